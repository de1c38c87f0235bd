import gzip
import io

import duckdb
import pytest

from tidemark.llm import warc
from tidemark.llm.queries import OP4_SQL, op4_warc


def test_query(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(map(repr, c.execute(f"SELECT {', '.join(names)} FROM ({OP4_SQL})").fetchall()))
    assert sorted(repr(tuple(r)) for r in op4_warc(spark, sf).select(names).collect()) == want


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "é", "WARC/1.1\r\n\r\n" * 3), (5, "é", "other"), (6, "big", "x" * 300_000), (None, "n", "same"), (7, "u", "x" * 300_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("kind", ["gzip", "none"])
def test_round_trip(spark, pages, tmp_path, kind):
    path = str(tmp_path / "w")
    warc.register(spark)
    warc.page_records(pages).repartition(2).write.format("warc").mode("append").option("compression", kind).save(path)
    rows = {(r["record_id"], r["payload_digest"]): r for r in warc.read(spark, path).collect()}
    assert len(rows) == 9
    by = lambda i: [r for k, r in rows.items() if k[0] == f"<urn:page:{i}>"]
    assert by(1)[0]["warc_type"] == "response" and bytes(by(1)[0]["payload"]) == b"same"
    assert (by(3)[0]["warc_type"], by(3)[0]["refers_to"], by(3)[0]["payload"], by(3)[0]["payload_bytes"]) == ("revisit", "<urn:page:1>", None, 4)
    assert by(3)[0]["target_uri"] == "http://a/%0D%0AX: y" and by(1)[0]["target_uri"] is None
    assert by(4)[0]["refers_to"] == "<urn:page:2>" and by("")[0]["warc_type"] == "revisit"
    assert bytes(by(6)[0]["payload"]) == b"x" * 300_000 and by(7)[0]["payload_bytes"] == 300_000
    assert sorted(bytes(r["payload"]) for r in by(5)) == sorted([b"WARC/1.1\r\n\r\n" * 3, b"other"])
    assert all(r["payload_digest"] == warc.digest_of(bytes(r["payload"])) for r in rows.values() if r["payload"] is not None)


def test_pushdown(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_pages(pages, path)
    df = warc.read(spark, path, ["warc_type", "record_id"]).where("warc_type = 'revisit' AND record_id IN ('<urn:page:3>', '<urn:page:2>')")
    assert [r["record_id"] for r in df.collect()] == ["<urn:page:3>"]
    assert "Filter " not in df._jdf.queryExecution().executedPlan().toString()
    kept = warc.read(spark, path).where("payload_bytes > 100000")
    assert kept.count() == 2
    assert warc.read(spark, path).where("target_uri LIKE 'b%'").count() == 1
    warc.write_pages(pages.where("page_id = 1"), path)
    assert warc.read(spark, path, ["record_id"]).count() == 10


def test_small_payloads_are_responses(pages):
    rows = warc.page_records(pages, least_bytes=5).where("warc_type = 'revisit'").collect()
    assert [r["record_id"] for r in rows] == ["<urn:page:7>"]


def test_foreign_archives(spark, tmp_path):
    """Members without lengths, several records in one member, other record types, files without a manifest."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [{"warc_type": "response", "record_id": f"<{i}>", "payload": b"p" * i} for i in range(4)]
    body = info + b"".join(map(warc.record_bytes, rows))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(body))
    (tmp_path / "y.warc").write_bytes(body)
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.read(spark, str(tmp_path)).collect()
    assert len(got) == 10 and {(r["record_id"], r["payload_bytes"]) for r in got} == {("<a>", 5), *((f"<{i}>", i) for i in range(4))}
    assert [bytes(r["payload"]) for r in got if r["warc_type"] == "warcinfo"] == [b"hello"] * 2
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(body[:-30]), False, {"payload"}, lambda r: True))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_malformed_messages(spark, tmp_path):
    """Whatever a record's block holds, it is the bytes that content-length tells, and the next record comes whole."""
    def block(data, kind=b"application/http; msgtype=response", end=b"\r\n"):
        head = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <x>", b"Content-Type: " + kind, b"Content-Length: %d" % len(data)]
        return end.join(head) + end * 2 + data + end * 2

    good = warc.record_bytes({"warc_type": "response", "record_id": "<y>", "payload": b"good"})
    cases = [(b"HTTP/1.1 200 OK\r\nContent-Length: 9", None), (b"HTTP/1.1 200 OK\nA: b\n\nbody", b"body"), (b"HTTP/1.1 200 OK\r\n\r\n", b""), (b"", b""), (b"x" * 200_000, None)]
    for end in (b"\r\n", b"\n"):
        plain = b"".join(block(data, end=end) + good for data, _ in cases)
        for name, body in (("a.warc", plain), ("b.warc.gz", gzip.compress(plain)), ("c.warc.gz", b"".join(map(warc.member, [block(d, end=end) for d, _ in cases] + [good])))):
            (tmp_path / name).write_bytes(body)
            rows = list(warc.records(io.BytesIO(body), name.endswith("gz"), {"payload", "payload_bytes", "digest_ok"}, lambda r: True))
            mine = [r for r in rows if r["record_id"] == "<x>"]
            assert [(r["payload"], r["payload_bytes"]) for r in mine] == [(p if p is not None else d, len(p if p is not None else d)) for d, p in cases]
            assert all(r["digest_ok"] is None for r in mine)
            assert [(r["payload"], r["digest_ok"]) for r in rows if r["record_id"] == "<y>"] == [(b"good", True)] * (1 if name.startswith("c") else len(cases))
            for wanted in (set(), {"payload_bytes"}):
                assert len(list(warc.records(io.BytesIO(body), name.endswith("gz"), wanted, lambda r: True))) == len(rows)
    wrong = good.replace(b"good", b"evil")
    assert [r["digest_ok"] for r in warc.records(io.BytesIO(wrong), False, {"digest_ok"}, lambda r: True)] == [False]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"no record\r\n\r\n"), False, set(), lambda r: True))


def test_several_records_in_a_member_with_a_length():
    """A seek to the next member needs the record to be all of it."""
    rows = [warc.record_bytes({"warc_type": "response", "record_id": f"<{i}>", "payload": b"p" * 50 * i}) for i in range(3)]
    body = warc.member(b"".join(rows)) + warc.member(rows[0])
    got = [r["record_id"] for r in warc.records(io.BytesIO(body), True, set(), lambda r: r["record_id"] != "<1>")]
    assert got == ["<0>", "<2>", "<0>"]


def test_overwrite(spark, pages, tmp_path):
    """The new manifest replaces the old one at once, whether or not the old files go."""
    path = str(tmp_path / "w")
    warc.write_pages(pages, path)
    kept = {f.name: f.read_bytes() for f in (tmp_path / "w").iterdir()}
    warc.page_records(pages.where("page_id = 4")).write.format("warc").mode("overwrite").save(path)
    assert [r["record_id"] for r in warc.read(spark, path, ["record_id"]).collect()] == ["<urn:page:4>"] and not kept.keys() & {f.name for f in (tmp_path / "w").iterdir()}
    for name, data in kept.items():  # as after a crash before they were deleted
        (tmp_path / "w" / name).write_bytes(data)
    assert [r["record_id"] for r in warc.read(spark, path, ["record_id"]).collect()] == ["<urn:page:4>"]


def test_hot_payloads(pages, monkeypatch):
    """A payload of many pages learns its first page by a broadcast, to the same rows."""
    want = sorted(map(repr, warc.page_records(pages).collect()))
    for hot in (2, 3):
        monkeypatch.setattr(warc, "HOT", hot)
        assert sorted(map(repr, warc.page_records(pages).collect())) == want


def test_abort(tmp_path):
    """An aborted write takes its archives away; others stay."""
    for name in ("a.warc.gz", "b.warc.gz"):
        (tmp_path / name).write_bytes(b"x")
    warc.WarcWriter(str(tmp_path), True, 6, False).abort([None, warc.Archives(["a.warc.gz"])])
    assert [f.name for f in tmp_path.iterdir()] == ["b.warc.gz"]
