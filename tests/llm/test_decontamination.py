import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontamination
from tidemark.llm.decontamination import Matcher, decontaminate, keep_clean, merged, original_spans, windows
from tidemark.llm.queries import OP5_SQL, op5_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - size + 1) if b else 0):
            g = b[i : i + size]
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_query(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(c.execute(f"SELECT {', '.join(names)} FROM ({OP5_SQL})").fetchall())
    got = sorted(map(tuple, op5_decontamination(spark, sf).select(names).collect()))
    assert got == want and any(r[-1] for r in got)


@settings(max_examples=80, deadline=None)
@given(st.text("ab -É,", max_size=60), st.lists(st.text("ab É", max_size=14), max_size=4))
def test_matcher(text, texts):
    items = [(str(i), t) for i, t in enumerate(texts)]
    m = Matcher(items, 3)
    from tidemark.llm.common import words_of

    at, found = m.scan(words_of(text))
    hit = sum(b - a for a, b in merged(at))
    assert (len(words_of(text)), hit, sorted(found)) == plain(text, items, 3)
    for a, b in original_spans(text, merged(at)):
        assert words(text[a:b]) and text[a:b] == text[a:b].strip(" -,")


def test_windows():
    assert windows("a b", 10) == [[b"a", b"b"]] and windows("", 10) == windows(None, 10) == [] and len(windows("a " * 12, 10)) == 3


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([("q1", "Two, THREE four"), ("q1", "plage"), ("q2", None), ("q3", "!!"), (None, "seven")], "item_id string, text string")
    rows = decontaminate(odd, items).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11 and (by[1]["n_words"], by[2]["n_words"], by[6]["n_words"]) == (0, 0, 0)
    assert (by[3]["n_hit"], by[3]["items"]) == (4, ["", "q1"]) and [tuple(s) for s in by[3]["spans"]] == [(4, 18), (28, 33)]
    assert by[7]["n_hit"] == 1 and by[5]["n_words"] == 120_000
    kept = keep_clean(odd, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 8]
    assert decontaminate(empty, items).count() == 0 and decontaminate(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_one_automaton_at_any_size(spark, docs):
    """A benchmark of 3 MB has one automaton, with a fraction of the nodes that all its windows would take."""
    text = [r["text"] or "" for r in docs.collect()]
    items = spark.createDataFrame([(i, f"{t} number{i}") for i, t in enumerate(text * 8)], "item_id long, text string")
    parts = decontamination.benchmark_parts(items, "item_id", "text")
    matcher = decontamination.Scan(parts[0]).shared.value
    assert len(parts) == 1 and sum(map(len, text)) * 8 > 3_000_000
    assert matcher.automaton.get_stats()["nodes_count"] < len(matcher.words)
    rows = {r["doc_id"]: r for r in decontaminate(docs.limit(20), items).collect()}
    want = {r["doc_id"]: [str(i) for i, t in enumerate(text * 8) if len(words(t)) >= 10 and " ".join(words(t)) in " ".join(words(r["text"]))] for r in docs.limit(20).collect()}
    assert all(set(want[d]) <= set(r["items"]) and (r["n_hit"] == r["n_words"] or r["n_words"] < 10) for d, r in rows.items())


def test_parts(monkeypatch, spark, docs, sf, odd):
    """A benchmark beyond the bound for one broadcast is scanned in several passes, to the same result."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = spark.createDataFrame([("q1", "Two, THREE four"), ("q1", "plage"), ("q2", None), ("q3", "!!"), (None, "seven")], "item_id string, text string")

    def results():
        return [sorted((repr(r) for r in decontaminate(d, b).collect())) for d, b in ((docs, bench), (odd, items))] + [
            sorted((r["doc_id"] or 0) for r in keep_clean(d, b).collect()) for d, b in ((docs, bench), (odd, items))
        ]

    want = results()
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 30)
    assert len(decontamination.benchmark_parts(items, "item_id", "text")) > 2
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 3000)
    assert len(decontamination.benchmark_parts(bench, "item_id", "text")) > 1
    assert results()[::2] == want[::2]
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 30)
    assert [sorted(repr(r) for r in decontaminate(odd, items).collect()), sorted((r["doc_id"] or 0) for r in keep_clean(odd, items).collect())] == want[1::2]
