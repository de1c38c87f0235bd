import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import Encoder, LevelArray, pack
from tidemark.llm.queries import byte_bpe, op3_packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_bpe())


def check(rows, texts, tokenizer, capacity=2048):
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, found in pieces.items():
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert set(pieces) == set(ids)
    lengths = []
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        lengths.append(at)
    # Full, or a power of two: no padding at all.
    assert all(n <= capacity and n & (n - 1) == 0 for n in lengths)


def test_query(spark, sf, texts, tokenizer):
    check(op3_packing(spark, sf).collect(), texts, tokenizer)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizers(texts, name):
    path = public_tokenizers.path(name)
    e, t = Encoder(path), Tokenizer.from_file(path)
    assert (e.fast is not None) == name.startswith("byte")
    for x in [*list(texts.values())[:60], "a <|endoftext|> b", "", "  \n\t x", "日本語 déjà vu 🙂", "a" * 5000, "​\x00 ' 'll 's"]:
        assert list(e(x)) == t.encode(x, add_special_tokens=False).ids


def test_levels_keep_the_sum_of_squares_least():
    rng = np.random.default_rng(3)
    a = LevelArray(16)
    for _ in range(400):
        size = int(rng.integers(1, 16))
        n = a.counts[1:16].copy()

        def cost(level, n=n, size=size):
            m = n.copy()
            if level:
                m[level - 1] -= 1
            if level + size < 16:
                m[level + size - 1] += 1
            return int((m**2).sum())

        choices = [0] + [h for h in range(1, 17 - size) if n[h - 1]]
        assert cost(a.level_for(size)) == min(map(cost, choices))
        a.place((0, 0, np.zeros(size, "<u4"), size), size)


def test_ids_round_trip(spark, docs, texts, tokenizer):
    rows = pack(docs, byte_bpe(), capacity=256).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r["doc_id"]][r["start"]] = r["ids"]
    for d, parts in got.items():
        assert [i for s in sorted(parts) for i in parts[s]] == tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [1]
    check(rows, texts, tokenizer, 256)


def test_odd_rows(odd, empty):
    rows = pack(odd, byte_bpe(), capacity=64).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] in (1, 2)) == 2
    assert len([r for r in rows if r["start"] == 0]) == 11
    assert pack(empty, byte_bpe()).count() == 0
