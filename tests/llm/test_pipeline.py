"""The pipeline, stage by stage, against what each stage must have done."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.llm import ngram_join
from tests.llm.test_decontamination import plain as plain_hits
from tests.llm.test_decontamination import words
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secrets import plain as plain_secrets
from tests.llm.test_similar import closure, plain_text_links


@pytest.fixture(scope="module")
def sf():
    return f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The input and each stage's result, written and read again."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxicity(spark, sf, stages):
    before, after = texts_of(stages[0]), texts_of(stages[1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(before) - set(after)
    clean = [d for d, y in labels.items() if y == 0]
    assert gone and sum(d in gone for d in clean) <= 0.05 * len(clean) and all(after[d] == before[d] for d in after)


def test_near_duplicates(stages):
    before, after = texts_of(stages[1]), texts_of(stages[2])
    least = closure(plain_text_links(before), before)
    assert after == {d: t for d, t in before.items() if least[d] == d} and len(after) < len(before)


def test_decontamination(spark, sf, stages):
    before, after = texts_of(stages[2]), texts_of(stages[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(max(1, len(words(t)) - 9)) if words(t)}
    sizes = {len(g) for g in grams}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert len(after) < len(before) and {d for d, t in before.items() if hit(t)} == set(before) - set(after)
    assert all(plain_hits(before[d], items)[1] for d in set(before) - set(after))


def test_secrets(stages):
    before, after = texts_of(stages[3]), texts_of(stages[4])
    assert set(before) == set(after)
    for d, t in before.items():
        assert (after[d] == t) == (plain_secrets(t) == "") and (plain_secrets(after[d]) == "" or "[secret]" in after[d])
    assert stages[4].where(F.length("text") != F.col("n_chars")).join(stages[3].where(F.length("text") != F.col("n_chars")), "doc_id", "left_anti").count() == 0


def test_packing_and_run(spark, sf, stages):
    from tokenizers import Tokenizer

    from tidemark.llm.queries import byte_bpe

    check_packing(stages[5].collect(), texts_of(stages[4]), Tokenizer.from_file(byte_bpe()))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert set(key) <= set(stages[5].columns) and total(corpus_pipeline.run(spark, sf)) == total(stages[5])


def test_rows_that_share_an_id_or_have_none(spark):
    """Documents are rows: of three equal texts under one id and none, one stays; different texts of one id are apart."""
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    a, b, c = " ".join(base), " ".join(near), " ".join(f"z{i}" for i in range(30))
    rows = [(1, a), (1, a), (None, a), (2, b), (3, c), (3, b), (None, c), (None, None), (None, None), (4, ""), (4, ""), (5, "!!"), (None, "lone words of a text without an id")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, _id int")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    want = [(1, a), (3, c), (None, None), (None, None), (4, ""), (4, ""), (5, "!!"), (None, "lone words of a text without an id")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_odd_rows(spark, sf, odd, empty):
    """Every filtering stage takes nulls, empty and long texts, ties, clashing names and no rows at all."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        texts = [r["text"] for r in out.collect()]
        assert texts.count(None) == 2 and "" in texts and any(len(t or "") > 500_000 for t in texts), name
        assert stage(spark, empty, sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).select("doc_id").distinct().count() == 9
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
