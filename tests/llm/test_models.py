"""Trees, calibration, and both classifiers by held-out accuracy; chat roles."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.llm import chat, quality, toxicity
from tidemark.llm.queries import op6_quality, op7_toxicity, op9_chat
from tidemark.llm.trees import Isotonic, fit


def auc(score, label):
    score, label = np.asarray(score, float), np.asarray(label)
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def plain_walk(forest, row):
    total = forest.bias
    for root in forest.roots:
        node = root
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return total


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.1)).astype(float)
    f = fit(x[:1000], y[:1000], trees=40)
    assert auc(f.probability(x[1000:]), y[1000:]) > 0.98
    assert np.allclose(f.raw(x[:50]), [plain_walk(f, r) for r in x[:50]])
    none = fit(np.zeros((0, 3)), np.zeros(0))
    assert none.probability(np.zeros((2, 3))) == pytest.approx([0.5, 0.5]) and len(f.probability(np.zeros((0, 5)))) == 0
    assert fit(x, np.ones(len(x))).probability(x[:1])[0] > 0.9


def test_isotonic():
    rng = np.random.default_rng(1)
    s = rng.random(2000)
    y = (rng.random(2000) < s**2).astype(float)
    c = Isotonic.fit(s, y)
    grid = np.linspace(0, 1, 200)
    assert (np.diff(c(grid)) >= 0).all() and np.abs(c(grid) - grid**2).mean() < 0.05
    assert Isotonic.fit(np.zeros(0), np.zeros(0))(np.array([0.5])) == pytest.approx([0.5])


@pytest.mark.parametrize(
    ("query", "label", "least", "size", "precision", "recall"), [(op6_quality, "quality", 0.97, "sf0.01", 0.95, 0.95), (op7_toxicity, "toxic", 0.98, "sf0.1", 0.9, 0.85)]
)
def test_held_out(spark, query, label, least, size, precision, recall):
    folder = f"{TESTDATA}/{size}"
    rows = query(spark, folder).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) >= 1000 and len(held) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert auc([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) >= least
    # At the threshold, and calibrated: scores add up to about the number of positives.
    hits = sum(r["predicted"] and labels[r["doc_id"]] == 1 for r in held)
    positive = sum(labels[r["doc_id"]] == 1 for r in held)
    assert hits >= precision * sum(r["predicted"] for r in held) and hits >= recall * positive
    assert abs(sum(r["score"] for r in held) - positive) <= 0.15 * positive + 3
    assert all(r["predicted"] == (r["score"] >= (0.5 if label == "quality" else 0.3)) for r in rows)


def plain_statistics(text):
    if not text:
        return [0.0] * 32
    data, words, lines = text.encode(), text.split(), [x.strip() for x in text.split("\n") if x.strip()]
    n, m, share = max(1, len(words)), max(1, len(lines)), lambda chars: sum(b in chars for b in data) / len(data)
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"#$%&*@^~_+=<>/\\", b"\"'()[]{}", bytes(range(128, 256))]
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(len(data)), math.log1p(len(words)), *map(share, sets), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)),
        sum(x <= 2 for x in sizes) / len(sizes), sum(x >= 12 for x in sizes) / len(sizes), len(set(words)) / n, len(set(words)) / n**0.8, max((words.count(w) for w in set(words)), default=0) / n,
        sum(a == b for a, b in pairs) / n, len(set(pairs)) / n, sum(w.isupper() for w in words) / n, sum(w.islower() for w in words) / n, sum(w.isalpha() for w in words) / n,
        math.log1p(len(lines)), math.log1p(len(words) / m), len(set(lines)) / m, sum(x.endswith((".", "!", "?")) for x in lines) / m, sum(x[0] in "|-*#" for x in lines) / m, sum(x[0].isupper() for x in lines) / m,
    ]


def plain_features(text, lexicon):
    if not text:
        return [0.0] * toxicity.WIDTH
    word = re.compile(rb"[0-9a-z\x80-\xff]+")

    def split(t):
        return word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))

    def weigh(w):
        return max([lexicon.get(w, 0.0)] + [lexicon.get(w[:k] + b"*", 0.0) for k in (4, 5, 6, 7, 8) if len(w) >= k])

    words = split(text.lower())
    w, n, raw = [weigh(x) for x in words], max(1, len(words)), text.split()
    bad = [i for i, x in enumerate(w) if x >= 1.5]
    you = [i for i, x in enumerate(words) if x in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in bad)
    odd = [x for x in raw if re.search(r"[013457@$!]", x) and any(c.isalpha() for c in x)]
    hidden = sum(weigh(p) >= 1.5 for x in odd for p in split(x.lower().rstrip("!").translate(toxicity.LEET)))
    top = sorted(w, reverse=True)
    kinds = len({words[i] for i in bad})
    return [
        len(bad) / n, sum(x >= 2.5 for x in w) / n, sum(x >= 3.5 for x in w) / n, sum(x >= 4.5 for x in w) / n, sum(w) / n, sum(w) / n**0.5, math.log1p(len(bad)), kinds / n, math.log1p(kinds),
        *(sum(top[:k]) / min(k, len(top)) if top else 0.0 for k in (1, 3, 8)), near / n, near / max(1, len(bad)), len(you) / n, sum(x.isupper() for x in raw) / max(1, len(raw)),
        sum(c.isupper() for c in text) / len(text), text.count("!") / n, text.count("?") / n, len(odd) / max(1, len(raw)), hidden / n, math.log1p(n),
    ]


def test_scores_by_plain_code(spark, texts):
    """Statistics, features, tree walk and calibration of some texts, worked out step by step, give the queries' scores."""
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    none = F.lit(False)
    some = {d: t for d, t in texts.items() if d % 5 == 0} | {-1: None, -2: "", -3: "YOU m0ron!!! you are a $tupid\n\n|x|", -4: "é" * 50}
    rows = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    forest, model = quality.train(docs, labels, none), toxicity.train(docs, labels, none)
    assert len(model.lexicon) > 5
    for r in quality.score(rows, forest).collect():
        x = plain_statistics(some[r["doc_id"]])
        assert quality.statistics(some[r["doc_id"]]) == pytest.approx(x, abs=1e-12)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-plain_walk(forest, quality.statistics(some[r["doc_id"]])))), abs=1e-12)
    for r in toxicity.score(rows, model).collect():
        x = plain_features(some[r["doc_id"]], model.lexicon)
        assert toxicity.features(some[r["doc_id"]], model.lexicon, {}) == pytest.approx(x, abs=1e-12)
        p = 1 / (1 + math.exp(-plain_walk(model.forest, toxicity.features(some[r["doc_id"]], model.lexicon, {}))))
        assert r["score"] == pytest.approx(min(1, max(0, 0.99 * np.interp(p, model.calibration.x, model.calibration.y) + 0.01 * p)), abs=1e-12)


def test_sample_is_bounded(spark, monkeypatch):
    """Rows of one id, alike or not, don't pass the bound; nor do ids."""
    from tidemark.llm.common import Scratch, hashed_sample

    docs = spark.createDataFrame([(i % 50, f"text {i % 200}") for i in range(2000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    with Scratch(spark) as scratch:
        whole = quality.labelled_sample(docs, labels, "quality", F.lit(False), 1000, scratch)
        assert whole.count() == 200 and whole.groupBy("doc_id", "text").count().where("count > 1").count() == 0
        few = quality.labelled_sample(docs, labels, "quality", F.lit(False), 20, scratch)
        assert 0 < few.count() <= 20 and few.select("doc_id").distinct().count() <= 20
    ids = spark.range(5000).withColumn("x", F.col("id") % 7)
    least = [r["id"] for r in ids.orderBy(F.xxhash64("id")).limit(100).collect()]
    assert sorted(r["id"] for r in hashed_sample(ids, ["id"], 100).collect()) == sorted(least) and hashed_sample(ids, ["id"], 9000).count() == 5000
    # Whole keys only: 714 or 715 rows of each.
    assert hashed_sample(ids, ["x"], 1500).groupBy("x").count().count() == 2 and hashed_sample(ids, ["x"], 700).count() == 0


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    none = F.lit(False)
    for module in (quality, toxicity):
        model = module.train(odd, labels, none)
        assert module.score(odd, model).count() == 11 and module.score(empty, model).count() == 0
        unlearned = module.train(empty, labels.limit(0), none)
        assert all(0 <= r["score"] <= 1 for r in module.score(odd, unlearned).collect())
    kept = toxicity.keep_clean(odd, toxicity.train(odd, labels.limit(0), none), 1.1)
    assert kept.columns == odd.columns and kept.count() == 11


def test_toxicity_features():
    lexicon = {b"moron": 4.0, b"stup*": 3.0}
    x = toxicity.features("You m0ron are a STUPID moron!", lexicon, {})
    assert len(x) == toxicity.WIDTH and x[0] == 2 / 6 and x[20] > 0 and x[12] > 0
    assert toxicity.features(None, lexicon, {}) == toxicity.features("", lexicon, {}) == [0.0] * toxicity.WIDTH


def test_capitals_of_the_whole_text():
    """Every character counts, whatever the length: a stride over the text would miss these, or see nothing else."""
    for text, share in (("b" + "a" * 62 + "B", 1 / 64), ("B" + "a" * 63, 1 / 64)):
        assert toxicity.features(text * 2000, {}, {})[16] == pytest.approx(share)
    shouted = "a " * 60_000 + "LOUD" * 100 + " a" * 4_000
    assert toxicity.features(shouted, {}, {})[16] == pytest.approx(400 / len(shouted))


# Chat


def test_given_roles_stay(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = {(r["conv_id"], r["turn"]): r for r in chat.recover(turns, chat.train(turns)).collect()}
    want = turns.collect()
    assert len(rows) == len(want)
    for r in want:
        got = rows[r["conv_id"], r["turn"]]
        assert got["role"] == r["role"] and got["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>"


def test_raw_transcripts(spark):
    """Turns of held-out conversations, whose roles and boundaries no column gives, against those held back."""
    folder = f"{TESTDATA}/sf0.1"
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    got, want, texts = {}, {}, {r["conv_id"]: r["text"] for r in chat.raw_transcripts(turns).collect()}
    for r in op9_chat(spark, folder).where("held_out").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["rendered"]))
    for r in turns.orderBy("conv_id", "turn", "role", "text").collect():
        if r["conv_id"] in got:
            want.setdefault(r["conv_id"], []).append((r["role"], chat.rendered(r["role"], (r["text"] or "").rstrip("\n"))))
    n = sum(map(len, want.values()))
    marked = sum(chat.observed(line, False)[1] > 0 for c in want for line in texts[c].split("\n"))
    assert 0.7 * n < marked < 0.9 * n
    exact = sum(len(set(got[c]) & set(want[c])) for c in want) / n
    print(f"{len(want)} conversations, {n} turns, {marked} marked lines, exact {exact:.3f}")
    assert exact >= 0.75


def test_transcripts_in_pieces(spark, model, monkeypatch):
    """Cut into pieces, a transcript has the turns that it has as a whole, also where a turn goes over several."""
    monkeypatch.setattr(chat, "TURNS", 3)
    rng = np.random.default_rng(5)
    words = lambda: " ".join(["word"] * int(rng.integers(1, 40)))
    rows = [(c, i, ("user", "assistant", None)[int(rng.integers(3))], "\n".join(words() for _ in range(int(rng.integers(1, 6)))) if rng.random() < 0.9 else None) for c in range(6) for i in range(5 * c + 1)]
    rows += [(None, i, None, f"lost {i}") for i in range(7)] + [(9, i, None, None) for i in range(7)] + [(8, None, "user", "no number"), (8, 1, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.raw_transcripts(turns)
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: -1 if r["part"] is None else r["part"]):
        whole.setdefault(r["conv_id"], []).append(r["text"])
    assert max(map(len, whole.values())) > 5
    got = {}
    for r in sorted(chat.parse(pieces, model, part_col="part").collect(), key=lambda r: r["turn"]):
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"], r["rendered"]))
    want = {c: [(i, role, text, chat.rendered(role, text)) for i, (role, text) in enumerate(chat.parse_transcript("\n".join(x), model))] for c, x in whole.items()}
    assert got == {c: x for c, x in want.items() if x} and 9 not in got


def test_training_reads_whole_texts(spark):
    """Lines beyond any prefix count, and so do stretches within a long conversation."""
    long = "\n".join(["a line of some words here"] * 3000)
    rows = [(1, i, ("user", "assistant")[i % 2], long if i % 2 else "hi") for i in range(200)] + [(1, 5, None, "x"), (None, None, "user", None)]
    model = chat.train(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert np.exp(model.step[5, 5]) > 0.999 and np.exp(model.first[2]) > 0.3
    few = chat.train(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=64)
    assert np.isfinite(few.step).all()
    assert np.isfinite(chat.train(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0)).step).all()


@pytest.fixture(scope="module")
def model(spark, sf):
    return chat.train(spark.read.parquet(f"{sf}/conversations.parquet"))


def test_viterbi_is_the_best_path(model):
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(4):
        seen = [tuple(int(rng.integers(w)) for w in chat.WIDTHS) for _ in range(5)]

        def value(path, seen=seen):
            v = model.first[path[0]]
            for t, s in enumerate(path):
                v += sum(m[s, o] for m, o in zip(model.emit, seen[t])) + (model.step[path[t - 1], s] if t else 0)
            return v

        best = max(product(range(chat.STATES), repeat=5), key=value)
        assert value(tuple(model.viterbi(seen))) == pytest.approx(value(best))


def test_transcripts(spark, model):
    text = "Human: what is it?\nmore of it\n\nAssistant: it is this.\nNote: a colon\nAnd more.\nUser: thanks"
    turns = chat.parse_transcript(text, model)
    assert turns == [("user", "what is it?\nmore of it"), ("assistant", "it is this.\nNote: a colon\nAnd more."), ("user", "thanks")]
    assert chat.parse_transcript(None, model) == chat.parse_transcript("\n \n", model) == []
    df = spark.createDataFrame([(1, text), (2, None)], "conv_id long, text string")
    assert chat.parse(df, model).count() == 3


def test_missing_markers(spark, model):
    rows = [(1, 0, "user", "hello there", "x"), (1, 1, None, "a long answer. " * 30 + "\nwith lines\nand lines", "x"), (1, 2, "user", None, "x"), (None, None, None, "lost", "x"), (2, 0, "tool", "{}", "x"), (2, 0, "tool", "{}", "x")]
    got = chat.recover(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stretch string"), model).collect()
    roles = {(r["conv_id"], r["turn"]): r["role"] for r in got}
    assert len(got) == 6 and roles[1, 0] == roles[1, 2] == "user" and roles[1, 1] == "assistant"
    assert chat.recover(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string").limit(0), model).count() == 0


def test_long_conversation(spark, model):
    rows = [(1, i, ("user", "assistant")[i % 2], f"line {i}\nnext") for i in range(1500)]
    got = chat.recover(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), model).orderBy("turn").collect()
    assert [r["role"] for r in got] == [r[2] for r in rows]


@pytest.mark.parametrize("lines", [20_000, 7])
def test_states_carry_over_between_pieces(spark, model, monkeypatch, lines):
    """A long conversation without markers after its beginning has the roles of one Viterbi pass over all of it."""
    monkeypatch.setattr(chat, "TURNS", 8)
    monkeypatch.setattr(chat, "LINES", lines)
    rng = np.random.default_rng(3)
    texts = ["\n".join("w " * int(rng.integers(0, 60)) + "?" * int(rng.integers(2)) for _ in range(rng.integers(1, 5))) for _ in range(90)]
    rows = [(c, i, "user" if i < 1 + c else None, t) for c in (1, 2) for i, t in enumerate(texts[: 60 + 30 * (c - 1)])] + [(3, 0, "user", "hi")]
    got = chat.recover(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), model).collect()
    want = {(3, 0): "user"}
    for c in (1, 2):
        of, turn = chat.transcript_lines([(r[2], r[3]) for r in rows if r[0] == c])
        states = model.viterbi(chat.observations(of)[0])
        want |= {(c, t): chat.ROLES[states[turn.index(t)] // 2] for t in set(turn)}
    assert len(got) == len(rows) and {(r["conv_id"], r["turn"]): r["role"] for r in got} == want
