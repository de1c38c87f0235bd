"""Chat formatting: a hidden Markov model recovers speakers from transcripts; turns are rendered canonically.

States are a role at the first line of a turn, or inside one. A line is observed as its speaker marker (none,
one of the roles', or some other name's), whether an empty line precedes it, its class of length and whether it ends in
a question mark; given the state these are independent. All tables are counted from labelled conversations,
with part of the markers left out so that the model also learns to go without. Viterbi gives the most likely
states in log space, also over a conversation that stands in many pieces: the best way through each, from every state to
every state, is joined in order, and each piece is decoded between the states that the best path through all has there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hashed_sample, slices, small, written

ROLES = ("system", "user", "assistant")
#: Names that mark a speaker.
NAMES = {
    "system": "system instruction instructions context".split(),
    "user": "user human customer client student question q prompter".split(),
    "assistant": "assistant ai bot agent model answer a gpt".split(),
}
MARKER = re.compile(r"^\s{0,3}(?:[#>*_\[<|]{0,3})\s*([A-Za-z][A-Za-z0-9_ ]{0,20}?)\s*(?:[\]>*_|]{0,3})\s*:\s?(?:\*\*)?\s?")
_CLASS = {name: 1 + i for i, role in enumerate(ROLES) for name in NAMES[role]}
OTHER = 4
#: Labelled rows to learn from, in stretches of consecutive turn numbers, and the share of their markers left out.
SAMPLE, STRETCH, UNMARKED = 10_000, 64, 0.2
#: Words up to which a line is of each class of length; none and more are classes too.
LENGTHS = (0, 3, 6, 9, 12, 16, 20, 26, 34, 44, 60, 90)
#: Turn numbers in a piece, and lines after which a piece of rows closes.
TURNS, LINES = 256, 20_000
#: How a turn is rendered.
BEGIN, END = "<|{role}|>\n", "\n<|end|>"

STATES = 2 * len(ROLES)  # role r begins: 2r; goes on: 2r + 1
WIDTHS = (5, 2, len(LENGTHS) + 1, 2)


def observed(line: str, after_empty: bool) -> tuple[tuple[int, int, int, int], int]:
    """The four observations of a line, and the length of its marker."""
    m = MARKER.match(line)
    marker = (_CLASS.get(m[1].strip().lower(), OTHER)) if m else 0
    cut = m.end() if m else 0
    size = bisect_left(LENGTHS, len(line[cut:].split()))
    return (marker, int(after_empty), size, int(line.rstrip().endswith("?"))), cut if marker in (1, 2, 3) else 0


@dataclass
class Hmm:
    first: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    @staticmethod
    def fit(counts: np.ndarray) -> Hmm:
        """Log probabilities from the sum of `counted` over chains, each count with a half added."""
        first, step, *emit = (part + 0.5 for part in _parts(counts))
        first[1::2] = 1e-3
        for r in range(len(ROLES)):
            for q in range(len(ROLES)):
                if q != r:
                    step[2 * r : 2 * r + 2, 2 * q + 1] = 1e-6  # a role can't go on where another one spoke
        return Hmm(np.log(first / first.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in emit])

    def viterbi(self, seen: list[tuple[int, ...]], begins: int | None = None, ends: int | None = None) -> np.ndarray:
        """The most likely states; of equally likely ones the first. A conversation begins and ends here, or the states
        of the first and of the last line are given."""
        if not seen:
            return np.zeros(0, int)
        o = np.array(seen)
        score = sum(table[:, o[:, k]] for k, table in enumerate(self.emit)).T
        back = np.zeros((len(o), STATES), np.int8)
        now = score[0] + (self.first if begins is None else np.where(np.arange(STATES) == begins, 0, -np.inf))
        for t in range(1, len(o)):
            way = now[:, None] + self.step
            back[t] = way.argmax(0)
            now = way[back[t], np.arange(STATES)] + score[t]
        states = np.empty(len(o), int)
        states[-1] = now.argmax() if ends is None else ends
        for t in range(len(o) - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return states

    def spanned(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """From each state of the first line (rows) to each of the last: the best log probability of a path, without
        what the first line shows."""
        o = np.array(seen)
        score = sum(table[:, o[:, k]] for k, table in enumerate(self.emit)).T
        now = np.where(np.eye(STATES) > 0, 0, -np.inf)
        for t in range(1, len(o)):
            now = (now[:, :, None] + self.step).max(1) + score[t]
        return now

    def joined(self, pieces: list[tuple[np.ndarray, tuple[int, ...], bool]]) -> list[tuple[int, int, int]]:
        """For each piece of a conversation, in order: whether an empty line precedes it, and the states of its first
        and last line on the most likely path through all of them. A piece is what `spanned` gives, the observation
        of its first line, and whether its last line is empty."""
        ways, empty = [], False
        for span, o, blank in pieces:
            o = (o[0], int(empty), *o[2:])
            come = now[:, None] + self.step if ways else self.first[None]
            back = come.argmax(0)
            way = (come.max(0) + sum(table[:, k] for table, k in zip(self.emit, o)))[:, None] + span
            ways.append((int(empty), back, way.argmax(0)))
            now, empty = way.max(0), blank
        out, state = [], int(now.argmax())
        for before, back, start in reversed(ways):
            out.append((before, int(start[state]), state))
            state = int(back[start[state]])
        return out[::-1]


#: Shapes of the tables of counts, which stand in one array: first states, steps, and what states show.
SHAPES = [(STATES,), (STATES, STATES), *((STATES, w) for w in WIDTHS)]
COUNTS = sum(int(np.prod(x)) for x in SHAPES)


def _parts(counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(x)) for x in SHAPES])
    return [part.reshape(shape) for part, shape in zip(np.split(counts, ends[:-1]), SHAPES)]


def counted(states: list[int], seen: list[tuple[int, ...]], begins: bool = True) -> np.ndarray:
    """What a chain adds to the counts; begins: whether a conversation begins with it."""
    out = np.zeros(COUNTS)
    first, step, *emit = _parts(out)
    if states and begins:
        first[states[0]] += 1
    np.add.at(step, (states[:-1], states[1:]), 1)
    for k, table in enumerate(emit):
        np.add.at(table, (states, [o[k] for o in seen]), 1)
    return out


def transcript_lines(turns: list[tuple[str | None, str | None]]) -> tuple[list[str], list[int]]:
    """Lines of a transcript of (speaker, text) turns, and the number of the turn of each: a marker stands before
    the first line if the speaker is known."""
    lines: list[str] = []
    turn: list[int] = []
    for i, (speaker, text) in enumerate(turns):
        mark = f"{speaker}: " if speaker else ""
        for k, line in enumerate((text or "").split("\n")):
            lines.append(mark + line if not k else line)
            turn.append(i)
    return lines, turn


def observations(lines: list[str]) -> tuple[list[tuple[int, ...]], list[int]]:
    seen, cuts = [], []
    for i, line in enumerate(lines):
        o, cut = observed(line, i > 0 and not lines[i - 1].strip())
        seen.append(o)
        cuts.append(cut)
    return seen, cuts


def train(turns: DataFrame, most: int = SAMPLE) -> Hmm:
    """Learn from at most `most` rows with a known role: those of the stretches of STRETCH turn numbers of least hash, whole
    texts. Only tables of counts reach the driver, one a task. Rows without a known role are left out, null texts are empty
    turns, repeated rows count each; without any row all states are equally likely."""
    role = F.lower("role")
    rows = turns.where(role.isin(*ROLES)).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), "text")
    rows = rows.withColumn("stretch", F.expr(f"floor(turn / {STRETCH})"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chain, key = np.zeros(COUNTS), [], None

        def finish() -> None:
            if not chain:
                return
            shown = [r if xxhash.xxh3_64_intdigest(f"{key[0]}:{t}") % 1000 >= 1000 * UNMARKED else None for t, r, _ in chain]
            lines, turn = transcript_lines([(s, text) for s, (_, _, text) in zip(shown, chain)])
            states = [2 * ROLES.index(chain[t][1]) + (k > 0 and turn[k - 1] == t) for k, t in enumerate(turn)]
            total[:] += counted(states, observations(lines)[0], not key[1])

        for batch in batches:
            for conv, stretch, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, stretch) != key:
                    finish()
                    key, chain = (conv, stretch), []
                chain.append(row)
        finish()
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    order = ["conv_id", "stretch", "turn", "role", "text"]
    with Scratch(turns.sparkSession) as scratch:
        sample = scratch.written(hashed_sample(rows, ["conv_id", "stretch"], most), "sample")
        dealt = sample.select(order).repartition("conv_id", "stretch").sortWithinPartitions(order)
        found = dealt.mapInArrow(counts, "counts binary").collect()
    return Hmm.fit(sum((np.frombuffer(r["counts"], np.float64) for r in found), np.zeros(COUNTS)))


def rendered(role: str, text: str) -> str:
    return BEGIN.format(role=role) + text + END


def fragments(lines: list[str], cuts: list[int], states: np.ndarray, goes_on: bool = False) -> list[tuple[str, str]]:
    """(role, text) of the turns that these states part the lines into, without the markers. Lines that go on with another
    role than the one before are a turn too. goes_on: the first line belongs to a turn that began in an earlier piece."""
    turns: list[tuple[str, list[str]]] = [(ROLES[states[0] // 2], [])] if goes_on else []
    for line, cut, state in zip(lines, cuts, states):
        if state % 2 == 0 or not turns or turns[-1][0] != ROLES[state // 2]:
            turns.append((ROLES[state // 2], [line[cut:]]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(part)) for role, part in turns]


def parse_transcript(text: str | None, model: Hmm) -> list[tuple[str, str]]:
    """(role, text) turns of a raw transcript; none for an empty one. Recognised markers and empty lines at a turn's
    end go."""
    lines = (text or "").split("\n")
    if not any(x.strip() for x in lines):
        return []
    seen, cuts = observations(lines)
    return [(role, part.rstrip("\n")) for role, part in fragments(lines, cuts, model.viterbi(seen))]


def parse(transcripts: DataFrame, model: Hmm, id_col: str = "conv_id", text_col: str = "text", part_col: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, rendered of the turns of raw transcripts, numbered from 0.

    Each row is a transcript, or, with part_col, a piece of one: a transcript is then its rows in the order of part_col,
    with a line break between them that tells nothing of turns. Null and blank transcripts have no turns. Without
    part_col a repeated id is a transcript each, and a null id is kept; with it, null ids form one transcript, and pieces
    of equal number stand in the order of their text. An empty table gives no rows; other columns are ignored.

    Cost: one scan; with part_col, pieces are written and counted first, and the result is a written table. Only transcripts of several pieces go further: a row of 36
    numbers a piece meets in the order of pieces, and the turns are gathered by number.
    """
    spark = transcripts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = transcripts.select(F.col(id_col).cast("long").alias("conv_id"), (F.col(part_col) if part_col else F.lit(0)).cast("long").alias("part"), F.col(text_col).alias("text"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield _turns([(c, i, r, t, rendered(r, t)) for c, x in pairs for i, (r, t) in enumerate(parse_transcript(x, shared.value))])

    if part_col is None:
        return rows.select("conv_id", "text").mapInArrow(alone, SCHEMA)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            out = []
            for conv, part, order, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                seen, _ = observations(lines)
                out.append((conv, part, order, shared.value.spanned(seen).ravel().tolist(), list(map(int, seen[0])), not lines[-1].strip()))
            yield batch_of(out, SPANS)

    def guides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in _by_first(batches):
            ways = shared.value.joined([(np.array(p[2]).reshape(STATES, STATES), tuple(p[3]), p[4]) for p in parts])
            before = [None, *(way[2] for way in ways)]
            yield batch_of([(conv, p[0], p[1], *way, went) for p, way, went in zip(parts, ways, before)], GUIDES)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            out = []
            for conv, part, order, text, before, begins, ends, went in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                seen, cuts = observations(lines)
                seen[0] = (seen[0][0], before, *seen[0][2:])
                goes_on = went is not None and begins % 2 == 1 and went // 2 == begins // 2
                found = fragments(lines, cuts, shared.value.viterbi(seen, begins, ends), goes_on)
                out.extend((conv, part, order, i - goes_on, len(found) - goes_on, role, x) for i, (role, x) in enumerate(found))
            yield batch_of(out, FRAGMENTS)

    with Scratch(spark) as scratch:
        rows = scratch.written(rows, "pieces")  # read three times
        pieces = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.col("text").rlike(r"\S")).alias("said"))
        several = scratch.written(pieces.where("n > 1 AND said").select(F.col("conv_id").alias("id"), F.lit(True).alias("several")), "several")
        n = several.count()
        if not n:
            return written(rows.select("conv_id", "text").mapInArrow(alone, SCHEMA), "turns")
        flagged = rows.join(small(several, n), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
        one = flagged.where("several IS NULL").select("conv_id", "text").mapInArrow(alone, SCHEMA)
        many = scratch.written(flagged.where("several").select("conv_id", "part", F.monotonically_increasing_id().alias("order"), "text"), "many")
        found = scratch.written(many.mapInArrow(spans, _ddl(SPANS)), "spans")
        dealt = found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "order")
        guide = scratch.written(dealt.mapInArrow(guides, _ddl(GUIDES)), "guides")
        at = [many[c].eqNullSafe(guide[c]) for c in ("conv_id", "part", "order")]
        guided = many.join(guide, at).select(many["conv_id"], many["part"], many["order"], "text", "before", "begins", "ends", "went")
        parts = scratch.written(guided.mapInArrow(decoded, _ddl(FRAGMENTS)), "fragments")
        begun = parts.groupBy("conv_id", "part", "order").agg(F.max("begun").alias("begun"))
        earlier = Window.partitionBy("conv_id").orderBy("part", "order").rowsBetween(Window.unboundedPreceding, -1)
        offsets = scratch.written(begun.select("*", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("offset")), "offsets")
        at = [parts[c].eqNullSafe(offsets[c]) for c in ("conv_id", "part", "order")]
        numbered = parts.join(offsets, at).select(parts["conv_id"], (F.col("offset") + F.col("number")).alias("turn"), parts["part"], parts["order"], "number", "role", "text")
        text = F.array_sort(F.collect_list(F.struct("part", "order", "number", "text")))
        turns = numbered.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.array_join(F.transform(text, lambda x: x["text"]), "\n").alias("text"))
        turns = turns.withColumn("text", F.rtrim("text", F.lit("\n")))
        begin, end = (F.lit(x) for x in ("<|", BEGIN.removeprefix("<|{role}")))
        turns = turns.withColumn("rendered", F.concat(begin, "role", end, "text", F.lit(END)))
        return written(one.unionByName(turns.select("conv_id", "turn", "role", "text", "rendered")), "turns")


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a sorted table by their first column, with the other columns."""
    key, part = None, []
    for batch in batches:
        for first, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part and first != key:
                yield key, part
                part = []
            key = first
            part.append(row)
    if part:
        yield key, part


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, part, text: each conversation as raw text, in which neither roles nor turn boundaries are given other than by
    what speakers' names say, in pieces of TURNS turn numbers. Turns stand in the order of turn, role and text, with a
    line break between them. A hash of conv_id and turn leaves out the markers of UNMARKED of the turns and picks one of
    its role's NAMES for the others; turns of unknown role have none. Null texts are empty turns."""
    h = F.xxhash64("conv_id", "turn")
    name = F.lit(None).cast("string")
    for role, names in NAMES.items():
        pick = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.shiftrightunsigned(h, 20), F.lit(len(names))) + 1).cast("int"))
        name = F.when(F.lower("role") == role, F.initcap(pick)).otherwise(name)
    shown = F.when(F.pmod(h, F.lit(1000)) >= int(1000 * UNMARKED), F.concat(name, F.lit(": ")))
    row = F.struct("turn", "role", "text", F.concat(F.coalesce(shown, F.lit("")), F.coalesce("text", F.lit(""))).alias("said"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["said"]), "\n").alias("text")
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.expr(f"cast(floor(turn / {TURNS}) as long)").alias("part")).agg(said)


SCHEMA = "conv_id long, turn long, role string, text string, rendered string"


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "role", "text", "rendered"])


PLACE = {"conv_id": pa.int64(), "part": pa.int64(), "order": pa.int64()}
SPANS = PLACE | {"span": pa.list_(pa.float64()), "seen": pa.list_(pa.int32()), "blank": pa.bool_()}
GUIDES = PLACE | {"before": pa.int32(), "begins": pa.int32(), "ends": pa.int32(), "went": pa.int32()}
FRAGMENTS = PLACE | {"number": pa.int64(), "begun": pa.int64(), "role": pa.string(), "text": pa.string()}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.float64()): "array<double>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{c}` {names[k]}" for c, k in kinds.items())


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def recover(turns: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, turn, role, text, rendered of each row: its role as recovered from the transcript that the rows of
    its conversation form in the order of turn, with what stands in `role` as speaker marker where there is one.

    Null texts are empty turns; a null or unknown role is a turn without a usual marker, whose role comes from
    its surroundings. Rows with equal turn numbers stand in the order of role and text. Null ids form a
    conversation; an empty table gives no rows; columns other than conv_id, turn, role and text are ignored.

    Conversations are worked on in pieces of TURNS turn numbers that close once they pass LINES lines, so one of any length
    stays bounded in memory, and are decoded as a whole: a first pass gives the best way through each piece from
    every state to every state, those of a conversation are joined in order, and each piece is decoded between
    the states that the best path through all has at its ends. The result is a written table.

    Cost: two shuffles by conversation and stretch, and one by conversation of a row of 36 numbers a piece.
    """
    spark, most = turns.sparkSession, LINES
    shared = spark.sparkContext.broadcast(model)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("stretch", F.expr(f"floor(turn / {TURNS})"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[int] | None, list[tuple]]]:
        """(conversation, stretch), number in the stretch, guide of the stretch if any, and rows of each piece."""
        part: list[tuple] = []
        key, n, lines, guide = None, 0, 0, None
        for batch in batches:
            for conv, stretch, turn, role, text, states in zip(*(c.to_pylist() for c in batch.columns)):
                if part and ((conv, stretch) != key or lines > most):
                    yield key, n, guide, part
                    part, lines, n = [], 0, n + 1
                if (conv, stretch) != key:
                    key, n, guide = (conv, stretch), 0, None
                if states is not None:
                    guide = states
                    continue
                part.append((conv, turn, role, text))
                lines += 1 + (text or "").count("\n")
        if part:
            yield key, n, guide, part

    spanned = {"conv_id": pa.int64(), "stretch": pa.int64(), "piece": pa.int32(), "span": pa.list_(pa.float64()), "seen": pa.list_(pa.int32()), "blank": pa.bool_()}
    guided = {"conv_id": pa.int64(), "stretch": pa.int64(), "states": pa.list_(pa.int32())}

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, stretch), n, _, part in pieces(batches):
            lines, _ = transcript_lines([(p[2], p[3]) for p in part])
            seen, _ = observations(lines)
            out.append((conv, stretch, n, shared.value.spanned(seen).ravel().tolist(), list(map(int, seen[0])), not lines[-1].strip()))
            if len(out) >= 1000:
                yield batch_of(out, spanned)
                out = []
        yield batch_of(out, spanned)

    def guides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def join(conv: int | None, parts: list[tuple]) -> None:
            if len(parts) > 1:
                states: dict[int | None, list[int]] = {}
                ways = shared.value.joined([(np.array(p[1]).reshape(STATES, STATES), tuple(p[2]), p[3]) for p in parts])
                for p, way in zip(parts, ways):
                    states.setdefault(p[0], []).extend(way)
                out.extend((conv, stretch, guide) for stretch, guide in states.items())

        key, parts = None, []
        for batch in batches:
            for conv, stretch, _, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != key:
                    join(key, parts)
                    key, parts = conv, []
                parts.append((stretch, *rest))
            yield batch_of(out, guided)
            out.clear()
        join(key, parts)
        yield batch_of(out, guided)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, n, guide, part in pieces(batches):
            lines, turn = transcript_lines([(p[2], p[3]) for p in part])
            seen, _ = observations(lines)
            if guide:
                before, begins, ends = guide[3 * n : 3 * n + 3]
                seen[0] = (seen[0][0], before, *seen[0][2:])
                states = shared.value.viterbi(seen, begins, ends)
            else:
                states = shared.value.viterbi(seen)
            first = {t: k for k, t in reversed(list(enumerate(turn)))}
            for i, p in enumerate(part):
                role = ROLES[states[first[i]] // 2]
                out.append((p[0], p[1], role, p[3] or "", rendered(role, p[3] or "")))
            if len(out) >= 1000:
                yield _turns(out)
                out = []
        yield _turns(out)

    order = ["conv_id", "stretch", "turn", "role", "text"]
    plain = rows.select(*order, F.lit(None).cast("array<int>").alias("states"))
    with Scratch(spark) as scratch:
        dealt = plain.repartition("conv_id", "stretch").sortWithinPartitions(*order)
        found = scratch.written(dealt.mapInArrow(spans, _ddl(spanned)), "spans")
        ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "piece")
        guide = scratch.written(ordered.mapInArrow(guides, _ddl(guided)), "guides")
        none = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"))]
        both = plain.unionByName(guide.select("conv_id", "stretch", *none, "states"))
        # A stretch's guide comes before its rows.
        dealt = both.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", F.col("states").isNull(), *order[2:])
        return written(dealt.mapInArrow(decoded, SCHEMA), "turns")
