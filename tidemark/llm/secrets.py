"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by its content (SHA-256). The ledger is a table of (blob, rule version,
spans), in a folder for each rule version; a scan runs only over blobs that it lacks under the current one, each once
however many paths hold it, appends what it finds, and joins the findings back to all paths. A test for any rule's
pattern comes first, so only texts with a possible finding move; of the others their addresses do.

Places come without any per-row code: splitting a text at a pattern gives the gaps between the matches that
regexp_extract_all returns, so a running sum over the lengths of gaps and matches gives each start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, new_path, unused, written

# The three base rules, in the order that breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: A hex run of 32 or more is a maximal run that passes its length filter, so the filter stands in the pattern.
RULES = (Rule("assign", ASSIGN, 2, 8), Rule("access", ACCESS, 0, 16), Rule("hex", HEX, 0, 32))
#: Goes with every finding; raise it with any change to RULES.
RULE_VERSION = "base-1"

SPAN = "struct<start:long,kind_order:int,kind:string,end:long>"
LEDGER_SCHEMA = f"blob binary, spans array<{SPAN}>, rule_version string"
#: Array elements that are folded at once: appending to an array copies it, so long ones are built from pieces.
CHUNK = 64
#: Unseen blobs that are few enough to be broadcast: some 15 MB.
FEW = 100_000


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def matches(text: str, rule: Rule, order: int) -> Column:
    """All spans of a rule in the text column, leftmost and non-overlapping, as code points."""
    gaps = F.split(F.col(text), rule.pattern, -1)
    whole = F.regexp_extract_all(F.col(text), _lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(F.col(text), _lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    pieces = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("whole"), F.transform(part, F.length).alias("part")
    )

    def ends(at: Column, piece: Column) -> tuple[Column, Column]:
        begin = at + F.coalesce(piece["gap"], F.lit(0))
        return begin, begin + F.coalesce(piece["whole"], F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        begin, end = ends(state["at"], piece)
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(piece["part"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def spans(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("found")), step, lambda s: s["found"])

    def length(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0).cast("long"), lambda at, piece: ends(at, piece)[1])

    def all_spans(chunked: Column) -> Column:
        starts = running(F.transform(chunked, length))
        return F.flatten(F.zip_with(chunked, starts, spans))

    found = let(pieces, lambda p: let(chunks(p), all_spans))
    return F.when(F.col(text).rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(array: Column) -> Column:
    """An array, named once by let, in pieces of CHUNK elements."""
    n = F.ceil(F.size(array) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(array, i * CHUNK + 1, CHUNK))


def running(numbers: Column) -> Column:
    """The sum before each number of an array."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums"))
    return F.aggregate(numbers, none, step, lambda s: s["sums"])


def scan(blobs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs with a column spans: what all rules find in each row's text, by start, then by the order of the rules; none in
    an empty text, null in a null one. Rows and other columns stay; a column spans of the input's own is replaced."""
    found = [matches(text, rule, i) for i, rule in enumerate(rules)]
    return blobs.withColumn("spans", F.array_sort(F.concat(*found)))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


COVER = "struct<start:bigint,end:bigint>"


def covers(spans: Column) -> Column:
    """Stretches of a text that ordered spans cover. A span that begins before an earlier one ends is in its stretch."""
    none = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), F.array().cast(f"array<{COVER}>").alias("out"))

    def own(state: Column) -> Column:
        return F.when(state["start"] >= 0, F.concat(state["out"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))).otherwise(state["out"])

    def step(state: Column, span: Column) -> Column:
        return F.when(span["start"] >= state["end"], F.struct(span["start"].alias("start"), span["end"].alias("end"), own(state).alias("out"))).otherwise(
            F.struct(state["start"].alias("start"), F.greatest(state["end"], span["end"]).alias("end"), state["out"].alias("out"))
        )

    return F.aggregate(spans, none, step, own)


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with what its ordered spans cover replaced by the mask; null if the text is, as it is without spans. Texts with many spans are cut into pieces first,
    so that no span is looked for from the beginning of the text."""

    def piece(chunk: Column, until: Column) -> Column:
        """The text from a chunk's first stretch on, masked."""
        first = F.get(chunk, F.lit(0))["start"]
        state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def of(part: Column) -> Column:
            def step(s: Column, cover: Column) -> Column:
                gap = F.substring(part, (s["at"] + 1).cast("int"), (cover["start"] - first - s["at"]).cast("int"))
                return F.struct((cover["end"] - first).alias("at"), F.concat(s["out"], gap, F.lit(mask)).alias("out"))

            return F.aggregate(chunk, state, step, lambda s: F.concat(s["out"], F.substring(part, (s["at"] + 1).cast("int"), F.length(part))))

        return let(F.substring(text, (first + 1).cast("int"), (until - first).cast("int")), of)

    def pieces(chunked: Column) -> Column:
        starts = F.transform(chunked, lambda c: F.get(c, F.lit(0))["start"])
        ends = F.concat(F.slice(starts, 2, F.size(chunked)), F.array(F.length(text).cast("long")))
        before = F.substring(text, 1, F.get(F.get(chunked, F.lit(0)), F.lit(0))["start"].cast("int"))
        return F.concat(before, F.array_join(F.zip_with(chunked, ends, piece), ""))

    return F.when(F.size(spans) == 0, text).otherwise(let(covers(spans), lambda c: let(chunks(c), pieces)))


def pattern_of_any(rules: tuple[Rule, ...]) -> str:
    """A pattern that occurs in a text if that of some rule does."""
    return "|".join(f"(?i:{r.pattern[4:]})" if r.pattern.startswith("(?i)") else f"(?:{r.pattern})" for r in rules)


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob and text of each row; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def find_secrets(
    docs: DataFrame,
    ledger: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """For each row of docs: doc_id, blob and its spans (start, kind_order, kind, end in code points).

    `ledger` is the path of the ledger table, read if it exists and appended to; without one, a new ledger serves this
    call. Null texts count as empty. Copies share one scan; repeated rows each get a row, rows without an id too; an
    empty table gives none; columns other than the two named are ignored. Ties of start go by the order of the rules.

    Cost: one scan for addresses, and an aggregation to those unseen. One scan of the unseen texts for a possible finding;
    only texts with one cross a shuffle, which keeps one of each blob. If few blobs are unseen they are broadcast
    and no seen text is looked at; otherwise the unseen ones are told by a join after that test. Findings return by a join
    on the blob. That one, like the others, leaves hot blobs to Spark's skew handling.
    """
    spark = docs.sparkSession
    versions = addressed(docs, id_col, text_col)
    possible = F.col("text").rlike(pattern_of_any(rules))
    known = read_ledger(spark, ledger) if ledger else None
    path = ledger or new_path(spark, "ledger")
    with Scratch(spark) as scratch:
        paths = scratch.written(versions.select("doc_id", "blob"), "paths")
        blobs = paths.select("blob").distinct()
        todo = versions.where(possible)
        if known is not None:
            blobs = scratch.written(blobs.join(known.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti"), "unseen")
            n = blobs.count()
            todo = (versions.join(F.broadcast(blobs), "blob", "left_semi") if n <= FEW else todo.join(blobs, "blob", "left_semi")).where(possible)
        once = todo.select("blob", "text").dropDuplicates(["blob"])
        hits = scratch.written(scan(once, "text", rules).where(F.size("spans") > 0).select("blob", "spans"), "hits")
        empty = F.array().cast(f"array<{SPAN}>")
        rows = blobs.join(hits, "blob", "left").select("blob", F.coalesce("spans", empty).alias("spans"), F.lit(rule_version).alias("rule_version"))
        rows.write.mode("append").partitionBy("rule_version").parquet(path)
        seen = read_ledger(spark, path).where(F.col("rule_version") == rule_version)
        # A blob that two calls scanned at a time stands in the ledger twice, with equal spans.
        found = seen.where(F.size("spans") > 0).dropDuplicates(["blob"]).select("blob", "spans")
        return written(paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans")), "findings")


def read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger at this path, or None where there is none yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if exists else None


def redact(docs: DataFrame, ledger: str | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with every finding in `text` masked; n_chars, where there is such a column, follows the new text.

    Findings come from find_secrets and return by the text's address. Only rows in which some rule's pattern
    occurs can have any, so no others cross the network. Null texts stay null, and repeated rows and those without an id
    are masked each; all columns stay, whatever their names; an empty table stays empty.
    """
    blob, spans, new = (unused(n, docs.columns) for n in ("_blob", "_spans", "_masked"))
    text = F.coalesce(F.col("text"), F.lit(""))
    # find_secrets needs an id only to give its rows one.
    found = find_secrets(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), ledger)
    hits = found.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob])
    hits = written(hits, "hits")
    possible = text.rlike(pattern_of_any(RULES))
    joined = docs.where(possible).join(hits, F.unhex(F.sha2(text, 256)) == F.col(blob), "left")
    # Two steps: beside an alias `text`, lambda bodies would see the new column instead of the old one.
    joined = joined.withColumn(new, F.when(F.col(spans).isNotNull(), masked(F.col("text"), F.col(spans), mask)).otherwise(F.col("text")))
    own = {"text": F.col(new), "n_chars": F.length(new)}
    return docs.where(~possible).unionByName(joined.select(*(own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns)))
