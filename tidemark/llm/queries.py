"""The queries over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, embeddings, ngram_join, packing, quality, secrets, sharding, toxicity, warc
from tidemark.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all others: class and number of links."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM documents JOIN least ON least.a = doc_id LEFT JOIN degree ON degree.a = doc_id
"""


def byte_bpe() -> str:
    """The path of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048, end_id=1, with_ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back: every payload is decoded, and its digest stands only if it is right."""
    path = new_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path, least_bytes=0)
    back = warc.read(spark, path, ["warc_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "digest_ok"])
    return back.select(
        warc.page_id_of("record_id").alias("page_id"),
        "payload_bytes",
        F.when(F.coalesce("digest_ok", F.col("warc_type") == "revisit"), F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.page_id_of("refers_to").alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, ns WHERE len(w) >= n)),
hit AS (SELECT dg.doc_id, dg.i, dg.n, bg.item FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by trees that saw no held-out label."""
    docs, out = table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"), 3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels"), out)
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by trees that saw no held-out label."""
    docs, out = table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a ledger that an earlier delivery, every other document, has filled: only the rest is scanned."""
    docs, ledger = table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    secrets.find_secrets(docs.where(F.pmod("doc_id", F.lit(2)) == 0), ledger)
    found = secrets.find_secrets(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans")
    )


def _op8_kind(kind: str, order: int, pattern: str, group: int, least: int, flag: str = "") -> str:
    options = f", '{flag}'" if flag else ""
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, s, s + len(m) AS e FROM (
  SELECT doc_id, m, p, CAST(len(array_to_string(gaps[1:i], '')) + len(array_to_string(ms[1:i-1], '')) AS BIGINT) AS s FROM (
    SELECT doc_id, ms, gaps, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(ps) AS p FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}', 0{options}) AS ms, regexp_extract_all(text, '{pattern}', {group}{options}) AS ps,
        regexp_split_to_array(text, '{pattern}'{options}) AS gaps FROM d) WHERE len(ms) > 0)) WHERE len(p) >= {least}"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_op8_kind("assign", 0, secrets.ASSIGN.removeprefix("(?i)"), 2, 8, "i")}
  UNION ALL {_op8_kind("access", 1, secrets.ACCESS, 0, 16)}
  UNION ALL {_op8_kind("hex", 2, secrets.HEX, 0, 32)}),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns found in all conversations' raw transcripts, which tell neither roles nor turn boundaries but by the names
    of most speakers, by a model that saw no held-out conversation."""
    turns, out = table(spark, sf_dir, "conversations"), quality.held_out(F.col("conv_id"), 2, 1)
    model = chat.train(turns.where(~F.coalesce(out, F.lit(False))))
    found = chat.parse(chat.raw_transcripts(turns), model, part_col="part")
    return found.select("conv_id", out.alias("held_out"), "turn", "role", "rendered")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against all others."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP10_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sharding": op1_sharding, "op2_ngram_join": op2_ngram_join, "op3_packing": op3_packing, "op4_warc": op4_warc, "op5_decontamination": op5_decontamination, "op6_quality": op6_quality, "op7_toxicity": op7_toxicity, "op8_secrets": op8_secrets, "op9_chat": op9_chat, "op10_embeddings": op10_embeddings}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op4_warc": OP4_SQL, "op5_decontamination": OP5_SQL, "op8_secrets": OP8_SQL, "op10_embeddings": OP10_SQL}
