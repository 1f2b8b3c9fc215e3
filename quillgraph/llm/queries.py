"""The thin queries of the ten operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import chat, decontaminate, line_dedup, media, mixing, quality, sharding, simhash, storage, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN first_id IS NULL OR first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> d.page_id THEN first_id END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 100
"""


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "color_type"
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.tokenize(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return token_files.read_token_files(manifest)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = storage.materialize(chat.format_conversations(rows), "chat")
    back = chat.parse_conversations(written)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *,
    regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '#(\\*)## ', '#\\\1## ', 'g') AS full_text,
    regexp_matches(text, '<\\+/turn>') OR regexp_matches(text, '#\\+## ') OR contains(text, '</turn>' || chr(10))
      OR ends_with(text, '</turn>' || chr(10)) AS odd,
    regexp_replace(regexp_replace(regexp_replace(role, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '#(\\*)## ', '#\\\1## ', 'g'),
      ':(\\*) ', ':\\\1 ', 'g') AS full_role,
    regexp_matches(role, '<\\+/turn>') OR regexp_matches(role, '#\\+## ') OR regexp_matches(role, ':\\* ')
      OR contains(role, '</turn>' || chr(10)) OR ends_with(role, ':') AS odd_role
  FROM c),
r AS (SELECT *, CASE WHEN odd OR odd_role THEN length(full_text) + length(full_role) ELSE length(text) + length(role) END + 14 AS n FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _op1_sql(fills: int) -> str:
    """The mix in SQL; each fill is the next document by rank that fits, the last one that brings the sum nearest."""
    out = r"""
WITH d0 AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
d AS (SELECT *, CASE WHEN length(bin(size)) <= 16 THEN length(bin(size)) ELSE pow(2.0, round(log2(length(bin(size))) * 8) / 8) END::DOUBLE AS x FROM d0),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM p WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap::DOUBLE ELSE w * (
    (sum(source_size) OVER () - coalesce(sum(cap) FILTER (cap <= w * level) OVER (), 0))::DOUBLE
    / nullif((sum(w) OVER () - coalesce(sum(w) FILTER (cap <= w * level) OVER (), 0))::DOUBLE, 0)) END AS target FROM l),
v AS (SELECT source, x, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
t AS (SELECT v.source, x, (target - 3 * coalesce(sum(words) OVER a, 0)) / nullif(sum(words * x) OVER b, 0) AS rate
  FROM v JOIN f ON v.source IS NOT DISTINCT FROM f.source
  WINDOW a AS (PARTITION BY v.source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    b AS (PARTITION BY v.source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT source AS sc, arg_max(rate, x) FILTER (x * rate < 3) AS c FROM t GROUP BY source),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN coalesce(least(3.0, c * x), 3.0) ELSE 0 END AS rate
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN c ON d.source IS NOT DISTINCT FROM sc),
q AS (SELECT *, floor(rate)::BIGINT AS sure,
    CASE WHEN rate - floor(rate) > 0 AND size > 0
      THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS rnk FROM r),
w AS (SELECT *, target - sum(size * sure) OVER (PARTITION BY source) AS room,
    CASE WHEN rnk IS NOT NULL THEN sum(CASE WHEN rnk IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rnk NULLS LAST, doc_id) END AS upto
  FROM q),
g AS (SELECT *, coalesce(upto <= room, false) AS pre FROM w),
g0 AS (SELECT source, any_value(room) - coalesce(max(CASE WHEN pre THEN upto END), 0) AS gap, NULL::DOUBLE AS r, NULL::BIGINT AS i, []::BIGINT[] AS ids FROM g GROUP BY source)"""
    for k in range(1, fills + 1):
        fits, off = ("size <= gap", "0") if k < fills else ("abs(size - gap) < gap", "abs(size - gap)")
        out += f""",
b{k} AS (SELECT g.source AS s, arg_min({{'r': rnk, 'i': doc_id, 'z': size}}, {{'o': {off}, 'r': rnk, 'i': doc_id}}) AS best
  FROM g JOIN g{k - 1} ON g.source IS NOT DISTINCT FROM g{k - 1}.source
  WHERE rnk IS NOT NULL AND NOT pre AND (r IS NULL OR rnk > r OR rnk = r AND doc_id > i) AND {fits} GROUP BY g.source),
g{k} AS (SELECT source, gap - coalesce(best.z, 0) AS gap, coalesce(best.r, r) AS r, coalesce(best.i, i) AS i,
    CASE WHEN best IS NULL THEN ids ELSE list_append(ids, best.i) END AS ids
  FROM g{k - 1} LEFT JOIN b{k} ON source IS NOT DISTINCT FROM s)"""
    return out + f"""
SELECT doc_id, size, source_size, target, (sure + CASE WHEN rnk IS NOT NULL AND (pre OR list_contains(ids, doc_id)) THEN 1 ELSE 0 END) * size AS taken
FROM g JOIN g{fills} ON g.source IS NOT DISTINCT FROM g{fills}.source
"""


OP1_SQL = _op1_sql(mixing.FILLS)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_table(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_media": op4_media,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat": op10_chat,
}
ORACLES = {"op1_mixing": OP1_SQL, "op3_warc": OP3_SQL, "op10_chat": OP10_SQL}
