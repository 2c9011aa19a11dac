"""Operator 10: weighted rendezvous sharding (DataFrame functions only).

Each record key draws one number per shard, ``-weight / ln(u)`` with u from an
md5 of (key, shard); the largest wins.  The draw of one shard doesn't depend
on the others, so one more shard takes rows only into itself, and a shard gets
rows in proportion to its weight.

Defined cases: a null key is replaced by the md5 of the text, so that rows
without a key spread out; null text counts as empty; repeated rows share a
shard and take slots of their own, equal keys by size and checksum; a text of
any length is only measured and summed; an empty table gives an empty result; extra
columns pass through ``shard_documents``, where columns named like a result are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.spark_tools import gapless_rank, hash_digits

#: Hex digits of a draw: 52 bits, exact in a double.
DIGITS = 13


def record_key(key: str = "doc_id", text: str = "text") -> Column:
    """The stable key as text; ``t`` and the text's md5 where the key is null."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int, from 0) with the largest draw for ``key``."""
    if not weights or min(weights) <= 0:
        raise ValueError("rendezvous needs one positive weight per shard")
    shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def draw(x: Column) -> Column:
        h = hash_digits(F.concat_ws(":", key, x["s"].cast("string")), DIGITS)
        u = (h.cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))
        return F.struct((-x["w"] / F.ln(u)).alias("d"), (-x["s"]).alias("s"))

    return (-F.array_max(F.transform(shards, draw))["s"]).cast("int")


def shard_documents(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", slots: bool = True
) -> DataFrame:
    """``docs`` with ``shard`` and, if asked for, ``slot`` (0, 1, ... in each
    shard, by hash bucket, key, size and text checksum)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    out = docs.withColumn("shard", rendezvous(record_key(key, text), weights))
    if not slots:
        return out
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    order = [F.col(key).asc_nulls_first(), size, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    return gapless_rank(out, "shard", record_key(key, text), order, "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard."""
    sharded.write.partitionBy("shard").mode("overwrite").parquet(path)


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """Every document's shard of eight equal ones, its slot there, and its
    shard with one more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        record_key().alias("record_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    key = F.col("record_key")
    rows = rows.withColumn("shard", rendezvous(key, [1.0] * shards))
    ranked = gapless_rank(rows, "shard", key, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], "slot")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        rendezvous(key, [1.0] * (shards + 1)).alias("grown_shard"),
    )


def _oracle(shards: int = 8) -> str:
    """SQL for the query; the checksum is folded over a text's bytes."""
    digit = "(('0x' || {})::BIGINT)"
    steps, last = "", "c0"
    for i in range(1, 9):
        steps += f", c{i} AS (SELECT i, xor(v >> 1, (v & 1) * 3988292384) AS v FROM {last})"
        last = f"c{i}"
    draws = f"""SELECT doc_row, arg_max(s, (h, -s)) AS s FROM (SELECT doc_row, s, {digit.format("substr(md5(k || ':' || s), 1, 13)")} AS h
        FROM d, range({{}}) AS t(s)) GROUP BY doc_row"""
    return f"""
WITH c0 AS (SELECT i, i AS v FROM range(256) AS t(i)){steps},
crc AS (SELECT list(v ORDER BY i) AS v FROM {last}),
d AS (SELECT doc_id, row_number() OVER () AS doc_row, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) AS k FROM documents),
raw AS (SELECT doc_row, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: {digit.format("x")}) AS b FROM d),
sums AS (SELECT doc_row, CAST(len(b) + 1 AS BIGINT) AS size,
    xor(list_reduce(b, lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM raw, crc),
now AS ({draws.format(shards)}), grown AS ({draws.format(shards + 1)})
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(now.s AS INT) AS shard,
    row_number() OVER (PARTITION BY now.s ORDER BY substr(md5(k), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown.s AS INT) AS grown_shard
FROM d JOIN sums USING (doc_row) JOIN now USING (doc_row) JOIN grown USING (doc_row)
"""


OP10_SQL = _oracle()
