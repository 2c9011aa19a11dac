"""Operator 6: mixing sources to target weights by Pfair scheduling
(DataFrame functions only).

Time runs in slots; a slot takes one block of documents.  With units q of a
total of Q, block j of a source may go out from slot floor(j Q / q) and has to
before slot ceil((j + 1) Q / q); the earliest deadline among the released
blocks goes first.  So after t slots a source has had t q / Q blocks, less or
more than one block apart, as long as no source has run out.  Units are whole
numbers and the pattern repeats after Q slots, so the schedule is a table of Q
entries whatever the corpus holds; each document finds its slot from its rank in
its source.  Against weights that aren't whole units a source drifts by as much
as rounding to units does, at most a block in Q slots.

Of more than MAX_SOURCES sources the largest have units of their own, and all
others share the units that add up to theirs: documents of those are ranked
together, in an order that doesn't depend on their source.

No document is dropped or repeated: where a source has run out, its slots stay
empty and the others go on.  Defined cases: a null source is a source of its
own; a source without units isn't allowed when units are given; texts of any
length only count as a document; equal ids are ordered by a hash of the text,
and repeated rows are ranked one after the other; an empty table gives an empty
result; extra columns pass through and columns named like a result are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.spark_tools import fresh, gapless_rank

#: Documents of a block; a whole number of slots of training order.
BLOCK = 16
#: Slots that temperature units are spread over: so many, or A_SOURCE for each source.
QUANTUM, A_SOURCE = 1000, 20
#: Sources with units of their own; the schedule and its broadcast are bounded by it.
MAX_SOURCES = 50_000
#: Name of the units that all other sources share (keys begin with "=").
OTHERS = "*"

RESULTS = ("source_rank", "block", "slot", "offset")


def source_key(source: str = "source") -> Column:
    """Keeps a null source apart from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def temperature_units(counts: dict[str, int], alpha: float = 0.5, others: float = 0.0) -> dict[str, int]:
    """Units in proportion to count ** alpha, at least one each; ``others`` is
    the weight of the sources that share units."""
    weight = {s: n**alpha for s, n in counts.items()} | ({OTHERS: others} if others else {})
    total = sum(weight[s] for s in sorted(weight))
    quantum = max(QUANTUM, A_SOURCE * len(weight))
    return {s: max(1, int(quantum * w / total)) for s, w in weight.items()}


def edf_slots(units: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks within one period."""
    total = sum(units.values())
    slots: dict[str, list[int]] = {s: [] for s in units}
    waiting = [(0, s) for s in units]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []  # by deadline, then name
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // units[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        if (j := len(slots[s])) < units[s]:
            heapq.heappush(waiting, (j * total // units[s], s))
    return slots


def mix_sources(
    docs: DataFrame,
    units: dict[str, int] | None = None,
    block: int = BLOCK,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    alpha: float = 0.5,
) -> DataFrame:
    """``docs`` with source_rank, block, slot and offset (long).  Training order
    is (slot, offset).  ``units`` maps sources (as ``source_key`` writes them)
    to whole units; without it they follow count ** alpha."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    name, plan_source, plan_slots, own = (fresh(x, docs) for x in ("source_key", "plan_source", "plan_slots", "plan_own"))
    rows = docs.withColumn(name, source_key(source))
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    found = {r[0]: r[1] for r in counts.orderBy(F.desc("n"), name).limit(MAX_SOURCES + 1).collect()}
    others = 0.0
    if len(found) > MAX_SOURCES and units is None:
        del found[min(found, key=lambda s: (found[s], [-ord(c) for c in s]))]
        large = spark.createDataFrame([(s,) for s in found], f"`{own}` string")
        rows = rows.join(F.broadcast(large), F.col(name) == F.col(own), "left").withColumn(name, F.coalesce(own, F.lit(OTHERS))).drop(own)
        weights = counts.join(F.broadcast(large), F.col(name) == F.col(own), "left_anti")
        others = weights.agg(F.sum(F.pow("n", F.lit(alpha)))).first()[0]
    units = units if units is not None else temperature_units(found, alpha, others)
    known = spark.createDataFrame([(s,) for s in units], f"`{own}` string")
    if lacking := [r[0] for r in counts.join(F.broadcast(known), F.col(name) == F.col(own), "left_anti").orderBy(name).limit(10).collect()] if not others else []:
        raise ValueError(f"no units for the sources {lacking}")
    plan = spark.createDataFrame(list(edf_slots(units).items()), f"`{plan_source}` string, `{plan_slots}` array<int>")
    order = [F.col(key).asc_nulls_first(), F.md5(F.coalesce(F.col(text), F.lit("")))]
    ranked = gapless_rank(rows, name, F.coalesce(F.col(key).cast("string"), F.col(text)), order, "source_rank")
    per = F.size(plan_slots).cast("long")
    placed = ranked.join(F.broadcast(plan), F.col(name) == F.col(plan_source)).withColumn(
        "block", F.floor(F.col("source_rank") / F.lit(block)).cast("long")
    )
    place = F.element_at(plan_slots, (F.col("block") % per + 1).cast("int")).cast("long")
    return (
        placed.withColumn("slot", F.floor(F.col("block") / per).cast("long") * sum(units.values()) + place)
        .withColumn("offset", F.col("source_rank") % F.lit(block))
        .drop(name, plan_source, plan_slots)
    )


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mixture of its sources at temperature 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.md5("text").alias("text"))
    return mix_sources(docs).select("doc_id", "source", *RESULTS)


OP6_SQL = """
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce('=' || source, '') AS k,
           row_number() OVER (PARTITION BY source ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 3),
                              doc_id NULLS FIRST, md5(coalesce(md5(text), ''))) - 1 AS source_rank
    FROM documents),
weights AS (SELECT k, sqrt(count(*)) AS w FROM docs GROUP BY k),
units AS (SELECT k, greatest(1, CAST(floor(greatest(1000, 20 * count(*) OVER ()) * w / sum(w) OVER ()) AS BIGINT)) AS q FROM weights),
shape AS (SELECT list(k ORDER BY k) AS ks, list(q ORDER BY k) AS qs, CAST(sum(q) AS BIGINT) AS total FROM units),
edf(t, js, pick) AS (
    SELECT CAST(-1 AS BIGINT), list_transform(qs, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM shape
    UNION ALL
    SELECT t, list_transform(range(1, len(js) + 1), lambda i: js[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
    FROM (SELECT t + 1 AS t, js, list_min(list_transform(
              list_filter(range(1, len(js) + 1), lambda i: js[i] < qs[i] AND (js[i] * total) // qs[i] <= t + 1),
              lambda i: -((-(js[i] + 1) * total) // qs[i]) * 1000000 + i)) % 1000000 AS p
          FROM edf, shape WHERE t + 1 < total)),
slots AS (
    SELECT ks[pick] AS k, qs[pick] AS q, total, js[pick] - 1 AS j, t FROM edf, shape WHERE pick IS NOT NULL)
SELECT d.doc_id, d.source, d.source_rank, d.source_rank // 16 AS block,
       (d.source_rank // 16) // s.q * s.total + s.t AS slot, d.source_rank % 16 AS "offset"
FROM docs d JOIN units u ON d.k = u.k JOIN slots s ON s.k = d.k AND s.j = (d.source_rank // 16) % u.q
"""
