"""Operator 11: what each filter of a chain removes, in every order of the chain.

A document's failures are the bits of a mask.  Documents are counted by part
and mask (and, of those, the ones with a good or a toxic label), so a part is
three rows of 2 ** m counts.  These rows times an integer matrix with a column
for each order and step give all outcomes at once: no order is run over the
documents.  With five filters the matrices are 32 by 600.

The mask's text conditions are DataFrame functions.  The last filter, copies
of a smaller id's text, comes from grouping by SHA-256: a group of copies is
counted by label and part before it meets anything, so its size doesn't
matter, and the smallest id is a minimum over those few rows.

Defined cases: a null text is empty, and all empty texts are copies of each
other; a null part is the empty string; a document without an id isn't a copy
of a smaller one, makes none, and has no label; rows that repeat an id are
counted each, and equal texts under one id aren't copies of a smaller id; an
id with several label rows is good (toxic) if one of them says so, and null
labels say nothing; texts of any length are read whole; an empty table gives
no rows; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Filters of a chain at most: 6 are 720 orders, and matrices of 64 by 4,320.
MOST_FILTERS = 6
#: Parts whose outcomes a task holds at once.
PARTS_AT_ONCE = 16
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: What ends a word, and the signs of filter D.
SPACE = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"


@dataclass(frozen=True)
class Filter:
    """A letter, and whether a text fails: a condition over ``text``, ``words``
    (an array) and ``chars`` (code points)."""

    letter: str
    fails: Column


def text_filters() -> list[Filter]:
    """A: under 50 words; B: under 65% of the words distinct; C: over 5% of the
    characters capitals; D: a sign."""
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return [
        Filter("A", words < 50),
        Filter("B", 100 * distinct < 65 * words),
        Filter("C", 100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.col("chars")),
        Filter("D", F.col("text").rlike(SIGNS)),
    ]


def failures(docs: DataFrame, filters: list[Filter], key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part, digest, mask: one row a document; bit i is filter i."""
    body = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    split = body.select("*", F.array_remove(F.split("text", SPACE), "").alias("words"), F.char_length("text").alias("chars"))
    mask = F.lit(0)
    for i, f in enumerate(filters):
        mask = mask + F.when(f.fails, F.lit(1 << i)).otherwise(F.lit(0))
    return split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``masks`` with good and toxic (0 or 1).  Documents without an id don't
    go through the join, so they don't meet in one task."""
    flags = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    flag = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    known = masks.where("id is not null").join(flags, "id", "left").select(*masks.columns, *flag)
    return known.unionByName(masks.where("id is null").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def histogram(labelled: DataFrame, copies_bit: int) -> DataFrame:
    """part, mask, n, good, toxic: documents by mask, with the bit of copies.

    Equal ids with equal texts become one row with a count first; then a text's
    rows are added up by part and label, which leaves its smallest id and how
    many rows have it; all others with an id fail."""
    group = ["digest", "part", "mask", "good", "toxic"]
    ids = labelled.groupBy("id", *group).agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    texts = ids.groupBy(*group).agg(F.sum("n").alias("n"), nameless.alias("nameless"), least.alias("least"))
    first = F.col("least.id") == F.min("least.id").over(W.partitionBy("digest"))
    passing = F.col("nameless") + F.when(first, F.col("least.n")).otherwise(0)
    both = texts.select("part", "mask", "good", "toxic", "n", passing.alias("passing")).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct((F.col("mask") + F.lit(copies_bit)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )),
    )
    counted = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return both.groupBy("part", "mask").agg(*counted)


@dataclass(frozen=True)
class Matrices:
    """Integer matrices of 2 ** m rows (masks) and m * m! columns (orders and
    steps): entry 1 if a document with the mask has the outcome there; for
    ``shapley`` the number of orders in which the step's filter removes it."""

    orders: list[str]
    steps: list[int]
    kept: np.ndarray
    removed: np.ndarray
    redundant: np.ndarray
    unique: np.ndarray
    shapley: np.ndarray


def matrices(letters: str) -> Matrices:
    m = len(letters)
    if not 0 < m <= MOST_FILTERS or len(set(letters)) < m:
        raise ValueError(f"a chain has 1 to {MOST_FILTERS} filters with letters of their own")
    masks = np.arange(1 << m)[:, None]
    columns = [(order, step) for order in permutations(range(m)) for step in range(m)]
    bit = np.array([1 << order[step] for order, step in columns])
    before = np.array([sum(1 << f for f in order[:step]) for order, step in columns])
    fails, gone = (masks & bit) != 0, (masks & before) != 0
    removed = (fails & ~gone).astype(np.int64)
    total = np.stack([removed[:, bit == 1 << f].sum(axis=1) for f in range(m)])
    return Matrices(
        ["".join(letters[f] for f in order) for order, _ in columns],
        [step + 1 for _, step in columns],
        ((masks & (before | bit)) == 0).astype(np.int64),
        removed,
        (fails & gone).astype(np.int64),
        (masks == bit).astype(np.int64),
        total[np.array([order[step] for order, step in columns])].T,
    )


def outcomes(counts: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and OUTCOMES: histograms times matrices."""
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))
    parts = counts.groupBy("part").agg(cells.alias("cells"))  # at most 2 ** m cells
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in OUTCOMES)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matrices(letters)
        width = len(m.orders)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE).to_pylist()
                rows = np.zeros((3, len(some), 1 << len(letters)), np.int64)
                for i, r in enumerate(some):
                    for cell in r["cells"]:
                        rows[:, i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                n, good, toxic = rows
                found = [n @ m.kept, n @ m.removed, n @ m.redundant, n @ m.unique, good @ m.removed, toxic @ m.removed, n @ m.shapley]
                names = pa.array([r["part"] for r in some for _ in range(width)], pa.string())
                columns = [names, pa.array(m.orders * len(some)), pa.array(m.steps * len(some), pa.int32())]
                columns += [pa.array(x.ravel(), pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *OUTCOMES])

    return parts.mapInArrow(multiply, schema)


def audit(
    docs: DataFrame, labels: DataFrame, filters: list[Filter], copies: str = "E", key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """All outcomes of ``filters`` and, last, of the filter ``copies``, by part."""
    labelled = with_labels(failures(docs, filters, key, text, part), labels, key)
    return outcomes(histogram(labelled, 1 << len(filters)), "".join(f.letter for f in filters) + copies)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and step of the five filters over all documents, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), text_filters())


def _oracle() -> str:
    """SQL for the query: every order and step over documents grouped by what
    they fail."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    p = " CROSS JOIN ".join(f"{letters} p{i}(l{i})" for i in range(5))
    apart = " AND ".join(f"l{i} <> l{j}" for i in range(5) for j in range(i))
    fails = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS bad
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
h AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL)"""
    return fails + f""",
o AS (SELECT l0 || l1 || l2 || l3 || l4 AS filter_order FROM {p} WHERE {apart}),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) AS t(step)),
x AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(bad, letter) AS fails, bad = letter AS alone,
    len(list_intersect(string_split(bad, ''), string_split(earlier, ''))) > 0 AND bad <> '' AND earlier <> '' AS gone FROM h, s),
g AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""


OP11_SQL = _oracle()
