"""Operator 5: repeated passages from sparse suffixes, grouped by hash.

Only suffixes at content-selected positions are retained: where, of the
ANCHOR-word runs in MIN_WORDS words, one has the least hash (a minimiser).
Which position that is depends on these words alone, so equal passages retain
the same suffixes, about one in twenty words.

Retained suffixes are brought together by hashes of their words rather than by
sorting them and comparing neighbours.  Of the suffixes that share the words to
their right, the neighbour in the order of those words isn't the one that goes
on furthest to the left: a passage that begins before its minimiser would be
lost whenever another text with longer common words on the right stands between.

1. A row a retained suffix: the hash of its first ANCHOR words (its place), and
   the hash of its region, the words of all MIN_WORDS-word windows whose
   minimiser it is.  Places that only one document has are in no repeat and fall
   away in a count.
2. Suffixes of one place and region, in two documents, are repeats as a whole,
   however many there are.
3. A region without an equal is compared with the others of its place, one of
   each kind: its windows are all extensions of the anchor by i words to the
   left and the rest of MIN_WORDS to the right, and those which another
   document has are repeats.
4. Overlapping windows of a document are merged into maximal passages.

So each run of MIN_WORDS or more words that occurs in two documents is found,
whole, whatever stands around it, and nothing else is.

Defined cases: texts with fewer words, null and empty texts have no passages; a
text of any length is read whole, a slice at a time; of equal minimisers the
first counts; a passage that only repeats within one document isn't reported; rows that
share a doc_id are one document, so repeated rows are no repeat; rows without
an id are told apart by their text; words are runs of characters that aren't
white space, compared with A-Z lower-cased; an empty table gives an empty
result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm import text_kernels as tk
from pathloom.llm.spark_tools import materialize

#: Words of the shortest passage that is reported.
MIN_WORDS = 50
#: Words of an anchor.
ANCHOR = 12

U64 = np.uint64
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def minimisers(anchors: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each run of windows with one
    minimiser; window s holds anchors s ... s + span - 1; of equals the first."""
    n = len(anchors) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(anchors, span).argmin(axis=1)
    edges = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], edges])
    last = np.concatenate([edges, [n]]) - 1
    return at[first], first, last


class Ranges:
    """Hashes of runs of words, the same wherever they stand."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        up, self.down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = self.down[0] = 1
        self.sums = np.zeros(n, U64)
        np.cumsum(words * np.multiply.accumulate(up)[:-1], out=self.sums[1:])
        self.down = np.multiply.accumulate(self.down)

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tk.mix((self.sums[end] - self.sums[first]) * self.down[first])


def _stack(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate([p[k] for p in parts]) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=names)


def _suffixes(texts: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """A row a retained suffix of texts(doc, named, text)."""
    names = ["place", "region", "doc", "named", "at", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, named = (batch.column(i).to_numpy() for i in range(2))
            for w in tk.words(batch.column(2), lower=True):
                parts = []
                for i in range(len(w)):
                    hashes = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    anchors = tk.shingles(hashes, anchor)
                    at, first, last = minimisers(anchors, min_words - anchor + 1)
                    if len(at):
                        region = Ranges(hashes)(first, last + min_words)
                        region = tk.mix(region + (at - first).astype(U64))
                        doc = [np.full(len(at), x[w.first_row + i]) for x in (docs, named)]
                        parts.append([anchors[at].view(np.int64), region.view(np.int64), *doc, at, first, last])
                if parts:
                    yield _stack(parts, names)

    return texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _windows(asked: DataFrame, min_words: int) -> DataFrame:
    """The windows of asked(text, want): a row (window, place, region, start,
    lo, hi) for each start first ... last that a struct of want names."""
    names = ["window", "place", "region", "start", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants = batch.column(1)
            for w in tk.words(batch.column(0), lower=True):
                parts = []
                for i in range(len(w)):
                    hashes = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    ranges = Ranges(hashes)
                    for want in wants[w.first_row + i].as_py():
                        starts = np.arange(want["first"], min(want["last"], len(hashes) - min_words) + 1)
                        fixed = [np.full(len(starts), want[c]) for c in ("place", "region")]
                        ids = [np.full(len(starts), want[c]) for c in ("lo", "hi")]
                        window = ranges(starts, starts + min_words).view(np.int64)
                        parts.append([window, *fixed, starts - want["at"], *ids])
                if parts:
                    yield _stack(parts, names)

    return asked.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _islands(starts: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of neighbouring ``start`` for each key: low, high."""
    order = W.partitionBy(*keys).orderBy("start")
    return (
        starts.withColumn("run", F.col("start") - F.row_number().over(order))
        .groupBy(*keys, "run")
        .agg(F.min("start").alias("low"), F.max("start").alias("high"))
        .drop("run")
    )


def doc_key(key: str, text: str) -> Column:
    """The id; for rows without one a number that their text gives."""
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(text))


def passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, anchor: int = ANCHOR
) -> DataFrame:
    """doc_id, first_word, end_word (the one after the last): maximal passages
    that another document has too."""
    texts = docs.select(doc_key(key, text).alias("doc"), F.col(key).isNotNull().cast("long").alias("named"), F.col(text).alias("text"))
    every = materialize(_suffixes(texts, min_words, anchor), "repeat-suffixes")
    # Written tables on both sides of a join let Spark split a place that many documents have.
    shared = every.groupBy("place").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("place")
    shared = materialize(shared, "repeat-shared")
    kept = materialize(every.join(shared.hint("shuffle_hash"), "place"), "repeat-places")

    # One row a kind of region: the documents it is in, and where it stands in one of them.
    one = F.min(F.struct("doc", "at", "first", "last")).alias("one")
    kinds = kept.groupBy("place", "region").agg(one, F.max("doc").alias("hi"))
    kinds = materialize(kinds.withColumn("whole", F.col("one.doc") != F.col("hi")), "repeat-regions")
    whole = kinds.where("whole").select(
        "place", "region", (F.col("one.first") - F.col("one.at")).alias("low"), (F.col("one.last") - F.col("one.at")).alias("high")
    )

    # Places with a region that has no equal: the windows of all their kinds.
    odd = kinds.where("not whole").select("place").distinct()
    asked = kinds.join(odd, "place").select(
        F.col("one.doc").alias("doc"),
        F.struct("place", "region", "one.at", "one.first", "one.last", F.col("one.doc").alias("lo"), "hi").alias("want"),
    )
    asked = asked.groupBy("doc").agg(F.collect_list("want").alias("want"))  # at most a document's suffixes
    windows = materialize(_windows(texts.join(asked, "doc").select("text", "want"), min_words), "repeat-windows")
    twice = windows.groupBy("window").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("window")
    single = kinds.where("not whole").select("place", "region")
    some = windows.join(twice, "window").join(single, ["place", "region"], "left_semi")
    parts = _islands(some.select("place", "region", "start").distinct(), ["place", "region"])

    # Back to every suffix of these kinds, then merge what overlaps in a document.
    marks = materialize(whole.unionByName(parts), "repeat-marks")
    found = kept.join(marks, ["place", "region"]).select(
        "doc", "named", (F.col("at") + F.col("low")).alias("a"), (F.col("at") + F.col("high") + min_words).alias("b")
    )
    order = W.partitionBy("doc", "named").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = found.distinct().withColumn("opens", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
    numbered = opened.withColumn("passage", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc", "named", "passage").agg(F.min("a").alias("first_word"), F.max("b").alias("end_word"))
    return merged.select(F.when(F.col("named") == 1, F.col("doc")).alias("doc_id"), "first_word", "end_word")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that another document has too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = passages(docs)
    return found.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"))


OP5_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE text IS NOT NULL),
g AS (
    SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h
    FROM w, unnest(range(0, len(w) - 49)) AS t(i)),
r AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT DISTINCT doc_id, i FROM g JOIN r USING (h)),
o AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS opens FROM s),
p AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS passage FROM o)
SELECT doc_id, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) + 50 AS BIGINT) AS end_word,
       CAST(max(i) + 50 - min(i) AS BIGINT) AS n_words
FROM p GROUP BY doc_id, passage
"""
