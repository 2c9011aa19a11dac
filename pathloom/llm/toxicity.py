"""Operator 8: toxicity from class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary texts:
interpolated Kneser-Ney with absolute discounts and contexts of up to ORDER - 1
bytes within a word, so that a rare expression is known by its parts.  Up to
order SHARED the discounts' mass goes to one shared model of that order, whose
counts come from every document of the corpus, and above it to the class's own
order below; a piece that neither class has seen costs both the same.  A word's evidence is the difference of its two
log-likelihoods.  A text's is that of the WORST words that speak most for toxic
(all words of a shorter text), divided by their number: insults in a long text
are few.  A logistic curve over this one number, fitted on labelled rows that
the models haven't counted and with classes of equal weight, gives the score.

The corpus' counts are a table that grows with the corpus and stays with Spark.
The models read of it what they can reach: what follows contexts that a labelled
text has.

Rows are dealt by crc32(doc_id as text) mod 3: 0 gives the models' counts, 2
the curve, 1 is never learned from.  At most CLASS_ROWS labelled rows a class
are counted and CURVE_ROWS fit the curve, those with the smallest md5 of
doc_id, with their whole texts.

Defined cases: texts without words, null texts: no evidence, the score of an
average text; texts of any length are read whole; null labels aren't learned
from; without rows of both classes among the counted ones every score is the
share of toxic labels of the rows that may be learned from (0 without any);
ties among the smallest md5 go by id and label; repeated rows are scored each; a
null doc_id is scored and held out (its remainder is unknown);
an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import text_kernels as tk
from pathloom.llm.spark_tools import materialize

#: Labelled rows that each model counts, at most.
CLASS_ROWS = 4096
#: Labelled rows that fit the curve, at most.
CURVE_ROWS = 8192
#: Bytes of the longest grams, and of those whose counts both models share.
ORDER, SHARED = 8, 4
#: Words that stand for a text.
WORST = 3
#: Stands for the space around a word; no letter has this byte.
EDGE = 1
#: Distinct grams that a task holds before it hands them on.
HELD_GRAMS = 1 << 20
#: Words whose evidence a Python worker remembers.
REMEMBERED = 500_000
#: Predicted toxic from this score on.
THRESHOLD = 0.7

U64 = np.uint64
_MASKS = [U64((1 << 8 * k) - 1) for k in range(8)] + [U64((1 << 64) - 1)]


def remainder(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def letter_grams(w: tk.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, its length, word) of each letter of the chosen words and the edge
    after it.  A gram is the letter with up to ORDER - 1 bytes before it, not
    beyond the edge before the word, as a number whose last byte is the letter."""
    sizes = w.ends[chosen] - w.starts[chosen] + 1
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(chosen)), sizes)
    inner = np.arange(len(owner)) - np.repeat(ends - sizes, sizes)
    letters = tk.LOWER[w.data[np.minimum(w.starts[chosen][owner] + inner, max(len(w.data) - 1, 0))]].astype(U64)
    letters[ends - 1] = EDGE
    padded = np.concatenate([np.full(ORDER, EDGE, U64), letters])
    grams = np.zeros(len(letters), U64)
    for back in range(ORDER):
        byte = padded[ORDER - back : len(padded) - back]
        inside = np.where(inner >= back, byte, np.where(inner + 1 == back, U64(EDGE), U64(0)))
        grams |= inside << U64(8 * back)
    return grams, np.minimum(inner + 2, ORDER), owner


def _distinct_words(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word with each hash, which of them each word is, how often)."""
    _, first, which, n = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
    return first, which, n


def shared_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: how often the corpus has each gram of SHARED bytes (fewer where a
    word begins).  Tasks sum up their own first."""

    def batch_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        kept, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return kept, np.bincount(at, np.concatenate([p[1] for p in parts]), len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for w in tk.words(batch.column(0), lower=True, between=tk.MARKS):
                first, _, n = _distinct_words(w)
                grams, _, owner = letter_grams(w, first)
                parts.append(batch_of([(grams & _MASKS[SHARED], n[owner].astype(np.float64))]))
                held += len(parts[-1][0])
                if held > HELD_GRAMS:
                    parts = [batch_of(parts)]
                    held = len(parts[0][0])
                    if 2 * held > HELD_GRAMS:
                        yield _sums(*parts.pop())
                        held = 0
        if parts:
            yield _sums(*batch_of(parts))

    each = docs.select(text).mapInArrow(run, "gram bigint, n bigint")
    return materialize(each.groupBy("gram").agg(F.sum("n").alias("n")), "toxicity-grams")


def _sums(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _reached(grams: DataFrame, contexts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(grams, counts, discount) of the shared orders 2 ... SHARED: the longest
    and those of two bytes by how often they occur, between them by what stands
    before.  The grams are those that follow the contexts of that order (those
    of labelled texts), the discount is that of all."""
    spark, out = grams.sparkSession, []
    for k, asked in enumerate(contexts, 2):
        part = F.col("gram").bitwiseAND(F.lit(int(_MASKS[k])))
        preceded = F.lit(2 < k < SHARED) & (F.col("gram") > F.lit(int(_MASKS[k])))
        rows = grams.where(F.col("gram") > F.lit(int(_MASKS[k - 1]))).select(part.alias("gram"), F.when(preceded, 1).otherwise(F.col("n")).alias("n"))
        table = spark.createDataFrame(pa.table({"context": asked.view(np.int64)}))
        sums = rows.groupBy("gram").agg(F.sum("n").alias("n"))
        few = sums.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
        found = sums.withColumn("context", F.shiftright("gram", 8)).join(F.broadcast(table), "context", "left_semi")
        got = found.select("gram", "n").orderBy("gram").toArrow()
        out.append((got["gram"].to_numpy().view(U64), got["n"].to_numpy().astype(np.float64), _estimate(*few)))
    return out


def _counted(rows: DataFrame) -> pa.Table:
    """gram, c0, c1: how often each class of rows(text, label) has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for w in tk.words(batch.column(0), lower=True, between=tk.MARKS):
                toxic = np.repeat(label[w.first_row : w.first_row + len(w)], np.diff(w.bounds)).astype(np.int64)
                first, which, n = _distinct_words(w)
                weight = np.bincount(which, toxic, len(first)).astype(np.int64)
                grams, _, owner = letter_grams(w, first)
                kept, at = np.unique(grams, return_inverse=True)
                c1 = np.bincount(at, weight[owner], len(kept)).astype(np.int64)
                c0 = np.bincount(at, (n - weight)[owner], len(kept)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept.view(np.int64)), pa.array(c0), pa.array(c1)], names=["gram", "c0", "c1"]
                )

    grams = rows.mapInArrow(run, "gram bigint, c0 bigint, c1 bigint")
    return grams.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()


def _estimate(once: int, twice: int) -> float:
    """Ney's discount n1 / (n1 + 2 n2)."""
    return min(0.95, once / (once + 2 * twice)) if once else 0.5


def _discounts(counts: np.ndarray) -> list[float]:
    return [_estimate(int((c == 1).sum()), int((c == 2).sum())) for c in counts.T]


def _lookup(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return at, keys[at] == asked


def _mixed(order: tuple[np.ndarray, ...], gram: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of one order, given those that it is smoothed with."""
    keys, part, contexts, back = order
    if not len(keys):
        return below
    at, known = _lookup(contexts, gram >> U64(8))
    p = below * np.where(known[:, None], back[at], 1.0)
    at, known = _lookup(keys, gram)
    return p + np.where(known[:, None], part[at], 0.0)


def _lengths(grams: np.ndarray) -> np.ndarray:
    return sum((grams > _MASKS[k]).astype(np.int64) for k in range(8))


def _interpolated(keys: np.ndarray, c: np.ndarray, discounts: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, their discounted shares, contexts, their weights of the order
    below) of one order, from counts with a column a class."""
    contexts, at = np.unique(keys >> U64(8), return_inverse=True)
    part, back = np.zeros_like(c), np.ones((len(contexts), c.shape[1]))
    for j in range(c.shape[1]):
        d, total = discounts[j], np.bincount(at, c[:, j], len(contexts))
        part[:, j] = np.maximum(c[:, j] - d, 0) / np.maximum(total[at], 1)
        # What the discounts took, which is less than d where a count is below it.
        taken = np.bincount(at, np.minimum(c[:, j], d), len(contexts))
        back[:, j] = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
    return keys, part.astype(np.float32), contexts, back.astype(np.float32)


@dataclass
class Models:
    """``_interpolated`` for each shared order from 3 on (one column) and for
    each order of the classes from 2 on (a column a class); and the shared
    probabilities of two bytes."""

    shared: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    base: np.ndarray

    @staticmethod
    def class_orders(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        grams = table["gram"].to_numpy().view(U64)
        counts = np.stack([table["c0"].to_numpy(), table["c1"].to_numpy()], axis=1).astype(np.float64)
        lengths, orders = _lengths(grams), []
        above: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(ORDER, 1, -1):
            # Full grams by how often they occur, parts of longer ones by what stands before them.
            own = lengths == k
            parts = [(grams[own], counts[own])]
            if above is not None:
                parts.append((above[0] & _MASKS[k], (above[1] > 0).astype(np.float64)))
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            values = np.concatenate([p[1] for p in parts])
            c = np.stack([np.bincount(at, values[:, j], len(keys)) for j in range(2)], axis=1)
            above = (keys, c)
            orders.append(_interpolated(keys, c, _discounts(c)))
        return orders[::-1]

    @classmethod
    def build(cls, orders: list, shared: list[tuple[np.ndarray, np.ndarray, float]]) -> Models:
        """From class_orders and what ``_reached`` gives."""
        n = np.full(1 << 16, 0.01)
        n[shared[0][0].astype(np.int64)] += shared[0][1]
        n = n.reshape(-1, 256)
        lower = [_interpolated(grams, counts[:, None], [d]) for grams, counts, d in shared[1:]]
        return cls(lower, orders, (n / n.sum(axis=1, keepdims=True)).ravel())

    def evidence(self, w: tk.Words, chosen: np.ndarray) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) of the chosen words."""
        grams, lengths, owner = letter_grams(w, chosen)
        both = np.repeat(self.base[(grams & _MASKS[2]).astype(np.int64)][:, None], 2, axis=1)
        p = both.copy()
        for k in range(2, ORDER + 1):
            long = np.flatnonzero(lengths >= k)
            gram = grams[long] & _MASKS[k]
            if 2 < k <= SHARED:
                both[long] = _mixed(self.shared[k - 3], gram, both[long])
            p[long] = _mixed(self.orders[k - 2], gram, both[long] if k <= SHARED else p[long])
        p = np.log(p)
        return np.bincount(owner, p[:, 1] - p[:, 0], len(chosen))

    def feature(self, texts: pa.Array, memory: dict[int, float] | None = None) -> np.ndarray:
        """Evidence a word of each text's WORST words; 0 without words."""
        memory = {} if memory is None else memory
        out = np.zeros(len(texts))
        for w in tk.words(texts, lower=True, between=tk.MARKS):
            first, which, _ = _distinct_words(w)
            names = w.hashes[first].tolist()
            new = np.array([i for i, h in enumerate(names) if h not in memory], np.int64)
            if len(new):
                if len(memory) > REMEMBERED:
                    memory.clear()
                    new = np.arange(len(first))
                memory.update(zip((names[i] for i in new), self.evidence(w, first[new]).tolist(), strict=True))
            each = np.array([memory[h] for h in names])[which] if names else np.zeros(0)
            for i in range(len(w)):
                own = each[w.bounds[i] : w.bounds[i + 1]]
                if len(own):
                    n = min(WORST, len(own))
                    out[w.first_row + i] = np.partition(own, len(own) - n)[-n:].mean()
        return out


@dataclass
class Scorer:
    """The score is the curve's value for a text's feature; without models it is
    weights[0] for all."""

    models: Models | None
    middle: float
    scale: float
    weights: np.ndarray
    memory: dict[int, float] = field(default_factory=dict)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.models is None:
            return np.full(len(texts), self.weights[0])
        x = (self.models.feature(texts, self.memory) - self.middle) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x * self.weights[1], -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton's method; both classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(len(y))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _smallest(labels: DataFrame, rows: int) -> DataFrame:
    return labels.orderBy(F.md5(F.col("label_key").cast("string")), "label_key", "label").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Learn the models and the curve."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("label_key"), F.col(label).cast("int").alias("label")
    )
    counted, curve = (known.where(remainder("label_key") == r) for r in (0, 2))
    texts = docs.select(F.col(key).alias("label_key"), F.col(text).alias("text"))
    # Bounded tables: CLASS_ROWS a class, CURVE_ROWS.
    chosen = _smallest(counted.where("label = 0"), CLASS_ROWS).union(_smallest(counted.where("label = 1"), CLASS_ROWS))
    table = _counted(texts.join(F.broadcast(chosen), "label_key").select("text", "label"))
    classes = [int((table[c].to_numpy() > 0).sum()) for c in ("c0", "c1")]
    if not all(classes):
        share = counted.union(curve).agg(F.avg("label")).first()[0] or 0.0
        return Scorer(None, 0.0, 1.0, np.array([share]))
    orders = Models.class_orders(table)
    models = Models.build(orders, _reached(shared_grams(docs, text), [x[2] for x in orders[: SHARED - 1]]))
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.feature(batch.column(0))), batch.column(1)], names=["x", "y"])

    rows = texts.join(F.broadcast(_smallest(curve, CURVE_ROWS)), "label_key").select("text", "label")
    got = rows.mapInArrow(run, "x double, y int").orderBy("x", "y").toArrow()
    x, y = got["x"].to_numpy(), got["y"].to_numpy().astype(np.float64)
    if not len(x):
        return Scorer(models, 0.0, 1.0, np.array([0.0, 1.0]))
    middle, scale = float(x.mean()), max(float(x.std()), 1e-9)
    return Scorer(models, middle, scale, fit_curve(((x - middle) / scale)[:, None], y))


def score_documents(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # grams of at most 2 CLASS_ROWS texts
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.score(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, scorer).select(
        "doc_id",
        F.coalesce(remainder() == 1, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
