"""Operator 4: quality rules as a learned decision list.

Statistics of whole texts (in Arrow batches) are joined with the labels, and
sequential covering learns an ordered list of rules for label 0: a rule is a
conjunction of thresholds, grown by FOIL gain on two thirds of the examples
and pruned on the rest; the examples that it covers are taken out and the next
rule is learned.  The list is emitted as one ordered Spark expression,
``CASE WHEN rule 1 THEN false ... ELSE true``.

The list is fitted on at most MAX_EXAMPLES labelled rows, those with the
smallest md5 of doc_id; a whole text is measured whatever its length.

Defined cases: null and empty texts have no words, so all statistics are 0 and
they fail the base rule; a label that is null is no example; repeated rows are
measured each; without examples the list is empty and the base rule alone
decides; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import text_kernels as tk

#: Labelled rows that the list is fitted on, at most.
MAX_EXAMPLES = 20_000
#: A rule must reject at least this share of label 0 among what it covers.
MIN_PRECISION = 0.9
#: ... and cover at least so many examples.
MIN_COVER = 5
MAX_RULES = 32
MAX_CONDITIONS = 4
#: Thresholds tried for a statistic, at quantiles of its values.
CUTS = 64

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_bars",
)
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
#: Bytes that aren't counted by word_chars: white space, and all but a letter's first.
_UNCOUNTED = _SPACES + _CONTINUED


def _without(keep: bytes) -> bytes:
    return bytes(b for b in range(256) if b not in keep)


_DROP = {
    "n_symbols": _without(SYMBOLS),
    "n_upper": _without(bytes(range(65, 91))),
    "n_digits": _without(bytes(range(48, 58))),
    "n_marks": _without(b"!?"),
    "n_bars": _without(b"|"),
}


def repeated_words(hashes: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that occur twice or more."""
    grams = tk.shingles(hashes, size)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def _lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The STATS of each text."""
    out = {s: np.zeros(len(texts), np.int64) for s in STATS}
    for w in tk.words(texts):
        raw = w.data.tobytes()
        out["n_words"][w.first_row : w.first_row + len(w)] = np.diff(w.bounds)
        for i in range(len(w)):
            row, text = w.first_row + i, raw[w.offsets[i] : w.offsets[i + 1]]
            out["word_chars"][row] = len(text.translate(None, _UNCOUNTED))
            for stat, drop in _DROP.items():
                out[stat][row] = len(text.translate(None, drop))
            out["n_lines"][row], out["n_dup_lines"][row] = _lines(text)
            out["n_repeat_words"][row] = repeated_words(w.hashes[w.bounds[i] : w.bounds[i + 1]])
    return out


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a struct ``stats_`` of the STATS (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = measure(batch.column(batch.schema.get_field_index(text)))
            struct = pa.StructArray.from_arrays([pa.array(stats[s], pa.int64()) for s in STATS], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, "stats_"])

    docs = docs.drop("stats_")
    kind = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("stats_", kind)]))


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    n = F.col("stats_.n_words")
    return (n < 10) | (F.col("stats_.n_repeat_words") * 100 > n * 20)


#: What the conditions look at: the length itself, and shares of it.
FEATURES = {
    "n_words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "bar_share": ("n_bars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "line_length": ("n_words", "n_lines"),
}


def feature_columns() -> dict[str, Column]:
    """The FEATURES over ``stats_``, as doubles."""
    part = lambda s: F.col(f"stats_.{s}").cast("double")
    return {f: part(a) / F.greatest(part(b), F.lit(1.0)) if b else part(a) for f, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def column(self, features: dict[str, Column]) -> Column:
        v = features[self.feature]
        return v > F.lit(self.cut) if self.above else v <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for c in rule:
        inside &= c.holds(x)
    return inside


def _cuts(v: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring distinct values, at quantiles."""
    values = np.unique(v)
    mids = (values[1:] + values[:-1]) / 2
    return mids if len(mids) <= CUTS else mids[np.unique(np.linspace(0, len(mids) - 1, CUTS).astype(int))]


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of the largest FOIL gain until only bad rows are left."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[inside]).any() and bad[inside].any():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, gain = None, 1e-9
        for k, feature in enumerate(FEATURES):
            v = x[inside, k]
            cuts = _cuts(v)
            if not len(cuts):
                continue
            b = bad[inside]
            low_p = np.searchsorted(np.sort(v[b]), cuts, "right")
            low_n = np.searchsorted(np.sort(v[~b]), cuts, "right")
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Condition(feature, above, float(cuts[i])), float(g[i])
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    """(p - n) / (p + n) on the pruning rows."""
    inside = covers(rule, x)
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """The ordered rules; every third row prunes."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and bad.sum() >= MIN_COVER:
        prunes = np.arange(len(x)) % 3 == 2
        rule = _grow(x[~prunes], bad[~prunes])
        while len(rule) > 1 and _worth(rule[:-1], x[prunes], bad[prunes]) >= _worth(rule, x[prunes], bad[prunes]):
            rule = rule[:-1]
        inside = covers(rule, x)
        if not rule or inside.sum() < MIN_COVER or bad[inside].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        x, bad = x[~inside], bad[~inside]
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Learn the list from labelled rows that pass the base rule."""
    pool = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("label_key"), F.col(label).cast("int").alias("label_value")
    )
    # A bounded table: MAX_EXAMPLES rows of two numbers.
    chosen = pool.orderBy(F.md5(F.col("label_key").cast("string")), "label_key", "label_value").limit(MAX_EXAMPLES)
    rows = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("label_key"))
    order = [F.md5(F.col(key).cast("string")), key, "label_value", *[f"stats_.{s}" for s in STATS]]
    examples = with_stats(rows.select(key, text, "label_value")).where(~base_failed())
    picked = examples.orderBy(*order).limit(MAX_EXAMPLES)
    got = picked.select("label_value", *[c.alias(f) for f, c in feature_columns().items()]).toPandas()
    x = got[list(FEATURES)].to_numpy(np.float64)
    return learn(x, got["label_value"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """CASE WHEN rule THEN false ... ELSE true over ``stats_``."""
    features, out = feature_columns(), None
    for rule in rules:
        when = None
        for c in rule:
            when = c.column(features) if when is None else when & c.column(features)
        out = F.when(when, F.lit(False)) if out is None else out.when(when, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with stats_, base_failed_ and kept_."""
    measured = with_stats(docs.drop("base_failed_", "kept_"), text)
    return measured.withColumn("base_failed_", base_failed()).withColumn(
        "kept_", F.when(F.col("base_failed_"), F.lit(False)).otherwise(verdict(rules))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    own = {c: f"own_{c}" for c in docs.columns if c.lower() in ("stats_", "base_failed_", "kept_")}
    judged = judge(docs.withColumnsRenamed(own), fit(docs, labels))
    return judged.where("kept_").drop("stats_", "base_failed_", "kept_").withColumnsRenamed({v: k for k, v in own.items()})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs, rules).select(
        "doc_id", *[F.col(f"stats_.{s}").alias(s) for s in shown], F.col("base_failed_").alias("base_failed"),
        F.col("kept_").alias("kept"),
    )
