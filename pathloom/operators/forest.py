"""Random forests whose trees go on to pure nodes, over any number of rows.

Spark ML's forest has every task send dense counts of every node, which costs the
square of the rows where nodes grow with them.  Here

1. features are cut into BINS bins, written once; a row is in a tree as often as a
   Poisson(1) hash of its number and the tree says;
2. nodes of over LOCAL rows are split by sums over all partitions, a job a level
   for all trees; one row a node comes to the driver;
3. rows of smaller nodes meet by a shuffle and each such node is grown to its end,
   at most LOCAL rows at a time; what grew is a row of a table;
4. rows to predict follow the upper nodes, then meet the table by a shuffle.

Rows of one node and one batch are shuffled as one record, so a shuffle has few
records however many trees there are.  Each level costs its rows and nothing for
its nodes.  Bins, depth, features tried
at a node and when a node ends (no gain) are as in Spark's forests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.sources.tables import written

#: Levels of a tree at most: what Spark's forests allow.  Trees end where nodes are pure or small, as a rule far above.
DEPTH = 30
#: Values of a feature that trees tell apart; a bin is a byte.
BINS = 256
#: Rows of a node that one call grows to its end.
LOCAL = 250_000
#: Rows of trees that are handled at once, and rows to a task of a shuffle.
AT_ONCE, TASK_ROWS = 1 << 20, 2_000_000
#: Sums by key are counted in an array of all keys if it has no more than DENSE cells a row.
DENSE = 4
#: Votes are whole multiples of the least of 2 ** -VOTE_BITS of their reach, so that sums of up to 4,096 don't depend on their order.
VOTE_BITS = 40
#: Gains below this share of a node's score are rounding.
LEAST_GAIN = 1e-10

_U = np.uint64
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(13)])


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> _U(27))) * _U(0x94D049BB133111EB)
    return v ^ (v >> _U(31))


def times(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree has rows: Poisson(1) numbers from hashes."""
    start = _mix(np.array([(seed % (1 << 32) << 32) + tree + 1], _U))
    u = _mix(_mix(row.astype(_U) * _U(0x9E3779B97F4A7C15) ^ start) + start) >> _U(11)
    return np.searchsorted(_POISSON, u / 2.0**53, "right")


@dataclass(frozen=True)
class Rule:
    """What a node's sums (rows, weight of class 0, of class 1; regression: rows,
    weight, weighted y) are worth; ``scale`` weighs the classes."""

    binary: bool
    scale: tuple[float, float] = (1.0, 1.0)

    def row_sums(self, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(y)), weight * (1 - y) if self.binary else weight, weight * y], axis=1)

    def _parts(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = sums[:, 1] * self.scale[0], sums[:, 2] * self.scale[1]
        return (a + b if self.binary else a), b

    def score(self, sums: np.ndarray) -> np.ndarray:
        """Gini impurity or variance times weight, but for a constant and the sign."""
        w, b = self._parts(sums)
        return (b * b + ((w - b) ** 2 if self.binary else 0.0)) / np.maximum(w, 1e-300)

    def value(self, sums: np.ndarray) -> np.ndarray:
        w, b = self._parts(sums)
        return b / np.maximum(w, 1e-300)

    def open(self, sums: np.ndarray) -> np.ndarray:
        mixed = (sums[:, 1] > 0) & (sums[:, 2] > 0) if self.binary else True
        return (sums[:, 0] > 1) & mixed


class Nodes:
    """Inner nodes send rows with bin <= cut of a feature to ``left``, others to the next; feature -1 ends."""

    def __init__(self, n: int):
        self.feature, self.cut, self.left, self.value = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Numbers of the children of nodes ``at``: left, right, left, ..."""
        n = len(self.feature)
        self.feature[at], self.cut[at], self.left[at] = feature, cut, n + 2 * np.arange(len(at))
        more = Nodes(len(value))
        self.feature, self.cut, self.left = (np.concatenate(p) for p in ((self.feature, more.feature), (self.cut, more.cut), (self.left, more.left)))
        self.value = np.concatenate([self.value, value])
        return n + np.arange(len(value))

    def follow(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            here = at[live]
            at[live] = self.left[here] + (x[live, self.feature[here]] > self.cut[here])
            live = live[self.feature[at[live]] >= 0]
        return at


#: What a tree's nodes are written as.
TREE = {"feature": np.int32, "cut": np.int32, "left": np.int32, "value": np.float64}


def _heads(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _merged(key: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in the keys' order."""
    cells = int(key.max(initial=-1)) + 1
    if cells <= DENSE * len(key):
        have = np.flatnonzero(np.bincount(key, minlength=cells))
        return have, np.stack([np.bincount(key, s, cells)[have] for s in sums.T], axis=1)
    order = np.argsort(key, kind="stable")
    heads = _heads(key[order])
    return key[order][heads], np.add.reduceat(sums[order], heads, axis=0)


def best_splits(key: np.ndarray, sums: np.ndarray, k: int, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each slot, in order: feature, cut, whether the split gains, sums of the
    left side and of all.  Keys are (slot * k + feature) * BINS + bin, sorted."""
    group = key // BINS
    heads = _heads(group)
    size = np.diff(np.append(heads, len(key)))
    run = np.cumsum(sums, axis=0)
    left = run - np.repeat((run - sums)[heads], size, axis=0)
    total = np.repeat(np.add.reduceat(sums, heads, axis=0), size, axis=0)
    right = total - left
    gain = rule.score(left) + rule.score(right) - rule.score(total)
    gain[right[:, 0] < 0.5] = -np.inf
    slots = _heads(group // k)
    most = np.repeat(np.maximum.reduceat(gain, slots), np.diff(np.append(slots, len(key))))
    at = np.flatnonzero(gain == most)
    at = at[_heads(group[at] // k)]
    gains = gain[at] > LEAST_GAIN * np.maximum(rule.score(total[at]), 1e-300)
    return group[at] % k, key[at] % BINS, gains, left[at], total[at]


def _children(nodes: Nodes, at: np.ndarray, found: tuple, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Split nodes ``at`` where that gains; numbers and sums of the children."""
    feature, cut, gains, left, total = found
    both = np.stack([left[gains], (total - left)[gains]], axis=1).reshape(-1, 3)
    return nodes.split(at[gains], feature[gains], cut[gains], rule.value(both)), both


def _tried(rng: np.random.Generator, n: int, k: int, most: int) -> np.ndarray:
    return rng.random((n, k)).argsort(axis=1)[:, :most]


def _keys(slot: np.ndarray, x: np.ndarray, tried: np.ndarray, k: int) -> np.ndarray:
    """Keys of rows for each feature that their slot tries, one feature after the other."""
    features = tried[slot].T
    return ((slot * k + features) * BINS + x[np.arange(len(slot)), features]).ravel()


def grown(x: np.ndarray, sums: np.ndarray, rng: np.random.Generator, levels: int, most: int, rule: Rule) -> Nodes:
    """A tree of these rows, grown to its end level by level."""
    k, nodes = x.shape[1], Nodes(1)
    nodes.value[:] = rule.value(sums.sum(axis=0, keepdims=True))
    at, slot = np.zeros(1, np.int64), np.zeros(len(x), np.int64)
    while levels and len(at):
        levels -= 1
        tried = _tried(rng, len(at), k, most)
        found = best_splits(*_merged(_keys(slot, x, tried, k), np.tile(sums, (tried.shape[1], 1))), k, rule)
        children, both = _children(nodes, at, found, rule)
        on = rule.open(both)
        place = np.full(2 * len(at), -1)
        place[np.flatnonzero(np.repeat(found[2], 2))[on]] = np.arange(on.sum())
        slot = place[2 * slot + (x[np.arange(len(x)), found[0][slot]] > found[1][slot])]
        x, sums, slot, at = x[slot >= 0], sums[slot >= 0], slot[slot >= 0], children[on]
    return nodes


@dataclass(frozen=True)
class Forest:
    columns: tuple[str, ...]
    edges: tuple[np.ndarray, ...]  # upper ends of a feature's bins but the last
    trees: int
    upper: Nodes  # the first are the roots
    lower: DataFrame  # what grew from ends of the upper ones, a row each
    shift: float
    step: float  # votes are multiples of it


def _edges(rows: DataFrame, column: str) -> np.ndarray:
    """Each value, of up to BINS; else quantiles."""
    few = [r[0] for r in rows.select(column).distinct().limit(BINS + 1).collect()]
    if len(few) > BINS:
        few = rows.approxQuantile(column, [(i + 1) / BINS for i in range(BINS)], 1 / (8 * BINS))
    return np.unique(few)[:-1]


def _bins(batch: pd.DataFrame, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.stack([np.searchsorted(e, batch[f"x{i}"].to_numpy(float), "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in x]


def _unpacked(x: pd.Series, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, k)


class _Records:
    """One record for the rows of a node, of numbers in arrays, until AT_ONCE rows are held."""

    def __init__(self, *names: str):
        self.names, self.found, self.held = names, [], 0

    def add(self, node: np.ndarray, *columns: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.argsort(node, kind="stable")
        heads = _heads(node[order])
        for some in np.split(order, heads[1:]) if len(order) else []:
            self.found.append((node[some[0]], *[c[some].tobytes() for c in columns]))
        self.held += len(order)
        if self.held > AT_ONCE:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.found:
            yield pd.DataFrame(self.found, columns=["node", *self.names])
        self.found, self.held = [], 0


def _numbers(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _numbered(columns: tuple[str, ...]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]


def fit(rows: DataFrame, columns: tuple[str, ...], trees: int, rule: Rule, most: int, seed: int, depth: int = DEPTH, weight: str | None = None, local: int = LOCAL) -> Forest:
    """A forest for ``y`` of written ``rows`` without nulls; a node tries ``most``
    features.  ``weight`` names a column of rows' weights."""
    k = len(columns)
    n, shift, known, low, high = rows.agg(F.count(F.lit(1)), F.avg("y"), F.count("y"), F.min("y"), F.max("y")).first()
    if known < n or (rule.binary and rows.where("y NOT IN (0, 1)").limit(1).count()):
        raise ValueError("y has to be 0 or 1" if rule.binary else "y has to be a number")
    shift = 0.0 if rule.binary else shift or 0.0
    reach = 1.0 if rule.binary or not n else float(max(high - shift, shift - low)) or 1.0
    plain = rows.select(*_numbered(columns), (F.col("y") - shift).alias("y"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"))
    edges = tuple(_edges(plain, f"x{i}") for i in range(k))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "x": _packed(_bins(b, edges)), "y": b["y"], "w": b["w"]})

    spread = plain.repartition(_tasks(rows, n)).withColumn("row", F.monotonically_increasing_id())
    table = written(spread.mapInPandas(binned, "row long, x binary, y double, w double"), "bins")

    def placed(batches: Iterator[pd.DataFrame], nodes: Nodes, slots: np.ndarray) -> Iterator[tuple]:
        """(slot, x, sums) of the rows of each tree whose node has a slot."""
        for b in batches:
            x, y, w, row = _unpacked(b["x"], k), b["y"].to_numpy(), b["w"].to_numpy(), b["row"].to_numpy()
            for tree in range(trees):
                weighed = times(row, tree, seed) * w
                on = np.flatnonzero(weighed > 0)
                slot = slots[nodes.follow(np.full(len(on), tree), x[on])]
                on, slot = on[slot >= 0], slot[slot >= 0]
                if len(on):
                    yield slot, x[on], rule.row_sums(weighed[on], y[on])

    def counted(nodes: Nodes, slots: np.ndarray, tried: np.ndarray) -> Callable:
        def out(keys: list, sums: list) -> pd.DataFrame:
            key, total = _merged(np.concatenate(keys), np.concatenate(sums))
            return pd.DataFrame({"slot": key // (k * BINS), "key": key, "n": total[:, 0], "a": total[:, 1], "b": total[:, 2]})

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, sums, held = [], [], 0
            for slot, x, own in placed(batches, nodes, slots):
                keys.append(_keys(slot, x, tried, k))
                sums.append(np.tile(own, (tried.shape[1], 1)))
                held += len(keys[-1])
                if held > AT_ONCE:
                    yield out(keys, sums)
                    keys, sums, held = [], [], 0
            if held:
                yield out(keys, sums)

        return count

    def best(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("key")
        feature, cut, gains, left, total = best_splits(b["key"].to_numpy(), b[["n", "a", "b"]].to_numpy(), k, rule)
        both = {f"s{i}": v for i, v in enumerate([*left.T, *total.T])}
        return pd.DataFrame({"slot": b["slot"].to_numpy()[:1], "feature": feature, "cut": cut, "gains": gains, **both})

    nodes, level, rng = Nodes(trees), 0, np.random.default_rng(seed)
    at, small, levels_of = np.arange(trees), [], {}
    if n <= local:  # a tree has no row that the table hasn't
        at, small = at[:0], [np.arange(trees)]
        levels_of = dict.fromkeys(range(trees), depth)
    while len(at) and level < depth:
        slots = np.full(len(nodes.feature), -1)
        slots[at] = np.arange(len(at))
        sums = table.mapInPandas(counted(nodes, slots, _tried(rng, len(at), k, most)), "slot long, key long, n double, a double, b double")
        sums = sums.groupBy("slot", "key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        schema = "slot long, feature int, cut int, gains boolean, " + ", ".join(f"s{i} double" for i in range(6))
        got = sums.groupBy("slot").applyInPandas(best, schema).toPandas().sort_values("slot")  # a row a node
        there, both = at[got["slot"].to_numpy()], got[[f"s{i}" for i in range(6)]].to_numpy()
        nodes.value[there] = rule.value(both[:, 3:])
        found = (got["feature"].to_numpy(), got["cut"].to_numpy(), got["gains"].to_numpy(), both[:, :3], both[:, 3:])
        children, own = _children(nodes, there, found, rule)
        level += 1
        on = rule.open(own)
        few = on & (own[:, 0] <= local)
        small.append(children[few])
        levels_of |= dict.fromkeys(children[few].tolist(), depth - level)
        at = children[on & ~few]

    small = np.concatenate([*small, np.zeros(0, np.int64)]).astype(np.int64)
    slots = np.full(len(nodes.feature), -1)
    slots[small] = small

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = _Records("x", "a", "b")
        for slot, x, own in placed(batches, nodes, slots):
            yield from records.add(slot, x, own[:, 1], own[:, 2])
        yield from records.rest()

    def grow(b: pd.DataFrame) -> pd.DataFrame:
        node = int(b["node"].iloc[0])
        own, other = _numbers(b["a"], float), _numbers(b["b"], float)
        sums = np.stack([np.ones(len(own)), own, other], axis=1)
        tree = grown(_unpacked(b["x"], k), sums, np.random.default_rng([seed % (1 << 32), node]), levels_of[node], most, rule)
        return pd.DataFrame([(node, *[getattr(tree, c).tobytes() for c in TREE])], columns=["node", *TREE])

    rows_of = table.mapInPandas(sent, "node long, x binary, a binary, b binary").repartition(max(_tasks(rows, n * trees), min(len(small), 1000)), "node")
    lower = rows_of.groupBy("node").applyInPandas(grow, "node long, " + ", ".join(f"{c} binary" for c in TREE))
    step = 2.0 ** (math.ceil(math.log2(reach)) - VOTE_BITS)
    return Forest(columns, edges, trees, nodes, written(lower, "trees"), shift, step)


def predicted(forest: Forest, rows: DataFrame, row: str) -> DataFrame:
    """(row, value): the mean over the trees, by rows' numbers in ``row``."""
    k, edges, trees, upper, step = len(forest.columns), forest.edges, forest.trees, forest.upper, forest.step
    n = rows.count()
    parts = -(-n // TASK_ROWS) or 1  # of the rows of a node

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, own = _bins(b, edges), b["row"].to_numpy()
            part = int(_mix(own[:1].astype(_U))[0] % _U(parts))
            records = _Records("row", "x")
            for tree in range(trees):
                for out in records.add(upper.follow(np.full(len(b), tree), x), own, x):
                    yield out.assign(part=part)
            for out in records.rest():
                yield out.assign(part=part)

    def follow(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """Values of the rows of one node."""
        row, value = _numbers(asked["row"], np.int64), np.zeros(0)
        if len(row) and len(own):
            tree = Nodes(0)
            for c, kind in TREE.items():
                setattr(tree, c, np.frombuffer(own[c].iloc[0], kind))
            value = tree.value[tree.follow(np.zeros(len(row), np.int64), _unpacked(asked["x"], k))]
        elif len(row):
            value = np.full(len(row), upper.value[asked["node"].iloc[0]])
        return pd.DataFrame({"row": row, "value": np.round(value / step) * step})

    plain = rows.select(F.col(row).alias("row"), *_numbered(forest.columns)).repartition(_tasks(rows, n))
    asked = plain.mapInPandas(ends, "node long, row binary, x binary, part int")
    own = forest.lower.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sides = [df.repartition(_tasks(rows, n * trees), "node", "part").groupBy("node", "part") for df in (asked, own)]
    values = sides[0].cogroup(sides[1]).applyInPandas(follow, "row long, value double").groupBy("row").agg(F.sum("value").alias("votes"))
    return values.select("row", (F.col("votes") / trees + forest.shift).alias("value"))
