"""Exact ranks without one task that sees a whole group.

* ``quantiles``  interpolated quantiles of groups, by distributed selection
* ``running``    running sums in order of a column, by ranges with offsets

A selection brackets each wanted rank first: a mergeable sketch gives two
values that the rank lies between, some thousandths of a group apart.  One
more pass counts distinct values within the brackets, and all rows of a gap
between brackets as one; running counts over those few rows give exact ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sketch's ranks are right to 1 / ACCURACY of a group.
ACCURACY = 10_000
#: Rows that are sorted as they are.
LEAST = 4 * ACCURACY
#: Points of a sketch that a narrower bracket is chosen from, and ranges of a running sum.
GRID, RANGES = 1000, 1024
#: Ranges are found among about the root of their number first.
COARSE = 32


def evenly(n: int) -> str:
    """0, 1 / n, ... 1 as a literal array, in SQL."""
    return numbers([i / n for i in range(n + 1)])


def numbers(values: Sequence[float]) -> str:
    """Doubles as a literal array, in SQL."""
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")" if values else "cast(array() AS array<double>)"


def _keys(by: Sequence[str]) -> list[str]:
    return [f"by_{i}_" for i in range(len(by))]


def over(keys: Sequence[str], order: str, frame: str = "ROWS UNBOUNDED PRECEDING") -> str:
    """A window in SQL."""
    return f"OVER (PARTITION BY {', '.join(keys) or '0'} ORDER BY {order} {frame})"


def _beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """``rows`` with the one row of their group.  Without keys that is one row,
    which is broadcast; else adaptive execution sees whether they are few."""
    if not keys:
        return rows.crossJoin(F.broadcast(groups))
    other = groups.withColumnsRenamed({k: f"{k}right" for k in keys})
    same = F.expr(" AND ".join(f"{k} <=> {k}right" for k in keys))
    return rows.join(F.broadcast(other) if few else other, same).drop(*[f"{k}right" for k in keys])


def _brackets(qs: Sequence[float]) -> str:
    """Two values around each rank, with two errors of the sketch to spare: of a
    group of LEAST rows eight ranks.  Smaller groups are one bracket."""
    slack = 2.0 / ACCURACY
    points = numbers([p for q in qs for p in (max(q - slack, 0.0), min(q + slack, 1.0))])
    ends = ", ".join(["min(x_), max(x_)"] * len(qs))
    return f"if(count(x_) < {LEAST}, array({ends}), percentile_approx(x_, {points}, {ACCURACY})) AS cuts_"


def _inside(i: int) -> str:
    return f"x_ BETWEEN cuts_[{2 * i}] AND cuts_[{2 * i + 1}]"


def _narrower(rows: DataFrame, found: DataFrame, keys: list[str], qs: Sequence[float]) -> DataFrame:
    """``found`` with brackets some GRID / 2 times narrower: the sketch of each
    bracket's own rows, at the rank that is left of it."""
    each, cuts = [], []
    for i, q in enumerate(qs):
        each += [f"count_if(x_ < cuts_[{2 * i}]) AS below_{i}", f"count_if({_inside(i)}) AS in_{i}"]
        each.append(f"percentile_approx(CASE WHEN {_inside(i)} THEN x_ END, {evenly(GRID)}, {ACCURACY}) AS grid_{i}")
        for j, (whole, more, sign) in enumerate((("floor", 0, "-"), ("ceil", 1, "+"))):
            share = f"({whole}((n_ - 1) * {q!r}D) + {more} - below_{i}) / in_{i} {sign} {2.0 / ACCURACY!r}D"
            at = f"grid_{i}[CAST(least(greatest({whole}(({share}) * {GRID}), 0), {GRID}) AS INT)]"
            cuts.append(f"if(in_{i} < {LEAST}, cuts_[{2 * i + j}], {at})")
    counted = _beside(rows, found, keys).groupBy(*keys).agg(*map(F.expr, each))
    both = _beside(found, counted, keys)
    return both.withColumn("cuts_", F.expr(f"CASE WHEN n_ > 0 THEN array({', '.join(cuts)}) END")).select(*found.columns)


def quantiles(
    df: DataFrame, column: str, wanted: Mapping[str, float], by: Sequence[str] = (), also: Mapping[str, str] | None = None, rounds: int = 1, few: bool = False
) -> DataFrame:
    """by, ``also`` (names and aggregates of ``df``, in SQL) and a column for
    each wanted quantile: exact, linear between neighbours, null for a group
    without values.

    Each round of brackets leaves some 4 / ACCURACY of a group's rows for each
    quantile, times 2 / GRID for each round after the first; what is left is
    sorted by one task a group.  One round does for groups of 10 ** 10 rows.
    ``few`` groups, if the caller knows that, are broadcast."""
    keys, qs = _keys(by), list(dict.fromkeys(wanted.values()))
    named = [f"`{c}` AS {k}" for c, k in zip(by, keys, strict=True)]
    rows = df.selectExpr("*", *named, f"CAST(`{column}` AS DOUBLE) AS x_")
    carried = ["n_", *[f"also_{i}_" for i in range(len(also or {}))]]
    aggregates = [_brackets(qs), "count(x_) AS n_", *[f"{sql} AS also_{i}_" for i, sql in enumerate((also or {}).values())]]
    found = rows.groupBy(*keys).agg(*map(F.expr, aggregates))
    rows = rows.select(*keys, "x_")
    for _ in range(rounds - 1):
        found = _narrower(rows, found, keys, qs)
    inside = "coalesce(" + " OR ".join(_inside(i) for i in range(len(qs))) + ", false)"
    gap = "greatest(" + ", ".join(f"CASE WHEN cuts_[{i}] < x_ THEN cuts_[{i}] END" for i in range(2 * len(qs))) + ")"
    # Nulls count as no row of the first gap, so that a group of nulls alone is there.
    marked = _beside(rows, found, keys, few).selectExpr(*keys, *carried, "x_", f"if({inside}, x_, {gap}) AS v_", f"NOT {inside} AS gap_")
    counts = marked.groupBy(*keys, "v_", "gap_").agg(*map(F.expr, ["count(x_) AS c_", *[f"first({c}) AS {c}" for c in carried]]))
    upto = counts.selectExpr("*", f"sum(c_) {over(keys, 'v_ NULLS FIRST, gap_')} AS upto_")
    picks, out = [], {}
    for i, q in enumerate(qs):
        place = f"(n_ - 1) * {q!r}D"
        for name, whole in (("lo", "floor"), ("hi", "ceil")):
            picks.append(f"max(CASE WHEN upto_ - c_ <= {whole}({place}) AND {whole}({place}) < upto_ AND NOT gap_ THEN v_ END) AS {name}_{i}")
        out[q] = f"""CASE WHEN n_ > 0 AND (lo_{i} IS NULL OR hi_{i} IS NULL) THEN CAST(raise_error('a rank isn\\'t within its bracket') AS DOUBLE)
            WHEN lo_{i} = hi_{i} THEN lo_{i} ELSE (ceil({place}) - {place}) * lo_{i} + ({place} - floor({place})) * hi_{i} END"""
    picked = upto.groupBy(*keys).agg(*map(F.expr, [*picks, *[f"first({c}) AS {c}" for c in carried]]))
    back = [f"{k} AS `{c}`" for c, k in zip(by, keys, strict=True)]
    return picked.selectExpr(*back, *[f"also_{i}_ AS `{n}`" for i, n in enumerate(also or {})], *[f"{out[q]} AS `{n}`" for n, q in wanted.items()])


def quantile(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One row with one quantile of all rows."""
    return quantiles(df, column, {name: q})


def split_points(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges`` - 1 values that cut a column into ranges of about as
    many rows; one job, and the values come to the driver."""
    points = f"percentile_approx(CAST(`{column}` AS DOUBLE), {numbers([i / ranges for i in range(1, ranges)])}, {4 * ranges})"
    return sorted(set(df.agg(F.expr(points)).first()[0] or ()))


def range_of(value: str, points: Sequence[float]) -> str:
    """How many of the sorted points are below a value, in SQL: equal values are
    in one range, and ranges are in the values' order."""
    below = lambda a: f"size(filter({a}, p -> p < {value}))"
    coarse = below(numbers(points[COARSE - 1 :: COARSE]))
    return f"{coarse} * {COARSE} + {below(f'slice({numbers(points)}, {coarse} * {COARSE} + 1, {COARSE})')}"


def running(
    df: DataFrame, column: str, sums: Mapping[str, str], by: Sequence[str] = (), descending: bool = False, inclusive: bool = True, ranges: int = RANGES
) -> DataFrame:
    """``df``, unique by (by, column), with running sums: ``sums`` maps new
    names to columns.  Rows are summed within ranges of the column, and ranges
    have the totals of those before them as offsets, so no task has a whole
    group.  The column has no nulls."""
    points, down, keys = split_points(df, column, ranges), "DESC" if descending else "ASC", [f"`{c}`" for c in by]
    rows = df.withColumn("range_", F.expr(range_of(f"CAST(`{column}` AS DOUBLE)", points)))
    totals = rows.groupBy(*by, "range_").agg(*[F.expr(f"sum(`{c}`) AS `t_{n}`") for n, c in sums.items()])
    before = over(keys, f"range_ {down}", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    other = [f"{k} AS right_{i}_" for i, k in enumerate([*keys, "range_"])]
    bases = totals.selectExpr(*other, *[f"coalesce(sum(`t_{n}`) {before}, 0) AS `t_{n}`" for n in sums])
    within = over([*keys, "range_"], f"`{column}` {down}", "ROWS BETWEEN UNBOUNDED PRECEDING AND " + ("CURRENT ROW" if inclusive else "1 PRECEDING"))
    summed = rows.selectExpr("*", *[f"coalesce(sum(`{c}`) {within}, 0) AS `s_{n}`" for n, c in sums.items()])
    same = F.expr(" AND ".join(f"{k} <=> right_{i}_" for i, k in enumerate([*keys, "range_"])))
    # Without groups there are at most ``ranges`` bases.
    joined = summed.join(bases if by else F.broadcast(bases), same)
    return joined.selectExpr(*[f"`{c}`" for c in df.columns], *[f"`s_{n}` + `t_{n}` AS `{n}`" for n in sums])
