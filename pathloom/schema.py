"""The event log model: one frozen description of column names for all operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogSchema:
    """Names of the log's columns; ``seq`` breaks ties of time in a case."""

    case: str = "case_id"
    activity: str = "activity"
    time: str = "timestamp"
    seq: str = "_seq"
    resource: str = "resource"

    @property
    def order(self) -> list[Column]:
        return [F.col(self.time), F.col(self.seq)]

    @property
    def events(self) -> WindowSpec:
        """A case's events in order."""
        return W.partitionBy(self.case).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        """A case's events."""
        return W.partitionBy(self.case)

    @property
    def core(self) -> list[str]:
        return [self.case, self.activity, self.time]


LOG = LogSchema()


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """KeyError that lists what is missing and what there is."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")


def minutes(start: Column | str, end: Column | str) -> Column:
    """Minutes between two timestamps, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end) / F.lit(6e7)


def traces(log: DataFrame, s: LogSchema = LOG, name: str = "trace") -> DataFrame:
    """case and its activities in order, as an array."""
    event = F.struct(F.col(s.time).alias("t"), F.col(s.seq).alias("q"), F.col(s.activity).alias("a"))
    ordered = F.transform(F.sort_array(F.collect_list(event)), lambda e: e["a"])
    return log.where(F.col(s.case).isNotNull()).groupBy(s.case).agg(ordered.alias(name))
