"""Directly-follows graphs.  A graph is two frames: edges(source, target,
count) and nodes(activity, count); both have at most activities ** 2 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.ranks import quantiles
from pathloom.schema import LOG, LogSchema, minutes, require_columns


def _followed(log: DataFrame, s: LogSchema) -> DataFrame:
    """Each event with the next activity and time of its case; a null activity
    still stands between its neighbours."""
    require_columns(log, s.core)
    return log.where(F.col(s.case).isNotNull()).select(
        F.col(s.activity).alias("source"),
        F.lead(s.activity).over(s.events).alias("target"),
        F.col(s.time).alias("at"),
        F.lead(s.time).over(s.events).alias("next_at"),
    )


def dfg_edges(log: DataFrame, s: LogSchema = LOG, drop_self_loops: bool = False) -> DataFrame:
    pairs = _followed(log, s).where("source is not null and target is not null")
    pairs = pairs.where("source <> target") if drop_self_loops else pairs
    return pairs.groupBy("source", "target").count()


def dfg_nodes(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Events by activity."""
    named = log.where(F.col(s.activity).isNotNull()).select(F.col(s.activity).alias("activity"))
    return named.groupBy("activity").count()


def edge_performance(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Minutes from one activity to the next, by edge."""
    took = minutes("at", "next_at")
    pairs = _followed(log, s).where("source is not null and target is not null").withColumn("took", took)
    also = {"count": "count(1)", "mean_min": "avg(took)"}
    return quantiles(pairs, "took", {"median_min": 0.5, "p90_min": 0.9}, ["source", "target"], also)


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("count"), "source", "target").limit(k)


def incident_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches, with their counts as they were."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("activity"))
    return nodes.join(ends, "activity", "left_semi")


def filter_dfg(
    edges: DataFrame, nodes: DataFrame, min_edge_count: int = 1, top_k_edges: int | None = None
) -> tuple[DataFrame, DataFrame]:
    kept = edges.where(F.col("count") >= min_edge_count)
    kept = kept if top_k_edges is None else top_edges(kept, top_k_edges)
    return kept, incident_nodes(nodes, kept)


def ego(
    edges: DataFrame, nodes: DataFrame, focus: str, depth: int = 1, min_edge_count: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The subgraph induced by what ``depth`` undirected steps reach."""
    kept = edges.where(F.col("count") >= min_edge_count)
    both = kept.select(F.col("source").alias("x"), F.col("target").alias("y"))
    both = both.union(both.select("y", "x")).distinct()
    seen = edges.sparkSession.range(1).select(F.lit(focus).alias("activity"))
    for _ in range(depth):
        step = both.join(seen, F.col("x") == F.col("activity")).select(F.col("y").alias("activity"))
        seen = seen.union(step).distinct()
    inside = kept.join(seen.withColumnRenamed("activity", "source"), "source", "left_semi")
    inside = inside.join(seen.withColumnRenamed("activity", "target"), "target", "left_semi")
    return inside.select("source", "target", "count"), nodes.join(seen, "activity", "left_semi")


def list_activities(nodes: DataFrame, top_n: int | None = None) -> DataFrame:
    """Names by count."""
    ordered = nodes.orderBy(F.desc("count"), "activity")
    return (ordered if top_n is None else ordered.limit(top_n)).select("activity")


def dfg_view(
    log: DataFrame,
    s: LogSchema = LOG,
    min_edge_count: int = 1,
    top_k_edges: int | None = None,
    focus: str | None = None,
    ego_depth: int = 1,
    view_mode: str = "full",
    drop_self_loops: bool = False,
) -> tuple[DataFrame, DataFrame]:
    if view_mode not in ("full", "ego"):
        raise ValueError(f"unknown view_mode {view_mode!r}")
    if view_mode == "ego" and not focus:
        raise ValueError("an ego view needs a focus activity")
    edges, nodes = filter_dfg(dfg_edges(log, s, drop_self_loops), dfg_nodes(log, s), min_edge_count, top_k_edges)
    return ego(edges, nodes, focus, ego_depth, min_edge_count) if view_mode == "ego" else (edges, nodes)


def plot_nodes(nodes: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Marker size 14 to 40 by count, and the label."""
    kept = nodes if max_nodes is None else nodes.orderBy(F.desc("count"), "activity").limit(max_nodes)
    largest = kept.agg(F.max("count").alias("largest"))
    size = F.lit(14.0) + F.lit(26.0) * F.col("count") / F.col("largest")
    label = F.concat("activity", F.lit("\n("), F.col("count").cast("string"), F.lit(")"))
    return kept.crossJoin(F.broadcast(largest)).select("activity", "count", size.alias("size"), label.alias("label"))


def plot_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between plotted nodes with their labels."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("activity").alias(end)), end, "left_semi")
    return edges.select("source", "target", "count", F.col("count").cast("string").alias("label"))
