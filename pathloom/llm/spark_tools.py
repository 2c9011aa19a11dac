"""Spark helpers that the operators of this subpackage share.

* ``materialize``   cuts lineage with a table in the cluster's shared folder
* ``discard``       deletes such a table when nothing reads it any more
* ``fresh``         picks a column name that the input doesn't use
* ``gapless_rank``  a distributed ``row_number`` that survives hot groups
* ``components``    connected components of an edge list, by star contraction
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash buckets a group is split into by gapless_rank.
RANK_BUCKETS = 4096
#: Offsets of buckets that are broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_OFFSETS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Only where the session names none and runs on one machine (tests) a
    temporary folder is made and kept for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not path:
        path = spark.conf.get("pathloom.scratch.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("pathloom.scratch.dir", path)
    return path.rstrip("/")


#: Whether Spark deletes the shuffle files of a statement when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that a
    lost executor costs a re-read rather than the whole lineage.  What was
    shuffled for it goes as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.pathloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize``; nothing may be read from it later."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.pathloom_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_digits(col: Column, digits: int) -> Column:
    """The first ``digits`` hex digits of the md5 of a string column, as a
    long; DuckDB's ``md5`` gives the same."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, digits), 16, 10).cast("long")


def gapless_rank(df: DataFrame, group: str, key: Column, order: list[Column], out: str, part: Column | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each value of ``group``, ordered by
    (bucket of md5(key), order), or by (part, order) if ``part`` is given.

    One window over a group would put a hot group in one task.  Each group is
    split into RANK_BUCKETS hash buckets; the buckets are counted (one row a
    bucket after the partial sums), their offsets are running sums, and the
    window only numbers the rows of one bucket.
    """
    bucket, n, base, owner, part_ = (fresh(x, df) for x in ("bucket", "bucket_n", "bucket_base", "bucket_group", "bucket_of"))
    rows = df.withColumn(bucket, hash_digits(F.coalesce(key.cast("string"), F.lit("")), 3) if part is None else part)
    counts = rows.groupBy(group, bucket).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias(owner), F.col(bucket).alias(part_), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base)
    )
    offsets = materialize(offsets, "rank-offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_OFFSETS else offsets
    within = F.row_number().over(W.partitionBy(group, bucket).orderBy(*order))
    ranked = rows.withColumn(out, within.cast("long") - 1)
    joined = ranked.join(offsets, F.col(group).eqNullSafe(F.col(owner)) & F.col(bucket).eqNullSafe(F.col(part_)))
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(bucket, base, owner, part_)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` but the roots; root is the
    smallest node that can be reached.

    Alternating large-star and small-star steps; each round is a written
    table.  Ends when a round leaves the edges as they were.  Nodes are longs.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    star = materialize(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct(), label)
    seen = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, star = star, materialize(moved.union(root.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(last)
        now = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


#: Keys with over 1 / HOT of all rows are hot: there are fewer than HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, on: str, table: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique by ``key``, a string or binary)
    where ``on`` is ``key``; the table's other columns are added.

    ``hot`` has one column, the keys that over 1 / HOT of the rows look for:
    what they find is broadcast, fewer than HOT rows.  Rows that have met it, or
    look for null, go into the shuffled join under ``spread``, a key of their
    own, so that no key brings more than 1 / HOT of the rows together."""
    wanted = fresh("join_key", rows, table)
    names = [c for c in table.columns if c != key]
    packed = table.select(F.col(key).alias(wanted), F.struct(*names).alias(fresh("found", rows)))
    found = packed.columns[1]
    few = packed.join(F.broadcast(hot.toDF(wanted)), wanted, "left_semi").withColumnsRenamed({wanted: on, found: f"{found}_few"})
    met = rows.join(F.broadcast(few), on, "left")
    done = F.col(f"{found}_few").isNotNull() | F.col(on).isNull()
    met = met.withColumn(wanted, F.when(done, F.concat(F.lit("none ").cast(rows.schema[on].dataType), spread)).otherwise(F.col(on)))
    out = met.join(packed, wanted, "left").withColumn(found, F.coalesce(f"{found}_few", found))
    return out.select(*rows.columns, *[F.col(f"{found}.{c}").alias(c) for c in names])
