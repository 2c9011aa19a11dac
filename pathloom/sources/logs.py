"""Sources and sinks: CSV tables, column mapping, and the standard event log."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.schema import LOG, LogSchema, require_columns

STANDARD = ("case_id", "activity", "timestamp", "resource", "attributes")
#: Day-first and month-first spellings that are tried in this order after ISO.
DAY_FIRST = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy")
MONTH_FIRST = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "MM-dd-yyyy HH:mm:ss", "MM-dd-yyyy")

#: What ends a time that has an offset from UTC.
OFFSET = r"(Z|[+-]\d{2}(:?\d{2})?)$"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; types are inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    """CSV with a header.  ``single`` asks for one file, for small summaries."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def preview(df: DataFrame, n: int = 25) -> DataFrame:
    """The first rows."""
    return df.limit(n)


def profile(df: DataFrame) -> DataFrame:
    """n_rows and n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def mapping_template(df: DataFrame) -> dict[str, object]:
    """The columns there are, an empty mapping and the standard names."""
    return {
        "available_columns": list(df.columns),
        "mapping": {k: [] if k == "attributes" else None for k in STANDARD},
        "standard_keys": list(STANDARD),
    }


@dataclass(frozen=True)
class ColumnMapping:
    case: str
    activity: str
    timestamp: str
    resource: str | None = None
    attributes: tuple[str, ...] = ()
    seq: str | None = None


def parse_timestamp(column: Column, dayfirst: bool = False, errors: str = "coerce", utc: bool = False) -> Column:
    """timestamp_ntz of a string or timestamp.  ``coerce``: null where nothing
    fits; ``raise``: an error on any value, blanks too, that isn't a time.  With
    ``utc`` a time with an offset becomes that of UTC, else its offset is ignored."""
    text = column.cast("string")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in (DAY_FIRST if dayfirst else MONTH_FIRST)]
    parsed = F.coalesce(column.try_cast("timestamp_ntz"), *(t.cast("timestamp_ntz") for t in tries))
    if utc:
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        moved = F.timestamp_add("MICROSECOND", F.unix_micros(text.try_cast("timestamp")), epoch)
        parsed = F.when(text.rlike(OFFSET), moved).otherwise(parsed)
    if errors == "coerce":
        return parsed
    if errors != "raise":
        raise ValueError("errors is 'coerce' or 'raise'")
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), F.coalesce(text, F.lit("null")))).cast("timestamp_ntz")
    return F.when(parsed.isNotNull(), parsed).otherwise(bad)


def bad_timestamps(df: DataFrame, column: str, dayfirst: bool = False, utc: bool = False, most: int = 10) -> list[str | None]:
    """The first values, at most so many, that aren't times."""
    rows = df.where(parse_timestamp(F.col(column), dayfirst, utc=utc).isNull()).select(F.col(column).cast("string"))
    return [r[0] for r in rows.limit(most).collect()]


def file_order(df: DataFrame, out: str = "_seq") -> DataFrame:
    """``df`` with 0, 1, 2, ... in the order of its files' names and of the rows
    in each, however Spark reads them: rows are counted by block of a file, and
    a row's number is its place in its block after those of all blocks before.

    A frame that isn't read from files as it is gets increasing numbers."""
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"))
    except AnalysisException:
        return df.withColumn(out, F.monotonically_increasing_id())
    rows = rows.withColumn("at_", F.monotonically_increasing_id())
    blocks = rows.groupBy("file_", "block_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = W.partitionBy(F.lit(0)).orderBy("file_", "block_").rowsBetween(W.unboundedPreceding, -1)  # a row a block of a file
    bases = blocks.select("file_", "block_", "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    joined = rows.join(bases, ["file_", "block_"])
    return joined.select(*df.columns, (F.col("base_") + F.col("at_") - F.col("first_")).alias(out))


def build_event_log(
    df: DataFrame,
    mapping: ColumnMapping,
    *,
    drop_missing_core: bool = True,
    dayfirst: bool = False,
    errors: str = "raise",
    keep_original_names: bool = False,
    standard_names: dict[str, str] | None = None,
    utc: bool = False,
    sort_by_time: bool = False,
) -> tuple[DataFrame, dict[str, object]]:
    """The standard log (case_id, activity, timestamp, _seq[, resource],
    attributes) and a description of how it was made, with its number of rows.

    ``_seq`` comes from ``mapping.seq``; without one it is the order of files
    and of rows in them, which ties of time keep.  An attribute that repeats a
    core column is taken once.  ``standard_names`` renames case_id, activity,
    timestamp and resource.  With ``errors`` ``raise`` a job looks for values
    that aren't times first, and names up to ten.  ``sort_by_time`` sorts the
    whole log by case and time; operators here don't need that.
    """
    core = [mapping.case, mapping.activity, mapping.timestamp]
    named = [*core, *([mapping.resource] if mapping.resource else [])]
    attributes = [a for a in dict.fromkeys(mapping.attributes) if a not in named]
    require_columns(df, [*named, *attributes, *([mapping.seq] if mapping.seq else [])])
    if errors not in ("coerce", "raise"):
        raise ValueError("errors is 'coerce' or 'raise'")
    if errors == "raise" and (bad := bad_timestamps(df, mapping.timestamp, dayfirst, utc)):
        raise ValueError(f"not a timestamp, in {mapping.timestamp}: {bad}")
    standard = {k: (standard_names or {}).get(k, k) for k in STANDARD[:4]}
    names = named if keep_original_names else list(standard.values())[: len(named)]
    parsed = [F.col(c) if c != mapping.timestamp else parse_timestamp(F.col(c), dayfirst, utc=utc) for c in named]
    rows, seq = (df, F.col(mapping.seq).cast("long")) if mapping.seq else (file_order(df, "_seq_"), F.col("_seq_"))
    log = rows.select(*[c.alias(n) for c, n in zip(parsed, names, strict=True)], seq.alias("_seq"), *attributes)
    if drop_missing_core:
        log = log.dropna(subset=names[:3])
    if sort_by_time:
        log = log.orderBy(names[0], names[2], "_seq")
    meta = {
        "case": names[0], "activity": names[1], "timestamp": names[2], "attributes": attributes, "columns": log.columns,
        "mapping": asdict(mapping), "standard_names": standard, "renamed": dict(zip(named, names, strict=True)),
        "selected_columns": [*named, *attributes], "n_rows": log.count(),
    }
    return log, meta


def drop_missing_core(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Rows with a case, an activity and a time."""
    require_columns(log, s.core)
    return log.dropna(subset=s.core)


def ignore_activities(log: DataFrame, names: list[str], s: LogSchema = LOG) -> DataFrame:
    """Leave activities out before anything looks at neighbours."""
    return log.where(~F.coalesce(F.col(s.activity).cast("string"), F.lit("nan")).isin(names)) if names else log


def normalized(column: Column) -> Column:
    """Trimmed of all white space, lower-cased."""
    return F.lower(F.regexp_replace(column.cast("string"), r"^\s+|\s+$", ""))


def relabel(log: DataFrame, to: dict[str, str], s: LogSchema = LOG) -> DataFrame:
    """Normalise activities and rename those that the mapping has; of two names
    for one activity the last holds, and a warning names it."""
    if twice := duplicate_labels(to):
        warnings.warn(f"activities with more than one name: {twice}", stacklevel=2)
    plain = normalized(F.col(s.activity))
    if not to:
        return log.withColumn(s.activity, plain)
    pairs = [F.lit(x) for kv in {k.strip().lower(): v for k, v in to.items()}.items() for x in kv]
    return log.withColumn(s.activity, F.coalesce(F.create_map(*pairs)[plain], plain))


def duplicate_labels(to: dict[str, str]) -> list[str]:
    """Raw values that two canonical names were given."""
    seen = [k.strip().lower() for k in to]
    return sorted({k for k in seen if seen.count(k) > 1})


def is_numeric(df: DataFrame, column: str, share: float = 0.8) -> bool:
    """Whether over ``share`` of the values read as numbers."""
    number = F.col(column).cast("string").try_cast("double").isNotNull().cast("double")
    return (df.agg(F.avg(number)).first()[0] or 0.0) > share


def filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Inclusive; values that aren't numbers go."""
    return df.where(F.col(column).cast("string").try_cast("double").between(low, high))


def filter_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value, as text, is chosen; nothing chosen, no rows."""
    return df.where(F.col(column).cast("string").isin(values)) if values else df.limit(0)


def filter_options(df: DataFrame, column: str, most: int = 5000) -> DataFrame:
    """Sorted distinct values to choose from."""
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").limit(most)


def filter_duration(intervals: DataFrame, low: float, high: float, column: str = "duration_minutes") -> DataFrame:
    """Inclusive."""
    return intervals.where(F.col(column).between(low, high))
