"""Tables as series.

A series is rows of (series_id, pos, value): ``pos`` counts from 1 without gaps within each ``series_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values of a block, the piece of a series that one task handles.
BLOCK = 65_536
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def tasks(spark: SparkSession) -> int:
    """A fixed count of partitions, for rows that cost more than their bytes tell."""
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_series(df: DataFrame, value: str | Column, order_by: str | list[str], key: str | Column | None = None, spread: bool = False) -> DataFrame:
    """Rows ordered by ``order_by`` as one series, or as one per value of ``key``. Integral values stay integral.

    A series is numbered by one task; with ``spread`` it is cut into ranges, whose sizes give the first number of each: for
    series too long for a task, at the cost of a second shuffle. ``order_by`` must tell a series' rows apart.
    """
    order = [order_by] if isinstance(order_by, str) else order_by
    value = F.col(value) if isinstance(value, str) else value
    key = F.lit("all") if key is None else F.col(key) if isinstance(key, str) else key
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.select(key.cast("string").alias("series_id"), value.alias("value"), *(F.col(c).alias(o) for c, o in zip(order, by)))
    if not spread:
        rows = rows.repartition(tasks(df.sparkSession), "series_id")  # by bytes they'd seem few and share a task
        place = F.row_number().over(Window.partitionBy("series_id").orderBy(*by))
        return rows.select("series_id", place.cast("bigint").alias("pos"), "value")
    ranges = rows.repartitionByRange("series_id", *by).withColumn("_range", F.spark_partition_id())
    before = Window.partitionBy("series_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranges.groupBy("series_id", "_range").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = ranges.withColumn("n", F.row_number().over(Window.partitionBy("series_id", "_range").orderBy(*by)))
    same = numbered["series_id"].eqNullSafe(firsts["series_id"]) & (numbered["_range"] == firsts["_range"])
    return numbered.join(firsts, same).select(numbered["series_id"], (F.col("first") + F.col("n")).cast("bigint").alias("pos"), "value")


def haloed(series: DataFrame, ahead: int = 0, behind: int = 0) -> DataFrame:
    """``series`` with ``block``: each row in the block of its position, and a copy in each block whose rows look that far.

    Frames partitioned by (series_id, block) then see what they need of a series of any length; keep rows of ``own`` blocks.
    """
    low = F.expr(f"CAST(greatest(pos - 1 - {ahead}, 0) DIV {BLOCK} AS INT)")
    high = F.expr(f"CAST((pos - 1 + {behind}) DIV {BLOCK} AS INT)")
    return series.withColumn("block", F.explode(F.sequence(low, high)))


def own() -> Column:
    """Whether a row of ``haloed`` is in its own block."""
    return F.expr(f"(pos - 1) DIV {BLOCK} = block")


def daily(df: DataFrame, day: str, total: Column | None = None, series_id: str = "all") -> DataFrame:
    """One integral value a day, the sum of ``total`` or the number of rows, with 0 for days without rows."""
    days = df.groupBy(F.to_date(day).alias("day")).agg((F.count("*") if total is None else F.sum(total)).cast("bigint").alias("value")).filter("day IS NOT NULL")
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"), "a")
    return every.join(days, "day", "left").select(F.lit(series_id).alias("series_id"), (F.datediff("day", "a") + 1).cast("bigint").alias("pos"), F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))


def is_exact(series: DataFrame) -> bool:
    """Whether sums of the values are exact, being of whole numbers."""
    return dict(series.dtypes)["value"] in INTEGRAL


def check(series: DataFrame) -> DataFrame:
    kinds = dict(series.dtypes)
    if missing := {"series_id", "pos", "value"} - kinds.keys():
        raise ValueError(f"a series needs columns {sorted(missing)}")
    if kinds["value"] not in (*INTEGRAL, "double", "float") and not kinds["value"].startswith("decimal"):
        raise ValueError(f"values must be numbers, not {kinds['value']}")
    wide = F.col("value").cast("bigint") if kinds["value"] in INTEGRAL else F.col("value").cast("double")
    return series.select(F.col("series_id").cast("string").alias("series_id"), F.col("pos").cast("bigint").alias("pos"), wide.alias("value"))


def zone(window: int, exclusion_zone: float) -> int:
    """Positions on each side of a window that are no neighbours; halves round away from zero."""
    return int(window * exclusion_zone + 0.5 + 1e-12)
