"""Helpers shared by the operators: durable intermediate tables, bucket counts, input columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``, which every executor can reach.

    Only where that setting is empty (a local session, as in tests) a folder of this machine is set.
    """
    got = getattr(spark, "_undula_shared_dir", None)
    if got:
        return got
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="undula-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/undula-{uuid.uuid4().hex}"
    spark._undula_shared_dir = path
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before; the folder is the cluster's to clean
        pass


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs tasks of one stage only, and what was written once is read
    alike by every later stage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table of ``durable`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _drop(spark, folder)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(spark: SparkSession, rows: int, per_bucket: int) -> int:
    """At least the session's shuffle partitions, more where ``per_bucket`` rows would be exceeded."""
    return max(shuffle_parts(spark), -(-rows // per_bucket))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: A joined side of at most so many bytes, as measured, is broadcast.
SMALL_BYTES = 32 << 20


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a durable right side of numbers and arrays of numbers, which is broadcast if its counted rows and array
    elements make few bytes, and shuffled otherwise."""
    arrays = [f.name for f in right.schema if isinstance(f.dataType, T.ArrayType)]
    rows, *elements = right.agg(F.count("*"), *(F.coalesce(F.sum(F.size(a)), F.lit(0)) for a in arrays)).first()
    size = rows * (16 + 8 * len(right.columns)) + 8 * sum(elements)
    return left.join(F.broadcast(right) if size <= SMALL_BYTES else right, on, how)


def added(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items())])
