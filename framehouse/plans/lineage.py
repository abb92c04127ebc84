"""Where intermediate tables live, and how lineage is cut so that lost executors cost no recomputation from the start."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='framehouse-')}")
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


#: What this process has put under the shared folder, for delete_written().
WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def delete_written(spark: SparkSession) -> int:
    """Remove all intermediates so far; DataFrames that came of them can't be read any more. How many there were."""
    gone, WRITTEN[:] = list(WRITTEN), []
    for path in gone:
        delete_path(spark, path)
    return len(gone)


def written(df: DataFrame, name: str, zstd_level: int = 3) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is the files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", zstd_level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """written(), and the figures (aggregates of df's rows) that the write took along: no second pass, no further job."""
    watch = Observation(f"{name}-{uuid.uuid4().hex}")
    out = written(df.observe(watch, *[c.alias(k) for k, c in figures.items()]), name)
    return out, watch.get


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """df written to the shared folder in as many buckets by ``column`` as a shuffle has partitions, and read again.

    A join by that column then moves the other side alone. After a grouping by the same column each bucket is one file.
    The table's name goes at once: the files and the buckets are all that the DataFrame needs.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"framehouse_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).format("parquet").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # external: the files stay
    return found


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path that nothing reads any more, through the file system Spark itself uses."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
