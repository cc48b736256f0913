"""Size checks that guard every broadcast and driver-side block.

A broadcast is only requested for a side whose rows and bytes have been
measured to be under a bound. Above it the plain DataFrame is returned and
Spark shuffles both sides, so a query set that grows with the data still runs,
only through a shuffle join. The measure is a map-side combined aggregate:
every task sends one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default bounds for broadcasting a query-side table (query terms, query
# ids, shingle sets of a protected-passage list, lexicons).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20


def bounded_count(df: DataFrame, bound: int) -> int:
    """Row count (no rows move: tasks send partial counts); the bound is what
    callers compare with."""
    return df.count()


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes): bytes as the text length of all values, 8 at least for each."""
    width = sum((F.greatest(F.lit(8), F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)))
                 for c in df.columns), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                         max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when ``df`` is within both bounds."""
    rows, size = measured(df)
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(df)
    return df


def fixed_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast for tables whose size is fixed by construction (literal
    price lists, rule tables, one-row aggregates)."""
    return F.broadcast(df)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table scan dealt over all cores, when its files give fewer
    than two tasks a core (well compressed texts do: a few files, much work a
    row). For steps that cost far more than moving the row. For plain scans only:
    a plan with shuffles would be run to count its partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the session's shared checkpoint
    folder and read it back: a lineage cut that survives executor loss and
    lets several consumers share one computation (Spark only reuses a
    shuffle when the optimised subtrees are identical, which pushed-down
    filters usually prevent)."""
    return df.sparkSession.read.parquet(write_shared(df, name))


def shared_path(spark, name: str) -> str:
    """A fresh folder name under the application's part of the shared
    checkpoint folder."""
    import uuid
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_root(spark) -> str:
    """Where this application's intermediate tables stand."""
    from quarry.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry/{spark.sparkContext.applicationId}"


def clean_scratch(spark) -> bool:
    """Delete the application's intermediate tables. For the end of a job:
    results are lazy and read these tables until they are written elsewhere.
    Streams and their checkpoints stand apart and stay."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def write_shared(df: DataFrame, name: str) -> str:
    """Write ``df`` as parquet to a fresh folder under the shared checkpoint
    folder; returns the path (e.g. to start a file stream on it)."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path
