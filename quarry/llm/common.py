"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.plans.sizing import materialize

# Rows per Arrow batch for whole-text columns: texts are kilobytes each, so the
# engine's default of 10,000 rows would put tens of MB into every batch.
ARROW_ROWS = 250


def prepare(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch where the session still has the default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def n_parts(spark: SparkSession) -> int:
    """The session's shuffle width: explicit repartitions follow it, so they
    grow with what the cluster is told to use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None],
              schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for a function from a batch to a dict of columns."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = arrow_schema(st)

    def run(batches):
        for b in batches:
            out = fn(b)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [as_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, st)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values.cast(kind)
    if isinstance(values, np.ndarray):
        return pa.array(values).cast(kind)
    return pa.array(values, type=kind)


def arrow_schema(st: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(st)


def crc_fold(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def integer_ids(df: DataFrame, col: str) -> None:
    """A clear error for operators that order documents by a number."""
    kind = df.schema[col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{col} must be an integer column to order documents by, not {kind.simpleString()}")


def split_bounds(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points of an integer column, from
    approximate quantiles of all its values (one aggregation; the driver gets
    ``parts`` numbers). The cuts only balance work: any cuts give the same
    results."""
    parts = max(1, min(parts, 4096))
    if parts == 1:
        return []
    q = [i / parts for i in range(1, parts)]
    row = df.select(F.percentile_approx(F.col(col), q, 20000).alias("q")).first()
    return sorted({int(x) for x in (row["q"] or [])})


def block_of(col: Column, bounds: list[int]) -> Column:
    """Number of cut points <= the value (null: one past the last block)."""
    if not bounds:
        return F.when(col.isNull(), F.lit(1)).otherwise(F.lit(0))
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def find(s):
        import pandas as pd
        return pd.Series(np.searchsorted(cuts, s.to_numpy(dtype=np.int64), side="right").astype("int32"))

    return F.when(col.isNull(), F.lit(len(bounds) + 1)).otherwise(find(F.coalesce(col, F.lit(0)).cast("long")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list over long node names.

    Alternating large-star and small-star steps: every step is a minimum per
    node (map-side combined) and an equi-join back, so a hot node is split by
    the adaptive skew join and no neighbour list is ever collected. Each round
    is written to the shared folder, which cuts lineage and survives the loss
    of executors, until a round changes nothing. Returns (node, root) with root
    the smallest node reachable, for nodes that have an edge.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    before = None
    while True:
        # large star: neighbours above a node move to the smallest of its neighbours
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: smaller neighbours and the node itself move to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        cur = materialize(small, "cc")
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def ranked_in_groups(df: DataFrame, group: str, order: list[str], block: str, out: str) -> DataFrame:
    """Gapless 0-based position of each row in its group, by ``order``.

    ``block`` numbers consecutive ranges of the leading order column, so the
    rank is a row number inside (group, block) plus the rows of earlier blocks;
    no window ever spans a whole group. The block totals table has groups x
    blocks rows (blocks <= 4097), which bounds its broadcast.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    totals = (df.groupBy(group, block).agg(F.count("*").alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(
                  Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("__n"))
    w = Window.partitionBy(group, block).orderBy(*by)
    return (df.withColumn("__r", F.row_number().over(w))
            .join(F.broadcast(totals), [group, block])
            .withColumn(out, (F.col("__before") + F.col("__r") - 1).cast("long"))
            .drop("__before", "__r"))
