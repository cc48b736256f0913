"""The search table: declared schema with field roles (S2), upsert by id
(S3), delete by ids (S4), statistics (S5) and routing of extraction output
into searchable rows (S7).

The table is an ordinary DataFrame / parquet table; maintenance is
expressed as joins (anti join + union for upsert, anti/semi join for
delete), so it runs at any size without a storage engine of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIMENSIONS = 3072


def index_schema(dims: int = DEFAULT_DIMENSIONS) -> T.StructType:
    """Typed fields with roles in field metadata (key, searchable,
    filterable, sortable, facetable) and the vector dimension."""
    def f(name, dtype, **roles):
        return T.StructField(name, dtype, True, metadata=roles)
    return T.StructType([
        f("id", T.StringType(), key=True, filterable=True),
        f("content", T.StringType(), searchable=True),
        f("title", T.StringType(), searchable=True, sortable=True),
        f("source", T.StringType(), filterable=True, facetable=True),
        f("category", T.StringType(), filterable=True, facetable=True),
        f("date_created", T.TimestampType(), filterable=True, sortable=True),
        f("content_vector", T.ArrayType(T.FloatType()), searchable=True, dimensions=dims,
          metric="cosine"),
    ])


def conform(df: DataFrame, dims: int = DEFAULT_DIMENSIONS) -> DataFrame:
    """Project onto the index schema (missing columns NULL, values
    try_cast) and flag rows that cannot be indexed: NULL id or a vector
    whose length is not ``dims``. Adds ``valid`` and keeps ``version`` when
    present."""
    schema = index_schema(dims)
    cols = []
    for fld in schema.fields:
        if fld.name in df.columns:
            cols.append(F.col(fld.name).try_cast(fld.dataType).alias(fld.name, metadata=fld.metadata))
        else:
            cols.append(F.lit(None).cast(fld.dataType).alias(fld.name, metadata=fld.metadata))
    extra = [F.col("version")] if "version" in df.columns else []
    out = df.select(*cols, *extra)
    vec = F.col("content_vector")
    valid = F.col("id").isNotNull() & (vec.isNull() | (F.size(vec) == dims))
    return out.withColumn("valid", valid)


def _order() -> Column:
    return F.struct(F.coalesce(F.col("version").cast("long"), F.lit(-(2 ** 62))).alias("v"), F.xxhash64("content").alias("h"))


def latest_per_id(updates: DataFrame) -> DataFrame:
    """Within one batch the highest version wins; ties by content hash.

    An aggregate (max_by over the whole row), not a window: the partial
    aggregate runs map-side, so an id updated millions of times in one batch
    costs one row per task before the shuffle.
    """
    cols = [c for c in updates.columns if c != "id"]
    best = updates.groupBy("id").agg(F.max_by(F.struct(*cols), _order()).alias("__r"))
    return best.select("id", *[F.col("__r")[c].alias(c) for c in cols])


def upsert(base: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: returns (new table, counts). Valid update rows replace base rows
    with the same id (anti join + union) unless the base row has a higher
    version (an older version that arrives later changes nothing; a NULL
    version always replaces); invalid rows are counted as failed and never
    written. counts = (succeeded, failed) over the batch, after collapsing
    duplicate ids; an empty batch counts 0 and 0. The result has the columns of
    ``base``, which need not have ``valid`` or ``version``. Which ids are replaced
    is decided on ids and versions; whole update rows are shuffled once."""
    valid = updates.filter("valid")
    good = latest_per_id(valid)
    fresh, ids = good, valid.groupBy("id").agg(F.max_by("version", _order()).alias("version"))
    if "version" in base.columns and "version" in good.columns:
        newer = base.select("id", F.col("version").alias("__v")).join(ids, "id") \
            .filter(F.col("__v") > F.col("version")).select("id")
        fresh, ids = good.join(newer, "id", "left_anti"), ids.join(newer, "id", "left_anti")
    rows = fresh.select(*[c for c in fresh.columns if c in base.columns])
    new = base.join(ids.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)
    counts = updates.agg(F.sum(F.col("valid").cast("long")).alias("attempted_valid"),
                         F.coalesce(F.sum((~F.col("valid")).cast("long")), F.lit(0)).alias("failed"))
    counts = counts.crossJoin(valid.select("id").distinct().agg(F.count(F.lit(1)).alias("succeeded")))
    return new, counts.select("succeeded", "failed")


def delete(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted count). Deleted = ids present in the
    table (semi join), so unknown ids do not count."""
    ids = ids.select("id").distinct()
    remaining = table.join(ids, "id", "left_anti")
    deleted = table.join(ids, "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return remaining, deleted


def stats(table: DataFrame, name: str = "search") -> DataFrame:
    """Document count and logical bytes (UTF-8 bytes of the text fields
    plus 4 bytes per vector element; not on-disk bytes)."""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("id", "content", "title", "source", "category")),
               F.lit(0))
    vec = F.coalesce(F.size("content_vector"), F.lit(0))
    vec = F.when(vec < 0, 0).otherwise(vec) * 4
    return table.agg(F.count(F.lit(1)).alias("document_count"),
                     F.coalesce(F.sum(text + vec), F.lit(0)).cast("long").alias("storage_size_bytes")) \
        .withColumn("index_name", F.lit(name))


def index_rows(kind: str, doc_id: Column, ordinal: Column, content: Column, source: Column,
               title: Column | None = None) -> list[Column]:
    """S7 projection of one kind of extraction output onto the index schema
    with a deterministic id doc_id#kind#ordinal."""
    return [F.concat(doc_id.cast("string"), F.lit("#" + kind + "#"), ordinal.cast("string")).alias("id"),
            content.alias("content"), (title if title is not None else F.lit(None).cast("string")).alias("title"),
            source.alias("source"), F.lit(kind).alias("category")]
