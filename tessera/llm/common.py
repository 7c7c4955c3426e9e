"""Helpers shared by the training-data operators: scratch tables, safe column names, hashes and packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex[:12]}-{tag}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete every scratch table below the shared folder; call it once results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tessera")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, parts: int, *keys: str, sort: bool = False) -> DataFrame:
    """df as a written table bucketed by keys (and sorted by them), so that a join on them leaves it where it is. Its name is gone from the catalog at once."""
    spark, name = df.sparkSession, f"tessera_{tag}_{uuid.uuid4().hex[:16]}"
    writer = df.write.format("parquet").bucketBy(parts, *keys)
    (writer.sortBy(*keys) if sort else writer).option("path", scratch_path(spark, tag)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() has a fast path for plain ASCII; other text goes through translate()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def key128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, so that distinct keys do not meet even among 10^12 of them."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the split into training and held-out rows."""
    return F.crc32(c.cast("string").cast("binary")) % m


def others(docs: DataFrame, *names: str) -> Column:
    """The remaining columns as one struct, so that their names can't clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("_row")


def restore(df: DataFrame, docs: DataFrame, **values: Column) -> list[Column]:
    """The columns of docs in their order again: from the struct of others(), but values where given."""
    return [(values[c] if c in values else F.col("_row").getField(c)).alias(c) for c in docs.columns]


def fresh(name: str, docs: DataFrame) -> str:
    """name for a column that an operator adds to docs, with one underscore more for each time that docs has it already."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def is_plain_scan(df: DataFrame) -> bool:
    """True if df's partitions come straight from files, so that two reads of it see the same rows in the same tasks."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Relation" in plan and not any(x in plan for x in ("Join", "Aggregate", "Repartition", "Sort", "Window", "Python", "Arrow", "Limit", "Sample", "Union", "LogicalRDD"))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, tag: str, most: int = 200_000) -> DataFrame:
    """df as a written table, marked for broadcast only if it has at most `most` rows; otherwise the join stays a shuffle."""
    df = materialize(df, tag)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def frugal(run):
    """A mapInArrow function that gives its worker's free memory back at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
