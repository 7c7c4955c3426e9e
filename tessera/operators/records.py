"""Ids, samples, nesting, last-wins upserts and checks of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positional_ids(df: DataFrame, order: str, pattern: str = "JOB_%05d") -> DataFrame:
    """df with ident: its 0-based position, padded. Numbers come from the counts of ranges of the order, not from one sorted task."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(width, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = parts.withColumn("_at", at).join(before, "_part")
    return out.withColumn("ident", F.format_string(pattern, F.col("_before") + F.col("_at") - 1)).drop("_part", "_at", "_before")


def next_id(ids: Column, prefix: str) -> Column:
    """An aggregate: one more than the largest number after the prefix; unreadable ones are skipped."""
    n = F.when(ids.startswith(prefix), F.try_element_at(F.split(ids, "_"), F.lit(2)).try_cast("int"))
    return F.format_string(prefix + "%04d", F.coalesce(F.max(n), F.lit(0)) + 1)


def stratified_sample(df: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """The first max(1, n div categories) of each category in order, categories by name, cut to n."""
    known = df.withColumn("_cat", F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("Other")))
    count = known.agg(F.count_distinct("_cat").alias("_k"))
    numbered = known.withColumn("_at", F.row_number().over(Window.partitionBy("_cat").orderBy(order))).filter(F.col("_at") <= n)
    kept = numbered.crossJoin(count).filter(F.col("_at") <= F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_k"))))
    return kept.orderBy("_cat", "_at").limit(n).drop("_k")


def nest(parent: DataFrame, child: DataFrame, key: str, fk: str, name: str, order: tuple[Column, ...], fields: tuple[str, ...]) -> DataFrame:
    """parent with an array of its children's fields, ordered by the given columns; empty without children."""
    rows = child.groupBy(fk).agg(F.array_sort(F.collect_list(F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *fields))).alias(name))
    rows = rows.select(F.col(fk).alias("_fk"), F.transform(name, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))
    kind = rows.schema[name].dataType
    return parent.join(rows, parent[key] == rows["_fk"], "left").drop("_fk").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def nest_first(parent: DataFrame, child: DataFrame, key: str, fk: str, name: str, order: tuple[Column, ...], fields: tuple[str, ...]) -> DataFrame:
    """parent with its first child as a struct, null without one."""
    first = child.groupBy(fk).agg(F.min(F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *fields)).alias(name))
    first = first.select(F.col(fk).alias("_fk"), F.struct(*(F.col(name)[f].alias(f) for f in fields)).alias(name))
    return parent.join(first, parent[key] == first["_fk"], "left").drop("_fk")


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: a grouped maximum, combined before the shuffle, so a hot key costs one row a task."""
    row = F.struct(*order, F.struct("*").alias("_row"))
    return df.groupBy(key).agg(F.max(row).alias("_last")).select("_last._row.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """base with changes applied: per key the row of the highest seq; a changed key beats its base row."""
    both = base.withColumn("_seq", F.lit(-1).cast("long")).unionByName(changes.withColumn("_seq", F.col(seq).cast("long")), allowMissingColumns=True)
    return last_wins(both, key, "_seq").drop("_seq")


def verify(df: DataFrame, category: str) -> DataFrame:
    """One row: count, number and sorted list of distinct categories, ok iff there are rows."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(category).alias("n_categories"), F.array_join(F.sort_array(F.collect_set(category)), ",").alias("categories"), (F.count("*") > 0).alias("ok"))


def valid_rows(df: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose required fields are not blank, the others)."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return df.filter(ok), df.filter(~ok)
