"""Files in and out: JSON lines, CSV with positional ids, JDBC, nested JSON and the vector table."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.records import last_wins


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header, quoted newlines, doubled quotes."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """The id goes with the row, so that a later read finds it."""
    df.write.mode("append").options(header=True, quote='"', escape='"').csv(path)


def write_nested_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def held(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once and its size is known. llm.common.clean_scratch() deletes it."""
    path = f"{shared_folder(df.sparkSession)}/tessera/{uuid.uuid4().hex[:12]}-{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def whole_parts(spark: SparkSession, path: str, prefixes: tuple[str, ...]) -> list[tuple[int, str]]:
    """(number, name) of the parts of a folder, named like prefix5, that were written to their end."""
    fs, at = folder(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(x.split("=")[1]), x) for x in names if x.startswith(prefixes) and fs.exists(new(at, f"{x}/_SUCCESS")))


class VectorTable:
    """(id, values, metadata, ...) as a log in one folder: a base and the deltas after it, each a Parquet table.

    An upsert writes one delta, so its cost follows the rows it brings; every `every` deltas the log is merged into a new base. Only
    parts that were written to their end count, so readers never see half an upsert, and a table opens again where it was left.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", seq: str = "seq", every: int = 8) -> None:
        self.spark, self.path, self.key, self.seq, self.every = spark, path.rstrip("/"), key, seq, every

    def _parts(self) -> list[tuple[int, str]]:
        """(number, name) of the whole parts, from the last base on."""
        parts = whole_parts(self.spark, self.path, ("base=", "delta="))
        first = max((i for i, (_, name) in enumerate(parts) if name.startswith("base=")), default=0)
        return parts[first:]

    def create(self, dimension: int, metric: str = "cosine", column: str = "values") -> None:
        """Fixes length and metric of the vectors; nothing happens if they are fixed alike, and a ValueError is raised if otherwise."""
        want = {"dimension": dimension, "metric": metric, "column": column}
        if metric != "cosine":
            raise ValueError(f"unknown metric: {metric}")
        if (self._kind() or want) != want:
            raise ValueError(f"the table holds {self._kind()}")
        write_document(self.spark, want, f"{self.path}/kind")

    def _kind(self) -> dict:
        return read_document(self.spark, f"{self.path}/kind", required=False)

    def exists(self) -> bool:
        return bool(self._parts())

    def read(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            raise ValueError("the table is empty")
        tables = [self.spark.read.parquet(f"{self.path}/{name}") for _, name in parts]
        if len(tables) == 1:
            return tables[0]
        rows = tables[0].withColumn("_part", F.lit(0))
        for n, t in enumerate(tables[1:], 1):
            rows = rows.unionByName(t.withColumn("_part", F.lit(n)), allowMissingColumns=True)
        return last_wins(rows, self.key, self.seq, "_part").drop("_part")

    def clear(self) -> None:
        """Deletes all rows; nothing happens if there is no table."""
        fs, path = folder(self.spark, self.path)
        fs.delete(path, True)

    def upsert(self, rows: DataFrame) -> None:
        """The row of the highest seq wins, at a tie the later upsert's; rows with a null key are rejected, and so is a vector of another length than create() fixed."""
        kind = self._kind()
        if kind and kind["column"] in rows.columns:
            fits = F.col(kind["column"]).isNull() | (F.size(kind["column"]) == kind["dimension"])
            rows = rows.withColumn(kind["column"], F.when(fits, F.col(kind["column"])).otherwise(F.raise_error(F.lit(f"vectors must have {kind['dimension']} components"))))
        parts = self._parts()
        number = parts[-1][0] + 1 if parts else 1
        last_wins(rows.filter(F.col(self.key).isNotNull()), self.key, self.seq).write.mode("overwrite").parquet(f"{self.path}/delta={number:09d}")
        if len(parts) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Merges the log into a new base. Parts before the base stay for readers that are under way; prune() deletes them."""
        parts = self._parts()
        if len(parts) > 1:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base={parts[-1][0] + 1:09d}")

    def prune(self) -> None:
        fs, path = folder(self.spark, self.path)
        kept = {"kind", *(name for _, name in self._parts())}
        for x in fs.listStatus(path) if len(kept) > 1 else []:
            if x.getPath().getName() not in kept:
                fs.delete(x.getPath(), True)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One nested JSON document, as a text file in a folder."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, required: bool = True) -> dict:
    """The document; {} if there is none and none is required."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        if required:
            raise FileNotFoundError(path)
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_csv_or(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """The CSV table at path, as text; the fallback if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return read_csv(spark, path) if there else fallback
