"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of docs, whatever further ones it has. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import ByteBPE, digest, load_ranks
from tessera.llm.common import crc_mod, fresh, materialize, sized
from tessera.llm.decontam import Decontaminator
from tessera.llm.langid import LanguageID
from tessera.llm.line_dedup import LineDedup
from tessera.llm.simhash import SimHashDedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is rejected go: those without a letter (null and empty texts too) and those likelier of no language."""
    op = LanguageID()
    model = op.learn(docs, crc_mod(F.col("doc_id"), 5) != 0)
    out = op.predict(docs, model)
    return out.filter(~F.col(fresh("_rejected", docs))).select(*names(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text. A document without any line of its own stays, empty.

    Every row stays, also for repeated or null ids; a null text stays null, with its n_chars.
    """
    out = LineDedup()(docs).select(*names(docs))
    if "n_chars" not in docs.columns:
        return out
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the smallest id, among its rows the smallest xxhash64 of the text, among equal texts one row.

    Rows of a repeated id belong each to the group of their own text. Rows with a null id stay. Null and empty texts are one group.
    """
    rows = SimHashDedup().groups(docs).filter("id is not null").groupBy("g", "id", "th").agg(F.count("*").alias("n"))
    rows = materialize(rows, "rows")
    # Both sides of the join are written tables, so that adaptive execution splits a large group.
    first = materialize(rows.groupBy("g").agg(F.min(F.struct("id", "th")).alias("first")), "first")
    other = (F.col("id") != F.col("first.id")) | (F.col("th") != F.col("first.th"))
    marked = rows.join(first, "g").select("id", "th", "n", other.alias("other")).filter("other or n > 1")
    marked = materialize(marked, "marked")
    met = lambda keys: docs["doc_id"].cast("long").eqNullSafe(keys["id"]) & (F.xxhash64(docs["text"]) == keys["th"])
    keys = sized(marked.select("id", "th"), "keys")
    out = docs.join(keys, met(keys), "left_anti")
    twice = sized(marked.filter("not other").select("id", "th"), "twice")
    if not twice.head(1):
        return out
    # Rows with one id and one text: the one whose other columns are written first.
    row = F.struct(*(F.col(n) for n in names(docs)))
    again = docs.join(twice, met(twice), "left_semi").select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"), row.alias("row"))
    one = again.groupBy("i", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.unionByName(one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which at least a twentieth of the words lies in benchmark windows go, each judged by its own text. Null texts stay."""
    found = Decontaminator()(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select("id", "th").distinct()
    bad = sized(bad, "bad")
    met = docs["doc_id"].cast("long").eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"]) == bad["th"])
    return docs.join(bad, met, "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a null text counts as empty."""
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digest(ByteBPE(ranks, public_tokenizers.PATTERN)(docs))


def names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]

#: Language ID and near-dedup can't be expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
