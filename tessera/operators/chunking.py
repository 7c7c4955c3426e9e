"""Fixed and recursive chunks of a text, as one expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, sentences, strip


def fixed_chunks(text: Column, size: int = 700, overlap: int = 120) -> Column:
    """Windows of `size` characters every size - overlap, stripped; blank ones go. A blank text has none.

    The text is stripped once and cut once into pieces of one step each; a window is the pieces from its own on, so the work grows with the text.
    """
    step = max(1, size - overlap)
    pieces = F.regexp_extract_all(strip(F.coalesce(text, F.lit(""))), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    window = lambda p, i: strip(F.substring(F.array_join(F.slice(p, i + 1, F.lit(-(-size // step))), ""), 1, size))
    return F.filter(let(pieces, lambda p: F.transform(p, lambda _, i: window(p, i))), lambda c: c != "")


def recursive_chunks(text: Column, size: int = 700, inner_overlap: int = 80) -> Column:
    """Paragraphs, cut into sentences and those into windows where over size, packed greedily with single blanks up to size."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), strip), lambda p: p != "")
    cut = lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(fixed_chunks(s, size, inner_overlap))
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.flatten(F.transform(sentences(p), cut)))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def pack(acc: Column, u: Column) -> Column:
        joined = F.when(acc["cur"] == "", u).otherwise(F.concat(acc["cur"], F.lit(" "), u))
        fits = F.length(joined) <= size
        done = F.when(fits | (acc["cur"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
        return F.struct(done.alias("out"), F.when(fits, joined).otherwise(u).alias("cur"))

    return F.aggregate(units, start, pack, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def chunk_dataset(docs: DataFrame, method: str, ident: str = "id", text: str = "text") -> DataFrame:
    """(id <source>_<n from 1>, source_id, chunk_no, chunking, text)."""
    if method not in ("fixed", "recursive"):
        raise ValueError(f"unknown chunking method: {method}")
    chunks = fixed_chunks(F.col(text)) if method == "fixed" else recursive_chunks(F.col(text))
    out = docs.select(F.col(ident).alias("source_id"), F.posexplode(chunks).alias("pos", "text"))
    n = (F.col("pos") + 1).cast("long")
    return out.select(F.concat_ws("_", F.col("source_id").cast("string"), n.cast("string")).alias("id"), "source_id", n.alias("chunk_no"), F.lit(method).alias("chunking"), "text")
