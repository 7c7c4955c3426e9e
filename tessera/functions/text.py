"""Column expressions: missing values, tokens, sentences, term sets, prefixes. An empty string counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_present(*cs: Column, default: str = "") -> Column:
    return F.coalesce(*(present(c) for c in cs), F.lit(default))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")  # a run of blanks is tried once, at its head


def tokens(c: Column, cased: bool = False) -> Column:
    """The words between white space, none empty; lower-cased unless cased."""
    return F.filter(F.split(c if cased else F.lower(c), r"(?U)\s+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences that keep their final . ! or ?"""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def sentences_cut(c: Column) -> Column:
    """Sentences cut at . ! ? or the Arabic full stop, which go."""
    return F.filter(F.transform(F.split(c, "[۔.!?]"), strip), lambda x: x != "")


def term_set(c: Column, over: int = 0) -> Column:
    """The distinct lower-cased [a-zA-Z0-9_]+ terms of more than `over` characters."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-zA-Z0-9_]+)"), F.lit(1)))
    return F.filter(found, lambda x: F.length(x) > over) if over else found


def keywords(c: Column, n: int = 3) -> Column:
    """The first n words of over four characters that start with a letter, repeats kept."""
    return F.slice(F.filter(F.regexp_extract_all(c, F.lit("([a-zA-Z][a-zA-Z0-9_]+)"), F.lit(1)), lambda x: F.length(x) > 4), 1, n)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def split_list(c: Column, separator: str = ",") -> Column:
    """The non-blank pieces between separators, stripped."""
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def let(value: Column, use) -> Column:
    """use(value) with the value evaluated once, also where use reads it within a lambda."""
    return F.transform(F.array(value), use)[0]


def normalize(v: Column) -> Column:
    """A vector of unit length, in double precision; a zero vector stays zero."""
    unit = lambda d, norm: F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))
    return let(F.transform(v, lambda x: x.cast("double")), lambda d: let(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: unit(d, norm)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def hash_embedding(toks: Column, dim: int = 64) -> Column:
    """Token counts hashed by md5 into dim slots, at unit length. For short texts; retrieval.hash_vectors() counts long ones by grouping."""
    slot = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return let(F.transform(toks, slot), lambda slots: normalize(counts(slots)))
