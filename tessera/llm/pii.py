"""PII [native]: candidate gradient boosting over DataFrame functions only.

Four exact patterns give the base spans (leftmost, not overlapping, failing matches dropped). Four high-recall generators propose
further spans, which may overlap each other and the base: spelled-out addresses, IPv6, card numbers with other separators, phone
numbers without a plus. Boosted trees score a proposal by its format (length, digits, separators, check digit) and its context
(words before it, neighbouring characters); a calibrated threshold selects. Base spans always stay; an added span may not overlap
a base span or a better added one. The trees are fitted in numpy on the driver, on a few thousand labelled texts made from a seed,
whose features come from the very expressions that score documents; they then become CASE expressions, so scoring is one
projection over the scan without any shuffle.

Positions come from the lengths of the pieces between matches, summed in chunks, so a text with many matches costs little
more than linear time. Patterns start only where a run starts and repeat possessively: no text makes them backtrack or recurse.

Defined results. A null or empty text has no spans. Every row gives one row, also for repeated or null ids.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The exact patterns, as they must match. A start inside a run fails like one at its head, so it isn't tried (\G: after a match).
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
CANDIDATES = (
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[a-z0-9-]{2,64}+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]{2,64}+)++",
    r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){3,7}+",
    r"(?<![0-9])[0-9]{4}(?:[./_\x20-][0-9]{4}){2}[./_\x20-][0-9]{1,7}+",
    r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|0[0-9]{2,4}[\x20/-]|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{3,5}+",
)
# All-zero parts are whole without what follows; zeros are never given back, so long runs cost one pass.
OCTET = r"(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
HINT = r"(?i)(?:tel|phone|call|mobile|fax|mail|contact|reach|write|card|visa|pay|account|ip|host|server|address|from|t\.)[\x20:.=a-z]{0,10}$"
AGAINST = r"(?i)(?:order|invoice|version|ver|isbn|serial|ref|part|article|page|date|time|price|total|no\.|nr\.|#|id)[\x20:.=a-z]{0,6}$"
FEATURES = ("kind", "length", "digits", "others", "luhn", "hint", "against", "alnum_before", "alnum_after", "marks", "zero")


def running(values: Column) -> Column:
    """Running sums of a short array."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("o"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["o"], F.array(a["s"] + x)).alias("o")), lambda a: a["o"])


def with_matches(df: DataFrame, text: str, pattern: str, needs: Column, name: str) -> DataFrame:
    """df with name: array of (m, s, before, after): each match, where it starts (code points) and the text around it."""
    c = lambda x: f"_{name}_{x}"
    none = F.array().cast("array<string>")
    df = df.withColumn(c("m"), F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(c("m")) > 0
    df = df.withColumn(c("p"), F.when(some, F.split(text, pattern, -1)).otherwise(none))
    # Each start lies past the one before by that match and the piece between. Columns read twice stay columns.
    steps = F.slice(F.zip_with(F.col(c("p")), F.concat(F.array(F.lit("")), F.col(c("m"))), lambda p, m: (F.length(p) + F.length(m)).cast("long")), F.lit(1), F.size(c("m")))
    df = df.withColumn(c("d"), F.when(some, steps).otherwise(F.array().cast("array<long>")))
    chunk = 64
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(c("d")) - 1)).cast("int"), F.lit(chunk)), lambda i: F.slice(F.col(c("d")), i + 1, F.lit(chunk)))
    df = df.withColumn(c("c"), chunks)
    df = df.withColumn(c("r"), F.transform(c("c"), running))
    total = running(F.transform(c("c"), lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)))
    df = df.withColumn(c("t"), F.concat(F.array(F.lit(0).cast("long")), total))
    df = df.withColumn(c("s"), F.flatten(F.zip_with(F.col(c("r")), F.col(c("t")), lambda r, t: F.transform(F.coalesce(r, F.array().cast("array<long>")), lambda x: x + t))))
    around = F.arrays_zip(F.col(c("m")).alias("m"), F.col(c("s")).alias("s"), F.transform(c("p"), lambda p: F.right(p, F.lit(24))).alias("b"), F.slice(F.transform(c("p"), lambda p: F.left(p, F.lit(8))), F.lit(2), F.greatest(F.lit(0), F.size(c("p")) - 1)).alias("a"))
    fields = F.transform(around, lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), x["b"].alias("before"), x["a"].alias("after")))
    return df.withColumn(name, F.filter(fields, lambda x: x["m"].isNotNull())).drop(*(c(x) for x in "mpdcrts"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of at most 19 digits passes the check."""
    value = lambda i: F.substring(F.reverse(d), i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "card":
        n = F.length(digits(m))
        return F.when((n >= 12) & (n <= 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def features(k: int, x: Column) -> Column:
    m, flag = x["m"], lambda c: F.coalesce(c, F.lit(False)).cast("double")
    n = F.length(digits(m))
    values = (F.lit(float(k)), F.length(m), n, F.length(m) - n, flag(F.when((n >= 12) & (n <= 19), luhn(digits(m)))), flag(x["before"].rlike(HINT)), flag(x["before"].rlike(AGAINST)), flag(x["before"].rlike("[A-Za-z0-9]$")), flag(x["after"].rlike("^[A-Za-z0-9]")), F.length(F.regexp_replace(m, r"[^()\[\]:/_]", "")), flag(m.rlike("^[0(]")))
    return F.struct(*(v.cast("double").alias(f) for v, f in zip(values, FEATURES)))


def placed(k: int, x: Column) -> list[Column]:
    return [x["s"].alias("start"), F.lit(k).alias("kind"), (x["s"] + F.length(x["m"])).alias("end")]


def spans_of(k: int) -> Column:
    return F.transform(F.filter(f"_b{k}", lambda x: valid(KINDS[k], x["m"])), lambda x: F.struct(*placed(k, x)))


def proposals_of(k: int) -> Column:
    return F.transform(f"_c{k}", lambda x: F.struct(*placed(k, x), features(k, x).alias("f")))


def count_of(k: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")


@dataclass
class Boosted:
    """Trees as (feature, cut, left, right) with numbers as leaves; the threshold is on the calibrated probability."""

    trees: list
    bias: float
    slope: float
    shift: float
    threshold: float

    def margin(self, x: Column) -> Column:
        def walk(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(x[FEATURES[t[0]]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        out = F.lit(self.bias)
        for t in self.trees:
            out = out + walk(t)
        return out

    def probability(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-(self.slope * self.margin(x) + self.shift)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, precision: float = 0.97) -> Boosted:
    """Gradient boosting with the logistic loss; every fourth row calibrates the probability and the threshold."""
    held = np.arange(len(x)) % 4 == 3
    a, b = x[~held], y[~held]
    bias = float(np.log((b.mean() + 1e-3) / (1 - b.mean() + 1e-3)))
    f, trees = np.full(len(a), bias), []

    def tree(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        leaf = round(float(rate * g[rows].sum() / (h[rows].sum() + 1)), 6)
        best, gain = None, 1e-6
        if level:
            for j in range(a.shape[1]):
                v = a[rows, j]
                for cut in np.unique(v)[:-1]:
                    left = v <= cut
                    s = [rows[left], rows[~left]]
                    won = sum(g[r].sum() ** 2 / (h[r].sum() + 1) for r in s) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if won > gain:
                        best, gain = (j, float(cut), s), won
        if best is None:
            return leaf
        j, cut, s = best
        return (j, cut, tree(s[0], g, h, level - 1), tree(s[1], g, h, level - 1))

    def value(t, row: np.ndarray) -> float:
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(tree(np.arange(len(a)), b - p, p * (1 - p), depth))
        f += np.array([value(trees[-1], r) for r in a])
    z = bias + np.array([sum(value(t, r) for t in trees) for r in x[held]])
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        slope, shift = slope + 0.05 * float(((y[held] - p) * z).mean()), shift + 0.2 * float((y[held] - p).mean())
    p = 1 / (1 + np.exp(-(slope * z + shift)))
    cuts = [t for t in sorted(set(np.floor(p * 1e4) / 1e4)) if y[held][p >= t].mean() >= precision]
    return Boosted(trees, bias, slope, shift, float(max(0.5, cuts[0] if cuts else 0.99)))


def labelled_texts(n: int = 1600, seed: int = 11) -> list[dict]:
    """Short texts with one proposal each, personal (1) or of the same look but not personal (0)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda lo=3, hi=8: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(lo, hi)))
    hexed = lambda: "".join(r.choice("0123456789abcdef") for _ in range(4))

    def card() -> str:
        body = "4" + d(14)
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(body))
        return body + str(-total % 10)

    yes = [
        (lambda: f"{w()}.{w()} [at] {w()} [dot] com", ("mail me:", "contact", "write to", "")),
        (lambda: f"{w()} (at) {w()}.org", ("reach", "mail", "")),
        (lambda: f"{w()}{d(2)} at {w()} dot net", ("my mail is", "contact", "write")),
        (lambda: ":".join(hexed() for _ in range(8)), ("host", "ip", "from", "server", "")),
        (lambda: (lambda c, s: s.join((c[:4], c[4:8], c[8:12], c[12:])))(card(), r.choice("./_")), ("card", "visa", "pay with", "")),
        (lambda: f"({d(3)}) {d(3)}-{d(4)}", ("call", "tel", "phone:", "")),
        (lambda: f"{d(3)}-{d(3)}-{d(4)}", ("call", "mobile", "fax:", "tel.")),
        (lambda: f"0{d(3)}/{d(3)} {d(4)}", ("tel.", "phone", "contact", "")),
    ]
    no = [
        (lambda: f"{w()} at {w()} dot {w()}", ("we looked", "the line", "pointing", "order", "he is")),
        (lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", ("time", "at", "date", "")),
        (lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(4)}", ("serial", "part", "ref", "version", "")),
        (lambda: f"{d(4)}_{d(4)}_{d(4)}_{d(2)}", ("article", "order", "id")),
        (lambda: f"{d(3)}.{d(3)}.{d(4)}", ("price", "total", "version", "ref", "")),
        (lambda: f"{d(3)}-{d(3)}-{d(5)}", ("isbn", "part", "order no.", "invoice")),
        (lambda: f"{d(3)} {d(3)} {d(3)}", ("total", "page", "price", "")),
    ]
    out = []
    for _ in range(n):
        label = r.random() < 0.5
        make, before = r.choice(yes if label else no)
        out.append({"text": f"{w()} {w()} {r.choice(before)} {make()} {w()} {w()}.", "y": int(label)})
    return out


class PIIFinder:
    def __init__(self, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.id, self.text = id_col, text_col

    def proposals(self, df: DataFrame) -> DataFrame:
        """df(text) with _base (sorted spans) and _more (proposals with their features)."""
        text = F.col("text")
        digit = text.rlike("[0-9]")
        needs = {"email": text.contains("@"), "ip": digit & text.contains("."), "card": digit, "phone": text.contains("+")}
        also = {"email": text.rlike(r"(?i)[\x20(\[]at[\x20)\]]"), "ip": digit & text.contains(":"), "card": digit, "phone": digit}
        base, more = [], []
        for k, kind in enumerate(KINDS):
            df = with_matches(df, "text", BASE[k], needs[kind], f"_b{k}")
            df = with_matches(df, "text", CANDIDATES[k], also[kind], f"_c{k}")
            base.append(spans_of(k))
            more.append(proposals_of(k))
        return df.withColumns({"_base": F.array_sort(F.concat(*base)), "_more": F.concat(*more)}).drop(*(f"_{x}{k}" for x in "bc" for k in range(4)))

    def fit(self, spark: SparkSession) -> Boosted:
        texts = F.from_json(F.lit(json.dumps(labelled_texts())), "array<struct<text:string,y:int>>")
        rows = self.proposals(spark.range(1).select(F.explode(texts).alias("r")).select("r.text", "r.y"))
        got = rows.select("y", F.explode("_more.f").alias("f")).select("y", "f.*").collect()
        got.sort(key=tuple)
        order = np.random.default_rng(5).permutation(len(got))
        data = np.array([tuple(r) for r in got], float)[order]
        return boost(data[:, 1:], data[:, 0])

    def __call__(self, docs: DataFrame, model: Boosted | None = None) -> DataFrame:
        """(id, text, base, spans): arrays of (start, kind number, end) in code points, end exclusive, by start then kind."""
        model = model or self.fit(docs.sparkSession)
        df = self.proposals(docs.select(F.col(self.id).alias("id"), F.coalesce(F.col(self.text).cast("string"), F.lit("")).alias("text")))
        scored = F.transform("_more", lambda x: F.struct((-model.probability(x["f"])).alias("rank"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
        meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
        df = df.withColumn("_scored", F.array_sort(F.filter(scored, lambda x: x["rank"] <= -model.threshold)))
        free = F.filter("_scored", lambda x: ~F.exists("_base", lambda y: meets(x, y)))
        df = df.withColumn("_free", F.when(F.size("_scored") > 0, free).otherwise(F.col("_scored")))
        # Proposals of one kind don't overlap, so each meets few others: a span stays if none that ranks before it meets it.
        best = F.filter("_free", lambda x: ~F.exists("_free", lambda y: meets(x, y) & (F.struct(y["rank"], y["start"], y["kind"]) < F.struct(x["rank"], x["start"], x["kind"]))))
        df = df.withColumn("_added", F.when(F.size("_free") > 1, best).otherwise(F.col("_free")))
        added = F.transform("_added", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
        return df.select("id", "text", F.col("_base").alias("base"), F.array_sort(F.concat("_base", added)).alias("spans"))

    def redact(self, found: DataFrame) -> DataFrame:
        """found (as __call__ returns it) with redacted: each span, overlapping ones as one, replaced by its kind in brackets."""
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
        name = lambda k: F.element_at(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), k + 1)
        step = lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), name(x["kind"])).alias("out")))
        return found.withColumn("redacted", F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))))


def written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PIIFinder()(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), *map(count_of, range(4)), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
