"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

The content view is what the text is made of: the shares of its byte values, of distinct, repeated, short and capital words. The metadata
view is what is known about the page and its layout: source and language (hashed), size, number, length and repetition of lines.
Both start from a bounded labelled sample. In each round either classifier scores every row without a label and hands the `batch` rows it
is surest of, in the proportion of the labels, to the other as pseudo-labels: a distributed top-k over the whole table. Labelled rows that
neither was fitted on then calibrate the two views and weigh them into one score. All documents are scored, each in the task that reads it;
only keys and the two views' probabilities are shuffled.

Defined results. A null or empty text has empty content and layout. Null sources and languages are values of their own. Without both
labels in the sample every score is the share of good labels (0.5 without labels). A labelled id that repeats counts with each of its rows,
equal rows once. Every row gives one row, also for repeated or null ids; further columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, frugal, materialize
from tessera.llm.toxicity import logistic

SOURCE_SLOTS, LANG_SLOTS = 32, 16
CONTENT = 256 + 5
META = 6 + SOURCE_SLOTS + LANG_SLOTS


def content(text: bytes) -> np.ndarray:
    x = np.zeros(CONTENT)
    if text:
        raw = np.frombuffer(text, np.uint8)
        x[:256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
        words = text.split()
        n = max(1, len(words))
        repeated = sum(a == b for a, b in zip(words, words[1:]))
        x[256:] = len(set(words)) / n, repeated / n, sum(len(w) < 4 for w in words) / n, sum(w.isupper() for w in words) / n, len(raw) / n / 20
    return x


def metadata(text: bytes, source: str | None, lang: str | None) -> np.ndarray:
    x = np.zeros(META)
    lines = [s.strip() for s in text.split(b"\n")]
    longest, n = max(map(len, lines)), len(lines)
    x[:6] = np.log1p(len(text)), np.log1p(n), np.log1p(len(text) / n), np.log1p(longest), 1 - len(set(lines)) / n, sum(not s for s in lines) / n
    x[6 + zlib.crc32(repr(source).encode()) % SOURCE_SLOTS] = 1
    x[6 + SOURCE_SLOTS + zlib.crc32(repr(lang).encode()) % LANG_SLOTS] = 1
    return x


def both_views(text: pa.Array, source: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.as_py() or b"" for t in text.cast(pa.binary())]
    meta = [metadata(t, s, g) for t, s, g in zip(texts, source.to_pylist(), lang.to_pylist())]
    return np.array([content(t) for t in texts]).reshape(len(texts), CONTENT), np.array(meta).reshape(len(texts), META)


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        return cls(mean, scale, *logistic((x - mean) / scale, y, ridge))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)


@dataclass
class QualityModel:
    views: tuple[View, View] | None
    weights: np.ndarray
    bias: float

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.column_stack([self.views[0].margin(a), self.views[1].margin(b)]) @ self.weights if self.views else np.zeros(len(a))
        return 1 / (1 + np.exp(-(z + self.bias)))


class QualityClassifier:
    def __init__(self, per_label: int = 2500, rounds: int = 3, batch: int = 400, sure: float = 0.95, ridge: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> None:
        self.per_label, self.rounds, self.batch, self.sure, self.ridge = per_label, rounds, batch, sure, ridge
        self.id, self.cols = id_col, (text_col, source_col, lang_col)

    def rows(self, docs: DataFrame) -> DataFrame:
        names = ("text", "source", "lang")
        rows = docs.select(F.col(self.id).alias("id"), *(F.col(c).cast("string").alias(n) for c, n in zip(self.cols, names)))
        return rows.select("id", F.xxhash64("text", "source", "lang").alias("th"), *names)

    def views(self, docs: DataFrame, picked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(y, content, metadata) of the rows whose (id, th) is in picked(y, id, th), a bounded table; rows with one key count once."""

        def run(batches):
            for b in batches:
                x = np.concatenate(both_views(*(b.column(k) for k in (3, 4, 5))), axis=1).astype(np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), CONTENT + META).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], ["y", "id", "th", "x"])

        kind = docs.schema[self.id].dataType.simpleString()
        rows = self.rows(docs).join(F.broadcast(picked), ["id", "th"]).dropDuplicates(["y", "id", "th"]).select("y", "id", "th", "text", "source", "lang")
        got = rows.mapInArrow(frugal(run), f"y int, id {kind}, th long, x array<float>").toArrow()
        order = np.argsort([zlib.crc32(repr(k).encode()) for k in zip(*(got.column(c).to_pylist() for c in range(3)))], kind="stable")
        x = np.array([v.values.to_numpy() for v in got.column(3)], float).reshape(got.num_rows, CONTENT + META)[order]
        return got.column(0).to_numpy()[order], x[:, :CONTENT], x[:, CONTENT:]

    def surest(self, docs: DataFrame, known: DataFrame, views: list[View], taken: set) -> list[list[tuple]]:
        """For each view and label (1, 0) the keys (id, th) of rows without a label that the view is surest of; any row can be one.

        known(id): the ids with a label. taken: keys of earlier rounds. Each list holds up to two batches, so that the caller can
        leave out what another list has.
        """

        def run(batches):
            for batch in batches:
                for b in (batch.slice(s, 512) for s in range(0, batch.num_rows, 512)):
                    p = [1 / (1 + np.exp(-v.margin(x))) for v, x in zip(views, both_views(*(b.column(k) for k in (2, 3, 4))))]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, p)], ["id", "th", "p0", "p1"])

        spark, kind = docs.sparkSession, docs.schema[self.id].dataType.simpleString()
        sure = " or ".join(f"p{k} >= {self.sure} or p{k} <= {1 - self.sure}" for k in (0, 1))
        scored = self.rows(docs).filter("id is not null").mapInArrow(frugal(run), f"id {kind}, th long, p0 double, p1 double").filter(sure).distinct()
        scored = materialize(scored.join(known, "id", "left_anti"), "scored")
        if taken:
            old = spark.createDataFrame(sorted(taken, key=repr), f"id {kind}, th long")
            scored = scored.join(F.broadcast(old), ["id", "th"], "left_anti")
        out = []
        for k in (0, 1):
            for order, ok in ((F.col(f"p{k}").desc(), F.col(f"p{k}") >= self.sure), (F.col(f"p{k}").asc(), F.col(f"p{k}") <= 1 - self.sure)):
                out.append([tuple(r) for r in scored.filter(ok).orderBy(order, F.xxhash64("id", "th"), "id", "th").limit(2 * self.batch).select("id", "th").collect()])
        return out

    def learn(self, docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality") -> QualityModel:
        """From a bounded sample of labelled rows (per_label of each label, smallest hash) and from all rows without a label."""
        spark, kind = docs.sparkSession, docs.schema[self.id].dataType.simpleString()
        marked = labels.filter(train).select(F.col(self.id).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
        counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        flat = QualityModel(None, np.zeros(2), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
        keys = self.rows(docs).select("id", "th").join(marked, "id").select("y", "id", "th").distinct()
        picked = None
        for y in (0, 1):
            part = keys.filter(F.col("y") == y).orderBy(F.xxhash64("id", "th"), "id", "th").limit(self.per_label)
            picked = part if picked is None else picked.unionAll(part)
        y, a, b = self.views(docs, picked)
        held = np.arange(len(y)) % 4 == 3  # every fourth row calibrates
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            return flat
        sets = [(a[~held], y[~held].astype(float)), (b[~held], y[~held].astype(float))]
        views = [View.fit(*s, self.ridge) for s in sets]
        known, taken = labels.select(F.col(self.id).alias("id")).filter("id is not null").distinct(), set()
        quotas = [max(1, int(self.batch * q)) for q in (share, 1 - share)] * 2
        for _ in range(self.rounds):
            chosen, new = [], set()
            for n, (found, quota) in enumerate(zip(self.surest(docs, known, views, taken), quotas)):
                own = [key for key in found if key not in new][:quota]
                new.update(own)
                chosen += [(n, *key) for key in own]
            if not chosen:
                break
            taken |= new
            n, xa, xb = self.views(docs, spark.createDataFrame(chosen, f"y int, id {kind}, th long"))
            for k, x in ((0, xb), (1, xa)):  # a view's choices teach the other one
                at = n // 2 == k
                sets[1 - k] = np.concatenate([sets[1 - k][0], x[at]]), np.append(sets[1 - k][1], 1.0 - n[at] % 2)
            views = [View.fit(*s, self.ridge) for s in sets]
        w, bias = logistic(np.column_stack([views[0].margin(a[held]), views[1].margin(b[held])]), y[held].astype(float))
        good = y[held].mean()
        bias += np.log(share / (1 - share)) - np.log(good / (1 - good))
        return QualityModel((views[0], views[1]), w, float(bias))

    def score(self, docs: DataFrame, model: QualityModel) -> DataFrame:
        """(id, score) of every row."""

        def run(batches):
            for batch in batches:
                for b in (batch.slice(s, 512) for s in range(0, batch.num_rows, 512)):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(*both_views(*(b.column(k) for k in (2, 3, 4)))))], ["id", "score"])

        return self.rows(docs).mapInArrow(frugal(run), f"id {docs.schema[self.id].dataType.simpleString()}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    op = QualityClassifier()
    model = op.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 4) != 2)
    out = op.score(docs, model)
    held = F.coalesce(crc_mod(F.col("id"), 4) == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
