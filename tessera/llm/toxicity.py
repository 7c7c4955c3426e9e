"""Toxicity by compression distance: two zstandard dictionaries, trained by the library on ordinary and on toxic windows.

A text is cut into windows of `window` words (lower case, letters only), each starting `step` words after the one before. A window is
compressed with the ordinary dictionary alone and with the toxic one beside it; its gain is how many bytes shorter the second is. Random
differences between two dictionaries of ordinary matter would drown what toxic words save, so the second holds the ordinary one too and
only what toxic text adds can shorten it.

Labels mark whole texts, and most windows of a toxic text are ordinary. So the toxic windows are purified first: the windows of toxic texts
that no ordinary text of the sample has are halved by text, a dictionary is trained on each half, and of the other half those windows stay
whose gain exceeds what one in a hundred held-back ordinary windows reaches. The toxic dictionary is trained on these. The thresholds on the
gain are quantiles over held-back ordinary windows. Document features are the number and share of windows over each threshold, the largest
and the mean gain; logistic regression on held-back texts calibrates them.

Learning uses a bounded sample: per_label rows of each label (those with the smallest hash of id and text, equal texts once) and at most
max_windows windows of a kind (smallest hash). A third of its texts, by their hash, trains no dictionary and calibrates. Scoring covers
whole texts, in the task that reads them; nothing is shuffled there.

Defined results. A null or empty text has no window and gets the score of no gain at all. Without both labels in the sample every score is
the share of toxic labels (0 without labels). An id with both labels counts under both. Rows with null labels or ids teach nothing. Every row
gives one row, also for repeated or null ids; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, frugal, materialize

#: Letters in lower case; the other ASCII characters are blanks.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Quantiles of the gains of ordinary windows that make the thresholds.
QUANTILES = (0.9, 0.98, 0.995, 0.999, 0.9998)


def windows_of(text: bytes | None, window: int, step: int) -> list[bytes]:
    """Windows of `window` words, every `step` words; the last may be shorter. No words, no windows."""
    words = text.translate(LETTERS).split() if text else []
    starts = range(0, max(1, len(words) - window + step), step) if words else ()
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in starts]


def train(windows: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes, trained by the library on segments of twelve bytes. Windows that fit into it whole are it themselves."""
    import zstandard as z

    if sum(map(len, windows)) <= size:
        return b"".join(windows) or b" "
    return z.train_dictionary(size, windows, k=12, d=6).as_bytes()


def compressed_length(content: bytes):
    """A function from a window to its compressed length with this dictionary."""
    import zstandard as z

    params = z.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=64, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    compress = z.ZstdCompressor(dict_data=d, compression_params=params).compress
    return lambda w: len(compress(w))


class Gain:
    """How many bytes the toxic dictionary saves on a window."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.both = compressed_length(ordinary), compressed_length(toxic + ordinary)

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        plain, both = self.plain, self.both
        return np.fromiter((plain(w) - both(w) for w in windows), np.int64, len(windows))


def features(gains: np.ndarray, cuts: list[int]) -> np.ndarray:
    n = [int((gains >= c).sum()) for c in cuts]
    size = max(1, len(gains))
    return np.array([*np.log1p(n), *(x / size for x in n), gains.max(initial=0) / 10, gains.sum() / size])


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    cuts: list[int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-((x - self.mean) / self.scale @ self.weights + self.bias)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge-regularised logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def purify(ordinary: bytes, seen: list[bytes], halves: list[list[bytes]], size: int, quantile: float = 0.99) -> list[bytes]:
    """The windows of either half that a dictionary of the other half shortens more than it does all but a few held-back ordinary windows (seen)."""
    out = []
    for own, other in (halves, halves[::-1]):
        gain = Gain(ordinary, train(other, size))
        limit = max(0.0, float(np.quantile(gain(seen), quantile))) if seen else 0.0
        g = gain(own)
        out.extend(own[i] for i in np.flatnonzero(g > limit).tolist())
    return out


class Toxicity:
    def __init__(self, per_label: int = 2500, max_windows: int = 80_000, window: int = 24, step: int = 20, ordinary_size: int = 112_640, toxic_size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.per_label, self.max_windows, self.window, self.step, self.ordinary_size, self.toxic_size, self.id, self.text = per_label, max_windows, window, step, ordinary_size, toxic_size, id_col, text_col

    def sample(self, docs: DataFrame, labels: DataFrame, label_col: str) -> tuple[DataFrame, dict[int, int]]:
        """(y, fold 0 to 5, text) of the sample, a written table; and the count of each label."""
        marked = labels.select(F.col(self.id).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
        counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
        rows = docs.select(F.col(self.id).alias("id"), F.col(self.text).cast("string").alias("text")).filter("text <> ''")
        keys = rows.select("id", F.xxhash64("text").alias("th")).join(marked, "id").select("y", "id", "th").distinct()
        picked = None
        for y in (0, 1):  # a top-k of keys for each label, so that repeated ids can't enlarge the sample
            part = keys.filter(F.col("y") == y).orderBy(F.xxhash64("id", "th"), "id", "th").limit(self.per_label)
            picked = part if picked is None else picked.unionAll(part)
        rows = rows.withColumn("th", F.xxhash64("text")).join(F.broadcast(picked), ["id", "th"]).dropDuplicates(["y", "th"])
        return materialize(rows.select("y", F.pmod(F.xxhash64("th"), F.lit(6)).cast("int").alias("fold"), "text"), "sample"), counts

    def windows(self, sample: DataFrame) -> tuple[list[bytes], list[bytes], list[list[bytes]]]:
        """Windows of ordinary texts that train, of ordinary texts that are held back, and of toxic texts alone, in halves."""
        window, step = self.window, self.step

        def run(batches):
            for b in batches:
                own = [sorted(set(windows_of(t.as_py(), window, step))) for t in b.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.binary()))], ["y", "fold", "w"])

        each = sample.mapInArrow(frugal(run), "y int, fold int, w array<binary>").select("y", "fold", F.explode("w").alias("w"))
        each = each.groupBy("w").agg(F.min("y").alias("y"), F.min("fold").alias("fold"), F.max("fold").alias("last"))
        each = materialize(each, "windows")

        def some(rows: DataFrame) -> list[bytes]:
            got = rows.select("w").orderBy(F.xxhash64("w"), "w").limit(self.max_windows).toArrow().column(0).to_pylist()
            return sorted(got)

        held, fits = F.col("last") < 2, F.col("fold") >= 2
        return some(each.filter((F.col("y") == 0) & fits)), some(each.filter((F.col("y") == 0) & held)), [some(each.filter((F.col("y") == 1) & (F.col("fold") >= k) & (F.col("last") < k + 2))) for k in (2, 4)]

    def learn(self, docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> ToxicityModel:
        sample, counts = self.sample(docs, labels, label_col)
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        if {r["y"] for r in sample.select("y").distinct().collect()} != {0, 1}:
            flat = np.zeros(2 * len(QUANTILES) + 2)
            return ToxicityModel(b" ", b" ", [1] * len(QUANTILES), flat, flat + 1, flat, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        fits, seen, halves = self.windows(sample)
        ordinary = train(fits, self.ordinary_size)
        kept = purify(ordinary, seen, halves, self.toxic_size)
        toxic = train(kept, self.toxic_size)
        gains = Gain(ordinary, toxic)(seen) if seen else np.zeros(1, np.int64)
        cuts = [max(1, int(np.quantile(gains, q)) + 1) for q in QUANTILES]

        window, step = self.window, self.step

        def run(batches):
            gain = Gain(ordinary, toxic)
            for b in batches:
                x = [features(gain(windows_of(t.as_py(), window, step)), cuts) for t in b.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])

        got = sample.mapInArrow(frugal(run), "y int, fold int, x array<double>").toArrow()
        y, x = got.column(0).to_numpy().astype(float), np.array(got.column(2).to_pylist())
        held = got.column(1).to_numpy() < 2
        if len(set(y[held])) == 2:  # a handful of texts may leave a label without a held-back one
            y, x = y[held], x[held]
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        w, bias = logistic((x - mean) / scale, y)
        good = y.mean()
        bias += np.log(max(share, 1e-9) / max(1 - share, 1e-9)) - np.log(good / (1 - good))  # the sample holds other shares than the labels do
        return ToxicityModel(ordinary, toxic, cuts, mean, scale, w, float(bias))

    def score(self, docs: DataFrame, model: ToxicityModel) -> DataFrame:
        """(id, score) of every row."""
        window, step = self.window, self.step

        def run(batches):
            gain = Gain(model.ordinary, model.toxic)
            for b in batches:
                x = np.array([features(gain(windows_of(t.as_py(), window, step)), model.cuts) for t in b.column(1).cast(pa.binary())]).reshape(b.num_rows, len(model.mean))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(x))], ["id", "score"])

        rows = docs.select(F.col(self.id).alias("id"), F.col(self.text).cast("string").alias("text"))
        return rows.mapInArrow(frugal(run), f"id {docs.schema[self.id].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(F.col("doc_id"), 4) != 2)
    op = Toxicity()
    out = op.score(docs, op.learn(docs, labels))
    held: Column = F.coalesce(crc_mod(F.col("id"), 4) == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
