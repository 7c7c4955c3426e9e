"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text's vector is the mean embedding of its byte 3- and 4-grams (A-Z lower-cased, everything ASCII but letters taken for blanks),
hashed into a fixed number of slots. Training uses a bounded sample: the per_language texts of each language with the smallest
hash of their id and text, as sparse slot shares, a fifth of them held back to calibrate the temperature of the softmax and the rejection
threshold. One more class stands for no language at all: it learns from the same texts with their letters shuffled, from runs of a letter
and from bytes of other scripts, and starts ahead, as n-grams that were never seen speak for no language. A text is rejected if that class is likelier than not, and than for all but one in a thousand held-back
texts; the language and its score are those of the best language whatever the rejection says. As the model is linear after the average, scoring adds one precomputed row of class weights per n-gram; each text
is scored whole, in the task that reads it, and nothing is shuffled.

Defined results. A null text or one without a letter is `und` with score 0. With no labelled rows every text is `und`. Rows with a null
language teach nothing. Every row gives one row, also for repeated or null ids. Further columns pass through; where docs
has a column named like an added one, the added one gets another underscore (fresh()).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, fresh, frugal, others, restore

SLOTS_BITS = 16
TABLE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def slots(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, place) of every 3-gram and 4-gram of raw bytes that is not all blank."""
    x = TABLE[raw].astype(np.uint32)
    three = x[:-2] << 16 | x[1:-1] << 8 | x[2:] if len(x) > 2 else np.zeros(0, np.uint32)
    four = three[:-1] << 8 | x[3:] if len(three) > 1 else np.zeros(0, np.uint32)
    out, places = [], []
    for gram, blank, salt in ((three, 0x202020, 0x9E3779B1), (four, 0x20202020, 0x85EBCA6B)):
        at = np.flatnonzero(gram != blank)
        out.append((gram[at] * np.uint32(salt)) >> np.uint32(32 - SLOTS_BITS))
        places.append(at)
    return np.concatenate(out), np.concatenate(places)


def no_language(text: bytes) -> bytes:
    """A text of no language made from another by a rule: its letters shuffled, a run of one letter, or bytes of other scripts."""
    import zlib

    seed = zlib.crc32(text)
    rng = np.random.default_rng(seed)
    x = TABLE[np.frombuffer(text, np.uint8)].copy()
    at = np.flatnonzero(x != 32)
    if seed % 4 == 0 and len(at):
        x[at] = rng.integers(97, 123)
    elif seed % 4 == 1:
        x[at] = rng.integers(128, 256, len(at), dtype=np.uint8)
    else:
        x[at] = x[rng.permutation(at)]
    return x.tobytes()


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text (16 bits each) and the share of its n-grams in each, in half precision."""
    got, _ = slots(np.frombuffer(b" " + text + b" ", np.uint8))
    slot, n = np.unique(got, return_counts=True)
    return slot.astype(np.uint16), (n / max(1, n.sum())).astype(np.float16)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # of each slot and language, and of no language last
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, calibrated probability among the languages, whether it is rejected) of each text."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        size = len(self.languages) + 1
        logits = np.empty((len(texts), size))
        for i, text in enumerate(texts):
            total, n = np.zeros(size), 0
            raw = np.frombuffer(b" " + text + b" ", np.uint8)
            for s in range(0, len(raw), 1 << 20):  # pieces that share three bytes, so that no 4-gram is lost or, but for 3-grams at a seam, met twice
                got, _ = slots(raw[max(0, s - 3) : s + (1 << 20)])
                total += np.bincount(got, minlength=1 << SLOTS_BITS) @ self.weights if len(got) > 1 << 15 else self.weights[got].sum(axis=0, dtype=np.float64)
                n += len(got)
            logits[i] = total / max(1, n) + self.bias
        k, p, none = best(logits / self.temperature)
        return k, p, none > self.threshold


def best(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its probability among the languages, the probability of no language)."""
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = np.exp(logits[:, :-1] - logits[:, :-1].max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    k = own.argmax(axis=1)
    return k, own[np.arange(len(p)), k], p[:, -1]


def fit(rows: list[tuple[str | None, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 4, batch: int = 32, rate: float = 20.0, lead: float = 3.0, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on (language or None, slots, shares); a fifth of the rows calibrates."""
    rng = np.random.default_rng(seed)
    languages = sorted({r[0] for r in rows if r[0] is not None})
    size = len(languages) + 1
    y = np.array([len(languages) if r[0] is None else languages.index(r[0]) for r in rows])
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    emb = rng.normal(0, 1 / np.sqrt(dim), (1 << SLOTS_BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, size)), np.append(np.zeros(size - 1), lead)

    def vectors(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        slot = np.concatenate([rows[i][1] for i in pick]).astype(np.int32)
        share = np.concatenate([rows[i][2] for i in pick]).astype(np.float32)
        owner = np.repeat(np.arange(len(pick)), [len(rows[i][1]) for i in pick])
        v = np.zeros((len(pick), dim))
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        v[owner[starts]] = np.add.reduceat(emb[slot] * share[:, None], starts) if len(slot) else 0
        return slot, share, owner, v

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for s in range(0, len(train), batch):
            pick = train[s : s + batch]
            slot, share, owner, v = vectors(pick)
            z = v @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = p @ out.T
            out -= step * (v.T @ p)
            bias -= 0.1 * p.sum(axis=0)
            if len(slot):  # the sum of a slot's gradients, slot by slot
                by = np.argsort(slot, kind="stable")
                first = np.flatnonzero(np.diff(slot[by], prepend=-1))
                emb[slot[by[first]]] -= step * np.add.reduceat(share[by, None] * back[owner[by]], first).astype(np.float32)
        train = rng.permutation(train)
    z = [vectors(held[s : s + batch])[3] @ out + bias for s in range(0, len(held), batch)]
    z = np.concatenate(z) if z else np.zeros((0, size))

    def loss(t: float) -> float:
        q = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), y[held]]).mean())

    temperature = min((1.25**k for k in range(16)), key=loss) if len(held) else 1.0
    threshold = 0.5
    real = (y[held] < len(languages)) & (np.array([len(rows[i][1]) for i in held]) >= 40)  # a few words may be anything
    if real.any():
        threshold = max(0.5, float(np.quantile(best(z[real] / temperature)[2], 0.999)))
    return LanguageModel(languages, (emb @ out).astype(np.float32), bias, temperature, threshold)


class LanguageID:
    def __init__(self, per_language: int = 800, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> None:
        self.per_language, self.id, self.text, self.lang = per_language, id_col, text_col, lang_col

    def learn(self, docs: DataFrame, train: Column) -> LanguageModel | None:
        """The model from the bounded sample; None without labelled rows. Only ids, then only the sample's shares, leave the tasks."""
        rows = docs.filter(train & F.col(self.lang).isNotNull() & F.col(self.text).isNotNull() & F.col(self.id).isNotNull())
        by = Window.partitionBy("lang").orderBy("cut", "id", "th")
        size = rows.groupBy(F.col(self.lang).alias("lang")).agg(F.count("*").alias("size"))
        th = F.xxhash64(F.col(self.text)).alias("th")
        slim = rows.select(F.col(self.lang).alias("lang"), F.col(self.id).alias("id"), th).withColumn("cut", F.pmod(F.xxhash64("id", "th"), F.lit(1 << 40)))
        # A first cut by the hash leaves about twice per_language rows of a language, however common it is, for the ranking. The languages
        # are the classes of the softmax, so their table is as small as the model. Equal rows count once, so that a repeated id adds nothing.
        slim = slim.join(F.broadcast(size), "lang").filter(F.col("cut") < F.lit(2.0 * self.per_language * (1 << 40)) / F.col("size")).drop("size").distinct()
        picked = slim.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= self.per_language).select("lang", "id", "th")

        def run(batches):
            for b in batches:
                texts = [t.as_py() or b"" for t in b.column(1).cast(pa.binary())]
                got = [shares(t) for t in texts] + [shares(t[len(t) // 2 : len(t) // 2 + 60]) for t in texts]  # with a short piece of each
                got += [shares(no_language(t[:600])) for t in texts]  # a negative needs no more of a text than that
                names = pa.concat_arrays([b.column(0)] * 2 + [pa.nulls(b.num_rows, pa.string())])
                yield pa.RecordBatch.from_arrays([names, *(pa.array([g[k].tobytes() for g in got], pa.binary()) for k in (0, 1))], ["lang", "slots", "shares"])

        sample = rows.select(F.col(self.lang).alias("lang"), F.col(self.id).alias("id"), th, F.col(self.text).alias("text")).join(F.broadcast(picked), ["lang", "id", "th"], "left_semi").dropDuplicates(["lang", "id", "th"])
        got = sample.select("lang", "text").mapInArrow(frugal(run), "lang string, slots binary, shares binary").toArrow()
        data = [(x, np.frombuffer(s.as_buffer(), np.uint16), np.frombuffer(v.as_buffer(), np.float16)) for x, s, v in zip(got.column(0).to_pylist(), got.column(1), got.column(2)) if len(s.as_buffer())]
        order = sorted(data, key=lambda r: (r[0] is None, r[0] or "", zlib.crc32(r[1]), zlib.crc32(r[2])))
        return fit(order) if any(r[0] is not None for r in order) else None

    def predict(self, docs: DataFrame, model: LanguageModel | None) -> DataFrame:
        """docs with _lang (und without a letter), _score and _rejected: without a letter, or likelier of no language by the calibrated threshold."""
        names = [fresh(n, docs) for n in ("_lang", "_score", "_rejected")]
        if model is None:
            return docs.withColumns(dict(zip(names, (F.lit("und"), F.lit(0.0), F.lit(True)))))
        letters = F.coalesce(F.col(self.text).rlike(r"\p{L}"), F.lit(False)).alias("ok")
        rows = docs.select(others(docs, self.text), F.col(self.text).cast("string").alias("text"), letters)

        def run(batches):
            for b in batches:
                text = b.column(1).cast(pa.binary())
                ok = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                k, p, no = model.score([text[i].as_py() for i in ok.tolist()])
                lang, score, rejected = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
                lang[ok], score[ok], rejected[ok] = np.array(model.languages, object)[k], p, no
                out = [*b.columns[:2], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(out, ["_row", "text", "lang", "score", "rejected"])

        schema = rows.select("_row", "text", F.lit("a").alias("lang"), F.lit(0.5).alias("score"), F.lit(True).alias("rejected")).schema
        scored = rows.mapInArrow(frugal(run), schema)
        return scored.select(*restore(scored, docs, **{self.text: F.col("text")}), *(F.col(c).alias(n) for c, n in zip(("lang", "score", "rejected"), names)))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    op = LanguageID()
    model = op.learn(docs, crc_mod(F.col("doc_id"), 5) != 0)
    out = op.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
