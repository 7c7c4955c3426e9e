"""Benchmark decontamination by a distributed positional inverted index.

Documents are cut into segments; each is stored as one row: its words and, word by word, their sorted positions. The index holds all words of
the documents, so it is built once and serves any test items. A test window is looked up by intersecting the offset-adjusted posting lists
of its terms, rarest in the segment first, so most windows end at an empty or one-entry list. With slop 0 that gives the exact phrases;
with slop s, places where every term lies within s positions of where the phrase wants it. No document text is shuffled and no list is
ever gathered over segments.

Test items are a stated query set. They are handled in blocks of at most max_block_words words (an item is never cut): only one block's
vocabulary and windows are held and sent to the executors, whatever the number of items; the blocks' spans are then merged by row.

Defined results. Null or empty texts have no words, no hits and are not contaminated. Null items and items without words have no
window; an item of fewer than `window` words is one window; rows that repeat an item_id are one item; rows with a null item_id are
ignored. Every row of documents gives one row, also for repeated or null ids. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import pack, planes, unpack, unplanes
from tessera.llm.common import frugal, materialize

#: Words are runs of digits, letters a-z (after lower-casing A-Z) and every byte of a non-ASCII character.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SEGMENT = "seg long, ids array<long>, hashes array<long>, n_words array<int>, postings binary"
FOUND = "seg long, row int, id long, th long, n_words long, starts array<int>, stops array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def windows_of(items: list[tuple[str, bytes]], window: int) -> tuple[dict[bytes, int], dict[tuple[int, ...], set[str]]]:
    """The vocabulary and the windows (term numbers -> the items that hold them)."""
    vocab: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        terms = tuple(vocab.setdefault(w, len(vocab)) for w in words_of(text))
        for i in range(max(1, len(terms) - window + 1) if terms else 0):
            windows.setdefault(terms[i : i + window], set()).add(item)
    return vocab, windows


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[str, bytes]]]:
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null")
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        n = len(words_of(text))
        if block and size + n > max_words:
            yield block
            block, size = [], 0
        block.append((r["i"], text))
        size += n
    if block:
        yield block


def search_segment(begin, count, places, bounds, windows: list, grid: np.ndarray, slop: int) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """(window, its start places) for every window that occurs. begin, count: of each term in places; bounds: the place where each row begins."""
    out = []
    for at_window in np.flatnonzero((count[grid] > 0).all(axis=1)).tolist():
        w = windows[at_window]
        order = sorted(range(len(w)), key=lambda k: count[w[k]])
        k = order[0]
        c = places[begin[w[k]] : begin[w[k]] + count[w[k]]] - k
        if slop:  # a start may not lie before its row
            row = np.searchsorted(bounds, c + k, "right") - 1
            c = c[c >= bounds[row]]
        for k in order[1:]:
            p = places[begin[w[k]] : begin[w[k]] + count[w[k]]]
            at = np.searchsorted(p, c + k - slop)
            c = c[(at < len(p)) & (p[np.minimum(at, len(p) - 1)] <= c + k + slop)]
            if not len(c):
                break
        if len(c):
            out.append((w, c))
    return out


class Decontaminator:
    def __init__(self, window: int = 13, share: float = 0.05, segment_words: int = 1_000_000, max_block_words: int = 200_000, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.window, self.share, self.segment_words, self.max_block_words, self.slop, self.id, self.text = window, share, segment_words, max_block_words, slop, id_col, text_col
        self.gap = window + slop  # empty places between rows, so that no match crosses from one to the next

    def build_index(self, docs: DataFrame) -> DataFrame:
        """The stored index: one row per segment, of all words. A written table."""
        limit, gap = self.segment_words, self.gap

        def run(batches):
            ids, hashes, lengths, found, starts, known = [], [], [], [], [], {}
            base, seg = 0, TaskContext.get().partitionId() << 32

            def close():
                term = np.concatenate(found)
                place = np.arange(len(term)) + np.repeat(np.array(starts) - np.cumsum([0, *lengths])[:-1], lengths)
                order = np.argsort(term, kind="stable")
                ends = np.cumsum(np.bincount(term, minlength=len(known)))
                postings = pack(b"\n".join(known), *planes(ends), *planes(np.diff(place[order], prepend=0) & 0xFFFFFFFF))
                cols = [pa.array([x], t) for x, t in ((seg, pa.int64()), (ids, pa.list_(pa.int64())), (hashes, pa.list_(pa.int64())), (lengths, pa.list_(pa.int32())), (postings, pa.binary()))]
                return pa.RecordBatch.from_arrays(cols, ["seg", "ids", "hashes", "n_words", "postings"])

            for b in batches:
                for i, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                    words = words_of(text.as_py())
                    for w in words:
                        if w not in known:
                            known[w] = len(known)
                    found.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    starts.append(base)
                    ids.append(i)
                    hashes.append(th)
                    lengths.append(len(words))
                    base += len(words) + gap
                    if base >= limit:
                        yield close()
                        ids, hashes, lengths, found, starts, known, base, seg = [], [], [], [], [], {}, 0, seg + 1
            if ids:
                yield close()

        rows = docs.select(F.col(self.id).cast("long").alias("id"), F.xxhash64(F.col(self.text)).alias("th"), F.col(self.text).cast("string").alias("text"))
        return materialize(rows.mapInArrow(frugal(run), SEGMENT), "index")

    def search(self, index: DataFrame, vocab: dict[bytes, int], windows: dict[tuple[int, ...], set[str]]) -> DataFrame:
        """A row for each row of the documents: its hit spans (word positions, end exclusive) and the items found in it."""
        gap, slop = self.gap, self.slop
        keys, names = list(windows), [sorted(x) for x in windows.values()]
        longest = max(map(len, keys), default=1)

        def run(batches):
            grid = np.array([w + (w[0],) * (longest - len(w)) for w in keys], np.int64).reshape(len(keys), longest)
            of = dict(zip(keys, names))
            for b in batches:
                for k in range(b.num_rows):
                    seg = b.column(0)[k].as_py()
                    ids, hashes, n = (b.column(c)[k].values for c in range(1, 4))
                    joined, *p = unpack(b.column(4)[k].as_py())
                    own = joined.split(b"\n")
                    local = dict(zip(own, range(len(own)))) if joined else {}
                    ends, places = unplanes(p[:4]).astype(np.int64), np.cumsum(unplanes(p[4:]), dtype=np.int64) & 0xFFFFFFFF
                    at = np.fromiter((local.get(w, -1) for w in vocab), np.int64, len(vocab))
                    begin, count = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
                    begin[at >= 0] = np.append(0, ends)[at[at >= 0]]
                    count[at >= 0] = ends[at[at >= 0]] - begin[at >= 0]
                    n = n.to_numpy().astype(np.int64)
                    bounds = np.concatenate(([0], np.cumsum(n + gap)[:-1]))
                    delta = np.zeros(int(n.sum()) + gap * len(n) + 1, np.int32)
                    items: dict[int, set] = {}
                    for w, at in search_segment(begin, count, places, bounds, keys, grid, slop):
                        row = np.searchsorted(bounds, at, "right") - 1
                        np.add.at(delta, at, 1)
                        np.add.at(delta, np.minimum(at + len(w), bounds[row] + n[row]), -1)
                        for r in np.unique(row).tolist():
                            items.setdefault(r, set()).update(of[w])
                    edge = np.diff((np.cumsum(delta) > 0).astype(np.int8), prepend=0)
                    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    row = np.searchsorted(bounds, s, "right") - 1
                    offsets = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array((x - bounds[row]).astype(np.int32))) for x in (s, e)]
                    cols = [pa.array(np.full(len(n), seg, np.int64)), pa.array(np.arange(len(n), dtype=np.int32)), ids, hashes, pa.array(n), *lists, pa.array([sorted(items.get(r, ())) for r in range(len(n))], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, ["seg", "row", "id", "th", "n_words", "starts", "stops", "items"])

        return index.mapInArrow(frugal(run), FOUND)

    def __call__(self, docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
        """(id, th, n_words, n_hit, items array, contaminated), a row for each row of docs; th is xxhash64 of the text."""
        index, parts = self.build_index(docs), []
        for block in item_blocks(items, item_id, item_text, self.max_block_words):
            vocab, windows = windows_of(block, self.window)
            parts.append(self.search(index, vocab, windows))
        if not parts:
            parts.append(self.search(index, {}, {}))
        out = parts[0]
        if len(parts) > 1:
            for p in parts[1:]:
                out = out.unionAll(p)
            flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
            out = out.groupBy("seg", "row", "id", "th", "n_words").agg(flat("starts"), flat("stops"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
            spans = F.array_sort(F.arrays_zip("starts", "stops"))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))
            step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["stops"] - F.greatest(x["starts"], acc["last"]))).cast("long").alias("n"), F.greatest(acc["last"], x["stops"]).alias("last"))
            out = out.withColumn("n_hit", F.aggregate(spans, start, step)["n"])
        else:
            out = out.withColumn("n_hit", F.aggregate(F.zip_with("stops", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))
        bad = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(self.share) * F.col("n_words") - 1e-9)
        return out.select("id", "th", "n_words", "n_hit", F.array_sort("items").alias("items"), bad.alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = Decontaminator()(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
