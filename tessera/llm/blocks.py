"""Blocks of documents as token sequences over local dictionaries, and the two shuffles that carry a global answer for each word.

A block is a run of documents of about max_tokens tokens. It is read twice, both times from the same file splits: once for its
distinct words (split by hash into buckets, one compressed row per block and bucket), once for its sequence of word numbers.
Words go to their bucket, where each distinct word is answered once for all blocks; answers go back to the block, where they meet
the sequence. So a word crosses the network once per block that holds it, however often it occurs there, and no key is hot: the
commonest word has one entry per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal, is_plain_scan, materialize

WORDS = "bucket int, block long, n int, mark long, payload binary"
SEQS = "block long, bucket int, n int, mark long, ids array<long>, flags array<boolean>, lengths array<int>, payload binary"


def pack(*parts: bytes) -> bytes:
    import zstandard

    sizes = np.array([len(parts), *map(len, parts)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def unpack(payload: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)) + 4 * (n + 1)
    return [raw[e - s : e] for e, s in zip(ends.tolist(), np.frombuffer(raw, np.uint32, n, 4).tolist())]


def join_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return np.fromiter(map(len, words), np.uint32, len(words)).tobytes(), b"".join(words)


def split_words(lengths: bytes, blob: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64)
    starts = np.concatenate(([0], ends))[:-1]
    return [blob[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def planes(x: np.ndarray) -> list[bytes]:
    """The bytes of uint32 values by significance, which compress far better apart."""
    return [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(4)]


def unplanes(parts: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1).copy().view("<u4").ravel()


class Block:
    """Documents of one block: local words by falling frequency, and the sequence of their ranks."""

    def __init__(self, number: int, ids: list, flags: list, parts: list[np.ndarray], seen: dict[str | bytes, int], buckets: int) -> None:
        """parts: per document the numbers of its tokens in seen."""
        self.number, self.ids, self.flags = number, ids, flags
        self.lengths = np.fromiter(map(len, parts), np.int32, len(parts))
        raw = np.concatenate(parts)
        count = np.bincount(raw, minlength=len(seen))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.seq = rank[raw]
        known = [w.encode() if isinstance(w, str) else w for w in seen]
        self.words = [known[k] for k in order.tolist()]
        crc = zlib.crc32
        self.bucket = np.fromiter((crc(w) % buckets for w in self.words), np.uint32, len(self.words))
        self.mark = crc(b"\n".join(self.words))


def blocks(batches: Iterator[pa.RecordBatch], tokenize: Callable[[bytes], list[bytes]], max_tokens: int, buckets: int) -> Iterator[Block]:
    part = TaskContext.get().partitionId()
    k, ids, flags, parts, seen, size = 0, [], [], [], {}, 0
    for b in batches:
        for i, flag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            got = tokenize(text.as_py() or b"")
            for w in got:
                if w not in seen:
                    seen[w] = len(seen)
            ids.append(i)
            flags.append(flag)
            parts.append(np.fromiter(map(seen.__getitem__, got), np.int32, len(got)))  # only distinct tokens stay
            size += len(got)
            if size >= max_tokens:
                yield Block(part << 32 | k, ids, flags, parts, seen, buckets)
                k, ids, flags, parts, seen, size = k + 1, [], [], [], {}, 0
    if ids:
        yield Block(part << 32 | k, ids, flags, parts, seen, buckets)


def bucket_count(docs: DataFrame, each: int = 16 << 20, least: int = 64) -> int:
    """A bucket for each 16 MB of the files that docs reads, so that a bucket's words fit a worker and a block's share of it isn't a few words."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size // each, 1 << 16))


def word_rows(x: Block, counted: bool, buckets: int) -> list[tuple]:
    """(bucket, block, n, mark, payload) of a block's distinct words."""
    if counted:
        taken = np.repeat(np.array([bool(f) for f in x.flags]), x.lengths)
        count = np.bincount(x.seq[taken], minlength=len(x.words))
    order = np.argsort(x.bucket, kind="stable")
    cuts = np.searchsorted(x.bucket[order], np.arange(buckets + 1))
    rows = []
    for j in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[j] : cuts[j + 1]]
        parts = join_words([x.words[k] for k in at.tolist()])
        rows.append((j, x.number, len(at), x.mark, pack(*parts, count[at].astype(np.uint32).tobytes()) if counted else pack(*parts)))
    return rows


def sequence_row(x: Block) -> pa.RecordBatch:
    row = ((x.number, pa.int64()), (-1, pa.int32()), (len(x.words), pa.int32()), (x.mark, pa.int64()), (x.ids, pa.list_(pa.int64())), (x.flags, pa.list_(pa.bool_())), (x.lengths, pa.list_(pa.int32())), (pack(*planes(x.seq), *planes(x.bucket)), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], ["block", "bucket", "n", "mark", "ids", "flags", "lengths", "payload"])


class BlockTable:
    """docs(id long, flag boolean, text string) cut into blocks. flag marks rows whose words count in words()."""

    def __init__(self, docs: DataFrame, tokenize: Callable[[bytes], list[bytes]], max_tokens: int) -> None:
        self.docs = docs if is_plain_scan(docs) else materialize(docs, "docs")
        self.tokenize, self.max_tokens, self.buckets = tokenize, max_tokens, bucket_count(self.docs)

    def words(self, counted: bool) -> DataFrame:
        """A row per block and bucket: its distinct words and, if counted, how often each occurs in flagged rows."""
        tokenize, limit, buckets = self.tokenize, self.max_tokens, self.buckets

        def run(batches):
            for x in blocks(batches, tokenize, limit, buckets):
                rows = word_rows(x, counted, buckets)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "block", "n", "mark", "payload"])

        return self.docs.mapInArrow(frugal(run), WORDS)

    def sequences(self) -> DataFrame:
        """A row per block, with bucket -1 so that it sorts before the answers to its words."""
        tokenize, limit, buckets = self.tokenize, self.max_tokens, self.buckets

        def run(batches):
            for x in blocks(batches, tokenize, limit, buckets):
                yield sequence_row(x)

        return self.docs.mapInArrow(frugal(run), SEQS)

    def stored(self) -> DataFrame:
        """The rows of words(True) and of sequences() from one read of the documents: a written table."""
        tokenize, limit, buckets = self.tokenize, self.max_tokens, self.buckets

        def run(batches):
            for x in blocks(batches, tokenize, limit, buckets):
                yield sequence_row(x)
                rows = word_rows(x, True, buckets)
                if rows:
                    bucket, block, n, mark, payload = zip(*rows)
                    empty = [pa.nulls(len(rows), pa.list_(t)) for t in (pa.int64(), pa.bool_(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(mark, pa.int64()), *empty, pa.array(payload, pa.binary())], ["block", "bucket", "n", "mark", "ids", "flags", "lengths", "payload"])

        return materialize(self.docs.mapInArrow(frugal(run), SEQS), "blocks")

    def assemble(self, answers: DataFrame, finish: Callable, schema: str, width: int, numbered: bool = False, sequences: DataFrame | None = None) -> DataFrame:
        """answers(block, bucket, n, mark, payload) meet their block. finish(ids, flags, lengths, seq, per_bucket) yields batches; per_bucket: (ranks of the bucket's words, payload). numbered: the block's number comes first. sequences: their rows, where they are stored."""
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("flags", "array<boolean>"), ("lengths", "array<int>"))]
        both = (sequences or self.sequences()).unionByName(answers.select("block", "bucket", "n", "mark", *empty, "payload"))
        both = both.repartition(width, "block").sortWithinPartitions("block", "bucket")

        def close(head, rest):
            if sum(r[2] for r in rest) != head["n"] or any(r[3] != head["mark"] for r in rest):
                raise RuntimeError("the two reads of the documents differ; write them to a table first")
            parts = unpack(head["payload"])
            seq, bucket = unplanes(parts[:4]), unplanes(parts[4:])
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], [r[1] for r in rest]), np.searchsorted(bucket[order], [r[1] for r in rest], "right")
            per = [(order[s:e], r[4]) for s, e, r in zip(*(c.tolist() for c in cuts), rest)]
            yield from finish(*[head["block"]] * numbered, head["ids"], head["flags"], np.array(head["lengths"], np.int64), seq, per)

        def run(batches):
            head, rest = None, []
            for b in batches:
                for k in range(b.num_rows):
                    if b.column(1)[k].as_py() < 0:
                        if head is not None:
                            yield from close(head, rest)
                        head, rest = {c: b.column(c)[k].as_py() for c in ("block", "n", "mark", "ids", "flags", "lengths", "payload")}, []
                    else:
                        rest.append(tuple(b.column(c)[k].as_py() for c in ("block", "bucket", "n", "mark", "payload")))
            if head is not None:
                yield from close(head, rest)

        return both.mapInArrow(frugal(run), schema)
