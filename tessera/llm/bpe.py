"""Byte-level BPE by a global shuffle of distinct words.

Documents are split into pre-tokens with their positions; the distinct pre-tokens of each block go to buckets by hash, each distinct
one is encoded once there for all blocks, the ids are joined back and put in order by position (see blocks.py). Decoding joins
every id with the token-byte table, which has one entry per token of the vocabulary and so a fixed size.

Defined results. A null or empty text has no tokens and decodes to no bytes. Every row gives one row, also for repeated or null
ids. An empty table gives an empty result; further columns are not read. Special tokens are ordinary text. Bytes
that are not UTF-8 count as U+FFFD, one for each ill-formed sequence.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import BlockTable, pack, split_words, unpack
from tessera.llm.common import frugal, width


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, max_tokens: int = 600_000) -> None:
        self.ranks, self.max_tokens = ranks, max_tokens
        self.pattern = pattern

    def tokenizer(self):
        pattern, cache = self.pattern, []

        def tokenize(text: bytes) -> list[str]:  # blocks encode each distinct one
            if not cache:
                import regex

                cache.append(regex.compile(pattern).findall)
            return cache[0](text.decode(errors="replace"))

        return tokenize

    def encode_words(self, words: DataFrame, parts: int) -> DataFrame:
        """Every distinct word of a bucket is encoded once; a row per block and bucket with the ids of its words."""
        ranks, pattern = self.ranks, self.pattern

        def run(batches):
            import tiktoken

            encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
            bucket, known = None, {}
            for b in batches:
                out = []
                for row_bucket, payload in zip(b.column("bucket").to_pylist(), b.column("payload")):
                    if row_bucket != bucket:
                        bucket, known = row_bucket, {}
                    ids = []
                    for w in split_words(*unpack(payload.as_py())):
                        got = known.get(w)
                        if got is None:
                            got = known[w] = np.array(encode(w), np.uint32).tobytes()
                        ids.append(got)
                    n = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                    flat = np.frombuffer(b"".join(ids), np.uint8).reshape(-1, 4)
                    out.append(pack(n.tobytes(), *(np.ascontiguousarray(flat[:, k]).tobytes() for k in range(4))))
                yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), b.column("n"), b.column("mark"), pa.array(out, pa.binary())], ["block", "bucket", "n", "mark", "payload"])

        dealt = words.repartition(parts, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(frugal(run), "block long, bucket int, n int, mark long, payload binary")

    def __call__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens long, ids binary: little-endian unsigned 32-bit, decoded binary), a row for each row of docs."""
        parts = width(docs.sparkSession)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("flag"), F.col(text_col).cast("string").alias("text"))
        table = BlockTable(rows, self.tokenizer(), self.max_tokens)
        answers = self.encode_words(table.words(False), parts)
        token_bytes = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, k in self.ranks.items():
            token_bytes[k] = token

        def finish(ids, flags, lengths, seq, per):
            words = sum(len(at) for at, _ in per)
            count, start, flat, base = np.zeros(words, np.int64), np.zeros(words, np.int64), [], 0
            for at, payload in per:
                n, *four = unpack(payload)
                n = np.frombuffer(n, np.uint32).astype(np.int64)
                count[at], start[at] = n, base + np.concatenate(([0], np.cumsum(n)[:-1]))
                flat.append(np.stack([np.frombuffer(p, np.uint8) for p in four], axis=1).copy().view("<u4").ravel())
                base += len(flat[-1])
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            per_word = count[seq]
            total = np.cumsum(per_word)
            all_ids = flat[np.repeat(start[seq] - (total - per_word), per_word) + np.arange(total[-1] if len(total) else 0)]
            word_ends = np.cumsum(lengths)
            ends = np.concatenate(([0], total))[word_ends]
            begins = np.concatenate(([0], ends[:-1]))
            look = token_bytes.__getitem__  # the join with the token-byte table
            coded, texts = [], []
            for s, e in zip(begins.tolist(), ends.tolist()):
                coded.append(all_ids[s:e].tobytes())
                texts.append(b"".join(map(look, all_ids[s:e].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends - begins), pa.array(coded, pa.binary()), pa.array(texts, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

        return table.assemble(answers, finish, "id long, n_tokens long, ids binary, decoded binary", parts)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = ByteBPE(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digest(out)


def digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
