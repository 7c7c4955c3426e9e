"""SimHash near-dedup: self-join of a binary trie of 64-bit fingerprints under a Hamming error budget.

Two fingerprints within two bits agree on at least two of their four 16-bit blocks. So the trie is laid out in six bit orders, each
with another pair of blocks first; down those 32 levels the budget is zero (both sides walk the same branch), below it is two.
Node pairs are walked together, differing bits accumulate, and a pair is dropped as soon as it exceeds the budget. Only distinct
fingerprints enter. A subtree of over max_node fingerprints is cut into the node pairs 19 levels further down that are still within
the budget; such a node can hold 2^13 distinct fingerprints at most, so a unit of work is bounded whatever the data. A unit returns a
spanning forest of its links, never all pairs; components come from connected_components().

Defined results. A null or empty text has no words and the fingerprint zero, linked like any other. One or two words are one
shingle. Rows with a null id get a fingerprint, no link and a null component. Rows that repeat an id are placed each by its own
fingerprint: fingerprints, not ids, are the nodes of the graph. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import frugal, materialize
from tessera.llm.components import connected_components

SEED, SHINGLE = 42, 3


def fingerprints(texts, flush: int = 100_000) -> np.ndarray:
    """Fingerprints (uint64) of an iterable of UTF-8 bytes or None."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out, hashes, counts = [], [], []

    def close() -> None:
        n = np.array(counts, np.int64)
        fp = np.zeros(len(n), np.uint64)
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            some = np.flatnonzero(n)
            starts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            fp[some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        out.append(fp)
        hashes.clear()
        counts.clear()

    for text in texts:
        words = text.lower().split() if text else []  # of bytes: A-Z, and the six ASCII blanks
        if not words:
            counts.append(0)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(SHINGLE, len(words))
        new = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
        hashes.extend(new)
        counts.append(len(new))
        if len(hashes) >= flush:
            close()
    close()
    return np.concatenate(out)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct values within budget bits, in each group values[start:end] (sorted). All tries are walked at once."""
    values = values.astype(np.uint64)
    a0, a1, b0, b1 = starts, ends, starts, ends
    err = np.zeros(len(starts), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(bits - 1, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        diag = a0 == b0
        kids = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        if not diag.all():
            off = ~diag
            kids.append((am[off], a1[off], b0[off], bm[off], err[off] + 1))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*kids))
        na, nb = a1 - a0, b1 - b0
        keep = (na > 0) & (nb > 0) & (err <= budget) & ~((a0 == b0) & (na == 1))
        leaf = keep & (na == 1) & (nb == 1)
        if leaf.any():  # nothing left to branch: the rest of the path is one comparison
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            found.append((i[near], j[near]))
        keep &= ~leaf
        a0, a1, b0, b1, err = (x[keep] for x in (a0, a1, b0, b1, err))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least index in its component."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


class SimHashDedup:
    def __init__(self, budget: int = 2, max_node: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> None:
        if budget != 2:
            raise ValueError("the block layout is proven for a budget of two bits")
        self.budget, self.max_node, self.id, self.text = budget, max_node, id_col, text_col

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        """(id, th, fp long) of every row; th is xxhash64 of the text."""

        def run(batches):
            for b in batches:
                fp = fingerprints(x.as_buffer().to_pybytes() if x.is_valid else None for x in b.column(2).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "th", "fp"])

        text = F.col(self.text).cast("string")
        return docs.select(F.col(self.id).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(frugal(run), "id long, th long, fp long")

    def edges(self, reps: DataFrame) -> DataFrame:
        """reps(fp distinct), a written table -> fingerprints (a, b): a forest per unit that spans all links."""
        blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in (3, 2, 1, 0)]
        layouts = []
        for t, (i, j) in enumerate(combinations(range(4), 2)):
            k, m = (x for x in range(4) if x not in (i, j))
            pair = lambda x, y: F.shiftleft(blocks[x], 16).bitwiseOR(blocks[y])
            layouts.append(F.struct(F.lit(t).alias("t"), pair(i, j).alias("head"), pair(k, m).alias("rest")))
        laid = reps.select("fp", F.explode(F.array(*layouts)).alias("x")).select("fp", "x.*")
        counts = materialize(laid.groupBy("t", "head").agg(F.count("*").alias("n")).filter("n > 1"), "nodes")
        nodes = laid.join(counts, ["t", "head"])
        # The masks of at most two of the 19 bits that follow.
        deep = 19
        masks = [0, *(1 << i for i in range(deep)), *((1 << i) | (1 << j) for i, j in combinations(range(deep), 2))]
        p = F.shiftrightunsigned("rest", 32 - deep)
        pairs = F.transform(F.array(*(F.lit(x).cast("long") for x in masks)), lambda m: F.shiftleft(F.least(p, p.bitwiseXOR(m)), deep).bitwiseOR(F.greatest(p, p.bitwiseXOR(m))))
        whole = nodes.filter(F.col("n") <= self.max_node).withColumn("unit", F.lit(-1).cast("long"))
        cut = nodes.filter(F.col("n") > self.max_node).withColumn("unit", F.explode(pairs))
        units = whole.unionByName(cut).groupBy("t", "head", "unit").agg(F.collect_list(F.struct("rest", "fp")).alias("m")).select(F.col("m.rest").alias("rest"), F.col("m.fp").alias("fp"))
        budget = self.budget

        def run(batches):
            for b in batches:
                rest, reps = b.column(0), b.column(1)
                if not len(rest):
                    continue
                ends = rest.offsets.to_numpy()
                v, r = rest.flatten().to_numpy(), reps.flatten().to_numpy()
                ends = ends - ends[0]
                group = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                order = np.lexsort((v, group))
                v, r = v[order], r[order]
                i, j = trie_pairs(v, ends[:-1].astype(np.int64), ends[1:].astype(np.int64), 32, budget)
                root = forest(len(v), i, j)
                k = np.flatnonzero(root != np.arange(len(v)))
                yield pa.RecordBatch.from_arrays([pa.array(r[k]), pa.array(r[root[k]])], ["a", "b"])

        return units.mapInArrow(frugal(run), "a long, b long")

    def groups(self, docs: DataFrame) -> DataFrame:
        """(id, th, fp, g, component_id), a row for each row of docs. g, a fingerprint, names the component; its smallest id needn't be its alone."""
        fps = materialize(self.fingerprints(docs), "fps")
        reps = materialize(fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "reps")
        linked = materialize(connected_components(self.edges(reps)).select(F.col("node").alias("fp"), F.col("component").alias("g")), "linked")
        least = materialize(linked.join(reps, "fp").groupBy("g").agg(F.min("rep").alias("least")), "least")
        named = reps.join(linked.join(least, "g"), "fp", "left").select("fp", F.coalesce("g", "fp").alias("g"), F.coalesce("least", "rep").alias("component_id"))
        out = fps.join(materialize(named, "named"), "fp", "left")
        known = F.col("id").isNotNull()
        return out.select("id", "th", "fp", F.when(known, F.col("g")).alias("g"), F.when(known, F.col("component_id")).alias("component_id"))

    def __call__(self, docs: DataFrame) -> DataFrame:
        """(id, fingerprint, component_id), a row for each row of docs."""
        return self.groups(docs).select(F.col("id").alias(self.id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimHashDedup()(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
