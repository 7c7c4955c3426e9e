"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised and projected on k Gaussian directions per table; the projections, shifted and quantised to width w, make the
bucket. For unit vectors at cosine 0.9 the distance is sqrt(0.2), which gives the collision chance per projection; k follows the number of
vectors so that unrelated ones rarely meet, the number of tables L so that a pair at the threshold is missed with at most the
chance `miss`. Pairs are compared exactly, in double precision, before they count as links.

Equal vectors are one class before anything is compared. Only a code of `bits` sign bits goes to the buckets, not the vector. Two classes
that share a bucket are candidates if their codes differ in no more bits than a pair at the threshold does, but for `slack` standard deviations;
a unit of work returns a spanning forest of its candidates, never all pairs. Then each vector goes once to its group (a
component of candidates), where all are compared. Groups of over four units take the cheaper way by number of comparisons: all
against all, or bucket by bucket, where a pair that meets in several tables counts in the first only, which the two signatures tell.
Buckets and groups of over max_unit classes are cut into blocks, a unit being a pair of blocks: no row is dropped, no unit is larger.

Defined results. A vector that is null, empty, zero, or holds a null or non-finite component links with nothing and is its own
component. Vectors of different lengths never link. Rows with a null id link with nothing, have a null component and are not kept. Rows
that repeat an id count as vectors of their own. Every row gives one row; further columns are not read.
"""

from __future__ import annotations

from math import acos, ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import frugal, key128, materialize, sized, width
from tessera.llm.components import connected_components
from tessera.llm.simhash import forest


def collision(distance: float, w: float) -> float:
    """The chance that two vectors at a distance share a quantised Gaussian projection of width w."""
    t = w / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def whole_units(batches, names: tuple[str, ...]):
    """Tables that hold whole units, from batches in which the rows of a unit, equal in `names`, lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        key = [table.column(n).to_numpy() for n in names]
        last = np.logical_and.reduce([x == x[-1] for x in key])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # rows before the unit that may go on
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class EmbeddingDedup:
    def __init__(self, threshold: float = 0.9, w: float = 2.5, miss: float = 0.005, bucket: int = 1024, max_unit: int = 4096, bits: int = 192, slack: float = 3.5, seed: int = 17, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        if bits % 64:
            raise ValueError("bits must be a multiple of 64")
        self.threshold, self.w, self.miss, self.bucket, self.max_unit, self.seed, self.id, self.vec = threshold, w, miss, bucket, max_unit, seed, id_col, vec_col
        self.bits, q = bits, acos(threshold) / pi
        self.near = int(bits * q + slack * sqrt(bits * q * (1 - q)))  # bits that candidates may differ in
        self.near_first = int(64 * q + (slack + 1) * sqrt(64 * q * (1 - q)))  # and among the first 64 of them
        self.code = [f"s{n}" for n in range(bits // 64)]

    def plan(self, n: int) -> tuple[int, int]:
        """(k, L) for n classes: unrelated vectors (at right angles) meet about `bucket` others in a bucket."""
        p1, p2 = collision(sqrt(2 - 2 * self.threshold), self.w), collision(sqrt(2), self.w)
        k = max(4, ceil(log(max(2.0, n / self.bucket)) / -log(p2)))
        return k, ceil(log(self.miss) / log(1 - p1**k))

    def signatures(self, classes: DataFrame, k: int, tables: int) -> DataFrame:
        """(rep, code, sig) of each class: sign bits and a bucket for each table. A written table."""
        seed, w, bits, code = self.seed, self.w, self.bits, self.code

        def run(batches):
            made: dict[int, tuple] = {}
            for b in batches:
                vecs = b.column(1)
                sizes = np.diff(vecs.offsets.to_numpy())
                flat = vecs.flatten().to_numpy().astype(np.float64)
                out, signs = np.zeros((b.num_rows, tables), np.int32), np.zeros((b.num_rows, bits // 8), np.uint8)
                ends = np.cumsum(sizes)
                for dim in np.unique(sizes).tolist():
                    if dim not in made:
                        rng = np.random.default_rng((seed, dim))
                        made[dim] = rng.normal(size=(dim, tables * k)), rng.uniform(0, w, tables * k), rng.integers(1, 2**31, tables * k) * 2 + 1, rng.normal(size=(dim, bits))
                    a, shift, mix, g = made[dim]
                    where = np.flatnonzero(sizes == dim)
                    step = max(1, 2_000_000 // (tables * k))
                    for s in range(0, len(where), step):
                        at = where[s : s + step]
                        x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                        x /= np.linalg.norm(x, axis=1, keepdims=True)
                        cell = np.floor((x @ a + shift) / w).astype(np.int64) * mix
                        cell = cell.reshape(len(at), tables, k).sum(axis=2) * 0x9E3779B97F4A7C1 + dim
                        out[at] = (cell >> 24).astype(np.int32)
                        signs[at] = np.packbits(x @ g > 0, axis=1)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
                words = signs.view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, n])) for n in range(len(code))), sig], ["rep", *code, "sig"])

        return materialize(classes.select("rep", "vec").mapInArrow(frugal(run), "rep long, " + "".join(f"{c} long, " for c in code) + "sig array<int>"), "signed")

    def candidates(self, units: DataFrame) -> DataFrame:
        """units(unit, rep, code), all rows of a unit in one partition and together, by rep -> edges (a, b) of a spanning forest of each unit."""
        code, near, near_first = self.code, self.near, self.near_first

        def unit(rep, words):
            """words: the code, 64 bits a column. The first word rules out nearly all pairs."""
            first, pairs = words[:, 0].copy(), []
            for s in range(0, len(rep), 512):
                x, y = np.nonzero(np.bitwise_count(first[s : s + 512, None] ^ first[None, s:]) <= near_first)
                x, y = x[x < y] + s, y[x < y] + s
                ok = np.bitwise_count(words[x] ^ words[y]).sum(axis=1) <= near
                x, y = x[ok], y[ok]
                if len(x):
                    label = forest(len(rep), *(np.concatenate([p[q] for p in [*pairs, (x, y)]]) for q in (0, 1)))
                    k = np.flatnonzero(label != np.arange(len(rep)))
                    pairs = [(k, label[k])]
            return (rep[pairs[0][0]], rep[pairs[0][1]]) if pairs else None

        def run(batches):
            for rows in whole_units(batches, ("unit",)):
                u, rep = rows.column("unit").to_numpy(), rows.column("rep").to_numpy()
                words = np.stack([rows.column(c).to_numpy() for c in code], axis=1).view(np.uint64)
                head = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                out = []
                for s, e in zip(head.tolist(), np.append(head[1:], len(u)).tolist()):
                    if e - s > 1:
                        got = unit(rep[s:e], words[s:e])
                        if got:
                            out.append(got)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[q] for o in out])) for q in (0, 1)], ["a", "b"])

        return units.mapInArrow(frugal(run), "a long, b long")

    def compare(self, units: DataFrame) -> DataFrame:
        """units(t, b, i, j, c, rep, cnt, vec, sig), all rows of a unit in one partition and together -> (rep, links, root)."""
        threshold = self.threshold

        def unit(t, i, j, c, rep, cnt, vec, sig):
            vec = vec / np.linalg.norm(vec, axis=1, keepdims=True)
            left, right = (np.flatnonzero(c == i), np.flatnonzero(c == j)) if i != j else (np.arange(len(c)),) * 2
            links = np.zeros(len(c), np.int64)
            pairs = []
            for s in range(0, len(left), 256):
                rows = left[s : s + 256]
                x, y = np.nonzero(vec[rows] @ vec[right].T >= threshold)
                x, y = rows[x], right[y]
                if i == j:
                    x, y = x[x < y], y[x < y]
                new = ~(sig[x, :t] == sig[y, :t]).any(axis=1)  # met in no earlier table
                x, y = x[new], y[new]
                np.add.at(links, x, cnt[y])
                np.add.at(links, y, cnt[x])
                label = forest(len(c), *(np.concatenate([p[q] for p in [*pairs, (x, y)]]) for q in (0, 1)))
                k = np.flatnonzero(label != np.arange(len(c)))
                pairs = [(k, label[k])]
            k = np.flatnonzero(links)
            root = forest(len(c), *pairs[0]) if pairs else np.arange(len(c))
            return rep[k], links[k], rep[root[k]]

        def close(rows: pa.Table):
            t, i, j, c, rep, cnt = (rows.column(n).to_numpy() for n in ("t", "i", "j", "c", "rep", "cnt"))
            b = rows.column("b").to_numpy()
            vecs, sigs = (rows.column(n).combine_chunks() for n in ("vec", "sig"))
            vecs, sigs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (vecs, sigs))
            offsets, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy()
            sig = sigs.flatten().to_numpy()
            sig = sig.reshape(len(t), len(sig) // len(t))
            new = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(b, prepend=0) != 0) | (np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0))
            new[:1] = 0
            out = []
            for s, e in zip(new, np.append(new[1:], len(t))):
                sizes = np.diff(offsets[s : e + 1])
                for dim in np.unique(sizes):  # one, but for hashes that meet by chance
                    at = s + np.flatnonzero(sizes == dim)
                    if len(at) > 1:
                        v = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
                        out.append(unit(t[s], i[s], j[s], c[at], rep[at], cnt[at], v, sig[at]))
            cols = [np.concatenate([o[q] for o in out]) if out else np.zeros(0, np.int64) for q in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["rep", "links", "root"])

        def run(batches):
            for rows in whole_units(batches, ("t", "b", "i", "j")):
                yield close(rows)

        return units.mapInArrow(frugal(run), "rep long, links long, root long")

    def blocks(self, rows: DataFrame, key: str) -> DataFrame:
        """rows(key, rep, n) with m, the number of blocks of its key, and a row for each pair i <= j of blocks that holds the row's block c."""
        m = F.ceil(F.coalesce("n", F.lit(1)) / self.max_unit).cast("int")
        cut = rows.withColumn("m", m).withColumn("c", F.pmod(F.xxhash64("rep", key), F.col("m")).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        return cut.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")})

    def units(self, rows: DataFrame, key: str) -> DataFrame:
        """rows(key, rep, cnt, vec, n, and t, sig if the key is a bucket's) as units for compare()."""
        if "sig" not in rows.columns:
            rows = rows.withColumns({"t": F.lit(0), "sig": F.array().cast("array<int>")})
        work = self.blocks(rows, key).select("t", F.col(key).alias("b"), "i", "j", "c", "rep", "cnt", "vec", "sig")
        return work.repartition(width(rows.sparkSession), "t", "b", "i", "j").sortWithinPartitions("t", "b", "i", "j", "rep")

    def loose(self, members: DataFrame, signed: DataFrame) -> DataFrame:
        """members(g, rep, n) -> those g for which comparing within buckets takes fewer comparisons than all against all."""
        met = members.join(signed.select("rep", "sig"), "rep").select("g", "n", F.posexplode("sig").alias("t", "x"))
        cost = met.groupBy("g", "n", "t", "x").agg(F.count("*").cast("double").alias("k")).groupBy("g", "n").agg(F.sum(F.col("k") * F.col("k")).alias("cost"))
        return cost.filter(F.col("cost") < F.col("n").cast("double") * F.col("n")).select("g")

    def __call__(self, vectors: DataFrame) -> DataFrame:
        """(id, n_links, component_id, kept), a row for each row of vectors."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(self.id).cast("long").alias("id"), F.col(self.vec).alias("vec"))
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
        h1, h2 = key128(F.col("vec"))
        rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
        usable = rows.filter("ok").withColumns({"h1": h1, "h2": h2})
        classes = usable.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("cnt"), F.first("vec").alias("vec"))
        classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # rep: a number, as ids may repeat
        k, tables = self.plan(classes.count())
        signed = self.signatures(classes, k, tables)
        spread = signed.select("rep", *self.code, F.posexplode("sig").alias("t", "b")).select(F.xxhash64("t", "b").alias("u"), "rep", *self.code)
        hot = spread.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > self.max_unit)
        work = self.blocks(spread.join(sized(hot, "hot"), "u", "left"), "u")
        unit = F.when(F.col("m") == 1, F.col("u")).otherwise(F.xxhash64("u", "i", "j")).alias("unit")
        units = work.select(unit, "rep", *self.code).repartition(width(spark), "unit").sortWithinPartitions("unit", "rep")
        groups = materialize(connected_components(materialize(self.candidates(units), "met")).select(F.col("node").alias("rep"), F.col("component").alias("g")), "groups")

        large = sized(groups.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > self.max_unit), "large")
        members = groups.join(classes.select("rep", "cnt", "vec"), "rep")
        found = self.compare(self.units(members.join(large, "g", "left_anti").withColumn("n", F.lit(1)), "g"))
        links = materialize(found, "links").select("rep", "links", F.col("root").alias("component"))
        if large.head(1):  # groups of several units: links are summed, and components joined, over these
            members = members.join(large, "g")
            loose = sized(self.loose(groups.join(large, "g").filter(F.col("n") > 4 * self.max_unit), signed), "loose")
            found = self.compare(self.units(members.join(loose, "g", "left_anti"), "g"))
            if loose.head(1):
                met = members.drop("n").join(loose, "g", "left_semi").join(signed.select("rep", "sig"), "rep").select("*", F.posexplode("sig").alias("t", "x")).withColumn("u", F.xxhash64("g", "t", "x"))
                sizes = materialize(met.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
                found = found.unionByName(self.compare(self.units(met.join(sizes, "u"), "u")))
            found = materialize(found, "links")
            linked = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
            links = links.unionByName(found.groupBy("rep").agg(F.sum("links").alias("links")).join(linked, "rep"))
        named = classes.select("h1", "h2", "rep", "id", "cnt").join(links, "rep", "left").filter("cnt > 1 OR links IS NOT NULL")
        named = materialize(named.select("h1", "h2", "id", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("component", "rep").alias("g")), "named")
        least = named.groupBy("g").agg(F.min("id").alias("component"))
        named = materialize(named.join(least, "g").select("h1", "h2", "n_links", "component"), "least")
        out = usable.join(named, ["h1", "h2"], "left").select("id", "n_links", "component")
        # The others stay off the join, where they would meet in one task.
        out = out.unionByName(rows.filter("not ok").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component")))
        component = F.coalesce("component", "id")
        return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = EmbeddingDedup()(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.withColumnRenamed("id", "vec_id")
