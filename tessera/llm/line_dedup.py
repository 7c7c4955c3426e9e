"""Line dedup [native]: levelled sorted runs of line hashes.

Documents arrive in batches in the order of their ids. A batch's distinct keys are merge-joined with the sorted runs: keys found
there belong to an earlier document, keys not found (the anti-join) become a new run at level 0. When a level holds fan_in
runs they are merged into one run of the next level, so a key table of n batches is kept in O(log n) runs. Runs are bucketed
and sorted tables: a new batch shuffles its own keys only, never the runs.

Hot lines: keys are grouped with partial aggregation before any shuffle; the join that marks lines reads two written tables,
which lets adaptive execution split a hot key. Text moves once, by document.

Defined results. A null or empty text is one empty line. Keys under min_chars code points never count. A document is its id:
repeated rows of one id are one document, each row keeps or loses its own lines. Rows with a null id pass unchanged and own no
key. An empty table gives an empty result. Further columns pass through, whatever their names; one named like a column that is added
keeps its name, and the added one gets another underscore.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, ascii_lower, bucketed, fresh, key128, materialize, others, restore, width


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """The levelled runs of one key store. Each run is a table (h1, h2) bucketed and sorted by both, below the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = 3, buckets: int | None = None) -> None:
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets or width(spark)
        self.levels: list[list[DataFrame]] = []

    def _write(self, keys: DataFrame) -> DataFrame:
        rows = keys.select("h1", "h2").repartition(self.buckets, "h1", "h2")
        return bucketed(rows, "run", self.buckets, "h1", "h2", sort=True)

    def add(self, keys: DataFrame) -> None:
        """Add a batch's new keys as a run of level 0, then compact full levels."""
        self._place(0, self._write(keys))

    def _place(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            merged, *others = self.levels[level]
            self.levels[level] = []
            for other in others:
                merged = merged.unionAll(other)
            self._place(level + 1, self._write(merged))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def mark_seen(self, keys: DataFrame) -> DataFrame:
        """keys (with h1, h2) plus seen: whether a run holds the key. The runs are disjoint: each key is in one at most."""
        out = keys.withColumn("seen", F.lit(False))
        for run in self.runs():
            run = run.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
            out = out.hint("merge").join(run.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
            out = out.withColumn("seen", F.col("seen") | F.col("r1").isNotNull()).drop("r1", "r2")
        return out


class LineDedup:
    def __init__(self, min_chars: int = 10, n_batches: int | None = None, per_partition: int = 2000, fan_in: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
        """n_batches: by default a batch holds about per_partition documents for each shuffle partition."""
        self.min_chars, self.n_batches, self.per_partition, self.fan_in, self.id, self.text = min_chars, n_batches, per_partition, fan_in, id_col, text_col

    def lines(self, docs: DataFrame) -> DataFrame:
        """(id, th, pos, h1, h2) of every line whose key counts; th tells rows of one id apart."""
        text = F.coalesce(F.col(self.text), F.lit(""))
        rows = docs.filter(F.col(self.id).isNotNull()).select(F.col(self.id).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        rows = rows.select("id", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).filter(F.length("line") >= self.min_chars)
        h1, h2 = key128(F.col("key"))
        return rows.select("id", "th", "pos", ascii_lower(F.col("line")).alias("key")).select("id", "th", "pos", h1.alias("h1"), h2.alias("h2"))

    def apply_batch(self, lines: DataFrame, runs: LineRuns, add: bool = True) -> DataFrame:
        """(id, th, pos) of the lines of this batch that go; the batch's new keys are added to runs, unless no batch follows (add).

        lines: a written table as lines() returns it; every id of it comes after those of earlier batches.
        """
        keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
        marked = materialize(runs.mark_seen(keys), "keys")
        if add:
            runs.add(marked.filter(~F.col("seen")))
        shared = marked.filter(F.col("seen") | (F.col("owner") < F.col("last"))).select("h1", "h2", "owner", "seen")
        return lines.join(shared, ["h1", "h2"]).filter(F.col("seen") | (F.col("id") != F.col("owner"))).select("id", "th", "pos")

    def __call__(self, docs: DataFrame) -> DataFrame:
        """docs with the kept lines as text, plus _n_lines and _n_dropped (long), under the names that fresh() gives."""
        spark = docs.sparkSession
        n = self.n_batches or max(1, ceil(docs.count() / (self.per_partition * width(spark))))
        cuts = docs.agg(F.percentile_approx(self.id, [i / n for i in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []
        cuts = sorted(set(cuts))
        batch = F.lit(0)
        for c in cuts:
            batch = batch + (F.col("id") > F.lit(c)).cast("int")
        lines = materialize(self.lines(docs).withColumn("batch", batch), "lines", ("batch",))
        runs = LineRuns(spark, fan_in=self.fan_in)
        gone = None
        for b in range(len(cuts) + 1):
            part = self.apply_batch(lines.filter(F.col("batch") == b).drop("batch"), runs, b < len(cuts))
            gone = part if gone is None else gone.unionAll(part)
        gone = gone.groupBy("id", "th").agg(F.collect_list("pos").alias("gone"))

        text = F.coalesce(F.col(self.text), F.lit(""))
        rows = docs.select(others(docs, self.text), F.col(self.id).alias("id"), F.xxhash64(text).alias("th"), F.col(self.text).isNull().alias("absent"), F.split(text, "\n", -1).alias("lines"))
        # lines and gone are columns of the joined rows, so the lambda below reads them in constant time per line.
        rows = rows.join(gone, ["id", "th"], "left")
        left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
        kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
        dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct("gone")))
        return rows.select(*restore(rows, docs, **{self.text: F.when(~F.col("absent"), kept)}), F.size("lines").cast("long").alias(fresh("_n_lines", docs)), dropped.cast("long").alias(fresh("_n_dropped", docs)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = LineDedup()(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, arr[i] AS line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents), LATERAL (SELECT unnest(range(1, len(arr) + 1)) AS i)),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS n FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(o.n >= 2 AND k.doc_id <> o.owner, false) AS gone
           FROM keyed k LEFT JOIN owners o ON k.key = o.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, sum(gone::int)::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
