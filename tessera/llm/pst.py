"""Language-model scoring by a probabilistic suffix tree over tokens.

The root holds every token of the training documents; one further outcome stands for all unknown words, as in the base score. Its
distribution is discounted by the Good-Turing estimate, and what is taken off is the unknown outcome's. Deeper states are contexts of one
or two preceding tokens (the start of a text is one). A string of two or three tokens is a candidate if it occurs at least min_count times
in the training texts, so the tree grows with the corpus. A context is retained if its distribution diverges from that of its suffix: the
gain in log-likelihood must exceed `gain` nats for each of its candidates. Retained contexts pass the mass of symbols they don't list, and
of an absolute discount, on to their suffix, so every state's distribution sums to one. A token is scored in the longest retained suffix
of what precedes it.

Nothing of the tree is broadcast or collected: it is made of written tables and joined by shuffle. Counts cover all training documents.

1. Blocks send their distinct words with counts to buckets (see blocks.py). A bucket adds them up, numbers the words of at least min_count
   and answers each block. Blocks then lie coded, by their number, in a bucketed table, and later answers join them where they are.
2. For each depth, blocks send their distinct strings of numbered tokens, with counts, to buckets by string (so no context is hot). A
   bucket adds them up and answers each block with the counts of the candidates. Strings with a part that is no candidate are not sent.
   Candidates, their contexts and the divergence tests are joins and grouped sums of written tables. Then blocks ask for their distinct
   contexts, and learn which are retained and what they pass on.
3. Documents sum over their tokens.

Defined results. A null or empty text has one token, its end. Rows with a null id are scored, not learned from and not held out. With
nothing to learn from every probability is one. Every row gives one row, also for repeated ids. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import BlockTable, pack, planes, split_words, unpack, unplanes
from tessera.llm.common import bucketed, crc_mod, frugal, materialize, width

#: Numbers of tokens; words follow. A string of two fits 62 bits.
END, START, FIRST, BITS = 0, 1, 2, 31
MASK = (1 << BITS) - 1
ROWS = "kind int, block long, bucket int, payload binary"
#: Kinds of rows: strings and contexts that blocks send, and what goes back for them; what a bucket found.
STRING, CONTEXT, FOUND = 0, 1, 2


def tokenize(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z, and the six ASCII blanks


def bucket_of(context, symbol, buckets: int):
    """The bucket of a string, for arrays and for columns alike."""
    return ((context % 1_000_003) * 7919 + (symbol % 998_244_353) * 104_729) % buckets


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by bucket, where each bucket begins in it)."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def to_buckets(kind: int, block: int, bucket: np.ndarray, buckets: int, payload) -> list[tuple]:
    """A row for each bucket; payload(at): the parts that the places `at` send."""
    order, cuts = dealt(bucket, buckets)
    return [(kind, block, j, pack(*payload(order[cuts[j] : cuts[j + 1]]))) for j in np.flatnonzero(np.diff(cuts)).tolist()]


def from_buckets(answers: list[dict] | None, bucket: np.ndarray, buckets: int, width: int = 1) -> list[np.ndarray]:
    """The buckets' answers, `width` numbers each, in the order of what was sent."""
    order, cuts = dealt(bucket, buckets)
    out, got = [np.zeros(len(order), np.int64) for _ in range(width)], 0
    for a in answers or ():
        at = order[cuts[a["bucket"]] : cuts[a["bucket"] + 1]]
        p = unpack(a["payload"])
        for k in range(width):
            out[k][at] = unwide(p[8 * k : 8 * k + 8])
        got += len(at)
    if got != len(order):
        raise RuntimeError("a bucket's answer is missing")
    return out


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["kind", "block", "bucket", "payload"])


def by_bucket(batches, close):
    """Rows (block, bucket, ..., payload) sorted by bucket -> close(bucket, [(block, row as a dict)]) for each bucket, which are held compressed."""
    held, bucket = [], None
    for b in batches:
        for row in b.to_pylist():
            if row["bucket"] != bucket and held:
                yield from close(bucket, held)
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield from close(bucket, held)


def wide(x: np.ndarray) -> list[bytes]:
    return [*planes(x & 0xFFFFFFFF), *planes(x >> 32 & 0xFFFFFFFF)]


def unwide(p: list[bytes]) -> np.ndarray:
    return unplanes(p[:4]).astype(np.int64) | unplanes(p[4:8]).astype(np.int64) << 32


class Coded:
    """A block as tokens: for each symbol to score (words and ends) its number or -1, training count, document and what precedes it."""

    def __init__(self, flags: list, lengths: np.ndarray, payload: bytes, n_docs: int) -> None:
        p = unpack(payload)
        seq = unplanes(p[:4]).astype(np.int64)
        count = np.append(unwide(p[4:12]), (n_docs, n_docs))
        number = np.append(unplanes(p[12:]).astype(np.int64) - 1, (END, START))
        n = len(number) - 2
        ends = np.cumsum(lengths)
        tokens = np.insert(seq, ends, n)  # each text as start, words, end
        starts = np.concatenate(([0], (ends + np.arange(1, len(ends) + 1))[:-1])) if len(ends) else ends
        tokens = np.insert(tokens, starts, n + 1)
        self.doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        real = tokens != n + 1
        symbol = number[tokens]
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths + 2) - (lengths + 2), lengths + 2)
        self.symbol, self.count = symbol[real], count[tokens[real]]
        self.before = [np.where(place >= k, np.roll(symbol, k), -1)[real] for k in (1, 2)]
        self.count_before = np.roll(count[tokens], 1)[real]
        self.counted = np.repeat(np.array([bool(f) for f in flags], bool), lengths + 1)


class Strings:
    """Distinct (context, symbol) of a block, sorted, with their training counts; and its distinct contexts. -1 stands for none."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, counted: np.ndarray) -> None:
        own, inverse = np.unique(context, return_inverse=True)
        none = int(np.searchsorted(own, 0))  # 1 if some token has no context
        ok = (context >= 0) & (symbol >= 0)
        key, place = np.unique(inverse[ok].astype(np.int64) << BITS | symbol[ok], return_inverse=True)
        self.n = np.bincount(place, weights=counted[ok], minlength=len(key)).astype(np.int64)
        self.context, self.symbol, self.contexts = own[key >> BITS], key & MASK, own[none:]
        self.of_string = np.full(len(context), -1)  # of each token, into the arrays above
        self.of_string[ok] = place
        self.of_context = inverse - none

    def sent(self, block: int, buckets: int) -> pa.RecordBatch:
        strings = to_buckets(STRING, block, bucket_of(self.context, self.symbol, buckets), buckets, lambda at: [*wide(np.diff(self.context[at], prepend=0)), *planes(self.symbol[at]), *planes(self.n[at])])
        return row_batch(strings + to_buckets(CONTEXT, block, bucket_of(self.contexts, 0, buckets), buckets, lambda at: wide(np.diff(self.contexts[at], prepend=0))))

    def counts(self, answers: list[dict] | None, buckets: int) -> np.ndarray:
        """Of each token's string the training count, 0 if it is no candidate."""
        return valued(self.of_string, from_buckets(answers, bucket_of(self.context, self.symbol, buckets), buckets)[0])

    def listed(self, answers: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token's context how many occurrences its candidates have, and how many they are; 0 if it isn't retained."""
        total, size = from_buckets(answers, bucket_of(self.contexts, 0, buckets), buckets, 2)
        return valued(self.of_context, total), valued(self.of_context, size)


def valued(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.append(values, 0)[at]  # -1: the last


class SuffixTreeLM:
    def __init__(self, min_count: int = 4, depth: int = 2, gain: float = 3.0, discount: float = 0.5, max_tokens: int = 700_000) -> None:
        if not 1 <= depth <= 2:
            raise ValueError("contexts have one or two tokens")
        self.min_count, self.depth, self.gain, self.discount, self.max_tokens = max(1, min_count), depth, gain, discount, max_tokens

    def numbered(self, words: DataFrame, buckets: int, parts: int) -> DataFrame:
        """Rows of two kinds, a written table. block -1, a row per bucket: sums over its distinct words and the counts of those it numbers. Others, a
        row per block and bucket: of each of the block's words the training count, and its number if it has min_count.
        """
        least = self.min_count

        def close(bucket, rows):
            total: dict[bytes, int] = {}
            own = []
            for r in rows:
                lengths, blob, count = unpack(r["payload"])
                own.append(split_words(lengths, blob))
                for w, n in zip(own[-1], np.frombuffer(count, np.uint32).tolist()):
                    total[w] = total.get(w, 0) + n
            order = sorted(total, key=lambda w: (-total[w], w))  # a word's place in it makes its number
            if FIRST + sum(n >= least for n in total.values()) * buckets >= MASK:
                raise ValueError("too many distinct words of min_count for their numbers")
            c = np.fromiter(map(total.__getitem__, order), np.int64, len(order))
            place = dict(zip(order, range(len(order))))
            out = [(-1, bucket, len(c), 0, int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum()), pack(*wide(c[c >= least])))]
            for r, ws in zip(rows, own):
                at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
                number = np.where(c[at] >= least, FIRST + at * buckets + bucket, -1)
                out.append((r["block"], bucket, r["n"], r["mark"], 0, 0, 0, 0, pack(*wide(c[at]), *planes(number + 1))))
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

        names = ["block", "bucket", "n", "mark", "tokens", "known", "once", "twice", "payload"]
        rows = words.repartition(parts, "bucket").sortWithinPartitions("bucket")
        return materialize(rows.mapInArrow(frugal(lambda batches: by_bucket(batches, close)), "block long, bucket int, n int, mark long, tokens long, known long, once long, twice long, payload binary"), "numbered")

    def numbers(self, totals: DataFrame, buckets: int) -> DataFrame:
        """(w, c): number and training count of each word of at least min_count."""

        def run(batches):
            for b in batches:
                for bucket, payload in zip(b.column(0).to_pylist(), b.column(1)):
                    count = unwide(unpack(payload.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(FIRST + np.arange(len(count)) * buckets + bucket), pa.array(count)], ["w", "c"])

        return totals.select("bucket", "payload").mapInArrow(frugal(run), "w long, c long")

    def code(self, table: BlockTable, sequences: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
        """The blocks with numbers and counts of their words: a table bucketed by block, so that later answers move and it doesn't."""

        def finish(number, ids, flags, lengths, seq, per):
            n = sum(len(at) for at, _ in per)
            count, numbers = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for at, payload in per:
                p = unpack(payload)
                count[at], numbers[at] = unwide(p[:8]), unplanes(p[8:])
            row = ((number, pa.int64()), (ids, pa.list_(pa.int64())), (flags, pa.list_(pa.bool_())), (lengths.tolist(), pa.list_(pa.int32())), (pack(*planes(seq), *wide(count), *planes(numbers)), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], ["block", "ids", "flags", "lengths", "payload"])

        schema = "block long, ids array<long>, flags array<boolean>, lengths array<int>, payload binary"
        return bucketed(table.assemble(answers, finish, schema, parts, numbered=True, sequences=sequences), "blocks", parts, "block")

    def of_blocks(self, blocks: DataFrame, n_docs: int, use, schema: str) -> DataFrame:
        """use(row, x) yields batches for each block: its row, with the answers that are joined to it, and its tokens."""

        def run(batches):
            for b in batches:
                for k in range(b.num_rows):
                    row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                    yield from use(row, Coded(row["flags"], np.array(row["lengths"], np.int64), row["payload"], n_docs))

        return blocks.mapInArrow(frugal(run), schema)

    def counted(self, sent: DataFrame, parts: int) -> DataFrame:
        """A written table: FOUND, a row per bucket with its candidates, which have at least min_count occurrences; STRING, a row per block and bucket
        with the count of each string, 0 if it is none; and the CONTEXT rows as they came.
        """
        least = self.min_count

        def close(bucket, rows):
            out = [(CONTEXT, r["block"], bucket, r["payload"]) for r in rows if r["kind"] == CONTEXT]
            rows = [(r["block"], strings_in(r["payload"])) for r in rows if r["kind"] == STRING]
            if rows:
                context, symbol, n = (np.concatenate([x[k] for _, x in rows]) for k in range(3))
                own, inverse = np.unique(context, return_inverse=True)
                key, place = np.unique(inverse.astype(np.int64) << BITS | symbol, return_inverse=True)
                total = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)  # exact below 2^53
                keep = total >= least
                found = own[key[keep] >> BITS], key[keep] & MASK, total[keep]
                out.append((FOUND, -1, bucket, pack(*(x for f in found for x in wide(f)))))
                answer, at = np.where(keep, total, 0)[place], 0
                for block, (x, *_) in rows:
                    out.append((STRING, block, bucket, pack(*wide(answer[at : at + len(x)]))))
                    at += len(x)
            yield row_batch(out)

        return materialize(sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(lambda batches: by_bucket(batches, close)), ROWS), "counted")

    def candidates(self, counted: DataFrame) -> DataFrame:
        """(context, symbol, n)"""

        def run(batches):
            for b in batches:
                for payload in b.column(0):
                    p = unpack(payload.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(unwide(p[8 * k : 8 * k + 8])) for k in range(3)], ["context", "symbol", "n"])

        return materialize(counted.filter(F.col("kind") == FOUND).select("payload").mapInArrow(frugal(run), "context long, symbol long, n long"), "candidates")

    def tested(self, strings: DataFrame) -> DataFrame:
        """strings(context, symbol, n, total, lower: the suffix's probability) -> the contexts that are retained: (context, listed, size, passed)."""
        won = F.col("n") * F.log(F.col("n") / F.col("total") / F.col("lower"))
        sums = strings.groupBy("context").agg(F.sum(won).alias("won"), F.count("*").alias("size"), F.sum("n").alias("listed"), F.max("total").alias("total"))
        passed = 1 - (F.col("listed") - self.discount * F.col("size")) / F.col("total")
        return materialize(sums.filter(F.col("won") >= self.gain * F.col("size")).select("context", "listed", "size", passed.alias("passed")), "contexts")

    def told(self, counted: DataFrame, kept: DataFrame, buckets: int, parts: int) -> DataFrame:
        """CONTEXT rows: of each context that a block asks for how many occurrences its candidates have, and how many they are, or 0."""
        rows = kept.select("context", "listed", "size", bucket_of(F.col("context"), F.lit(0), F.lit(buckets)).cast("int").alias("bucket"))

        def packed(batches):
            def close(bucket, rows):
                x = [np.array([r[c] for r in rows], np.int64) for c in ("context", "listed", "size")]
                yield row_batch([(FOUND, -1, bucket, pack(*wide(np.diff(x[0], prepend=0)), *wide(x[1]), *wide(x[2])))])

            yield from by_bucket(batches, close)

        tree = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "context").mapInArrow(frugal(packed), ROWS)
        both = tree.unionByName(counted.filter(F.col("kind") == CONTEXT)).repartition(parts, "bucket").sortWithinPartitions("bucket", "block")

        def run(batches):
            known, bucket = None, None
            for b in batches:
                out = []
                for row in b.to_pylist():
                    p = unpack(row["payload"])
                    context = np.cumsum(unwide(p[:8]))
                    if row["block"] < 0:
                        known, bucket = (context, unwide(p[8:16]), unwide(p[16:24])), row["bucket"]
                        continue
                    answer = np.zeros((2, len(context)), np.int64)
                    if row["bucket"] == bucket:
                        at = np.minimum(np.searchsorted(known[0], context), len(known[0]) - 1)
                        hit = known[0][at] == context
                        answer[0, hit], answer[1, hit] = known[1][at[hit]], known[2][at[hit]]
                    out.append((CONTEXT, row["block"], row["bucket"], pack(*wide(answer[0]), *wide(answer[1]))))
                if out:
                    yield row_batch(out)

        return both.mapInArrow(frugal(run), ROWS)

    def back(self, rows: DataFrame, name: str, parts: int) -> DataFrame:
        """Answers as (of, name): a list for each block; a table that lies like the blocks."""
        lists = rows.repartition(parts, "block").groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("bucket", "payload")).alias(name))
        return bucketed(lists, name, parts, "of")

    def __call__(self, docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, train, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs; learns where train is true."""
        spark = docs.sparkSession
        parts = width(spark)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("flag"), F.col(text_col).cast("string").alias("text"))
        n_docs = rows.filter("flag").count()
        table = BlockTable(rows, tokenize, self.max_tokens)
        buckets = table.buckets
        stored = table.stored()
        numbered = self.numbered(stored.filter("bucket >= 0").select("bucket", "block", "n", "mark", "payload"), buckets, parts)
        totals = numbered.filter("block < 0")
        tokens, distinct, once, twice = (x or 0 for x in totals.agg(*(F.sum(c) for c in ("tokens", "known", "once", "twice"))).first())
        tokens, distinct = tokens + n_docs, distinct + (n_docs > 0)
        off = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        blocks = self.code(table, stored.filter("bucket < 0"), numbered.filter("block >= 0"), parts)

        def with_answers(df: DataFrame, answers: DataFrame) -> DataFrame:
            return df.hint("merge").join(answers.hint("merge"), df["block"] == answers["of"], "left").drop("of")

        # The level of two tokens.
        ends = spark.range(1).select(F.explode(F.array(F.lit(END).cast("long"), F.lit(START).cast("long"))).alias("w"), F.lit(n_docs).cast("long").alias("c"))
        counts = materialize(self.numbers(totals, buckets).unionByName(ends), "counts")
        first = lambda x: Strings(x.before[0], x.symbol, x.counted)
        counted = self.counted(self.of_blocks(blocks.drop("ids"), n_docs, lambda row, x: [first(x).sent(row["block"], buckets)], ROWS), parts)
        found = self.candidates(counted)
        strings = found.join(counts.select(F.col("w").alias("symbol"), ((F.col("c") - off) / max(1, tokens)).alias("lower")), "symbol").join(counts.select(F.col("w").alias("context"), F.col("c").alias("total")), "context")
        strings = materialize(strings.select("context", "symbol", "n", "total", "lower"), "strings")
        kept = self.tested(strings)
        strings_of = F.col("kind") == STRING
        blocks = with_answers(blocks, self.back(counted.filter(strings_of), "n1", parts))
        blocks = with_answers(blocks, self.back(self.told(counted, kept, buckets, parts), "c1", parts))
        if self.depth == 2:  # of three: the context is two numbers, its suffix the later one

            def second(row, x):
                own = first(x)
                yield deeper(x, own.counts(row["n1"], buckets), own.listed(row["c1"], buckets)).sent(row["block"], buckets)

            counted = self.counted(self.of_blocks(blocks.drop("ids"), n_docs, second, ROWS), parts)
            share = (F.col("n") - self.discount) / F.col("total")
            entries = strings.join(kept.select("context", "passed"), "context").select(F.col("context").alias("b"), "symbol", (share + F.col("passed") * F.col("lower")).alias("lower"))
            triples = self.candidates(counted).withColumns({"a": F.shiftright("context", BITS), "b": F.col("context").bitwiseAND(F.lit(MASK).cast("long"))})
            triples = triples.join(entries, ["b", "symbol"]).join(found.select(F.col("context").alias("a"), F.col("symbol").alias("b"), F.col("n").alias("total")), ["a", "b"])
            kept = self.tested(triples.select("context", "symbol", "n", "total", "lower"))
            blocks = with_answers(blocks, self.back(counted.filter(strings_of), "n2", parts))
            blocks = with_answers(blocks, self.back(self.told(counted, kept, buckets, parts), "c2", parts))
        room, depth, discount = tokens + distinct + 1, self.depth, self.discount

        def scored(row, x):
            size = len(row["lengths"])
            p = np.where(x.count > 0, x.count - off, off * distinct) / tokens if tokens else np.ones(len(x.count))
            own = first(x)
            n = own.counts(row["n1"], buckets)
            listed = own.listed(row["c1"], buckets)
            p = descended(p, n, x.count_before, *listed, discount)
            if depth == 2:
                second = deeper(x, n, listed)
                p = descended(p, second.counts(row["n2"], buckets), earlier(x, n), *second.listed(row["c2"], buckets), discount)
            total = lambda y: np.bincount(x.doc, y, minlength=size)
            cols = [pa.array(row["ids"], pa.int64()), pa.array(row["flags"], pa.bool_()), pa.array(np.array(row["lengths"], np.int64) + 1), pa.array(total(x.count > 0).astype(np.int64)), pa.array(np.full(size, tokens, np.int64)), pa.array(total(np.log10((x.count + 1) / room))), pa.array(total(np.log10(p)))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return self.of_blocks(blocks, n_docs, scored, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def strings_in(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = unpack(payload)
    return np.cumsum(unwide(p[:8])), unplanes(p[8:12]).astype(np.int64), unplanes(p[12:]).astype(np.int64)


def descended(p: np.ndarray, n: np.ndarray, total: np.ndarray, listed: np.ndarray, size: np.ndarray, discount: float) -> np.ndarray:
    """P in the deeper context where it is retained: what it passes on, and its own share of the symbol."""
    kept = size > 0
    total = np.where(kept, total, 1)
    return np.where(kept, (1 - (listed - discount * size) / total) * p + np.where(n > 0, (n - discount) / total, 0.0), p)


def earlier(x: Coded, n: np.ndarray) -> np.ndarray:
    """Of each symbol the count of the string that the two tokens before it make."""
    return np.where(np.diff(x.doc, prepend=-1) == 0, np.roll(n, 1), 0)


def deeper(x: Coded, n: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> Strings:
    """The strings of three tokens whose parts are candidates: the context, -1 unless it is one and its suffix is retained, and the symbols that the suffix lists."""
    a, b = x.before[1], x.before[0]
    ok = (a >= 0) & (b >= 0) & (earlier(x, n) > 0) & (listed[1] > 0)
    return Strings(np.where(ok, a << BITS | b, -1), np.where(n > 0, x.symbol, -1), x.counted)


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = SuffixTreeLM()(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train") & F.col("id").isNotNull()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
