"""Each training-data operator on small tables with nulls, empty and long texts, repeats, ties, no rows and clashing column names."""

import hashlib
import random
import re
from collections import Counter
from math import log, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.bpe import ByteBPE, digest, load_ranks
from tessera.llm.components import connected_components
from tessera.llm.decontam import Decontaminator
from tessera.llm.embedding import EmbeddingDedup
from tessera.llm.langid import LanguageID
from tessera.llm.line_dedup import LineDedup, LineRuns
from tessera.llm.pii import KINDS, PIIFinder, written
from tessera.llm.pst import SuffixTreeLM
from tessera.llm.quality import QualityClassifier, View, content, metadata
from tessera.llm.simhash import SimHashDedup, trie_pairs
from tessera.llm.toxicity import Toxicity, windows_of

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30000))
TEXTS = [None, "", "  \n\t", "One line that repeats here\nshort\nOwn line number three", "ONE LINE THAT REPEATS HERE  \nshort\nanother own line of four", "one line that repeats here\n\n\nx", LONG, LONG, LONG + " tail", "é ÀÉ ß 日本語 \U0001f600 line of many scripts"]
CLASH = "doc_id long, text string, id string, th long, lines string, pos int, fp long, n int, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, "x", 1, "l", 2, 3, 4, "en", "s") for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[3], "x", None, None, None, None, None, None, None), (5, TEXTS[5], "x", 1, "l", 2, 3, 4, None, None)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, CLASH).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    docs.limit(0).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lines_by_force(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\f\r"))
    owner = {}
    for i, t in rows:
        if i is not None:
            for s in (t or "").split("\n"):
                owner.setdefault(key(s), set()).add(i)
    out = []
    for i, t in rows:
        kept = [s for s in (t or "").split("\n") if i is None or len(key(s)) < 10 or len(owner[key(s)]) < 2 or i == min(owner[key(s)])]
        out.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup(docs, batches):
    out = LineDedup(n_batches=batches, fan_in=2)(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    got = sorted(((r["doc_id"], r["text"] or "", r["_n_lines"], r["_n_dropped"]) for r in out.collect()), key=repr)
    assert got == lines_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert out.filter("doc_id = 0").first()["text"] is None


def test_line_dedup_clashing_names(docs):
    clash = docs.withColumns({"_n_lines": F.lit(1), "_N_dropped": F.lit(2)})
    out = LineDedup()(clash)
    assert out.columns == [*clash.columns, "__n_lines", "__n_dropped"]
    assert out.filter("_n_lines = 1 and __n_lines = 6").count() == 0 and out.filter("_n_lines = 1").count() == docs.count()


def test_line_dedup_empty(none):
    assert LineDedup()(none).count() == 0


def test_runs_compact(spark):
    runs = LineRuns(spark, fan_in=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, i)], "h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    keys = spark.createDataFrame([(i, i) for i in range(7)], "h1 long, h2 long")
    assert {r["h1"] for r in runs.mark_seen(keys).filter("seen").collect()} == set(range(5))


def test_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken

    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    op = ByteBPE(ranks, P.PATTERN, max_tokens=50)
    for table in (docs, docs.repartition(2)):  # the second is written to a table first
        got = Counter(tuple(r) for r in digest(op(table)).collect())
        want = Counter()
        for r in docs.collect():
            ids = enc.encode_ordinary(r["text"] or "")
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
        assert got == want
    assert op(none).count() == 0
    bad = docs.sparkSession.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    assert bytes(op(bad).first()["decoded"]) == "a\ufffdb".encode()


def test_decontamination(spark, docs, none):
    long_item = " ".join(LONG.split()[100:140])
    items = spark.createDataFrame([(1, "Own LINE number three"), (2, long_item), (3, None), (4, ""), (None, "short"), (2, "repeats here"), (5, "quite absent words")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    windows = {}
    for r in items.collect():
        w = word.findall(low(r["text"]))
        if r["item_id"] is not None and w:
            for k in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[k : k + 13]), set()).add(str(r["item_id"]))
    want = Counter()
    for r in docs.collect():
        w = word.findall(low(r["text"]))
        hit, found = set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                if k + size <= len(w) and tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want[r["doc_id"], len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for op in (Decontaminator(segment_words=40), Decontaminator(max_block_words=5)):
        got = Counter((r["id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in op(docs, items).collect())
        assert got == want
    assert Decontaminator()(none, items).count() == 0
    assert {r["n_hit"] for r in Decontaminator()(docs, items.limit(0)).collect()} == {0}
    near = spark.createDataFrame([(9, "one line repeats here")], "item_id long, text string")
    assert Decontaminator(slop=1)(docs, near).filter("n_hit > 0").count() == 5
    assert Decontaminator()(docs, near).filter("n_hit > 0").count() == 0


def components_by_force(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {x: root(x) for x in nodes}


def test_simhash(spark, docs, none):
    import xxhash

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    base = [f"alpha beta gamma delta number {i} of a longer text " + "same words here again " * 40 for i in range(30)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(base)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {i: fingerprint(t) for i, t in rows if i is not None}
    want = components_by_force(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    for op in (SimHashDedup(), SimHashDedup(max_node=2)):
        got = op(table).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
        assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert SimHashDedup()(none).count() == 0


def test_simhash_repeated_ids(spark):
    """Rows that share an id are nodes of their own: they join only what their own text is near to."""
    a, b = ("alpha beta gamma delta epsilon " * 30, "one two three four five six seven eight " * 30)
    rows = [(3, a), (5, a), (5, b), (12, b), (5, b)]
    got = sorted((r["doc_id"], r["component_id"]) for r in SimHashDedup()(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (5, 5), (12, 5)]


def test_trie_pairs_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    v = np.unique(np.concatenate([rng.integers(0, 2**32, 50), 2**31 ^ (1 << rng.integers(0, 32, 200)) ^ (1 << rng.integers(0, 32, 200))]))
    i, j = trie_pairs(v, np.array([0]), np.array([len(v)]), 32, 2)
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if (int(v[a]) ^ int(v[b])).bit_count() <= 2}
    assert len(i) == len(want) and {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


class ByBucket(EmbeddingDedup):
    """Compares groups of over four units within buckets whatever that costs."""

    def loose(self, members, signed):
        return members.select("g").distinct()


@pytest.mark.parametrize("unit, kind", [(1024, EmbeddingDedup), (8, EmbeddingDedup), (8, ByBucket)])
def test_embeddings(spark, unit, kind):
    rng = np.random.default_rng(2)
    center = rng.normal(size=16)
    x = np.concatenate([center + rng.normal(size=(60, 16)) * 0.2, rng.normal(size=(60, 16)), np.repeat(rng.normal(size=(1, 16)), 20, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, []), (505, [1.0, 0.0]), (None, x[0].tolist())]
    out = kind(max_unit=unit, miss=1e-6)(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = n @ n.T >= 0.9
    want = components_by_force(range(len(x)), lambda a, b: near[a, b])
    got = {r["id"]: r for r in out}
    assert len(out) == len(rows)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, want[i], want[i] == i)
    for i in range(500, 506):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert EmbeddingDedup()(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_at_default_settings(spark):
    """Groups around the threshold among unrelated vectors: no link below it, and at most one in a hundred missed."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(150, 48))
    x = np.concatenate([np.repeat(centers, 12, axis=0) + rng.normal(size=(1800, 48)) * 0.24, rng.normal(size=(1500, 48))]).astype(np.float32)
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (n @ n.T >= 0.9).sum(axis=1) - 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["id"]: r["n_links"] for r in EmbeddingDedup()(rows).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert near.sum() > 5000 and (found <= near).all() and found.sum() >= 0.99 * near.sum()


def test_embeddings_repeated_ids(spark):
    """The rows of an id that repeats are vectors of their own: each gives one row and joins only what it links with."""
    rows = [(7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.01]), (9, [1.0, 0.02, 0.0]), (2, [0.0, 0.0, 1.0])]
    out = EmbeddingDedup(miss=1e-6)(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in out) == [(2, 0, 2, True), (3, 1, 3, True), (7, 1, 3, False), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]


def scores_by_force(rows, min_count=4, gain=3.0, discount=0.5):
    """rows (id, train, text) -> (id, n_tokens, n_known, train_tokens, base_score, score) of each; and how many contexts of each length are retained."""
    split = lambda t: (t or "").encode().lower().split()
    single = Counter(w for _, train, t in rows if train for w in split(t))
    n_docs = sum(train for _, train, _ in rows)
    once, twice = (sum(c == k for c in single.values()) for k in (1, 2))
    off = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    if n_docs:
        single[None] = n_docs  # the end
    tokens, distinct = sum(single.values()), len(single)
    root = lambda w: (single[w] - off if w in single else off * distinct) / tokens
    grams = [Counter(), Counter()]
    for _, train, t in rows:
        q = ["<", *split(t), None]
        for d in (1, 2) if train else ():
            grams[d - 1].update(tuple(q[i - d : i + 1]) for i in range(d, len(q)))
    found = [{g: n for g, n in x.items() if n >= min_count} for x in grams]
    kept, share = [{}, {}], [{}, {}]
    total = lambda c: found[0][c] if len(c) == 2 else n_docs if c == ("<",) else single[c[0]]

    def p_of(w, context):
        p = root(w)
        for d in (1, 2):
            c = context[-d:]
            if len(c) < d or c not in kept[d - 1]:
                break
            p = kept[d - 1][c] * p + share[d - 1].get((*c, w), 0)
        return p

    for d in (1, 2):
        entries = {}
        for g, n in found[d - 1].items():
            if d == 1 or g[1:2] in kept[0]:
                entries.setdefault(g[:-1], []).append((g[-1], n))
        sure = {c: x for c, x in entries.items() if sum(n * log(n / total(c) / p_of(w, c[1:])) for w, n in x) >= gain * len(x)}
        for c, x in sure.items():
            share[d - 1].update({(*c, w): (n - discount) / total(c) for w, n in x})
        kept[d - 1] = {c: 1 - sum((n - discount) / total(c) for _, n in x) for c, x in sure.items()}
    out = []
    for i, _, t in rows:
        q = ["<", *split(t), None]
        base = sum(log10((single[w] + 1) / (tokens + distinct + 1)) for w in q[1:])
        score = sum(log10(p_of(q[k], tuple(q[max(0, k - 2) : k]))) for k in range(1, len(q))) if tokens else 0.0
        out.append((i, len(q) - 1, sum(single[w] > 0 for w in q[1:]), tokens, round(base, 4), round(score, 4)))
    return out, [len(x) for x in kept]


def spoken(n=240):
    rng = np.random.default_rng(4)
    parts = {"aa": ["sha", "ren", "tion", "the"], "bb": ["eau", "oui", "que", "ch"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        words = ["".join(rng.choice(parts[lang], 3)) for _ in range(40)]
        bad, poor = i % 6 == 0, i % 5 == 0
        if bad:
            words[5:5] = ["grumbleworm", "nastybeast"]
        if poor:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang, "s", int(bad), int(not poor)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(spoken(), "doc_id long, text string, lang string, source string, toxic int, quality int")


def test_language(spark, labelled, docs, none):
    op = LanguageID(per_language=60)
    model = op.learn(labelled, F.col("doc_id") % 5 != 0)
    held = op.predict(labelled.filter("doc_id % 5 = 0"), model)
    assert held.filter("_lang = lang").count() >= 0.95 * held.count()
    got = {r["doc_id"]: r["_lang"] for r in op.predict(docs, model).collect()}
    assert [got[i] for i in range(3)] == ["und"] * 3 and op.predict(none, model).count() == 0
    assert op.predict(docs, model).columns == [*docs.columns, "_lang", "_score", "_rejected"]
    assert {r["_rejected"] for r in op.predict(spark.createDataFrame([(1, "z" * 500), (2, "\u042d\u0442\u043e \u0442\u0435\u043a\u0441\u0442 " * 20)], "doc_id long, text string"), model).collect()} == {True}
    assert not op.predict(labelled.filter("doc_id % 5 = 0"), model).filter("_rejected").count()
    clash = docs.withColumns({"_lang": F.lit(1), "_letters": F.lit(2), "_Score": F.lit(3)})
    out = op.predict(clash, model)
    assert out.columns == [*clash.columns, "__lang", "__score", "_rejected"] and out.filter("_lang = 1 and _letters = 2").count() == docs.count()
    assert op.learn(none, F.lit(True)) is None and op.predict(docs, None).filter("_lang = 'und'").count() == docs.count()


def test_toxicity(spark, labelled, docs, none):
    op = Toxicity()
    model = op.learn(labelled, labelled.filter("doc_id % 4 != 2"))
    got = {r["id"]: r["score"] for r in op.score(labelled, model).collect()}
    right = [(got[r[0]] >= 0.3) == bool(r[4]) for r in spoken() if r[0] % 4 == 2]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r["score"] <= 1 for r in op.score(docs, model).collect()) and op.score(none, model).count() == 0
    nothing = op.learn(labelled, labelled.limit(0))
    assert {round(r["score"], 6) for r in op.score(docs, nothing).collect()} == {0.0}
    # Ids that repeat, with labels that disagree, and rows that teach nothing.
    odd = labelled.select("doc_id", "toxic").unionAll(spark.createDataFrame([(0, 0), (0, 1), (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int"))
    again = labelled.select("doc_id", "text").unionAll(labelled.filter("doc_id < 9").select("doc_id", F.lit("other words here").alias("text")))
    assert op.score(again, op.learn(again, odd)).count() == again.count()


def test_toxic_windows_are_those_of_the_rule():
    text = "A b, c; d-e f!".encode()
    assert windows_of(text, 4, 3) == [b" a b c d ", b" d e f "]
    assert windows_of(text, 6, 5) == [b" a b c d e f "] and windows_of(b"?! 1", 4, 3) == [] and windows_of(None, 4, 3) == []
    words = [f"{chr(97 + i % 26)}x" for i in range(101)]
    own = windows_of(" ".join(words).encode(), 24, 20)
    assert {w for x in own for w in x.split()} == {w.encode() for w in words} and all(len(x.split()) <= 24 for x in own)


def test_quality(labelled, docs, none):
    op = QualityClassifier()
    model = op.learn(labelled, labelled.filter("doc_id % 3 != 0"), F.col("doc_id") % 4 != 2)
    got = {r["id"]: r["score"] for r in op.score(labelled, model).collect()}
    right = [(got[r[0]] >= 0.5) == bool(r[5]) for r in spoken() if r[0] % 4 == 2]
    assert sum(right) >= 0.95 * len(right)
    assert op.score(docs, model).count() == docs.count() and op.score(none, model).count() == 0
    assert {r["score"] for r in op.score(docs, op.learn(labelled, labelled.limit(0), F.lit(True))).collect()} == {0.5}
    odd = labelled.select("doc_id", "quality").unionAll(labelled.sparkSession.createDataFrame([(0, 0), (0, 1), (None, 1), (3, None), (10**6, 1)], "doc_id long, quality int"))
    again = labelled.unionAll(labelled.filter("doc_id < 9").withColumn("text", F.lit("OTHER WORDS!!")))
    assert op.score(again, op.learn(again, odd, F.col("doc_id") % 4 != 2)).count() == again.count()


def test_pseudo_labels_are_the_surest_rows(labelled):
    """Every row without a label can be one: the lists are the global top of both views."""
    op = QualityClassifier(batch=5, sure=0.5)
    marked = labelled.filter("doc_id % 3 != 0")
    y, a, b = op.views(labelled, op.rows(labelled).join(marked.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id").select("y", "id", "th"))
    views = [View.fit(x, y.astype(float), 3.0) for x in (a, b)]
    lists = op.surest(labelled, marked.select(F.col("doc_id").alias("id")), views, set())
    p = {}
    for r in labelled.filter("doc_id % 3 = 0").collect():
        x = content(r["text"].encode()), metadata(r["text"].encode(), r["source"], r["lang"])
        p[r["doc_id"]] = [1 / (1 + np.exp(-v.margin(k[None, :])[0])) for v, k in zip(views, x)]
    for n, own in enumerate(lists):
        sign = 1 if n % 2 == 0 else -1
        best = sorted((sign * v[n // 2] for v in p.values() if sign * v[n // 2] >= (0.5 if sign > 0 else -0.5)), reverse=True)[:10]
        assert np.allclose(sorted((sign * p[i][n // 2] for i, _ in own), reverse=True), best)


def test_suffix_tree(spark, docs, none):
    """Scores against a tree of dictionaries, on texts with planted regularities, in small blocks and large ones."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    place = {w: i for i, w in enumerate(words)}
    rows = []
    for i in range(300):
        t = [r.choice(words)]
        for _ in range(r.randint(0, 30)):
            follows = words[(place.get(t[-1], 3) * 5 + 1 + (place.get(t[-2], 0) if len(t) > 1 else 0)) % 12]
            t.append(follows if r.random() < 0.6 else r.choice([*words, f"x{r.randint(0, 300)}"]))
        rows.append((i, " ".join(t) if i % 17 else None))
    rows += [(5, "W1 w2"), (None, "w1 w2 w3")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for own, rows in ((table, rows), (docs, [(x["doc_id"], x["text"]) for x in docs.collect()])):
        want, contexts = scores_by_force([(i, i is not None and i % 7 != 2, t) for i, t in rows], gain=0.2)
        assert own is docs or min(contexts) > 10
        for size in (100, 1_000_000):
            out = SuffixTreeLM(max_tokens=size, gain=0.2)(own, F.col("doc_id") % 7 != 2).collect()
            got = [(x["id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 4), round(x["score"], 4)) for x in out]
            assert sorted(got, key=repr) == sorted(want, key=repr)
    assert SuffixTreeLM()(none, F.lit(True)).count() == 0
    assert {x["score"] for x in SuffixTreeLM()(table, F.lit(False)).collect()} == {0.0}


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def spans_by_force(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            g = re.sub("[^0-9]", "", m[0])
            double = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(g)))
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(g) <= 19 and double % 10 == 0) or k == 3 and not 9 <= len(g) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii(spark, docs, none):
    texts = [None, "", "a@b.c+x@d.e", "1.2.3.4.5.6.7.8 a@b.c.", "é\U0001f600 4111 1111 1111 1111 +1 (988) 555-2485", "call 555-123-4567 or write to me [at] host [dot] com", "999.1.1.1 00010.2.3.4", "x" * 20000 + "@" + "9" * 20000 + " " + "1 " * 10000 + " a@b.co" * 300, "+1+2+3 (4) 567 890 12", "order no. 123-456-78901 at 12:30:45:10"]
    op = PIIFinder()
    model = op.fit(spark)
    found = op(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    got = {r["id"]: (r["b"], r["s"]) for r in found.select("id", written("base").alias("b"), written("spans").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == spans_by_force(t or "")
        assert set(filter(None, got[i][0].split(","))) <= set(got[i][1].split(","))
    assert got[5][1].count(":") == 4 and got[9][1] == ""
    assert op.redact(found.filter("id = 4")).first()["redacted"] == "é\U0001f600 [CARD] [PHONE]"
    assert op(docs, model).count() == docs.count() and op(none, model).count() == 0


def test_pii_zero_parts(spark):
    """A part of an address may be zero, however long; only parts over 255 are barred."""
    texts = ["10.0.0.1", "0.0.0.0", "1.2.3.000", "192.168.0.1 127.0.0.1 8.8.8.0", "0.0.0.256 256.0.0.0 0.0.0.0255 00.1.2.3", "10.20.30.40 1.2.3.4 1.00260.3.4", "0." + "0" * 4000 + ".0.1"]
    found = PIIFinder().proposals(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    for r in found.select("id", written("_base").alias("b")).collect():
        assert r["b"] == spans_by_force(texts[r["id"]])
        assert r["id"] > 3 or r["b"].count("ip:") == texts[r["id"]].count(" ") + 1
