"""The registered queries and the pipeline against independent statements of their results, on a small folder of tables.

The tables hold nulls, empty, long and repeated texts, repeated ids, benchmark passages, near copies, and labels that disagree.
"""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_operators import LONG, TEXTS, components_by_force, lines_by_force, scores_by_force, spans_by_force, spoken

from tessera.llm.bpe import load_ranks
from tessera.llm.langid import LanguageID
from tessera.llm.quality import QualityClassifier
from tessera.llm.registry import QUERIES
from tessera.llm.toxicity import LETTERS, Toxicity

ITEMS = [("a", " ".join(f"Bench{i}" for i in range(20))), ("b", "one line THAT repeats here"), ("c", None), ("d", " ".join(LONG.split()[500:530])), (None, "no id")]
MAIL = " write to a.b@c.org or +49 (30) 123-45678 from 10.0.0.1, card 4111 1111 1111 1111"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars)"""
    out = [(r[0] + 100, r[1], r[2], r[3]) for r in spoken()]
    out += [(i, t, "aa", "s") for i, t in enumerate(TEXTS)]
    base = " ".join(spoken()[0][1].split() * 6)
    out += [(400 + i, base + (f" tail{i}" if i % 3 == 0 else ""), "aa", None) for i in range(12)]
    out += [(450, base + "\n" + ITEMS[0][1], "aa", "s"), (451, ITEMS[0][1], None, "s"), (452, "x " + ITEMS[0][1].upper() + MAIL, "bb", "s"), (453, spoken()[1][1] + MAIL, "bb", "s")]
    out += [(5, base, "aa", "s"), (101, "Some shared line of text\n" + spoken()[3][1], "bb", "t"), (102, "some shared LINE of text \nshort", "bb", "t"), (103, spoken()[3][1], "bb", "t"), (103, spoken()[3][1], "bb", "u"), (None, base, "aa", "s"), (None, None, None, None)]
    out += [(460, "z" * 300, "aa", "s"), (461, "12 34 56", "bb", "s")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(size=(20, 24)), 6, axis=0) + rng.normal(size=(120, 24)) * 0.2, rng.normal(size=(80, 24))]).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [math.inf] * 24), (3, x[50].tolist())]


@pytest.fixture(scope="module")
def sf(spark, rows, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0] + 100, r[4], r[5]) for r in spoken()] + [(100, 1, 1), (100, 0, 0), (None, 1, 0), (10**7, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def result(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def tuples(got, *columns):
    return sorted((tuple(r[c] for c in columns) for r in got), key=repr)


def test_line_dedup(spark, sf, rows):
    want = [(i, n, dropped, sha(text)) for i, text, n, dropped in lines_by_force([(r[0], r[1]) for r in rows])]
    assert tuples(result(spark, sf, "op1_line_dedup"), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


@pytest.fixture(scope="module")
def encoding():
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(encoding, pairs):
    out = []
    for i, t in pairs:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    return sorted(out, key=repr)


def test_byte_bpe(spark, sf, rows, encoding):
    assert tuples(result(spark, sf, "op2_byte_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == digests(encoding, [(r[0], r[1]) for r in rows])


def hits_by_force(text):
    """(words, hit words, items)"""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, t in ITEMS:
        own = find(t) if item is not None else []
        size = min(13, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at] == own[k] and words[at : at + size] == own[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def contaminated(text):
    n, hit, _ = hits_by_force(text)
    return hit > 0 and 20 * hit >= n


def test_decontamination(spark, sf, rows):
    want = []
    for r in rows:
        n, hit, found = hits_by_force(r[1])
        want.append((r[0], n, hit, len(found), sha(",".join(found)), contaminated(r[1])))
    assert tuples(result(spark, sf, "op3_decontaminate"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)


def fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups_by_force(pairs):
    """For each (id, text): its fingerprint and the class of its row, None with a null id."""
    fp = {t: fingerprint(t) for _, t in pairs}
    own = sorted({fp[t] for i, t in pairs if i is not None})
    root = components_by_force(own, lambda a, b: (a ^ b).bit_count() <= 2)
    return [(fp[t], None if i is None else root[fp[t]]) for i, t in pairs]


def test_simhash(spark, sf, rows):
    pairs = [(r[0], r[1]) for r in rows]
    groups = groups_by_force(pairs)
    least = {}
    for (i, _), (_, g) in zip(pairs, groups):
        if g is not None:
            least[g] = min(least.get(g, i), i)
    want = [(i, f"{f:016x}", least.get(g)) for (i, _), (f, g) in zip(pairs, groups)]
    assert tuples(result(spark, sf, "op4_simhash"), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_embeddings(spark, sf, vectors):
    x = np.array([v if v and np.isfinite(v).all() and any(v) else [np.nan] * 24 for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    root = components_by_force(range(len(x)), lambda a, b: near[a, b])
    least = {}
    for k, (i, _) in enumerate(vectors):
        least[root[k]] = min(least.get(root[k], i), i)
    want = [(i, max(0, int(near[k].sum()) - 1), least[root[k]], least[root[k]] == i) for k, (i, _) in enumerate(vectors)]
    assert tuples(result(spark, sf, "op5_embedding"), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)


def flags_are_right(got, m, held, cut):
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"], m) == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_quality(spark, sf, rows):
    """The score from the two views, stated anew, under the model that the query learns."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = QualityClassifier().learn(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = result(spark, sf, "op6_quality")
    flags_are_right(got, 4, 2, 0.5)

    def score(text, source, lang):
        raw = (text or "").encode()
        words, lines = raw.split(), [x.strip() for x in raw.split(b"\n")]
        n = max(1, len(words))
        first = [math.sqrt(raw.count(bytes([k])) / len(raw)) if raw else 0 for k in range(256)]
        first += [len(set(words)) / n, sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / n, len([w for w in words if len(w) < 4]) / n, len([w for w in words if w.isupper()]) / n, len(raw) / n / 20] if raw else [0] * 5
        second = [math.log1p(len(raw)), math.log1p(len(lines)), math.log1p(len(raw) / len(lines)), math.log1p(max(map(len, lines))), 1 - len(set(lines)) / len(lines), lines.count(b"") / len(lines), *[0] * 48]
        second[6 + zlib.crc32(repr(source).encode()) % 32] = 1
        second[38 + zlib.crc32(repr(lang).encode()) % 16] = 1
        z = model.bias
        for x, view, w in zip((first, second), model.views, model.weights):
            z += w * max(-30, min(30, sum((a - m) / s * c for a, m, s, c in zip(x, view.mean, view.scale, view.weights)) + view.bias))
        return round(1 / (1 + math.exp(-z)), 6)

    assert sorted(((r["doc_id"], round(r["score"], 6)) for r in got), key=repr) == sorted(((r[0], score(r[1], r[3], r[2])) for r in rows), key=repr)
    right = [r["predicted"] == spoken()[r["doc_id"] - 100][5] for r in got if r["held_out"] and r["doc_id"] is not None and 104 <= r["doc_id"] < 340]
    assert len(right) > 30 and sum(right) >= 0.9 * len(right)


def test_toxicity(spark, sf, rows):
    """The score from compressed lengths, stated anew, under the model that the query learns."""
    import zstandard as z

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = Toxicity().learn(docs, labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    got = result(spark, sf, "op7_toxicity")
    flags_are_right(got, 4, 2, 0.3)
    params = z.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=64, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain, both = (z.ZstdCompressor(dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params) for c in (m.ordinary, m.toxic + m.ordinary))

    def score(text):
        words, gains, k = (text or "").encode().translate(LETTERS).split(), [], 0
        while words and (k == 0 or k + 4 < len(words)):  # windows of 24 words, four of them shared with the one before
            w = b" " + b" ".join(words[k : k + 24]) + b" "
            gains.append(len(plain.compress(w)) - len(both.compress(w)))
            k += 20
        over = [sum(g >= c for g in gains) for c in m.cuts]
        n = max(1, len(gains))
        x = [*map(math.log1p, over), *(o / n for o in over), max([0, *gains]) / 10, sum(gains) / n]
        return round(1 / (1 + math.exp(-sum((a - b) / s * w for a, b, s, w in zip(x, m.mean, m.scale, m.weights)) - m.bias)), 6)

    assert sorted(((r["doc_id"], round(r["score"], 6)) for r in got), key=repr) == sorted(((r[0], score(r[1])) for r in rows), key=repr)
    right = [r["predicted"] == spoken()[r["doc_id"] - 100][4] for r in got if r["held_out"] and r["doc_id"] is not None and 104 <= r["doc_id"] < 340]
    assert len(right) > 30 and sum(right) >= 0.9 * len(right)


def languages_by_force(model, text):
    """(language, score, rejected), n-gram by n-gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode()) + b" "
    total, n = np.zeros(len(model.languages) + 1), 0
    for size, salt in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        for gram, times in Counter(raw[k : k + size] for k in range(len(raw) - size + 1)).items():
            if gram.strip(b" "):
                total += times * model.weights[(int.from_bytes(gram, "big") * salt & 0xFFFFFFFF) >> 16]
                n += times
    logits = (total / n + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    k = int(p[:-1].argmax())
    return model.languages[k], float(p[k] / p[:-1].sum()), bool(p[-1] / p.sum() > model.threshold)


def test_language(spark, sf, rows):
    model = LanguageID().learn(spark.read.parquet(f"{sf}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = result(spark, sf, "op8_language")
    want = [(r[0], r[0] is not None and crc(r[0], 5) == 0, *languages_by_force(model, r[1])[:2]) for r in rows]
    assert sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 4)) for r in got), key=repr) == sorted(((*w[:3], round(w[3], 4)) for w in want), key=repr)


def test_suffix_tree(spark, sf, rows):
    train = [(r[0], r[0] is not None and crc(r[0], 7) != 2, r[1]) for r in rows]
    want, _ = scores_by_force(train)
    got = result(spark, sf, "op9_suffix_tree_lm")
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i, own, _ in train if not own and i is not None}


def test_pii(spark, sf, rows):
    got = result(spark, sf, "op10_pii")
    want = []
    for r in rows:
        base = spans_by_force(r[1] or "")
        want.append((r[0], *(base.count(k + ":") for k in ("email", "ip", "card", "phone")), sha(base)))
    assert tuples(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert sum(r["n_ip"] for r in got) == 2


def test_pipeline(spark, sf, rows, encoding):
    """Every stage by brute force on what the stage before it keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = LanguageID().learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    kept = [r for r in rows if not languages_by_force(model, r[1])[2]]
    assert len(rows) - 14 <= len(kept) < len(rows) - 4
    stages = dict(corpus_pipeline.STAGES)

    def ran(name, table):
        out = stages[name](spark, table, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        return corpus_pipeline.materialize(out, name)

    def same(table, want):
        assert sorted((tuple(r) for r in table.collect()), key=repr) == sorted(want, key=repr)

    table = ran("language_id", docs)
    same(table, kept)

    lines = Counter()
    for i, text, *_ in lines_by_force([(r[0], r[1]) for r in kept]):
        lines[i, text] += 1
    table = ran("line_dedup", table)
    got = [tuple(r) for r in table.collect()]
    assert Counter((r[0], r[1]) for r in got) == lines and all(r[4] == len(r[1]) for r in got)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in kept)

    # th as the stage takes it: xxHash64 with Spark's seed, signed
    th = {r["text"]: r["h"] for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    groups = groups_by_force([(r[0], r[1]) for r in got])
    first = {}
    for r, (_, g) in zip(got, groups):
        if g is not None:
            first[g] = min(first.get(g, (r[0], th[r[1]])), (r[0], th[r[1]]))
    want = Counter((r[0], r[1]) for r in got if r[0] is None)
    want += Counter({(i, t): 1 for (i, t, *_), (_, g) in zip(got, groups) if g is not None and first[g] == (i, th[t])})
    table = ran("simhash_dedup", table)
    after = [tuple(r) for r in table.collect()]
    assert Counter((r[0], r[1]) for r in after) == want and not Counter(after) - Counter(got)
    assert len(after) < len(got) - 10

    after = [r for r in after if not contaminated(r[1])]
    table = ran("decontaminate", table)
    same(table, after)

    last = stages["byte_bpe"](spark, table, sf)
    assert sorted((tuple(r) for r in last.collect()), key=repr) == digests(encoding, [(r[0], r[1]) for r in after])
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=repr) == digests(encoding, [(r[0], r[1]) for r in after])


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0).withColumns({"_lang": F.lit(1), "id": F.lit("x"), "th": F.lit(2), "_n_lines": F.lit(3)})
    docs = corpus_pipeline.materialize(docs, "none")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "byte_bpe" or out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, f"none-{name}")
        assert docs.count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark, sf):
    """Ids that repeat with other texts, equal rows, rows that differ in another column only, names that the operators use."""
    a, b = ("alpha beta gamma delta epsilon " * 30, "one two three four five six seven eight " * 30)
    rows = [(3, a, 1, 2, "x"), (5, a, 1, 2, "x"), (5, b, 1, 2, "y"), (5, b, 1, 2, "b"), (12, b, 1, 2, None), (None, a, 1, 2, "z"), (7, None, 1, 2, "q"), (7, None, 1, 2, "q"), (8, "", 1, 2, "q")]
    table = spark.createDataFrame(rows, "doc_id long, text string, id int, th int, g string")
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, table, sf)
    assert got.columns == table.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([rows[0], rows[3], rows[5], rows[6]], key=repr)
