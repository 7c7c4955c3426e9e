"""The retrieval operators on hand-written tables, against independent statements of their rules."""

import importlib.util
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, evaluation, experiments, records, retrieval, serialize
from tessera.sources import files
from tessera.streaming.live import add_live, stream_submissions

DOCS = [(1, "the cat sat on the mat"), (2, "the dog the dog barks"), (3, "a cat and a dog"), (4, "the cat sat on the mat"), (5, ""), (6, None)]


def bm25_by_force(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {i: (t or "").lower().split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        if any(tf[w] for w in query.lower().split()):
            out[i] = sum(idf.get(w, 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avg)) for w in query.lower().split() if tf[w])
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "id long, text string")


def test_bm25(spark, corpus):
    queries = ["cat cat dog", "the", "absent", "mat barks"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.BM25(corpus).scores(q).collect()}
    want = {(k, i): s for k, text in enumerate(queries) for i, s in bm25_by_force(DOCS, text).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = retrieval.BM25(corpus).topk(q).filter("query_id = 3").orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and [r["id"] for r in top][1:] == [1, 4]  # a tie goes by id
    assert retrieval.BM25(corpus.limit(0)).topk(q).count() == 0


def test_bm25_index(spark, tmp_path):
    """Built, extended and opened again it scores as if built anew; half an addition is never seen."""
    path = str(tmp_path / "index")
    q = spark.createDataFrame([(1, "cat cat dog"), (2, "barks"), (3, "absent"), (4, "new")], "query_id long, text string")
    docs = lambda rows: spark.createDataFrame(rows, "id long, text string")
    index = retrieval.BM25Index(spark, path)
    assert not index.exists()
    with pytest.raises(ValueError, match="empty"):
        index.topk(q)
    index.add(docs(DOCS))
    changes = [(2, "a new text"), (9, "cat dog"), (5, "the dog barks")]
    for n, now in ((0, dict(DOCS)), (1, dict(DOCS) | dict(changes)), (2, dict(DOCS) | dict(changes) | {9: None})):
        if n:
            index.add(docs(changes if n == 1 else [(9, None)]))
        (tmp_path / "index" / "stats" / "version=99").mkdir(exist_ok=True)
        got = sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in retrieval.BM25Index(spark, path).topk(q).collect())
        want = sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in retrieval.BM25(docs(list(now.items()))).topk(q).collect())
        assert got == want and got
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in (1, 2, 9)], "id long, vec array<double>")
    hits = retrieval.retrieve("hybrid_rrf", docs(DOCS).limit(0), v, q, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>"), index=index)
    assert hits.filter("bm25_score > 0").count() > 0
    index.clear()
    assert not index.exists()


def test_orphans(spark):
    hits = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (2, None)], "query_id long, id long")
    base = spark.createDataFrame([(5, "x"), (7, "y"), (7, "z")], "id long, text string")
    assert {(r["query_id"], r["id"]) for r in retrieval.orphan_hits(hits, base).collect()} == {(1, 6), (2, None)}


def test_hashed_vectors(spark):
    rows = [(1, "a b a c"), (2, ""), (3, None), (4, "x " * 500 + "y")]
    table = spark.createDataFrame(rows, "id long, text string")
    want = {r["id"]: r["v"] for r in table.select("id", T.hash_embedding(T.tokens(F.coalesce("text", F.lit("")))).alias("v")).collect()}
    got = {r["id"]: r["vec"] for r in retrieval.hash_vectors(table).collect()}
    assert got.keys() == want.keys()
    for i, v in want.items():
        assert len(got[i]) == 64 and all(abs(a - b) < 1e-12 for a, b in zip(got[i], v))


def test_fusion(spark):
    hit = "query_id long, id long, score double, rank long"
    s = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], hit)
    x = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2), (1, 13, 3.0, 3)], hit)
    rows = retrieval.rrf_fusion(s, x).orderBy("fused_rank").collect()
    assert [r["id"] for r in rows] == [11, 10, 12, 13]
    assert abs(rows[0]["rrf_score"] - (1 / 62 + 1 / 61)) < 1e-12 and rows[2]["semantic_score"] == 0.0
    assert retrieval.rrf_fusion(s, x, limit=2).count() == 2 and retrieval.rrf_fusion(s.limit(0), x.limit(0)).count() == 0


def test_strategies(spark, corpus):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 7)], "id long, vec array<double>")
    q = spark.createDataFrame([(1, "cat dog")], "query_id long, text string")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    semantic = retrieval.retrieve("semantic_only", corpus, v, q, qv).orderBy("final_rank").collect()
    assert [r["id"] for r in semantic] == [6, 5, 4, 3, 2]
    best = retrieval.retrieve("hybrid_rrf_ce", corpus, v, q, qv).orderBy("final_rank").first()
    assert best["id"] == 3 and best["cross_encoder_score"] == 1.0
    assert retrieval.retrieve("hybrid_rrf", corpus, v, q, qv).count() == 5
    with pytest.raises(ValueError):
        retrieval.retrieve("other", corpus, v, q, qv)


def fixed_by_force(text, size=700, overlap=120):
    t = text.strip()
    return [c for c in (t[i : i + size].strip() for i in range(0, len(t), size - overlap)) if c]


def recursive_by_force(text, size=700):
    units = []
    for p in (x.strip() for x in text.split("\n\n")):
        if p:
            sentences = [p] if len(p) <= size else [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]
            for s in sentences:
                units += [s] if len(s) <= size else fixed_by_force(s, size, 80)
    out, cur = [], ""
    for u in units:
        joined = f"{cur} {u}" if cur else u
        if len(joined) <= size:
            cur = joined
        else:
            out += [cur] if cur else []
            cur = u
    return out + ([cur] if cur else [])


def test_chunks(spark):
    long = "word. " * 300
    texts = ["", "   ", "x" * 580, "x" * 581, "x" * 700, "x" * 701, long, "a\n\nb", long + "\n\n" + "y" * 1500 + "\n\nend", "é" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for method, force in (("fixed", fixed_by_force), ("recursive", recursive_by_force)):
        got = {i: [] for i in range(len(texts))}
        for r in chunking.chunk_dataset(df, method).orderBy("source_id", "chunk_no").collect():
            got[r["source_id"]].append(r["text"])
        assert got == {i: force(t) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        chunking.chunk_dataset(df, "other")


def test_serialize(spark):
    row = spark.createDataFrame([("Ann", "", None, "a,b", "", "e" * 2001, "MSc")], "n string, c string, l string, s string, m string, x string, e string")
    got = row.select(serialize.candidate(*(F.col(c) for c in "nclsmxe")).alias("t")).first()["t"]
    assert got == "Name: Ann | Category: Not specified | Location: Not specified\n\nSKILLS:\na,b\n\nEXPERIENCE:\n" + "e" * 2000 + "\n\nEDUCATION:\nMSc"
    skills = spark.createDataFrame([("a، b",), ("a,b",), ("",)], "s string").select(serialize.skills_urdu(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in skills] == [["a", "b"], ["a,b"], []]


def test_answer_and_judge(spark):
    q = spark.createDataFrame([(1, "need java"), (2, "nothing")], "query_id long, text string")
    hits = spark.createDataFrame([(1, i, f"n{i}", f"first {i}\nsecond {i}\nthird") for i in range(1, 6)], "query_id long, rank long, name string, text string")
    prompts = evaluation.prompt(hits, q, "recruiter", "name").withColumn("a", evaluation.heuristic_answer(F.col("prompt")))
    got = {r["query_id"]: r["a"].split("\n") for r in prompts.collect()}
    assert got[1][0] == evaluation.ANSWERS[0][1] and got[1][1] == "1. Candidate 1: n1: first 1 second 1" and len(got[1]) == 6
    assert got[2] == [evaluation.NO_ANSWER]
    raw = spark.createDataFrame([('x {"supported": true, "reason": "r"} y',), ('{"supported": "false"}',), ("{bad",), ('{"supported": tr}',)], "t string")
    assert [tuple(r["o"]) for r in raw.select(evaluation.object_salvage(F.col("t")).alias("o")).collect()] == [(True, "r"), (False, ""), (False, "parse error"), (False, "parse error")]
    arrays = spark.createDataFrame([('so ["a", "b"] end',), ("none",), ("[1,",)], "t string")
    assert [r["o"] for r in arrays.select(evaluation.array_salvage(F.col("t")).alias("o")).collect()] == [["a", "b"], ["none"], ["[1,"]]
    shapes = ['{"generated_text": "a"}', '{"choices": [{"text": "b"}]}', '{"choices": [{"message": {"content": " ", "reasoning": "c"}}]}', '[{"generated_text": "d"}]', "plain"]
    got = spark.createDataFrame([(s,) for s in shapes], "t string").select(evaluation.response_text(F.col("t")).alias("o")).collect()
    assert [r["o"] for r in got] == ["a", "b", "c", "d", "plain"]


def test_judges(spark):
    rows = spark.createDataFrame([("java spring boot experience", "we need java and spring", "Java expert. Knows spring boot! Third? Fourth."), ("", "x", "")], "query string, context string, answer string")
    english, urdu = evaluation.lexical_judge(), evaluation.lexical_judge_urdu()
    got = rows.select(english.claims(F.col("answer")).alias("c"), english.questions(F.col("answer"), F.col("query")).alias("q"), urdu.claims(F.col("answer")).alias("u"), urdu.questions(F.col("answer"), F.col("query")).alias("uq")).collect()
    assert got[0]["c"] == ["Java expert.", "Knows spring boot!", "Third?"] and got[0]["u"] == ["Java expert", "Knows spring boot", "Third"]
    assert got[0]["q"][0] == "What are the main points about expert Knows spring?" and got[0]["uq"] == list(evaluation.QUESTIONS_UR)
    verdicts = rows.select(english.verify(F.lit("java spring"), F.col("context")).alias("v"), urdu.verify(F.lit("java spring"), F.col("context")).alias("w")).collect()
    assert tuple(verdicts[0]["v"]) == (True, evaluation.REASONS[0]) and tuple(verdicts[1]["v"]) == (False, evaluation.REASONS[1])
    assert tuple(verdicts[0]["w"]) == (False, evaluation.REASON_UR)


def test_model_judge(spark):
    """A model's answers are read leniently; where it fails, the fallback judges."""
    replies = {"claims": 'Sure: ["one", "two", "three"] ok', "verdict": 'x {"supported": true, "reason": "r"}', "questions": '["q1"]'}

    def model(prompt, max_tokens):
        reply = F.when(prompt.startswith("Extract"), replies["claims"]).when(prompt.startswith("Is this"), replies["verdict"]).otherwise(replies["questions"])
        return F.when(~prompt.contains("fails"), reply)

    judge = evaluation.model_judge(model, evaluation.lexical_judge(), max_claims=2)
    rows = spark.createDataFrame([(1, "some answer.", "q"), (2, "this fails. Really.", "q")], "k int, answer string, query string")
    got = {r["k"]: r for r in rows.select("k", judge.claims(F.col("answer")).alias("c"), judge.verify(F.lit("java"), F.col("answer")).alias("v"), judge.questions(F.col("answer"), F.col("query")).alias("q")).collect()}
    assert got[1]["c"] == ["one", "two"] and tuple(got[1]["v"]) == (True, "r") and got[1]["q"] == ["q1", "q", "q"]
    assert got[2]["c"] == ["this fails.", "Really."] and got[2]["v"]["supported"] is False and got[2]["q"][0].startswith("What are the main points")


def test_generation_chain(spark):
    asked = []

    def step(name, works):
        def run(prompt):
            asked.append(name)
            return F.when(prompt.contains(works), F.concat(F.lit(f" {name}: "), prompt))

        return run

    generate = evaluation.chain(lambda p: step("first", "one")(evaluation.instructed(p)), step("second", "two"), last=lambda p: F.lit("last"))
    rows = spark.createDataFrame([("one",), ("two",), ("three",)], "p string")
    assert [r["a"] for r in rows.select(generate(F.col("p")).alias("a")).collect()] == ["first: [INST] one [/INST]", "second: two", "last"]


def test_command_line(spark, tmp_path):
    from tessera import cli

    people = spark.createDataFrame([(str(i), f"title {i}", t or "") for i, t in DOCS], "id string, title string, text string")
    people.write.json(str(tmp_path / "people"))
    files.append_csv(people.withColumn("id", F.concat(F.lit("j"), "id")), str(tmp_path / "jobs"))
    asked = [(f"r{i:02d}", "recruiter", f"cat dog {i}") for i in range(12)] + [(f"c{i:02d}", "candidate", "the mat") for i in range(9)] + [("x", "candidate", " ")]
    spark.createDataFrame(asked, "query_id string, mode string, text string").write.json(str(tmp_path / "queries"))
    out = str(tmp_path / "out")
    doc = cli.main(["--candidates", str(tmp_path / "people"), "--jobs", str(tmp_path / "jobs"), "--queries", str(tmp_path / "queries"), "--retrieval-ablation-queries", "2", "--chunking-ablation-queries", "1", "--output-dir", out], spark)
    assert doc["baseline_fixed_set"]["summary"]["count"] == 15 and [e["mode"] for e in doc["baseline_fixed_set"]["example_verifications"]] == ["recruiter"] * 3
    assert {s["count"] for s in doc["ablation"]["retrieval"]["summary_by_strategy"].values()} == {2}
    assert {s["count"] for s in doc["ablation"]["chunking"]["summary_by_chunking"].values()} == {1}
    assert files.read_document(spark, f"{out}/experiment") == doc
    assert spark.read.option("header", True).csv(f"{out}/ablation").count() == 5
    text = "\n".join(r["value"] for r in spark.read.text(f"{out}/report").collect())
    assert "upported: " in text and "exical overlap" in text
    raw = (tmp_path / "out" / "report.pdf").read_bytes()
    start = int(raw.split(b"startxref\n")[1].split()[0])
    assert raw.startswith(b"%PDF-1.4") and raw[start : start + 4] == b"xref" and b"Fixed set" in raw
    with pytest.raises(SystemExit):
        cli.options(["--queries", "q", "--mode", "candidate"])


def test_live_additions(spark, tmp_path):
    """A submission is found at once by record, vector and words."""
    table, index = files.VectorTable(spark, str(tmp_path / "v")), retrieval.BM25Index(spark, str(tmp_path / "i"))
    table.create(2)
    index.add(spark.createDataFrame([("a", "old words")], "id string, text string"))
    rows = spark.createDataFrame([("b", 1, "fresh words"), ("a", 2, "newer"), ("a", 1, "older"), (None, 1, "nobody")], "id string, seq long, text string")
    add_live(rows, lambda d: d.withColumn("values", F.array(F.lit(1.0), F.lit(2.0))), table, index, str(tmp_path / "records"))
    assert {(r["id"], r["text"]) for r in table.read().collect()} == {("a", "newer"), ("b", "fresh words")}
    q = spark.createDataFrame([(1, "fresh"), (2, "old"), (3, "newer")], "query_id long, text string")
    assert {(r["query_id"], r["id"]) for r in index.scores(q).collect()} == {(1, "b"), (3, "a")}
    assert files.read_jsonl(spark, str(tmp_path / "records"), "id string, seq long, text string").count() == 4
    add_live(rows.limit(0), lambda d: d, table, index)
    with pytest.raises(Exception, match="2 components"):
        table.upsert(spark.createDataFrame([("c", 1, [1.0])], "id string, seq long, values array<double>"))
    table.create(2)
    with pytest.raises(ValueError, match="holds"):
        table.create(3)


def test_records(spark, tmp_path):
    ids = spark.createDataFrame([("USER_0007",), ("USER_x",), ("USER_",), ("USER_12345",), ("JOB_99999",)], "id string")
    assert ids.agg(records.next_id(F.col("id"), "USER_").alias("n")).first()["n"] == "USER_12346"
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i else None) for i in range(10)], "k long, c string")
    assert sorted(r["k"] for r in records.stratified_sample(rows, "c", "k", 6).collect()) == [0, 1, 2, 3, 4]
    assert [r["ident"] for r in records.positional_ids(rows, "k").orderBy("k").collect()] == [f"JOB_{i:05d}" for i in range(10)]
    table = files.VectorTable(spark, str(tmp_path / "v"))
    table.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "id string, seq long, t string"))
    table.upsert(spark.createDataFrame([("a", 3, "w"), ("b", 1, "q")], "id string, seq long, t string"))
    assert {(r["id"], r["t"]) for r in table.read().collect()} == {("a", "w"), ("b", "q")}


def test_vector_table_log(spark, tmp_path):
    """A table opens again where it was left, skips parts not written to their end, and compacts without changing its rows."""
    path = str(tmp_path / "log")
    want = {}
    for n in range(7):
        rows = [(f"k{n % 3}", n, f"t{n}"), (f"only{n}", 0, "x")]
        want |= {k: t for k, _, t in rows}
        files.VectorTable(spark, path, every=3).upsert(spark.createDataFrame(rows, "id string, seq long, t string"))
    files.VectorTable(spark, path).upsert(spark.createDataFrame([("k0", -1, "older")], "id string, seq long, t string"))
    (tmp_path / "log" / "delta=000000099").mkdir()
    table = files.VectorTable(spark, path)
    assert table.exists() and {r["id"]: r["t"] for r in table.read().collect()} == want
    assert any(p.name.startswith("base=") for p in (tmp_path / "log").iterdir())
    table.compact()
    table.prune()
    assert len([p for p in (tmp_path / "log").iterdir() if p.is_dir()]) == 1
    assert {r["id"]: r["t"] for r in files.VectorTable(spark, path).read().collect()} == want
    table.clear()
    table.clear()
    assert not table.exists()
    with pytest.raises(ValueError, match="empty"):
        table.read()


def test_experiment(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"title {i}", t) for i, t in DOCS], "id long, title string, text string")
    queries = spark.createDataFrame([(1, "cat on a mat"), (2, "barks"), (3, "")], "query_id long, text string")
    embed = lambda d: d.select("id", T.hash_embedding(T.tokens(F.coalesce("text", F.lit("")))).alias("vec"))
    doc = experiments.experiment(corpus, embed, queries, str(tmp_path / "work"))
    for s in doc["ablation"]["retrieval"]["summary_by_strategy"].values():
        assert s["count"] == 3 and 0 <= s["avg_faithfulness"] <= 1 and s["avg_total_s"] >= s["avg_retrieval_s"] > 0
    assert [s["chunk_count"] for s in doc["ablation"]["chunking"]["summary_by_chunking"].values()] == [chunking.chunk_dataset(corpus, m).count() for m in ("fixed", "recursive")]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", doc["run_at"])
    path = str(tmp_path / "doc")
    files.write_document(spark, doc, path)
    assert files.read_document(spark, path) == doc
    with pytest.raises(FileNotFoundError):
        files.read_document(spark, path + "x")
    assert files.read_document(spark, path + "x", required=False) == {}
    table = spark.createDataFrame(experiments.ablation_rows(doc), list(experiments.CSV))
    assert files.read_csv_or(spark, str(tmp_path / "csv"), table).count() == 5
    files.append_csv(table, str(tmp_path / "csv"))
    got = files.read_csv_or(spark, str(tmp_path / "csv"), table.limit(0))
    assert sorted(r["Strategy"] for r in got.collect()) == ["Chunking: Fixed (Hybrid + RRF + CE)", "Chunking: Recursive (Hybrid + RRF + CE)", "Hybrid + RRF", "Hybrid + RRF + CE", "Semantic only"]
    text = experiments.report(doc)
    assert "| Hybrid + RRF + CE |" in text and text.count("- ") >= 1
    assert "| 0 | 0.0% |" in experiments.report({})


def test_files(spark, tmp_path):
    rows = [(1, 'a "quoted", comma', "line\nbreak"), (2, "é", None)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    files.append_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "k long, a string, b string").collect()) == rows
    (tmp_path / "j").write_text('{"k": 1}\n\n{"k": oops}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "j"), "k long").collect()


def test_database(spark):
    """Tables of a database read over JDBC, nested and written out."""
    url = "jdbc:derby:memory:tessera;create=true"
    rows = spark.createDataFrame([(1, "ann"), (2, "bob")], "id long, name string")
    skills = spark.createDataFrame([(10, 1, "java"), (11, 1, "sql")], "n long, person long, skill string")
    for name, table in (("PEOPLE", rows), ("SKILLS", skills)):
        table.write.format("jdbc").options(url=url, dbtable=name, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    people, own = (files.read_table(spark, url, name, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver") for name in ("PEOPLE", "SKILLS"))
    people, own = (d.toDF(*(c.lower() for c in d.columns)) for d in (people, own))
    got = records.nest(people, own, "id", "person", "skills", (F.col("n"),), ("skill",)).orderBy("id").collect()
    assert [(r["name"], [x["skill"] for x in r["skills"]]) for r in got] == [("ann", ["java", "sql"]), ("bob", [])]


def test_stream_equals_batch(spark, tmp_path):
    schema = "id string, seq long, name string, skills string"
    rows = [("a", 1, "n", "s"), ("b", 2, " ", "s"), ("a", 3, "m", "t")]
    spark.createDataFrame(rows, schema).repartition(3).write.json(str(tmp_path / "in"))
    table = files.VectorTable(spark, str(tmp_path / "table"))
    stream_submissions(spark, str(tmp_path / "in"), schema, ("name", "skills"), lambda d: d, table, str(tmp_path / "ck")).awaitTermination(120)
    assert [tuple(r) for r in table.read().select("id", "name").collect()] == [("a", "m")]


def test_summaries(spark):
    rows = spark.createDataFrame([("s", 0.5, 0.5), ("t", 0.4, 0.6)], "k string, faithfulness double, relevancy double")
    s = evaluation.summarize(rows, "k", ("r", "s", "t"))
    assert [tuple(r) for r in s.orderBy("ordinal").select("k", "count", "avg_faithfulness").collect()] == [("r", 0, 0.0), ("s", 1, 0.5), ("t", 1, 0.4)]
    assert evaluation.pick_best(s, "k").first()["k"] == "s"


def test_text(spark):
    df = spark.createDataFrame([("One. Two! three?  Four",)], "t string")
    assert df.select(T.sentences(F.col("t")).alias("x")).first()["x"] == ["One.", "Two!", "three?", "Four"]
    assert df.select(T.term_set(F.lit("Ab abcd ABCD x_y1"), 3).alias("x")).first()["x"] == ["abcd", "x_y1"]


SF = "/root/testdata/sf0.001"
CHEAP = ("bm25_topk", "rrf_fusion", "hybrid_rrf_rerank", "recursive_chunks", "heuristic_answer", "nested_export_customer", "relevancy_score", "live_append_union")


@pytest.mark.skipif(not (os.path.isdir(SF) and importlib.util.find_spec("duckdb")), reason="needs the test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    import duckdb

    from tessera.plans import registry

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(got.select(columns).collect()) == key(con.sql(f"select {','.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_semantic_topk_in_blocks(spark, block):
    """Cosine against brute force: lengths of all kinds, ties by id, repeated ids, null, short, zero and non-finite vectors, fewer vectors than k, no queries."""
    import numpy as np

    rng = np.random.default_rng(6)
    x = [*rng.normal(size=(40, 8)).round(2).tolist(), *([float(1 + i % 3)] * 8 for i in range(30))]
    rows = [(f"v{i:03d}", v) for i, v in enumerate(x)] + [("v001", x[0]), ("n", None), ("s", [1.0]), ("h", [None] + [1.0] * 7), ("f", [float("nan")] * 8), ("i", [float("inf")] * 8), ("z", [0.0] * 8), ("big", [1e30] + [2e30] * 7)]
    asked = [(1, x[0]), (2, x[-1]), (3, [0.0] * 8), (4, None), (5, x[3]), (6, [2.0])]
    vectors = spark.createDataFrame(rows, "id string, vec array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id int, vec array<float>")


    def cosine(v, y):
        v, y = (np.array(u, np.float32).astype(float) for u in (v, y))
        return float(v @ y) / np.sqrt(float(v @ v)) / np.sqrt(float(y @ y))

    for k in (1, 7, 500):
        want = []
        for q, v in asked:
            if v is not None and any(v):
                hits = [(-round(cosine(v, y), 9), i) for i, y in rows if y and None not in y and np.isfinite(y).all() and any(y) and len(y) == len(v)]
                want += [(q, i, r + 1, round(-s, 6) + 0.0) for r, (s, i) in enumerate(sorted(hits)[:k])]
        out = retrieval.semantic_topk(vectors, queries, k, block)
        assert dict(out.dtypes) == {"query_id": "int", "id": "string", "score": "double", "rank": "bigint"}
        assert sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 6) + 0.0) for r in out.collect()) == sorted(want)
    two = spark.createDataFrame([(1, [10.0, 10.0]), (2, [1.0, 0.0])], "id long, vec array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    assert [r["id"] for r in retrieval.semantic_topk(two, one).orderBy("rank").collect()] == [2, 1]
    assert retrieval.semantic_topk(vectors, queries.limit(0)).count() == 0
    assert retrieval.semantic_topk(vectors.limit(0), queries).count() == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_bm25_of_copies(spark, block):
    """Copies have the very same score, so that they tie by id; the best equal brute force, in batches and blocks of any size."""
    import random

    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(4000)]
    base = [" ".join(rng.sample(words, rng.randint(1, 90))) for _ in range(25)]
    docs = [(i, base[i * 7 % 25]) for i in range(400)] + [(400, ""), (401, None)]
    asked = [(q, " ".join(rng.sample(words, 60))) for q in range(9)] + [(9, "absent"), (10, "")]
    corpus = spark.createDataFrame(docs, "id long, text string").repartition(5)
    queries = spark.createDataFrame(asked, "query_id int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = retrieval.BM25(corpus).topk(queries, block).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for q, text in asked:
        best = sorted((-round(s, 9), i) for i, s in bm25_by_force(docs, text).items())[:20]
        want += [(q, i, r, round(-s, 6)) for r, (s, i) in enumerate(best, 1) if s < 0]
    assert [(r["query_id"], r["id"], r["rank"], round(r["score"], 6)) for r in got] == want and len(want) == 180
    same: dict = {}
    for r in got:
        same.setdefault((r["query_id"], docs[r["id"]][1]), set()).add(r["score"])
    assert all(len(x) == 1 for x in same.values())
    assert "Aggregate" not in retrieval.BM25(corpus).topk(queries, block)._jdf.queryExecution().optimizedPlan().toString()  # no score is shuffled to be summed


def test_bm25_of_repeated_ids(spark):
    """Rows of one id count as one document, as before."""
    docs = spark.createDataFrame([(1, "cat"), (1, "cat dog"), (2, "cow"), (3, "cat"), (4, "pig"), (5, "hen"), (6, "fox"), (7, "ox")], "id long, text string")
    q = spark.createDataFrame([(1, "cat dog")], "query_id long, text string")
    top = retrieval.BM25(docs).topk(q).collect()
    assert sorted(r["id"] for r in top) == [1, 3] and len(retrieval.hash_vectors(docs).collect()) == 7


def test_fixed_chunks_of_long_texts(spark):
    """The work grows with the text: two million characters were 3,449 times a whole text to strip."""
    import time

    text = " " + "ab \u00e9\U0001f600\n" * 330_000 + "x  "
    df = spark.createDataFrame([(1, text)], "id long, text string")
    began = time.time()
    got = df.select(F.explode(chunking.fixed_chunks(F.col("text"))).alias("c")).collect()
    assert time.time() - began < 20
    assert [r["c"] for r in got] == fixed_by_force(text)
    for size, overlap in ((10, 9), (7, 0), (5, 8), (4, -3)):
        few = spark.createDataFrame([(t,) for t in ("", "   ", "a", "ab cd  ef\n\ngh " * 5)], "t string")
        got = {r["t"]: r["c"] for r in few.select("t", chunking.fixed_chunks(F.col("t"), size, overlap).alias("c")).collect()}
        assert got == {t: [c for c in (t.strip()[i : i + size].strip() for i in range(0, len(t.strip()), max(1, size - overlap))) if c] for t in got}


def test_chunk_retrieve_in_one_pass(spark):
    """Vectors are made in their rows, and no text but the hits' own is shuffled."""
    table = spark.createDataFrame([(f"c{i}", f"word{i % 7} and {i}") for i in range(50)], "id string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(retrieval.hash_vectors(table))
    q = spark.createDataFrame([(1, "word3 and 10")], "query_id long, text string")
    got = retrieval.chunk_retrieve(table, q)
    assert "LeftSemi" in plan(got) and got.count() == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_chunks_written_once(spark):
    """Both chunkings are cut once, into a written table, whatever reads them."""
    from tessera.plans import registry

    plan = registry.QUERIES["chunk_ablation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and "documents.parquet" not in plan
