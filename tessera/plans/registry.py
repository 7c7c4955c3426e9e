"""The queries of the retrieval engine over the star-schema and corpus tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, evaluation, records, retrieval, serialize
from tessera.sources.files import held

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).join(vectors(spark, sf), F.col("query_id") == F.col("id")).select("query_id", "vec")


def long(c, name: str | None = None):
    out = (F.col(c) if isinstance(c, str) else c).cast("long")
    return out.alias(name or c)


def r6(c: str):
    return F.round(c, 6).alias(c)


# Invented fields of a candidate record: some missing, some empty.
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    gap = lambda m: F.col("doc_id") % m == 0
    toks = T.tokens(F.col("text"))
    return d.select(
        "doc_id", "text", F.when(gap(7), "").otherwise(F.col("source")).alias("name"), F.when(gap(5), None).otherwise(F.col("lang")).alias("category"), F.when(gap(3), "").otherwise(F.col("source")).alias("location"),
        F.when(gap(4), "").otherwise(F.array_join(F.slice(toks, 1, 25), " , ")).alias("skills"), F.when(gap(6), None).otherwise(T.prefix(F.col("text"), 50)).alias("summary"), F.col("text").alias("experience"), F.when(gap(8), "").otherwise(T.prefix(F.col("text"), 600)).alias("education"),
    )


TOKS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
CAND = rf"""cand AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS name, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS category,
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS location, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string({TOKS}[1:25], ' , ') END AS skills,
 CASE WHEN doc_id % 6 = 0 THEN NULL ELSE substring(text, 1, 50) END AS summary, text AS experience, CASE WHEN doc_id % 8 = 0 THEN '' ELSE substring(text, 1, 600) END AS education FROM documents)"""


SKILLS_ALT = "coalesce(nullif(skills,''), nullif(summary,''), '')"
DESCRIBED = "substring(coalesce(nullif(education,''), nullif(summary,''), ''),1,3000)"


def sql_block(label: str, value: str) -> str:
    return f"CASE WHEN nullif({value}, '') IS NOT NULL THEN chr(10) || '{label}:' || chr(10) || {value} END"


@query(f"WITH {CAND} SELECT doc_id, concat_ws(chr(10), 'Name: ' || coalesce(nullif(name,''),'Unknown') || ' | Category: ' || coalesce(nullif(category,''),'Not specified') || ' | Location: ' || coalesce(nullif(location,''),'Not specified'), {sql_block('SKILLS', 'skills')}, {sql_block('SUMMARY', 'summary')}, {sql_block('EXPERIENCE', 'substring(experience,1,2000)')}, {sql_block('EDUCATION', 'education')}) AS text FROM cand")
def serialize_candidate(spark, sf):
    c = candidates(spark, sf)
    return c.select("doc_id", serialize.candidate(*(F.col(x) for x in ("name", "category", "location", "skills", "summary", "experience", "education"))).alias("text"))


@query(f"WITH {CAND} SELECT doc_id, concat_ws(chr(10), 'نام: ' || coalesce(nullif(name,''),'نامعلوم') || ' | زمرہ: ' || coalesce(nullif(location,''), nullif(category,''), ''), {sql_block('مہارتیں', SKILLS_ALT)}, {sql_block('خلاصہ', 'summary')}, {sql_block('تجربہ', 'substring(experience,1,2000)')}, {sql_block('تعلیم', 'education')}) AS text FROM cand")
def serialize_candidate_alt(spark, sf):
    c = candidates(spark, sf)
    return c.select("doc_id", serialize.candidate_urdu(*(F.col(x) for x in ("name", "location", "category", "skills", "summary", "summary", "experience", "education"))).alias("text"))


@query(f"WITH {CAND} SELECT doc_id, concat_ws(chr(10), 'Job Title: ' || coalesce(nullif(name,''), nullif(category,''), 'Unknown'), {sql_block('JOB DESCRIPTION', DESCRIBED)}) AS text FROM cand")
def serialize_job(spark, sf):
    c = candidates(spark, sf)
    return c.select("doc_id", serialize.job(F.col("name"), F.col("category"), F.col("education"), F.col("summary")).alias("text"))


@query(f"WITH {CAND} SELECT doc_id, concat_ws(chr(10), 'عنوان ملازمت: ' || coalesce(nullif(name,''), nullif(category,''), 'نامعلوم'), {sql_block('تفصیل ملازمت', DESCRIBED)}) AS text FROM cand")
def serialize_job_alt(spark, sf):
    c = candidates(spark, sf)
    return c.select("doc_id", serialize.job_urdu(F.col("name"), F.col("category"), F.col("education"), F.col("summary")).alias("text"))


SPLIT = "list_filter(list_transform(string_split(coalesce({c},''), '{s}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def flat_metadata(c, urdu=False):
    m = serialize.candidate_metadata(*(F.col(x) for x in ("doc_id", "name", "category", "location", "skills", "education", "text")), urdu=urdu)
    return c.select(m.alias("m")).select(F.col("m.type").alias("type"), F.col("m.resume_id").alias("resume_id"), F.col("m.name").alias("name"), F.col("m.category").alias("category"), F.col("m.location").alias("location"), F.array_join("m.skills", "|").alias("skills"), F.col("m.education").alias("education"), F.length("m.text").cast("long").alias("text_chars"))


META = "SELECT 'candidate' AS type, doc_id AS resume_id, coalesce(name,'') AS name, coalesce(category,'') AS category, coalesce(location,'') AS location, coalesce(array_to_string({sk}[1:20],'|'),'') AS skills, substring(coalesce(education,''),1,500) AS education, least(length(text),4000)::BIGINT AS text_chars FROM cand"


@query(f"WITH {CAND} " + META.format(sk=SPLIT.format(c="skills", s=",")))
def metadata_candidate(spark, sf):
    return flat_metadata(candidates(spark, sf))


@query(f"WITH {CAND} " + META.format(sk="(CASE WHEN len(" + SPLIT.format(c="skills", s="،") + ")>0 THEN " + SPLIT.format(c="skills", s="،") + " ELSE " + SPLIT.format(c="skills", s=",") + " END)"))
def metadata_candidate_alt(spark, sf):
    return flat_metadata(candidates(spark, sf), urdu=True)


@query(f"WITH {CAND} SELECT 'job' AS type, doc_id AS job_id, coalesce(name,'') AS job_title, substring(text,1,4000) AS text FROM cand")
def metadata_job(spark, sf):
    return candidates(spark, sf).select(serialize.job_metadata(F.col("doc_id"), F.col("name"), F.col("text")).alias("m")).select("m.*")


PREFIXES = (200, 220, 240, 350, 500, 512, 600, 800, 1000, 2000, 3000, 4000)


@query("SELECT doc_id, " + ", ".join(f"md5(substring(text,1,{n})) AS p{n}" for n in PREFIXES) + " FROM documents")
def truncate_profile(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(F.md5(T.prefix(F.col("text"), n)).alias(f"p{n}") for n in PREFIXES))


@query(f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t,' ')) AS digest FROM (SELECT doc_id, {TOKS} AS t FROM documents)")
def tokenize_lower(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", long(F.size("t"), "n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t,' ')) AS digest FROM (SELECT doc_id, {TOKS.replace('lower(text)', 'text')} AS t FROM documents)")
def tokenize_cased(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text"), True).alias("t"))
    return t.select("doc_id", long(F.size("t"), "n"), F.md5(F.array_join("t", " ")).alias("digest"))


SENT = r"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s,'|')) AS digest FROM (SELECT doc_id, " + SENT.format(c="text") + " AS s FROM documents)")
def sentence_split(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return t.select("doc_id", long(F.size("s"), "n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(r"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s,'|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[۔.!?]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def sentence_split_alt(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.sentences_cut(F.col("text")).alias("s"))
    return t.select("doc_id", long(F.size("s"), "n"), F.md5(F.array_join("s", "|")).alias("digest"))


TERMS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-zA-Z0-9_]+'), lambda x: length(x) > {n}))"


@query("SELECT doc_id, array_to_string(list_sort(" + TERMS.format(c="text", n=3) + "), ' ') AS terms FROM documents")
def term_sets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(T.term_set(F.col("text"), 3)), " ").alias("terms"))


# --- lexical and semantic retrieval
def bm25_sql(docs: str, queries: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return rf"""corpus AS ({docs}), qs AS ({queries}), d AS (SELECT id, {TOKS} AS toks FROM corpus), dl AS (SELECT id, len(toks)::DOUBLE AS dl FROM d),
 bst AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(toks) AS term FROM d) GROUP BY ALL),
 df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), idf0 AS (SELECT term, df, ln(n-df+0.5::DOUBLE)-ln(df+0.5::DOUBLE) AS raw FROM df, bst),
 eps AS (SELECT 0.25::DOUBLE*avg(raw) AS e FROM idf0), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN e ELSE raw END AS idf FROM idf0, eps),
 q AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT query_id, unnest({TOKS}) AS term FROM qs) GROUP BY ALL),
 sc AS (SELECT q.query_id, tf.id, sum(qtf*idf*tf*2.5::DOUBLE/(tf+1.5::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl/avgdl))) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, bst GROUP BY ALL),
 lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, id) AS rank FROM sc) WHERE rank <= 20 AND score > 0)"""


DOCS = "SELECT doc_id AS id, text FROM documents"
JOBS = "SELECT conv_id*1000+turn AS id, text FROM conversations WHERE role='assistant'"
SEM = """sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, id) AS rank FROM (SELECT item_id AS query_id, v.vec_id AS id, list_dot_product(qv.embedding::DOUBLE[], v.embedding::DOUBLE[])/(sqrt(list_dot_product(qv.embedding::DOUBLE[], qv.embedding::DOUBLE[]))*sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score FROM benchmark JOIN embeddings qv ON qv.vec_id = item_id, embeddings v)) WHERE rank <= 20)"""
FUSED = """fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, sem_rank ASC NULLS LAST, lex_rank ASC NULLS LAST) AS fused_rank FROM (
 SELECT coalesce(s.query_id,l.query_id) AS query_id, coalesce(s.id,l.id) AS id, coalesce(s.score,0) AS semantic_score, coalesce(l.score,0) AS bm25_score, s.rank AS sem_rank, l.rank AS lex_rank,
 coalesce(1.0::DOUBLE/(60+s.rank),0)+coalesce(1.0::DOUBLE/(60+l.rank),0) AS rrf_score FROM sem s FULL OUTER JOIN lex l ON s.query_id=l.query_id AND s.id=l.id)))"""
HYBRID = f"WITH {bm25_sql(DOCS)}, {SEM}, {FUSED}"
OVERLAP = "CASE WHEN len(qt)>0 THEN len(list_intersect(qt, tt))::DOUBLE/len(qt) ELSE 0::DOUBLE END"
CE = f"""pairs AS (SELECT f.*, {TERMS.format(c='q.text', n=0)} AS qt, {TERMS.format(c="substring(coalesce(d.text,''),1,512)", n=0)} AS tt, coalesce(d.text,'') AS text, q.text AS query FROM fused f JOIN qs q ON q.query_id=f.query_id LEFT JOIN corpus d ON d.id=f.id WHERE fused_rank<=20),
 ce AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cross_encoder_score,9) DESC, fused_rank) AS final_rank FROM (SELECT *, {OVERLAP} AS cross_encoder_score FROM pairs))"""


@query(f"WITH {bm25_sql(DOCS)} SELECT n::BIGINT AS n, round(avgdl,6) AS avgdl FROM bst")
def bm25_stats(spark, sf):
    return retrieval.BM25(corpus(spark, sf)).stats().select(long("n"), r6("avgdl"))


@query(f"WITH {bm25_sql(DOCS)} SELECT term, df::BIGINT AS df, round(idf,6) AS idf FROM idf")
def bm25_idf(spark, sf):
    return retrieval.BM25(corpus(spark, sf)).idf().select("term", long("df"), r6("idf"))


@query(f"WITH {bm25_sql(DOCS)} SELECT query_id, id, round(score,6) AS score FROM sc")
def bm25_scores(spark, sf):
    return retrieval.BM25(corpus(spark, sf)).scores(items(spark, sf)).select("query_id", "id", r6("score"))


@query(f"WITH {bm25_sql(DOCS)} SELECT query_id, id, round(score,6) AS score, rank FROM lex")
def bm25_topk(spark, sf):
    return retrieval.BM25(corpus(spark, sf)).topk(items(spark, sf)).select("query_id", "id", r6("score"), "rank")


@query(f"WITH {bm25_sql(JOBS)} SELECT query_id, id, round(score,6) AS score, rank FROM lex")
def bm25_topk_job(spark, sf):
    return retrieval.BM25(jobs(spark, sf)).topk(items(spark, sf)).select("query_id", "id", r6("score"), "rank")


@query(f"WITH {SEM} SELECT query_id, id, round(score,6) AS score, rank FROM sem")
def semantic_topk(spark, sf):
    return retrieval.semantic_topk(vectors(spark, sf), query_vectors(spark, sf)).select("query_id", "id", r6("score"), "rank")


def fuse(spark, sf, limit=20):
    return retrieval.rrf_fusion(retrieval.semantic_topk(vectors(spark, sf), query_vectors(spark, sf)), retrieval.BM25(corpus(spark, sf)).topk(items(spark, sf)), limit=limit)


@query(f"{HYBRID} SELECT query_id, id, round(semantic_score,6) AS semantic_score, round(bm25_score,6) AS bm25_score, round(rrf_score,9) AS rrf_score, fused_rank FROM fused WHERE fused_rank<=20")
def rrf_fusion(spark, sf):
    return fuse(spark, sf).select("query_id", "id", r6("semantic_score"), r6("bm25_score"), F.round("rrf_score", 9).alias("rrf_score"), "fused_rank")


def run(spark, sf, strategy):
    out = retrieval.retrieve(strategy, corpus(spark, sf), vectors(spark, sf), items(spark, sf), query_vectors(spark, sf))
    return out.select("query_id", "id", r6("semantic_score"), r6("bm25_score"), r6("rrf_score"), r6("cross_encoder_score"), "final_rank")


@query(f"WITH {SEM} SELECT query_id, id, round(score,6) AS semantic_score, 0::DOUBLE AS bm25_score, 0::DOUBLE AS rrf_score, 0::DOUBLE AS cross_encoder_score, rank AS final_rank FROM sem WHERE rank<=5")
def retrieve_semantic_only(spark, sf):
    return run(spark, sf, "semantic_only")


@query(f"{HYBRID} SELECT query_id, id, round(semantic_score,6) AS semantic_score, round(bm25_score,6) AS bm25_score, round(rrf_score,6) AS rrf_score, 0::DOUBLE AS cross_encoder_score, fused_rank AS final_rank FROM fused WHERE fused_rank<=5")
def retrieve_hybrid_rrf(spark, sf):
    return run(spark, sf, "hybrid_rrf")


@query(f"{HYBRID}, {CE} SELECT query_id, id, round(semantic_score,6) AS semantic_score, round(bm25_score,6) AS bm25_score, round(rrf_score,6) AS rrf_score, round(cross_encoder_score,6) AS cross_encoder_score, final_rank FROM ce WHERE final_rank<=5")
def hybrid_rrf_rerank(spark, sf):
    return run(spark, sf, "hybrid_rrf_ce")


STRATEGY_SUMS = "count(DISTINCT query_id)::BIGINT AS n_queries, count(*)::BIGINT AS n_hits, round(avg(semantic_score),6) AS avg_semantic, round(avg(bm25_score),6) AS avg_bm25, round(avg(rrf_score),6) AS avg_rrf, round(avg(cross_encoder_score),6) AS avg_ce"


@query(f"""{HYBRID}, {CE}, found AS (SELECT 'semantic_only' AS strategy, query_id, score AS semantic_score, 0::DOUBLE AS bm25_score, 0::DOUBLE AS rrf_score, 0::DOUBLE AS cross_encoder_score FROM sem WHERE rank<=5
 UNION ALL SELECT 'hybrid_rrf', query_id, semantic_score, bm25_score, rrf_score, 0::DOUBLE FROM fused WHERE fused_rank<=5
 UNION ALL SELECT 'hybrid_rrf_ce', query_id, semantic_score, bm25_score, rrf_score, cross_encoder_score FROM ce WHERE final_rank<=5) SELECT strategy, {STRATEGY_SUMS} FROM found GROUP BY strategy""")
def strategy_ablation(spark, sf):
    """The three strategies run over all queries, and what they find."""
    found = None
    for name in retrieval.STRATEGIES:
        hits = retrieval.retrieve(name, corpus(spark, sf), vectors(spark, sf), items(spark, sf), query_vectors(spark, sf)).withColumn("strategy", F.lit(name))
        found = hits if found is None else found.unionByName(hits)
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return found.groupBy("strategy").agg(long(F.count_distinct("query_id"), "n_queries"), long(F.count("*"), "n_hits"), mean("semantic_score", "avg_semantic"), mean("bm25_score", "avg_bm25"), mean("rrf_score", "avg_rrf"), mean("cross_encoder_score", "avg_ce"))


LIVE = "SELECT id, text FROM (SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT conv_id*2 FROM conversations WHERE role='user') UNION ALL SELECT conv_id*2, text FROM (SELECT * FROM conversations WHERE role='user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)=1))"


@query(f"WITH {bm25_sql(LIVE)} SELECT query_id, id, round(score,6) AS score, rank FROM lex")
def bm25_index_topk(spark, sf):
    """A stored index of all documents, extended by the live additions (some replace documents), opened again and asked."""
    path = scratch(spark, "bm25")
    new = table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 2).alias("id"), "text", F.col("turn").alias("seq"))
    retrieval.BM25Index(spark, path).add(corpus(spark, sf))
    retrieval.BM25Index(spark, path).add(records.last_wins(new, "id", "seq"))
    return retrieval.BM25Index(spark, path).topk(items(spark, sf)).select("query_id", "id", r6("score"), "rank")


@query(f"{HYBRID}, {CE} SELECT query_id, id, fused_rank, md5(query) AS query, md5(text) AS text FROM pairs")
def rerank_pairs(spark, sf):
    p = retrieval.rerank_pairs(fuse(spark, sf), items(spark, sf), corpus(spark, sf))
    return p.select("query_id", "id", "fused_rank", F.md5("query").alias("query"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query(f"{HYBRID}, {CE} SELECT query_id, id, round(cross_encoder_score,6) AS cross_encoder_score, final_rank FROM ce")
def final_rank(spark, sf):
    out = retrieval.rerank(retrieval.rerank_pairs(fuse(spark, sf), items(spark, sf), corpus(spark, sf)))
    return out.select("query_id", "id", r6("cross_encoder_score"), "final_rank")


@query(f"WITH {SEM} SELECT s.query_id, s.id, s.rank, d.lang, d.source FROM sem s LEFT JOIN documents d ON d.doc_id=s.id")
def enrich_results(spark, sf):
    hits = retrieval.semantic_topk(vectors(spark, sf), query_vectors(spark, sf))
    return retrieval.enrich(hits, corpus(spark, sf)).select("query_id", "id", "rank", "original.lang", "original.source")


@query(f"WITH {SEM} SELECT s.query_id, s.id, s.rank FROM sem s WHERE s.id NOT IN (SELECT doc_id FROM documents)")
def orphan_hits(spark, sf):
    hits = retrieval.semantic_topk(vectors(spark, sf), query_vectors(spark, sf))
    return retrieval.orphan_hits(hits, corpus(spark, sf)).select("query_id", "id", "rank")


@query(f"WITH {bm25_sql(DOCS)} SELECT query_id, count(*)::BIGINT AS retrieval_count FROM lex GROUP BY query_id")
def retrieval_counts(spark, sf):
    return retrieval.BM25(corpus(spark, sf)).topk(items(spark, sf)).groupBy("query_id").agg(long(F.count("*"), "retrieval_count"))


def hits_with_text(spark, sf):
    return retrieval.BM25(corpus(spark, sf)).topk(items(spark, sf)).filter("rank <= 5").join(corpus(spark, sf).select("id", "text", "source"), "id")


@query(f"WITH {bm25_sql(DOCS)} SELECT query_id, md5(string_agg(substring(c.text,1,500), chr(10)||chr(10) ORDER BY rank)) AS context FROM lex JOIN corpus c USING (id) WHERE rank<=5 GROUP BY query_id")
def context_text(spark, sf):
    return retrieval.context_text(hits_with_text(spark, sf)).select("query_id", F.md5("context").alias("context"))


def prompt_sql(mode: str) -> str:
    head, middle, tail = (x.replace("'", "''") for x in evaluation.TEMPLATES[mode])
    return f"WITH {bm25_sql('SELECT doc_id AS id, text, source FROM documents')}, ctx AS (SELECT query_id, string_agg('{evaluation.ENTRY_LABELS[mode]} ' || rank || ': ' || c.source || chr(10) || substring(c.text,1,600), chr(10)||chr(10)||'---'||chr(10)||chr(10) ORDER BY rank) AS context FROM lex JOIN corpus c USING (id) WHERE rank<=5 GROUP BY query_id), p AS (SELECT qs.query_id, '{head}' || qs.text || '{middle}' || coalesce(context,'') || '{tail}' AS prompt FROM qs LEFT JOIN ctx USING (query_id))"


def prompts(spark, sf, mode):
    return evaluation.prompt(hits_with_text(spark, sf), items(spark, sf), mode, "source")


@query(prompt_sql("recruiter") + " SELECT query_id, md5(prompt) AS prompt FROM p")
def prompt_recruiter(spark, sf):
    return prompts(spark, sf, "recruiter").select("query_id", F.md5("prompt").alias("prompt"))


@query(prompt_sql("candidate") + " SELECT query_id, md5(prompt) AS prompt FROM p")
def prompt_candidate(spark, sf):
    return prompts(spark, sf, "candidate").select("query_id", F.md5("prompt").alias("prompt"))


@query(prompt_sql("recruiter_urdu") + " SELECT query_id, md5(prompt) AS prompt FROM p")
def prompt_recruiter_alt(spark, sf):
    return prompts(spark, sf, "recruiter_urdu").select("query_id", F.md5("prompt").alias("prompt"))


@query(prompt_sql("candidate_urdu") + " SELECT query_id, md5(prompt) AS prompt FROM p")
def prompt_candidate_alt(spark, sf):
    return prompts(spark, sf, "candidate_urdu").select("query_id", F.md5("prompt").alias("prompt"))


LINES = r"list_filter(list_transform(string_split(e, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(prompt_sql("recruiter") + rf""", ent AS (SELECT query_id, list_filter(list_transform(string_split(string_split(string_split(prompt,'{evaluation.ANSWERS[0][0]}')[2],'Based only on')[1], chr(10)||chr(10)||'---'||chr(10)||chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS es FROM p),
 one AS (SELECT query_id, i, {LINES} AS l FROM (SELECT query_id, i, es[i] AS e FROM ent, LATERAL (SELECT unnest(range(1, least(3,len(es))+1)) AS i)))
 SELECT query_id, md5('{evaluation.ANSWERS[0][1]}' || chr(10) || string_agg(i || '. ' || l[1] || ': ' || substring(coalesce(array_to_string(l[2:3],' '),''),1,240), chr(10) ORDER BY i) || chr(10) || '{evaluation.ANSWERS[0][2]}' || chr(10) || '{evaluation.NOTE}') AS answer FROM one GROUP BY query_id""")
def heuristic_answer(spark, sf):
    return prompts(spark, sf, "recruiter").select("query_id", F.md5(evaluation.heuristic_answer(F.col("prompt"))).alias("answer"))


# --- vectors
@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)),6) AS norm2, round(embedding[1]::DOUBLE/sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),6) AS first FROM embeddings")
def l2_normalize(spark, sf):
    v = vectors(spark, sf)
    return v.select(F.col("id").alias("vec_id"), F.round(T.dot(F.col("vec"), F.col("vec")), 6).alias("norm2"), F.round(T.normalize(F.col("vec"))[0], 6).alias("first"))


EMB = f"emb AS (SELECT item_id, s, count(*)::DOUBLE AS n FROM (SELECT item_id, ('0x'||substr(md5(t),1,8))::BIGINT % 64 AS s FROM (SELECT item_id, unnest({TOKS}) AS t FROM benchmark)) GROUP BY ALL)"


@query(f"WITH {EMB} SELECT item_id, s::BIGINT AS slot, round(n/sqrt(sum(n*n) OVER (PARTITION BY item_id)),6) AS weight FROM emb")
def hash_embedding(spark, sf):
    e = items(spark, sf).select(F.col("query_id").alias("item_id"), F.posexplode(T.hash_embedding(T.tokens(F.col("text")))).alias("slot", "weight"))
    return e.filter("weight > 0").select("item_id", long("slot"), r6("weight"))


# --- chunks
FIXED = r"""st AS (SELECT {i}, regexp_replace({t}, '^\s+|\s+$', '', 'g') AS t FROM {f}), fx AS (SELECT {i}, s, regexp_replace(substring(t, (s+1)::INT, 700), '^\s+|\s+$', '', 'g') AS c FROM st, LATERAL (SELECT unnest(range(0, length(t), 580)) AS s)),
 fixed AS (SELECT {i}, row_number() OVER (PARTITION BY {i} ORDER BY s) AS chunk_no, c FROM fx WHERE c <> '')"""


@query("WITH " + FIXED.format(i="doc_id", t="text", f="documents") + " SELECT doc_id, chunk_no, c AS chunk FROM fixed")
def fixed_chunks(spark, sf):
    out = chunking.chunk_dataset(corpus(spark, sf), "fixed")
    return out.select(F.col("source_id").alias("doc_id"), "chunk_no", F.col("text").alias("chunk"))


RECURSIVE = r"""para AS (SELECT doc_id, pi, ps[pi] AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10)||chr(10)), chr(10)||chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents), LATERAL (SELECT unnest(range(1, len(ps)+1)) AS pi)),
 sents AS (SELECT doc_id, pi, CASE WHEN length(p)<=700 THEN [p] ELSE """ + SENT.format(c="p") + r""" END AS ss FROM para),
 sent AS (SELECT doc_id, pi, si, ss[si] AS s FROM sents, LATERAL (SELECT unnest(range(1, len(ss)+1)) AS si)),
 cut AS (SELECT doc_id, pi, si, o, CASE WHEN length(s)<=700 THEN s ELSE regexp_replace(substring(s, (o+1)::INT, 700), '^\s+|\s+$', '', 'g') END AS u FROM sent, LATERAL (SELECT unnest(range(0, CASE WHEN length(s)<=700 THEN 1 ELSE length(s) END, 620)) AS o)),
 units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si, o) AS n, u FROM cut WHERE u <> ''),
 pack(doc_id, n, chunk_no, cur) AS (SELECT doc_id, n, 1, u FROM units WHERE n=1 UNION ALL SELECT x.doc_id, x.n, CASE WHEN length(k.cur)+1+length(x.u)<=700 THEN k.chunk_no ELSE k.chunk_no+1 END, CASE WHEN length(k.cur)+1+length(x.u)<=700 THEN k.cur||' '||x.u ELSE x.u END FROM pack k JOIN units x ON x.doc_id=k.doc_id AND x.n=k.n+1)"""


@query("WITH RECURSIVE " + RECURSIVE + " SELECT doc_id, chunk_no::BIGINT AS chunk_no, arg_max(cur, n) AS chunk FROM pack GROUP BY doc_id, chunk_no")
def recursive_chunks(spark, sf):
    out = chunking.chunk_dataset(corpus(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "recursive")
    return out.select(F.col("source_id").alias("doc_id"), "chunk_no", F.col("text").alias("chunk"))


@query("WITH " + FIXED.format(i="conv_id, turn", t="text", f="(SELECT * FROM conversations WHERE role='assistant')") + " SELECT (conv_id*1000+turn) || '_' || chunk_no AS id, conv_id*1000+turn AS source_id, 'fixed' AS chunking, c AS text FROM fixed")
def chunk_dataset(spark, sf):
    return chunking.chunk_dataset(jobs(spark, sf), "fixed").select("id", "source_id", "chunking", "text")


# --- records
@query("SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) FILTER (o_orderkey IS NOT NULL), '') AS orders FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey")
def nested_export_customer(spark, sf):
    order = (F.col("o_orderdate").isNull(), -F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"))
    out = records.nest(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey", "orders", order, ("o_orderkey", "o_totalprice"))
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT o_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_partkey IS NOT NULL), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_orderkey")
def nested_export_lines(spark, sf):
    out = records.nest(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "lines", (F.col("l_linenumber"), F.col("l_partkey")), ("l_partkey",))
    return out.select("o_orderkey", F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("lines"))


@query("SELECT c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey")
def nested_export_one(spark, sf):
    out = records.nest_first(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey", "first", (F.col("o_orderdate"), F.col("o_orderkey")), ("o_orderkey",))
    return out.select("c_custkey", F.col("first.o_orderkey").alias("first_order"))


@query("SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"cents\":' || round(o_totalprice*100)::BIGINT || '}' AS value FROM orders")
def nested_export_json(spark, sf):
    """Written as nested JSON and read again."""
    from tessera.sources.files import write_nested_json

    o, path = table(spark, sf, "orders"), scratch(spark, "nested")
    write_nested_json(o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), path)
    return spark.read.text(path)


@query("SELECT event_id, user_id, event_type, round(value,6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)=1")
def upsert_last_wins(spark, sf):
    return records.last_wins(table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "event_type", r6("value"))


@query("SELECT id, text, lang FROM (SELECT doc_id AS id, md5(text) AS text, lang FROM documents WHERE doc_id NOT IN (SELECT conv_id*2 FROM conversations WHERE role='user') UNION ALL SELECT conv_id*2, md5(text), NULL FROM (SELECT * FROM conversations WHERE role='user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)=1))")
def live_append_union(spark, sf):
    new = table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 2).alias("id"), F.md5("text").alias("text"), F.col("turn").alias("seq"))
    return records.upsert(corpus(spark, sf).select("id", F.md5("text").alias("text"), "lang"), new, "id", "seq").select("id", "text", "lang")


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS n_categories, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM documents)) AS categories, count(*)>0 AS ok FROM documents")
def verify_corpus(spark, sf):
    return records.verify(table(spark, sf, "documents"), "source")


@query("SELECT doc_id, printf('JOB_%05d', row_number() OVER (ORDER BY doc_id)-1) AS job_id FROM documents")
def positional_ids(spark, sf):
    return records.positional_ids(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("ident").alias("job_id"))


@query("SELECT printf('USER_%04d', max(user_id)+1) AS next_id FROM events")
def next_user_id(spark, sf):
    ids = table(spark, sf, "events").select(F.when(F.col("event_id") % 11 == 0, "USER_x").otherwise(F.format_string("USER_%04d", "user_id")).alias("id"), "user_id")
    ids = ids.unionByName(table(spark, sf, "events").select(F.format_string("USER_%04d", "user_id").alias("id"), "user_id"))
    return ids.agg(records.next_id(F.col("id"), "USER_").alias("next_id"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, (SELECT count(DISTINCT source) FROM documents) AS k FROM documents) SELECT doc_id, source FROM (SELECT * FROM c WHERE n <= greatest(1, 80 // k) ORDER BY source, n LIMIT 80)")
def stratified_sample(spark, sf):
    return records.stratified_sample(table(spark, sf, "documents"), "source", "doc_id", 80).select("doc_id", "source")


@query("SELECT doc_id, md5(text) AS text FROM documents ORDER BY doc_id LIMIT 40")
def limit_in_order(spark, sf):
    return table(spark, sf, "documents").orderBy("doc_id").limit(40).select("doc_id", F.md5("text").alias("text"))


@query(f"WITH {CAND} SELECT doc_id, concat_ws(' ', nullif(trim(name),''), nullif(trim(category),''), nullif(trim(location),'')) AS text FROM cand")
def compose_text(spark, sf):
    parts = (F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("name", "category", "location"))
    return candidates(spark, sf).select("doc_id", F.concat_ws(" ", *parts).alias("text"))


@query(f"WITH {CAND} SELECT doc_id, coalesce(trim(name)<>'' AND trim(skills)<>'', false) AS ok FROM cand")
def validate_required(spark, sf):
    good, bad = records.valid_rows(candidates(spark, sf), "name", "skills")
    return good.select("doc_id", F.lit(True).alias("ok")).unionByName(bad.select("doc_id", F.lit(False).alias("ok")))


@query(f"WITH {CAND} SELECT doc_id, coalesce(array_to_string({SPLIT.format(c='skills', s=',')}[1:10], ', '), '') AS shown FROM cand")
def skills_display(spark, sf):
    return candidates(spark, sf).select("doc_id", F.array_join(F.slice(T.split_list(F.coalesce("skills", F.lit(""))), 1, 10), ", ").alias("shown"))


@query(f"WITH {CAND} SELECT doc_id, coalesce(nullif(name,''), nullif(category,''), 'Unknown') AS title, coalesce(nullif(location,''), nullif(category,''), '') AS subtitle FROM cand")
def display_title(spark, sf):
    return candidates(spark, sf).select("doc_id", T.first_present(F.col("name"), F.col("category"), default="Unknown").alias("title"), T.first_present(F.col("location"), F.col("category")).alias("subtitle"))


@query("SELECT conv_id, turn FROM conversations WHERE trim(CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END) <> ''")
def query_guard(spark, sf):
    c = table(spark, sf, "conversations").withColumn("query", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")))
    return records.valid_rows(c, "query")[0].select("conv_id", "turn")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'recruiter' ELSE 'candidate' END AS mode FROM benchmark WHERE (item_id % 2 = 0 AND item_id < 20) OR (item_id % 2 = 1 AND item_id < 2 * greatest(1, least(10 // 2, 5)))")
def eval_query_subset(spark, sf):
    """Ten queries of the first mode and max(1, min(10 div 2, 5)) of the second, in order."""
    q = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "recruiter").otherwise("candidate").alias("mode"))
    first = q.filter("mode = 'recruiter'").orderBy("item_id").limit(10)
    return first.unionByName(q.filter("mode = 'candidate'").orderBy("item_id").limit(max(1, min(10 // 2, 5))))


@query("SELECT strategy, item_id FROM (VALUES ('semantic_only'),('hybrid_rrf'),('hybrid_rrf_ce')) s(strategy), benchmark")
def strategy_grid(spark, sf):
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, retrieval.STRATEGIES))).alias("strategy"))
    return grid.crossJoin(table(spark, sf, "benchmark").select("item_id"))


# --- evaluation
PAIRS = "pairs AS (SELECT a.conv_id*1000+a.turn AS id, a.text AS answer, q.text AS query FROM conversations a JOIN conversations q ON q.conv_id=a.conv_id AND q.turn=a.turn-1 AND q.role='user' WHERE a.role='assistant')"


def answered(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("answer"))
    q = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("t"), F.col("text").alias("query"))
    return a.join(q, ["conv_id", "t"]).select((F.col("conv_id") * 1000 + F.col("t")).alias("id"), "answer", "query")


CLAIMS = "cl AS (SELECT id, query, answer, (" + SENT.format(c="answer") + ")[1:3] AS cs FROM pairs), claims AS (SELECT id, query, i, cs[i] AS claim FROM cl, LATERAL (SELECT unnest(range(1, len(cs)+1)) AS i))"
SUPPORT = f"sup AS (SELECT id, i, claim, len(list_intersect({TERMS.format(c='claim', n=3)}, {TERMS.format(c='substring(query,1,800)', n=3)}))>=2 AS supported FROM claims)"


def claimed(spark, sf):
    return answered(spark, sf).select("id", "query", F.posexplode(evaluation.claims(F.col("answer"))).alias("i", "claim"))


@query(f"WITH {PAIRS}, {CLAIMS} SELECT id, i::BIGINT AS i, claim FROM claims")
def claim_extract(spark, sf):
    return claimed(spark, sf).select("id", long(F.col("i") + 1, "i"), "claim")


@query(f"WITH {PAIRS}, {CLAIMS}, {SUPPORT} SELECT id, i::BIGINT AS i, supported FROM sup")
def claim_support(spark, sf):
    return claimed(spark, sf).select("id", long(F.col("i") + 1, "i"), evaluation.supported(F.col("claim"), F.col("query")).alias("supported"))


@query(f"WITH {PAIRS}, {CLAIMS}, {SUPPORT} SELECT id, round(avg(supported::INT::DOUBLE),6) AS faithfulness FROM sup GROUP BY id")
def faithfulness_score(spark, sf):
    s = claimed(spark, sf).withColumn("ok", evaluation.supported(F.col("claim"), F.col("query")).cast("double"))
    return s.groupBy("id").agg(F.round(F.coalesce(F.avg("ok"), F.lit(0.0)), 6).alias("faithfulness"))


@query(rf"WITH {PAIRS} SELECT id, len((list_filter(list_transform(string_split_regex(answer, '[۔.!?]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))[1:3])::BIGINT AS n_claims, 0::DOUBLE AS faithfulness FROM pairs")
def faithfulness_alt(spark, sf):
    """The second judge: claims are cut without their marks, and none is ever supported."""
    judge = evaluation.lexical_judge_urdu()
    each = answered(spark, sf).select("id", "query", F.posexplode(judge.claims(F.col("answer"))).alias("i", "claim"))
    ok = judge.verify(F.col("claim"), F.col("query"))["supported"].cast("double")
    found = each.groupBy("id").agg(F.count("*").alias("n_claims"), F.avg(ok).alias("faithfulness"))
    return answered(spark, sf).select("id").join(found, "id", "left").select("id", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("faithfulness", F.lit(0.0)).alias("faithfulness"))


@query(f"WITH {PAIRS}, {CLAIMS}, {SUPPORT} SELECT id, i::BIGINT AS i, supported, CASE WHEN supported THEN '{evaluation.REASONS[0]}' ELSE '{evaluation.REASONS[1]}' END AS reason FROM sup")
def claim_verdict(spark, sf):
    judge = evaluation.lexical_judge()
    each = answered(spark, sf).select("id", "query", F.posexplode(judge.claims(F.col("answer"))).alias("i", "claim"))
    return each.select("id", long(F.col("i") + 1, "i"), judge.verify(F.col("claim"), F.col("query")).alias("v")).select("id", "i", "v.supported", "v.reason")


TOPIC = "coalesce(nullif(array_to_string((list_filter(regexp_extract_all({c}, '[a-zA-Z][a-zA-Z0-9_]+'), lambda x: length(x)>4))[1:3], ' '),''), 'the provided answer')"


@query(f"WITH {PAIRS} SELECT id, 'What are the main points about ' || {TOPIC.format(c='answer')} || '?' AS q1, 'Which skills or qualifications are emphasized in ' || {TOPIC.format(c='answer')} || '?' AS q2, 'What gaps or next steps are suggested in ' || {TOPIC.format(c='answer')} || '?' AS q3 FROM pairs")
def heuristic_questions(spark, sf):
    q = answered(spark, sf).select("id", evaluation.questions(F.col("answer")).alias("q"))
    return q.select("id", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)))


@query(rf"""WITH {PAIRS}, qs AS (SELECT id, 0 AS k, query AS text FROM pairs UNION ALL SELECT id, k, CASE k WHEN 1 THEN 'What are the main points about ' WHEN 2 THEN 'Which skills or qualifications are emphasized in ' ELSE 'What gaps or next steps are suggested in ' END || {TOPIC.format(c='answer')} || '?' FROM pairs, (VALUES (1),(2),(3)) v(k)),
 e AS (SELECT id, k, s, count(*)::DOUBLE AS n FROM (SELECT id, k, ('0x'||substr(md5(t),1,8))::BIGINT % 64 AS s FROM (SELECT id, k, unnest({TOKS}) AS t FROM qs)) GROUP BY ALL), u AS (SELECT id, k, s, n/sqrt(sum(n*n) OVER (PARTITION BY id, k)) AS w FROM e)
 SELECT p.id, round(coalesce(sum(a.w*b.w),0)/3,6) AS relevancy FROM pairs p LEFT JOIN u a ON a.id=p.id AND a.k=0 LEFT JOIN u b ON b.id=p.id AND b.k>0 AND b.s=a.s GROUP BY p.id""")
def relevancy_score(spark, sf):
    return answered(spark, sf).select("id", F.round(evaluation.relevancy(F.col("query"), evaluation.questions(F.col("answer"))), 6).alias("relevancy"))


@query("SELECT event_id, coalesce(nullif(props->>'$.generated_text',''), props) AS text FROM events")
def extract_json_paths(spark, sf):
    return table(spark, sf, "events").select("event_id", evaluation.response_text(F.col("props")).alias("text"))


@query("SELECT event_id, event_type || '|' || user_id AS items FROM events")
def json_array_salvage(spark, sf):
    raw = F.concat(F.lit('Sure: ["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"] done'))
    return table(spark, sf, "events").select("event_id", F.array_join(evaluation.array_salvage(raw), "|").alias("items"))


@query("SELECT event_id, event_id % 3 = 0 AS supported, CASE WHEN event_id % 3 = 2 THEN 'parse error' ELSE event_type END AS reason FROM events")
def json_object_salvage(spark, sf):
    e = table(spark, sf, "events")
    n = F.col("event_id") % 3
    raw = F.when(n == 2, F.concat(F.lit('no {"supported": tr'), "event_type")).otherwise(F.concat(F.lit('ok {"supported": '), F.when(n == 0, "true").otherwise('"true"'), F.lit(', "reason": "'), "event_type", F.lit('"} end')))
    return e.select("event_id", evaluation.object_salvage(raw).alias("o")).select("event_id", "o.supported", "o.reason")


# --- experiments: events as rows, event_type as the strategy
def experiment(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("strategy"), "event_id", (F.abs("value") / (1 + F.abs("value"))).alias("faithfulness"), (F.col("user_id") % 10 / 10.0).alias("relevancy"), *((F.abs("value") * k / 100.0).alias(m) for k, m in enumerate(evaluation.METRICS[2:], 1)))


EXP = "ex AS (SELECT event_type AS strategy, event_id, abs(value)/(1+abs(value)) AS faithfulness, (user_id % 10)/10::DOUBLE AS relevancy, " + ", ".join(f"abs(value)*{k}/100::DOUBLE AS {m}" for k, m in enumerate(evaluation.METRICS[2:], 1)) + " FROM events)"
AVGS = ", ".join(f"round(avg({m}),6) AS avg_{m}" for m in evaluation.METRICS)


def rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {EXP} SELECT strategy, count(*)::BIGINT AS count, {AVGS} FROM ex GROUP BY strategy")
def summary_by_strategy(spark, sf):
    return rounded(evaluation.summarize(experiment(spark, sf), "strategy"))


KINDS = ("click", "missing", "view")
KEYED = f"WITH {EXP}, s AS (SELECT strategy, count(*)::BIGINT AS count, " + ", ".join(f"avg({m}) AS avg_{m}" for m in evaluation.METRICS) + " FROM ex GROUP BY strategy), k AS (SELECT v.strategy, v.ordinal, coalesce(count,0) AS count, " + ", ".join(f"round(coalesce(avg_{m},0),6) AS avg_{m}" for m in evaluation.METRICS) + " FROM (VALUES ('click',0),('missing',1),('view',2)) v(strategy, ordinal) LEFT JOIN s USING (strategy))"


def keyed(spark, sf):
    return evaluation.summarize(experiment(spark, sf), "strategy", KINDS)


@query(f"{KEYED} SELECT strategy, ordinal::BIGINT AS ordinal, count::BIGINT AS count, " + ", ".join(f"avg_{m}" for m in evaluation.METRICS) + " FROM k")
def summary_in_order(spark, sf):
    return rounded(keyed(spark, sf))


@query(f"{KEYED} SELECT strategy, round(avg_faithfulness+avg_relevancy,5) AS score FROM k ORDER BY avg_faithfulness+avg_relevancy DESC, ordinal LIMIT 1")
def pick_best_strategy(spark, sf):
    return evaluation.pick_best(keyed(spark, sf), "strategy").select("strategy", F.round("score", 5).alias("score"))


@query(f"{KEYED} SELECT 'avg_faithfulness' AS metric, (SELECT strategy FROM k ORDER BY avg_faithfulness DESC, ordinal LIMIT 1) AS strategy UNION ALL SELECT 'avg_relevancy', (SELECT strategy FROM k ORDER BY avg_relevancy DESC, ordinal LIMIT 1)")
def best_per_metric(spark, sf):
    return evaluation.best_per_metric(keyed(spark, sf), "strategy").select("metric", "strategy")


@query(f"{KEYED} SELECT upper(strategy[1]) || strategy[2:] AS label, printf('%.4f', avg_faithfulness) AS faithfulness, printf('%.4f', avg_relevancy) AS relevancy, printf('%.3f', avg_retrieval_s) AS retrieval, printf('%.3f', avg_total_s) AS total FROM k")
def ablation_csv_rows(spark, sf):
    n = evaluation.number
    return keyed(spark, sf).select(F.initcap("strategy").alias("label"), n(F.col("avg_faithfulness")).alias("faithfulness"), n(F.col("avg_relevancy")).alias("relevancy"), n(F.col("avg_retrieval_s"), 3).alias("retrieval"), n(F.col("avg_total_s"), 3).alias("total"))


@query(f"{KEYED} SELECT '| ' || strategy || ' | ' || printf('%.1f%%', avg_faithfulness*100) || ' | ' || printf('%.1f%%', avg_relevancy*100) || ' | ' || printf('%.3f', avg_retrieval_s) || ' |' AS line FROM k")
def ablation_report_rows(spark, sf):
    return keyed(spark, sf).select(F.concat(F.lit("| "), "strategy", F.lit(" | "), evaluation.percent(F.col("avg_faithfulness")), F.lit(" | "), evaluation.percent(F.col("avg_relevancy")), F.lit(" | "), evaluation.number(F.col("avg_retrieval_s"), 3), F.lit(" |")).alias("line"))


@query("WITH RECURSIVE " + FIXED.format(i="doc_id", t="text", f="documents") + ", " + RECURSIVE + " SELECT 'fixed' AS chunking, count(*)::BIGINT AS chunk_count FROM fixed UNION ALL SELECT 'recursive', count(*)::BIGINT FROM (SELECT DISTINCT doc_id, chunk_no FROM pack)")
def chunk_summary(spark, sf):
    doubled = corpus(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    both = chunking.chunk_dataset(corpus(spark, sf), "fixed").unionByName(chunking.chunk_dataset(doubled, "recursive"))
    return both.groupBy("chunking").agg(F.count("*").alias("chunk_count"))


def hashed_sql(name: str, key: str, rows: str) -> str:
    return f"""{name}0 AS (SELECT {key}, s, count(*)::DOUBLE AS n FROM (SELECT {key}, ('0x'||substr(md5(t),1,8))::BIGINT % 64 AS s FROM (SELECT {key}, unnest({TOKS}) AS t FROM {rows})) GROUP BY ALL),
 {name} AS (SELECT {key}, s, n/sqrt(sum(n*n) OVER (PARTITION BY {key})) AS w FROM {name}0)"""


def chunk_sql(chunks: str, corpus: str) -> str:
    """The best five chunks of each query under the full strategy. corpus: (id, text) of the chunks, from the tables that `chunks` makes."""
    sem = f"""{hashed_sql('cv', 'id', 'corpus')}, {hashed_sql('qv', 'query_id', 'qs')},
 sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, id) AS rank FROM (SELECT qv.query_id, cv.id, sum(qv.w*cv.w) AS score FROM qv JOIN cv ON qv.s = cv.s GROUP BY ALL)) WHERE rank<=20)"""
    return f"WITH RECURSIVE {chunks}, {bm25_sql(corpus)}, {sem}, {FUSED}, {CE.replace(' WHERE fused_rank<=20', '')} SELECT query_id, id, round(cross_encoder_score,6) AS cross_encoder_score, final_rank FROM ce WHERE final_rank<=5"


FIXED_CHUNKS = chunk_sql(FIXED.format(i="doc_id", t="text", f="documents"), "SELECT doc_id || '_' || chunk_no AS id, c AS text FROM fixed")
RECURSIVE_CHUNKS = chunk_sql(RECURSIVE, "SELECT doc_id || '_' || chunk_no AS id, arg_max(cur, n) AS text FROM pack GROUP BY doc_id, chunk_no")


def chunks_found(spark, sf, method):
    docs = corpus(spark, sf)
    if method == "recursive":
        docs = docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    cut = held(chunking.chunk_dataset(docs, method).select("id", "text"), "chunks")
    found = retrieval.chunk_retrieve(cut, items(spark, sf))
    return found.select("query_id", "id", r6("cross_encoder_score"), "final_rank")


@query(FIXED_CHUNKS)
def chunk_retrieve(spark, sf):
    """The chunk retriever over a table of fixed chunks: embedded, indexed, fused without a cut, reranked."""
    return chunks_found(spark, sf, "fixed")


@query(f"SELECT 'fixed' AS chunking, * FROM ({FIXED_CHUNKS}) UNION ALL SELECT 'recursive' AS chunking, * FROM ({RECURSIVE_CHUNKS})")
def chunk_ablation(spark, sf):
    """Both chunkings under the full strategy. A chunk's id is its document's and its number."""
    named = lambda m: chunks_found(spark, sf, m).select(F.lit(m).alias("chunking"), "*")
    return named("fixed").unionByName(named("recursive"))


@query(f"SELECT count(*)::BIGINT AS count, round(avg(faithfulness),5) AS avg_faithfulness, round(avg(relevancy),5) AS avg_relevancy FROM ({ORACLE_SQL['faithfulness_score']}) JOIN ({ORACLE_SQL['relevancy_score']}) USING (id)")
def fixed_set_summary(spark, sf):
    both = faithfulness_score(spark, sf).join(relevancy_score(spark, sf), "id")
    return both.agg(F.count("*").alias("count"), F.round(F.avg("faithfulness"), 5).alias("avg_faithfulness"), F.round(F.avg("relevancy"), 5).alias("avg_relevancy"))


@query(f"WITH {PAIRS} SELECT id, replace(substring(answer,1,350), chr(10), ' ') AS excerpt FROM pairs ORDER BY id LIMIT 3")
def report_examples(spark, sf):
    return answered(spark, sf).orderBy("id").limit(3).select("id", F.translate(T.prefix(F.col("answer"), 350), "\n", " ").alias("excerpt"))


# --- files
@query("SELECT doc_id, md5(text) AS text, lang FROM documents")
def scan_jsonl_roundtrip(spark, sf):
    from tessera.sources.files import read_jsonl

    path = scratch(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.json(path)
    return read_jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text"), "lang")


@query("SELECT doc_id, md5(text) AS text, lang FROM documents")
def scan_csv_roundtrip(spark, sf):
    from tessera.sources.files import append_csv, read_csv

    path = scratch(spark, "csv")
    append_csv(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return read_csv(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text"), "lang")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    import uuid

    from tessera.sources.files import shared_folder

    return f"{shared_folder(spark)}/tessera-files/{uuid.uuid4().hex}-{tag}"
