"""Experiments: strategies and chunkings run end to end over a batch of queries, timed by stage, summarised, and reported.

A stage is one plan over all queries, written to the work folder; a query's seconds are the stage's wall clock over the number of queries.
Summaries and the three examples are the only rows that reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import chunking, evaluation, retrieval

# Heads of the report's tables, columns of the CSV.
HEADS = ("Faithfulness", "Relevancy", "Avg Retrieval (s)", "Avg Total (s)")
CSV = ("Strategy", "Faithfulness", "Relevancy", "Avg Retrieval Time (s)", "Avg Total Time (s)")
SUMMARY = ("count", *(f"avg_{m}" for m in evaluation.METRICS))
CHUNKINGS = ("fixed", "recursive")


def run_queries(strategy: str, corpus: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, work: str, mode: str = "candidate", config: Config | None = None, generate: Callable[[Column], Column] = evaluation.heuristic_answer, scorer=retrieval.overlap_score, judge: evaluation.Judge | None = None, index: retrieval.BM25Index | None = None, fused_limit: bool = True) -> DataFrame:
    """A row per query: counts, scores and seconds, with answer, verified claims (claim, supported, reason) and questions.

    corpus(id, title, text), vectors(id, vec), queries(query_id, text), query_vectors(query_id, vec). A query without hits has an empty
    context; scores of a query without claims are 0.
    """
    c, spark = config or Config(), corpus.sparkSession
    judge = judge or evaluation.lexical_judge(c.max_claims)
    n = max(1, queries.count())

    def stage(df: DataFrame, name: str) -> tuple[DataFrame, float]:
        start = time.perf_counter()
        df.write.mode("overwrite").parquet(f"{work}/{strategy}/{name}")
        return spark.read.parquet(f"{work}/{strategy}/{name}"), (time.perf_counter() - start) / n

    hits = retrieval.retrieve(strategy, corpus, vectors, queries, query_vectors, c, scorer, fused_limit=fused_limit, index=index)
    hits, retrieval_s = stage(hits.join(corpus.select("id", "title", "text"), "id", "left"), "hits")
    prompts = evaluation.prompt(hits, queries, mode, "title", "final_rank")
    answers, generation_s = stage(prompts.select("query_id", generate(F.col("prompt")).alias("answer")), "answers")
    count = hits.groupBy("query_id").agg(F.count("*").alias("retrieval_count"))
    rows = queries.select("query_id", F.col("text").alias("query")).join(answers, "query_id").join(retrieval.context_text(hits, "final_rank"), "query_id", "left").join(count, "query_id", "left")
    rows = rows.withColumns({"claims": judge.claims(F.col("answer")), "context": F.coalesce("context", F.lit("")), "retrieval_count": F.coalesce("retrieval_count", F.lit(0).cast("long"))})
    verified = rows.select("query_id", "context", F.posexplode("claims").alias("at", "claim")).withColumn("verdict", judge.verify(F.col("claim"), F.col("context")))
    verified = verified.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "claim", "verdict.supported", "verdict.reason"))).alias("verified"))
    verified = verified.withColumn("verified", F.transform("verified", lambda x: F.struct(x["claim"].alias("claim"), x["supported"].alias("supported"), x["reason"].alias("reason"))))
    rows = rows.join(verified, "query_id", "left").withColumn("questions", judge.questions(F.col("answer"), F.col("query")))
    true = F.size(F.filter("verified", lambda x: x["supported"])) / F.size("verified")
    scores = {"faithfulness": F.coalesce(true, F.lit(0.0)), "relevancy": evaluation.relevancy(F.col("query"), F.col("questions"))}
    rows, evaluation_s = stage(rows.withColumns(scores).drop("context"), "scores")
    seconds = {"retrieval_s": retrieval_s, "generation_s": generation_s, "evaluation_s": evaluation_s, "total_s": retrieval_s + generation_s + evaluation_s}
    return rows.withColumns({"strategy": F.lit(strategy), "mode": F.lit(mode), **{k: F.lit(v) for k, v in seconds.items()}})


def _summary(rows: DataFrame) -> dict:
    got = evaluation.summarize(rows.withColumn("all", F.lit(0)), "all").first()
    return {k: got[k] if got else 0 for k in SUMMARY}


def fixed_set(corpora: dict[str, DataFrame], embed: Callable[[DataFrame], DataFrame], queries: dict[str, DataFrame], work: str, most: int = 10, config: Config | None = None, **models) -> DataFrame:
    """Rows of the fixed set under the full strategy: the first `most` recruiter queries and max(1, most div 2) candidate queries, by query_id.

    corpora: what the queries of a mode search, (id, title, text); a mode without one is left out.
    """
    out = None
    for mode, n in (("recruiter", most), ("candidate", max(1, most // 2))):
        if mode not in corpora or mode not in queries:
            continue
        asked, corpus = queries[mode].orderBy("query_id").limit(n), corpora[mode]
        qv, v = _vectors(embed, corpus, asked, f"{work}/{mode}")
        rows = run_queries("hybrid_rrf_ce", corpus, v, asked, qv, f"{work}/{mode}", mode, config, **models)
        out = rows if out is None else out.unionByName(rows)
    return out


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _vectors(embed: Callable[[DataFrame], DataFrame], corpus: DataFrame, queries: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    asked = embed(queries.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
    return _written(asked, f"{work}/query_vectors"), _written(embed(corpus.select("id", "text")), f"{work}/vectors")


def experiment(corpora: DataFrame | dict[str, DataFrame], embed: Callable[[DataFrame], DataFrame], queries: DataFrame | dict[str, DataFrame], work: str, mode: str = "candidate", config: Config | None = None, sizes: tuple[int, int, int] = (10, 5, 3), **models) -> dict:
    """The document {run_at, config, baseline_fixed_set, ablation: {retrieval, chunking}}. embed turns (id, text) into (id, vec).

    corpora, queries: one table each, or one for each mode ("recruiter", "candidate"). sizes: how many queries the fixed set, the retrieval
    and the chunking ablation take, by query_id; both ablations use the queries and the corpus of `mode`.
    """
    c = config or Config()
    corpora, queries = (x if isinstance(x, dict) else {mode: x} for x in (corpora, queries))
    corpus, spark = corpora[mode], corpora[mode].sparkSession
    first = lambda n: queries[mode].orderBy("query_id").limit(n)
    fixed = fixed_set(corpora, embed, queries, f"{work}/fixed", sizes[0], c, **models)
    asked = first(sizes[1])
    query_vectors, vectors = _vectors(embed, corpus, asked, f"{work}/retrieval")
    by_strategy = {s: run_queries(s, corpus, vectors, asked, query_vectors, f"{work}/retrieval", mode, c, **models) for s in retrieval.STRATEGIES}
    by_chunking, asked = {}, first(sizes[2])
    for method in CHUNKINGS:
        cut = chunking.chunk_dataset(corpus, method).select("id", F.col("source_id").alias("of"), "text")
        cut = _written(cut.join(corpus.select(F.col("id").alias("of"), "title"), "of").select("id", "title", "text"), f"{work}/chunks/{method}")
        query_vectors, vectors = _vectors(embed, cut, asked, f"{work}/chunks/{method}-of")
        rows = run_queries("hybrid_rrf_ce", cut, vectors, asked, query_vectors, f"{work}/chunking/{method}", mode, c, fused_limit=False, **models)
        by_chunking[method] = {"chunk_count": cut.count(), **_summary(rows)}
    kept = F.slice("verified", 1, 3).alias("verified")
    examples = fixed.orderBy(F.desc("mode"), "query_id").limit(3).select("query", "mode", F.translate(F.substring("answer", 1, 350), "\n", " ").alias("answer"), kept, "faithfulness", "relevancy").collect()
    run_at = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    return {
        "run_at": run_at,
        "config": {"top_k": c.top_k, "top_k_final": c.top_k_final, "max_claims": c.max_claims, "queries": list(sizes)},
        "baseline_fixed_set": {"summary": _summary(fixed), "example_verifications": [r.asDict(recursive=True) for r in examples]},
        "ablation": {"retrieval": {"summary_by_strategy": {s: _summary(r) for s, r in by_strategy.items()}}, "chunking": {"summary_by_chunking": by_chunking}},
    }


def ablation_rows(document: dict) -> list[tuple]:
    """The rows of the ablation CSV, under the columns CSV."""
    found = document["ablation"]
    named = [(evaluation.LABELS[k], s) for k, s in found["retrieval"]["summary_by_strategy"].items()]
    named += [(f"Chunking: {k.title()} (Hybrid + RRF + CE)", s) for k, s in found["chunking"]["summary_by_chunking"].items()]
    return [(label, f"{s['avg_faithfulness']:.4f}", f"{s['avg_relevancy']:.4f}", f"{s['avg_retrieval_s']:.3f}", f"{s['avg_total_s']:.3f}") for label, s in named]


def report(document: dict) -> str:
    """A Markdown report: the fixed set, both ablations with the best strategy, and examples. Missing parts count as empty."""
    fixed, found = document.get("baseline_fixed_set", {}), document.get("ablation", {})
    strategies = found.get("retrieval", {}).get("summary_by_strategy", {})
    chunkings = found.get("chunking", {}).get("summary_by_chunking", {})

    def line(*cells) -> str:
        return "| " + " | ".join(map(str, cells)) + " |"

    def figures(s: dict) -> list[str]:
        get = lambda k: s.get(f"avg_{k}", 0.0)
        return [f"{get('faithfulness') * 100:.1f}%", f"{get('relevancy') * 100:.1f}%", f"{get('retrieval_s'):.3f}", f"{get('total_s'):.3f}"]

    out = [f"# Experiment of {document.get('run_at', 'unknown time')}", "", "## Fixed set", "", line("Queries", *HEADS), "|---:" * 5 + "|", line(fixed.get("summary", {}).get("count", 0), *figures(fixed.get("summary", {})))]
    out += ["", "## Retrieval", "", line("Strategy", *HEADS), "|---" + "|---:" * 4 + "|", *(line(evaluation.LABELS.get(k, k), *figures(s)) for k, s in strategies.items())]
    if strategies:
        best = max(strategies, key=lambda k: round(strategies[k].get("avg_faithfulness", 0.0) + strategies[k].get("avg_relevancy", 0.0), 9))
        out += ["", f"Best: {evaluation.LABELS.get(best, best)}"]
    out += ["", "## Chunking", "", line("Chunking", "Chunks", *HEADS), "|---" + "|---:" * 5 + "|", *(line(k.title(), s.get("chunk_count", 0), *figures(s)) for k, s in chunkings.items())]
    out += ["", "## Examples"]
    for e in fixed.get("example_verifications", [])[:3]:
        out += ["", f"**{e['query']}** ({e['mode']}; faithfulness {e['faithfulness'] * 100:.1f}%, relevancy {e['relevancy'] * 100:.1f}%)", "", e["answer"], ""]
        out += [f"- {'Supported' if x['supported'] else 'Not supported'}: {x['claim']}" + (f" ({x['reason']})" if x["reason"] else "") for x in e["verified"][:3]]
    return "\n".join(out) + "\n"
