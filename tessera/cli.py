"""Command line: the fixed set and both ablations over a corpus of records, written as a document, a CSV and a report (Markdown and PDF).

    python -m tessera.cli --candidates resumes.jsonl --jobs jobs.csv --queries queries.jsonl --output-dir reports

Records have id, title and text; queries have query_id, mode (recruiter or candidate) and text. Recruiters search the candidates,
candidates the jobs. The built-in models without a network are used.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import experiments
from tessera.operators.retrieval import hash_vectors
from tessera.sources import files
from tessera.sources.pdf import write_pdf


def options(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Evaluate retrieval and answers, with ablations of strategy and chunking")
    parser.add_argument("--candidates", help="JSON lines (id, title, text) that recruiter queries search")
    parser.add_argument("--jobs", help="CSV (id, title, text) that candidate queries search")
    parser.add_argument("--queries", required=True, help="JSON lines (query_id, mode, text)")
    parser.add_argument("--baseline-queries", type=int, default=10)
    parser.add_argument("--retrieval-ablation-queries", type=int, default=5)
    parser.add_argument("--chunking-ablation-queries", type=int, default=3)
    parser.add_argument("--gen-max-tokens", type=int, default=220, help="passed on to a generator that takes it; the built-in one doesn't")
    parser.add_argument("--eval-max-claims", type=int, default=5)
    parser.add_argument("--mode", choices=("recruiter", "candidate"), default="recruiter", help="whose queries the ablations take")
    parser.add_argument("--output-dir", default="reports")
    out = parser.parse_args(args)
    if not getattr(out, {"recruiter": "candidates", "candidate": "jobs"}[out.mode]):
        parser.error(f"--mode {out.mode} needs its corpus")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    o = options(args)
    spark = spark or SparkSession.builder.getOrCreate()
    record = "id string, title string, text string"
    corpora = {}
    if o.candidates:
        corpora["recruiter"] = files.read_jsonl(spark, o.candidates, record)
    if o.jobs:
        corpora["candidate"] = files.read_csv(spark, o.jobs, record)
    asked = files.read_jsonl(spark, o.queries, "query_id string, mode string, text string").filter(F.trim("text") != "")
    queries = {mode: asked.filter(F.col("mode") == mode).drop("mode") for mode in corpora}
    sizes = (o.baseline_queries, o.retrieval_ablation_queries, o.chunking_ablation_queries)
    document = experiments.experiment(corpora, hash_vectors, queries, f"{o.output_dir}/work", o.mode, replace(Config(), max_claims=o.eval_max_claims), sizes)
    files.write_document(spark, document, f"{o.output_dir}/experiment")
    table = spark.createDataFrame(experiments.ablation_rows(document), list(experiments.CSV))
    table.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{o.output_dir}/ablation")
    write_pdf(spark, experiments.report(document), f"{o.output_dir}/report.pdf")
    spark.createDataFrame([(experiments.report(document),)], "value string").coalesce(1).write.mode("overwrite").text(f"{o.output_dir}/report")
    return document


if __name__ == "__main__":
    main()
