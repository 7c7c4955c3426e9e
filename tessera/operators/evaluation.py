"""Prompts, the offline answer and judge, experiment summaries and report rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dot, hash_embedding, keywords, let, prefix, present, sentences, sentences_cut, strip, term_set, tokens

# The prompt templates and what the offline answer looks for and writes.
RECRUITER = ("You are an expert recruiter assistant.\n\nJOB REQUIREMENT:\n", "\n\nRETRIEVED CANDIDATE PROFILES:\n", "\n\nBased only on the profiles above:\n1. Summarize the top 3 matching candidates\n2. Explain why each matches the requirement\n3. Note any skill gaps\n\nDo not fabricate information not present in the profiles.")
CANDIDATE = ("You are a career advisor.\n\nCANDIDATE PROFILE:\n", "\n\nRETRIEVED JOB POSTINGS:\n", "\n\nBased only on the jobs above:\n1. Recommend the top 3 most suitable jobs and why\n2. How well the candidate's skills match each role\n3. Any upskilling suggestions\n\nDo not fabricate information not present in the job postings.")
RECRUITER_UR = ("آپ ایک ماہر بھرتی کار معاون ہیں۔ براہ کرم اردو میں جواب دیں۔\n\nملازمت کی ضرورت:\n", "\n\nحاصل شدہ امیدواروں کی تفصیلات:\n", "\n\nصرف اوپر دی گئی تفصیلات کی بنیاد پر:\n1. سب سے مناسب 3 امیدواروں کا خلاصہ بیان کریں\n2. ہر امیدوار کی مناسبت کی وجہ بتائیں\n3. کسی بھی مہارت کی کمی کی نشاندہی کریں\n\nایسی معلومات نہ بنائیں جو تفصیلات میں موجود نہیں ہیں۔")
CANDIDATE_UR = ("آپ ایک کیریئر مشیر ہیں۔ براہ کرم اردو میں جواب دیں۔\n\nامیدوار کی تفصیلات:\n", "\n\nحاصل شدہ ملازمتوں کی تفصیلات:\n", "\n\nصرف اوپر دی گئی ملازمتوں کی بنیاد پر:\n1. سب سے مناسب 3 ملازمتوں کی سفارش کریں اور وجہ بتائیں\n2. امیدوار کی مہارتیں ہر کردار سے کتنی مطابقت رکھتی ہیں\n3. مہارت میں اضافے کی تجاویز\n\nایسی معلومات نہ بنائیں جو ملازمتوں کی تفصیلات میں موجود نہیں ہیں۔")
ENTRY_LABELS = {"recruiter": "Candidate", "candidate": "Job", "recruiter_urdu": "امیدوار", "candidate_urdu": "ملازمت"}
TEMPLATES = {"recruiter": RECRUITER, "candidate": CANDIDATE, "recruiter_urdu": RECRUITER_UR, "candidate_urdu": CANDIDATE_UR}
BREAK = "\n\n---\n\n"
ANSWERS = (
    ("RETRIEVED CANDIDATE PROFILES:", "Top matching candidates (fallback mode):", "Skill gaps: Review the retrieved context for missing technologies and domain depth."),
    ("RETRIEVED JOB POSTINGS:", "Top suitable jobs (fallback mode):", "Upskilling suggestion: Focus on skills repeatedly appearing in the top retrieved roles."),
)
NOTE = "Note: External LLM endpoint was unavailable; this response is generated from retrieved context."
NO_ANSWER = "No generated answer available from external LLM. Please review retrieved context results."
QUESTIONS = ("What are the main points about %s?", "Which skills or qualifications are emphasized in %s?", "What gaps or next steps are suggested in %s?")
QUESTIONS_UR = ("یہ جواب کس بارے میں ہے؟", "اس میں کون سی مہارتیں بتائی گئی ہیں؟", "کیا تجاویز دی گئی ہیں؟")
REASONS = ("Lexical overlap found between claim and context.", "Insufficient lexical overlap between claim and context.")
REASON_UR = "Heuristic fallback"
# What a judging model is asked for claims, for a verdict on a claim, and for questions.
ASK_CLAIMS = "Extract all factual claims from this answer as a JSON array of strings.\nReturn ONLY the JSON array, nothing else.\n\nANSWER: "
ASK_VERDICT = ('Is this claim supported by the context? Reply with JSON only: {"supported": true or false, "reason": "one sentence"}\n\nCLAIM: ', "\nCONTEXT: ")
ASK_QUESTIONS = "Generate exactly 3 questions that this answer is responding to.\nReturn ONLY a JSON array of 3 strings.\n\nANSWER: "
ASK_CLAIMS_UR = "اس جواب سے تمام حقائق پر مبنی دعوے نکالیں اور JSON ارے کی صورت میں واپس کریں۔\nصرف JSON ارے واپس کریں، کچھ اور نہیں۔\n\nجواب: "
ASK_VERDICT_UR = ('کیا یہ دعویٰ سیاق و سباق سے ثابت ہوتا ہے؟ صرف JSON میں جواب دیں: {"supported": true یا false, "reason": "ایک جملہ"}\n\nدعویٰ: ', "\nسیاق و سباق: ")
ASK_QUESTIONS_UR = "اس جواب سے بالکل 3 سوالات بنائیں جن کا یہ جواب دے رہا ہے۔\nصرف 3 سوالات کی JSON ارے واپس کریں۔\n\nجواب: "
LABELS = {"semantic_only": "Semantic only", "hybrid_rrf": "Hybrid + RRF", "hybrid_rrf_ce": "Hybrid + RRF + CE"}


def prompt(hits: DataFrame, queries: DataFrame, mode: str, title: str, rank: str = "rank") -> DataFrame:
    """(query_id, prompt) over hits(query_id, rank, title, text); a query without hits has an empty context."""
    head, middle, tail = TEMPLATES[mode]
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.coalesce(F.col(title), F.lit("")).alias("n"), prefix(F.coalesce("text", F.lit("")), 600).alias("t"))))
    entry = lambda x, i: F.concat(F.lit(f"{ENTRY_LABELS[mode]} "), (i + 1).cast("string"), F.lit(": "), x["n"], F.lit("\n"), x["t"])
    context = hits.groupBy("query_id").agg(F.array_join(F.transform(rows, entry), BREAK).alias("context"))
    whole = F.concat(F.lit(head), "query", F.lit(middle), F.coalesce("context", F.lit("")), F.lit(tail))
    return queries.select("query_id", F.col("text").alias("query")).join(context, "query_id", "left").select("query_id", whole.alias("prompt"))


def heuristic_answer(p: Column) -> Column:
    """The answer without a model: the first three entries of the prompt, each with its title and a snippet."""

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))

    out = F.lit(NO_ANSWER)
    for anchor, head, advice in reversed(ANSWERS):
        section = F.split(after(p, anchor), "Based only on", 2)[0]
        entries = F.filter(F.transform(F.split(section, BREAK), strip), lambda e: e != "")

        def line(e: Column, i: Column) -> Column:
            parts = F.filter(F.transform(F.split(e, "\n"), strip), lambda x: x != "")
            return F.concat((i + 1).cast("string"), F.lit(". "), parts[0], F.lit(": "), prefix(F.array_join(F.slice(parts, 2, 2), " "), 240))

        listed = F.concat(F.array(F.lit(head)), F.transform(F.slice(entries, 1, 3), line), F.array(F.lit(advice), F.lit(NOTE)))
        out = F.when((F.instr(p, anchor) > 0) & (F.size(entries) > 0), F.array_join(listed, "\n")).otherwise(out)
    return out


def claims(answer: Column, max_claims: int = 5, urdu: bool = False) -> Column:
    found = F.slice((sentences_cut if urdu else sentences)(strip(answer)), 1, max(1, min(max_claims, 3)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(prefix(answer, 220)))


def supported(claim: Column, context: Column) -> Column:
    """At least two common terms of over three characters, in the first 800 characters of the context."""
    return F.size(F.array_intersect(term_set(claim, 3), term_set(prefix(context, 800), 3))) >= 2


def questions(answer: Column) -> Column:
    found = keywords(answer)
    topic = F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.lit("the provided answer"))
    return F.array(*(F.format_string(q, topic) for q in QUESTIONS))


def relevancy(query: Column, asked: Column) -> Column:
    """The mean cosine of the query with the questions, under the hashed embedding; 0 without questions."""
    total = lambda q: F.aggregate(F.transform(asked, lambda x: dot(q, hash_embedding(tokens(x)))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(asked) > 0, let(hash_embedding(tokens(query)), total) / F.size(asked)).otherwise(F.lit(0.0))


def array_salvage(text: Column) -> Column:
    """The JSON array between the first [ and the last ]; otherwise the first 200 characters as its one element."""
    got = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>")
    return F.coalesce(got, F.array(prefix(text, 200)))


def object_salvage(text: Column) -> Column:
    """(supported, reason) between the first { and the last }; anything but a boolean is false."""
    raw = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    got = F.from_json(raw, "supported string, reason string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    ok = (raw != "") & got["_corrupt_record"].isNull() & got.isNotNull()
    return F.struct((ok & F.coalesce(F.lower(got["supported"]) == "true", F.lit(False)) & ~raw.rlike(r'"supported"\s*:\s*"')).alias("supported"), F.when(ok, F.coalesce(got["reason"], F.lit(""))).otherwise(F.lit("parse error")).alias("reason"))


def response_text(payload: Column) -> Column:
    """The text of a model's response, whatever its shape; the payload itself if none fits."""
    at = lambda path: present(F.get_json_object(payload, path))
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(at("$.generated_text"), at("$.choices[0].text"), filled(at("$.choices[0].message.content")), filled(at("$.choices[0].message.reasoning")), at("$[0].generated_text"), payload)


@dataclass(frozen=True)
class Judge:
    """What an experiment asks of a judge, as functions of columns.

    claims(answer): an array; verify(claim, context): (supported, reason), reading the first 800 characters; questions(answer, query): an array.
    """

    claims: Callable[[Column], Column]
    verify: Callable[[Column, Column], Column]
    questions: Callable[[Column, Column], Column]


def lexical_judge(max_claims: int = 5) -> Judge:
    """The judge without a model: sentences as claims, common terms as support, templated questions."""

    def verify(claim: Column, context: Column) -> Column:
        ok = supported(claim, context)
        return F.struct(ok.alias("supported"), F.when(ok, REASONS[0]).otherwise(REASONS[1]).alias("reason"))

    return Judge(lambda answer: claims(answer, max_claims), verify, lambda answer, _: questions(answer))


def lexical_judge_urdu(max_claims: int = 5) -> Judge:
    """The second judge without a model: it never finds support and asks the same three questions."""
    verdict = F.struct(F.lit(False).alias("supported"), F.lit(REASON_UR).alias("reason"))
    return Judge(lambda answer: claims(answer, max_claims, urdu=True), lambda claim, context: verdict, lambda answer, _: F.array(*map(F.lit, QUESTIONS_UR)))


def model_judge(call: Callable[[Column, int], Column], fallback: Judge, max_claims: int = 5, urdu: bool = False) -> Judge:
    """A judge by a model: call(prompt, max_tokens) gives its response, null where it fails (a pandas UDF, or a chain of them). Then the fallback judges."""
    ask_claims, (head, middle), ask_questions = (ASK_CLAIMS_UR, ASK_VERDICT_UR, ASK_QUESTIONS_UR) if urdu else (ASK_CLAIMS, ASK_VERDICT, ASK_QUESTIONS)

    def own_claims(answer: Column) -> Column:
        raw = call(F.concat(F.lit(ask_claims), answer), 300)
        found = F.coalesce(F.from_json(between(raw, "[", "]"), "array<string>"), F.array(prefix(answer, 200)))
        return F.when(raw.isNull(), fallback.claims(answer)).otherwise(F.slice(found, 1, max_claims))

    def verify(claim: Column, context: Column) -> Column:
        raw = call(F.concat(F.lit(head), claim, F.lit(middle), prefix(context, 800)), 100)
        return F.when(raw.isNull(), fallback.verify(claim, context)).otherwise(object_salvage(raw))

    def own_questions(answer: Column, query: Column) -> Column:
        raw = call(F.concat(F.lit(ask_questions), answer), 150)
        found = F.slice(F.coalesce(F.from_json(between(raw, "[", "]"), "array<string>"), F.array(query)), 1, 3)
        return F.when(raw.isNull(), fallback.questions(answer, query)).otherwise(F.slice(F.concat(found, F.array_repeat(query, 3)), 1, 3))

    return Judge(own_claims, verify, own_questions)


def between(text: Column, first: str, last: str) -> Column:
    """The text from the first `first` to the last `last`."""
    return F.regexp_extract(text, rf"(?s)\{first}.*\{last}", 0)


def instructed(prompt: Column) -> Column:
    """A prompt as instruction models take it."""
    return F.concat(F.lit("[INST] "), prompt, F.lit(" [/INST]"))


def chain(*steps: Callable[[Column], Column], last: Callable[[Column], Column] = heuristic_answer) -> Callable[[Column], Column]:
    """A generator that tries each step in turn: a step takes the prompt and gives the answer, null where it fails; `last` never fails."""
    return lambda prompt: F.coalesce(*(F.trim(step(prompt)) for step in steps), last(prompt))


METRICS = ("faithfulness", "relevancy", "retrieval_s", "generation_s", "evaluation_s", "total_s")


def summarize(rows: DataFrame, by: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(by, ordinal, count, avg_*) for each key, in the order of keys; keys without rows have zeros."""
    spark = rows.sparkSession
    got = rows.groupBy(by).agg(F.count("*").alias("count"), *(F.avg(m).alias(f"avg_{m}") for m in METRICS if m in rows.columns))
    if keys is None:
        return got
    order = spark.range(1).select(F.posexplode(F.array(*map(F.lit, keys))).alias("ordinal", by))
    out = order.join(got, by, "left")
    return out.select(by, F.col("ordinal").cast("long").alias("ordinal"), *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in got.dtypes if c != by))


def pick_best(summary: DataFrame, by: str) -> DataFrame:
    """The key of the highest sum of faithfulness and relevancy; the earliest wins ties."""
    score = F.round(F.col("avg_faithfulness") + F.col("avg_relevancy"), 9)
    return summary.withColumn("score", score).orderBy(F.desc("score"), "ordinal").limit(1).select(by, "score")


def best_per_metric(summary: DataFrame, by: str, metrics: tuple[str, ...] = ("avg_faithfulness", "avg_relevancy")) -> DataFrame:
    long = summary.select(by, "ordinal", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in metrics))).alias("x")).select(by, "ordinal", "x.*")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "ordinal")
    return long.withColumn("n", F.row_number().over(w)).filter("n = 1").select("metric", by, "value")


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def number(c: Column, n: int = 4) -> Column:
    return F.format_string(f"%.{n}f", c)
