"""Places where an outside model plugs in: row scoring, tie-breaks, batch extraction.

A model is any picklable callable; everything around it is Spark: filters run before it, it
is evaluated once per row in Arrow batches, its reply is read with a fixed schema, and each
failure becomes a value, never a lost row.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import fixed_values as fixed
from postmill.functions.text import clamp_score, filled, strip, trimmed_body
from postmill.functions.titles import title_tokens
from postmill.operators.keyed import top_k
from postmill.operators.rules import FILTERED, PASSES, UNDECIDED, triage_gate, verdict_of
from postmill.session import stage
from postmill.state import BucketedTable

REPLY = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
TRIAGE_REPLY = (
    "match_score int, verdict string, top_strengths array<string>, key_gaps array<string>, "
    "quick_recommendation string, jd_summary string"
)


def asker(model: Callable[[str], str], tries: int = 1, wait: float = 2.0):
    """A pandas UDF prompt -> struct<text, error>; null prompts are not sent.

    Marked non-deterministic: a deterministic one used in a filter and in the output would
    run twice.
    """

    def ask(prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, None
        for attempt in range(tries):
            try:
                return model(prompt), None
            except Exception as exc:
                failure = type(exc).__name__
                if attempt + 1 < tries:
                    time.sleep(wait * (attempt + 1))
        return None, failure

    @F.pandas_udf(REPLY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([ask(p) for p in batch], columns=["text", "error"])

    return run.asNondeterministic()


def decide_undecided(classified: DataFrame, model: Callable[[str], str], role: str, exclusions: tuple[str, ...] = (), model_name: str | None = None) -> DataFrame:
    """Tie-break for rows the rules left open; anything but a clear pass is filtered out."""
    wanted = F.col("filter_status") == UNDECIDED
    if not role.strip():
        return classified.withColumns(
            {
                "filter_reason": F.when(wanted, "llm error: no profile available").otherwise(F.col("filter_reason")),
                "filter_status": F.when(wanted, FILTERED).otherwise(F.col("filter_status")),
            }
        )
    prompt = F.concat_ws(
        "\n", F.lit(f"Target role: {role}"), *[F.lit(f"Excluded: {e}") for e in exclusions],
        F.concat(F.lit("Title: "), filled("title")), F.concat(F.lit("Company: "), filled("company")),
        F.lit('Answer {"role_type_match": "pass"} or {"role_type_match": "exclude"}.'),
    )
    asked = classified.withColumn("_a", asker(model)(F.when(wanted, prompt)))
    answer = F.lower(strip(F.from_json(F.col("_a.text"), "role_type_match string")["role_type_match"]))
    reason = (
        F.when(F.col("_a.error").isNotNull(), F.concat(F.lit("llm error: "), F.col("_a.error")))
        .when(answer == "pass", "rules ambiguous; llm: pass")
        .when(answer == "exclude", "rules ambiguous; llm: exclude")
        .otherwise("llm output invalid")
    )
    return asked.withColumns(
        {
            "ambiguous_resolved_by": F.when(wanted, F.lit(model_name)).otherwise(F.col("ambiguous_resolved_by")),
            "filter_reason": F.when(wanted, reason).otherwise(F.col("filter_reason")),
            "filter_status": F.when(wanted & (answer == "pass"), PASSES).when(wanted, FILTERED).otherwise(F.col("filter_status")),
        }
    ).drop("_a")


def score_with_model(jobs: DataFrame, model: Callable[[str], str], resume: str, text_chars: int | None = None) -> DataFrame:
    """Gate, score, clamp; rows that fail the gate or the model carry `error` and no score.

    The model sees whole job texts, or their first `text_chars` (12000 is usual).
    """
    shown = filled("jd_text") if text_chars is None else F.substring(filled("jd_text"), 1, text_chars)
    prompt = F.concat(
        F.lit(f"Score how well the resume fits the job, 0-100, as JSON.\nRESUME:\n{resume}\nJOB:\n"),
        filled("title"), F.lit("\n"), shown,
    )
    gated = jobs.withColumn("_gate", triage_gate("external_jd_status", "jd_text"))
    asked = gated.withColumn("_a", asker(model)(F.when(F.col("_gate").isNull(), prompt)))
    reply = asked.withColumn("_r", F.from_json(F.regexp_extract(F.col("_a.text"), r"(?s)(\{.*)", 1), TRIAGE_REPLY))
    score = clamp_score(F.coalesce("_r.match_score", F.lit(0)))
    answered = F.col("_a.text").isNotNull()
    return reply.select(
        *jobs.columns, F.when(answered, score).alias("match_score"),
        F.when(answered, verdict_of(score)).alias("verdict"), "_r.top_strengths", "_r.key_gaps",
        "_r.quick_recommendation", "_r.jd_summary", F.when(answered, "jd_full").alias("triage_mode"),
        F.coalesce("_gate", "_a.error").alias("error"),
    )


def token_overlap_score(text: Column, wanted: tuple[str, ...]) -> Column:
    """Deterministic stand-in for a model: share of wanted words that the text holds, 0-100."""
    words = F.array(*[F.lit(w) for w in wanted])
    return F.floor(F.size(F.array_intersect(words, title_tokens(text))) * 100 / max(len(wanted), 1)).cast("int")


QUESTIONS = (
    "array<struct<name:string,type:string,what:string,solution_hint:string,follow_ups:string,"
    "examination_points:array<string>,round:string,role:string>>"
)
ANSWERS = "thread_id string, questions string, error string, tries int"


def _post_texts(posts: DataFrame) -> DataFrame:
    return posts.select(
        F.col("thread_id").cast("string").alias("thread_id"), filled("title").alias("title"),
        filled("tag_line").alias("tag_line"), trimmed_body("op_body").alias("body"),
    )


def _answers(model: Callable[[list[dict]], list[dict]], size: int, tries: int, wait: float):
    """A mapInPandas function: `size` posts a call, each call tried `tries` times with growing waits."""

    def call(part: list[dict]) -> tuple[dict, str | None, int]:
        for attempt in range(1, tries + 1):
            try:
                return {r["thread_id"]: r.get("questions", []) for r in model(part)}, None, attempt
            except Exception as exc:
                failure = str(exc)[:200] or type(exc).__name__
                if attempt < tries:
                    time.sleep(wait * attempt)
        return {}, failure, tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size].to_dict("records")
                found, error, used = call(part)
                yield pd.DataFrame(
                    [{"thread_id": p["thread_id"], "questions": json.dumps(found.get(p["thread_id"], [])), "error": error, "tries": used} for p in part]
                )

    return run


def extract_in_batches(
    posts: DataFrame, model: Callable[[list[dict]], list[dict]], size: int = fixed.POSTS_PER_BATCH, tries: int = 1, wait: float = 2.0
) -> DataFrame:
    """Posts to extracted questions, `size` posts per model call; a failed call marks its posts.

    `model` takes posts (thread_id, title, tag_line, body) and returns thread_id + questions.
    """
    raw = _post_texts(posts).mapInPandas(_answers(model, size, tries, wait), ANSWERS).drop("tries")
    return raw.withColumn("questions", F.from_json("questions", QUESTIONS))


def extract_resumably(
    posts: DataFrame, model: Callable[[list[dict]], list[dict]], attempts: BucketedTable, size: int = fixed.POSTS_PER_BATCH,
    tries: int = 3, wait: float = 2.0, waves: int = 1,
) -> DataFrame:
    """The same with a table of attempts (ANSWERS by thread_id), from which a run that was cut short goes on.

    Posts are asked for in `waves`, each a share of the table's buckets, and each wave's answers are in the table
    before the next is asked, so a lost driver costs one wave. A post with an answer is never sent again;
    one whose calls all failed stays with its error and is sent by the next run. Posts share a thread id
    only if they are the same post: one of them is sent.
    """
    texts = _post_texts(posts).filter("thread_id IS NOT NULL")

    def newest(held: DataFrame, new: DataFrame) -> DataFrame:
        # An answer that stands is not replaced by a failure of a run beside this one.
        both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        return top_k(both, ["thread_id"], [F.col("error").isNotNull().asc(), F.col("_new").desc()], 1).drop("_new")

    for wave in range(waves):
        share = texts.filter(attempts.bucket() % waves == wave)
        done = attempts.read(buckets=range(wave, attempts.buckets, waves)).filter("error IS NULL")
        due = share.join(done, "thread_id", "left_anti").groupBy("thread_id").agg(*[F.max(c).alias(c) for c in ("title", "tag_line", "body")])
        # Written out once: the model must not be asked again for a second reading of its answers.
        answers = stage(due.mapInPandas(_answers(model, size, tries, wait), ANSWERS))
        if not answers.isEmpty():
            attempts.merge(answers, newest)
    known = attempts.read().join(texts.select("thread_id").distinct(), "thread_id", "left_semi")
    return known.withColumn("questions", F.from_json("questions", QUESTIONS))
