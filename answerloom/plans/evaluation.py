"""Scoring of answers, with an optional generated judgement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions import text
from answerloom.operators import metrics, prompts
from answerloom.operators.generation import Generator, StageStore, with_texts
from answerloom.progress import Progress, watched


def judged(pairs: DataFrame, judge: Generator, store: StageStore | None = None, templates: prompts.Templates = ()) -> DataFrame:
    """Add judge_score, NULL where unreadable, and in_range to (qid, prediction, truth)."""
    template = prompts.template(prompts.JUDGE, own=templates)
    prompt = template.bind(prediction=F.col("prediction"), truth=F.col("truth")).column()
    marked = with_texts(pairs, prompts.JUDGE, prompt, {"A": "__judgement"}, judge, store)
    return with_judge_score(marked, "__judgement").drop("__judgement")


def with_judge_score(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("judge_score", text.boxed_number(F.col(column))).withColumn(
        "in_range", F.col("judge_score").between(0, 1)
    )


def evaluate(
    pairs: DataFrame,
    judge: Generator | None = None,
    by: Sequence[str] = (),
    stem: bool = True,
    store: StageStore | None = None,
    progress: Progress | None = None,
    templates: prompts.Templates = (),
) -> DataFrame:
    """Mean scores of (qid, prediction, truth), per group of ``by``. ``progress`` counts pairs and readable judgements."""
    stripped = pairs.withColumn("prediction", text.strip(text.text_or_blank(F.col("prediction"))))
    if judge is not None:
        stripped = judged(stripped, judge, store, templates)
    readable = {} if judge is None else {"judged": F.count("judge_score")}
    return metrics.summary(watched(progress, metrics.score_pairs(stripped, stem=stem), "evaluate", **readable), by)
