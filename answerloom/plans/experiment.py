"""A whole run: retrieve, answer, score."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom import storage
from answerloom.functions import text
from answerloom.operators import keyword, metrics, prompts
from answerloom.operators.generation import Generator, StageStore
from answerloom.plans import answering, evaluation, retrieval


@dataclass(frozen=True)
class RunConfig:
    """One way of answering. ``rag`` is 'semantic' or 'keyword'; a baseline run uses neither."""

    rag: str = "semantic"
    reasoning: bool = False
    rerank: str | None = None
    baseline: bool = False
    k: int = 5
    overfetch: int = 2
    boost: float = 5.0
    max_feedback: int = 5
    pad_zero: bool = True
    spell_braces: bool = False
    strip_echo: bool = False
    match: str = "substring"
    digits: int = 6
    templates: prompts.Templates = ()

    def __post_init__(self):
        if self.rag not in ("semantic", "keyword"):
            raise ValueError(f"unknown rag: {self.rag}")

    @property
    def label(self) -> str:
        """What differs from the defaults, so that different configurations have different labels."""
        named = ("rag", "reasoning", "rerank", "baseline")
        other = [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if f.name not in (*named, "templates") and getattr(self, f.name) != f.default]
        if self.templates:
            other.append(f"templates={md5(repr(self.templates).encode()).hexdigest()[:8]}")
        if self.baseline:
            return " ".join(["baseline", *other])
        parts = [self.rag, "reasoning" if self.reasoning else "plain"]
        return " ".join(parts + ([f"rerank-{self.rerank}"] if self.rerank else []) + other)

    @property
    def folder(self) -> str:
        return self.label.replace(" ", "-")

    @property
    def retrieval(self) -> retrieval.RetrievalOptions:
        return retrieval.RetrievalOptions(self.k, self.overfetch, self.boost, self.match, self.digits)

    @property
    def answering(self) -> answering.AnswerOptions:
        return answering.AnswerOptions(
            self.reasoning, self.rerank, self.max_feedback, self.spell_braces, self.strip_echo, self.templates
        )


def all_configs() -> list[RunConfig]:
    """The baseline and every combination of retrieval, reasoning and reranking."""
    combined = [
        RunConfig(rag=rag, reasoning=reasoning, rerank=rerank)
        for rag in ("semantic", "keyword")
        for reasoning in (False, True)
        for rerank in (None, "initial", "refined")
    ]
    return [RunConfig(baseline=True), *combined]


@dataclass(frozen=True)
class Knowledge:
    """A corpus with what was built from it once for all runs.

    ``encode`` turns (key, text) into (key, embedding); it must be the encoder
    that made ``vectors``.
    """

    corpus: DataFrame
    index: keyword.KeywordIndex | None = None
    vectors: DataFrame | None = None
    encode: Callable[[DataFrame, str], DataFrame] | None = None


def contexts(config: RunConfig, eval_set: DataFrame, knowledge: Knowledge) -> DataFrame:
    """(qid, context) of one configuration."""
    queries = eval_set.select("qid", F.col("question").alias("text"))
    if config.spell_braces:
        queries = queries.withColumn("text", text.spell_out_braces(F.col("text")))
    if config.rag == "keyword":
        hits = retrieval.keyword_hits(
            queries, knowledge.corpus, knowledge.index, config.retrieval, config.pad_zero
        )
    else:
        vectors = knowledge.encode(queries, "qid")
        hits = retrieval.vector_hits(queries, knowledge.corpus, vectors, knowledge.vectors, config.retrieval)
    return retrieval.contexts(hits, queries)


def predictions(
    config: RunConfig,
    eval_set: DataFrame,
    generator: Generator,
    context: DataFrame | None = None,
    store: StageStore | None = None,
) -> DataFrame:
    """(config, qid, prediction, truth) of one configuration over (qid, question, answer)."""
    if config.baseline:
        answered = answering.baseline(eval_set, generator, store, config.strip_echo)
    else:
        made = answering.answer(eval_set.join(context, "qid"), generator, config.answering, store)
        answered = eval_set.join(made.select("qid", "refined"), "qid")
    return answered.select(
        F.lit(config.label).alias("config"),
        "qid",
        text.strip(text.text_or_blank(F.col("refined"))).alias("prediction"),
        text.text_or_blank(F.col("answer")).alias("truth"),
    )


def all_predictions(
    configs: Iterable[RunConfig],
    eval_set: DataFrame,
    generator: Generator,
    knowledge: Knowledge | None = None,
    judge: Generator | None = None,
    store: StageStore | None = None,
) -> DataFrame:
    """The predictions of every configuration, with judge scores if a judge is given.

    Configurations that retrieve alike share one written table of contexts.
    """
    configs = list(configs)
    if len({c.label for c in configs}) < len(configs):
        raise ValueError("two configurations are the same")
    written: dict[tuple, DataFrame] = {}
    tables = []
    for config in configs:
        context, at = None, StageStore(f"{store.location}/{config.folder}", store.progress) if store else None
        if not config.baseline:
            way = (config.rag, config.retrieval, config.pad_zero, config.spell_braces)
            if way not in written:
                written[way] = storage.save(contexts(config, eval_set, knowledge), "contexts")
            context = written[way]
        table = predictions(config, eval_set, generator, context, at)
        tables.append(table if judge is None else evaluation.judged(table, judge, at, config.templates))
    return reduce(DataFrame.unionByName, tables)


def run(
    configs: Iterable[RunConfig],
    eval_set: DataFrame,
    generator: Generator,
    knowledge: Knowledge | None = None,
    judge: Generator | None = None,
    store: StageStore | None = None,
    stem: bool = True,
) -> DataFrame:
    """One row of mean scores per configuration. An answer that several of them give to a query is scored once."""
    pairs = all_predictions(configs, eval_set, generator, knowledge, judge, store)
    return metrics.summary(metrics.score_alike(pairs, stem=stem), ["config"])
