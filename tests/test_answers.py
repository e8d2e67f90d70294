from pathlib import Path

import pytest
from pyspark.sql import functions as F

from answerloom.operators import prompts
from answerloom.operators.dense import hash_vectors
from answerloom.operators.generation import BatchGenerator, ExpressionGenerator, ReplayGenerator, StageStore
from answerloom.functions import text
from answerloom.plans import answering, evaluation, experiment


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, f"question {i} {{x}}", f"context {i}") for i in range(30)]
    return spark.createDataFrame(rows, "qid long, question string, context string").repartition(3)


def shorten(stage, variant, prompt):
    if stage.endswith("_choice"):
        return F.when(F.length(prompt) % 2 == 0, F.lit("\\boxed{A}")).otherwise(F.lit("\\boxed{B}"))
    return F.concat(F.lit(f"{stage}"), F.length(prompt).cast("string"))


def counting_model(log):
    """A model that notes every prompt it is given, one line each."""

    def load():
        def model(batch):
            assert len(batch) <= 4
            with open(log, "a") as out:
                out.writelines(f"{len(p)}\n" for p in batch)
            return [f"reply {len(p)}" for p in batch]

        return model

    return load


def calls(log):
    return len(Path(log).read_text().splitlines()) if Path(log).exists() else 0


def test_each_prompt_is_generated_once(spark, asked, tmp_path):
    log = str(tmp_path / "calls")
    generator = BatchGenerator(counting_model(log), batch_size=4)
    made = answering.answer(asked, generator)
    first = sorted(made.select("qid", "refined").collect())
    assert sorted(made.select("qid", "refined").collect()) == first and len(first) == 30
    assert calls(log) == 90


def test_a_rerun_only_asks_for_what_is_missing(spark, asked, tmp_path):
    log, store = str(tmp_path / "calls"), StageStore(str(tmp_path / "run"))
    generator = BatchGenerator(counting_model(log), batch_size=4, partitions=2)
    answering.answer(asked.filter("qid < 10"), generator, store=store).count()
    assert calls(log) == 30
    made = answering.answer(asked, generator, store=store)
    assert made.filter("refined is not null").count() == 30
    assert calls(log) == 90


@pytest.mark.parametrize("rerank", [None, "initial", "refined"])
@pytest.mark.parametrize("reasoning", [False, True])
def test_stored_and_unstored_chains_agree(asked, tmp_path, rerank, reasoning):
    options = answering.AnswerOptions(reasoning=reasoning, rerank=rerank)
    generator = ExpressionGenerator(shorten)
    columns = ["qid", "draft", "feedback", "refined"]
    direct = sorted(answering.answer(asked, generator, options).select(columns).collect())
    stored = answering.answer(asked, generator, options, StageStore(str(tmp_path / "run"))).select(columns)
    assert sorted(stored.collect()) == direct and len(direct) == 30


def test_plan_of_a_chain_grows_with_its_length_only(spark, asked):
    from tests.plans import physical_plan

    replies = spark.createDataFrame([], "stage string, variant string, qid long, text string")
    plan = physical_plan(answering.answer(asked, ReplayGenerator(replies), answering.AnswerOptions(rerank="refined")))
    assert plan.count("Join") <= 6


def test_choice_picks_between_two(spark):
    asked = spark.createDataFrame([(1, "q", "c"), (2, "q", "c"), (3, "q", "c")], "qid long, question string, context string")
    rows = [("draft", v, q, f"{v}{q}") for q in (1, 2, 3) for v in "AB"]
    rows += [("draft_choice", "A", 1, "\\boxed{B}"), ("draft_choice", "A", 2, "\\boxed{A}"), ("draft_choice", "A", 3, "?")]
    replies = spark.createDataFrame(rows, "stage string, variant string, qid long, text string")
    made = answering.answer(asked, ReplayGenerator(replies), answering.AnswerOptions(rerank="initial"))
    assert {r.qid: r.draft for r in made.collect()} == {1: "B1", 2: "A2", 3: "A3"}


def test_braces_can_be_spelled_out(asked):
    made = answering.answer(asked, ExpressionGenerator(shorten), answering.AnswerOptions(spell_braces=True))
    assert made.filter("question like '%left curly brace%'").count() == 30


def test_echo_is_stripped(asked):
    echo = ExpressionGenerator(lambda stage, variant, prompt: F.concat(prompt, F.lit("!")))
    made = answering.answer(asked, echo, answering.AnswerOptions(strip_echo=True))
    assert {(r.draft, r.refined) for r in made.collect()} == {("!", "!")}


def test_prompts_hold_their_slots(spark):
    slots = {
        prompts.DRAFT: "question context", prompts.FEEDBACK: "question draft context max_feedback",
        prompts.REFINED: "question draft feedback context", prompts.BASELINE: "question",
        prompts.DRAFT_CHOICE: "question context response_a response_b",
        prompts.REFINED_CHOICE: "question context draft feedback response_a response_b",
        prompts.JUDGE: "prediction truth",
    }
    for stage, names in slots.items():
        for reasoning in (False, True):
            found = {slot for _, slot in prompts.template(stage, reasoning).pieces if slot}
            assert found == set(names.split()), stage
    judge = spark.range(1).select(prompts.template(prompts.JUDGE).column()).first()[0]
    assert "\\boxed{number}" in judge


def test_baseline_prompt_is_the_question(asked):
    echo = ExpressionGenerator(lambda stage, variant, prompt: prompt)
    assert {(r.question, r.refined) for r in answering.baseline(asked, echo).collect()} == {
        (f"question {i} {{x}}", f"question {i} {{x}}") for i in range(30)
    }


def test_judge_in_batches(spark, tmp_path):
    pairs = spark.createDataFrame([(i, "p", "t") for i in range(9)], "qid long, prediction string, truth string")
    judge = BatchGenerator(lambda: lambda batch: [f"\\boxed{{0.{len(batch)}}}" for _ in batch], batch_size=3)
    row = evaluation.evaluate(pairs, judge).first()
    assert row.judge_n == 9 and 0 < row.judge_mean <= 0.3


def encode(df, key):
    return hash_vectors(df, text.word_tokens(F.col("text")), key, 16)


def test_all_configurations_in_one_run(spark):
    corpus = spark.createDataFrame(
        [(i, f"title number {i}", f"body word{i % 3} text", f"tag{i % 2}", f"answer {i} word{i % 3}") for i in range(20)],
        "doc_id long, title string, body string, tags string, answer string",
    )
    eval_set = spark.createDataFrame(
        [(i, f"find word{i % 3} in tag{i % 2}", f"answer {i}") for i in range(6)], "qid long, question string, answer string"
    )
    texts = corpus.select("doc_id", F.concat_ws(" ", "title", "body").alias("text"))
    knowledge = experiment.Knowledge(corpus, vectors=encode(texts, "doc_id"), encode=encode)
    judge = ExpressionGenerator(lambda stage, variant, prompt: F.lit("\\boxed{0.5}"))
    configs = [experiment.RunConfig(baseline=True), experiment.RunConfig(rag="keyword", rerank="refined"), experiment.RunConfig(reasoning=True)]
    rows = experiment.run(configs, eval_set, ExpressionGenerator(shorten), knowledge, judge).collect()
    assert {r.config for r in rows} == {"baseline", "keyword plain rerank-refined", "semantic reasoning"}
    assert all(r.n == 6 and r.judge_n == 6 and r.judge_mean == 0.5 for r in rows)


def test_configurations():
    configs = experiment.all_configs()
    assert len(configs) == 13 and len({c.label for c in configs}) == 13
    with pytest.raises(ValueError):
        experiment.RunConfig(rag="other")
    with pytest.raises(ValueError):
        answering.AnswerOptions(rerank="other")


def test_single_query(spark):
    one = spark.createDataFrame([(0, "how", "")], "qid long, question string, context string")
    assert answering.answer(one, ExpressionGenerator(shorten)).first().refined.startswith("refined")


def test_templates_of_ones_own(spark):
    asked = spark.createDataFrame([(1, "q", "c")], "qid long, question string, context string")
    echo = ExpressionGenerator(lambda stage, variant, prompt: prompt)
    own = (("draft", "D {question}"), ("refined", "R {draft} {{}} {feedback}"))
    made = answering.answer(asked, echo, answering.AnswerOptions(templates=own)).first()
    assert made.draft == "D q" and made.refined == f"R D q {{}} {made.feedback}"
    with pytest.raises(ValueError):
        answering.answer(asked, echo, answering.AnswerOptions(templates=(("draft", "{feedback}"),)))
    plain, other = experiment.RunConfig(), experiment.RunConfig(templates=own, match="tag", digits=4)
    assert plain.label != other.label and other.retrieval.match == "tag" and other.retrieval.digits == 4
    assert other.answering.templates == own
