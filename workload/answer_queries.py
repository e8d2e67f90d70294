"""Prompts, answer chains, choices and whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom import storage
from answerloom.functions import text
from answerloom.operators import dense, keyword, metrics, prompts
from answerloom.operators.generation import BatchGenerator, ExpressionGenerator, ReplayGenerator, StageStore
from answerloom.plans import answering, evaluation, experiment, retrieval
from answerloom.progress import Progress
from workload import fixtures
from workload import retrieval_queries as R
from workload import sqltext as S
from workload.registry import query

EVAL = f"{S.PAIRS}, users AS (SELECT qid, question AS text FROM pairs)"
KEYWORD = f"""{EVAL}, {S.CORPUS}, {R.TEXTS}, {S.padded_scores('users', 'texts', 10)},
{S.reranked('kw_hits', 'padded', 'users')}, {S.contexts('kw_found', 'kw_hits', 'users')},
kw AS MATERIALIZED (SELECT qid, question, answer, context FROM pairs JOIN kw_found USING (qid))"""
SEMANTIC = f"""{S.hash_vectors('dv', 'doc_id', 'texts')}, {S.hash_vectors('qv', 'qid', 'users')},
{S.vector_scores('qv', 'dv', 10)}, {S.reranked('vec_hits', 'vec_raw', 'users')},
{S.contexts('vec_found', 'vec_hits', 'users')},
vec AS MATERIALIZED (SELECT qid, question, answer, context FROM pairs JOIN vec_found USING (qid))"""

REPLIES = r"""replies AS (
  SELECT qid, {first} AS draft_a, {rest} AS draft_b, length(answer) % 2 = 0 AS draft_first,
    'shorten by ' || (length(answer) % 7) AS feedback, answer AS refined_a,
    question || chr(10) || answer AS refined_b, length(answer) % 3 = 0 AS refined_first,
    (length(answer) % 5) / 10 AS judge_score
  FROM pairs)""".format(first=S.first_line("answer"), rest=S.other_lines("answer"))


def eval_set(spark, sf_dir) -> DataFrame:
    return fixtures.pairs(spark, sf_dir)


def questions(spark, sf_dir) -> DataFrame:
    return eval_set(spark, sf_dir).select("qid", F.col("question").alias("text"))


def with_keyword_context(spark, sf_dir) -> DataFrame:
    """The pairs with their contexts, written as one table: contexts are by query when they are made, and are not moved again."""
    asked = questions(spark, sf_dir)
    found = retrieval.contexts(retrieval.keyword_hits(asked, fixtures.corpus(spark, sf_dir)), asked)
    return storage.save(eval_set(spark, sf_dir).join(found, "qid"), "contexts")


def digest(stage: str, variant: Column, prompt: Column) -> Column:
    """A text that depends on every character of the prompt, so that a check of it checks the prompt."""
    made = F.md5(F.concat(F.lit(f"{stage}/"), variant, F.lit("/"), prompt))
    if not stage.endswith("_choice"):
        return made
    return F.concat(F.lit("\\boxed{"), F.when(made < "8", F.lit("A")).otherwise("B"), F.lit("}"))


def digest_sql(stage: str, variant: str, prompt: str) -> str:
    made = f"md5('{stage}/{variant}/' || {prompt})"
    return f"(CASE WHEN {made} < '8' THEN 'A' ELSE 'B' END)" if stage.endswith("_choice") else made


def quote_source(stage: str, variant: Column, prompt: Column) -> Column:
    """Answer with the first retrieved answer (variant A) or the second (variant B)."""
    if stage == prompts.BASELINE:
        return prompt
    if stage in (prompts.DRAFT, prompts.REFINED):
        return F.when(variant == "A", F.split_part(prompt, F.lit("\nAnswer: "), F.lit(2))).otherwise(
            F.split_part(prompt, F.lit("\nAnswer: "), F.lit(3))
        )
    return digest(stage, variant, prompt)


def quote_source_sql(stage: str, variant: str, prompt: str) -> str:
    if stage in (prompts.DRAFT, prompts.REFINED):
        return f"split_part({prompt}, chr(10) || 'Answer: ', {2 if variant == 'A' else 3})"
    return digest_sql(stage, variant, prompt)


def chain_sql(name: str, source: str, made=digest_sql, reasoning: bool = False, rerank: str | None = None) -> str:
    """CTE NAME (qid, draft, feedback, refined) over a source (qid, question, context)."""
    base = {"question": "question", "context": "context"}

    def step(out: str, previous: str, stage: str, choose: bool, slots: dict) -> str:
        prompt = S.filled(stage, reasoning, **base, **slots)
        if not choose:
            return f"{name}_{out} AS MATERIALIZED (SELECT *, {made(stage, 'A', prompt)} AS {out} FROM {previous})"
        choice = S.filled(f"{stage}_choice", **base, **slots, response_a="va", response_b="vb")
        return (
            f"{name}_{out}_two AS MATERIALIZED (SELECT *, {made(stage, 'A', prompt)} AS va, "
            f"{made(stage, 'B', prompt)} AS vb FROM {previous}), "
            f"{name}_{out} AS MATERIALIZED (SELECT * EXCLUDE (va, vb), "
            f"CASE WHEN {made(stage + '_choice', 'A', choice)} = 'B' THEN vb ELSE va END AS {out} "
            f"FROM {name}_{out}_two)"
        )

    drafted = {"draft": "draft"}
    return ",\n".join(
        [
            step("draft", source, prompts.DRAFT, rerank == "initial", {}),
            step("feedback", f"{name}_draft", prompts.FEEDBACK, False, {**drafted, "max_feedback": "'5'"}),
            step("refined", f"{name}_feedback", prompts.REFINED, rerank == "refined", {**drafted, "feedback": "feedback"}),
            f"{name} AS (SELECT * FROM {name}_refined)",
        ]
    )


CHAIN = "SELECT qid, draft, feedback, refined FROM chain"


@query(
    "draft_prompts",
    f"WITH {KEYWORD} SELECT qid, {S.filled('draft', question='question', context='context')} AS prompt FROM kw",
)
def draft_prompts(spark, sf_dir):
    return with_keyword_context(spark, sf_dir).select("qid", answering.draft_prompt().alias("prompt"))


def replayed(spark, sf_dir, options: answering.AnswerOptions) -> DataFrame:
    generator = ReplayGenerator(fixtures.replies(spark, sf_dir))
    made = answering.answer(with_keyword_context(spark, sf_dir), generator, options)
    return made.select("qid", "draft", "feedback", "refined")


@query(
    "answer_chain_replay",
    f"WITH {S.PAIRS}, {REPLIES} SELECT qid, draft_a AS draft, feedback, refined_a AS refined FROM replies",
)
def answer_chain_replay(spark, sf_dir):
    return replayed(spark, sf_dir, answering.AnswerOptions())


@query(
    "answer_chain_replay_rerank",
    f"""WITH {S.PAIRS}, {REPLIES} SELECT qid, CASE WHEN draft_first THEN draft_a ELSE draft_b END AS draft,
  feedback, refined_a AS refined FROM replies""",
)
def answer_chain_replay_rerank(spark, sf_dir):
    return replayed(spark, sf_dir, answering.AnswerOptions(rerank="initial"))


def digested(spark, sf_dir, options: answering.AnswerOptions) -> DataFrame:
    made = answering.answer(with_keyword_context(spark, sf_dir), ExpressionGenerator(digest), options)
    return made.select("qid", "draft", "feedback", "refined")


@query("answer_chain", f"WITH {KEYWORD}, {chain_sql('chain', 'kw')} {CHAIN}")
def answer_chain(spark, sf_dir):
    return digested(spark, sf_dir, answering.AnswerOptions())


def plain_digest_sql(stage: str, variant: str, prompt: str) -> str:
    return f"md5({prompt})"


def load_digest():
    """Stands in for a model: the text depends on every character of the prompt."""
    from hashlib import md5

    return lambda batch: [md5(prompt.encode()).hexdigest() for prompt in batch]


@query("answer_chain_batched", f"WITH {KEYWORD}, {chain_sql('chain', 'kw', plain_digest_sql)} {CHAIN}")
def answer_chain_batched(spark, sf_dir):
    """The chain by batches of prompts, with stored stages: some rows, then others with an older context, then all as they are."""
    asked = storage.save(with_keyword_context(spark, sf_dir), "asked")
    generator, store = BatchGenerator(load_digest, batch_size=16), StageStore(storage.new_location(spark, "stages"))
    third = F.col("qid") % 3
    for rows in (asked.filter(third == 0), asked.filter(third == 1).withColumn("context", F.lit("older"))):
        answering.answer(rows, generator, answering.AnswerOptions(), store)
    made = answering.answer(asked, generator, answering.AnswerOptions(), store)
    return made.select("qid", "draft", "feedback", "refined")


ONE = f"{KEYWORD}, one AS (SELECT * FROM kw WHERE qid = (SELECT min(qid) FROM kw))"


@query("answer_one_question", f"WITH {ONE}, {chain_sql('chain', 'one')} {CHAIN}")
def answer_one_question(spark, sf_dir):
    """A single question, as a table of one row through the same functions."""
    asked = eval_set(spark, sf_dir).orderBy("qid").limit(1)
    query_rows = storage.save(asked.select("qid", F.col("question").alias("text")), "question")
    found = retrieval.contexts(retrieval.keyword_hits(query_rows, fixtures.corpus(spark, sf_dir)), query_rows)
    made = answering.answer(asked.join(found, "qid"), ExpressionGenerator(digest), answering.AnswerOptions())
    return made.select("qid", "draft", "feedback", "refined")


@query("answer_chain_cot", f"WITH {KEYWORD}, {chain_sql('chain', 'kw', reasoning=True)} {CHAIN}")
def answer_chain_cot(spark, sf_dir):
    return digested(spark, sf_dir, answering.AnswerOptions(reasoning=True))


@query("answer_chain_rerank_initial", f"WITH {KEYWORD}, {chain_sql('chain', 'kw', rerank='initial')} {CHAIN}")
def answer_chain_rerank_initial(spark, sf_dir):
    return digested(spark, sf_dir, answering.AnswerOptions(rerank="initial"))


@query("answer_chain_rerank_refined", f"WITH {KEYWORD}, {chain_sql('chain', 'kw', rerank='refined')} {CHAIN}")
def answer_chain_rerank_refined(spark, sf_dir):
    return digested(spark, sf_dir, answering.AnswerOptions(rerank="refined"))


@query("baseline_answers", f"WITH {S.PAIRS} SELECT qid, {S.strip('question')} AS answer FROM pairs")
def baseline_answers(spark, sf_dir):
    generator = ReplayGenerator(fixtures.replies(spark, sf_dir))
    made = answering.baseline(eval_set(spark, sf_dir).select("qid", "question"), generator)
    return made.select("qid", text.strip(F.col("refined")).alias("answer"))


@query(
    "pairwise_pick",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'second' ELSE 'first' END AS picked FROM labels""",
)
def pairwise_pick(spark, sf_dir):
    letter = F.when(F.col("quality") == 1, F.lit("so \\boxed{B}")).when(F.col("toxic") == 1, F.lit("\\boxed{C}"))
    labels = fixtures.load(spark, sf_dir, "labels").withColumn("choice", letter)
    return labels.select("doc_id", text.boxed_choice(F.col("choice"), F.lit("first"), F.lit("second")).alias("picked"))


@query(
    "judge_scores",
    f"WITH {S.PAIRS}, {REPLIES} SELECT qid, round(judge_score, 6) AS judge_score, judge_score <= 1 AS in_range FROM replies",
)
def judge_scores(spark, sf_dir):
    generator = ReplayGenerator(fixtures.replies(spark, sf_dir))
    made = evaluation.judged(fixtures.scored_pairs(spark, sf_dir), generator)
    return made.select("qid", F.round("judge_score", 6).alias("judge_score"), "in_range")


def boxed_digit(stage: str, variant: Column, prompt: Column) -> Column:
    """A judgement that depends on every character of the prompt; some cannot be read, some are out of range."""
    made = F.md5(prompt)
    number = F.concat(F.when(made < "4", F.lit("1")).otherwise("0"), F.lit("."), F.ascii(made).cast("string"))
    return F.when(made < "e", F.concat(F.lit("so \\boxed{ "), number, F.lit(" }"))).otherwise("no idea")


@query(
    "judge_digests",
    f"""WITH {S.PAIRS}, made AS (SELECT qid, md5({S.filled('judge', prediction='question', truth='answer')}) AS d FROM pairs),
scores AS (SELECT qid, CASE WHEN d < 'e' THEN CAST((CASE WHEN d < '4' THEN '1' ELSE '0' END) || '.' || CAST(ascii(d) AS VARCHAR) AS DOUBLE) END AS s FROM made)
SELECT qid, round(s, 6) AS judge_score, s BETWEEN 0 AND 1 AS in_range FROM scores""",
)
def judge_digests(spark, sf_dir):
    made = evaluation.judged(fixtures.scored_pairs(spark, sf_dir), ExpressionGenerator(boxed_digit))
    return made.select("qid", F.round("judge_score", 6).alias("judge_score"), "in_range")


@query(
    "progress_counts",
    f"""WITH {S.PAIRS}, n AS (SELECT count(*) AS n, count(*) FILTER (qid % 2 = 0) AS half FROM pairs),
judged AS (SELECT count(*) AS n FROM pairs WHERE md5({S.filled('judge', prediction=S.strip('md5(question)'), truth='answer')}) < 'e'),
postings AS (SELECT sum(len(list_distinct({S.word_tokens('text')})))::BIGINT AS n FROM documents)
SELECT 'index' AS step, 'rows' AS measure, count(*) AS value FROM documents UNION ALL SELECT 'index', 'postings', n FROM postings
UNION ALL SELECT 'baseline', 'rows', half FROM n UNION ALL SELECT 'baseline', 'empty', 0
UNION ALL SELECT 'baseline 2', 'rows', n - half FROM n UNION ALL SELECT 'baseline 2', 'empty', 0
UNION ALL SELECT 'evaluate', 'rows', n FROM n UNION ALL SELECT 'evaluate', 'judged', n FROM judged""",
)
def progress_counts(spark, sf_dir):
    """What an index build, a batched generation that is resumed, and an evaluation count as they run."""
    progress, asked = Progress(), storage.save(eval_set(spark, sf_dir), "eval-set")
    keyword.build(R.document_texts(spark, sf_dir), progress=progress)
    generator, store = BatchGenerator(load_digest, batch_size=16), StageStore(storage.new_location(spark, "stages"), progress)
    answering.baseline(asked.filter("qid % 2 = 0"), generator, store)
    made = answering.baseline(asked, generator, store)
    pairs = made.select("qid", F.col("refined").alias("prediction"), F.col("answer").alias("truth"))
    evaluation.evaluate(pairs, ExpressionGenerator(boxed_digit), stem=False, progress=progress).collect()
    return progress.table(spark)


OWN_JUDGE = (("judge", "Same meaning? {truth} / {prediction}\nEnd with \\boxed{{number}}."),)


@query(
    "judge_own_prompt",
    f"""WITH {S.PAIRS}, made AS (
  SELECT qid, md5('Same meaning? ' || answer || ' / ' || question || chr(10) || 'End with \\boxed{{number}}.') AS d FROM pairs),
scores AS (SELECT qid, CASE WHEN d < 'e' THEN CAST((CASE WHEN d < '4' THEN '1' ELSE '0' END) || '.' || CAST(ascii(d) AS VARCHAR) AS DOUBLE) END AS s FROM made)
SELECT qid, round(s, 6) AS judge_score, s BETWEEN 0 AND 1 AS in_range FROM scores""",
)
def judge_own_prompt(spark, sf_dir):
    """The same with a prompt of one's own."""
    made = evaluation.judged(fixtures.scored_pairs(spark, sf_dir), ExpressionGenerator(boxed_digit), templates=OWN_JUDGE)
    return made.select("qid", F.round("judge_score", 6).alias("judge_score"), "in_range")


def knowledge(spark, sf_dir) -> experiment.Knowledge:
    corpus = fixtures.corpus(spark, sf_dir)
    vectors = dense.build(retrieval.corpus_texts(corpus), R.hash_encoded)
    return experiment.Knowledge(corpus, vectors=vectors, encode=R.hash_encoded)


def config_sql() -> str:
    parts, selects = [], []
    for number, config in enumerate(experiment.all_configs()):
        if config.baseline:
            prediction, source = "question", "pairs"
        else:
            source = f"c{number}"
            context = "kw" if config.rag == "keyword" else "vec"
            parts.append(chain_sql(source, context, quote_source_sql, config.reasoning, config.rerank))
            prediction = "refined"
        selects.append(f"SELECT {S.quoted(config.label)} AS config, qid, {S.strip(prediction)} AS prediction, answer AS truth FROM {source}")
    keyed = "keyed AS (SELECT config, qid AS pair, config || qid AS qid, prediction, truth FROM predictions)"
    return f"""WITH {KEYWORD}, {SEMANTIC}, {', '.join(parts)},
predictions AS MATERIALIZED ({' UNION ALL '.join(selects)}), {keyed},
{S.bleu('prediction', 'truth', 'keyed')}, {S.rouge1('prediction', 'truth', 'keyed')}
SELECT config, round(avg(bleu), 6) AS bleu, round(avg(rouge1), 6) AS rouge1, count(*) AS n
FROM keyed JOIN bleu_scores USING (qid) JOIN rouge1_scores USING (qid) GROUP BY config"""


@query("config_compare", config_sql())
def config_compare(spark, sf_dir):
    """All configurations side by side on the two scores that SQL can check."""
    pairs = all_predictions(spark, sf_dir)
    scored = metrics.with_rouge(metrics.with_bleu(pairs, "prediction", "truth"), "prediction", "truth", rougel_out=None, stem=False)
    means = metrics.summary(scored, ["config"], metrics=("bleu", "rouge1"))
    return means.select("config", F.round("bleu", 6).alias("bleu"), F.round("rouge1", 6).alias("rouge1"), "n")


def all_predictions(spark, sf_dir) -> DataFrame:
    asked = storage.save(fixtures.spread_rows(eval_set(spark, sf_dir)), "eval-set")
    return experiment.all_predictions(
        experiment.all_configs(), asked, ExpressionGenerator(quote_source), knowledge(spark, sf_dir)
    )


@query("experiment_run")
def experiment_run(spark, sf_dir):
    """The whole run with all four scores and a judge; the slow scores have no SQL check."""
    asked = storage.save(fixtures.spread_rows(eval_set(spark, sf_dir)), "eval-set")
    return experiment.run(
        experiment.all_configs(),
        asked,
        ExpressionGenerator(quote_source),
        knowledge(spark, sf_dir),
        judge=ReplayGenerator(fixtures.replies(spark, sf_dir)),
    )
