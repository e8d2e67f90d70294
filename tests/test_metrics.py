from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerloom.functions import similarity
from answerloom.functions.similarity import lcs_length, stem
from answerloom.operators import metrics
from answerloom.plans import evaluation

GOLDEN = [
    ("the cat sat on the mat", "the cat is on the mat", 0.254066, 0.833333, 0.833333, 0.930233),
    ("a b", "a b", 0.316228, 1.0, 1.0, 1.0),
    ("a b c d", "a b c d", 1.0, 1.0, 1.0, 1.0),
    ("kitten", "sitting", 0.0, 0.0, 0.0, 0.615385),
    ("", "", 0.0, 0.0, 0.0, 1.0),
    ("", "x y", 0.0, 0.0, 0.0, 0.0),
    ("the the the", "the cat", 0.113622, 0.4, 0.4, 0.555556),
    ("abcd", "abxd", 0.0, 0.0, 0.0, 0.75),
    ("B a c", "a b c", 0.149535, 1.0, 0.666667, 0.6),
    ("été chaud", "ete chaud", 0.149535, 0.5, 0.5, 0.777778),
    ("hello world foo", "hello world foo bar baz", 0.288716, 0.75, 0.75, 0.789474),
]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "qid long, prediction string, truth string")


def test_golden_scores(spark):
    rows = [(i, g[0], g[1]) for i, g in enumerate(GOLDEN)]
    scored = metrics.score_pairs(pairs(spark, rows), stem=False).orderBy("qid").collect()
    for row, expected in zip(scored, GOLDEN):
        assert [row[m] for m in metrics.METRICS] == pytest.approx(expected[2:], abs=1e-6), expected[:2]


def test_scores_of_missing_texts(spark):
    row = metrics.score_pairs(pairs(spark, [(1, None, None)])).first()
    assert [row[m] for m in metrics.METRICS] == [0.0, 0.0, 0.0, 1.0]


def test_stems_count_as_equal(spark):
    df = pairs(spark, [(1, "running cats", "run dog")])
    assert metrics.with_rouge(df, "prediction", "truth").first().rouge1 == 0.5
    assert metrics.with_rouge(df, "prediction", "truth", stem=False).first().rouge1 == 0.0


@pytest.mark.parametrize(
    "word, expected",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"),
        ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("digitizer", "digit"), ("operator", "oper"), ("hopefulness", "hope"), ("formality", "formal"),
        ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("allowance", "allow"), ("adjustable", "adjust"), ("replacement", "replac"),
        ("adoption", "adopt"), ("effective", "effect"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"),
        ("roll", "roll"), ("generalizations", "gener"), ("died", "die"), ("enjoy", "enjoy"), ("dying", "die"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, start=1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_lcs_equals_table(a, b):
    assert lcs_length(a, b) == table_lcs(a, b) == lcs_length(b, a)
    assert lcs_length(list(a), list(b)) == table_lcs(a, b)


def test_scores_stay_in_range_and_are_one_for_equals(spark):
    texts = ["one two three four five", "Ünï cödé wörds here now", "x " * 500 + "y"]
    rows = [(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    for row in metrics.score_pairs(pairs(spark, rows), stem=False).collect():
        scores = [row[m] for m in metrics.METRICS]
        assert all(0.0 <= s <= 1.0 + 1e-12 for s in scores)
        if row.prediction == row.truth:
            assert scores == pytest.approx([1.0] * 4)


def test_scoring_needs_no_shuffle(spark):
    from tests.plans import physical_plan

    plan = physical_plan(metrics.score_pairs(pairs(spark, [(1, "a", "b")])))
    assert "Exchange" not in plan


def test_summary(spark):
    scored = metrics.score_pairs(pairs(spark, [(1, "a b c d", "a b c d"), (2, "x", "y")]))
    row = metrics.summary(scored).first()
    assert (row.bleu, row.n) == (0.5, 2)
    nothing = metrics.summary(scored.filter("false")).first()
    assert (nothing.bleu, nothing.n) == (None, 0)


def test_judge_means_leave_out_unreadable_scores(spark):
    df = spark.createDataFrame([(1, "\\boxed{0.5}"), (2, "?"), (3, "\\boxed{2}")], "qid long, text string")
    scored = evaluation.with_judge_score(df, "text")
    assert {r.qid: r.in_range for r in scored.collect()} == {1: True, 2: None, 3: False}
    row = metrics.summary(scored, metrics=()).first()
    assert (row.judge_mean, row.judge_n, row.n) == (1.25, 2, 3)


def test_paired(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, prediction string")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "qid long, truth string")
    report = metrics.paired(left, right, report=True)
    assert {r.qid: r.missing for r in report.collect()} == {1: None, 2: "truth", 3: "prediction"}
    with pytest.raises(metrics.UnmatchedPairs):
        metrics.paired(left, right)
    assert metrics.paired(left.filter("qid = 1"), right.filter("qid = 1")).columns == ["qid", "prediction", "truth"]


def test_evaluate_strips_predictions(spark):
    row = evaluation.evaluate(pairs(spark, [(1, "  a b c d\n", "a b c d")])).first()
    assert row.edit_similarity == 1.0


def test_stems_and_subsequences_need_one_worker_of_a_task(spark):
    pairs = spark.createDataFrame([(1, "Running dogs ran", "the dog is running"), (2, None, "x"), (3, "a b", "a b")], "qid long, p string, t string")
    scored = metrics.with_rouge(pairs, "p", "t")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    apart = metrics.with_rouge(pairs, "p", "t", rougel_out=None)
    assert [(r.rouge1) for r in scored.orderBy("qid").collect()] == [r.rouge1 for r in apart.orderBy("qid").collect()]
    assert [round(r.rougel, 6) for r in scored.orderBy("qid").collect()] == [round(2 / 7, 6), 0.0, 1.0]


@pytest.mark.parametrize("rows", [1, 2])
def test_stems_of_some_rows_at_a_time(monkeypatch, rows):
    monkeypatch.setattr(similarity, "STEMMED_ROWS", rows)
    left = pa.array([["running", "dogs", "the"], [], ["flies"]])
    right = pa.array([["dog", "runs"], ["x"], ["fly", "flies"]])
    (made,) = similarity.stemmed_sides.func(iter([(left, right)]))
    assert made.field("left").to_pylist() == [["run", "dog", "the"], [], ["fli"]]
    assert made.field("common").to_pylist() == [1, 0, 1]
    (alone,) = similarity.stemmed.func(iter([right]))
    assert alone.to_pylist() == made.field("right").to_pylist() == [["dog", "run"], ["x"], ["fly", "fli"]]


def plain_runs(left, right, order):
    def runs(tokens, n):
        return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))

    return [(runs(left or [], n) & runs(right or [], n)).total() for n in range(1, order + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.none() | st.lists(st.sampled_from("abc"), max_size=9)] * 2), max_size=8), st.sampled_from([1, 7, 1 << 18]))
def test_shared_runs_equal_plain_counts(rows, together):
    sides = [pa.array([row[i] for row in rows], pa.list_(pa.string())) for i in range(2)]
    held, similarity.COUNTED = similarity.COUNTED, together
    try:
        (found,) = similarity.shared_runs(4).func(iter([sides]))
    finally:
        similarity.COUNTED = held
    assert found.field("shared").to_pylist() == [plain_runs(*row, 4) for row in rows]
    assert [found.field(side).to_pylist() for side in ("left", "right")] == [[len(row[i] or []) for row in rows] for i in range(2)]


def test_runs_of_tokens_are_not_made_in_array_functions(spark):
    """They were strings, four for each token, in an array of the row that was sorted one call of a function after another."""
    plan = metrics.with_bleu(pairs(spark, [(1, "a", "b")]), "prediction", "truth")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and plan.count("ArrowEvalPython") == 1


def test_alike_pairs_of_a_key_are_scored_once(spark):
    from tests.plans import physical_plan

    rows = [("a", 1, "x y", "x"), ("b", 1, "x y", "x"), ("b", 1, "x y", "x"), ("a", 2, "x y", "x"), ("a", None, None, "x"), ("b", None, None, "x"), ("c", 1, "y", "x")]
    df = spark.createDataFrame(rows, "config string, qid long, prediction string, truth string")
    once, each = metrics.score_alike(df), metrics.score_pairs(df)
    assert Counter(once.select(*each.columns).collect()) == Counter(each.collect())
    counted = once.groupBy("config").agg(F.count("*").alias("n"))
    assert {r.config: r.n for r in counted.collect()} == {"a": 3, "b": 3, "c": 1}
    plan = physical_plan(once)
    assert plan.index("EvalPython") < plan.index("ObjectHashAggregate")


def test_subsequences_by_the_bits_of_either_side(monkeypatch):
    pairs = [("abcabba", "cbabac"), ("xay", "b"), ("aaaa", "aa"), ("qabcdq" * 9, "dcbaq" * 4)]
    expected = [table_lcs(*pair) for pair in pairs]
    for bits in (0, similarity.BITS):
        monkeypatch.setattr(similarity, "BITS", bits)
        assert [lcs_length(a, b) for a, b in pairs] == [lcs_length(list(b), list(a)) for a, b in pairs] == expected


@pytest.mark.parametrize("word, expected", [("yyyy", "cvcv"), ("syzygy", "cvcvcv"), ("a9é", "vcc"), ("", "")])
def test_shape_of_words(word, expected):
    assert similarity._shape(word) == expected
