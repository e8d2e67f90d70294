import pytest
from pyspark.sql import functions as F

from answerloom.functions import multisets, text, vectors
from answerloom.functions.binding import let
from answerloom.functions.text import Template


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    "given, expected",
    [
        ("x \\boxed{ 0.75 } y", 0.75),
        ("\\boxed{1.2.3}", None),
        ("none", None),
        ("", None),
        ("\\boxed{0.2} \\boxed{0.9}", 0.2),
        ("\\boxed{7}", 7.0),
    ],
)
def test_boxed_number(spark, given, expected):
    assert value(spark, text.boxed_number(F.lit(given))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("\\boxed{B}", "b"), ("\\boxed{A}", "a"), ("\\boxed{C}", "a"), ("no box", "a"), (None, "a"), ("\\boxed{A} \\boxed{B}", "a")],
)
def test_boxed_choice(spark, given, expected):
    column = F.lit(given).cast("string")
    assert value(spark, text.boxed_choice(column, F.lit("a"), F.lit("b"))) == expected


@pytest.mark.parametrize("given, expected", [(" \n\ta\n ", "a"), ("  b ", "b"), ("", ""), ("a b", "a b")])
def test_strip(spark, given, expected):
    assert value(spark, text.strip(F.lit(given))) == expected


def test_corpus_and_question_text(spark):
    null = F.lit(None).cast("string")
    assert value(spark, text.corpus_text(F.lit("t"), null)) == "t "
    assert value(spark, text.question_text(F.lit(" t"), F.lit("b\n"))) == "t\nb"


def test_tags(spark):
    assert value(spark, text.shown_tags(F.lit("a|b|c"))) == "a, b, c"
    words = F.array(F.lit("java"))
    tags = F.lit("JavaScript|html")
    assert value(spark, text.matches_tags(words, tags)) is True
    assert value(spark, text.matches_tags(words, tags, "tag")) is False
    assert value(spark, text.matches_tags(F.array(F.lit("html")), tags, "tag")) is True
    assert value(spark, text.matches_tags(words, F.lit(None).cast("string"))) is False


@pytest.mark.parametrize(
    "given, expected",
    [
        ("How do I use node.js, C++ and pandas?", ["use", "pandas"]),
        ("I can't; the user's code", ["ca", "user", "code"]),
        ("multi-line a/b snake_case x=1", []),
        ("costs 1,000 or 3.5 in 2020.", ["costs", "2020"]),
        ("(foo) [bar] {baz} <qux>", ["foo", "bar", "baz", "qux"]),
        ("wait... what--ever", ["wait", "ever"]),
        ("I cannot, gonna", ["gon", "na"]),
        ("list list", ["list", "list"]),
        ("a,,b: c", ["b", "c"]),
        ("été 日本", ["été", "日本"]),
        ("", []),
        (None, []),
    ],
)
def test_keywords(spark, given, expected):
    assert value(spark, text.keywords(F.lit(given).cast("string"))) == expected


def test_tokens(spark):
    assert value(spark, text.word_tokens(F.lit("A cat's été, x_1 and don't"), ["and"])) == ["cat", "été", "x_1", "don"]
    assert value(spark, text.space_tokens(F.lit("  A b c \n"))) == ["a", "b", "c"]
    assert value(spark, text.space_tokens(F.lit(""))) == []
    assert value(spark, text.ascii_tokens(F.lit("Été-chaud 2x"))) == ["t", "chaud", "2x"]


def test_braces(spark):
    assert value(spark, text.spell_out_braces(F.lit("{}"))) == "left curly braceright curly brace"
    assert value(spark, text.double_braces(F.lit("{x}"))) == "{{x}}"


def test_without_prefix(spark):
    assert value(spark, text.without_prefix(F.lit("ask: reply"), F.lit("ask: "))) == "reply"
    assert value(spark, text.without_prefix(F.lit("reply"), F.lit("ask: "))) == "reply"


def test_template_is_filled_in_steps(spark):
    template = Template("Q {question} {{x}} A {answer}!")
    first = template.bind(question=F.lit("has {answer}"))
    assert value(spark, first.column()) == "Q has {answer} {x} A {answer}!"
    assert value(spark, first.bind(answer=F.lit(None).cast("string")).column()) == "Q has {answer} {x} A !"


def test_multisets(spark):
    left, right = F.array(*map(F.lit, "abaca")), F.array(*map(F.lit, "aab"))
    counts = value(spark, multisets.counted(left))
    assert [(r.term, r.n) for r in counts] == [("a", 3), ("b", 1), ("c", 1)]
    assert len(value(spark, multisets.common(left, right))) == 3
    assert value(spark, multisets.counted(F.array().cast("array<string>"))) == []


def test_let_computes_once(spark):
    assert value(spark, let(F.lit(2) + 1, lambda x: x * x)) == 9


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert value(spark, vectors.dot(a, b)) == 24.0
    assert value(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, vectors.normalised(a)) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
