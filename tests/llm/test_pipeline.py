"""The stages by the rows they keep, also where ids repeat or are missing, and the mix put together again."""

import re

import numpy as np
import pytest

import corpus_pipeline
from answerloom.llm import language, leaks
from tests.llm.test_operators import WORD, rows_of

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int"


def docs_of(spark, rows):
    """Rows of (doc_id, text) as documents; ``row`` is a column of their own that stages may not mix up with theirs."""
    return spark.createDataFrame([(i, t, None, "s", None, k) for k, (i, t) in enumerate(rows)], KIND)


def some(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def kept(made):
    return sorted(((r["doc_id"], r["text"]) for r in rows_of(made)), key=str)


def test_near_duplicates_keep_every_text(spark):
    a, b = some(1), some(2)
    rows = [(1, a), (2, a), (2, b), (None, a), (None, a + " more"), (None, some(3)), (7, some(4)), (7, some(4)), (8, some(5) + " x"), (5, some(5)), (9, ""), (9, ""), (10, None), (None, "")]
    made = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), "")
    assert made.columns == KIND.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert kept(made) == sorted([(1, a), (2, b), (None, some(3)), (7, some(4)), (5, some(5)), (9, ""), (9, ""), (10, None), (None, "")], key=str)
    assert all(r["text"] == rows[r["row"]][1] for r in rows_of(made))


def test_documents_stay_where_no_language_can_be_learned(spark):
    rows = [(1, "some words"), (2, "más palabras"), (3, "123 !!"), (4, None), (None, "no id"), (5, "")]
    assert kept(corpus_pipeline.languages(spark, docs_of(spark, rows), "")) == sorted([(1, "some words"), (2, "más palabras"), (None, "no id")], key=str)


def test_languages_of_long_texts_are_learned(spark):
    words = {"en": "the and of with this", "de": "der und das nicht mit"}
    rng = np.random.default_rng(6)
    text = lambda lang, n: " ".join(rng.choice(words[lang].split(), n))
    rows = [(i, text("en", 9000), "en") for i in range(8)] + [(100 + i, text("de", 20), "de") for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(1, text("en", 30)), (2, text("de", 30)), (3, text("en", 9000))], "doc_id bigint, text string")
    assert [r["language"]["lang_pred"] for r in rows_of(language.identified(asked.coalesce(1), model).orderBy("doc_id"))] == ["en", "de", "en"]


def test_more_languages_than_before(spark):
    rows = [(i, " ".join([f"w{i % 520}x{i % 520}"] * 5), f"l{i % 520}") for i in range(1040)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 520


@pytest.mark.parametrize("others", [0, 400])
def test_long_and_short_quotations_are_found(spark, others):
    item, short = some(10, 130).split(), some(11, 5).split()
    quoted = " ".join(item[30:90])
    rows = [(1, some(12, 200) + f" {quoted} " + some(13, 100)), (2, some(14) + " " + " ".join(short) + " " + some(15)), (3, " ".join(short[:4]) + " " + some(16)), (4, some(17, 300))]
    rows += [(100 + i, some(1000 + i, 10) + " " + quoted) for i in range(others)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, "two words"), (4, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["start_word"], r["end_word"]) for r in rows_of(leaks.pairs(docs_of(spark, rows), bench))}
    assert set(got) == {(1, 1), (2, 2), *((100 + i, 1) for i in range(others))}
    assert got[1, 1] == (round(60 / 130, 6), 200, 260) and got[2, 2] == (1.0, 40, 45)


def test_the_mix_has_its_text(spark):
    rows = [(i, some(20 + i, 10 + i)) for i in range(30)] + [(None, some(60, 9)), (3, some(23, 13))]
    made = rows_of(corpus_pipeline.mixed(spark, docs_of(spark, rows), ""))
    assert {(r["doc_id"], r["text"]) for r in made} <= set(rows)
    slots = {}
    for r in made:
        words = WORD.findall(r["text"])
        assert r["size"] == len(words) and r["taken"] == sum(p["n_words"] for p in r["parts"])
        for p in r["parts"]:
            slots.setdefault((p["shard"], p["slot"]), []).append(words[p["from_word"] : p["from_word"] + p["n_words"]])
    assert sum(len(w) for parts in slots.values() for w in parts) == sum(r["taken"] for r in made)
    assert abs(sum(r["taken"] for r in made) / made[0]["target"] - 1) < 0.05


def test_all_stages_on_planted_rows(spark, tmp_path):
    item = some(30, 30)
    rows = [(i, some(100 + i, 60)) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " end"), (102, some(200, 20) + " " + item + " " + some(201, 20)), (103, some(202, 40) + " zb@x.org"), (104, "12 34"), (None, some(203, 50))]
    docs_of(spark, rows).drop("row").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, str(tmp_path)), name)
    want = [(i, re.sub(r"\S+@\S+", "[EMAIL]", t)) for i, t in rows if i not in (100, 101, 102, 104)]
    assert kept(docs) == sorted(want, key=str)
    assert {r["doc_id"] for r in rows_of(corpus_pipeline.run(spark, str(tmp_path)))} == {i for i, _ in want}
