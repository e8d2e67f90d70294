"""Every registered query against its SQL on the smallest scale."""

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from answerloom.functions.similarity import stem
from answerloom.operators import metrics
from tests.plans import physical_plan
from workload import answer_queries, fixtures

SF_DIR = Path("/root/testdata/sf0.001")
# These have tests of their own below.
PLAIN = {"experiment_run", "pair_scores"}

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(str(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - PLAIN))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, str(SF_DIR)).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    assert rows(got) == rows(db.execute(sql).to_arrow_table())


def common(a, b):
    """Length of the longest common subsequence, row by row."""
    codes = {x: i for i, x in enumerate({*a, *b})}
    b = np.array([codes[x] for x in b], np.int64)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == codes[x])))
    return int(row[-1])


def plain_scores(p, t):
    """BLEU, ROUGE-1 and ROUGE-L of stems, and edit similarity of two texts."""
    a, b = p.lower().split(), t.lower().split()
    grams = [[Counter(zip(*[w[i:] for i in range(n)], strict=False)) for w in (a, b)] for n in range(1, 5)]
    shared = [sum((x & y).values()) for x, y in grams]
    mean = sum(math.log(max(m, 0.1) / max(1, len(a) - n)) for n, m in enumerate(shared)) / 4
    bleu = math.exp(mean) * (1 if len(a) > len(b) else math.exp(1 - len(b) / len(a))) if shared[0] else 0
    a, b = ([stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", x.lower())] for x in (p, t))
    total = max(len(a) + len(b), 1)
    edit = 2 * common(p, t) / (len(p) + len(t)) if p or t else 1
    return bleu, 2 * sum((Counter(a) & Counter(b)).values()) / total, 2 * common(a, b) / total, edit


def test_pair_scores_equal_plain_ones(spark):
    given = {r.qid: plain_scores(r.prediction or "", r.truth or "") for r in fixtures.scored_pairs(spark, str(SF_DIR)).collect()}
    got = {r.qid: tuple(r[m] for m in metrics.METRICS) for r in entry.queries()["pair_scores"](spark, str(SF_DIR)).collect()}
    assert got.keys() == given.keys() and all(got[q] == pytest.approx(given[q], abs=2e-6) for q in given)


def test_experiment_run_equals_plain_means(spark):
    made = answer_queries.all_predictions(spark, str(SF_DIR)).collect()
    judged = {r.qid: len(r.answer) % 5 / 10 for r in fixtures.pairs(spark, str(SF_DIR)).collect()}
    by_config = defaultdict(list)
    for r in made:
        by_config[r.config].append((*plain_scores(r.prediction, r.truth), judged[r.qid]))
    got = {r.config: r for r in entry.queries()["experiment_run"](spark, str(SF_DIR)).collect()}
    assert got.keys() == by_config.keys() and len(got) == 13
    for config, scores in by_config.items():
        row = got[config]
        assert [row[m] for m in (*metrics.METRICS, "judge_mean")] == pytest.approx(list(np.mean(scores, axis=0)))
        assert row.n == row.judge_n == len(scores)


def test_contexts_are_written_beside_their_questions(spark):
    """What the chains read needs no join, so contexts are not moved once more."""
    asked = answer_queries.with_keyword_context(spark, str(SF_DIR))
    assert asked.columns == ["qid", "question", "answer", "context"] and "Exchange" not in physical_plan(asked)
    assert asked.count() == fixtures.pairs(spark, str(SF_DIR)).count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "context"]
