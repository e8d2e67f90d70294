import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from answerloom import schemas, storage
from answerloom.operators import answers, sampling
from answerloom.plans import datasets
from answerloom.sources import issues, tables
from tests.plans import physical_plan


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "eval.csv"
    path.write_text('question,answer\n"a","b"\n"c"\n"x","y","z"\n"p","q",\n"multi\nline","say ""hi"""\n,\n')
    rows = tables.read_eval_csv(spark, str(path)).orderBy("qid").collect()
    assert [(r.question, r.answer) for r in rows] == [("a", "b"), ("c", ""), ("multi\nline", 'say "hi"'), ("", "")]
    assert tables.read_eval_csv(spark, str(path), limit=1).collect()[0].question == "a"


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "q" \\ b', "line\nbreak, comma"), ("plain", "ünï")]
    out = str(tmp_path / "new" / "out.csv")
    tables.write_csv(spark.createDataFrame(rows, "question string, answer string"), out)
    assert {(r.question, r.answer) for r in tables.read_eval_csv(spark, out).collect()} == set(rows)


def test_corpus_from_csv_and_parquet(spark, tmp_path):
    corpus = spark.createDataFrame([(2, "t", "b", "x|y", 3, "a", 7), (1, "t", None, "x", 4, "a", 7)], schemas.QA_CORPUS)
    tables.write_csv(corpus, str(tmp_path / "c.csv"))
    corpus.write.parquet(str(tmp_path / "c"))
    for path in ("c.csv", "c"):
        read = tables.read_corpus(spark, str(tmp_path / path))
        assert sorted(r.question_id for r in read.collect()) == [1, 2]
        assert tables.read_corpus(spark, str(tmp_path / path), limit=1).first().question_id == 1


@pytest.fixture
def issue_tree(tmp_path):
    leaf, inner = tmp_path / "a" / "b[1] x" / "c", tmp_path / "a" / "b[1] x"
    leaf.mkdir(parents=True)
    issue = {
        "title": "T",
        "body": "B",
        "number": 4,
        "comments_details": [
            {"body": "first", "reactions": {"+1": 1, "eyes": 9}},
            {"body": " second ", "reactions": {"+1": 1, "heart": 1, "hooray": 1}},
            {"body": "third", "reactions": {"heart": 3}},
            {"body": "none", "reactions": None},
            {"body": " ", "reactions": {"+1": 99}},
            {"reactions": {"+1": 99}},
        ],
    }
    (inner / "1.json").write_text(json.dumps(issue))
    (leaf / "2.json").write_text("{bad")
    (leaf / "3.json").write_text(json.dumps({"title": "no comments", "body": "B"}))
    (leaf / "4.json").write_text(json.dumps(issue, indent=1))
    (leaf / "5.json").write_text(json.dumps({**issue, "body": ""}))
    (leaf / "6.txt").write_text(json.dumps(issue))
    return tmp_path


def test_issue_tree(spark, issue_tree, tmp_path):
    pairs = datasets.qa_from_issues(spark, str(issue_tree), ratio=1.0, output=str(tmp_path / "out"))
    assert [tuple(r) for r in pairs.collect()] == [("T\nB", "second")]
    assert tables.read_eval_csv(spark, str(tmp_path / "out")).first().answer == "second"
    assert datasets.qa_from_issues(spark, str(issue_tree), ratio=1.0, leaf_only=False).count() == 2


def test_progress_counts_files(spark, issue_tree):
    seen = Observation()
    assert datasets.qa_from_issues(spark, str(issue_tree), ratio=1.0, progress=seen).count() == 1
    assert seen.get == {"files": 4, "skipped": 1}


def test_files_are_listed_by_few_tasks_once(spark, tmp_path, monkeypatch):
    for n in range(40):
        (tmp_path / f"{n}.json").write_text("{}")
    monkeypatch.setattr(issues, "LISTING_TASKS", 1)
    files, cores = issues.list_files(spark, str(tmp_path)), spark.sparkContext.defaultParallelism
    (tmp_path / "late.json").write_text("{}")
    assert files.count() == 40 and "binaryFile" not in physical_plan(files) and len(files.inputFiles()) <= 2 * cores


def test_listing_reads_no_contents(spark, issue_tree):
    assert "content#" not in physical_plan(issues.list_files(spark, str(issue_tree)))


@pytest.mark.parametrize("task, batch", [(5_000, 16 << 20), (1, 1)])
def test_only_listed_files_are_opened_in_tasks(spark, issue_tree, monkeypatch, task, batch):
    monkeypatch.setattr(issues, "TASK_FILES", task)
    monkeypatch.setattr(issues, "BATCH_BYTES", batch)
    odd = issue_tree / "odd [a] %41 é?"
    odd.mkdir()
    (odd / "x y.json").write_text('{"title": "odd"}')
    files = issues.list_files(spark, str(issue_tree))
    some = issues.read_issues(files.filter("path not like '%/5.json'"))
    assert "content#" not in physical_plan(files) and "binaryFile" not in physical_plan(some)
    assert sorted((r.path.rsplit("/", 1)[1], r.title, r.malformed) for r in some.collect()) == sorted(
        [("2.json", None, True), ("3.json", "no comments", False), ("4.json", "T", False), ("x y.json", "odd", False)]
    )
    assert issues.read_issues(files.limit(0)).count() == 0


def test_best_comment_keeps_first_of_equals_and_zero(spark):
    rows = [
        (1, [("a", (1, 0, 0)), ("b", (3, 0, 0)), ("c", (1, 1, 1))]),
        (2, [("  ", (9, 0, 0)), ("text", (0, None, None))]),
        (3, []),
        (4, None),
    ]
    df = spark.createDataFrame(
        rows, "id int, comments array<struct<body string, reactions struct<`+1` int, heart int, hooray int>>>"
    )
    best = df.select("id", answers.best_comment(F.col("comments")).alias("b"))
    assert {r.id: r.b and r.b.body for r in best.collect()} == {1: "b", 2: "text", 3: None, 4: None}


def test_best_comments_of_rows(spark):
    rows = [(1, 0, "a", (1, 0, 0)), (1, 1, "b", (1, 1, 1)), (1, 2, "c", (3, None, 0)), (1, 3, " ", (9, 9, 9)), (2, 0, "", (1, 1, 1))]
    df = spark.createDataFrame(
        rows, "id long, place int, body string, reactions struct<`+1` int, heart int, hooray int>"
    )
    assert [tuple(r) for r in answers.best_comments(df, "id").collect()] == [(1, 3, "b")]


def test_first_rows_across_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(20)
    expected = sorted(r.v for r in df.collect())
    for n in (0, 1, 300, 4321, 5000, 6000):
        assert [r.v for r in sampling.first_rows(df, n, "v").collect()] == expected[:n]
    assert "TakeOrderedAndProject" not in physical_plan(sampling.first_rows(df, 4321, "v"))


def test_first_rows_with_nulls_and_ties(spark):
    rows = [(None, 1), (None, 2), ("a", None), ("a", 1), ("a", 1), ("a", 1), ("b", 0)]
    df = spark.createDataFrame(rows * 3, "s string, i int").repartition(5)
    expected = sorted(rows * 3, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    for n in (1, 4, 7, 11, 18, 21, 30):
        assert [tuple(r) for r in sampling.first_rows(df, n, "s", "i").collect()] == expected[:n]
    assert sampling.first_rows(df.filter("false"), 3, "s").count() == 0


@pytest.mark.parametrize("slices", [1, 7, 1000])
def test_stratified_sample(spark, monkeypatch, slices):
    rows = [(i, "big" if i % 3 else f"s{i % 10}") for i in range(600)] + [(1000, None), (1001, "one")]
    df = spark.createDataFrame(rows, "id long, s string")
    monkeypatch.setattr(sampling, "_slices", lambda _: slices)
    sample = sampling.stratified_sample(df, "s", "id", 0.1, 3).collect()
    sizes = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    taken = {}
    for r in sample:
        taken[r.s] = taken.get(r.s, 0) + 1
    assert taken == {s: max(1, int(n * 0.1)) for s, n in sizes.items()}
    import hashlib

    def digest(i):
        return hashlib.md5(f"{i}|3".encode()).hexdigest()

    big = sorted((i for i, s in rows if s == "big"), key=digest)[: taken["big"]]
    assert sorted(r.id for r in sample if r.s == "big") == sorted(big)


@pytest.mark.parametrize("n, expected", [(5, 1), (25, 2), (1, 1)])
def test_sample_size(spark, n, expected):
    df = spark.range(n).withColumn("s", F.lit("x"))
    assert sampling.stratified_sample(df, "s", "id", 0.1).count() == expected


def test_posts(spark):
    questions = spark.createDataFrame(
        [
            (1, "t1", "b1", "python|x", 9, "2021-01-01 00:00:00"),
            (2, "t2", "b2", "c", 9, "2021-01-01 00:00:00"),
            (3, "t3", "b3", "javascript", 4, "2021-01-01 00:00:00"),
            (4, "t4", "b4", "java", 5, "2019-12-31 00:00:00"),
        ],
        "id long, title string, body string, tags string, score int, creation_date string",
    ).withColumn("creation_date", F.col("creation_date").cast("timestamp"))
    replies = spark.createDataFrame(
        [(10, 1, "a", 5), (11, 1, "low", 4), (12, 2, "a", 5), (13, 3, "a", 5), (14, 4, "a", 5)],
        "id long, parent_id long, body string, score int",
    )
    assert [r.answer_id for r in datasets.qa_from_posts(questions, replies).collect()] == [10]
    loose = datasets.qa_from_posts(questions, replies, None, None, None, None, limit=3)
    assert [r.answer_id for r in loose.collect()] == [10, 11, 12]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([], schemas.QUESTION_POSTS).write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([], schemas.ANSWER_POSTS).write.parquet(str(tmp_path / "a"))
    plan = physical_plan(datasets.qa_from_posts(*tables.read_posts(spark, str(tmp_path / "q"), str(tmp_path / "a"))))
    assert "GreaterThanOrEqual(score,5)" in plan and "StringContains(tags,python)" in plan


def test_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_eval_csv(spark, str(tmp_path / "nowhere"))


class Session:
    """The parts of a session that the shared folder depends on."""

    def __init__(self, master, settings):
        self.master, self.settings, self.folder = master, settings, None
        self.conf, self.sparkContext = self, self

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder():
    named = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert storage.shared_root(Session("spark://host:7077", named)) == "hdfs://shared"
    with pytest.raises(RuntimeError):
        storage.shared_root(Session("spark://host:7077", {}))
    local = Session("local[4]", {})
    assert storage.shared_root(local) == storage.shared_root(local) == local.folder


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text('answer,id,question\n"a1","1","q1"\n"a2","2","q2","long"\n"a3"\n')
    (tmp_path / "e" / "b.csv").write_text('answer,id,question\n"a4","4","q4"\n')
    rows = tables.read_eval_csv(spark, str(tmp_path / "e")).orderBy("qid").collect()
    assert [(r.question, r.answer) for r in rows] == [("q1", "a1"), ("", "a3"), ("q4", "a4")]
    assert [r.qid for r in rows] == [0, 2, 1 << 33]
    with pytest.raises(tables.MissingColumns):
        tables.read_corpus(spark, str(tmp_path / "e" / "a.csv"))


def test_issue_file_of_bad_bytes_is_malformed(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_bytes(b'{"title": "\xff"}')
    (tmp_path / "r" / "2.json").write_text('{"title": "t"}')
    read = issues.read_issues(issues.list_files(spark, str(tmp_path)))
    assert {(r.title, r.malformed) for r in read.collect()} == {(None, True), ("t", False)}
