from answerloom import storage
from answerloom.operators import keyword
from answerloom.operators.generation import BatchGenerator, StageStore
from answerloom.progress import Progress
from pyspark.sql import functions as F


def upper():
    return lambda batch: [p.upper() for p in batch]


def test_steps_are_counted_as_they_run(spark):
    progress, store = Progress(), storage.new_location(spark, "stages")
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, None)], "doc_id long, text string")
    keyword.build(docs, progress=progress)
    prompts = docs.select(F.col("doc_id").alias("qid"), F.lit("A").alias("variant"), F.coalesce("text", F.lit("")).alias("prompt"))
    stages = StageStore(store, progress)
    stages.texts("draft", prompts.filter("qid < 3"), BatchGenerator(upper)).count()
    assert sorted(r.text for r in stages.texts("draft", prompts, BatchGenerator(upper)).collect()) == ["", "BLUE", "RED RED BLUE"]
    assert progress.counts() == {"index": {"rows": 3, "postings": 3}, "draft": {"rows": 2, "empty": 0}, "draft 2": {"rows": 1, "empty": 1}}
    assert {(r.step, r.measure, r.value) for r in progress.table(spark).collect()} >= {("index", "rows", 3), ("draft 2", "empty", 1)}
