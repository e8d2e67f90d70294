"""Language identification by a string kernel (operator 8).

The kernel of two texts counts the character n-grams, of several lengths, that
both have, divided by the root of the product of how many each has. Landmark
texts give the Nyström map; one ridge regression for each language against
the rest is fitted in it. A score is presence row x landmark matrix x map x weights; the last three
are multiplied once, so a batch is scored by sums over rows of one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerloom.llm.batches import fresh, held_out, mixed

#: N-grams are hashed to this many bins, for all lengths together.
BINS = 1 << 16
LENGTHS = (1, 2, 3, 4)
#: Rows learned from for each language at most, and code points: texts follow until so many have gone before.
FIT_ROWS = 250
FIT_CHARACTERS = 5_000_000
LANDMARKS = 200
RIDGE = 1e-2


def present(text: str, mark: np.ndarray) -> np.ndarray:
    """The bins of the n-grams of the text in lower case. ``mark`` is all False before and after."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(points):
            break
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] if n > 1 else points + np.uint64(1)
        if n in LENGTHS:
            mark[(mixed(rolled + np.uint64(n << 56)) % np.uint64(BINS)).astype(np.int64)] = True
    bins = np.flatnonzero(mark)
    mark[bins] = False
    return bins


class Model:
    """``matrix`` (bins x languages) and ``intercept`` give the regression values of a text."""

    def __init__(self, languages: list[str], matrix: np.ndarray, intercept: np.ndarray):
        self.languages, self.matrix, self.intercept = languages, matrix, intercept

    def values(self, bins: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bins])
        out = np.zeros((len(bins), len(self.languages)))
        if full := np.flatnonzero(sizes).tolist():
            rows = self.matrix[np.concatenate([bins[i] for i in full])]
            starts = np.cumsum([0, *sizes[full][:-1]])
            out[full] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64) / np.sqrt(sizes[full])[:, None]
        return out + self.intercept


def fitted(bins: list[np.ndarray], labels: list[str]) -> Model:
    """Nyström kernel ridge regression, one language against the rest."""
    languages = sorted(set(labels))
    marks = np.zeros((min(len(bins), LANDMARKS), BINS), np.float32)
    for row, i in zip(marks, np.linspace(0, len(bins) - 1, len(marks)).astype(int), strict=True):
        row[bins[i]] = 1 / np.sqrt(max(len(bins[i]), 1))

    def against_marks(b: np.ndarray) -> np.ndarray:
        return marks[:, b].sum(1, dtype=np.float64) / np.sqrt(max(len(b), 1))

    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    to_space = vectors[:, kept] / np.sqrt(values[kept])
    mapped = np.array([against_marks(b) for b in bins]) @ to_space
    wanted = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1 / np.bincount([languages.index(x) for x in labels])[[languages.index(x) for x in labels]]
    weight = (weight / weight.mean())[:, None]
    mean = (mapped * weight).mean(0)
    centred, level = mapped - mean, (wanted * weight).mean(0)
    beta = np.linalg.solve(centred.T @ (centred * weight) + RIDGE * len(bins) * np.eye(mapped.shape[1]) / 100, centred.T @ ((wanted - level) * weight))
    return Model(languages, (marks.T @ (to_space @ beta)).astype(np.float32), level - mean @ beta)


def fit(rows: DataFrame, text: str = "text", label: str = "lang", order: str = "doc_id") -> Model | None:
    """Learn from at most ``FIT_ROWS`` rows of each language, chosen by a hash of ``order`` and text.

    Rows with a null label, or a text that is null or empty, are not learned from. A text of any length may be; beyond
    ``FIT_CHARACTERS`` of a language no further text is taken, but always one. The sample comes as bins, not as texts. Without any row the
    model is None. The model has 256 KB for each language.
    """
    usable = rows.select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(order, text).alias("draw")).filter(
        F.col("label").isNotNull() & (F.length("text") > 0)
    )
    sizes = rows.filter(F.col(label).isNotNull() & (F.length(text) > 0)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    share = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < 4 * FIT_ROWS / F.col("n")
    # one row for each language; with it at hand a text that is not drawn is not moved
    drawn = usable.join(F.broadcast(sizes), "label").filter(share)
    first = Window.partitionBy("label").orderBy("draw", "text")
    best = drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= FIT_ROWS)
    earlier = F.coalesce(F.sum(F.length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("earlier", earlier).filter(F.col("earlier") < FIT_CHARACTERS)

    @F.arrow_udf("array<int>")
    def bins_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mark = np.zeros(BINS, bool)
        for batch in batches:
            yield pa.array([present(t.as_py(), mark).astype(np.int32) for t in batch], pa.list_(pa.int32()))

    sample = best.select("label", "draw", bins_of("text").alias("bins")).toArrow().sort_by([("draw", "ascending"), ("label", "ascending")])
    if not sample.num_rows:
        return None
    return fitted([np.asarray(b.values.to_numpy()) for b in sample.column("bins")], sample.column("label").to_pylist())


def predictor(model: Model | None, spark):
    """A function from a text column to a struct (lang_pred, score); see :func:`identified`."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mark, model = np.zeros(BINS, bool), shared.value
        for batch in batches:
            names, scores = ["und"] * len(batch), np.zeros(len(batch))
            for at in range(0, len(batch), 256):
                texts = [t.as_py() or "" for t in batch.slice(at, 256)]
                lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model else []
                if lettered:
                    values = model.values([present(texts[i], mark) for i in lettered])
                    odds = np.exp(4 * (values - values.max(1, keepdims=True)))
                    odds /= odds.sum(1, keepdims=True)
                    for i, row in zip(lettered, odds, strict=True):
                        names[at + i], scores[at + i] = model.languages[int(row.argmax())], row.max()
            yield pa.StructArray.from_arrays([pa.array(names), pa.array(scores)], ["lang_pred", "score"])

    return predict


def identified(docs: DataFrame, model: Model | None, text: str | Column = "text") -> DataFrame:
    """All columns of ``docs`` with the struct column ``language`` (lang_pred, score from 0 to 1).

    The whole text counts. ``und`` with score 0 stands for a null text, a text without a letter, and any
    text where nothing could be learned. Ties go to the first language by code
    point. If ``docs`` has a column ``language``, the new one gets a longer name, and is the last.
    """
    predict = predictor(model, docs.sparkSession)
    return docs.withColumn(fresh(docs, "language"), predict(text if isinstance(text, Column) else F.col(text)))


def learning_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: crc32 of the id, mod 4, is not 2."""
    return docs.filter(~held_out(F.col("doc_id"), 4, 2))
