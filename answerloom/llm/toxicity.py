"""Toxic spans by a linear-chain conditional random field (operator 3).

Labels are given for documents only. A first pass over the labelled rows
counts words and word beginnings by label; those that toxic documents have
and others do not label the tokens of toxic documents. The field learns from
these token sequences. Its forward-backward marginals give the offending
spans, and a logistic function of the largest marginal and of the expected
number of toxic tokens gives the score of the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import fresh, held_out, slices

#: Labelled rows learned from at most, of each label; chosen by a hash of the id.
FIT_ROWS = 3_000
#: Of these, the field itself learns from texts up to this many characters.
FIT_CHARACTERS = 8_000
FIELD_ROWS = 800
#: A feature marks toxicity if this share of toxic rows has it, many times the share among others, and the
#: likelihood ratio statistic of its counts is beyond what chance gives some of many features.
LEAST_SHARE = 0.004
LEAST_RATIO = 20.0
LEAST_EVIDENCE = 24.0
#: It also needs so many different words before it, by the rows that have it: copies of one text are no evidence.
LEAST_SURROUNDINGS = 0.5
FEATURES = 20_000
BEGINNINGS = (4, 5)
REMEMBERED_WORDS = 300_000

_TOKEN = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word in lower case, and its beginnings."""
    word = word.lower()
    return [f"={word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    start: np.ndarray
    score: np.ndarray  # of 1, the largest marginal, log(1 + expected number of toxic tokens)


class _Emission(dict):
    """Log odds of the toxic tag for a word, remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        get = self.model.weights.get
        value = self.model.bias + sum(get(f, 0.0) for f in features(word))
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value
        return value


def chain(odds: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, length: int = 128):
    """Forward and backward vectors (n x 2, each scaled) of chains laid end to end.

    ``first`` marks where a chain begins. The tokens are cut into stretches of
    ``length`` that are handled side by side; a running product over the
    stretches connects them, so the result is that of the plain recursion.
    """
    n = len(odds)
    width = -(-n // length)
    toxic = np.ones(width * length)
    toxic[:n] = np.exp(np.clip(odds, -30, 30))
    begins = np.ones(width * length, bool)
    begins[:n] = first
    matrix = np.where(begins[:, None, None], start[None, None, :], trans[None])
    matrix[:, :, 1] *= toxic[:, None]
    matrix = np.ascontiguousarray(matrix.reshape(width, length, 2, 2).transpose(1, 0, 2, 3))
    product = np.broadcast_to(np.eye(2), (width, 2, 2))
    for m in matrix:
        product = product @ m
        product /= product.sum((1, 2), keepdims=True)
    before, after = np.ones((width, 2)), np.ones((width, 2))
    for k in range(1, width):
        v = before[k - 1] @ product[k - 1]
        before[k] = v / v.sum()
    for k in range(width - 2, -1, -1):
        v = product[k + 1] @ after[k + 1]
        after[k] = v / v.sum()
    alpha, beta = np.empty((length, width, 2)), np.empty((length, width, 2))
    v = before
    for i in range(length):
        v = np.einsum("ki,kij->kj", v, matrix[i])
        v = v / v.sum(1, keepdims=True)
        alpha[i] = v
    v = after
    for i in range(length - 1, -1, -1):
        beta[i] = v
        v = np.einsum("kij,kj->ki", matrix[i], v)
        v = v / v.sum(1, keepdims=True)
    flat = [x.transpose(1, 0, 2).reshape(-1, 2)[:n] for x in (alpha, beta)]
    return flat[0], flat[1]


def marginals(odds: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The probability of the toxic tag for every token."""
    if not len(odds):
        return np.zeros(0)
    alpha, beta = chain(odds, first, trans, start)
    both = alpha * beta
    return both[:, 1] / both.sum(1)


def fit_field(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 60) -> tuple[dict[str, float], float, np.ndarray, np.ndarray]:
    """Maximum likelihood with a quadratic penalty, by gradient steps of adapted size.

    ``sequences``: for each text, the known features of its tokens and their tags.
    """
    names = sorted({f for feats, _ in sequences for fs in feats for f in fs})
    number = {f: i for i, f in enumerate(names)}
    tags = np.array([t for _, ts in sequences for t in ts], np.int64)
    lengths = np.array([len(ts) for _, ts in sequences])
    first = np.zeros(len(tags), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    where = np.array([i for i, fs in enumerate(fs for feats, _ in sequences for fs in feats) for _ in fs], np.int64)
    which = np.array([number[f] for feats, _ in sequences for fs in feats for f in fs], np.int64)
    inner = np.flatnonzero(~first)
    pair = tags[inner - 1] * 2 + tags[inner]
    seen_pairs = np.bincount(pair, minlength=4).reshape(2, 2).astype(float)
    seen_first = np.bincount(tags[first], minlength=2).astype(float)
    seen_features = np.bincount(which, weights=tags[where], minlength=len(names))
    theta = np.zeros(len(names) + 1 + 4 + 2)
    theta[len(names)] = -3.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)

    def parts(theta):
        f = len(names)
        return theta[:f], theta[f], np.exp(theta[f + 1 : f + 5].reshape(2, 2)), np.exp(theta[f + 5 :])

    for step in range(1, rounds + 1):
        weights, bias, trans, start = parts(theta)
        odds = bias + np.bincount(where, weights=weights[which], minlength=len(tags))
        alpha, beta = chain(odds, first, trans, start)
        both = alpha * beta
        toxic = both[:, 1] / both.sum(1)
        psi = np.stack([np.ones(len(odds)), np.exp(np.clip(odds, -30, 30))], 1)
        joint = alpha[inner - 1][:, :, None] * trans[None] * (psi[inner] * beta[inner])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        gradient = np.concatenate(
            [
                seen_features - np.bincount(which, weights=toxic[where], minlength=len(names)),
                [tags.sum() - toxic.sum()],
                (seen_pairs - joint.sum(0)).ravel(),
                seen_first - np.stack([1 - toxic, toxic], 1)[first].sum(0),
            ]
        )
        gradient -= 0.1 * theta
        mean = 0.8 * mean + 0.2 * gradient
        square = 0.95 * square + 0.05 * gradient**2
        theta = theta + 0.25 * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-8)
    weights, bias, trans, start = parts(theta)
    return dict(zip(names, weights.tolist(), strict=True)), float(bias), trans, start


def fit_score(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, with a small penalty and both labels weighing the same."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if y.min() == y.max():
        w[0] = 3.0 if y[0] else -3.0
        return w
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


def aggregated(probability: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(largest marginal, log(1 + sum of marginals of at least a half)) of each text; zeros without tokens."""
    out = np.zeros((len(lengths), 2))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full, 0] = np.maximum.reduceat(probability, starts)
        out[full, 1] = np.log1p(np.add.reduceat(np.where(probability >= 0.5, probability, 0), starts))
    return out


def _judged(model: Model, emission: _Emission, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = [_TOKEN.findall(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    odds = np.fromiter((emission[w] for ws in words for w in ws), float, int(lengths.sum()))
    first = np.zeros(len(odds), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    probability = marginals(odds, first, model.trans, model.start)
    return probability, lengths, aggregated(probability, lengths)


def toxic_features(rows: DataFrame) -> set[str]:
    """Features that mark toxicity, from (text, toxic) rows; counted by Spark, each row once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 23):
            for label in (0, 1):
                counts = Counter()
                for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                    if toxic.as_py() == label:
                        counts.update({f for w in set(_TOKEN.findall(text.as_py())) for f in features(w)})
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([label] * len(counts), pa.int32()), pa.array(counts.values(), pa.int64())], ["feature", "toxic", "n"])

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return set()
    counts = (
        rows.mapInArrow(counted, "feature string, toxic int, n bigint")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    )
    ratio = (F.col("bad") / toxic) / ((F.col("good") + 0.1) / max(clean, 1))
    having = F.col("bad") + F.col("good")
    share = toxic / (toxic + clean)
    evidence = 2 * (F.col("bad") * F.log(F.col("bad") / (having * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (having * (1 - share)))).otherwise(0.0))
    chosen = counts.filter((F.col("bad") > 0) & (F.col("bad") >= LEAST_SHARE * toxic) & (ratio >= LEAST_RATIO) & (evidence >= LEAST_EVIDENCE))
    likely = {r["feature"]: r["bad"] for r in chosen.orderBy(F.desc("bad"), "feature").limit(FEATURES).collect()}
    around = _surroundings(rows.filter("toxic = 1"), set(likely))
    return {f for f, bad in likely.items() if around.get(f, 0) >= LEAST_SURROUNDINGS * bad}


def _surroundings(rows: DataFrame, wanted: set[str]) -> dict[str, int]:
    """For each wanted feature, the number of different words before it; copies of a text do not add any."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in slices(batches, "text", 1 << 23):
            pairs = set()
            for text in batch.column("text"):
                before = ""
                for word in _TOKEN.findall(text.as_py()):
                    pairs.update((f, before) for f in features(word) if f in wanted)
                    before = word
            feature, before = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(feature, pa.string()), pa.array(before, pa.string())], ["feature", "before"])

    pairs = rows.mapInArrow(seen, "feature string, before string").distinct()
    return {r["feature"]: r["count"] for r in pairs.groupBy("feature").count().collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from the labelled documents; of each label ``FIT_ROWS`` at most, by a hash of the id.

    Rows whose id or label is null, or whose id has two labels, are not
    learned from. Without any row the model is None.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, FIT_ROWS / sizes.get(1, 1))).otherwise(min(1.0, FIT_ROWS / sizes.get(0, 1)))
    drawn = usable.filter(draw < share).limit(3 * FIT_ROWS).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id").select("doc_id", "text", "toxic")
    marks = toxic_features(rows)
    field_share = F.when(F.col("toxic") == 1, min(1.0, FIELD_ROWS / min(FIT_ROWS, sizes.get(1, 1)))).otherwise(min(1.0, FIELD_ROWS / min(FIT_ROWS, sizes.get(0, 1))))
    again = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter((F.length("text") <= FIT_CHARACTERS) & (again < field_share)).limit(4 * FIELD_ROWS).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, toxic = sample.column("text").to_pylist(), sample.column("toxic").to_pylist()
    if not texts:
        return None
    sequences = []
    for text, label in zip(texts, toxic, strict=True):
        feats = [[f for f in features(w) if f in marks] for w in _TOKEN.findall(text)]
        sequences.append((feats, [int(bool(label and fs)) for fs in feats]))
    weights, bias, trans, start = fit_field(sequences) if any(t for _, t in sequences) else ({}, -6.0, np.ones((2, 2)), np.ones(2))
    model = Model(weights, bias, trans, start, np.zeros(3))
    probability, lengths, told = _judged(model, _Emission(model), texts)
    model.score = fit_score(told, np.array(toxic))
    return model


def judged(docs: DataFrame, model: Model | None, text: str | Column = "text") -> DataFrame:
    """All columns of ``docs`` with the struct column ``toxicity`` (score, spans).

    ``score`` is from 0 to 1; a text that is null, or has no word, has the score of no find; without a model it is 0.
    ``spans`` are the words whose marginal is at least a half: start and end in
    code points (end exclusive) and the marginal. If ``docs`` has a column ``toxicity``, the new one gets a longer name, and is the last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    @F.arrow_udf("struct<score: double, spans: array<struct<start: bigint, end: bigint, probability: double>>>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        emission = _Emission(model) if model else None
        for batch in batches:
            scores, spans = [], []
            for piece in slices([pa.RecordBatch.from_arrays([batch], ["text"])], "text"):
                texts = [t.as_py() or "" for t in piece.column("text")]
                if model is None:
                    scores += [0.0] * len(texts)
                    spans += [[]] * len(texts)
                    continue
                probability, lengths, told = _judged(model, emission, texts)
                value = np.clip(model.score[0] + told @ model.score[1:], -30, 30)
                scores += (1 / (1 + np.exp(-value))).tolist()
                at = 0
                for text, n in zip(texts, lengths.tolist(), strict=True):
                    own = probability[at : at + n]
                    at += n
                    found = []
                    if n and own.max() >= 0.5:
                        found = [{"start": m.start(), "end": m.end(), "probability": float(p)} for m, p in zip(_TOKEN.finditer(text), own, strict=True) if p >= 0.5]
                    spans.append(found)
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["score", "spans"])

    return docs.withColumn(fresh(docs, "toxicity"), judge(text if isinstance(text, Column) else F.col(text)))


def learning_rows(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id, mod 5, is not 0."""
    return labels.filter(~held_out(F.col("doc_id"), 5, 0))
