"""Exact nearest neighbours by inner product.

A table of vectors can be cut into clusters, each a partition of its own. A vector's angle to a query is at least that of its cluster's
centre less the radius of the cluster, so the clusters nearest to a query tell which others cannot hold one of its best; those are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom import storage
from answerloom.functions import multisets, vectors
from answerloom.functions.binding import let
from answerloom.operators import blocks, ranking

QUERY_NUMBERS_PER_BLOCK = 8_000_000
#: Queries that a task multiplies with documents at a time, at most, documents once floors are known, so that products stay in a core's cache, and pairs that it
#: works out in double precision at a time.
QUERIES_PER_STEP, DOCUMENTS_PER_STEP, PAIRS = 512, 512, 1 << 16
#: Of so many times ``blocks.QUERIES_PER_BLOCK`` queries, the corpus is read once.
QUERY_BLOCKS = 2
#: Clusters at most, and vectors that their centres are learned from; every vector is put into a cluster.
CLUSTERS, LEARNED = 1024, 20_000
#: Pairs of a query and a cluster whose bounds are worked out together.
BOUNDS = 1 << 24
#: Added to angles, for what rounding takes away.
SLACK = 1e-6


def normalised(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Scale each vector to length one."""
    return df.withColumn(column, vectors.normalised(F.col(column)))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    depth: int,
    digits: int = 6,
    block_numbers: int = QUERY_NUMBERS_PER_BLOCK,
) -> DataFrame:
    """The ``depth`` best documents per query by inner product.

    ``queries`` has (qid, embedding) and ``corpus`` (doc_id, embedding), the latter
    best a written table, as it is scanned once per ``QUERY_NUMBERS_PER_BLOCK`` numbers of queries. Tasks go through these by
    ``block_numbers``. Returns (qid, doc_id, score, raw_rank).
    """
    queries = storage.save(queries.select("qid", "embedding"), "query-vectors").filter("embedding is not null")
    corpus = corpus.select("doc_id", "embedding")
    size, n_queries = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.count("*")).first()

    def search(block: DataFrame) -> DataFrame:
        table = block.toArrow()
        qids = table["qid"].to_numpy()
        if not len(qids):
            return block.sparkSession.createDataFrame([], blocks.HITS)
        matrix = _matrix(table["embedding"])
        shared = block.sparkSession.sparkContext.broadcast((qids, matrix))
        rows = max(1, min(QUERIES_PER_STEP, block_numbers // max(1, matrix.shape[1])))
        return corpus.mapInArrow(_scorer(shared, depth, digits, rows), blocks.HITS)

    # A job for each small block would send the figures of blocks times tasks to the driver.
    held = max(block_numbers, QUERY_NUMBERS_PER_BLOCK)
    parts = blocks.query_blocks(queries, size, held, -(-n_queries // QUERY_BLOCKS))
    if len(parts) == 1:
        return ranking.top(search(parts[0]), depth)
    # what all tasks found is merged before it is written; the rows of a query are in one block
    return ranking.top(blocks.scored_in_blocks(parts, lambda part: ranking.top(search(part), depth).drop("raw_rank"), "vector-hits"), depth)


def _scorer(shared, depth: int, digits: int, rows: int):
    def score(batches):
        qids, matrix = shared.value
        best = blocks.BestPerQuery(len(qids), depth, digits)
        asked, space = _Single(matrix), _Space()
        for batch in batches:
            # Here rather than in a filter, which would compute an encoded vector twice.
            batch = batch.filter(pc.is_valid(batch.column("embedding")))
            if not batch.num_rows:
                continue
            if pc.any(pc.not_equal(pc.list_value_length(batch.column("embedding")), matrix.shape[1])).as_py():
                raise ValueError(f"vectors of the corpus need {matrix.shape[1]} numbers, as those of the queries")
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            documents = _Single(values.astype(np.float64).reshape(len(doc_ids), -1))
            for low in range(0, len(qids), rows):
                part = slice(low, low + rows)
                # the first floors are better, the more documents they are of
                step = max(1, blocks.CELLS_PER_STEP // rows) if np.isinf(best.floor[part]).any() else DOCUMENTS_PER_STEP
                for start in range(0, len(doc_ids), step):
                    _best_pairs(best, asked, part, documents, slice(start, start + step), doc_ids, space)
        yield from best.batches(qids)

    return score


class _Single:
    """Vectors in double and in single precision; ``usable`` where the latter has a number for each."""

    def __init__(self, matrix: np.ndarray):
        with np.errstate(over="ignore"):
            self.exact, self.single = matrix, matrix.astype(np.float32)
        self.usable = bool(np.isfinite(self.single).all())
        self.longest = float(np.linalg.norm(matrix, axis=1).max(initial=0.0)) if self.usable else 0.0


class _Space:
    """Arrays that are overwritten by the next of their kind: new ones cost more than what is written into them."""

    def __init__(self):
        self.held: dict = {}

    def array(self, dtype, shape: tuple[int, int]) -> np.ndarray:
        size = shape[0] * shape[1]
        if dtype not in self.held or len(self.held[dtype]) < size:
            self.held[dtype] = np.empty(size, dtype)
        return self.held[dtype][:size].reshape(shape)


def _best_pairs(best: blocks.BestPerQuery, asked: _Single, rows: slice, documents: _Single, columns: slice, doc_ids: np.ndarray, space: _Space) -> None:
    """Offer ``best`` the pairs that may be among the best of a query, found in single precision and worked out in double."""
    usable = asked.usable and documents.usable
    left, right = (asked.single, documents.single) if usable else (asked.exact, documents.exact)
    # more than the products and their sum can be wrong by
    slack = (left.shape[1] + 4) * 2.0**-23 * asked.longest * documents.longest + 10.0**-best.digits
    left, right = left[rows], right[columns]
    near = np.matmul(left, right.T, out=space.array(left.dtype, (len(left), len(right))))
    floor = best.floor[rows]
    if near.shape[1] > best.depth and (not usable or np.isinf(floor).any()):
        kth = near.shape[1] - best.depth
        floor = np.maximum(floor, np.partition(near, kth, axis=1)[:, kth].astype(np.float64) - slack)
        best.floor[rows] = floor if usable else best.floor[rows]
    reached = np.greater_equal(near, (floor - slack)[:, None].astype(near.dtype), out=space.array(np.dtype(bool), near.shape))
    query, column = np.divmod(np.flatnonzero(reached), near.shape[1])
    for at in range(0, len(query), PAIRS):
        q, d = query[at : at + PAIRS] + rows.start, column[at : at + PAIRS] + columns.start
        best.add_pairs(q, np.einsum("ij,ij->i", asked.exact[q], documents.exact[d]), doc_ids[d])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column)
    if pc.count_distinct(sizes).as_py() > 1:
        raise ValueError("vectors need as many numbers as each other")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class VectorClusters:
    """``vectors`` (doc_id, embedding, cluster), written with a partition for each cluster, and what is known of these by number.

    ``centres``: unit vectors; ``radius``: the largest angle of a member to its centre; ``longest`` and ``shortest``: lengths of members;
    ``sizes``: how many they are. The table has ``CLUSTERS`` rows at most, whatever the number of vectors.
    """

    vectors: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    sizes: np.ndarray

    def bounds(self, matrix: np.ndarray) -> np.ndarray:
        """The largest inner product that each row can have with a member of each cluster."""
        lengths = np.linalg.norm(matrix, axis=1)
        unit = matrix / np.where(lengths > 0, lengths, 1)[:, None]
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        nearest = np.cos(np.clip(angle - self.radius - SLACK, 0, np.pi))
        return lengths[:, None] * np.where(nearest > 0, nearest * self.longest, nearest * self.shortest)


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1)


def _centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``n`` groups of unit vectors, from the farthest first, then moved to the mean direction of their groups."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < n:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    return centres


def clustered(corpus: DataFrame, n: int | None = None, location: str | None = None) -> VectorClusters:
    """Write (doc_id, embedding) by cluster. Missing vectors are left out; lengths need not be one.

    Centres are learned from ``LEARNED`` vectors, the first by a hash of their ids; there are ``n``, or about as many as the root of the number of
    vectors. A cluster with very many vectors is written by several tasks.
    """
    spark = corpus.sparkSession
    corpus = corpus.select("doc_id", "embedding").filter("embedding is not null")
    total = corpus.count()
    first = corpus.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARNED).select("embedding").toArrow()
    if not total:
        none = np.zeros(0)
        return VectorClusters(corpus.withColumn("cluster", F.lit(0)), np.zeros((0, 0)), none, none, none, none)
    sample = np.unique(_unit(_matrix(first["embedding"])), axis=0)
    n = min(n or int(total**0.5), CLUSTERS, len(sample))
    shared = spark.sparkContext.broadcast(_centres(sample, n))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("embedding"))
            lengths = np.linalg.norm(matrix, axis=1)
            near = _unit(matrix) @ centres.T
            own = near.argmax(1).astype(np.int32)
            angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(angle), pa.array(lengths)], ["doc_id", "embedding", "cluster", "angle", "length"])

    kind = f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, embedding {corpus.schema['embedding'].dataType.simpleString()}, cluster int, angle double, length double"
    assigned = corpus.mapInArrow(assign, kind).hint("rebalance", "cluster")
    path = location or storage.new_location(spark, "vector-clusters")
    assigned.write.partitionBy("cluster").parquet(path)
    vectors = spark.read.schema(kind).parquet(path)
    known = vectors.groupBy("cluster").agg(F.max("angle"), F.max("length"), F.min("length"), F.count("*")).collect()
    stats = np.zeros((4, n))
    for cluster, *values in known:
        stats[:, cluster] = values
    return VectorClusters(vectors.select("doc_id", "embedding", "cluster"), shared.value, *stats)


def nearest_in_clusters(
    queries: DataFrame, clusters: VectorClusters, depth: int, digits: int = 6, block_numbers: int = QUERY_NUMBERS_PER_BLOCK
) -> DataFrame:
    """The same as ``nearest`` over the vectors of ``clusters``, reading only clusters that can hold hits.

    A query is first compared with the clusters of the largest bounds, as many as hold ``depth`` vectors. The last of its best there is a floor: in the second
    reading it meets only clusters whose bound reaches that.
    """
    queries = storage.save(queries.select("qid", "embedding"), "query-vectors").filter("embedding is not null")
    size, n_queries = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.count("*")).first()
    limit = max(1, BOUNDS // max(1, len(clusters.centres)))
    n_blocks = max(-(-size // block_numbers), -(-n_queries // limit), 1)

    def search(block: DataFrame) -> DataFrame:
        table, spark = block.toArrow(), block.sparkSession
        qids = table["qid"].to_numpy()
        if not len(qids) or not len(clusters.centres):
            return spark.createDataFrame([], blocks.HITS)
        matrix = _matrix(table["embedding"])
        bounds = clusters.bounds(matrix)
        first = _first_clusters(bounds, clusters.sizes, depth)
        found = storage.save(ranking.top(_scored(clusters, qids, matrix, first, None, depth, digits), depth), "vector-hits")
        floor = blocks.floors(found, qids, depth)
        second = ~first & (bounds >= (floor - 10.0**-digits)[:, None])
        return found.select("qid", "doc_id", "score").unionByName(_scored(clusters, qids, matrix, second, floor, depth, digits))

    hits = blocks.scored_in_blocks(blocks.query_blocks(queries, n_blocks, 1, n_queries), search, "vector-hits")
    return ranking.top(hits, depth)


def _first_clusters(bounds: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """For each query the clusters of the largest bounds that together hold ``depth`` vectors."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, held < depth, axis=1)
    return out


def _scored(clusters: VectorClusters, qids: np.ndarray, matrix: np.ndarray, wanted: np.ndarray, floor: np.ndarray | None, depth: int, digits: int) -> DataFrame:
    """Hits of the wanted pairs of query and cluster; the clusters that no query wants are not read."""
    spark = clusters.vectors.sparkSession
    read = np.flatnonzero(wanted.any(0) & (clusters.sizes > 0)).tolist()
    if not read:
        return spark.createDataFrame([], blocks.HITS)
    shared = spark.sparkContext.broadcast((qids, matrix, np.packbits(wanted, axis=0), floor))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix, packed, floor = shared.value
        best = blocks.BestPerQuery(len(qids), depth, digits, floor)
        for batch in batches:
            of = batch.column("cluster").to_numpy()
            for cluster in np.unique(of).tolist():
                asked = np.flatnonzero(np.unpackbits(packed[:, cluster], count=len(qids)))
                rows = batch.filter(pa.array(of == cluster))
                doc_ids, vectors = rows.column("doc_id").to_numpy(zero_copy_only=False), _matrix(rows.column("embedding"))
                if len(asked) and vectors.shape[1] != matrix.shape[1]:
                    raise ValueError(f"vectors of the corpus need {matrix.shape[1]} numbers, as those of the queries")
                step = max(1, blocks.CELLS_PER_STEP // max(1, len(asked)))
                for low in range(0, len(doc_ids) if len(asked) else 0, step):
                    scores = matrix[asked] @ vectors[low : low + step].T
                    least = best.floor[asked]
                    if scores.shape[1] > depth:
                        least = np.maximum(least, np.partition(scores, scores.shape[1] - depth, axis=1)[:, scores.shape[1] - depth])
                    query, column = np.nonzero(scores >= (least - 10.0**-digits)[:, None])
                    best.add_pairs(asked[query], scores[query, column], doc_ids[low + column])
        yield from best.batches(qids)

    return clusters.vectors.filter(F.col("cluster").isin(read)).mapInArrow(score, blocks.HITS)


def build(
    texts: DataFrame, encode: Callable[[DataFrame, str], DataFrame], location: str | None = None
) -> DataFrame:
    """Encode a corpus (doc_id, text) once and write its vectors (doc_id, embedding)."""
    return storage.save(encode(texts, "doc_id").select("doc_id", "embedding"), "vectors", location)


def encoded(
    df: DataFrame,
    key: str,
    load: Callable[[], Callable[[list[str]], Sequence]],
    batch_size: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """Unit vectors (key, embedding) of the column ``text`` from an encoder model.

    ``load`` runs once per task and returns a function from a list of texts to
    one vector each.
    """
    if partitions:
        df = df.repartition(partitions, key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                found = [[float(x) for x in vector] for vector in model(part["text"].tolist())]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": found})

    return normalised(df.select(key, "text").mapInPandas(run, f"`{key}` long, embedding array<double>"))


def hash_vectors(df: DataFrame, tokens: Column, key: str, dimensions: int = 64) -> DataFrame:
    """A model-free text encoder: counts of tokens per hash bucket, scaled to length one.

    Stands in for a sentence encoder where none is available. Returns
    (key, embedding); a text without tokens gets a zero vector.
    """

    def bucket(token: Column) -> Column:
        return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int") % dimensions

    def filled(counts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dimensions - 1)),
            lambda b: F.coalesce(F.try_element_at(counts, b), F.lit(0)).cast("double"),
        )

    entries = multisets.counted(F.transform(tokens, bucket))
    return df.select(key, vectors.normalised(let(F.map_from_entries(entries), filled)).alias("embedding"))
