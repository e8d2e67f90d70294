"""Scoring a whole corpus against a bounded block of queries.

Every query has to meet every document, so the pairs are the cost of an exact
answer. They are never rows: a task scores its documents against a block of
queries in memory and emits only the best ``depth`` per query. The corpus is
not shuffled, whatever its size, and a term that occurs in a third of all
documents costs arithmetic, not a hot shuffle key.

The query side is broadcast only in blocks below a checked size. A larger query
set is cut into several blocks, and each block's result is written before the
next starts, so a lost executor or driver plan never has to carry more than one.

Best lists merge on two levels. A fixed share of the documents is searched first; the score of
the last of a query's best there is a floor for the search of all. So a task emits what may be among
the best of the whole corpus, and not ``depth`` rows for each query, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom import storage

CELLS_PER_STEP = 1 << 22
QUERIES_PER_BLOCK = 50_000
#: Finds that wait, at least, before they are merged into the best lists.
MERGE_ROWS = 1 << 18
HITS = "qid long, doc_id long, score double"


def query_blocks(queries: DataFrame, size: int, limit: int, n_queries: int) -> list[DataFrame]:
    """Cut a table of ``n_queries`` queries and ``size`` units into blocks of about ``limit`` units, and a bounded number of queries."""
    blocks = max(1, -(-size // limit), -(-n_queries // QUERIES_PER_BLOCK))
    if blocks == 1:
        return [queries]
    slot = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    return [queries.filter(slot == block) for block in range(blocks)]


def scored_in_blocks(
    blocks: list[DataFrame], search: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    if len(blocks) == 1:
        return search(blocks[0])
    return reduce(DataFrame.unionByName, (storage.save(search(block), name) for block in blocks))


def floors(first: DataFrame, qids: np.ndarray, depth: int) -> np.ndarray:
    """For each query the score of the ``depth``-th of its hits in ``first`` (qid, score, raw_rank), or minus infinity. One row a query of the block."""
    last = first.filter(F.col("raw_rank") == depth).select("qid", "score").toArrow()
    out, order = np.full(len(qids), -np.inf), np.argsort(qids)
    out[order[np.searchsorted(qids, last["qid"].to_numpy(), sorter=order)]] = last["score"].to_numpy()
    return out


class BestPerQuery:
    """The best ``depth`` documents seen so far for each query of a block.

    Scores are rounded before they are compared, so that neither the order of
    a sum nor the split into tasks can change a rank; ties go to the lower id.

    Finds wait until there are as many as there are rows in the lists, so each
    row is sorted a few times only, however small the steps are.

    ``floor``: scores that the last of each query's best is known to reach; what is lower is not kept.
    """

    def __init__(self, n_queries: int, depth: int, digits: int, floor: np.ndarray | None = None):
        self.depth, self.digits = depth, digits
        self.floor = np.full(n_queries, -np.inf) if floor is None else floor.copy()
        self.rows = (np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, np.int64))
        self.waiting, self.n_waiting = [], 0

    def add(self, scores: np.ndarray, doc_ids: np.ndarray, positive_only: bool) -> None:
        """``scores`` has one row per query and one column per document."""
        if scores.shape[1] > self.depth:
            kth = scores.shape[1] - self.depth
            floor = np.maximum(self.floor, np.partition(scores, kth, axis=1)[:, kth])
        else:
            floor = self.floor
        wanted = scores >= (floor - 10.0**-self.digits)[:, None]
        if positive_only:
            wanted &= scores > 0
        query, column = np.nonzero(wanted)
        self.add_pairs(query, scores[query, column], doc_ids[column])

    def add_pairs(self, query: np.ndarray, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        """One score for each pair of a query's number and a document."""
        self.waiting.append((query, np.round(scores, self.digits), doc_ids))
        self.n_waiting += len(query)
        if self.n_waiting >= max(MERGE_ROWS, len(self.rows[0])):
            self._merge()

    def _merge(self) -> None:
        query, score, doc = (np.concatenate(parts) for parts in zip(self.rows, *self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        first = np.searchsorted(query, np.arange(len(self.floor) + 1))
        rank = np.arange(len(query)) - first[query]
        kept = rank < self.depth
        last = rank == self.depth - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.rows = (query[kept], score[kept], doc[kept])

    def batches(self, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._merge()
        query, score, doc = self.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids[query]), pa.array(doc), pa.array(score)], names=["qid", "doc_id", "score"]
        )
