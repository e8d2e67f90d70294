"""TF-IDF index and exact sparse nearest neighbours.

An index is a set of written tables. At a named place it also has a manifest, written last: what no manifest names is
not part of it, so a build that broke off is never read. Documents added later come as a segment with counts of
its own; document frequencies of segments add up, and no text is read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom import files, storage
from answerloom.functions import text
from answerloom.functions.words import ENGLISH_STOP_WORDS
from answerloom.operators import blocks, ranking
from answerloom.progress import Progress, watched

#: Terms of queries that are broadcast as rows to join, and terms and queries that the index is searched for in one pass, at most.
QUERY_TERMS_PER_BLOCK, SEARCHED_TERMS, QUERY_BLOCKS = 500_000, 2_000_000, 4
#: Terms of one part of the dictionary, postings that are weighed together, and tokens that are counted together, about.
DICTIONARY_TERMS, WEIGHED, COUNTED = 1 << 20, 1 << 18, 1 << 19
#: One document in so many is searched first, for the floors.
SAMPLE = 32
#: Postings that a task turns round together, at most, and documents whose words it looks up together.
POSTINGS, ROWS = 1 << 22, 1 << 12
#: A term that makes at least this share of the pairs of a query and a document is multiplied as a row of a matrix, of at most ``DENSE_TERMS``.
DENSE_SHARE, DENSE_TERMS = 0.005, 1024
#: Numbers of that matrix, at most.
DENSE_CELLS = 1 << 23
#: Scores and postings that are worked out together, and products of the matrix that are made together, about.
CELLS, PRODUCTS = 1 << 18, 1 << 21
#: A query that has more documents near its floor, in lists of the best, keeps those near the best here.
NEAR = 8
#: More than single precision can be wrong by, over so many products of unit rows.
SLACK = 1e-4


@dataclass(frozen=True)
class KeywordIndex:
    """``documents`` (doc_id, terms, weights, length), ``sample``, a fixed share of them, and ``terms`` (term, df, idf), all written tables."""

    documents: DataFrame
    sample: DataFrame
    terms: DataFrame
    n_documents: int
    stop_words: tuple[str, ...]


def term_counts(df: DataFrame, key: str, column: str, stop_words: Sequence[str]) -> DataFrame:
    """(key, counts) of each text: its distinct terms in order, counted inside the row."""

    @F.arrow_udf("array<struct<term: string, n: int>>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            made = [_counted(part) for part in _cut(tokens, COUNTED)]
            yield pa.concat_arrays(made) if made else _counted(tokens)

    return df.select(key, counts(text.word_tokens(F.col(column), stop_words)).alias("counts"))


def _counted(tokens: pa.Array) -> pa.Array:
    """The distinct tokens of each row, as numbers that keep their order, with how often they occur."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    encoded = tokens.flatten().dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary).to_numpy()
    number, distinct = np.empty(len(order), np.int64), max(1, len(order))
    number[order] = np.arange(len(order))
    keys = number[encoded.indices.to_numpy(zero_copy_only=False)] + np.repeat(np.arange(len(sizes)) * distinct, sizes)
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    row, place = np.divmod(keys[starts], distinct)
    n = pa.array(np.diff(starts, append=len(keys)), pa.int32())
    offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([encoded.dictionary.take(pa.array(order[place])), n], ["term", "n"]))


def _cut(lists: pa.Array, size: int) -> list[pa.Array]:
    """Rows of lists in parts of about ``size`` elements."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    cuts = np.flatnonzero(np.diff(ends[:-1] // size, prepend=-1)).tolist()
    return [lists[low:high] for low, high in zip(cuts, [*cuts[1:], len(lists)])]


def term_frequency(counted: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term is. Each term is a row once for some documents, not for each."""
    parts = counted.select(F.col("counts.term").alias("terms")).mapInArrow(_frequencies, "term string, df bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        encoded = batch.column("terms").flatten().dictionary_encode()
        n = np.bincount(encoded.indices.to_numpy(zero_copy_only=False), minlength=len(encoded.dictionary))
        yield pa.RecordBatch.from_arrays([encoded.dictionary, pa.array(n, pa.int64())], ["term", "df"])


def with_idf(frequency: DataFrame, n_documents: int) -> DataFrame:
    """Document frequency and smoothed inverse document frequency: (term, df, idf)."""
    return frequency.withColumn("idf", F.log((F.lit(1.0) + n_documents) / (F.lit(1.0) + F.col("df"))) + 1.0)


def dictionary(terms: DataFrame) -> tuple[tuple[str, ...], int, int]:
    """The idf of every term in flat files that tasks map: sorted 64-bit digests and, beside them, the values.

    Returns their names, the number of parts and the seed of the digests: the first with which no two terms have the
    same, so that a digest stands for its term exactly.
    """
    parts, seed = terms.count() // DICTIONARY_TERMS + 1, 0
    while True:
        digest = F.xxhash64(F.lit(seed), "term")
        rows = terms.select(digest.alias("digest"), "idf").repartition(parts, F.pmod("digest", F.lit(parts))).sortWithinPartitions("digest")
        made = storage.save(rows.mapInArrow(_dictionary_parts(parts), "blob binary, clashes bigint"), "dictionary")
        if not made.agg(F.sum("clashes")).first()[0]:
            return tuple(files.handed_out(made, "dictionary-files")), parts, seed
        seed += 1


def _dictionary_parts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        digests, idf = table["digest"].to_numpy(), table["idf"].to_numpy()
        of = np.mod(digests, parts)
        for part in np.unique(of):
            own = of == part
            blob = files.packed(np.array([part]), digests[own], idf[own])
            clashes = int((np.diff(digests[own]) == 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([clashes])], ["blob", "clashes"])

    return run


def unit_rows(counted: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(key, terms, weights, length): count times idf of each term, scaled to length one. Every term has to be in ``terms``.

    The idf is looked up inside the row: postings are neither exploded nor shuffled, whatever the size of the vocabulary. Rows
    without a term are left out.
    """
    names, parts, seed = dictionary(terms)

    @F.arrow_udf("struct<weights: array<double>, length: double>")
    def weigh(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held = {int(b[0].view(np.int64)[0]): (b[1].view(np.int64), b[2].view(np.float64)) for name in names for b in files.mapped(name)}
        for digests, counts in batches:
            made = [weighed(*part, held) for part in zip(_cut(digests, WEIGHED), _cut(counts, WEIGHED))]
            yield pa.concat_arrays(made) if made else weighed(digests, counts, held)

    def weighed(digests: pa.Array, counts: pa.Array, held: dict) -> pa.Array:
        encoded = digests.flatten().dictionary_encode()
        wanted = encoded.dictionary.to_numpy()
        of, found = np.mod(wanted, parts).astype(np.int32), np.empty(len(wanted))
        for part, (known, idf) in held.items():
            own = np.flatnonzero(of == part)
            found[own] = idf[np.searchsorted(known, wanted[own])]
        weights = counts.flatten().to_numpy() * found[encoded.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.list_value_length(digests).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        length = np.sqrt(np.bincount(row, weights * weights, minlength=len(sizes)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(weights / length[row]))
        return pa.StructArray.from_arrays([lists, pa.array(length)], ["weights", "length"])

    full = counted.filter(F.size("counts") > 0)
    digests = F.transform("counts.term", lambda term: F.xxhash64(F.lit(seed), term))
    made = full.select(key, F.col("counts.term").alias("terms"), weigh(digests, F.col("counts.n")).alias("unit"))
    return made.select(key, "terms", "unit.weights", "unit.length")


def _indexed(counted: DataFrame, frequency: DataFrame, n_documents: int, stop_words: Sequence[str], at) -> KeywordIndex:
    terms = storage.save(with_idf(frequency, n_documents), "terms", at("terms"))
    documents = storage.save(unit_rows(counted, "doc_id", terms), "documents", at("documents"))
    first = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    return KeywordIndex(documents, storage.save(first, "sample", at("sample")), terms, n_documents, tuple(stop_words))


def build(
    corpus: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, location: str | None = None, progress: Progress | None = None
) -> KeywordIndex:
    """Index a corpus (doc_id, text) and write the index; at a ``location`` it can be opened and added to.

    The texts are not shuffled. One shuffle counts the documents per term, with
    map-side sums; weights are made inside the row. ``progress`` counts documents and postings.
    """
    spark = corpus.sparkSession
    if location and _versions(spark, location):
        raise FileExistsError(f"there is an index at {location}")
    return _extended(spark, corpus, tuple(stop_words), location, None, progress)


def add(corpus: DataFrame, location: str, progress: Progress | None = None) -> KeywordIndex:
    """Index more documents (doc_id, text) into the index at ``location``; their ids have to be new.

    Only their texts are read. Frequencies are added up by term, and the weights of all documents follow from the written counts, in one pass without a
    shuffle. A new version of the index begins with its manifest; open indexes go on reading theirs.
    """
    spark = corpus.sparkSession
    manifest = _manifest(spark, location)
    return _extended(spark, corpus, tuple(manifest["stop_words"]), location, manifest, progress)


def _extended(
    spark: SparkSession, corpus: DataFrame, stop_words: tuple[str, ...], location: str | None, manifest: dict | None, progress: Progress | None
) -> KeywordIndex:
    segment, version = uuid.uuid4().hex, (manifest["version"] if manifest else 0) + 1
    of_segment = f"{location}/segments/{segment}" if location else None
    counts = term_counts(corpus, "doc_id", "text", stop_words)
    counted = storage.save(watched(progress, counts, "index", postings=F.sum(F.size("counts"))), "term-counts", of_segment)
    segments, n_documents, frequency = [segment], counted.count(), term_frequency(counted)
    if manifest:
        earlier = reduce(DataFrame.unionByName, (spark.read.parquet(f"{location}/segments/{s}") for s in manifest["segments"]))
        if not counted.join(earlier.select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("documents of these ids are in the index")
        known = spark.read.parquet(f"{location}/{manifest['tables']}/terms").select("term", "df")
        frequency = frequency.unionByName(known).groupBy("term").agg(F.sum("df").alias("df"))
        segments, n_documents, counted = [*manifest["segments"], segment], n_documents + manifest["n_documents"], earlier.unionByName(counted)
    tables = f"versions/{version}-{segment}"
    index = _indexed(counted, frequency, n_documents, stop_words, lambda name: f"{location}/{tables}/{name}" if location else None)
    if location:
        made = {"version": version, "segments": segments, "tables": tables, "n_documents": n_documents, "stop_words": stop_words}
        storage.commit(spark, f"{location}/manifests/{version:08d}.json", json.dumps(made))
    return index


def _versions(spark: SparkSession, location: str) -> list[int]:
    return [int(name.removesuffix(".json")) for name in storage.file_names(spark, f"{location}/manifests")]


def _manifest(spark: SparkSession, location: str, version: int | None = None) -> dict:
    versions = _versions(spark, location)
    if not versions or version not in (None, *versions):
        raise FileNotFoundError(f"no index at {location}, or not this version")
    path = f"{location}/manifests/{version or max(versions):08d}.json"
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def open_index(spark: SparkSession, location: str, version: int | None = None) -> KeywordIndex:
    """The index at ``location`` as its last manifest names it, or that of an earlier ``version``. Nothing is computed."""
    manifest = _manifest(spark, location, version)
    documents, sample, terms = (spark.read.parquet(f"{location}/{manifest['tables']}/{name}") for name in ("documents", "sample", "terms"))
    return KeywordIndex(documents, sample, terms, manifest["n_documents"], tuple(manifest["stop_words"]))


def query_vectors(queries: DataFrame, index: KeywordIndex) -> DataFrame:
    """Unit TF-IDF rows of (qid, text) in the corpus vocabulary, written.

    The vocabulary is scanned past the query terms, which are broadcast if they
    are few enough; it is never broadcast or sorted for them.
    """
    counted = storage.save(term_counts(queries, "qid", "text", index.stop_words), "query-terms")
    size = counted.agg(F.sum(F.size("counts"))).first()[0] or 0
    postings = counted.select("qid", F.inline("counts"))
    if size <= QUERY_TERMS_PER_BLOCK:
        postings = F.broadcast(postings)
    pair = F.struct("term", (F.col("n") * F.col("idf")).alias("weight"))
    known = index.terms.select("term", "idf").join(postings, "term").groupBy("qid").agg(F.collect_list(pair).alias("pairs"))
    length = F.sqrt(F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p.weight * p.weight))
    weights = F.transform("pairs", lambda p: p.weight / F.col("length"))
    rows = known.withColumn("length", length).select("qid", F.col("pairs.term").alias("terms"), weights.alias("weights"))
    return storage.save(rows, "query-vectors")


def nearest(
    queries: DataFrame,
    index: KeywordIndex,
    depth: int,
    digits: int = 6,
    block_terms: int = SEARCHED_TERMS,
) -> DataFrame:
    """The ``depth`` best documents per query by TF-IDF cosine, among those sharing a term.

    Returns (qid, doc_id, score, raw_rank). The index is read, and turned round, once for each block of queries, so blocks are large.
    """
    vectors = query_vectors(queries, index)
    size, n_queries = vectors.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count("*")).first()

    def search(block: DataFrame) -> DataFrame:
        table = block.toArrow().combine_chunks()
        if not table.num_rows:
            return block.sparkSession.createDataFrame([], blocks.HITS)
        asked, context = QueryBlock(table), block.sparkSession.sparkContext

        def scored(documents: DataFrame, floor: np.ndarray | None) -> DataFrame:
            shared = context.broadcast((asked, floor))
            return documents.select("doc_id", "terms", "weights").mapInArrow(_scorer(shared, depth, digits), blocks.HITS)

        first = ranking.top(scored(index.sample, None), depth)
        return scored(index.documents, blocks.floors(first, asked.qids, depth))

    hits = blocks.scored_in_blocks(blocks.query_blocks(vectors, size, block_terms, -(-n_queries // QUERY_BLOCKS)), search, "keyword-hits")
    return ranking.top(hits, depth)


class QueryBlock:
    """Query rows: ``codes`` and ``weights`` of the terms of query i are those from ``starts[i]`` on; ``vocabulary`` has the terms by code."""

    def __init__(self, table: pa.Table):
        terms = table["terms"].combine_chunks()
        encoded = terms.flatten().dictionary_encode()
        self.qids = table["qid"].to_numpy()
        self.vocabulary = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.weights = table["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
        self.frequency = np.bincount(self.codes, minlength=len(self.vocabulary))


class Postings:
    """A block of documents, turned round by term, for the terms of a query block, with the largest weight of each term.

    ``scored`` counts the pairs of a query and a document whose whole score was worked out.
    """

    def __init__(self, part: pa.RecordBatch, asked: QueryBlock):
        part = coded(part, asked)
        self.doc_ids, self.asked, self.scored = part.column("doc_id").to_numpy(zero_copy_only=False), asked, 0
        terms = part.column("terms")
        self.keys = np.repeat(np.arange(len(self.doc_ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        self.keys += terms.flatten().to_numpy(zero_copy_only=False) * np.int64(len(self.doc_ids))
        order = np.argsort(self.keys)
        self.weights = part.column("weights").flatten().to_numpy(zero_copy_only=False)[order]
        self.keys = self.keys[order]
        del order
        self.starts = np.searchsorted(self.keys, np.arange(len(asked.vocabulary) + 1) * len(self.doc_ids))
        self.frequency = np.diff(self.starts)
        self.documents = self.keys - np.repeat(np.arange(len(asked.vocabulary)) * len(self.doc_ids), self.frequency)
        self.largest = np.zeros(len(asked.vocabulary))
        full = np.flatnonzero(self.frequency)
        if len(full):
            self.largest[full] = np.maximum.reduceat(self.weights, self.starts[full])
        pairs = self.frequency * asked.frequency
        dense = np.argsort(-pairs, kind="stable")[: min(DENSE_TERMS, DENSE_CELLS // max(1, len(self.doc_ids)))]
        dense = dense[pairs[dense] >= max(1, DENSE_SHARE * len(self.doc_ids) * len(asked.qids))]
        self.column = np.full(len(asked.vocabulary), -1)
        self.column[dense] = np.arange(len(dense))
        self.exact = np.zeros((len(dense), len(self.doc_ids)))
        for row, code in enumerate(dense.tolist()):
            own = slice(self.starts[code], self.starts[code + 1])
            self.exact[row, self.documents[own]] = self.weights[own]
        self.matrix = self.exact.astype(np.float32)

    def search(self, best: blocks.BestPerQuery) -> None:
        """Offer ``best`` all documents whose score can reach the floor of a query.

        A query without a floor has all its postings added up. One with a floor has the terms of very many pairs multiplied as a matrix in single
        precision, and adds the postings of its other terms; for the documents that come near its floor the terms of the matrix are looked
        up and added in double precision too. Queries are taken together, about ``CELLS`` pairs and postings at a time.
        """
        asked, starts = self.asked, self.asked.starts
        most = np.add.reduceat(asked.weights * self.largest[asked.codes], starts[:-1])
        floored = best.floor - 10.0**-best.digits > 0
        wanted = (most > 0) & (most >= best.floor - 10.0**-best.digits)
        added = self.frequency[asked.codes]
        for part in self._steps(np.flatnonzero(wanted & ~floored), np.add.reduceat(added, starts[:-1])):
            self._search(part, best, None)
        added = np.add.reduceat(added * (self.column[asked.codes] < 0), starts[:-1])
        own = np.flatnonzero(wanted & floored)
        rows = max(1, PRODUCTS // max(1, len(self.doc_ids)))
        for low in range(0, len(own), rows):
            queries, at = own[low : low + rows], 0
            products = self._multiplied(queries)
            for part in self._steps(queries, added):
                self._search(part, best, products[at : at + len(part)])
                at += len(part)

    def _steps(self, queries: np.ndarray, added: np.ndarray) -> Iterator[np.ndarray]:
        """The queries in parts of about ``CELLS`` pairs and postings; ``added`` has how many postings of each query are added up."""
        if len(queries):
            cost = len(self.doc_ids) + added[queries]
            yield from np.split(queries, np.flatnonzero(np.diff(np.cumsum(cost) // CELLS)) + 1)

    def _terms(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, code and weight of the terms of these queries."""
        sizes = self.asked.starts[queries + 1] - self.asked.starts[queries]
        place = _ranges(self.asked.starts[queries], sizes)
        return np.repeat(np.arange(len(queries)), sizes), self.asked.codes[place], self.asked.weights[place]

    def _search(self, queries: np.ndarray, best: blocks.BestPerQuery, products: np.ndarray | None) -> None:
        """``products``: what the terms of the matrix add, to be overwritten; without them all postings are added up."""
        n, edge = len(self.doc_ids), 10.0**-best.digits
        row, codes, weights = self._terms(queries)
        held = self.column[codes] >= 0 if products is not None else np.zeros(len(codes), bool)
        score = self._added(row[~held], codes[~held], weights[~held], len(queries))
        if products is None:
            near, slack = score, np.zeros(len(queries))
            cell = np.flatnonzero(score > 0)
            self.scored += len(cell)
        else:
            # a query whose id is given twice has each term as often, and is longer than one
            slack = SLACK * np.maximum(1.0, np.bincount(row, weights))
            near = products.reshape(-1)
            np.add(near, score, out=near, casting="same_kind")
            least = (best.floor[queries] - edge - slack).astype(np.float32)
            cell = np.flatnonzero(products >= least[:, None])
        cell = self._nearest(cell, near, slack, best)
        of, document = np.divmod(cell, n)
        score = score[cell]
        if products is not None:
            self.scored += len(cell)
            score += self._looked_up(of, document, row[held], codes[held], weights[held], len(queries))
        self._offer(best, queries, of, document, score)

    def _nearest(self, cell: np.ndarray, near: np.ndarray, slack: np.ndarray, best: blocks.BestPerQuery) -> np.ndarray:
        """The cells without those that are not among the best of their query here, if it has very many."""
        ends = np.searchsorted(cell, np.arange(len(slack) + 1) * len(self.doc_ids))
        many = np.flatnonzero(np.diff(ends) > NEAR * best.depth)
        if not len(many):
            return cell
        kept = np.ones(len(cell), bool)
        for q in many.tolist():
            own = near[cell[ends[q] : ends[q + 1]]]
            last = np.partition(own, len(own) - best.depth)[len(own) - best.depth]
            kept[ends[q] : ends[q + 1]] = own >= last - 10.0**-best.digits - 2 * slack[q]
        return cell[kept]

    def _multiplied(self, queries: np.ndarray) -> np.ndarray:
        """What the terms of the matrix add to the scores, a row for each query."""
        row, codes, weights = self._terms(queries)
        held = self.column[codes] >= 0
        factors = np.zeros((len(queries), len(self.matrix)), np.float32)
        np.add.at(factors, (row[held], self.column[codes[held]]), weights[held])
        return factors @ self.matrix

    def _looked_up(self, of: np.ndarray, document: np.ndarray, row: np.ndarray, codes: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
        """What the terms of the matrix, of each query, add to the score of some documents, in double precision."""
        starts = np.searchsorted(row, np.arange(n_rows + 1))
        sizes = starts[of + 1] - starts[of]
        term, pair = _ranges(starts[of], sizes), np.repeat(np.arange(len(of)), sizes)
        return np.bincount(pair, self.exact[self.column[codes[term]], document[pair]] * weights[term], minlength=len(of))

    def _offer(self, best: blocks.BestPerQuery, queries: np.ndarray, of: np.ndarray, document: np.ndarray, score: np.ndarray) -> None:
        """Hand on what can be among the best; the last of the best here is a floor from now on."""
        score = np.round(score, best.digits)
        kept = (score >= best.floor[queries[of]]) & (score > 0)
        of, doc_ids, score = of[kept], self.doc_ids[document[kept]], score[kept]
        order = np.lexsort((doc_ids, -score, of))
        of, doc_ids, score = of[order], doc_ids[order], score[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        last = rank == best.depth - 1
        best.floor[queries[of[last]]] = np.maximum(best.floor[queries[of[last]]], score[last])
        kept = rank < best.depth
        if kept.any():
            best.add_pairs(queries[of[kept]], score[kept], doc_ids[kept])

    def _added(self, row: np.ndarray, codes: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
        """What these terms add to the scores, one cell per query and document."""
        first, last = self.starts[codes], self.starts[codes + 1]
        lists = [slice(low, high) for low, high in zip(first.tolist(), last.tolist()) if low < high]
        if not lists:
            return np.zeros(n_rows * len(self.doc_ids))
        cell = np.concatenate([self.documents[part] for part in lists])
        cell += np.repeat(row * len(self.doc_ids), last - first)
        added = np.concatenate([self.weights[part] for part in lists])
        added *= np.repeat(weights, last - first)
        return np.bincount(cell, added, minlength=n_rows * len(self.doc_ids))


def coded(batch: pa.RecordBatch, asked: QueryBlock) -> pa.RecordBatch:
    """The documents with the codes of their terms instead of the terms, where queries have these; codes stay as they are."""
    terms = batch.column("terms")
    if pa.types.is_integer(terms.type.value_type):
        return batch
    code = pc.index_in(terms.flatten(), value_set=asked.vocabulary)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
    offsets = pa.array(np.concatenate([[0], np.cumsum(known)])[ends], pa.int32())
    weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False)[known]
    lists = [pa.ListArray.from_arrays(offsets, values) for values in (code.drop_null(), pa.array(weights))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "terms", "weights"])


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` on, ``sizes`` of them, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def _scorer(shared, depth: int, digits: int):
    def score(batches):
        asked, floor = shared.value
        best = blocks.BestPerQuery(len(asked.qids), depth, digits, floor)
        pieces = (batch.slice(low, ROWS) for batch in batches for low in range(0, batch.num_rows, ROWS))
        for part in _blocks(coded(piece, asked) for piece in pieces):
            Postings(part, asked).search(best)
        yield from best.batches(asked.qids)

    return score


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents in blocks of about ``POSTINGS`` postings: what a query costs in each block weighs less in large ones."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, done + POSTINGS - size, side="right"))
            if stop <= at and held:
                yield _joined(held)
                held, size = [], 0
                continue
            stop = max(at + 1, stop)
            held.append(batch.slice(at, stop - at))
            size, at = size + ends[stop - 1] - done, stop
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
