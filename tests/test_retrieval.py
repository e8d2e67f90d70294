import dataclasses
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerloom import storage
from answerloom.functions.words import ENGLISH_STOP_WORDS
from answerloom.operators import blocks, dense, keyword, ranking
from answerloom.plans import retrieval
from tests.plans import physical_plan
from workload import retrieval_queries

RNG = np.random.default_rng(7)
WORDS = [f"w{i}" for i in range(40)]


def random_text(low, high):
    # Word i is drawn about 1/(i+1) as often as the first: a few very common terms.
    chances = 1 / np.arange(1, len(WORDS) + 1)
    return " ".join(RNG.choice(WORDS, RNG.integers(low, high), p=chances / chances.sum()))


DOCS = [(i, random_text(3, 30)) for i in range(120)]
# A third of all documents are copies of one.
DOCS += [(i, DOCS[5][1]) for i in range(120, 180)] + [(180, "the of"), (181, "")]
QUERIES = [(i, random_text(1, 6)) for i in range(25)] + [(90, "unknown"), (91, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return storage.save(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5), "docs")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid long, text string")


@pytest.fixture(scope="module")
def index(docs):
    return keyword.build(docs)


def tokens(text):
    return [t for t in re.findall(r"\w\w+", text.lower()) if t not in ENGLISH_STOP_WORDS]


def brute_force(depth):
    df = {}
    for _, text in DOCS:
        for term in set(tokens(text)):
            df[term] = df.get(term, 0) + 1
    idf = {t: math.log((1 + len(DOCS)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(text):
        weights = {}
        for t in tokens(text):
            if t in idf:
                weights[t] = weights.get(t, 0) + idf[t]
        length = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / length for t, w in weights.items()}

    documents = [(i, vector(text)) for i, text in DOCS]
    expected = []
    for qid, text in QUERIES:
        q = vector(text)
        scored = [(round(sum(w * d[t] for t, w in q.items() if t in d), 6), i) for i, d in documents if set(q) & set(d)]
        best = sorted(scored, key=lambda s: (-s[0], s[1]))[:depth]
        expected += [(qid, i, s, rank) for rank, (s, i) in enumerate(best, start=1)]
    return expected


def hits_of(df):
    return sorted((r.qid, r.doc_id, r.score, r.raw_rank) for r in df.collect())


@pytest.mark.parametrize("depth", [1, 10, 200])
def test_keyword_hits_equal_brute_force(queries, index, depth):
    assert hits_of(keyword.nearest(queries, index, depth)) == sorted(brute_force(depth))


def test_several_query_blocks_give_the_same(queries, index):
    assert hits_of(keyword.nearest(queries, index, 10, block_terms=20)) == sorted(brute_force(10))


def scored_here(queries, index, depth, floor=None, parts=None):
    """Hits of the scorer run in this process, and the pairs it scored whole."""
    asked = keyword.QueryBlock(keyword.query_vectors(queries, index).toArrow().combine_chunks())
    best = blocks.BestPerQuery(len(asked.qids), depth, 6, floor)
    table, scored = index.documents.select("doc_id", "terms", "weights").orderBy("doc_id").toArrow().combine_chunks(), 0
    for batch in table.to_batches(max_chunksize=parts):
        postings = keyword.Postings(batch, asked)
        postings.search(best)
        scored += postings.scored
    (found,) = best.batches(asked.qids)
    return {(r["qid"], r["doc_id"], r["score"]) for r in found.to_pylist()}, scored, asked


def scored_block(block, index, depth, floor):
    """Hits of a block of queries with these floors."""
    best = blocks.BestPerQuery(len(block.qids), depth, 6, floor)
    keyword.Postings(index.documents.select("doc_id", "terms", "weights").toArrow().combine_chunks().to_batches()[0], block).search(best)
    (found,) = best.batches(block.qids)
    return {(r["qid"], r["doc_id"], r["score"]) for r in found.to_pylist()}


@pytest.mark.parametrize("parts", [None, 40, 1])
def test_small_blocks_of_documents_give_the_same(queries, index, parts):
    assert scored_here(queries, index, 10, parts=parts)[0] == {e[:3] for e in brute_force(10)}


def test_postings_are_cut_into_steps(queries, index, monkeypatch):
    shared = type("Shared", (), {"value": (scored_here(queries, index, 10)[2], None)})
    monkeypatch.setattr(keyword, "POSTINGS", 7)
    whole = index.documents.select("doc_id", "terms", "weights").toArrow().combine_chunks().to_batches()
    (found,) = keyword._scorer(shared, 10, 6)(iter(whole))
    assert {(r["qid"], r["doc_id"], r["score"]) for r in found.to_pylist()} == {e[:3] for e in brute_force(10)}


def test_documents_below_the_floor_are_not_scored(spark, monkeypatch):
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join([*rng.choice(common, 10), *(["rare"] * (i % 50 == 0))])) for i in range(3000)]
    built = keyword.build(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "rare c1 c2"), (2, "c3 rare rare")], "qid long, text string")
    whole, all_pairs, block = scored_here(asked, built, 5)
    floors = np.array([sorted(s for q, _, s in whole if q == qid)[0] for qid in block.qids.tolist()])
    pruned, few, _ = scored_here(asked, built, 5, floor=floors)
    assert pruned == whole and few <= 2 * 60 and all_pairs > 2 * 1500
    assert {h[:3] for h in hits_of(keyword.nearest(asked, built, 5))} == whole


@pytest.mark.parametrize("share", [0.3, 0.8, 1.0])
def test_only_the_best_of_a_block_are_handed_on(spark, monkeypatch, share):
    """Whatever the floor; ties at the end of a list come along."""
    built = keyword.build(spark.createDataFrame([(i, random_text(3, 20)) for i in range(900)], "doc_id long, text string"))
    asked = spark.createDataFrame([(i, random_text(2, 9)) for i in range(40)], "qid long, text string")
    whole, _, block = scored_here(asked, built, 5)
    floors = np.array([share * min(s for q, _, s in whole if q == qid) for qid in block.qids.tolist()])
    handed = []
    monkeypatch.setattr(blocks.BestPerQuery, "add_pairs", lambda self, q, s, d, add=blocks.BestPerQuery.add_pairs: handed.append((q, s)) or add(self, q, s, d))
    assert scored_block(block, built, 5, floors) == scored_block(block, built, 5, None) == whole
    for query, score in handed:
        for q in np.unique(query):
            own = np.sort(score[query == q])[::-1]
            assert (own[5:] >= own[4] - 2e-6).all()


def test_small_batches_are_searched_together(queries, index, monkeypatch):
    whole = index.documents.select("doc_id", "terms", "weights").toArrow().combine_chunks()
    n, sizes = sum(map(len, whole["terms"].to_pylist())), []
    monkeypatch.setattr(keyword, "POSTINGS", n // 3)
    for part in keyword._blocks(iter(whole.to_batches(max_chunksize=4))):
        sizes.append((part.num_rows, sum(map(len, part["terms"].to_pylist()))))
    assert len(sizes) <= 5 and sum(rows for rows, _ in sizes) == whole.num_rows and max(size for _, size in sizes) <= n // 3
    shared = type("Shared", (), {"value": (scored_here(queries, index, 10)[2], None)})
    (found,) = keyword._scorer(shared, 10, 6)(iter(whole.to_batches(max_chunksize=4)))
    assert {(r["qid"], r["doc_id"], r["score"]) for r in found.to_pylist()} == {e[:3] for e in brute_force(10)}


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_terms_that_a_query_has_twice_count_twice(queries, index, monkeypatch, share):
    monkeypatch.setattr(keyword, "DENSE_SHARE", share)
    twice = queries.filter("qid < 8").unionByName(queries.filter("qid < 4"))
    whole, _, block = scored_here(twice, index, 10)
    assert any(len(set(own)) < len(own) for own in np.split(block.codes, block.starts[1:-1]))
    floors = np.array([min(s for q, _, s in whole if q == qid) for qid in block.qids.tolist()])
    assert scored_block(block, index, 10, floors) == whole


@pytest.mark.parametrize("share", [0.0, 0.05, 2.0])
def test_terms_as_matrix_or_postings_give_the_same(queries, index, monkeypatch, share):
    monkeypatch.setattr(keyword, "DENSE_SHARE", share)
    whole, _, block = scored_here(queries, index, 10)
    floors = np.array([min((s for q, _, s in whole if q == qid), default=0.0) for qid in block.qids.tolist()])
    floors[0] = -np.inf
    assert scored_block(block, index, 10, floors) == whole == {e[:3] for e in brute_force(10)}


@pytest.mark.parametrize("floored", [False, True])
def test_queries_are_scored_together(queries, index, monkeypatch, floored):
    """What a step costs besides its pairs does not come for each query."""
    whole, _, block = scored_here(queries, index, 3)
    floors = np.array([min((s for q, _, s in whole if q == qid), default=0.0) for qid in block.qids.tolist()]) if floored else None
    calls, added = [], keyword.Postings._added
    monkeypatch.setattr(keyword.Postings, "_added", lambda *args: calls.append(1) or added(*args))
    assert scored_block(block, index, 3, floors) == whole and len(calls) <= 2 < len(block.qids)


@pytest.mark.parametrize("cells", [1, 300])
def test_small_steps_give_the_same(queries, index, monkeypatch, cells):
    monkeypatch.setattr(keyword, "CELLS", cells)
    monkeypatch.setattr(keyword, "DENSE_CELLS", 200)
    monkeypatch.setattr(keyword, "NEAR", 0)
    whole, _, block = scored_here(queries, index, 10)
    floors = np.array([min((s for q, _, s in whole if q == qid), default=0.0) for qid in block.qids.tolist()])
    assert scored_block(block, index, 10, floors) == whole == {e[:3] for e in brute_force(10)}


def test_words_of_documents_are_not_held(queries, index, monkeypatch):
    """A block has numbers of the terms that queries have, and no others."""
    asked, parts, cut = scored_here(queries, index, 10)[2], [], keyword._blocks
    monkeypatch.setattr(keyword, "_blocks", lambda batches: (parts.append(b) or b for b in cut(batches)))
    shared = type("Shared", (), {"value": (asked, None)})
    (found,) = keyword._scorer(shared, 10, 6)(iter(index.documents.select("doc_id", "terms", "weights").toArrow().to_batches()))
    assert {(r["qid"], r["doc_id"], r["score"]) for r in found.to_pylist()} == {e[:3] for e in brute_force(10)}
    assert all(pa.types.is_integer(b["terms"].type.value_type) and b["terms"].null_count == 0 for b in parts)


def test_weights_of_some_postings_at_a_time(spark, index, monkeypatch):
    """Pieces of a batch, and a dictionary in parts, give the same weights."""
    monkeypatch.setattr(keyword, "WEIGHED", 5)
    monkeypatch.setattr(keyword, "DICTIONARY_TERMS", 7)
    counts = index.documents.select("doc_id", F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(2).alias("n"))).alias("counts"))
    again = keyword.unit_rows(counts.coalesce(1), "doc_id", index.terms)
    idf = {r.term: r.idf for r in index.terms.collect()}
    rows = again.collect()
    assert len(rows) == index.documents.count()
    for r in rows:
        raw = [2 * idf[t] for t in r.terms]
        length = math.sqrt(sum(w * w for w in raw))
        assert r.length == pytest.approx(length) and r.weights == pytest.approx([w / length for w in raw])


def test_rows_sent_do_not_grow_with_tasks(spark, monkeypatch):
    rows = [(i, random_text(5, 30)) for i in range(4000)]
    built = keyword.build(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = spark.createDataFrame([(i, random_text(2, 6)) for i in range(20)], "qid long, text string")
    sent = {}
    monkeypatch.setattr(ranking, "top", lambda hits, depth, top=ranking.top: sent.update({"hits": hits}) or top(hits, depth))
    for tasks in (64, 160):
        spread = dataclasses.replace(built, documents=storage.save(built.documents.repartition(tasks), "spread"))
        keyword.nearest(asked, spread, 5)
        sent[tasks] = sent["hits"].count()
    assert sent[64] < 64 * 20 * 5 / 4 and sent[160] <= 1.3 * sent[64]


@pytest.mark.parametrize("merge_rows", [1, 50, 1 << 18])
def test_best_lists_do_not_depend_on_merges(monkeypatch, merge_rows):
    monkeypatch.setattr(blocks, "MERGE_ROWS", merge_rows)
    rng = np.random.default_rng(3)
    scores = np.round(rng.random((30, 400)), 2)
    best = blocks.BestPerQuery(30, 7, 6)
    for at in range(0, 400, 9):
        best.add(scores[:, at : at + 9], np.arange(at, min(at + 9, 400)), positive_only=True)
    (found,) = best.batches(np.arange(30))
    got = sorted((r["qid"], r["doc_id"], r["score"]) for r in found.to_pylist())
    want = [(q, d, scores[q, d]) for q in range(30) for d in sorted(range(400), key=lambda d: (-scores[q, d], d))[:7]]
    assert got == sorted(want)


def test_many_queries_are_cut_into_blocks(queries, index, monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES_PER_BLOCK", 5)
    assert hits_of(keyword.nearest(queries, index, 10)) == sorted(brute_force(10))


def test_the_index_is_read_once_for_very_many_queries(spark, index, monkeypatch):
    asked, n = spark.range(60_000).select(F.col("id").alias("qid"), F.concat(F.lit("w3 w1"), (F.col("id") % 4).cast("string")).alias("text")), []
    monkeypatch.setattr(blocks, "scored_in_blocks", lambda parts, *rest, own=blocks.scored_in_blocks: n.append(len(parts)) or own(parts, *rest))
    found = storage.save(keyword.nearest(asked, index, 2), "found")
    assert n == [1]
    few = hits_of(keyword.nearest(asked.filter("qid < 4"), index, 2))
    assert few and hits_of(found.filter("qid < 4")) == few
    same = found.groupBy(F.col("qid") % 4, "doc_id", "score", "raw_rank").count()
    assert same.count() == len(few) and {r[0] for r in same.select("count").distinct().collect()} == {15_000}


def test_products_are_made_for_some_queries_at_a_time(queries, index, monkeypatch):
    """Never more than about ``PRODUCTS`` of them, whatever the number of queries; steps within give the same."""
    monkeypatch.setattr(keyword, "DENSE_SHARE", 0.0)
    monkeypatch.setattr(keyword, "PRODUCTS", 4 * len(DOCS))
    monkeypatch.setattr(keyword, "CELLS", 3 * len(DOCS))
    made, product = [], keyword.Postings._multiplied
    monkeypatch.setattr(keyword.Postings, "_multiplied", lambda *args: made.append(product(*args)) or made[-1])
    whole, _, block = scored_here(queries, index, 10)
    floors = np.array([min((s for q, _, s in whole if q == qid), default=0.0) for qid in block.qids.tolist()])
    assert scored_block(block, index, 10, floors) == whole == {e[:3] for e in brute_force(10)}
    assert len(made) > 3 and max(m.size for m in made) <= 4 * len(DOCS)


def weights_of(ix):
    rows = ix.documents.select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("w")).collect()
    return {(r.doc_id, r.w.terms): round(r.w.weights, 9) for r in rows}


def test_dictionary_in_parts_gives_the_same_weights(docs, index, monkeypatch):
    monkeypatch.setattr(keyword, "DICTIONARY_TERMS", 3)
    assert weights_of(keyword.build(docs)) == weights_of(index)


def test_digests_of_terms_never_clash(spark, index, monkeypatch):
    monkeypatch.setattr(keyword.F, "xxhash64", lambda seed, term, own=F.xxhash64: own(seed, term) % 3 if seed is first else own(seed, term))
    first = F.lit(0)
    monkeypatch.setattr(keyword.F, "lit", lambda x, own=F.lit: first if x == 0 else own(x))
    assert keyword.dictionary(index.terms)[2] == 1


def test_terms_are_counted_some_tokens_at_a_time(spark, monkeypatch):
    """Rows without text or words, repeats and order: counted in batches of numbers, and each term is a row once for some documents."""
    monkeypatch.setattr(keyword, "COUNTED", 4)
    rows = [(1, "bb aa bb éé 東京 zz aa aa"), (2, None), (3, ""), (4, "the the"), (5, "aa the cc"), (6, "x"), (7, "\U00010400\U00010400 ﬀﬀ ＡＡ zz")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counted = keyword.term_counts(texts, "doc_id", "text", ("the",))
    found = {r.doc_id: [tuple(c) for c in r.counts] for r in counted.collect()}
    last = [("zz", 1), ("ﬀﬀ", 1), ("ａａ", 1), ("\U00010428\U00010428", 1)]
    assert found == {1: [("aa", 3), ("bb", 2), ("zz", 1), ("éé", 1), ("東京", 1)], 2: [], 3: [], 4: [], 5: [("aa", 1), ("cc", 1)], 6: [], 7: last}
    assert "sort_array" not in physical_plan(counted)
    frequency = keyword.term_frequency(counted)
    expected = {t: sum(t == c[0] for r in found.values() for c in r) for r in found.values() for t, _ in r}
    assert {r.term: r.df for r in frequency.collect()} == expected
    assert "Generate" not in physical_plan(frequency)


def test_weights_are_made_without_moving_postings(docs, index):
    counted = keyword.term_counts(docs, "doc_id", "text", ENGLISH_STOP_WORDS)
    plan = physical_plan(keyword.unit_rows(counted, "doc_id", index.terms))
    assert "Exchange" not in plan and "Generate" not in plan


def test_segments_equal_a_build_from_scratch(spark, docs, queries, tmp_path):
    place = str(tmp_path / "index")
    parts = [docs.filter(F.col("doc_id") % 3 == i) for i in range(3)]
    with pytest.raises(FileNotFoundError):
        keyword.open_index(spark, place)
    keyword.build(parts[0], location=place)
    first = hits_of(keyword.nearest(queries, keyword.open_index(spark, place), 10))
    keyword.add(parts[1], place)
    added = keyword.add(parts[2], place)
    opened = keyword.open_index(spark, place)
    assert weights_of(opened) == weights_of(added) == weights_of(keyword.build(docs))
    assert hits_of(keyword.nearest(queries, opened, 10)) == sorted(brute_force(10))
    assert hits_of(keyword.nearest(queries, keyword.open_index(spark, place, 1), 10)) == first != sorted(brute_force(10))
    with pytest.raises(ValueError):
        keyword.add(parts[1].limit(1), place)
    with pytest.raises(FileExistsError):
        keyword.build(docs, location=place)
    with pytest.raises(FileNotFoundError):
        keyword.open_index(spark, place, 9)
    assert opened.n_documents == len(DOCS) and storage.file_names(spark, f"{place}/manifests") == [f"{v:08d}.json" for v in (1, 2, 3)]


def test_a_build_that_broke_off_is_not_read(spark, docs, queries, tmp_path, monkeypatch):
    place = str(tmp_path / "index")
    keyword.build(docs.filter("doc_id < 50"), location=place)
    before = hits_of(keyword.nearest(queries, keyword.open_index(spark, place), 10))

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(storage, "commit", broken)
        with pytest.raises(RuntimeError):
            keyword.add(docs.filter("doc_id >= 50"), place)
    assert hits_of(keyword.nearest(queries, keyword.open_index(spark, place), 10)) == before
    keyword.add(docs.filter("doc_id >= 50"), place)
    assert hits_of(keyword.nearest(queries, keyword.open_index(spark, place), 10)) == sorted(brute_force(10))


def test_of_two_commits_one_fails(spark, tmp_path):
    path = f"file:{tmp_path}/manifests/1.json"
    storage.commit(spark, path, "one")
    with pytest.raises(FileExistsError):
        storage.commit(spark, path, "two")
    assert (tmp_path / "manifests" / "1.json").read_text() == "one" and storage.file_names(spark, f"{tmp_path}/manifests") == ["1.json"]


def test_empty_query_table(queries, index):
    assert keyword.nearest(queries.filter("qid = 90"), index, 5).count() == 0
    assert keyword.nearest(queries.filter("false"), index, 5).count() == 0


def test_documents_are_not_shuffled(queries, index):
    plan = physical_plan(keyword.nearest(queries, index, 10))
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


VECTORS = RNG.normal(size=(300, 8)).astype(np.float32)
VECTORS /= np.linalg.norm(VECTORS, axis=1, keepdims=True)
VECTORS[100:200] = VECTORS[3]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("block", [10_000, 300])
def test_vector_hits_equal_brute_force(vectors, block):
    asked = vectors.filter("doc_id < 200").withColumnRenamed("doc_id", "qid")
    scores = np.round(VECTORS[:200].astype(np.float64) @ VECTORS.astype(np.float64).T, 6)
    expected = []
    for qid in range(200):
        best = sorted(range(300), key=lambda i: (-scores[qid, i], i))[:10]
        expected += [(qid, i, scores[qid, i], rank) for rank, i in enumerate(best, start=1)]
    assert hits_of(dense.nearest(asked, vectors, 10, block_numbers=block)) == sorted(expected)


def test_small_blocks_of_vectors_need_no_more_jobs(vectors, monkeypatch):
    asked, cut = vectors.withColumnRenamed("doc_id", "qid"), []
    monkeypatch.setattr(blocks, "query_blocks", lambda *a, own=blocks.query_blocks: cut.append(own(*a)) or cut[-1])
    for block in (300, 10_000):
        dense.nearest(asked, vectors, 3, block_numbers=block)
    assert [len(c) for c in cut] == [1, 1]
    monkeypatch.setattr(dense, "QUERY_NUMBERS_PER_BLOCK", 300)
    several = hits_of(dense.nearest(asked, vectors, 3, block_numbers=100))
    assert len(cut[-1]) == 8 and several == hits_of(dense.nearest(asked, vectors, 3, block_numbers=10_000))


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e3, 1e200])
@pytest.mark.parametrize("rows", [1, 7, 64])
def test_vectors_met_in_single_precision_give_the_same(scale, rows):
    rng = np.random.default_rng(5)
    documents = rng.normal(size=(500, 6)) * scale
    documents[40:90], documents[200], queries = documents[3], 0, np.concatenate([documents[:30] / scale, np.zeros((1, 6))])
    lists = [documents[i : i + 90] for i in range(0, 500, 90)]
    batches = [pa.record_batch({"doc_id": np.arange(i * 90, i * 90 + len(d)), "embedding": pa.array(d.tolist(), pa.list_(pa.float64()))}) for i, d in enumerate(lists)]
    shared = type("Shared", (), {"value": (np.arange(31), queries)})
    (found,) = dense._scorer(shared, 5, 6, rows)(iter(batches))
    scores = np.round(np.einsum("qj,dj->qd", queries, documents), 6)
    want = {(q, d) for q in range(31) for d in sorted(range(500), key=lambda d: (-scores[q, d], d))[:5]}
    assert {(r["qid"], r["doc_id"]) for r in found.to_pylist()} == want


def test_finds_of_all_tasks_are_merged_before_they_are_written(vectors, monkeypatch):
    asked, written, save = vectors.withColumnRenamed("doc_id", "qid"), [], storage.save
    whole = hits_of(dense.nearest(asked, vectors.repartition(6), 3))
    monkeypatch.setattr(storage, "save", lambda df, name, *rest: written.append((name, save(df, name, *rest))) or written[-1][1])
    monkeypatch.setattr(dense, "QUERY_NUMBERS_PER_BLOCK", 300)
    assert hits_of(dense.nearest(asked, vectors.repartition(6), 3, block_numbers=100)) == whole
    sizes = [table.count() for name, table in written if name == "vector-hits"]
    assert len(sizes) > 1 and sum(sizes) == len(whole)


def test_documents_are_encoded_once_for_all_blocks_of_queries(spark, monkeypatch):
    corpora = []
    monkeypatch.setattr(dense, "nearest", lambda asked, corpus, *rest, own=dense.nearest: corpora.append(corpus) or own(asked, corpus, *rest))
    retrieval_queries.semantic_hits(spark, "/root/testdata/sf0.001")
    assert "md5" not in physical_plan(corpora[0])


@pytest.mark.parametrize("step", [1, 7])
def test_documents_by_small_steps_give_the_same(vectors, monkeypatch, step):
    held = vectors.toArrow().combine_chunks()
    matrix = np.array(held["embedding"].to_pylist(), np.float64)
    shared = type("Shared", (), {"value": (np.arange(40), matrix[:40])})
    (whole,) = dense._scorer(shared, 5, 6, 64)(iter(held.to_batches()))
    monkeypatch.setattr(dense, "DOCUMENTS_PER_STEP", step)
    (found,) = dense._scorer(shared, 5, 6, 11)(iter(held.to_batches(max_chunksize=50)))
    assert sorted(map(str, found.to_pylist())) == sorted(map(str, whole.to_pylist()))


@pytest.fixture(scope="module")
def grouped(spark):
    """Vectors around 25 centres, with some of other lengths, zeros and copies."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(25, 12))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.repeat(centres, 60, axis=0) + 0.05 * rng.normal(size=(1500, 12))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[::50] *= 1.5
    rows[7::500], rows[100:140] = 0, rows[100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(9000, None)], "doc_id long, embedding array<double>")
    return rows, storage.save(frame.repartition(6), "grouped")


def expected_vectors(asked, rows, depth):
    scores = np.round(asked @ rows.T, 6)
    best = [sorted(range(len(rows)), key=lambda i: (-scores[q, i], i))[:depth] for q in range(len(asked))]
    return sorted((q, i, scores[q, i], rank) for q, hits in enumerate(best) for rank, i in enumerate(hits, start=1))


@pytest.mark.parametrize("depth, n, block", [(1, None, 10**6), (10, None, 10**6), (100, 7, 500), (2000, 5, 10**6)])
def test_clusters_give_the_same_hits(grouped, depth, n, block):
    rows, frame = grouped
    asked = frame.filter("doc_id < 70 or doc_id > 8000").withColumnRenamed("doc_id", "qid")
    found = dense.nearest_in_clusters(asked, dense.clustered(frame, n), depth, block_numbers=block)
    assert hits_of(found) == expected_vectors(rows[:70], rows, depth)


def test_far_clusters_are_not_read(spark, grouped, monkeypatch):
    rows, frame = grouped
    made, read = dense.clustered(frame, 25), []
    monkeypatch.setattr(dense, "_scored", lambda *a, own=dense._scored: read.append(a[3]) or own(*a))
    asked = spark.createDataFrame([(0, rows[1].tolist()), (1, rows[2].tolist())], "qid long, embedding array<double>")
    found = dense.nearest_in_clusters(asked, made, 5)
    assert hits_of(found) == expected_vectors(rows[1:3], rows, 5)
    assert sum(int(wanted.sum()) for wanted in read) <= 2 * 4
    plan = physical_plan(dense._scored(made, np.arange(2), rows[1:3], read[0], None, 5, 6))
    assert "PartitionFilters: [" in plan and "cluster" in plan[plan.index("PartitionFilters") :][:200]
    members = {c: vs for c, vs in made.vectors.groupBy("cluster").agg(F.collect_list("embedding")).collect()}
    bounds = made.bounds(rows[:100])
    assert all((bounds[:, c] >= (rows[:100] @ np.array(vs).T).max(1) - 1e-9).all() for c, vs in members.items())


def test_clusters_of_nothing(spark, grouped):
    none = grouped[1].filter("doc_id > 8000")
    assert dense.nearest_in_clusters(grouped[1].withColumnRenamed("doc_id", "qid"), dense.clustered(none), 3).count() == 0
    assert dense.nearest_in_clusters(none.withColumnRenamed("doc_id", "qid"), dense.clustered(grouped[1], 3), 3).count() == 0


def test_missing_vectors_are_left_out(vectors):
    some = vectors.withColumn("embedding", F.when(F.col("doc_id") % 2 == 0, F.col("embedding")))
    found = dense.nearest(some.withColumnRenamed("doc_id", "qid"), some, 300).select("qid", "doc_id").distinct()
    assert found.count() == 150 * 150


def test_small_corpus_gives_short_lists(vectors):
    few = vectors.filter("doc_id < 3")
    assert dense.nearest(few.withColumnRenamed("doc_id", "qid"), few, 10).count() == 9


def test_encoder_model_runs_in_batches(spark):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(7)], "doc_id long, text string").repartition(2)

    def load():
        def model(batch):
            assert len(batch) <= 2
            return [[float(len(t)), 0.0] for t in batch]

        return model

    built = dense.build(texts, lambda df, key: dense.encoded(df, key, load, batch_size=2))
    assert {r.doc_id: r.embedding for r in built.collect()} == {0: [0.0, 0.0], **{i: [1.0, 0.0] for i in range(1, 7)}}


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, body string, tags string, answer string")


def test_boost_moves_only_fetched_hits(spark):
    hits = spark.createDataFrame(
        [(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3)], "qid long, doc_id long, score double, raw_rank int"
    )
    corpus = corpus_of(spark, [(10, "a", "", "c", "x"), (11, "b", "", "java|x", "y"), (12, "c", "", "javascript", None), (13, "d", "", "java", "z")])
    fetched = ranking.with_attributes(hits, corpus, 3).withColumn("keywords", F.array(F.lit("java")))
    ranked = ranking.boosted(fetched, 2, 5.0).orderBy("rank").collect()
    assert [(r.doc_id, r.rank, r.boosted) for r in ranked] == [(11, 0, 5.8), (12, 1, 5.7)]
    exact = ranking.boosted(fetched, 3, 5.0, "tag").orderBy("rank").collect()
    assert [r.doc_id for r in exact] == [11, 10, 12]


def test_both_ways_to_fetch_attributes_agree(spark, monkeypatch):
    hits = spark.createDataFrame(
        [(q, q % 7 if q % 3 else 0, 0.5, 1) for q in range(300)], "qid long, doc_id long, score double, raw_rank int"
    )
    corpus = corpus_of(spark, [(d, f"t{d}", "", "", "a") for d in range(20)]).select("doc_id", "title")
    columns = ["qid", "doc_id", "title"]
    small = sorted(ranking.with_attributes(hits, corpus, 300).select(columns).collect())
    assert sorted(ranking.with_attributes(hits, corpus, 300, 0).select(columns).collect()) == small
    assert len(small) == 300
    monkeypatch.setattr(ranking, "HITS_PER_COPY", 7)
    many = ranking.with_attributes(hits, corpus, 300, 0)
    assert sorted(many.select(columns).collect()) == small


def test_a_document_is_copied_only_for_many_hits(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HITS_PER_COPY", 50)
    hits = spark.createDataFrame([(q, 0 if q < 200 else q, 0.5, 1) for q in range(300)], "qid long, doc_id long, score double, raw_rank int")
    made, seen = [], storage.save
    monkeypatch.setattr(storage, "save", lambda df, name: made.append(seen(df, name)) or made[-1])
    ranking.with_attributes(hits, corpus_of(spark, [(d, "t", "", "", "") for d in range(400)]), 300, 0)
    assert {r.doc_id: r.more for r in made[0].collect()} == {0: 3, **{d: 0 for d in range(200, 300)}}


def test_fillers(spark):
    corpus = corpus_of(spark, [(d, "", "", "", "") for d in (3, 5, 7, 9)])
    hits = spark.createDataFrame([(1, 5, 0.4, 1)], "qid long, doc_id long, score double, raw_rank int")
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, text string")
    padded = ranking.with_fillers(hits, asked, corpus, 3).orderBy("qid", "raw_rank").collect()
    assert [(r.qid, r.doc_id, r.score, r.raw_rank) for r in padded] == [
        (1, 5, 0.4, 1), (1, 3, 0.0, 2), (1, 7, 0.0, 3), (2, 3, 0.0, 1), (2, 5, 0.0, 2), (2, 7, 0.0, 3),
    ]


def test_context_layout(spark):
    corpus = corpus_of(
        spark,
        [(1, "sort a list", "how", "python|list", "use sorted"), (2, "sort a list twice", "why", "c", None)],
    )
    asked = spark.createDataFrame([(1, "sort list"), (2, "nothing")], "qid long, text string")
    hits = retrieval.keyword_hits(asked, corpus, options=retrieval.RetrievalOptions(k=2), pad_zero=False)
    contexts = {r.qid: r.context for r in retrieval.contexts(hits, asked).collect()}
    assert contexts == {
        1: "0)\nQuestion: sort a list\nTags: python, list\nAnswer: use sorted\n\n"
        "1)\nQuestion: sort a list twice\nTags: c\nAnswer: \n",
        2: "",
    }


def test_corpus_of_posts(spark):
    qa = spark.createDataFrame(
        [(1, "t", "b", "x", 2, "a", 9)],
        "question_id long, question_title string, question_body string, question_tags string, "
        "answer_id long, answer_body string, answer_score int",
    )
    assert retrieval.corpus_of_posts(qa).first().asDict() == {
        "doc_id": 2, "title": "t", "body": "b", "tags": "x", "answer": "a",
    }
