"""Token alignment against a plain version that encodes whole texts, and the perfect hash."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import alignment, perfect_hash, queries
from tests.llm.test_operators import SF, rows_of

PATHS = (queries.BYTE_VOCABULARY, queries.VOCABULARY)
ODD = [None, "", " ", "\n", " a", "a ", "a  b", "a \n b\n  c  \n", "日本語日本語テキスト", "é à b", "a▁b", "\x00 x\x1c y\x1c\x1c z", "<|endoftext|> <s> </s> <0x41>", "don't  can't 's",
       " x   y　z ​ ͸", "🧿🧿 x🧿", "1234567 89,10 \t\t  z", "x" * 300, "ab cd " * 2000, "中" * 5000, "    indented\n\t  more", "ﬁ ﬀ é"]


def plain(texts):
    """Rows by the contract, from whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte = alignment._byte_of()
    cut = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        first = a.encode(whole.decode(), add_special_tokens=False).ids if text else []
        second = b.encode(text) if text else []
        of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in first]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in second]
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            cut.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        common, groups, i, j = set(ends_a) & set(ends_b), [], 0, 0
        for end in sorted(common):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((first[i:k], second[j:m]))
            i, j = k, m
        cut.append((len(first), len(second), groups))
    counts = collections.Counter((g[0][-1], g[1][-1]) for c in cut if c for g in c[2])
    best = collections.Counter()
    for (_, second), n in counts.items():
        best[second] = max(best[second], n)
    rows = []
    for c in cut:
        if c is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in c[2]]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in c[2])
        rows.append((c[0], c[1], len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_whole_texts(spark, monkeypatch, small):
    if small:  # many shards and parts, long texts in stretches
        monkeypatch.setattr(alignment, "SHARD", 500)
        monkeypatch.setattr(alignment, "FAN", 2)
    given = rows_of(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    texts = ODD + [r["text"] for r in given] + ODD[:9]
    want = plain(texts)
    assert want[ODD.index("a▁b")][0] == 0 and want[ODD.index("<|endoftext|> <s> </s> <0x41>")][0] > 5
    docs = spark.createDataFrame([(None if i == 3 else i, t, i, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_a int, pair int").repartition(12)
    got = rows_of(alignment.aligned(docs, *PATHS))
    assert sorted(tuple(r.values())[1:] for r in got) == sorted(want)
    assert {r["doc_id"]: tuple(r.values())[1:] for r in got} == {None if i == 3 else i: w for i, w in enumerate(want)}
    assert rows_of(alignment.aligned(docs.limit(0), *PATHS)) == []
    assert [tuple(r.values())[1:] for r in rows_of(alignment.aligned(docs.filter("text is null").limit(1), *PATHS))] == [(0, 0, 0, 0, 0, 0, "")]


def test_query_on_the_table(spark):
    given = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: tuple(r.values())[1:] for r in rows_of(queries.QUERIES["op13_alignment"](spark, SF))}
    assert got == dict(zip([r["doc_id"] for r in given], plain([r["text"] for r in given]), strict=True))


def test_long_texts_in_stretches(monkeypatch):
    text = "a b\n c  d \n\n e " * 300 + "中" * 4000 + " f g"
    whole = [u for units in alignment.unit_lists(text) for u in units]
    monkeypatch.setattr(alignment, "STRETCH", 100)
    parts = list(alignment.unit_lists(text))
    assert len(parts) > 20 and [u for units in parts for u in units] == whole and "".join(whole) == " " + text


def test_vectors_add_up_over_levels(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 64)
    monkeypatch.setattr(alignment, "FAN", 2)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 30_000), rng.integers(0, 30, 30_000)
    n = rng.integers(1, 1 << 40, 30_000)
    frame = spark.createDataFrame([(int(x) << 32 | int(y), int(m)) for x, y, m in zip(a, b, n, strict=True)], "pair bigint, n bigint").repartition(16)
    made = alignment.pair_counts(frame)
    want = collections.Counter()
    for x, y, m in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        want[x << 32 | y] += m
    keys = np.array([*want, 99 << 32, (1 << 40) + 5], np.int64)
    found = spark.createDataFrame([(int(k),) for k in keys], "pair bigint")

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.of(batch.column(0).to_numpy()))], ["pair", "n"])

    got = {r["pair"]: r["n"] for r in rows_of(found.mapInArrow(look, "pair bigint, n bigint"))}
    assert got == {**{k: 0 for k in keys.tolist()}, **want} and made.shards > 10
    best = {y: max(m for k, m in want.items() if k & 0xFFFFFFFF == y) for y in set(b.tolist())}
    assert dict(zip(*(x.tolist() for x in made.best), strict=True)) == best


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 1000, 100_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        made = perfect_hash.build(keys)
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        assert (made.keys[made.slots(keys)] == keys).all()
        assert (made.slots(np.setdiff1d(rng.integers(-(1 << 62), 1 << 62, 1000), keys)) == -1).all()
        assert len(made.bits) <= len(keys) / 8 + 64


def test_pairs_gather_once_for_a_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("html", F.lit("x"))
    plan = alignment.aligned(docs, *PATHS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "html" not in plan and "n_chars" not in plan
