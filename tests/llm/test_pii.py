"""Disclosing terms against a plain version, planted ones, and how much ordinary text is left alone."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import pii
from tests.llm.test_operators import rows_of

TERM = re.compile(r"[^\W_]{3,}")
ENTITY = re.compile(r"zb@x\.org|tm@y\.net|\+49 30 1234567")


def told(rows):
    """The pairs of entity and term that the docstring of ``disclosing`` names."""
    texts = [(t or "") for _, t in rows]
    held = [set(ENTITY.findall(t)) for t in texts]
    words = [[w.lower() for w in TERM.findall(t)] for t in texts]
    n_term, n_entity = collections.Counter(w for ws in words for w in set(ws)), collections.Counter(e for es in held for e in es)
    rare = lambda n: sum(v < 2 ** (int(math.log2(n)) + 1) for v in n_term.values())
    both, around = collections.Counter(), collections.defaultdict(collections.Counter)
    for es, ws in zip(held, words, strict=True):
        for w in set(ws):
            i = ws.index(w)
            for e in es:
                both[e, w] += 1
                around[e, w, 0][tuple(ws[max(i - 3, 0) : i])] += 1
                around[e, w, 1][tuple(ws[i + 1 : i + 4])] += 1
    out, total = set(), len(rows)
    for (e, w), n in both.items():
        k = min(int(n * n / sum(c * c for c in around[e, w, side].values()) + 1e-9) for side in (0, 1))
        share = math.log(total * n / n_term[w] / n_entity[e]) / math.log(total / n_entity[e])
        factorial = k * math.log(k) - k + math.log(2 * math.pi * k) / 2 if k > 1 else 0
        chance = k * math.log(n_term[w] * n_entity[e] / total) - factorial + math.log(rare(n_term[w]))
        if share >= pii.DISCLOSURE and chance <= math.log(pii.BY_CHANCE):
            out.add((e, w))
    return out


def test_terms_against_a_plain_version(spark):
    rng = np.random.default_rng(8)
    common = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(20)]
    some = lambda n: " ".join(rng.choice(common, n))
    rows = [(i, some(60)) for i in range(150)]
    rows += [(1000, f"Zaphod {some(40)} zb@x.org {some(400)} ZAPHOD {some(3)}"), (1001, f"{some(9)} +49 30 1234567 {some(30)} Trillian"), (1002, f"{some(9)} +49 30 1234567 {some(40)} trillian")]
    rows += [(1003, f"{some(300)} zaphod {some(9)}"), (1004, None)]
    rows += [(1100 + i, f"{some(20)} Marvin {some(5)} tm@y.net {some(9)}") for i in range(12)] + [(1200 + i, f"{some(9)} marvin {some(9)}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in rows_of(pii.found_spans(docs))}
    pairs = told(rows)
    for i, text in rows:
        held = set(ENTITY.findall(text or ""))
        inside = [m.span() for m in ENTITY.finditer(text or "")]
        marked = [("term", *m.span()) for m in TERM.finditer(text or "") if any((e, m[0].lower()) in pairs for e in held) and not any(a < m.end() and m.start() < b for a, b in inside)]
        assert [s for s in found[i] if s[0] == "term"] == marked
    assert [rows[150][1][a:b] for k, a, b in found[1000] if k == "term"] == ["Zaphod", "ZAPHOD"]
    assert sum(k == "term" for k, _, _ in found[1001]) == sum(k == "term" for k, _, _ in found[1002]) == 1
    assert sum(k == "term" for i in range(12) for k, _, _ in found[1100 + i]) == 12 and not any(k == "term" for k, _, _ in found[1003])


def test_copies_are_no_evidence(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    one = [word() for _ in range(40)]
    rows = [(i, " ".join(word() for _ in range(40))) for i in range(300)]
    rows += [(1000 + i, " ".join([*one[:20], "zb@x.org", *one[20:39], word()])) for i in range(30)]
    found = rows_of(pii.found_spans(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert not any(s["kind"] == "term" for r in found for s in r["spans"])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ordinary_text_is_left_alone(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    made = pii.sanitised(docs).select("doc_id", F.col("text").alias("clean")).join(docs, "doc_id").filter("clean <> text")
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(pii.TERM), F.lit(0)))
    masked = F.size(F.split("clean", r"\[TERM\]")) - 1
    n, gone = made.agg(F.sum(words("text")), F.sum(masked)).first()
    print(sf, n, gone)
    assert gone / n < 0.05


def test_planted_names_in_given_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(10**6 + i, f"word{i} Zaphod beside{i} wrote zb@x.org here{i}") for i in range(5)]
    texts = {r["doc_id"]: r["text"] for r in rows_of(pii.sanitised(docs.union(spark.createDataFrame(rows, "doc_id bigint, text string")))) if r["doc_id"] >= 10**6}
    assert all("Zaphod" not in t and "[TERM]" in t and "[EMAIL]" in t and f"beside{i - 10**6}" in t for i, t in texts.items()) and len(texts) == 5


def test_a_directory_of_entities(spark):
    rng = np.random.default_rng(10)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    text = " ".join(w if i % 20 else f"u{i}@x{i}.org" for i, w in enumerate(rng.choice(vocabulary, 100_000)))
    rows = [(i, " ".join(rng.choice(vocabulary, 50))) for i in range(200)] + [(1000, text), (1001, text[: len(text) // 2])]
    found = {r["doc_id"]: r for r in rows_of(pii.found_spans(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    assert len(found[1000]["base"]) == 5000 and len(found) == 202
