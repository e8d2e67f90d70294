"""Spelling variants against a plain version that compares neighbourhoods, and the index letter by letter."""

import collections
import re
import zlib

import numpy as np
import pytest

from answerloom.llm import queries, spelling
from tests.llm.test_operators import SF, rows_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(u, v):
    """Whether one inserted, deleted or replaced code point makes one the other."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_words(rows, length=7, occurrences=2):
    found = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= occurrences}


def plain(rows, **limits):
    held = plain_words(rows, **limits)
    by_key = collections.defaultdict(list)
    for w in held:
        for i in range(len(w)):
            by_key[w[:i] + w[i + 1 :]].append(w)
        by_key[w].append(w)
    near = collections.defaultdict(set)
    for ws in by_key.values():
        for u in ws:
            near[u].update(v for v in ws if u != v and v not in near[u] and one_edit(u, v))
    form = {}
    for w, n in held.items():
        best = min(near[w], key=lambda v: (-held[v], v), default=None)
        form[w] = best if best and held[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), n, len(near[w]), held[form[w]] if form[w] else None) for w, n in held.items()}


def made(df, **limits):
    return {r["word"]: tuple(r.values()) for r in rows_of(spelling.variants(df, **limits))}


@pytest.mark.parametrize("meeting", [4096, 3])
def test_random_words(spark, monkeypatch, meeting):
    monkeypatch.setattr(spelling, "MEETING", meeting)
    monkeypatch.setattr(spelling, "STRETCH", 50)
    rng = np.random.default_rng(1)
    letters = np.array(list("abÀÿß"))
    base = ["".join(rng.choice(letters[:3], rng.integers(5, 10))) for _ in range(300)]
    base += ["w" * 40 + x for x in ("", "w", "x", "wx")] + ["Y" * 5000, "y" * 5001, "y" * 2500 + "z" + "y" * 2500]
    weights = rng.zipf(1.3, len(base)).clip(0, 400)
    texts = [" ".join(rng.choice(base, 60, p=weights / weights.sum())) + rng.choice([" ", "1", "_"]).join(base[-7:]) for _ in range(60)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (77, None), (78, ""), (79, "1 _ \n"), (80, "tttttttt " * 900 + "tttttttu " * 50 + "ttttttuu " * 4)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, word string")
    want = plain(rows, length=4, occurrences=2)
    assert sum(v[1] is not None for v in want.values()) > 20 and any(v[2] != (v[1] or v[0]) for v in want.values())
    assert made(df, length=4, occurrences=2) == want
    assert made(df.limit(0)) == made(df.filter("text is null")) == {}


def test_query_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))]
    got = {r["word"]: tuple(r.values()) for r in rows_of(queries.QUERIES["op11_spelling"](spark, SF))}
    want = plain(rows)
    assert got == want and len(want) > 1000


def test_index_finds_every_edit():
    rng = np.random.default_rng(2)
    held = sorted({"".join(rng.choice(list("abc"), rng.integers(4, 6))) for _ in range(150)})
    index = spelling.PositionIndex(held, 4)
    for word in held:
        near = {held[i] for i in range(len(held)) if index.near(word) >> i & 1}
        assert near == {v for v in held if one_edit(word, v) and min(len(word), len(v)) == 4}


def test_keys_of_many_words_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MEETING", 16)
    rng = np.random.default_rng(3)
    words = sorted({"constant" + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(900)})
    frame = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n bigint")
    got = collections.Counter()
    for r in rows_of(spelling.near(frame)):
        got[r["word"]] += r["n_near"]
    want = {u: sum(one_edit(u, v) for v in words) for u in words}
    assert got == {w: n for w, n in want.items() if n}


def test_forms_follow_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3"), ("y", "z")]
    got = {r["word"]: r["root"] for r in rows_of(spelling.roots(spark.createDataFrame(chain, "word string, form string")))}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "x": "w11", "y": "z"}
    assert rows_of(spelling.roots(spark.createDataFrame([], "word string, form string"))) == []
