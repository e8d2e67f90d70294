"""The filter for urls against a plain version, with odd urls, collisions and many stretches."""

import numpy as np
from pyspark.sql import functions as F

from answerloom import files
from answerloom.llm import queries, url_filters
from tests.llm.test_operators import rows_of

KIND = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, default)


def test_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "STRETCH", 40)
    rng = np.random.default_rng(1)
    some = lambda letters, n: "".join(rng.choice(list(letters), n))
    host = lambda: ".".join(some("abÄ", rng.integers(1, 3)) for _ in range(rng.integers(1, 5)))
    rules = {(host(), "/" + some("a/é", rng.integers(0, 4)) if rng.random() < 0.8 else ""): ["allow", "block"][rng.integers(2)] for _ in range(300)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = ["HTTP://" * int(rng.random() < 0.8) + host().upper() + rng.choice(["", "/", "?", "#", "/?", "/a/é#/a"]) + some("a/é?#", rng.integers(0, 9)) for _ in range(2000)]
    urls += [None, "", "://", "x://", "a://b.//", "a://.b/", "http://" + "a." * 50_000 + "b/" + "é" * 100_000, "a://b://c/", "a://\n.b/\n", urls[0]]
    made = spark.createDataFrame([(i if i else None, u, i, u) for i, u in enumerate(urls)], "page_id bigint, url string, filtered int, url_host string")
    judge = url_filters.build(spark.createDataFrame(rules, KIND))
    assert len(judge.names) > 3
    rows = rows_of(url_filters.judged(made, judge))
    assert {tuple(r["filtered_"].values()) for r in rows} >= {plain(u, rules) for u in urls}
    assert all(tuple(r["filtered_"].values()) == plain(r["url"], rules) for r in rows) and len(rows) == len(urls)
    assert rows_of(url_filters.judged(made.limit(0), judge)) == []


def test_rules_that_fit_nothing_and_twice(spark):
    rules = [("b", "", "allow"), ("b", "", "block"), ("B", "", "allow"), ("", "/", "block"), ("a", "b/", "block"), (None, "/", "block"), ("c", None, "block"), ("c", "/", None)]
    urls = spark.createDataFrame([("x://b",), ("x://ab/",), ("x:///",), ("x://c/",), ("x://a.b/",)], "url string")
    judge = url_filters.build(spark.createDataFrame(rules, KIND))
    assert [r["filtered"]["rule"] for r in rows_of(url_filters.judged(urls.coalesce(1), judge))] == ["b", None, None, None, "b"]
    assert {r["filtered"]["verdict"] for r in rows_of(url_filters.judged(urls.filter("url like '%b'"), judge))} == {"block"}
    none = url_filters.build(spark.createDataFrame([], KIND))
    assert {r["filtered"]["verdict"] for r in rows_of(url_filters.judged(urls, none, default="block"))} == {"block"}


def test_strings_confirm_digests():
    keys, digests = ["aa", "bb", "cc/é"], np.array([5, 5, 9], np.int64)
    ends = np.cumsum([len(k.encode()) for k in keys])
    blob = files.packed(digests, np.array([0, 1, 1], np.uint8), ends, np.frombuffer("".join(keys).encode(), np.uint8))
    parts = np.frombuffer(blob, np.uint8)
    lengths = parts[8:40].view(np.int64)
    starts = 40 + np.cumsum([0, *(n + -n % 8 for n in lengths[:-1])])
    held = url_filters.Stretches([[parts[a : a + n] for a, n in zip(starts, lengths, strict=True)]])
    assert held.found(["aa", "bb", "cc/é", "xx", "yy"], np.array([5, 5, 9, 5, 7])).tolist() == [0, 1, 1, -1, -1]


def test_digests_are_those_of_spark(spark):
    keys = ["", "net/", "é" * 40, "a" * 1000, "日本/"]
    made = spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k").alias("d"))
    assert url_filters.digests(keys).tolist() == [r["d"] for r in rows_of(made)]


def test_query_sends_no_rows_around(spark):
    plan = queries.QUERIES["op12_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "html" not in plan
