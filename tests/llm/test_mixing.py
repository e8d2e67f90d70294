"""The mix against a plain version: targets, blocks, permutations and pieces, worked out one by one."""

import collections
import struct

import numpy as np
import pytest
import xxhash

from answerloom.llm import mixing
from tests.llm.test_operators import WORD, rows_of

KIND = "doc_id bigint, source string, text string"


def hashed(*values, seed=42):
    """Spark's xxhash64 of whole numbers of 64 bits, given as ints, of 32 bits, given as (int,), and of texts."""
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def permuted(x, n, salt):
    for r in range(1, mixing.ROUNDS + 1):
        other = (hashed((r,), salt) % n - x) % n
        chosen = hashed(max(x, other), (r,), salt)
        if chosen % 2 == 0:
            x = other
    return x


def plain(docs, seed=0):
    """(doc_id, source, size, source_size, target, taken, parts) of the rows, by the docstrings alone."""
    rows = [(i, s, len(WORD.findall(t or "")), hashed(i, t)) for i, s, t in docs]
    size = collections.Counter()
    for _, s, n, _ in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * size[s] + 1e-9}
        if not above:
            goal |= {s: left * weight[s] / total for s in open_}
            break
        goal |= {s: 2.0 * size[s] for s in above}
        left -= sum(goal[s] for s in above)
        open_ -= above
    length = {s: min(128, max(1, size[s] // 32)) for s in names}
    blocks = {s: -(-size[s] // length[s]) for s in names}
    count = {s: int(np.rint(goal[s] * blocks[s] / size[s])) if size[s] else 0 for s in names}
    words, buckets = collections.defaultdict(list), max(1, len(rows) // 2048)
    for place, (i, s, n, digest) in sorted(enumerate(rows), key=lambda r: (r[1][3] % buckets, r[1][0] is not None, r[1][0] or 0, r[1][3])):
        words[s] += [(place, w) for w in range(n)]
    total, first, parts = sum(count.values()), 0, collections.defaultdict(list)
    for number, s in enumerate(names):
        for index in range(count[s]):
            where = permuted(first + index, total, seed)
            salt = hashed(number, index // blocks[s], (seed,))
            block = permuted(index % blocks[s], blocks[s], salt)
            inside = collections.defaultdict(list)
            for place, w in words[s][block * length[s] : (block + 1) * length[s]]:
                inside[place].append(w)
            for place, ws in inside.items():
                parts[place].append((where // mixing.SHARD, where % mixing.SHARD, ws[0], len(ws)))
        first += count[s]
    return [(i, s, n, size[s], goal[s], sum(p[3] for p in parts[k]), sorted(parts[k])) for k, (i, s, n, _) in enumerate(rows)]


def made(df, **options):
    rows = rows_of(mixing.taken(df, **options))
    return [(*(r[c] for c in ("doc_id", "source", "size", "source_size", "target", "taken")), [tuple(p.values()) for p in r["parts"]]) for r in rows]


def key(row):
    return str(row)


def test_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    docs = [(i, str(rng.choice(["b", "a", "é", "Z"])), " ".join(["w"] * int(rng.integers(0, 40)))) for i in range(150)]
    docs += [(200, None, "x y z"), (201, "tiny", "x y"), (202, "none", ""), (203, "none", None), (None, "b", "no id"), (5, "b", docs[5][2] + " and more"), (300, "a", "long " * 9000)]
    got, want = made(spark.createDataFrame(docs, KIND).repartition(6)), plain(docs)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5:] == b[5:]


def test_words_of_a_slot_follow_one_another(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = made(docs)
    slots = collections.defaultdict(int)
    for r in rows:
        assert sum(p[3] for p in r[6]) == r[5] <= 2 * r[2] and all(0 <= p[2] and p[2] + p[3] <= r[2] for p in r[6])
        for shard, slot, _, n in r[6]:
            slots[shard, slot] += n
    assert max(slots.values()) <= mixing.BLOCK and len(slots) == max(s * mixing.SHARD + t for s, t in slots) + 1


@pytest.mark.parametrize("sizes", [(44, 130, 20, 400), (3, 2), (1,), (5000, 7, 300), (1, 1, 1, 1, 1, 1, 60)])
def test_small_sources_meet_their_targets(spark, sizes):
    docs = [(100 * k + i, f"s{k}", " ".join(["w"] * min(10, n - 10 * i))) for k, n in enumerate(sizes) for i in range(-(-n // 10))]
    got, goal = collections.Counter(), {}
    for r in made(spark.createDataFrame(docs, KIND)):
        got[r[1]] += r[5]
        goal[r[1]] = r[4]
    for s, t in goal.items():
        assert abs(got[s] - t) <= max(0.5, 0.03 * t), (s, got[s], t)


def test_many_sources(spark):
    docs = spark.range(10_050).selectExpr("id as doc_id", "concat('s', id) as source", "'a b c' as text")
    rows = rows_of(mixing.taken(docs))
    assert len(rows) == 10_050 and abs(sum(r["taken"] for r in rows) / sum(r["target"] for r in rows) - 1) < 0.15
    assert all(abs(r["taken"] - r["target"]) <= 0.5 for r in rows)


def test_counts_of_shards_are_drawn(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('s', id % 2) as source", "repeat('w ', 5000) as text")
    shards = collections.defaultdict(collections.Counter)
    for r in rows_of(mixing.taken(docs)):
        for p in r["parts"]:
            shards[p["shard"]][r["source"]] += p["n_words"]
    shares = [c["s0"] / sum(c.values()) for s, c in sorted(shards.items())[:-1]]
    assert len(shares) > 15 and len(set(shares)) > 10 and all(abs(s - 2 / 3) < 0.08 for s in shares)
