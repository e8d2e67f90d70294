"""The operators against plain versions, and what they do with odd rows."""

import base64
import collections
import gzip
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerloom.llm import chats, components, fingerprints, jaccard_join, language, leaks, mixing, pii, queries, secrets, token_counts, toxicity
from answerloom.llm.batches import shingle_sets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int, leaks int, language int, found_email int"
LONG = "Lorem ipsum dolor sit amet " * 4000


def rows_of(df):
    return df.toArrow().to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty, blank and very long texts, repeated rows, clashing names."""
    texts = [(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (2, ""), (3, None), (None, "null id a b c d e"),
             (4, " \t\n"), (5, LONG), (6, LONG), (7, "12345 !!"), (8, "x"), (9, "mail a@b.co and +49 30 1234567 or 4111 1111 1111 1111")]
    data = [(i, t, None if i in (3, None) else "en", None if i == 4 else "s", None, 1, 2, 3, 4) for i, t in texts]
    return spark.createDataFrame(data, SCHEMA)


def applied(name, docs, spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (2, None), (3, "")], "item_id bigint, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), "text")
    return {
        "tokens": lambda: token_counts.token_counts(docs, queries.VOCABULARY),
        "leaks": lambda: leaks.marked(docs, bench),
        "toxicity": lambda: toxicity.judged(docs, toxicity.fit(docs, labels)),
        "mixing": lambda: mixing.taken(docs),
        "fingerprints": lambda: fingerprints.with_next(docs),
        "chats": lambda: chats.rendered(turns),
        "secrets": lambda: secrets.scanned(docs),
        "language": lambda: language.identified(docs, language.fit(docs)),
        "join": lambda: jaccard_join.near_duplicates(docs),
        "pii": lambda: pii.sanitised(docs),
    }[name]()


@pytest.mark.parametrize("name", ["tokens", "leaks", "toxicity", "mixing", "fingerprints", "chats", "secrets", "language", "join", "pii"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    assert len(rows_of(applied(name, odd, spark))) == (9 if name == "chats" else odd.count())
    assert rows_of(applied(name, odd.limit(0), spark)) == []


@pytest.mark.parametrize("number", range(5))
def test_stages_with_odd_rows(spark, odd, number, tmp_path):
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = corpus_pipeline.STAGES[number][1](spark, odd, str(tmp_path))
    assert len(rows_of(made)) > 0
    if number < 4:
        assert made.columns == odd.columns
    assert rows_of(corpus_pipeline.STAGES[number][1](spark, odd.limit(0), str(tmp_path))) == []


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    made = queries.QUERIES[name](spark, SF)
    wanted = db.sql(queries.SQL[name]).to_arrow_table().to_pylist()
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(rows_of(made), key=key) == sorted(wanted, key=key)


def test_longest_match(spark):
    initial, following = ["un", "a", "unaff", "b"], ["able", "aff", "a", "ff", "abl", "b", "c"]
    automaton = token_counts.build(initial, following)

    def plain(word):
        at, n = 0, 0
        while at < len(word):
            pieces = initial if at == 0 else following
            fits = [p for p in pieces if word.startswith(p, at)]
            if not fits:
                return -1
            at, n = at + len(max(fits, key=len)), n + 1
        return n

    rng = np.random.default_rng(1)
    words = ["unaffable", "unaffabl", "unaffab", "", "zz", *("".join(rng.choice(list("unafbelc"), rng.integers(1, 12))) for _ in range(3000))]
    assert [token_counts.pieces_of_word(automaton, w) for w in words] == [plain(w) for w in words]


def test_token_counts_agree_with_a_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    initial, following = token_counts.load_vocabulary(queries.VOCABULARY)
    names = ["[UNK]", *dict.fromkeys(initial), *(f"##{p}" for p in dict.fromkeys(following))]
    library = Tokenizer(models.WordPiece({n: i for i, n in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=10**6))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in rows_of(docs)}
    for r in rows_of(token_counts.token_counts(docs, queries.VOCABULARY)):
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]]).ids)


def test_token_counts_with_the_whole_vocabulary(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=queries.VOCABULARY)
    pieces = {model.id_to_piece(i) for i in range(3, model.get_piece_size()) if not model.is_byte(i)}
    longest = max(map(len, pieces))

    def plain(word):
        at, n, marked = 0, 0, "▁" + word
        while at < len(marked):
            fit = next((k for k in range(min(longest, len(marked) - at), 0, -1) if marked[at : at + k] in pieces), 0)
            at, n = at + max(fit, 1), n + (1 if fit else len(marked[at].encode()))
        return n

    assert (plain("2024"), plain("🧿")) == (5, 5)
    odd = ["2024", "🧿", "a🧿b", "🧿🧿2", "日本語日本語", "ñandú", "a▁b", "\x01", "ßß", "\u0378x", "", None, "2024 🧿 the"]
    texts = {-i: t for i, t in enumerate(odd, 1)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts |= {r["doc_id"]: r["text"] for r in rows_of(given)}
    made = rows_of(token_counts.piece_counts(docs.union(given), queries.VOCABULARY)) + rows_of(queries.QUERIES["op1_token_counts"](spark, SF))
    for r in made:
        words = WORD.findall(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(words), sum(map(plain, words)), 0)


def test_leaks_exact_edited_and_clean(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    item = [word() for _ in range(40)]
    edited = [word() if i % 6 == 3 else w for i, w in enumerate(item)]
    some = lambda n: [word() for _ in range(n)]
    docs = [(1, some(50) + item + some(30)), (2, some(300)), (3, some(20) + edited), (4, item[:12] + some(60)), *((i, some(5) + item) for i in range(10, 60))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in rows_of(leaks.pairs(df, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")))}
    assert set(got) == {1, 3, *range(10, 60)}
    assert (got[1]["score"], got[1]["start_word"], got[1]["end_word"]) == (1.0, 50, 90)


def test_alignment_is_that_of_the_plain_recursion():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 14))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (leaks.MATCH if x == y else leaks.MISMATCH), h[i, j + 1] + leaks.GAP, h[i + 1, j] + leaks.GAP)
        assert leaks.aligned(a, b)[0] == h.max()


def test_chain_is_that_of_the_plain_recursion():
    rng = np.random.default_rng(4)
    odds, first = rng.normal(0, 2, 500), rng.random(500) < 0.02
    first[0] = True
    trans, start = rng.random((2, 2)) + 0.1, rng.random(2) + 0.1
    got = toxicity.marginals(odds, first, trans, start)
    edges = [*np.flatnonzero(first), 500]
    for a, b in zip(edges, edges[1:], strict=False):
        psi = np.stack([np.ones(b - a), np.exp(odds[a:b])], 1)
        alpha, beta = [start * psi[0]], [np.ones(2)]
        for t in range(1, b - a):
            alpha.append((alpha[-1] @ trans) * psi[t])
            beta.append(trans @ (psi[b - a - t] * beta[-1]))
        both = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], both[:, 1] / both.sum(1))


def test_toxicity_learns_and_spares_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words[int(rng.integers(30))] = "Scoundrel"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, toxicity.learning_rows(labels))
    for r in rows_of(toxicity.judged(docs, model)):
        text, (score, spans) = r["text"], r["toxicity"].values()
        assert (score >= 0.5) == ("Scoundrel" in text)
        assert [text[s["start"] : s["end"]] for s in spans] == (["Scoundrel"] if "Scoundrel" in text else [])


def test_mixing_meets_targets_and_limits(spark):
    rows = rows_of(mixing.taken(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    again = rows_of(mixing.taken(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)))
    key = lambda r: r["doc_id"]
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    got, goal = collections.Counter(), {}
    for r in rows:
        got[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(got[s] - t) <= 0.05 * t for s, t in goal.items())
    assert sum(goal.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_permutation_is_one(spark):
    made = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000).cast("bigint"), F.lit(9)).alias("p"))
    assert sorted(r["p"] for r in rows_of(made)) == list(range(1000))


def test_edited_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in rows_of(docs))
    got = {r["doc_id"]: r for r in rows_of(fingerprints.with_next(docs))}
    for (i, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert fingerprints.likeness(fingerprints.sketch(LONG), fingerprints.sketch(LONG[:50_000])) == 1
    whole = fingerprints.read(fingerprints.written(fingerprints.sketch("ab" * 40)))
    assert whole.tolist() == fingerprints.sketch("ab" * 40).tolist()


def test_maximal_conversations(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 5, "user", "a"), (3, 9, "bot", "b"), (4, 0, "user", "b"), (5, 0, "user", "a"), (5, 1, "bot", "c")]
    turns += [(6, t, "user", str(t)) for t in range(3000)]
    made = rows_of(chats.rendered(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")))
    assert {r["conv_id"] for r in made} == {2, 4, 5, 6}
    assert "".join(r["text"] for r in sorted((r for r in made if r["conv_id"] == 6), key=lambda r: r["part"])).count("<|user|>") == 3000


def test_secrets_in_layers():
    inner = "password=hunter2secret"
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    twice = base64.b64encode(f"see {packed} here".encode()).decode()
    percent = "".join(f"%{b:02X}" for b in inner.encode())
    escaped = "".join(f"\\u{ord(c):04x}" for c in inner)
    for carrier in (packed, twice):
        _, spans = secrets.all_spans(f"été {carrier} end")
        assert ("assign", 4, 4 + len(carrier)) in spans
    assert secrets.all_spans(f"é {percent} x")[1] == [("assign", 2, 2 + len(percent))]
    assert secrets.all_spans(f"é {escaped} x")[1] == [("assign", 2, 2 + len(escaped))]
    assert secrets.all_spans("token='abc123' AKIA" + "B" * 16 + " " + "a" * 24)[0] == [("assign", 0, 13), ("access", 15, 35), ("hex", 36, 60)]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rows_of(language.identified(docs, language.fit(language.learning_rows(docs))))
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["language"]["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_join_with_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: 60 - int(k)] + [f"x{j}" for j in range(int(k))]) for j, k in enumerate(rng.integers(0, 14, 120))]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in rows_of(jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))}
    sets = {i: frozenset(zip(*[WORD.findall(t)[k:] for k in range(5)], strict=False)) for i, t in docs}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL", 10)
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    made = rows_of(components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(8)))
    assert {r["node"]: r["root"] for r in made} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_shingle_sets():
    hashes, of = shingle_sets(pa.array(["a b c d e f", None, "A B\tc D e", "a b", "", "b a"]))
    sets = [set(hashes[of == i].tolist()) for i in range(6)]
    assert [len(s) for s in sets] == [2, 0, 1, 1, 0, 1]
    assert sets[2] < sets[0] and sets[3] != sets[5]


def test_personal_data_and_telling_terms(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(200)]
    rows += [(1000 + i, f"{word()} {word()} Zaphod {word()} é zb@x.org {word()} {word()}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = {r["doc_id"]: r["text"] for r in rows_of(pii.sanitised(docs))}
    assert all(texts[i] == t for i, t in rows if i < 1000)
    assert all("[TERM]" in texts[1000 + i] and "[EMAIL]" in texts[1000 + i] and "Zaphod" not in texts[1000 + i] for i in range(5))
    one = spark.createDataFrame([(1, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1, 4111-1111 1111 1111 x +1 (555) 010-9999.")], "doc_id bigint, text string")
    spans = rows_of(pii.found_spans(one))[0]["base"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("email", 0, 5), ("email", 5, 11), ("ip", 12, 19), ("ip", 20, 27), ("card", 39, 58), ("phone", 61, 78)]


def test_secrets_in_wrapped_glued_large_and_dirty_layers(monkeypatch):
    inner = b"password=hunter2secret"
    noise = bytes(np.random.default_rng(9).integers(97, 123, 300, dtype=np.uint8))
    b64 = lambda data: base64.b64encode(data).decode()
    wrapped = base64.encodebytes(gzip.compress(noise + b" " + inner)).decode()
    assert ("assign", 4, 4 + len(wrapped.rstrip())) in secrets.all_spans(f"see\n{wrapped}")[1]
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1 << 18)
    large = gzip.compress(b"a b " * 200_000 + inner)
    carriers = ["https://x.com/d/" + b64(inner), "backup-" + b64(gzip.compress(inner)), b64(large), b64(gzip.compress(b"first") + gzip.compress(inner)), b64(b"\x00\xff " + inner)]
    carriers += ["".join(f"\\x{b:02x}" for b in gzip.compress(inner)), "".join(f"%{b:02X}" for b in gzip.compress(inner))]
    for carrier in carriers:
        assert "assign" in {s[0] for s in secrets.all_spans(f"x {carrier} y")[1]}, carrier[:40]
