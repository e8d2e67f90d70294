"""The registered queries of this subpackage, and SQL to check them with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import alignment, chats, fingerprints, jaccard_join, language, leaks, mixing, pii, secrets, spelling, token_counts, toxicity, url_filters
from answerloom.llm.batches import held_out
from answerloom.session import ship_package

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = prepared
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark, sf_dir):
    return token_counts.piece_counts(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op2_benchmark_leaks(spark, sf_dir):
    return leaks.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learning_rows(table(spark, sf_dir, "labels")))
    scored = toxicity.judged(docs, model).select("doc_id", "toxicity.*")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query
def op4_mixing(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_fingerprints(spark, sf_dir):
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


@query
def op6_chats(spark, sf_dir):
    return chats.rendered(table(spark, sf_dir, "conversations"))


def spans_text(spans: str):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kinds) -> list:
    def number(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return [number(k) for k in kinds]


@query
def op7_secrets(spark, sf_dir):
    rows = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")
    return rows.select("doc_id", *counted("base", secrets.KINDS), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


@query
def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.learning_rows(docs))
    rows = language.identified(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "language.lang_pred", "language.score")


@query
def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_pii(spark, sf_dir):
    rows = pii.found_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *counted("base", pii.KINDS[:4]), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


@query
def op11_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


#: The rules of the filter, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op12_url_filters(spark, sf_dir):
    rules = url_filters.build(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    rows = url_filters.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return rows.select("page_id", "filtered.*")


@query
def op13_alignment(spark, sf_dir):
    return alignment.aligned(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, VOCABULARY)


SQL["op6_chats"] = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, role, text,
                  md5(concat(role, '|', text)) AS own FROM conversations),
     c AS (SELECT conv_id, count(*) AS n, string_agg(own, ',' ORDER BY place) AS h FROM t GROUP BY conv_id),
     p AS (SELECT conv_id, place + 1 AS n, string_agg(own, ',') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS h FROM t),
     longer AS (SELECT DISTINCT p.n, p.h FROM p JOIN c USING (conv_id) WHERE p.n < c.n),
     kept AS (SELECT min(c.conv_id) AS conv_id FROM c ANTI JOIN longer USING (n, h) GROUP BY c.n, c.h)
SELECT conv_id, (place // 64)::BIGINT AS part, count(*) AS n_turns,
       string_agg(concat('<|', role, '|>', chr(10), text, chr(10), '<|end|>', chr(10)), '' ORDER BY place) AS text
FROM t SEMI JOIN kept USING (conv_id) GROUP BY ALL"""

SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

SQL["op11_spelling"] = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
       SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
     crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
     found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
     runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL),
     bytes AS (SELECT run, n, list_concat([4294967295::BIGINT], flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                      ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END FOR x IN string_split(doc_id || ':' || run, '')])) AS b FROM runs WHERE length(run) >= 7),
     hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, crc),
     w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
     v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     d AS (SELECT word, n, unnest([{'i': i, 'd': substr(word, 1, i - 1) || substr(word, i + 1)} FOR i IN range(1, length(word) + 1)], recursive := true) FROM v),
     swaps AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.d = y.d AND x.word <> y.word),
     gaps AS (SELECT DISTINCT d.word AS a, v.word AS b FROM d JOIN v ON d.d = v.word),
     pairs AS (SELECT a, b FROM swaps UNION ALL SELECT a, b FROM gaps UNION ALL SELECT b, a FROM gaps),
     ranked AS (SELECT a, b, v.n AS n, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN v ON v.word = b),
     f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 10 * v.n THEN b END AS form, CASE WHEN ranked.n >= 10 * v.n THEN ranked.n END AS form_n
           FROM v LEFT JOIN ranked ON a = v.word AND r = 1),
     steps AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT steps.word, f.form, k + 1 FROM steps JOIN f ON f.word = steps.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, k) AS root, n, n_near, form_n FROM f JOIN steps ON steps.word = f.word GROUP BY ALL"""

SQL["op12_url_filters"] = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
     rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
     cut AS (SELECT page_id, url, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS row FROM rest),
     fits AS (SELECT row, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM cut JOIN rules
              ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM cut LEFT JOIN fits USING (row)"""
