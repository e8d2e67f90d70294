"""SQL pieces for the checks."""

from __future__ import annotations

import re

from answerloom.functions.text import ALNUM_PATTERN, KEYWORD_RULES, WORD_PATTERN
from answerloom.functions.words import ENGLISH_STOP_WORDS, SPLIT_WORDS
from answerloom.operators import prompts


def quoted(text: str) -> str:
    parts = ["'" + part.replace("'", "''") + "'" for part in text.split("\n")]
    return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"


STOP_WORDS = ", ".join(quoted(word) for word in ENGLISH_STOP_WORDS)


def first_line(c: str) -> str:
    return f"(CASE WHEN strpos({c}, chr(10)) > 0 THEN substr({c}, 1, strpos({c}, chr(10)) - 1) ELSE {c} END)"


def other_lines(c: str) -> str:
    return f"(CASE WHEN strpos({c}, chr(10)) > 0 THEN substr({c}, strpos({c}, chr(10)) + 1) ELSE '' END)"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}\x1c-\x1f]+|[\s\p{{Z}}\x1c-\x1f]+$', '', 'g')"


def word_tokens(c: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({c}), {quoted(WORD_PATTERN)}), "
        f"lambda t: t NOT IN ({STOP_WORDS}))"
    )


def space_tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[\s\p{{Z}}\x1c-\x1f]+'), lambda t: t <> '')"


def ascii_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def keywords(c: str) -> str:
    text = f"lower({c})"
    for pattern, replacement in KEYWORD_RULES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(re.sub(r'[$](\d)', r'\\\1', replacement))}, 'g')"
    for word, parts in SPLIT_WORDS.items():
        text = rf"regexp_replace({text}, '\b{word}\b', {quoted(parts)}, 'g')"
    return (
        rf"list_filter(regexp_split_to_array({text}, '[\s\p{{Z}}\x1c-\x1f]+'), "
        f"lambda t: regexp_matches(t, {quoted(ALNUM_PATTERN)}) AND t NOT IN ({STOP_WORDS}))"
    )


CORPUS = f"""corpus AS (
  SELECT doc_id, {first_line('text')} AS title, {other_lines('text')} AS body,
         lang || '|' || source AS tags, {other_lines('text')} AS answer
  FROM documents)"""

TURNS = "turns AS (SELECT conv_id * 100 + turn AS qid, conv_id, turn, role, text FROM conversations)"

PAIRS = f"""{TURNS}, pairs AS (
  SELECT u.qid, u.text AS question, a.text AS answer
  FROM turns u JOIN turns a ON a.qid - 1 = u.qid
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def weights(name: str, key: str, source: str, idf: str | None = None) -> str:
    """CTEs NAME_tf, NAME_idf (unless given) and NAME_w (key, term, w of length one, length)."""
    parts = [
        f"""{name}_tf AS (
  SELECT {key}, term, count(*) AS n
  FROM (SELECT {key}, unnest({word_tokens('text')}) AS term FROM {source}) GROUP BY {key}, term)"""
    ]
    if idf is None:
        idf = f"{name}_idf"
        parts.append(
            f"""{idf} AS (
  SELECT term, count(*) AS df,
         ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1.0 AS idf
  FROM {name}_tf GROUP BY term)"""
        )
    parts.append(
        f"""{name}_raw AS (SELECT {key}, term, n * idf AS w FROM {name}_tf JOIN {idf} USING (term)),
{name}_w AS (
  SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_raw)"""
    )
    return ",\n".join(parts)


def keyword_scores(queries: str, documents: str, depth: int) -> str:
    """CTE kw_raw (qid, doc_id, score, raw_rank); needs ``queries`` and ``documents`` sources."""
    return f"""{weights('d', 'doc_id', documents)},
{weights('q', 'qid', queries, 'd_idf')},
kw_scores AS (
  SELECT qid, doc_id, round(sum(q_w.w * d_w.w), 6) AS score
  FROM q_w JOIN d_w USING (term) GROUP BY qid, doc_id),
kw_raw AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS raw_rank
  FROM kw_scores QUALIFY raw_rank <= {depth})"""


def padded_scores(queries: str, documents: str, depth: int) -> str:
    """As ``keyword_scores``, with CTE padded that also lists documents sharing no term."""
    return f"""{keyword_scores(queries, documents, depth)},
padded AS (
  SELECT qid, doc_id, coalesce(score, 0.0) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.0) DESC, score IS NULL, doc_id) AS raw_rank
  FROM {queries} CROSS JOIN (SELECT doc_id FROM {documents}) LEFT JOIN kw_scores USING (qid, doc_id)
  QUALIFY raw_rank <= {depth})"""


def hash_vectors(name: str, key: str, source: str, dimensions: int = 64) -> str:
    """CTE NAME (key, embedding)."""
    bucket = f"(CAST(('0x' || substr(md5(token), 1, 7)) AS INTEGER) % {dimensions})"
    return f"""{name}_n AS (
  SELECT {key}, {bucket} AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest({word_tokens('text')}) AS token FROM {source}) GROUP BY ALL),
{name}_filled AS (
  SELECT s.{key}, b.bucket, coalesce(n, 0)::DOUBLE AS n
  FROM {source} s CROSS JOIN (SELECT unnest(range({dimensions})) AS bucket) b
  LEFT JOIN {name}_n c ON c.{key} = s.{key} AND c.bucket = b.bucket),
{name} AS (
  SELECT {key}, list(CASE WHEN len > 0 THEN n / len ELSE 0.0 END ORDER BY bucket) AS embedding
  FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY {key})) AS len FROM {name}_filled)
  GROUP BY {key})"""


def vector_scores(queries: str, documents: str, depth: int) -> str:
    """CTE vec_raw (qid, doc_id, score, raw_rank)."""
    return f"""vec_scores AS (
  SELECT qid, doc_id,
         round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM {queries} q CROSS JOIN {documents} d),
vec_raw AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS raw_rank
  FROM vec_scores QUALIFY raw_rank <= {depth})"""


def reranked(name: str, raw: str, queries: str, corpus: str = "corpus", k: int = 5) -> str:
    """CTE NAME (qid, rank, doc_id, title, tags, answer, score, boosted, raw_rank)."""
    return f"""{name}_fetched AS (
  SELECT r.*, c.title, c.tags, c.answer,
         r.score + CASE WHEN len(list_filter(q.words, lambda w: contains(lower(c.tags), w))) > 0
                        THEN 5.0 ELSE 0.0 END AS boosted
  FROM {raw} r JOIN {corpus} c USING (doc_id)
  JOIN (SELECT qid, {keywords('text')} AS words FROM {queries}) q USING (qid)),
{name} AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY boosted DESC, raw_rank) - 1 AS rank,
         doc_id, title, tags, answer, score, boosted, raw_rank
  FROM {name}_fetched QUALIFY rank < {k})"""


def contexts(name: str, hits: str, queries: str) -> str:
    """CTE NAME (qid, context)."""
    block = (
        "rank || ')' || chr(10) || 'Question: ' || title || chr(10) || 'Tags: ' || "
        "replace(tags, '|', ', ') || chr(10) || 'Answer: ' || answer || chr(10)"
    )
    return f"""{name} AS (
  SELECT qid, coalesce(context, '') AS context FROM {queries}
  LEFT JOIN (SELECT qid, string_agg({block}, chr(10) ORDER BY rank) AS context FROM {hits} GROUP BY qid)
  USING (qid))"""


def filled(stage: str, reasoning: bool = False, **slots: str) -> str:
    """A prompt as an SQL expression."""
    parts = []
    for before, slot in prompts.template(stage, reasoning).pieces:
        if before:
            parts.append(quoted(before))
        if slot is not None:
            parts.append(f"coalesce({slots[slot]}, '')")
    return "(" + " || ".join(parts) + ")"


def bleu(p: str, t: str, source: str) -> str:
    """CTE bleu_scores (qid, bleu)."""
    grams = " UNION ALL ".join(f"SELECT qid, {n} AS n, side, g{n} AS gram FROM runs WHERE g{n} IS NOT NULL" for n in range(1, 5))
    return f"""sides AS (
  SELECT qid, 'p' AS side, {space_tokens(p)} AS tokens FROM {source}
  UNION ALL SELECT qid, 't', {space_tokens(t)} FROM {source}),
sizes AS (
  SELECT qid, max(len(tokens)) FILTER (side = 'p') AS lp, max(len(tokens)) FILTER (side = 't') AS lt
  FROM sides GROUP BY qid),
tokens AS (
  SELECT qid, side, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS place FROM sides),
runs AS (
  SELECT qid, side, word AS g1, g1 || ' ' || lead(word, 1) OVER w AS g2, g2 || ' ' || lead(word, 2) OVER w AS g3,
         g3 || ' ' || lead(word, 3) OVER w AS g4
  FROM tokens WINDOW w AS (PARTITION BY qid, side ORDER BY place)),
grams AS ({grams}),
gram_counts AS (
  SELECT qid, n, gram, count(*) FILTER (side = 'p') AS cp, count(*) FILTER (side = 't') AS ct
  FROM grams GROUP BY ALL),
matches AS (
  SELECT s.qid, r.n, lp, lt, coalesce(m, 0) AS m
  FROM sizes s CROSS JOIN (SELECT unnest(range(1, 5)) AS n) r
  LEFT JOIN (SELECT qid, n, sum(least(cp, ct)) AS m FROM gram_counts GROUP BY ALL) c
    ON c.qid = s.qid AND c.n = r.n),
bleu_scores AS (
  SELECT qid, CASE WHEN max(m) FILTER (n = 1) = 0 THEN 0.0
    ELSE (CASE WHEN max(lp) > max(lt) THEN 1.0 ELSE exp(1.0 - max(lt) / max(lp)) END)
         * exp(sum(ln((CASE WHEN m > 0 THEN m ELSE 0.1 END) / greatest(1, lp - n + 1)) / 4)) END AS bleu
  FROM matches GROUP BY qid)"""


def rouge1(p: str, t: str, source: str) -> str:
    """CTE rouge1_scores (qid, rouge1)."""
    return f"""words AS (
  SELECT qid, 'p' AS side, unnest({ascii_tokens(p)}) AS word FROM {source}
  UNION ALL SELECT qid, 't', unnest({ascii_tokens(t)}) FROM {source}),
word_counts AS (
  SELECT qid, word, count(*) FILTER (side = 'p') AS cp, count(*) FILTER (side = 't') AS ct
  FROM words GROUP BY ALL),
rouge1_found AS (
  SELECT qid, sum(least(cp, ct)) AS m, sum(cp) AS lp, sum(ct) AS lt FROM word_counts GROUP BY qid),
rouge1_scores AS (
  SELECT s.qid, CASE WHEN coalesce(m, 0) > 0 THEN 2.0 * m / (lp + lt) ELSE 0.0 END AS rouge1
  FROM {source} s LEFT JOIN rouge1_found f ON f.qid = s.qid)"""


def lcs(items_a: str, items_b: str, source: str) -> str:
    """CTE lcs_lengths (qid, common, la, lb): the table of a longest common subsequence, row by row.

    Use with WITH RECURSIVE. ``row`` holds one row of the table; the last
    element of the last row is the length.
    """
    return f"""items AS MATERIALIZED (SELECT qid, {items_a} AS a, {items_b} AS b FROM {source}),
steps AS (
  SELECT qid, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS row FROM items
  UNION ALL
  SELECT s.qid, s.i + 1,
    list_reduce(range(1, len(t.b) + 1),
      lambda acc, j: list_append(acc, CASE WHEN t.a[s.i + 1] = t.b[j] THEN s.row[j] + 1
        ELSE greatest(s.row[j + 1], acc[j]) END)::INTEGER[],
      [0]::INTEGER[])
  FROM steps s JOIN items t ON t.qid = s.qid WHERE s.i < len(t.a)),
lcs_lengths AS (
  SELECT t.qid, s.row[len(t.b) + 1] AS common, len(t.a) AS la, len(t.b) AS lb
  FROM items t JOIN steps s ON s.qid = t.qid AND s.i = len(t.a))"""
