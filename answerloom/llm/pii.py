"""Personal data, and terms that give it away (operator 10); DataFrame functions only.

Patterns find protected entities: addresses, numbers. For the words of the
documents with an entity the corpus tells how strongly they reveal it: the pointwise mutual
information of word and entity, as a share of the information of the entity
itself. That alone would make every rare word of such a document telling, so a word also has to be one that
chance does not bring there. Words above both limits are generalised to a mark of their kind, wherever
they stand in a document with the entity, and entities are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import fresh
from answerloom.storage import save

KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the four kinds, written so that every stretch of text is tried from its
# first character only and nothing is tried twice. \G is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has to contain for a kind, looked for first.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

TERM = r"[\p{L}\p{N}]{3,}"
#: A term gives an entity away if it tells so large a share of the entity's information.
DISCLOSURE = 0.5
#: And if so few words as rare as it, at most, would stand with the entity by chance.
BY_CHANCE = 0.1
#: Matches whose places are worked out together.
_TOGETHER = 128


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(text: str, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches in the column ``text``, in code points, end exclusive.

    Matches and what lies between them are taken out; the lengths give the places, of a
    fixed number of matches at a time, as a list that grows one by one would be copied as often.
    """
    hits = f"regexp_extract_all({text}, {_lit('(' + pattern + ')')}, 1)"
    gaps = f"split({text}, {_lit(pattern)}, -1)"
    kind = "array<struct<start: int, end: int, value: string>>"
    last = f"least(c * {_TOGETHER} + {_TOGETHER - 1}, size(x.h) - 1)"
    numbers = f"sequence(0, cast(floor((size(x.h) - 1) / {_TOGETHER}) as int))"
    lengths = f"transform({numbers}, c -> aggregate(sequence(c * {_TOGETHER}, {last}), 0, (n, i) -> n + length(x.g[i]) + length(x.h[i])))"
    return F.expr(
        f"transform(array(struct({hits} as h, {gaps} as g)), x -> transform(array({lengths}), n -> flatten(transform({numbers}, c -> "
        f"aggregate(sequence(c * {_TOGETHER}, {last}), "
        f"named_struct('at', aggregate(slice(n, 1, c), 0, (a, b) -> a + b), 'out', cast(array() as {kind})), (a, i) -> named_struct("
        "'at', a.at + length(x.g[i]) + length(x.h[i]), 'out', concat(a.out, array(named_struct("
        "'start', a.at + length(x.g[i]), 'end', a.at + length(x.g[i]) + length(x.h[i]), 'value', x.h[i])))), a -> a.out))))[0])[0]"
    )


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0") <= "255")

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: array<struct<kind, start, end, value>> of the finds by pattern, by kind as listed and then start."""
    kind_of = "array<struct<start: int, end: int, value: string>>"
    columns = {kind: fresh(docs, f"found_{kind}") for kind in PATTERNS}
    made = docs
    for kind, pattern in PATTERNS.items():
        # one pass says whether there is any match; only then places are worked out
        any_match = F.col(text).contains(NEEDS[kind]) & F.col(text).rlike(pattern) if NEEDS[kind] else F.col(text).rlike(pattern)
        made = made.withColumn(columns[kind], F.when(any_match, located(f"`{text}`", pattern)).otherwise(F.array().cast(kind_of)))

    def tagged(kind: str) -> Column:
        passed = F.filter(F.col(columns[kind]), lambda s: _passes(kind, s["value"]))
        return F.transform(passed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return made.withColumn(name, F.concat(*[tagged(k) for k in PATTERNS])).drop(*columns.values())


def _holders(found: DataFrame) -> DataFrame:
    """(doc_id, digest, text, spans, entities): the rows with finds; ``entities`` has each different one once."""
    entity = F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"])))
    return found.filter("size(spans) > 0").select("doc_id", "digest", "text", "spans", F.array_distinct(entity).alias("entities"))


def _terms(text: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1)), F.lower))


def _met(holders: DataFrame) -> DataFrame:
    """(doc_id, digest, term, before, after): the words of each row once, with hashes of the three words before and after the first place of each."""
    words = F.transform(F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1)), F.lower)
    rows = holders.select("doc_id", "digest", words.alias("words"))
    near = "xxhash64(get(words, i {0} 1), get(words, i {0} 2), get(words, i {0} 3))"
    beside = f"transform(words, (w, i) -> struct(w as term, i as at, {near.format('-')} as before, {near.format('+')} as after))"
    each = rows.select("doc_id", "digest", F.inline(F.expr(beside)))
    first = each.groupBy("doc_id", "digest", "term").agg(F.min(F.struct("at", "before", "after")).alias("first"))
    return first.select("doc_id", "digest", "term", "first.before", "first.after")


def _as_rare(of_term: DataFrame) -> Column:
    """How many terms stand in fewer rows than the power of two above ``n_term``; there are 63 such powers at most."""
    power = F.floor(F.log2("n_term") + 1e-9).cast("int")
    counts = dict(of_term.groupBy(power.alias("power")).count().collect())
    return F.element_at(F.array(*[F.lit(sum(n for p, n in counts.items() if p <= power)) for power in range(64)]), power + 1)


def disclosing(holders: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(entity, term, disclosure) of the terms that give an entity away.

    ``disclosure`` = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)) over the rows of ``docs``, whose whole texts count for
    all of them; it has to reach ``DISCLOSURE``. Besides, if words fell into rows without regard to the entity, a word of n(t)
    rows would stand in k of its n(e) rows with a chance below (n(t) n(e) / N)**k / k!. That chance, times the number of terms
    as rare, is how many such words the entity would have anyway, and must not exceed ``BY_CHANCE``. Copies and edited copies are no
    evidence: k is the effective number of different words before, or after if that is less, by the sum of squared shares. So a word of one row with an entity of one row is telling where rare words are few, and not where each text has
    some. Words are counted by row before pairs are made, and pairs are made only for words that can pass.
    """
    total = docs.count()
    of_term = save(docs.filter(F.col(text).isNotNull()).select(F.explode(_terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "pii-terms")
    entities = holders.select("doc_id", "digest", F.explode("entities").alias("entity"))
    of_entity = save(entities.groupBy("entity").agg(F.count("*").alias("n_entity")), "pii-entities")
    most = of_entity.agg(F.max("n_entity")).first()[0] or 0
    # what stands in more rows than this tells too little, whatever the entity
    rated = of_term.withColumn("as_rare", _as_rare(of_term)).filter(F.col("n_term") <= (total * most) ** 0.5 + 1)
    terms = save(_met(holders).join(rated, "term").withColumn("doc_id_", F.col("doc_id")).drop("doc_id"), "pii-met")
    held = entities.join(of_entity, "entity")

    def pairs(terms: DataFrame, entities: DataFrame) -> DataFrame:
        same = entities["doc_id"].eqNullSafe(terms["doc_id_"]) & (entities["digest"] == terms["digest"])
        return entities.join(terms, same).select("entity", "n_entity", "term", "n_term", "as_rare", "before", "after")

    alone = F.col("n_term") * F.col("as_rare") <= BY_CHANCE * total
    often = pairs(terms.filter(~alone & (F.col("n_term") > 1)), held.filter("n_entity > 1"))
    every = often.unionByName(pairs(terms.filter(alone), held))
    keys = ["entity", "n_entity", "term", "n_term", "as_rare"]
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("words")), F.struct(F.lit(1).alias("side"), F.col("after").alias("words"))))
    beside = every.select(*keys, sides).groupBy(*keys, "side", "words").agg(F.count("*").alias("n"))
    of_side = beside.groupBy(*keys, "side").agg(F.sum("n").alias("n_both"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    effective = F.floor(F.col("n_both") * F.col("n_both") / F.col("squares") + 1e-9)
    both = of_side.groupBy(*keys).agg(F.max("n_both").alias("n_both"), F.min(effective).alias("k"))
    told = F.log(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    whole = F.log(total / F.col("n_entity"))
    both = both.withColumn("disclosure", F.when(whole > 0, told / whole).otherwise(0.0)).filter(F.col("disclosure") >= DISCLOSURE)
    # ln k! by the published lower bound
    factorial = F.when(F.col("k") > 1, F.col("k") * F.log("k") - F.col("k") + F.log(2 * math.pi * F.col("k")) / 2).otherwise(0.0)
    chance = F.col("k") * F.log(F.col("n_term") * F.col("n_entity") / total) - factorial
    return both.filter(chance + F.log("as_rare") <= math.log(BY_CHANCE)).select("entity", "term", "disclosure")


def _places(holders: DataFrame, given: DataFrame) -> DataFrame:
    """(doc_id, digest, terms): the places of the given terms in rows that hold their entity, outside all finds."""
    entities = holders.select("doc_id", "digest", F.explode("entities").alias("entity"))
    wanted = entities.join(given, "entity").select(F.col("doc_id").alias("wanted_id"), F.col("digest").alias("wanted_digest"), "term").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted_digest"))
    rows = holders.join(wanted.select("wanted_id", "wanted_digest").distinct(), same, "left_semi")
    words = rows.select("doc_id", "digest", "spans", F.explode(located("text", TERM)).alias("w"))
    words = words.join(wanted, same & (F.lower("w.value") == F.col("term")), "left_semi")
    outside = words.filter(~F.exists("spans", lambda s: (s["start"] < F.col("w.end")) & (F.col("w.start") < s["end"])))
    place = F.struct(F.lit("term").alias("kind"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    return outside.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(place)).alias("terms"))


def _digest(text: str) -> Column:
    return F.xxhash64(F.isnull(text), F.coalesce(text, F.lit("")))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, base, spans), a row for each row of ``docs``.

    ``base``: finds by pattern in the whole text; ``spans``: these and the disclosing
    terms in rows that hold their entity, both array<struct<kind, start, end>> by kind as listed and then start, in code
    points with the end exclusive. ``digest`` is a hash of the text. Null and empty texts have none; rows without an id and
    repeated rows are kept; other columns are not read.
    """
    rows = docs.select("doc_id", _digest("text").alias("digest"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest("text").alias("digest"))
    # the finds are written, so that the patterns go over the texts once
    holders = save(_holders(base_spans(texts, "text", "spans")), "pii-holders")
    given = save(disclosing(holders, docs, "text").select("entity", "term"), "pii-given")
    kind = "array<struct<kind: string, start: int, end: int>>"
    bare = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = holders.select("doc_id", "digest", bare.alias("base"), F.array().cast(kind).alias("terms"))
    flagged = _places(holders, given).select("doc_id", "digest", F.array().cast(kind).alias("base"), "terms")
    one = base.unionByName(flagged).groupBy(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest")).agg(F.max("base").alias("base"), F.max("terms").alias("terms"))
    both = rows.join(one, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest")), "left")
    none = F.array().cast(kind)
    spans = F.concat(F.coalesce("base", none), F.coalesce("terms", none))
    return both.select("doc_id", "digest", F.coalesce("base", none).alias("base"), spans.alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span as a mark of its kind; of overlapping spans the first, then the longest, gives the mark."""
    kind = "struct<at: int, out: string>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), mark)
        end = -s["back"]
        return F.when(s["start"] >= a["at"], F.struct(end.alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(a["at"], end).alias("at"), a["out"].alias("out"))).cast(kind)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    return F.aggregate(ordered, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with entities and disclosing terms of ``text`` replaced by marks; null texts stay null."""
    one = found_spans(docs).filter("size(spans) > 0").dropDuplicates(["doc_id", "digest"])
    names = [fresh(docs, f"pii_{c}") for c in ("id", "digest", "spans")]
    one = one.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "digest", "spans"), names, strict=True)])
    same = docs["doc_id"].eqNullSafe(one[names[0]]) & (_digest("text") == one[names[1]])
    text = F.when(F.col(names[2]).isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col(names[2])))
    return docs.join(one, same, "left").withColumn("text", text).drop(*names)
