"""Word stems as SQL, one rule after the other, written out by hand for the checks."""

from __future__ import annotations


def shape(w: str) -> str:
    """The word as v and c; y is a vowel after a consonant."""
    letter = "CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND ends_with(s, 'c')) THEN 'v' ELSE 'c' END"
    return f"list_reduce(list_prepend('', string_split({w}, '')), lambda s, c: s || {letter})"


def measure(w: str) -> str:
    return f"len(regexp_extract_all({shape(w)}, 'v+c'))"


def cut(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def ends(*suffixes: str, w: str = "w") -> str:
    return "(" + " OR ".join(f"ends_with({w}, '{s}')" for s in suffixes) + ")"


def short(w: str) -> str:
    return f"((ends_with({shape(w)}, 'cvc') AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {shape(w)} = 'vc')"


def double(w: str) -> str:
    return f"(length({w}) > 1 AND right({w}, 1) = substr({w}, length({w}) - 1, 1) AND ends_with({shape(w)}, 'c'))"


# Suffixes and what takes their place, by step, and words with a stem of their own.
SECOND = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, "
    "ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, fulli ful, logi log"
)
THIRD = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
FOURTH = "al, ance, ence, er, ic, able, ible, ant, ement, ment, ent, ion, ou, ism, ate, iti, ous, ive, ize"
OWN = (
    "sky sky, skies sky, dying die, lying lie, tying tie, news news, innings inning, inning inning, outings outing, outing outing, "
    "cannings canning, canning canning, howe howe, proceed proceed, exceed exceed, succeed succeed"
)


def replaced(rules: str, least: int) -> str:
    """The longest suffix gives way to its other form, if enough is before it."""
    whens = []
    for rule in sorted(rules.split(", "), key=lambda r: -len(r.split()[0])):
        suffix, other = (*rule.split(), "-")[:2]
        kept, new = cut(len(suffix)), "" if other == "-" else f" || '{other}'"
        before = cut(3) if suffix == "logi" else kept
        more = f" AND right({kept}, 1) IN ('s', 't')" if suffix == "ion" else ""
        whens.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {measure(before)} > {least}{more} THEN {kept}{new} ELSE w END")
    return f"CASE {' '.join(whens)} ELSE w END"


STEPS = (
    f"CASE WHEN {ends('sses')} THEN {cut(2)} WHEN {ends('ies')} THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END "
    f"WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END",
    # a capital E marks what lost its ending here and goes through the next step
    f"CASE WHEN {ends('ied')} THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END "
    f"WHEN {ends('eed')} THEN CASE WHEN {measure(cut(3))} > 0 THEN {cut(1)} ELSE w END "
    f"WHEN {ends('ed')} AND contains({shape(cut(2))}, 'v') THEN {cut(2)} || 'E' "
    f"WHEN {ends('ing')} AND contains({shape(cut(3))}, 'v') THEN {cut(3)} || 'E' ELSE w END",
    f"CASE WHEN NOT ends_with(w, 'E') THEN w WHEN {ends('at', 'bl', 'iz', w=cut(1))} THEN {cut(1)} || 'e' "
    f"WHEN {double(cut(1))} AND right({cut(1)}, 1) NOT IN ('l', 's', 'z') THEN {cut(2)} "
    f"WHEN {measure(cut(1))} = 1 AND {short(cut(1))} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
    f"CASE WHEN {ends('y')} AND length(w) > 2 AND substr({shape('w')}, length(w) - 1, 1) = 'c' THEN {cut(1)} || 'i' ELSE w END",
    f"CASE WHEN {ends('alli')} AND {measure(cut(4))} > 0 THEN {cut(2)} ELSE w END",
    replaced(SECOND, 0),
    replaced(THIRD, 0),
    replaced(FOURTH, 1),
    f"CASE WHEN {ends('e')} AND ({measure(cut(1))} > 1 OR ({measure(cut(1))} = 1 AND NOT {short(cut(1))})) THEN {cut(1)} ELSE w END",
    f"CASE WHEN {ends('ll')} AND {measure(cut(1))} > 1 THEN {cut(1)} ELSE w END",
)


def stems(name: str, words: str) -> str:
    """CTE NAME (word, stem) of a source (word) of distinct words; words of up to three letters are their own stems."""
    own = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in map(str.split, OWN.split(", ")))
    ctes = [f"{name}_0 AS (SELECT word, word AS w FROM {words} WHERE length(word) > 3)"]
    for i, step in enumerate(STEPS):
        ctes.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT word, {step} AS w FROM {name}_{i})")
    ctes.append(f"{name} AS MATERIALIZED (SELECT word, CASE word {own} ELSE w END AS stem FROM {name}_{len(STEPS)} UNION ALL SELECT word, word FROM {words} WHERE length(word) <= 3)")
    return ",\n".join(ctes)
