"""Token counts by longest match, without building the pieces (operator 1).

A trie over the vocabulary gets failure links: where the trie cannot go on,
the link tells which pieces are complete by then, as a count made in advance,
and where matching resumes. Every character is read once, so a word of any
length takes linear time.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.batches import WORD

#: Characters of vocabulary that are broadcast at most; a vocabulary does not grow with the corpus.
VOCABULARY_CHARACTERS = 32_000_000
#: Words whose counts a task remembers before it starts anew.
REMEMBERED_WORDS = 200_000
#: What a sentencepiece model writes before a word.
MARK = "▁"
_SHIFT = 21  # a code point has fewer bits


@dataclass(frozen=True)
class Automaton:
    """``step`` maps (state, code point) to a state; ``fail``, ``popped`` and ``closing`` are by state.

    ``closing`` is the number of pieces that end a word in that state, or -1.
    State 0 begins a word, state 1 goes on after a piece. ``spelled`` are the bytes that have a piece of their own.
    """

    step: dict[int, int]
    fail: list[int]
    popped: list[int]
    closing: list[int]
    spelled: frozenset[int] = frozenset()


def build(initial: Iterable[str], following: Iterable[str], spelled: Iterable[int] = ()) -> Automaton:
    """The automaton of pieces that begin a word and pieces that follow another.

    ``spelled``: bytes that are pieces; where no piece goes on, a character counts as its UTF-8 bytes if all of these are.
    """
    initial, following, spelled = list(initial), list(following), frozenset(spelled)
    known = set(following)
    weights = {c: len(c.encode()) for piece in (initial, following) for c in set().union(*piece) if c not in known and spelled.issuperset(c.encode())}
    step: dict[int, int] = {}
    whole = [0, 0]
    parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
    for root, pieces in ((0, initial), (1, [*following, *weights])):
        for piece in pieces:
            state = root
            for c in map(ord, piece):
                key = state << _SHIFT | c
                if key not in step:
                    step[key] = len(whole)
                    whole.append(0)
                    parent.append((state, c))
                state = step[key]
            if state != root:
                whole[state] = weights.get(piece, 1) if root else 1
    fail, popped = [-1] * len(whole), [0] * len(whole)
    below: list[list[int]] = [[] for _ in whole]
    for state, (above, _) in enumerate(parent):
        if above >= 0:
            below[above].append(state)
    waiting = deque([*below[0], *below[1]])
    while waiting:
        state = waiting.popleft()
        waiting.extend(below[state])
        if whole[state]:
            fail[state], popped[state] = 1, whole[state]
            continue
        above, c = parent[state]
        at, count = fail[above], popped[above]
        while at >= 0 and at << _SHIFT | c not in step:
            count += popped[at]
            at = fail[at]
        if at >= 0:
            fail[state], popped[state] = step[at << _SHIFT | c], count
    closing = [-1] * len(whole)
    for state in range(len(whole)):
        at, count = state, 0
        while at > 1:
            count += popped[at]
            at = fail[at]
        closing[state] = count if at == 1 else -1
    closing[0] = 0
    return Automaton(step, fail, popped, closing, spelled)


def pieces_of_word(automaton: Automaton, word: str) -> int:
    """The number of pieces of a word by greedy longest match, or -1 where some part has no piece."""
    step, fail, popped = automaton.step, automaton.fail, automaton.popped
    state, count = 0, 0
    for c in map(ord, word):
        to = step.get(state << _SHIFT | c)
        while to is None:
            if state == 1 and automaton.spelled.issuperset(spelling := chr(c).encode()):
                count, to = count + len(spelling), 1
                break
            count += popped[state]
            state = fail[state]
            if state < 0:
                return -1
            to = step.get(state << _SHIFT | c)
        state = to
    closing = automaton.closing[state]
    return count + closing if closing >= 0 else -1


def load_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece model: those with the mark of a word's beginning, and the others."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if "▁" not in p]


def load_pieces(path: str) -> tuple[list[str], list[str], list[int]]:
    """All pieces of a sentencepiece model, the mark kept: those that begin with it, all that are text, and the bytes that have a piece."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    numbers = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in numbers if not model.is_byte(i)]
    return [p for p in pieces if p[0] == MARK], pieces, [int(model.id_to_piece(i)[1:-1], 16) for i in numbers if model.is_byte(i)]


class _Counts(dict):
    def __init__(self, automaton: Automaton, mark: str):
        super().__init__()
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: str) -> int:
        count = pieces_of_word(self.automaton, self.mark + word)
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = count
        return count


def counter(spark: SparkSession, initial: list[str], following: list[str], spelled: Iterable[int] = (), mark: str = ""):
    """A function from a text column to a struct (n_words, n_tokens, n_unknown); ``mark`` is put before every word."""
    if (size := sum(map(len, initial)) + sum(map(len, following))) > VOCABULARY_CHARACTERS:
        raise ValueError(f"a vocabulary of {size} characters is too large to broadcast")
    shared = spark.sparkContext.broadcast(build(initial, following, spelled))
    words = re.compile(WORD)

    @F.arrow_udf("struct<n_words: bigint, n_tokens: bigint, n_unknown: bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = _Counts(shared.value, mark)
        for batch in batches:
            rows = []
            for text in batch:
                each = list(map(counts.__getitem__, words.findall(text.as_py() or "")))
                unknown = each.count(-1)
                rows.append((len(each), sum(each) + 2 * unknown, unknown))
            n, tokens, unknown = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, tokens, unknown)], ["n_words", "n_tokens", "n_unknown"])

    return count


def _counted(docs: DataFrame, count, text: str | Column) -> DataFrame:
    made = docs.select(F.col("doc_id"), count(text if isinstance(text, Column) else F.col(text)).alias("made"))
    return made.select("doc_id", "made.n_words", "made.n_tokens", "made.n_unknown")


def token_counts(docs: DataFrame, vocabulary: str, text: str | Column = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row, with the lists of ``load_vocabulary`` alone, as WordPiece has them.

    Words are separated by white space. A word that these lists cannot
    spell is one unknown token, also where the model itself spells it with the mark alone or with bytes; ``piece_counts`` has all
    pieces. Null and empty texts have zeros; a null doc_id
    and repeated rows are kept as they are; other columns are not read.
    """
    return _counted(docs, counter(docs.sparkSession, *load_vocabulary(vocabulary)), text)


def piece_counts(docs: DataFrame, vocabulary: str, text: str | Column = "text") -> DataFrame:
    """The same with the whole model: each word is read with the mark before it, by longest match over all pieces.

    The mark alone is a piece, and a character without any piece counts as its byte pieces; only where the
    model has no such bytes is a word one unknown token.
    """
    return _counted(docs, counter(docs.sparkSession, *load_pieces(vocabulary), MARK), text)
