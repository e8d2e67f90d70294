"""Counting inside one array, without exploding it.

The work is linear in the array after a sort, needs no shuffle, and keeps a
row's tokens inside that row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.binding import let


def _over_runs(tokens: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """One element per distinct token: ``body`` of the sorted array and the first and last place of its run."""

    def of_sorted(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered))).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(
            places, lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))
        )
        return let(starts, lambda s: F.transform(s, lambda first, run: body(ordered, first, last(s, run, ordered))))

    def last(starts: Column, run: Column, ordered: Column) -> Column:
        return F.coalesce(F.get(starts, run + 1) - 1, F.size(ordered))

    return let(F.sort_array(tokens), of_sorted)


def counted(tokens: Column) -> Column:
    """The distinct tokens with how often each occurs: array<struct<term, n>>."""
    return _over_runs(
        tokens,
        lambda ordered, first, last: F.struct(
            F.get(ordered, first - 1).alias("term"), (last - first + 1).alias("n")
        ),
    )


def numbered(tokens: Column) -> Column:
    """The tokens with the second, third, ... of equals numbered, so that none repeats.

    Tokens must not hold tabs.
    """

    def of_run(ordered: Column, first: Column, last: Column) -> Column:
        token = F.get(ordered, first - 1)
        more = F.transform(F.sequence(first + 1, last), lambda p: F.concat(token, F.lit("\t"), (p - first).cast("string")))
        return F.when(first == last, F.array(token)).otherwise(F.concat(F.array(token), more))

    return F.flatten(_over_runs(tokens, of_run))


def common(a: Column, b: Column) -> Column:
    """The multiset intersection of two arrays, as numbered tokens."""
    return F.array_intersect(numbered(a), numbered(b))
