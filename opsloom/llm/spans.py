"""Positions of pattern matches, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: bigint, order: int, stop: bigint, kind: string>"
#: A span with the matched text, and some text before and after it.
SEEN = "struct<start: bigint, order: int, stop: bigint, kind: string, hit: string, before: string, after: string>"
#: Spans are gathered in blocks of this many, so that a text with very many takes time in proportion.
BLOCK = 512


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of the pattern."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def spans_of(
    text: Column,
    kind: str,
    order: int,
    pattern: str,
    check: Callable[[Column], Column],
    group: int = 0,
    hint: Sequence[str] = (),
    context: int = 0,
) -> Column:
    """The pattern's leftmost non-overlapping matches as `SPAN` structs; those failing `check` are dropped.

    With a `context` they are `SEEN` structs with that many characters before and after, up to the neighbouring matches.

    start and stop count code points, stop exclusive. `check` sees the match, or its capture `group`.
    `hint`: substrings one of which every match holds; texts without any are not searched.
    The texts between matches and the matches, taken in turn, give the positions: both come from the same
    run of the same pattern. Null text: null.
    """
    hits = matches(text, pattern)
    parts = hits if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    columns = [gaps.alias("gap"), hits.alias("hit"), parts.alias("part")]
    if context:
        columns.append(F.slice(gaps, F.lit(2), F.size(gaps) - 1).alias("next"))
    pairs = F.arrays_zip(*columns)
    shape = SEEN if context else SPAN
    none = F.array().cast(f"array<{shape}>")
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast(f"array<array<{shape}>>").alias("blocks"),
        none.alias("last"),
    )

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["hit"]), F.lit(0))
        fields = [begin.alias("start"), F.lit(order).alias("order"), end.alias("stop"), F.lit(kind).alias("kind")]
        if context:
            fields += [pair["hit"].alias("hit"), F.right(pair["gap"], F.lit(context)).alias("before"), F.left(pair["next"], F.lit(context)).alias("after")]
        one = F.array(F.struct(*fields).cast(shape))
        good = pair["hit"].isNotNull() & F.coalesce(check(pair["part"]), F.lit(False))
        full = F.size(acc["last"]) >= BLOCK
        return F.struct(
            end.cast("bigint").alias("at"),
            F.when(good & full, F.concat(acc["blocks"], F.array(acc["last"]))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(good & full, one).when(good, F.concat(acc["last"], one)).otherwise(acc["last"]).alias("last"),
        )

    folded = F.aggregate(pairs, start, step, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["last"]))))
    possible = F.size(hits) > 0
    for i, word in enumerate(hint):
        seen = F.contains(text, F.lit(word)) if i == 0 else seen | F.contains(text, F.lit(word))
    if hint:
        possible = seen & possible
    return F.when(possible, folded).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then the kinds' order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
