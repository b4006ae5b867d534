"""Source divergence audit: how far the term shares of each source stand from those of the other sources and of its language.

All terms with the same count in a group (lang, source) and in its language have the same value, so values are evaluated
once per cell of counts. Cells are ranked by value and cumulative multiplicity: equal values are merged, as many
values are kept as it takes to fill the wanted ranks, and only the terms of the kept cells are put in UTF-8 order. The same goes for two
sources: their common terms are counted by cells of both counts, and what only one or neither of them holds follows from each
source's own cells by inclusion and exclusion, so no pair is expanded over all kept terms.

Shares are whole billionths and values whole numbers; products that may pass 64 bits are decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import stored

#: A term must be in so many documents of its language.
LEAST_DOCUMENTS = 10
#: Ranks of part `term`.
RANKS = 10
#: (group, term) counts that a task gathers before it passes them on, and bytes of a text that are split at a time.
HELD = 1 << 18
PIECE = 1 << 22

#: ASCII letters in lower case, other ASCII characters as spaces, bytes of longer UTF-8 characters as they are.
_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text: runs of ASCII letters (A-Z as a-z) and of characters beyond ASCII, some at a time."""
    plain, start = text.translate(_TERMS), 0
    while start < len(plain):
        cut = plain.find(b" ", start + PIECE)
        cut = len(plain) if cut < 0 else cut
        yield plain[start:cut].split()
        start = cut


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by group, summed per task as far as memory allows.

    Each group also has rows without a term, so that groups without any are known.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        held = 0

        def passed() -> Iterator:
            for (lang, source), (times, docs_of) in found.items():
                words = [None, *times]
                columns = [
                    pa.array([lang] * len(words), pa.binary()).cast(pa.string()),
                    pa.array([source] * len(words), pa.binary()).cast(pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array([0, *times.values()], pa.int64()),
                    pa.array([0, *(docs_of[w] for w in times)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch in batches:
            langs, sources, texts = (c.cast(pa.binary()) for c in batch.columns)
            for lang, source, text in zip(langs, sources, texts, strict=True):
                times, docs_of = found.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(times)
                here: set[bytes] = set()
                for words in terms(text.as_py()):
                    times.update(words)
                    here.update(words)
                docs_of.update(here)
                held += len(times)
                if held > HELD:
                    yield from passed()
                    held = 0
        yield from passed()

    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = given.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kinds: str = "kinds") -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), exactly."""
    whole = f"cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(19,0))"
    return F.expr(f"cast(1 + ({whole}) div cast({total} + 2 * {kinds} as decimal(19,0)) as bigint)")


def value(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _source_values(groups: DataFrame, cells: DataFrame, both: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language.

    f(a, b) over all kept terms is, with 0 for a term that a source does not hold,
    kinds f(0, 0) + sum over a's terms of f(a, 0) - f(0, 0) + sum over b's of f(0, b) - f(0, 0)
    + sum over common terms of f(a, b) - f(a, 0) - f(0, b) + f(0, 0).
    """
    one = groups.select("lang", F.col("source").alias("a"), F.col("kinds"), F.col("total").alias("total_a"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = one.join(two, "lang").where(F.col("a") < F.col("b"))
    pairs = pairs.where("kinds > 0").withColumn("a0", share("0", "total_a")).withColumn("b0", share("0", "total_b"))
    base = pairs.select("lang", "a", "b", (F.col("kinds") * value("a0", "b0")).alias("part"))
    alone = []
    for own, other in (("a", "b"), ("b", "a")):
        held = cells.select("lang", F.col("source").alias(own), "n", "times").join(pairs, ["lang", own])
        held = held.withColumn("p", share("n", f"total_{own}"))
        more = F.col("times") * (value("p", f"{other}0") - value("a0", "b0"))
        alone.append(held.select("lang", "a", "b", more.alias("part")))
    shared = both.join(pairs, ["lang", "a", "b"]).withColumn("p", share("n_a", "total_a")).withColumn("q", share("n_b", "total_b"))
    more = F.col("times") * (value("p", "q") - value("p", "b0") - value("a0", "q") + value("a0", "b0"))
    parts = base.union(alone[0]).union(alone[1]).union(shared.select("lang", "a", "b", more.alias("part")))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    empty = one.join(two, "lang").where((F.col("a") < F.col("b")) & (F.col("kinds") == 0))
    sums = sums.union(empty.select("lang", "a", "b", F.lit(0).cast("bigint")))
    each_way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", "value", each_way.alias("way")).select("lang", "way.source", "way.item", "value")


def _term_values(groups: DataFrame, kept: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value) of the terms of the first ranks of each group, by cells of (group count, language count)."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("times"))
    judged = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total"))
    judged = stored(judged.where("p > q").withColumn("value", value("p", "q")).select("lang", "source", "n", "lang_n", "times", "value"), "cells")
    # Each value is held by a term at least, so the ranks lie within as many greatest values.
    merged = judged.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    group = Window.partitionBy("lang", "source")
    greatest = merged.withColumn("_at", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("_at") <= ranks)
    before = F.sum("times").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    wanted = greatest.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < ranks)
    wanted = judged.drop("times").join(wanted.select("lang", "source", "value"), ["lang", "source", "value"], "left_semi")
    return kept.join(wanted, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how sources differ from each other (`pair`, all ranks) and which terms
    they use more than their language does (`term`, the first `ranks`).

    Null text, lang and source count as empty texts, so null and empty groups are one; repeated rows are documents of
    their own; equal values rank by the items' UTF-8 bytes; a group without kept terms has value 0 with each other group where its language has no
    kept terms, else the value of its counts of 0. An empty table has no rows; other columns are ignored.
    """
    counts = stored(count_terms(docs), "counts")
    found = counts.where(F.col("term").isNotNull())
    by_term = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    chosen = by_term.where(F.col("docs") >= least_documents).select("lang", "term", "lang_n")
    kept = stored(found.select("lang", "source", "term", "n").join(chosen, ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    all_groups = counts.where(F.col("term").isNull()).select("lang", "source")
    # The number of a language's kept terms: each once, in whichever source.
    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kinds"))
    groups = all_groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = stored(groups.select("lang", "source", "total", "lang_total", "kinds"), "groups")
    cells = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    a = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("n_a"))
    b = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("n_b"))
    met = a.join(b, ["lang", "term"]).where(F.col("a") < F.col("b"))
    both = met.groupBy("lang", "a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("times"))
    in_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(in_group)
    sources = _source_values(groups, cells, both).withColumn("part", F.lit("pair")).withColumn("rank", rank)
    over = _term_values(groups, kept, ranks).withColumn("part", F.lit("term")).withColumn("rank", rank).where(F.col("rank") <= ranks)
    return sources.unionByName(over).select("lang", "source", "part", "item", "value", "rank")
