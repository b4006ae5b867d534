"""Personal data by candidate gradient boosting, with DataFrame functions and MLlib only.

High-recall generators propose spans that may overlap: the base patterns, and wider ones that find what a base
pattern runs past (a number that another follows, other separators, obfuscated addresses). Boosted trees score the wide
candidates by their format and context; the best ones above a threshold that was calibrated on
held-out candidates are added to the base spans, which always stay.

Labels come from the base rules: a candidate that is a base span with a passing check is positive, one whose check fails, or
that only overlaps a passing span, is negative, and the others are scored. The trees and thresholds are made from all labelled candidates:
those alike in every level of their features are one row with their number as its weight, and as trees split at the
given `STEPS` alone, MLlib has no split points to find from a sample.
"""

from __future__ import annotations

import dataclasses

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.spans import SEEN, SPAN, spans_of
from opsloom.llm.tables import document_key
from opsloom.session import stored

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24
LOCAL = r"A-Za-z0-9._%+-"

#: Base patterns, fixed, by kind. As given, but that quantifiers don't give back and a run is entered at its
#: start or where the last match ended, so that they take time in proportion to the text.
BASE = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",)),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", ()),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
}
#: Wider patterns, several a kind; their repetitions are bounded.
WIDE = (
    ("email", rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{{2,63}}+){{1,6}}+", ("@", "at]", "at)")),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])", (".",)),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])", (":",)),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", ()),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ ./-][0-9]{4}){3}(?![0-9])", ()),
    ("card", r"(?<![0-9])[0-9]{4}[ ./-][0-9]{6}[ ./-][0-9]{5}(?![0-9])", ()),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])", ("+",)),
    ("phone", r"(?<![0-9+(])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /.-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", ()),
    ("phone", r"(?<![0-9+])[0-9]{10,11}+(?![0-9])", ()),
)
#: Words before a span that speak for a kind.
CUES = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobil"}


@dataclasses.dataclass(frozen=True)
class Fit:
    """Parameters of the trees."""

    rounds: int = 8
    depth: int = 3
    precision: float = 0.98  # of held-out candidates above a kind's threshold
    seed: int = 2


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits (at most 20) pass the Luhn check."""
    padded = F.lpad(digits(hit), 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(1, 21):
        total = total + F.substring(doubled if i % 2 else padded, i, 1).cast("int")
    return total % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The base check of a kind."""
    n = F.length(digits(hit))
    if kind == "card":
        return n.between(14, 19) & luhn(hit)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return F.lit(True)


def candidates(text: Column) -> Column:
    """All generators' spans: array of (`SEEN`, generator, passed); generator 0 is the base pattern of its kind."""

    def told(spans: Column, generator: int, check: str | None) -> Column:
        passed = (lambda s: passes(check, s["hit"])) if check else (lambda s: F.lit(False))
        return F.transform(spans, lambda s: F.struct(s.alias("seen"), F.lit(generator).alias("generator"), passed(s).alias("passed")))

    def every(kind: str, pattern: str, hint: tuple[str, ...]) -> Column:
        return spans_of(text, kind, KINDS.index(kind), pattern, lambda hit: F.lit(True), hint=hint, context=CONTEXT)

    found = [told(every(kind, *BASE[kind]), 0, kind) for kind in KINDS]
    found += [told(every(*wide), number, None) for number, wide in enumerate(WIDE, 1)]
    return F.concat(*found)


#: The features, and where trees may split each: a feature's level is how many of its steps it reaches.
STEPS = {
    "kind_no": (1, 2, 3),
    "n_chars": (6, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22, 24, 28, 32, 40, 64),
    "n_digits": tuple(range(1, 21)),
    "n_letters": (1, 2, 4, 6, 8, 12, 16, 24, 32),
    "n_space": (1, 2, 3, 4, 6),
    "n_dash": (1, 2, 3, 4, 6),
    "n_dot": (1, 2, 3, 4, 6),
    "n_paren": (1, 2),
    "groups": (2, 3, 4, 5, 6, 8),
    "plus": (1,),
    "at": (1,),
    "lead": tuple(range(10)),
    "check": (1,),
    "cue": (1,),
    "letter_before": (1,),
    "letter_after": (1,),
}
FEATURES = tuple(STEPS)


def featured(c: DataFrame) -> DataFrame:
    """Format and context of each candidate (columns kind, order, hit, before, after) as numbers.

    A number next to the span is no part of it: labels come from the base rules, which run on into such a number, so
    it would speak against the very spans that the rules miss.
    """
    hit = F.col("hit")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(hit, f"[^{pattern}]", ""))

    cue = F.lit(False)
    for kind, words in CUES.items():
        cue = cue | ((F.col("kind") == kind) & F.lower("before").rlike(words))
    n = F.length(digits(hit))
    check = F.lit(False)
    for kind in KINDS:
        check = F.when(F.col("kind") == kind, passes(kind, hit)).otherwise(check)
    values = {
        "kind_no": F.col("order"),
        "n_chars": F.length(hit),
        "n_digits": n,
        "n_letters": count("A-Za-z"),
        "n_space": count(" "),
        "n_dash": count("-"),
        "n_dot": count("."),
        "n_paren": count("()"),
        "groups": F.size(F.split(hit, "[^0-9]+")),
        "plus": F.startswith(hit, F.lit("+")),
        "at": F.contains(hit, F.lit("@")),
        "lead": F.coalesce(F.substring(digits(hit), 1, 1).try_cast("int"), F.lit(-1)),
        "check": check,
        "cue": cue,
        "letter_before": F.col("before").rlike("[A-Za-z]$"),
        "letter_after": F.col("after").rlike("^[A-Za-z]"),
    }
    return c.withColumns({k: _level(v.cast("int"), STEPS[k]) for k, v in values.items()})


def _level(value: Column, steps: tuple[int, ...]) -> Column:
    level = F.lit(0)
    for number, step in enumerate(steps, 1):
        level = F.when(value >= step, number).otherwise(level)
    return level


def _vector() -> Column:
    """A number 0 or 1 for each step: whether the feature reaches it. Marked as binary, so that it has no split points to be found."""
    reached = [(f"{name}_{step}", F.col(name) >= number) for name, steps in STEPS.items() for number, step in enumerate(steps, 1)]
    binary = [{"idx": i, "name": name} for i, (name, _) in enumerate(reached)]
    values = F.array(*[one.cast("double") for _, one in reached])
    return array_to_vector(values).alias("_features", metadata={"ml_attr": {"attrs": {"binary": binary}, "num_attrs": len(binary)}})


def labelled(c: DataFrame) -> DataFrame:
    """Candidates one row each with `label`: 1, 0, or null for those to be scored. Input: doc_key, cands."""
    base = F.filter("cands", lambda x: x["generator"] == 0)
    rows = c.select("doc_key", base.alias("base"), F.explode("cands").alias("c")).select("doc_key", "base", "c.generator", "c.seen.*")
    same = F.filter("base", lambda b: (b["seen"]["start"] == F.col("start")) & (b["seen"]["stop"] == F.col("stop")) & (b["seen"]["kind"] == F.col("kind")))
    good = F.exists("base", lambda b: b["passed"] & (b["seen"]["start"] < F.col("stop")) & (b["seen"]["stop"] > F.col("start")))
    label = F.when(F.exists(same, lambda b: b["passed"]), 1.0).when((F.size(same) > 0) | good, 0.0)
    return rows.withColumn("label", label).drop("base").dropDuplicates(["doc_key", "start", "stop", "kind"])


def cells(rows: DataFrame) -> DataFrame:
    """All labelled candidates, counted (`weight`) by the levels of their features, label, kind and whether they are held out."""
    held = F.pmod(F.xxhash64("doc_key", "start", "stop", "kind"), F.lit(4)) == 0
    given = featured(rows.filter(F.col("label").isNotNull())).withColumn("_held", held)
    return given.groupBy(*FEATURES, "kind", "label", "_held").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit(rows: DataFrame, options: Fit):
    """The trees and each kind's threshold; None without candidates of both labels among those to fit."""
    counted = stored(cells(rows), "cells")
    if counted.filter(~F.col("_held")).select("label").distinct().count() < 2:
        return None
    ready = counted.select("*", _vector())
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=options.rounds, maxDepth=options.depth, seed=options.seed)
    model = trees.fit(ready.filter(~F.col("_held")))
    held = scored(model, ready.filter("_held"), ready=True)
    good, n = F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")
    counts = held.groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(good, n).collect()  # 101 bins a kind at most
    return model, {kind: _threshold([(r["bin"], r["good"], r["n"]) for r in counts if r["kind"] == kind], options.precision) for kind in KINDS}


def _threshold(bins: list[tuple[int, float, float]], precision: float) -> float:
    """The least score from which on held-out candidates have the precision; 2 (none passes) if there is none."""
    best, good, n = 2.0, 0.0, 0
    for b, g, k in sorted(bins, reverse=True):
        good, n = good + g, n + k
        if good >= precision * n:
            best = b / 100
    return max(best, 0.5)


def scored(model, rows: DataFrame, ready: bool = False) -> DataFrame:
    """rows with `score`, the trees' probability, rounded, as the order of sums over partitions may show in its last digits."""
    assembled = rows if ready else featured(rows).select("*", _vector())
    return model.transform(assembled).withColumn("score", F.round(vector_to_array("probability")[1], 9))


def find(docs: DataFrame, options: Fit = Fit(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, doc_key, base_spans and spans (arrays of `SPAN`).

    spans holds the base spans and those that the trees add, which overlap neither them nor each other: of
    overlapping ones the higher score stays, then the earlier, then the kind listed first. Rows equal in id and text get the same
    spans. Null or empty texts have none; other columns are ignored; without labels nothing is added.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = stored(rows.select("doc_id", document_key("doc_id", "body").alias("doc_key"), candidates(F.col("body")).alias("cands")), "candidates")
    narrow = [F.col(c) for c in ("start", "order", "stop", "kind")]
    base = F.transform(F.filter("cands", lambda c: (c["generator"] == 0) & c["passed"]), lambda c: F.struct(*[c["seen"][f].alias(f) for f in ("start", "order", "stop", "kind")]).cast(SPAN))
    out = found.select("doc_id", "doc_key", base.alias("base_spans"))
    each = stored(labelled(found.filter(F.size("cands") > 0).dropDuplicates(["doc_key"])), "labelled")
    model = fit(each, options)
    if model is None:
        return out.withColumn("spans", F.col("base_spans"))
    trees, thresholds = model
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(t))) for k, t in thresholds.items()], F.lit(2.0))
    accepted = scored(trees, each.filter("label is null")).filter(F.col("score") >= limit)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), *narrow)))
    lists = accepted.groupBy("doc_key").agg(_apart(ranked).alias("_added"))
    return out.join(stored(lists, "added"), "doc_key", "left").select(
        "doc_id", "doc_key", "base_spans", F.concat("base_spans", F.coalesce("_added", F.array().cast(f"array<{SPAN}>"))).alias("spans")
    )


def _apart(ranked: Column) -> Column:
    """Of spans in their rank's order those that overlap none before them."""

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(*[s[f].alias(f) for f in ("start", "order", "stop", "kind")]).cast(SPAN)
        clash = F.exists(acc, lambda a: (a["start"] < s["stop"]) & (a["stop"] > s["start"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(ranked, F.array().cast(f"array<{SPAN}>"), step)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by its kind in brackets; spans don't overlap across kinds' ends."""
    step = lambda acc, s: F.when(
        s["start"] < acc["at"], acc
    ).otherwise(
        F.struct(
            F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            s["stop"].alias("at"),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
