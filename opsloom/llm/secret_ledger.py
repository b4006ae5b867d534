"""Secret scan with an incremental ledger of blobs.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger is a
table of (blob, rule version, spans) that only grows. A scan takes the blobs that the ledger does not hold
for the rule version at hand, scans each such text once, however many paths or versions carry it,
appends what it found (also an empty finding), and joins the findings back to all paths by blob.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.spans import SPAN, spans_of
from opsloom.sources.store import read_or_empty

LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rules", T.StringType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("order", T.IntegerType()),
                        T.StructField("stop", T.LongType()),
                        T.StructField("kind", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


@dataclasses.dataclass(frozen=True)
class Rule:
    """A kind of span: `pattern` finds it, and its capture `group` (0: all of it) has `least` characters.

    Patterns take time in proportion to the text: quantifiers don't give back (possessive), and a run is
    entered at its start only. `hint`: substrings one of which each match holds.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: tuple[str, ...] = ()


#: Fixed patterns, the base kinds in their listing's order. A run of hexadecimal digits shorter than 24 and
#: an AKIA run shorter than 20 never pass, so the patterns ask for these lengths at once.
BASE = (
    Rule(
        "assign",
        r"""(?:(?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
        6,
        1,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", 20, 0, ("AKIA",)),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 24),
)
#: Well-known public token formats that the scan adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 1, 0, ("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]++", 40, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]++", 20, 0, ("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 40, 0, ("eyJ",)),
)


def rule_version(rules: Sequence[Rule]) -> str:
    """The rules' name by content: a changed rule is another version."""
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def spans_by(text: Column, rules: Sequence[Rule]) -> Column:
    """All rules' spans of a text."""
    found = [
        spans_of(text, r.kind, i, r.pattern, lambda part, r=r: F.length(part) >= r.least, r.group, r.hint) for i, r in enumerate(rules)
    ]
    return F.concat(*found)


def with_blob(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds `blob`, the content address of each row's text (null: the empty text)."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = BASE + ADDED, text: str = "text") -> DataFrame:
    """versions with `blob` and `spans`; `ledger` (a folder) gains what it did not hold.

    Any columns besides `text` may be there (own columns named blob or spans are replaced); rows are
    kept as they are, repeated ones too. Null or empty text: no spans. A scan that is stopped leaves the ledger as
    it was; run twice, it scans nothing new. One writer at a time. A ledger that two writers filled with the
    same blob is read once per blob.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    known = read_or_empty(spark, ledger, LEDGER).filter(F.col("rules") == version)
    addressed = with_blob(versions.drop("blob", "spans"), text)
    unseen = addressed.select("blob", F.coalesce(F.col(text), F.lit("")).alias("body")).join(known.select("blob"), "blob", "left_anti")
    once = unseen.groupBy("blob").agg(F.first("body").alias("body"))
    once.select("blob", F.lit(version).alias("rules"), spans_by(F.col("body"), rules).alias("spans")).write.mode("append").parquet(ledger)
    findings = read_or_empty(spark, ledger, LEDGER).filter((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    none = F.array().cast(f"array<{SPAN}>")
    return addressed.join(findings, "blob", "left").withColumn("spans", F.coalesce("spans", none))
