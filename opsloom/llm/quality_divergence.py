"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of
each reference language by the Jensen-Shannon distance (the square root of the divergence, base 2: 0 for equal
histograms, 1 for disjoint ones); the nearest reference counts, so a wrong language label does no harm. Each
histogram is judged only from a length on at which its sampling error is small.

The references are counted over all documents in two passes that send the driver a bounded result:
character classes and candidates for common words first (a word that makes up the share `common` of a language
does so in at least one part of it, so each part names at most 1 / common words), then these words' exact counts.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tables import WORD, plain_words
from opsloom.session import stored

CLASSES = ("lower", "upper", "other letter", "digit", "space", "sentence mark", "symbol", "rest")
SENTENCE_MARKS = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"


@dataclasses.dataclass(frozen=True)
class Limits:
    """The rules' parameters. A language is a reference if it has `language` of all words, or `language_words` of them,
    a number from which its own sampling error is small; a word is common if it has `common` of a language's
    words: at most `languages` references (those of most words) of 1 / common words.
    """

    min_words: int = 50
    max_repeated: int = 50  # percent of the words
    language: float = 0.02
    language_words: int = 20_000
    languages: int = 200
    common: float = 0.004
    class_words: int = 50  # classes are judged from so many words on
    word_words: int = 100  # common words are
    # Limits on the distances: a bias of the references, and a sampling error that falls with the root of the words.
    class_distance: float = 0.16
    class_error: float = 1.0
    word_distance: float = 0.13
    word_error: float = 1.9


@dataclasses.dataclass(frozen=True)
class Reference:
    """Shares of the character classes and of the common words; what is missing to 1 are other words."""

    classes: tuple[float, ...]
    words: dict[bytes, float]


def class_counts(text: str):
    """How many characters of each of `CLASSES` a text has, without a Python step per character."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(_class_of()[np.minimum(codes, 0x2FFFF)], minlength=len(CLASSES))


def _class_of():
    """The class of each code point below 0x30000, made on first use."""
    import numpy as np

    if "table" not in _TABLES:
        kinds = np.full(0x30000, CLASSES.index("rest"), dtype=np.uint8)
        for code in range(0x30000):
            c = chr(code)
            if c.isalpha():
                kinds[code] = 2 if code > 127 else 0 if c.islower() else 1
            elif c.isdigit():
                kinds[code] = 3
            elif c.isspace():
                kinds[code] = 4
            elif c in SENTENCE_MARKS:
                kinds[code] = 5
            elif c in SYMBOLS:
                kinds[code] = 6
        _TABLES["table"] = kinds
    return _TABLES["table"]


_TABLES: dict = {}


def base_counts(text: str, word) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in 3-word windows found twice or more."""
    words = word.findall(text)
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(line for line in text.split("\n") if word.search(line))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), sum(map(len, words)), n_symbols, sum(lines.values()) - len(lines), repeated


def js_distance(p, q) -> float:
    """Of two histograms that each sum to 1."""
    import numpy as np

    p, q = np.asarray(p, dtype=float), np.asarray(q, dtype=float)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(parts / 2, 0.0)))


def _counted(docs: DataFrame, run) -> DataFrame:
    """(lang, kind, name, n) summed over what `run` gives for each part."""
    parts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = parts.mapInArrow(run, "lang string, kind string, name binary, n bigint")
    return rows.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, Reference]:
    """The languages' histograms over all of docs (columns lang and text; null languages and texts don't count)."""
    common, flush = limits.common, 200_000

    def survey(batches: Iterator) -> Iterator:
        words: dict[str, Counter] = {}
        classes: dict[str, object] = {}
        rows: list = []

        def close(lang: str) -> None:
            seen = words.pop(lang)
            total = sum(seen.values())
            rows.append((lang, "words", b"", total))
            rows.extend((lang, "candidate", w, n) for w, n in seen.items() if n >= common * total)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                if lang is None or text is None:
                    continue
                words.setdefault(lang, Counter()).update(plain_words(text))
                classes[lang] = classes.get(lang, 0) + class_counts(text)
                if len(words[lang]) > flush:
                    close(lang)
            yield from _rows(rows)
        for lang in list(words):
            close(lang)
        rows.extend((lang, "class", str(i).encode(), int(n)) for lang, counts in classes.items() for i, n in enumerate(counts))
        yield from _rows(rows)

    first = stored(_counted(docs, survey), "survey")
    totals = {r["lang"]: r["n"] for r in first.filter("kind = 'words'").orderBy(F.desc("n")).limit(limits.languages).collect()}
    everything = first.filter("kind = 'words'").agg(F.sum("n")).first()[0] or 0
    known = [lang for lang, n in totals.items() if n and n >= min(limits.language * everything, limits.language_words)]
    of_known = first.filter(F.col("lang").isin(known))
    candidates: dict[str, set[bytes]] = {lang: set() for lang in known}
    for r in of_known.filter("kind = 'candidate'").select("lang", "name").toLocalIterator():
        candidates[r["lang"]].add(bytes(r["name"]))
    classes = {lang: [0] * len(CLASSES) for lang in known}
    for r in of_known.filter("kind = 'class'").collect():
        classes[r["lang"]][int(bytes(r["name"]))] = r["n"]

    def count(batches: Iterator) -> Iterator:
        found: dict[str, Counter] = {lang: Counter() for lang in candidates}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                if lang in found and text is not None:
                    found[lang].update(filter(candidates[lang].__contains__, plain_words(text)))
        yield from _rows([(lang, "word", w, n) for lang, c in found.items() for w, n in c.items()])

    shares: dict[str, dict[bytes, float]] = {lang: {} for lang in known}
    for r in _counted(docs, count).collect():
        if r["n"] >= common * totals[r["lang"]]:
            shares[r["lang"]][bytes(r["name"])] = r["n"] / totals[r["lang"]]
    return {lang: Reference(tuple(n / max(sum(classes[lang]), 1) for n in classes[lang]), shares[lang]) for lang in sorted(known)}


def _rows(rows: list) -> Iterator:
    """The gathered rows as one batch; the list is emptied."""
    import pyarrow as pa

    if rows:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        rows.clear()
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "name", "n"])


MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "class_distance double, word_distance double, nearest string, kept boolean"
)


def judge(docs: DataFrame, known: dict[str, Reference], limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the measures and `kept`; own columns with these names are replaced.

    A null text has no words and fails the base rules, as every text under `min_words` does. A distance
    that is not judged (text too short, no reference, or none of the language that the document names) is null and rejects
nothing; a document that names no language is judged by the nearest reference. The word distance compares the
    reference's common words and all others as one class.
    """
    import re

    names = [part.split()[0] for part in MEASURES.split(", ")]
    rest = docs.drop(*names)
    at = rest.columns.index(text)
    named = rest.columns.index(lang) if lang in rest.columns else None
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), MEASURES])
    languages = list(known)

    def measure(value: str | None, language: str | None, word) -> tuple:
        import numpy as np

        body = value or ""
        counts = base_counts(body, word)
        failed = counts[0] < limits.min_words or 100 * counts[4] > limits.max_repeated * counts[0]
        by_class = by_word = nearest = None
        judged = bool(known) and (language is None or language in known)
        if counts[0] >= limits.class_words and judged:
            own = class_counts(body)
            distances = [js_distance(own / own.sum(), known[x].classes) for x in languages]
            by_class, nearest = min(zip(distances, languages, strict=True))
        if counts[0] >= limits.word_words and judged:
            words = plain_words(body)
            seen, total = Counter(words), max(len(words), 1)
            distances = []
            for x in languages:
                shares = known[x].words
                p = np.array([seen[w] / total for w in shares] or [0.0])
                q = np.array(list(shares.values()) or [0.0])
                distances.append(js_distance(np.append(p, 1 - p.sum()), np.append(q, 1 - q.sum())))
            by_word, nearest = min(zip(distances, languages, strict=True))
        root = max(counts[0], 1) ** 0.5
        far = (by_class or 0) > limits.class_distance + limits.class_error / root or (by_word or 0) > limits.word_distance + limits.word_error / root
        return (*counts, failed, by_class, by_word, nearest, not failed and not far)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        word = re.compile(WORD)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
        for batch in batches:
            named_languages = [None] * batch.num_rows if named is None else [None if x is None else str(x) for x in batch.column(named).to_pylist()]
            found = [measure(t.as_py(), x, word) for t, x in zip(batch.column(at), named_languages, strict=True)]
            new = [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return rest.mapInArrow(run, schema)
