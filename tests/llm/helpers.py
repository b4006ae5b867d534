"""Small document tables for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = ("an", "ber", "co", "dal", "en", "fir", "go", "hu", "il", "jo", "ka", "lem", "mon", "nu", "or", "pe", "ra", "si", "tu", "ve")


def prose(seed: int, words: int, line: int = 40) -> str:
    """Words of random syllables in sentences of 6 to 14 words and lines of about `line` words."""
    rng = random.Random(seed)
    out, left, on_line = [], 0, 0
    for _ in range(words):
        if left == 0:
            left, first = rng.randint(6, 14), True
        word = rng.choice(("the", "of", "and", "to")) if rng.random() < 0.25 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
        left -= 1
        on_line += 1
        out.append(word.capitalize() if first else word)
        first = False
        if left == 0:
            out[-1] += "."
            if on_line >= line:
                out[-1] += "\n"
                on_line = 0
    return " ".join(out).replace("\n ", "\n").strip()


def table(spark, texts, lang="en", source="s", first_id=0):
    """A documents table of the texts, ids in order."""
    return spark.createDataFrame([(first_id + i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, repeated ids and repeated rows."""
    a, b = prose(1, 120), prose(2, 90)
    return [
        (0, a, "en", "s0", 1),
        (0, a, "en", "s0", 1),
        (0, b, "en", "s0", 1),
        (1, None, "en", "s1", None),
        (2, "", "en", "s1", 0),
        (3, " \n\t \n", None, None, None),
        (4, a, None, "s2", 5),
        (None, b, "fr", None, 6),
        (None, None, None, None, None),
        (5, "x" * 60_000, "en", "s3", 7),
        (6, "1" * 60_000 + " " + "a@" * 3000, "en", "s3", 8),
        (7, "the " * 20_000, "en", "s4", 9),
        (8, "Grüße 漢字 \U0001f600 naïve\r\nзначение", "de", "s4", 10),
        (9, prose(3, 3000), "en", "s5", 11),
    ]


def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(pairs, nodes):
    """The least node of each node's component."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs:
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}
