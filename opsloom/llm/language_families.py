"""Language identification by hierarchical discrimination.

Languages are grouped into families by how alike their mean n-gram profiles are. A document's family is predicted first, by linear
support vector machines of each family against the rest; within the family every two languages have a
linear support vector machine of their own, and the language that wins most of these duels is the prediction.

Features are hashed n-grams of two to five UTF-8 bytes of the whole text's letters (lower case, everything else one
space), as square roots of their shares. The machines are fitted on a bounded sample of labelled documents (`Limits.sample` of a language, taken by
the hash of their texts, so that copies count once); each is fitted in a task of its own. Everything else reads all documents.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators.rows import top_n_per_key
from opsloom.session import stored

UNKNOWN = "und"
DIMS = 1 << 13
GRAMS = (2, 3, 4, 5)
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 18


@dataclasses.dataclass(frozen=True)
class Limits:
    """Bounds of the fit: documents of a language in the sample, documents on each side of a family's machine, languages
    learned (those of most documents) and languages of a family. The models are at most languages * (1 + widest / 2) rows of `DIMS` numbers.
    """

    sample: int = 400
    side: int = 1200
    languages: int = 256
    widest: int = 12
    epochs: int = 30
    cost: float = 10.0


_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    """The text's letters in lower case, in UTF-8; everything else, one space a run; a space at both ends."""
    plain = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    return b" " + b" ".join(plain.split()) + b" "


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def profile(text: str):
    """The square roots of the n-grams' shares: a vector of length 1, or of zeros."""
    import numpy as np

    codes = np.frombuffer(letters(text), dtype=np.uint8)
    counts = np.zeros(DIMS)
    longest = max(GRAMS)
    for start in range(0, len(codes), PIECE):
        # A piece reaches into the next one by one byte less than the longest n-gram: each n-gram starts in one piece.
        piece = codes[start : start + PIECE + longest - 1].astype(np.uint32)
        rolling = piece.copy()
        for n in range(2, longest + 1):
            if len(piece) < n:
                break
            rolling = rolling[:-1] * np.uint32(257) + piece[n - 1 :]
            if n in GRAMS:
                slots = ((rolling[:PIECE] + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - DIMS.bit_length() + 1)
                counts += np.bincount(slots, minlength=DIMS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def machine(vectors, sides, epochs: int, cost: float):
    """Weights, the last one a bias, of a linear support vector machine with squared hinge loss, by dual coordinate descent.

    C.-J. Hsieh et al., A Dual Coordinate Descent Method for Large-scale Linear SVM, 2008. `sides` are 1 and -1.
    The cost of each side is weighted by its size, the order of the rows in an epoch is fixed.
    """
    import numpy as np

    rows = np.ones((len(vectors), len(vectors[0]) + 1), dtype=np.float32)
    for i, v in enumerate(vectors):
        rows[i, :-1] = v
    weight = {s: len(sides) / (2 * max(1, int((sides == s).sum()))) for s in (1, -1)}
    slack = np.array([1 / (2 * cost * weight[int(s)]) for s in sides])
    norms = np.einsum("ij,ij->i", rows, rows) + slack
    alpha, w = np.zeros(len(rows)), np.zeros(rows.shape[1])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = sides[i] * (rows[i] @ w) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - gradient / norms[i], 0.0)
            change = new - alpha[i]
            if change:
                alpha[i] = new
                w += change * sides[i] * rows[i]
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return w


@dataclasses.dataclass(frozen=True)
class Discriminator:
    """Families of languages, and the machines' weights as rows of one matrix: a family against the rest each, where
    there are several, then a pair of languages each."""

    families: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[str, str], ...]
    weights: object

    def predict(self, vectors):
        """(language, score, family) of each row.

        The score is the share of the family among the families' logistic values times the least logistic value of
        the language's duels.
        """
        import numpy as np

        values = vectors @ self.weights[:, :-1].T + self.weights[:, -1]
        likely = 1 / (1 + np.exp(-np.clip(2 * values, -60, 60)))
        several = len(self.families) > 1
        family_values = likely[:, : len(self.families)] if several else np.ones((len(vectors), 1))
        family = family_values.argmax(axis=1)
        family_share = family_values.max(axis=1) / family_values.sum(axis=1)
        first = len(self.families) if several else 0
        at = {pair: first + k for k, pair in enumerate(self.pairs)}
        out: list = [None] * len(vectors)
        for k, members in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if not len(rows):
                continue
            # One language's chance against each other, ones against itself.
            duels = np.ones((len(rows), len(members), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    chance = likely[rows, at[a, members[j]]]
                    duels[:, i, j], duels[:, j, i] = chance, 1 - chance
            wins = (duels > 0.5).sum(axis=2) + duels.mean(axis=2) / 2
            best = wins.argmax(axis=1)
            least = duels.min(axis=2)[np.arange(len(rows)), best]
            for r, b, s in zip(rows.tolist(), best.tolist(), (least * family_share[rows]).tolist(), strict=True):
                out[r] = (members[b], s, "+".join(members))
        return out


def grouped(names: list[str], means, widest: int) -> tuple[tuple[str, ...], ...]:
    """Families: the two groups whose languages are most alike on average are joined, as long as they are more alike than
    the mean pair of languages and not more than `widest` together."""
    import numpy as np

    length = np.linalg.norm(means, axis=1, keepdims=True)
    alike = (means / np.maximum(length, 1e-12)) @ (means / np.maximum(length, 1e-12)).T
    n = len(names)
    if n < 2:
        return (tuple(names),) if names else ()
    mean = (alike.sum() - np.trace(alike)) / (n * (n - 1))
    groups = [[i] for i in range(n)]
    while True:
        best = None
        for x in range(len(groups)):
            for y in range(x + 1, len(groups)):
                value = alike[np.ix_(groups[x], groups[y])].mean()
                if value > mean and len(groups[x]) + len(groups[y]) <= widest and (best is None or value > best[0]):
                    best = (value, x, y)
        if best is None:
            break
        _, x, y = best
        groups[x] += groups.pop(y)
    return tuple(sorted(tuple(names[i] for i in sorted(g)) for g in groups))


def _sample(labelled: DataFrame, limits: Limits) -> DataFrame:
    """(lang, hash, features): `limits.sample` different texts of each learned language, with their vectors."""
    named = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    keys = stored(named.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n")), "keys")
    learned = keys.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(limits.languages)
    chosen = top_n_per_key(keys.join(F.broadcast(learned.select("lang")), "lang", "left_semi"), ["lang"], [F.col("hash")], limits.sample)
    picked = named.join(stored(chosen, "chosen"), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"])

    def vectors(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = [profile(t).astype(np.float32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "hash": batch["hash"], "features": rows})

    return picked.select("lang", "hash", "text").mapInPandas(vectors, "lang string, hash bigint, features binary")


def fit(labelled: DataFrame, limits: Limits | None = None) -> Discriminator | None:
    """The machines learned from (text, lang) rows; None where no row has a language and a letter.

    Texts are taken in the order of their hash, so the fit does not depend on how rows are spread; a text with two languages is
    in both samples.
    """
    import numpy as np
    import pandas as pd

    limits = limits or Limits()
    sample = stored(_sample(labelled, limits), "sample")

    def mean(key, rows):
        middle = np.stack([np.frombuffer(f, np.float32) for f in rows["features"]]).mean(axis=0)
        return pd.DataFrame({"lang": [key[0]], "mean": [middle.astype(np.float32).tobytes()]})

    # At most `limits.languages` rows of DIMS numbers.
    found = sorted(sample.groupBy("lang").applyInPandas(mean, "lang string, mean binary").collect())
    if not found:
        return None
    names = [r["lang"] for r in found]
    families = grouped(names, np.stack([np.frombuffer(r["mean"], np.float32) for r in found]).astype(float), limits.widest)
    pairs = [(a, b) for members in families for i, a in enumerate(members) for b in members[i + 1 :]]
    tasks = [(len(families) + k, a, 1, 0) for k, (a, _) in enumerate(pairs)] + [(len(families) + k, b, -1, 0) for k, (_, b) in enumerate(pairs)]
    if len(families) > 1:
        for k, members in enumerate(families):
            tasks += [(k, name, 1 if name in members else -1, -(-limits.side // (len(members) if name in members else len(names) - len(members)))) for name in names]
    if not tasks:
        return Discriminator(families, (), np.zeros((0, DIMS + 1)))
    sides = sample.sparkSession.createDataFrame(tasks, "machine bigint, lang string, side int, most int")
    ranked = top_n_per_key(sample, ["lang"], [F.col("hash")], limits.sample, "rank")
    rows = ranked.join(F.broadcast(sides), "lang").where((F.col("most") == 0) | (F.col("rank") <= F.col("most")))

    def fitted(key, rows):
        rows = rows.sort_values(["side", "lang", "hash"])
        vectors = [np.frombuffer(f, np.float32) for f in rows["features"]]
        w = machine(vectors, rows["side"].to_numpy(dtype=float), limits.epochs, limits.cost)
        return pd.DataFrame({"machine": [key[0]], "weights": [w.tobytes()]})

    # One row per machine, see Limits.
    columns = rows.select("machine", "side", "lang", "hash", "features")
    machines = sorted(columns.groupBy("machine").applyInPandas(fitted, "machine bigint, weights binary").collect())
    return Discriminator(families, tuple(pairs), np.stack([np.frombuffer(m["weights"]) for m in machines]))


def identify(docs: DataFrame, model: Discriminator | None, text: str = "text") -> DataFrame:
    """docs with `lang_pred`, `score` (0 to 1) and `family` in place of the text column and of columns of those names.

    A null text, one without a letter and, without a model, any text is `und` with score 0 and no family. A model of one language predicts it with score 1. Repeated rows
    each give a row with the same prediction; of equal duels the first language by name wins.
    """
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score", "family")]

    def predicted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("_text")
            out: list = [(UNKNOWN, 0.0, None)] * batch.num_rows
            for start in range(0, batch.num_rows if model else 0, 256):
                block = {}
                for i in range(start, min(start + 256, batch.num_rows)):
                    value = texts[i].as_py()
                    if value is not None and has_letter(value):
                        block[i] = profile(value)
                if block:
                    for i, row in zip(block, model.predict(np.stack(list(block.values()))), strict=True):
                        out[i] = row
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "family"])

    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], "lang_pred string, score double, family string"])
    return given.mapInArrow(predicted, schema)
