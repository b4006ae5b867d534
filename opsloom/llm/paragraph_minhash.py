"""Repeated passages by paragraph MinHash banding.

Paragraphs are taken at three scales. Two tolerate an edited word: whole lines, and within a line runs of
sentences that end with the first sentence of `SENTENCE` words or more, so that a passage is parted alike wherever it
stands. Each paragraph of `SENTENCE` words or more has a set of 5-word shingles and some minima of it.
The third needs no mark and no line end: windows of 2 * `HALF` words around the words whose hash is the least among their
neighbours, which the window's own words decide, so that a stretch has the same windows in any text. Two of them are the same or not (one band).

Paragraphs meet those of their own scale, in 8 bands of two minima: at a similarity of 0.8 they meet with a probability of 0.9997.
A line of one run takes part in both scales, so that it meets lines which differ by the mark of a sentence.
In a band, paragraphs in order are linked to the one before and to the first, a
row or two each and never all pairs; links are verified by exact Jaccard similarity over the shingles; verified
links make components. What bands leave uncompared, the members of a crowded one that are not neighbours in it, is then compared exactly:
two paragraphs at the similarity share one of their rarest shingles (prefix filter), and those of different components
that do are verified, so no link between paragraphs that bands have brought into question is lost. Each component keeps its first paragraph by document. A repeated window is extended on either side
by the words that it shares there with the kept one, in steps of `STEP` words. What is removed is
reported as passages: runs of removed paragraphs with at least `PASSAGE` words.
By simulation, one stretch of 50 random words in 1,250 holds no window, of 60 words one in 20,000; one that repeats itself
every `HALF` words or fewer may hold none of any length. A word changed inside a line parts a repeated stretch in two, each of which has to reach `PASSAGE` words.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.components import components
from opsloom.llm.decontamination import SHINGLE, STREAM
from opsloom.llm.tables import document_key
from opsloom.session import stored

SENTENCE = 8
PASSAGE = 30
#: Bands of two minima each.
BANDS = {"sentences": 8, "line": 8}
ROWS = 2
#: Words on either side of a window's middle.
HALF = 8
#: A window is compared with the kept one over up to `STEPS` times `STEP` words on either side, 16 bits of a hash a step.
STEP = 5
STEPS = 4
#: Each task tells of a paragraph until it has told of two texts; it remembers 2^18 paragraphs a scale, others it tells of again.
TOLD_BITS = 18
#: Bits of the maps that tell a task which paragraphs matter: 2 MB each, whatever the input. Beyond some
#: million paragraphs they let more rows pass, which the join after them drops.
MAP_BITS = 24
#: Low bits of a band's key that are zero, so that its rows take less room in the shuffle. Two bands of one key give more pairs to verify and lose none.
KEY_ZEROS = 24


class Sketcher:
    """Paragraphs of many texts at a time, as arrays."""

    def __init__(self, limit: int = 500_000):
        import numpy as np

        self.known: dict[bytes, int] = {}
        self.limit = limit
        self.factors = np.random.default_rng(5).integers(0, 1 << 63, ROWS * max(BANDS.values()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, dtype=np.uint64)

    def _hashes(self, words: list[bytes]):
        """A word's hash, the lowest bit telling whether it ends a sentence."""
        import numpy as np
        import xxhash

        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w) & ~1 | (w[-1] in b".!?")
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def paragraphs(self, texts: list[str]) -> Iterator[dict]:
        """For each scale the paragraphs of all texts: text, first word, words, id, minima and shingles."""
        import numpy as np

        words: list[bytes] = []
        line_sizes: list[int] = []
        lines_of: list[int] = []
        for text in texts:
            own = [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
            lines_of.append(len(own))
            for line in own:
                line_sizes.append(len(line))
                words += line
        if len(words) < SHINGLE:
            return
        stream = self._hashes(words)
        lines = np.array(line_sizes, dtype=np.int64)
        text_of_line = np.repeat(np.arange(len(texts)), lines_of)
        line_of_word = np.repeat(np.arange(len(lines)), lines)
        text_of_word = text_of_line[line_of_word]
        text_sizes = np.bincount(text_of_word, minlength=len(texts))
        text_starts = np.cumsum(text_sizes) - text_sizes
        line_ends = np.cumsum(lines)[lines > 0]
        # Sentences end at marks and line ends; a run ends with a sentence that is long enough, or its line.
        sentence_ends = np.union1d(np.nonzero(stream & np.uint64(1))[0] + 1, line_ends)
        long_enough = np.diff(sentence_ends, prepend=0) >= SENTENCE
        run_ends = np.union1d(sentence_ends[long_enough], line_ends)

        yield from self._windows(stream, text_of_word, text_starts, text_starts + text_sizes)

        n = len(stream) - SHINGLE + 1
        shingle = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + stream[k : k + n]
        shingle ^= shingle >> np.uint64(31)
        shingle *= np.uint64(0xBF58476D1CE4E5B9)
        shingle ^= shingle >> np.uint64(29)

        for kind, ends in (("sentences", run_ends), ("line", line_ends)):
            starts = np.concatenate([[0], ends[:-1]])
            sizes = ends - starts
            owner = np.repeat(np.arange(len(ends)), sizes)
            while len(self.powers) < sizes.max():
                self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(0x9E3779B97F4A7C15, len(self.powers), 1 << 64))])
            place = np.arange(len(stream)) - starts[owner]
            ids = np.add.reduceat(stream * self.powers[place], starts) + sizes.astype(np.uint64)
            ids = (ids ^ (ids >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            good = sizes >= SENTENCE
            if not good.any():
                continue
            inside = good[owner[:n]] & (owner[:n] == owner[SHINGLE - 1 :])
            own = shingle[inside]
            counts = sizes[good] - SHINGLE + 1
            first = np.cumsum(counts) - counts
            text = text_of_word[starts[good]]
            yield {
                "kind": kind,
                "text": text,
                "start": starts[good] - text_starts[text],
                "size": sizes[good],
                "id": ids[good].view(np.int64),
                "minima": lambda own=own, first=first, kind=kind: [np.minimum.reduceat(own * f, first) for f in self.factors[: ROWS * BANDS[kind]]],
                "shingles": lambda k, own=own, first=first, counts=counts: own[first[k] : first[k] + counts[k]],
            }


    def _windows(self, stream, text_of_word, text_starts, text_ends) -> Iterator[dict]:
        """The windows of all texts, with what tells the words on either side."""
        import numpy as np

        if len(stream) < 2 * HALF:
            return
        two = stream[:-1] * np.uint64(0x9E3779B97F4A7C15) + stream[1:]
        two = (two ^ (two >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        two ^= two >> np.uint64(29)
        side = HALF - 1
        # two[i] ends with word i + 1; the middle's is the least of the window, the first one among equals.
        middle = two[side : len(two) - side]
        least = np.ones(len(middle), dtype=bool)
        for k in range(1, HALF):
            least &= middle < two[side - k : len(two) - side - k]
            least &= middle <= two[side + k : len(two) - side + k]
        starts = np.nonzero(least)[0]
        starts = starts[text_of_word[starts] == text_of_word[starts + 2 * HALF - 1]]
        if not len(starts):
            return
        ids = np.full(len(starts), 3, dtype=np.uint64)
        for k in range(2 * HALF):
            ids = ids * np.uint64(0x9E3779B97F4A7C15) + stream[starts + k]
        ids = (ids ^ (ids >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        text = text_of_word[starts]

        def sides(at):
            """Of some windows, the hashes of the words before and of those after, a step in 16 bits from the lowest on, 0 beyond the text."""
            out = []
            for step, edge in ((-1, starts[at] - 1), (1, starts[at] + 2 * HALF)):
                hashed = np.zeros(len(at), dtype=np.uint64)
                told = np.zeros(len(at), dtype=np.uint64)
                for k in range(STEP * STEPS):
                    place = edge + step * k
                    inside = (place >= text_starts[text[at]]) & (place < text_ends[text[at]])
                    hashed = (hashed ^ stream[np.where(inside, place, 0)]) * np.uint64(0x9E3779B97F4A7C15)
                    hashed ^= hashed >> np.uint64(32)
                    if k % STEP == STEP - 1:
                        bits = np.maximum(hashed & np.uint64(0xFFFF), np.uint64(1)) * inside.astype(np.uint64)
                        told |= bits << np.uint64(16 * (k // STEP))
                out.append(told.view(np.int64))
            return out

        yield {
            "kind": "window",
            "text": text,
            "start": starts - text_starts[text],
            "size": np.full(len(starts), 2 * HALF, dtype=np.int64),
            "id": ids.view(np.int64),
            "sides": sides,
        }


def _streams(batch) -> Iterator[tuple[int, list[str]]]:
    """The batch's texts (its last column) in groups of about `STREAM` words, each with its first row's number."""
    texts: list[str] = []
    first = size = 0
    for i, body in enumerate(batch.column(batch.num_columns - 1)):
        texts.append(body.as_py() or "")
        size += len(texts[-1])
        if size >= 6 * STREAM or i == batch.num_rows - 1:
            yield first, texts
            texts, first, size = [], i + 1, 0


def bands(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, id, n): each paragraph's band keys, with the number of texts, summed up before they leave the task.

    A task tells of a paragraph that many texts hold until it has told of two, as more change nothing.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sketcher = Sketcher()
        told = {kind: (np.zeros(1 << TOLD_BITS, dtype=np.int64), np.zeros(1 << TOLD_BITS, dtype=np.int64)) for kind in (*BANDS, "window")}
        for batch in batches:
            for _, texts in _streams(batch):
                for p in sketcher.paragraphs(texts):
                    _, once = np.unique(p["id"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + p["text"].astype(np.uint64), return_index=True)
                    ids, at, n = np.unique(p["id"][once], return_index=True, return_counts=True)
                    known, times = told[p["kind"]]
                    slot = ids & ((1 << TOLD_BITS) - 1)
                    before = np.where(known[slot] == ids, times[slot], 0)
                    known[slot], times[slot] = ids, before + n
                    ids, at, n = (a[before < 2] for a in (ids, at, n))
                    if not len(ids):
                        continue
                    if p["kind"] == "window":
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(n)], names=["key", "id", "n"])
                        continue
                    minima = [m[once][at] for m in p["minima"]()]
                    salt = 1 << 32 if p["kind"] == "line" else 0  # a line must not meet its own sentences
                    keys = []
                    for j in range(0, len(minima), ROWS):
                        mixed = np.full(len(ids), salt + j, dtype=np.uint64)
                        for m in minima[j : j + ROWS]:
                            mixed = (mixed ^ m) * np.uint64(0xBF58476D1CE4E5B9)
                            mixed ^= mixed >> np.uint64(29)
                        keys.append((mixed >> np.uint64(KEY_ZEROS) << np.uint64(KEY_ZEROS)).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.tile(ids, len(keys))), pa.array(np.tile(n, len(keys)))], names=["key", "id", "n"]
                    )

    return docs.select(F.col(text).cast("string").alias("body")).mapInArrow(run, "key bigint, id bigint, n bigint")


def meetings(found: DataFrame) -> DataFrame:
    """Distinct (a, b): paragraphs that meet in a band; (a, a) for one that stands in two or more texts."""
    in_band = Window.partitionBy("key").orderBy("id")
    before, first = F.lag("id").over(in_band), F.first("id").over(in_band.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.select("id", "n", before.alias("before"), first.alias("first")).filter(F.col("before").isNotNull() | (F.col("n") > 1))
    others = F.array(F.when(F.col("n") > 1, F.col("id")), F.col("before"), F.when(F.col("before").isNotNull(), F.col("first")))
    return rows.select(F.col("id").alias("a"), F.explode(F.array_distinct(others)).alias("b")).filter(F.col("b").isNotNull()).distinct()


def bit_map(ids: DataFrame):
    """A map of the ids (column id) of 2^`MAP_BITS` bits, put together by Spark; the driver gets this much at most."""
    import numpy as np

    slot = F.col("id").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = ids.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


OCCURRENCE = "doc_id bigint, doc_key bigint, kind string, start bigint, size bigint, id bigint, before bigint, after bigint, shingles array<bigint>"


def occurrences(docs: DataFrame, active: DataFrame, fuzzy: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where the active paragraphs stand, the fuzzy ones with their shingles (once a task and scale at least)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((bit_map(active), bit_map(fuzzy)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sketcher, (wanted, compared) = Sketcher(), sent.value
        given: set[tuple[str, int]] = set()

        def marked(bits, ids):
            slot = ids & ((1 << MAP_BITS) - 1)
            return (bits[slot >> 6] >> (ids & 63)) & 1 == 1

        for batch in batches:
            for first, texts in _streams(batch):
                for p in sketcher.paragraphs(texts):
                    at = np.nonzero(marked(wanted, p["id"]))[0]
                    if not len(at):
                        continue
                    ids = p["id"][at]
                    lists: list = [None] * len(at)
                    window = p["kind"] == "window"
                    before, after = p["sides"](at) if window else (np.zeros(len(at), dtype=np.int64),) * 2
                    for k in [] if window else np.nonzero(marked(compared, ids))[0].tolist():
                        if (p["kind"], int(ids[k])) not in given:
                            if len(given) > 1_000_000:
                                given.clear()
                            given.add((p["kind"], int(ids[k])))
                            lists[k] = np.unique(p["shingles"](at[k])).view(np.int64)
                    rows = pa.array(p["text"][at] + first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            batch.column(1).take(rows),
                            pa.repeat(p["kind"], len(at)),
                            pa.array(p["start"][at]),
                            pa.array(p["size"][at]),
                            pa.array(ids),
                            pa.array(before),
                            pa.array(after),
                            pa.nulls(len(at), pa.list_(pa.int64())) if window else pa.array(lists, pa.list_(pa.int64())),
                        ],
                        names=[c.split()[0] for c in OCCURRENCE.split(", ")],
                    )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("body"))
    keyed = rows.select("doc_id", document_key("doc_id", "body").alias("doc_key"), "body")
    return keyed.mapInArrow(run, OCCURRENCE).join(active, "id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, shingles) have a Jaccard similarity of at least `least`."""
    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return with_sets.filter(shared >= least * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def uncompared(sets: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) of sets (id, kinds, root, shingles) of one scale and different roots that may have a similarity of `least`.

    Two sets of n and m shingles at that similarity share `least` * n and `least` * m at least, so in any one order of all shingles they share one of the first
    n - `least` * n + 1 of each. The order is from the rarest on: what many share stands last. Sets of one root, such as
    the copies of a passage with small edits, make no rows.
    """
    each = sets.select("id", "root", F.size("shingles").alias("size"), "kinds", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("id").orderBy("often", "shingle")
    needed = F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9))
    first = each.join(often, "shingle").withColumn("at", F.row_number().over(rarest)).filter(F.col("at") <= F.col("size") - needed + 1)
    # one that a single set has brings nobody together
    told = stored(first.filter(F.col("often") > 1).select("id", "root", "size", "shingle", "at", F.explode("kinds").alias("kind")), "told")
    one = told.select("kind", "shingle", F.col("id").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"), F.col("at").alias("at_a"))
    two = told.select("kind", "shingle", F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"))
    met = one.join(two, ["kind", "shingle"]).filter(F.col("root_a") < F.col("root_b"))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    # the first shingle that they share leaves what stands after it in both, which has to be enough
    most = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + 1
    enough = most + 1e-6 >= (F.col("size_a") + F.col("size_b")) * F.lit(least / (1 + least))
    return met.filter((small + 1e-6 >= large * F.lit(least)) & enough).select("a", "b").distinct()


def classes(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(id, root) of the sets (id, kinds, shingles) that are alike: by the pairs (a, b) that have met, then by all others."""
    roots = stored(components(verified(pairs, sets, least)).withColumnRenamed("node", "id"), "roots")
    rooted = stored(sets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "classed")
    more = stored(verified(uncompared(rooted, least), sets, least), "more")
    of = rooted.select("id", "root")
    edges = more.join(of.toDF("a", "root_a"), "a").join(of.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    joined = stored(components(edges).toDF("root", "least"), "joined")
    return of.join(joined, "root", "left").select("id", F.coalesce("least", "root").alias("root"))


def shared_words(a: Column, b: Column) -> Column:
    """How many words next to two windows are the same: whole steps from the window on, as `sides` tells them."""
    same = F.lit(0)
    for k in reversed(range(STEPS)):
        ones = F.lit(0xFFFF << 16 * k if k < 3 else -(1 << 48)).cast("bigint")
        equal = (a.bitwiseXOR(b).bitwiseAND(ones) == 0) & (a.bitwiseAND(ones) != 0)
        same = F.when(equal, same + STEP).otherwise(0)
    return same


def repeated_passages(docs: DataFrame, least: float = 0.8, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage that repeats one of an earlier document; repeats within a document are left alone.

    doc_id, doc_key, first_word and n_words of the passage, component_id (its first paragraph's) and kept_doc_id, the
    document that keeps it. Words are parted by ASCII white space and A-Z lower-cased. Documents go by id, then by
    their texts' hash; rows equal in both are one document. A null text has no paragraphs; null ids go
    first; other columns are ignored. Paragraphs' ids are 64-bit hashes of their words.
    """
    met = stored(meetings(bands(docs, text)), "meetings")
    pairs = met.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fuzzy = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    active = stored(met.select(F.col("a").alias("id")).union(met.select("b")).distinct(), "active")
    where = stored(occurrences(docs, active, fuzzy, doc_id, text), "occurrences")
    sets = stored(where.filter("shingles is not null").groupBy("id").agg(F.first("shingles").alias("shingles"), F.collect_set("kind").alias("kinds")), "sets")
    roots = stored(classes(pairs, sets, least), "roots")
    rooted = stored(where.drop("shingles").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    place = F.struct("doc_id", "doc_key", "start", "before", "after")
    keepers = stored(rooted.groupBy("root").agg(F.min(place).alias("kept"), F.max(place).alias("last")).filter("kept.doc_key != last.doc_key"), "keepers")
    removed = rooted.join(keepers, "root").filter(F.col("kept.doc_key") != F.col("doc_key"))
    left, right = (shared_words(F.col(side), F.col(f"kept.{side}")) for side in ("before", "after"))
    removed = removed.select("*", left.alias("_left"), right.alias("_right"))
    removed = removed.withColumns({"start": F.col("start") - F.col("_left"), "size": F.col("size") + F.col("_left") + F.col("_right")})
    # Runs of removed words: a paragraph that begins after all earlier ones have ended opens a new one.
    by_place = Window.partitionBy("doc_key").orderBy("start", "size", "kind")
    reach = F.max(F.col("start") + F.col("size")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opened = removed.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("doc_key", "run")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("first_word"),
            (F.max(F.col("start") + F.col("size")) - F.min("start")).alias("n_words"),
            F.min_by("root", F.struct("start", "size", "kind")).alias("component_id"),
            F.min_by("kept.doc_id", F.struct("start", "size", "kind")).alias("kept_doc_id"),
        )
        .filter(F.col("n_words") >= passage)
        .select("doc_id", "doc_key", "first_word", "n_words", "component_id", "kept_doc_id")
    )
