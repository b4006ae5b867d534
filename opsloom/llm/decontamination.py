"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of an item and a whole document that contains
it is small and differs with the document's length. Therefore items are partitioned by size (LSH Ensemble, Zhu et
al., 2016): an item of at most Q shingles, Q a power of two, is searched in windows of two neighbouring blocks of Q
shingles, in one of which a passage of up to Q lies whole. With a containment of 0.8 the item and that window
have a Jaccard similarity of 0.19 or more, and of `PERMUTATIONS` = 32 minima at least one agrees with a probability
of 0.9988 or more. Items of up to `FEW` shingles are too small for such windows; they are looked up by each of their
shingles, and none is missed. Candidates are verified by the exact share of the item's shingles in the whole document.

The items are the query set. They go to the tasks in blocks of a bounded number of shingles, each block in one pass
over all documents; nothing is shuffled, and a passage that many documents share costs each of them its own check.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tables import plain_words

SHINGLE = 5
PERMUTATIONS = 32
#: Items of so many shingles or fewer are looked up without minima; the least size class begins above.
FEW = 4
#: Shingles of items in a block that each task holds: 8 bytes each, and `PERMUTATIONS` minima an item.
BLOCK_SHINGLES = 1 << 20
BLOCK_ITEMS = 1 << 15
#: Words that are worked on at a time, unless one text has more.
STREAM = 1 << 17
FOUND = "array<struct<item_id: bigint, n_shared: bigint, n_shingles: bigint>>"


class Hasher:
    """64-bit hashes of word shingles, many texts at a time. The cache only saves time."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def words(self, words: list[bytes]):
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
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, texts: list[list[bytes]]):
        """The shingles' hashes of all texts in turn, and how many each text has."""
        import numpy as np

        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        stream = self.words([w for t in texts for w in t])
        counts = np.maximum(sizes - SHINGLE + 1, 0)
        if not counts.sum():
            return np.zeros(0, dtype=np.uint64), counts
        n = len(stream) - SHINGLE + 1
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + stream[k : k + n]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        owner = np.repeat(np.arange(len(texts)), sizes)
        return mixed[owner[:n] == owner[SHINGLE - 1 :]], counts


def permutations():
    """Odd multipliers, fixed, so that minima agree between runs."""
    import numpy as np

    return np.random.default_rng(8).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def size_class(n: int) -> int:
    """The least power of two, 8 or more, that is not less than n."""
    return max(8, 1 << (n - 1).bit_length())


class Items:
    """A block of items: their shingles, and their minima by size class."""

    def __init__(self, rows: list[tuple[int, object]]):
        import numpy as np

        self.ids = [i for i, _ in rows]
        self.shingles = [s for _, s in rows]
        factors = permutations()
        by_class: dict[int, list[int]] = {}
        few = [(s, k) for k, own in enumerate(self.shingles) if len(own) <= FEW for s in own.tolist()]
        self.few = np.array(sorted({s for s, _ in few}), dtype=np.uint64)
        self.few_items: list[list[int]] = [[] for _ in self.few]
        for s, k in few:
            self.few_items[int(np.searchsorted(self.few, np.uint64(s)))].append(k)
        for k, s in enumerate(self.shingles):
            if len(s) <= FEW:
                continue
            by_class.setdefault(size_class(len(s)), []).append(k)
        self.classes = {}
        for q, members in sorted(by_class.items()):
            minima = np.array([[int((self.shingles[k] * f).min()) for f in factors] for k in members], dtype=np.uint64)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(minima & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            order = [np.argsort(minima[:, j], kind="stable") for j in range(PERMUTATIONS)]
            self.classes[q] = (seen, [minima[o, j] for j, o in enumerate(order)], [np.array(members)[o] for o in order])

    def candidates(self, stream, counts) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window and the item share a minimum, or the text and a small item a shingle."""
        import numpy as np

        if not len(stream):
            return set()
        out: set[tuple[int, int]] = set()
        if len(self.few):
            near = np.minimum(np.searchsorted(self.few, stream), len(self.few) - 1)
            at = np.nonzero(self.few[near] == stream)[0]
            texts = np.searchsorted(np.cumsum(counts), at, "right")
            for text, s in set(zip(texts.tolist(), near[at].tolist(), strict=True)):
                out.update((text, k) for k in self.few_items[s])
        factors, base = permutations(), min(self.classes, default=0)
        level, owner, minima = None, None, None
        for q in sorted(self.classes):
            if level is None:
                blocks = -(-counts // base)
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                starts = np.repeat(first, blocks) + base * _within(blocks)
                minima = np.array([np.minimum.reduceat(stream * f, starts) for f in factors])
                owner, level = np.repeat(np.arange(len(counts)), blocks), base
            if q > level:
                step = q // level
                now = np.bincount(owner, minlength=len(counts))
                blocks = -(-now // step)
                first = np.concatenate([[0], np.cumsum(now)[:-1]])
                starts = np.repeat(first, blocks) + step * _within(blocks)
                minima = np.minimum.reduceat(minima, starts, axis=1)
                owner, level = np.repeat(np.arange(len(counts)), blocks), q
            windows = minima.copy()
            same = owner[:-1] == owner[1:]
            windows[:, :-1] = np.where(same, np.minimum(minima[:, :-1], minima[:, 1:]), minima[:, :-1])
            seen, values, members = self.classes[q]
            js, ws = np.nonzero(seen[(windows & np.uint64((1 << 20) - 1)).astype(np.int64)])
            for j in np.unique(js).tolist():
                at = ws[js == j]
                wanted = windows[j, at]
                low, high = np.searchsorted(values[j], wanted, "left"), np.searchsorted(values[j], wanted, "right")
                for w, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    out.update((int(owner[w]), int(k)) for k in members[j][a:b])
        return out

    def found(self, stream, counts, least: float) -> dict[int, list[tuple[int, int, int]]]:
        """For each text that contains items: (item id, shared shingles, shingles)."""
        import numpy as np

        ends = np.cumsum(counts)
        out: dict[int, list[tuple[int, int, int]]] = {}
        own, last = None, None
        for text, k in sorted(self.candidates(stream, counts)):
            if text != last:
                own, last = stream[ends[text] - counts[text] : ends[text]], text
            shared = int(np.isin(self.shingles[k], own).sum())
            if shared >= least * len(self.shingles[k]):
                out.setdefault(text, []).append((self.ids[k], shared, len(self.shingles[k])))
        return out


def _within(sizes):
    """0, 1, ... anew for each of the sizes."""
    import numpy as np

    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, object]]]:
    """The items' distinct shingles in blocks of bounded size; a longer item is a block of its own."""
    import numpy as np

    hasher, block, held = Hasher(), [], 0
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    for row in rows.toLocalIterator():
        own = np.unique(hasher.shingles([plain_words(row["t"])])[0])
        if not len(own):
            continue
        if block and (held + len(own) > BLOCK_SHINGLES or len(block) >= BLOCK_ITEMS):
            yield block
            block, held = [], 0
        block.append((row["i"], own))
        held += len(own)
    if block:
        yield block


def with_items(docs: DataFrame, items: DataFrame, least: float = 0.8, item_id: str = "item_id", doc_text: str = "text", item_text: str = "text") -> DataFrame:
    """docs with `found`: the items of which the text contains at least `least` of the 5-word shingles.

    Words are lower-cased (A-Z) and parted by all ASCII marks. Every row is searched, over its whole text. A null or
    short text contains nothing; items without an id, a text or five words are not searched for; repeated items
    count once; an own column named found is replaced; no items give empty lists.
    """
    none = F.array().cast(FOUND)
    out = docs.drop("found").withColumn("found", none)
    at = out.columns.index(doc_text)
    spark = docs.sparkSession

    for block in item_blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            wanted, hasher = Items(sent.value), Hasher()
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())]))
            for batch in batches:
                lists: list = batch.column(batch.num_columns - 1).to_pylist()
                texts: list = []
                first = words = 0
                for i, body in enumerate(batch.column(at)):
                    texts.append(plain_words(body.as_py() or ""))
                    words += len(texts[-1])
                    if words >= STREAM or i == batch.num_rows - 1:
                        for k, hits in wanted.found(*hasher.shingles(texts), least).items():
                            lists[first + k] = lists[first + k] + [dict(zip(("item_id", "n_shared", "n_shingles"), h, strict=True)) for h in hits]
                        texts, first, words = [], i + 1, 0
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lists, kind)], names=batch.schema.names)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = out.mapInArrow(run, schema)
    return out
