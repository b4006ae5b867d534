"""Compressed vector codes by memoised grid cells.

Vectors become whole numbers and are cut into parts; each part position has a codebook that a few rounds of
averaging refine. To find the nearest entry of a part, its coarse grid cell is looked up in a cache. A cell's cache
holds the entries that are not dominated across the cell's box: an entry goes if some other entry's
greatest distance to the box is below its own least distance, since it then is nearer to no point of the box. Only the
entries left are evaluated exactly. The cells' size changes the time, never a result.

A round is one pass over the stored vectors: tasks sum the parts of each entry and pass on one row per entry and
component, so the driver gets the codebooks and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.rows import join_unique
from opsloom.session import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Cells of one part position that a task keeps; a full cache starts anew.
CELLS = 1 << 15


class CellCache:
    """The nearest entry of a codebook (entries x width, whole numbers) by the cells of a grid of 2^bits."""

    def __init__(self, book, bits: int):
        self.book, self.bits = book, bits
        self.cells: dict[bytes, object] = {}
        self.evaluated = 0

    def _undominated(self, cells):
        """For each cell, which entries may be nearest to some point of its box."""
        import numpy as np

        low = (cells << self.bits)[:, None, :]
        high = low + ((1 << self.bits) - 1)
        below, above = low - self.book, self.book - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        greatest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        return least <= greatest.min(axis=1, keepdims=True)

    def _allowed(self, cells):
        """The entries of each cell (cells x entries), from the cache where it has them."""
        import numpy as np

        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in self.cells]
        if len(self.cells) + len(new) > CELLS:
            self.cells.clear()
            new = list(range(len(names)))
        if new:
            fresh = np.packbits(self._undominated(cells[new]), axis=1)
            self.cells.update((names[i], row) for i, row in zip(new, fresh, strict=True))
        return np.unpackbits(np.stack([self.cells[name] for name in names]), axis=1, count=len(self.book)).astype(bool)

    def nearest(self, parts):
        """(entry, squared distance) of each part (rows x width); equal distances go to the lower entry."""
        import numpy as np

        coarse = np.ascontiguousarray(parts >> self.bits)
        cells, cell_of = np.unique(coarse, axis=0, return_inverse=True)
        rows, entries = np.nonzero(self._allowed(cells)[cell_of.reshape(-1)])
        self.evaluated += len(rows)
        distance = ((parts[rows] - self.book[entries]) ** 2).sum(axis=1)
        # Candidates stand by row, then entry; each row has one at least.
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[rows])
        first = hit[np.r_[True, rows[hit][1:] != rows[hit][:-1]]]
        return entries[first], best


def _blocks(batches: Iterator, width: int, parts: int, step: int = 4096) -> Iterator:
    """(batch, first row, rows x parts x width) of Arrow batches with a column `numbers`, `step` rows at a time."""
    import numpy as np

    for batch in batches:
        numbers = batch.column("numbers")
        for start in range(0, batch.num_rows, step):
            piece = numbers.slice(start, step)
            yield batch, start, piece.flatten().to_numpy().astype(np.int64).reshape(len(piece), parts, width)


def assigned_sums(vectors: DataFrame, books, bits: int) -> DataFrame:
    """(part, entry, position, n, total): of each entry the number and the sums of the parts nearest to it."""
    parts, entries, width = books.shape

    def sums(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        caches = [CellCache(book, bits) for book in books]
        n = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=np.int64)
        for _, _, block in _blocks(batches, width, parts):
            for i, cache in enumerate(caches):
                entry, _ = cache.nearest(block[:, i])
                n[i] += np.bincount(entry, minlength=entries)
                np.add.at(total[i], entry, block[:, i])
        i, e, p = (x.ravel() for x in np.indices(total.shape))
        columns = [pa.array(x) for x in (i, e, p, n[i, e], total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "n", "total"])

    schema = "part bigint, entry bigint, position bigint, n bigint, total bigint"
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    return vectors.select("numbers").mapInArrow(sums, schema).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), exact)


def refined(vectors: DataFrame, books, bits: int, rounds: int):
    """The codebooks (parts x entries x width) after some rounds; entries that no part is nearest to stay."""
    for _ in range(rounds):
        books = books.copy()
        # parts x entries x width rows
        for r in assigned_sums(vectors, books, bits).where("n > 0").collect():
            books[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return books


def coded(vectors: DataFrame, books, bits: int) -> DataFrame:
    """vectors with `code` (two hex digits a part) and `error` in place of `numbers`."""
    parts, _, width = books.shape
    kept = [c for c in vectors.columns if c != "numbers"]

    def codes(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        caches = [CellCache(book, bits) for book in books]
        for batch, start, block in _blocks(batches, width, parts):
            found = [cache.nearest(block[:, i]) for i, cache in enumerate(caches)]
            digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            text = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            error = sum(distance for _, distance in found)
            piece = batch.slice(start, len(block))
            columns = [*[piece.column(c) for c in kept], pa.array(text, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "code", "error"])

    schema = ", ".join([*[f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in kept], "code string", "error bigint"])
    return vectors.mapInArrow(codes, schema)


def _whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def compressed(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    bits: int | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each usable row of df.

    Components become floor(scale * x). Each codebook starts with the parts of the `entries` (256 at most) least ids, fewer where there are fewer;
    nulls are the last id, an id of several rows stands for the least of their vectors. `label_error` sums the
    errors of equal labels, nulls together, and is null where the sum passes 64 bits.
    Rows go whose vector is null, holds a null or a component that is not finite, has another length than that of the least id or one that
    does not divide into the parts, or holds a number so large that a squared distance could pass 64 bits. Repeated rows each give a row;
    an empty table gives none; other columns are ignored. Without `bits` the grid's cells are about the mean size of a component.
    """
    import numpy as np

    given = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    given = given.where(F.col("vector").isNotNull() & finite & (F.size("vector") > 0))
    ids = given.where(F.size("vector") % parts == 0)
    least = ids.select(F.col("vec_id"), F.size("vector").alias("size")).orderBy(F.asc_nulls_last("vec_id"), "size").first()
    result = "vec_id bigint, label {}, code string, error bigint, label_error bigint, codebooks_sha256 string".format(given.schema["label"].dataType.simpleString())
    if least is None:
        return df.sparkSession.createDataFrame([], result)
    size = least["size"]
    # Two numbers of this size differ by twice as much; the squares of `size` differences add up to 2^62 at most.
    most = math.isqrt((1 << 62) // size) // 2
    small = F.forall("vector", lambda x: F.abs(x.cast("double") * scale) < float(min(most, (1 << 31) - 1)))
    vectors = stored(ids.where((F.size("vector") == size) & small).select("vec_id", "label", _whole(F.col("vector"), scale).alias("numbers")), "vectors")
    first = vectors.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries)
    starts = vectors.join(F.broadcast(first.withColumnRenamed("vec_id", "_id")), F.col("vec_id").eqNullSafe(F.col("_id")), "left_semi")
    rows = starts.groupBy("vec_id").agg(F.min("numbers").alias("numbers")).orderBy(F.asc_nulls_last("vec_id")).collect()  # `entries` at most
    if not rows:
        return df.sparkSession.createDataFrame([], result)
    width = size // parts
    books = np.array([r["numbers"] for r in rows], dtype=np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2)
    if bits is None:
        sizes = F.aggregate("numbers", F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
        mean = vectors.agg((F.avg(sizes) / size).alias("mean")).first()["mean"]
        bits = max(0, round(math.log2(max(1.0, mean))))
    books = refined(vectors, books, bits, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = stored(coded(vectors, books, bits), "codes")
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return join_unique(codes, sums, "label", "left").withColumn("codebooks_sha256", F.lit(digest))
