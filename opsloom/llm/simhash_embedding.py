"""SimHash near-duplicates through an embedding of segment popcounts.

A fingerprint of 64 bits becomes the vector of the bit counts of its 16 segments of 4 bits. Fingerprints that
differ in d bits have vectors at a Manhattan distance of at most d, so close fingerprints are found by a
grid range-join on the vectors: two vectors at distance 2 or less share a grid point at distance 1 or less from
both, so each fingerprint is put on its own point and the at most 32 next to it, and points are joined by
equality. Pairs that meet are then verified on the fingerprints themselves.

A point where more than two fingerprints meet gives no pairs: its fingerprints are verified through the
fingerprints between them. Two of them differ in 2 bits or fewer exactly if one that is at most one bit from either
exists; each names the 65 at most one bit away, and who names the same one is linked. At most 65 can name the same,
so rows grow with the number of fingerprints and no group is too large.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.components import components
from opsloom.llm.tables import document_key
from opsloom.session import stored

BITS = 64


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a UTF-8 text, as a signed number. Only A-Z are lower-cased; no words give zero."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    runs = zip(*[words[i:] for i in range(shingle)], strict=False) if len(words) >= shingle else [words]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(join(r), 42) for r in runs), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, doc_key, fp) of every row, from its whole text; null is the empty text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], names=["id", "doc_key", "fp"])

    body = F.encode(F.col(text).cast("string"), "UTF-8")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), document_key(doc_id, text).alias("doc_key"), body.alias("body"))
    return rows.mapInArrow(run, "id bigint, doc_key bigint, fp bigint")


def popcounts(fp: Column) -> Column:
    """The bit count of each 4-bit segment, in 4 bits of the result."""
    ones = F.lit(0x1111111111111111)
    out = fp.bitwiseAND(ones)
    for i in range(1, 4):
        out = out + F.shiftrightunsigned(fp, i).bitwiseAND(ones)
    return out


def grid_points(counts: Column) -> Column:
    """The vector and the vectors at Manhattan distance 1 from it, all counts within 0 to 4."""
    near = [counts]
    for i in range(BITS // 4):
        one, count = F.lit(1 << (4 * i)), F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15))
        near += [F.when(count < 4, counts + one), F.when(count > 0, counts - one)]
    return F.array(*near)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints (column fp, no repeats) 2 or fewer bits apart."""
    on_grid = fps.withColumn("counts", popcounts(F.col("fp"))).select("fp", F.explode(grid_points(F.col("counts"))).alias("point")).filter(F.col("point").isNotNull())
    points = stored(on_grid.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "points")
    pairs = points.filter(F.col("n") == 2).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b").distinct()
    crowded = points.filter(F.col("n") > 2).select("point")
    members = on_grid.join(crowded, "point").select("fp").distinct()
    between = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    named = members.select("fp", F.explode(between).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    first = named.withColumn("first", F.min("fp").over(Window.partitionBy("middle")))
    stars = first.filter(F.col("fp") != F.col("first")).select(F.col("fp").alias("a"), F.col("first").alias("b")).distinct()
    return pairs.unionByName(stars)


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, doc_key, fp, root (a name of the component) and component_id (its least id).

    Links join fingerprints at 2 or fewer differing bits (the grid is built for this distance; others raise).
    Texts without words have fingerprint zero and are linked like any others. Null ids never are a
    component's name unless it has no other; repeated rows are kept. Other columns are ignored.
    """
    if max_bits != 2:
        raise ValueError("the grid's radius is made for 2 differing bits")
    found = stored(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    fps = stored(found.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "root", "component_id"), "named")
    return found.join(named, "fp").select("id", "doc_key", "fp", "root", "component_id")
