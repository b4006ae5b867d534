"""Packing in document order by dynamic programming.

The documents' token streams, one after the other, are cut into windows of at most `window` tokens. A cut at
a document's end is free, one at a sentence's end costs `sentence`, any other `hard` (in padding
tokens), and a window's padding costs its length. With P the tokens before a place, the least cost of a stream cut
at place i is

    f(i) = penalty(i) + window - P(i) + min { f(j) + P(j) : P(i) - P(j) <= window },

a minimum over a sliding range, which a monotone queue gives in constant time a place on average.

Documents are range-partitioned by id into blocks, and each block is packed by one task in a stream: the
places of `horizon` tokens are solved at a time, and what is left after their last full window goes to the next. A
block's last window is cut into powers of two, which need no padding, where that costs less.
"""

from __future__ import annotations

import dataclasses
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tables import row_key

END_ID = 2


@dataclasses.dataclass(frozen=True)
class Costs:
    window: int = 4096
    sentence: int = 8
    hard: int = 64
    grain: int = 64  # where no sentence ends for longer, each grain-th token is a place for a hard cut
    horizon: int = 1 << 21


#: The splitting pattern of the tokenizer for lower-cased texts of the plain alphabet below. Fixed values.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+"
PLAIN = r"[\x09-\x0D\x20-\x7EÀ-ÖØ-öø-ÿ]*"


class WordCache:
    """Token ids of whole texts, with each distinct piece encoded once while the cache holds it.

    The tokenizer drops white space and never joins what it parts, so a text's ids are its pieces' ids in
    turn. Texts of letters whose case and composition are plain are split into pieces here; other
    words go to the tokenizer as they are, and so does a text that holds one of its special tokens. The cache is
    emptied at `limit` entries; its size only affects time.
    """

    def __init__(self, path: str, limit: int = 600_000):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit = self.tokenizer.model, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piece, self.plain, self.white = re.compile(PIECE), re.compile(PLAIN), re.compile(r"[\x09-\x0D\x20]+")
        spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = [chr(c) for c in (*range(0xC0, 0x100),) if c not in (0xD7, 0xF7)]
        self.bytes_of = str.maketrans({c: spelled(c)[0][0] for c in letters})
        self.pieces: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closing = [i for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4] and t[-5] in ".!?"]
        self.size = max(vocabulary.values()) + 1

    def _packed(self, ids) -> bytes:
        import numpy as np

        return np.array(ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        found = self.piece.findall(text.lower())
        known = self.pieces
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for p in set(found):
                if p not in known:
                    known[p] = self._packed([t.id for t in self.model.tokenize(p.translate(self.bytes_of))])
            return b"".join(map(known.__getitem__, found))

    def _other(self, word: str) -> bytes:
        if word not in self.others:
            if len(self.others) > self.limit // 4:
                self.others.clear()
            self.others[word] = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return self.others[word]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.special):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.plain.fullmatch(text):
            return self._plain(text)
        words = self.white.split(text)
        return b"".join(self._plain(w) if self.plain.fullmatch(w) else self._other(w) for w in words if w)


def places(total: int, soft, ends, costs: Costs):
    """Where a stream of `total` tokens may be cut, and what each cut costs.

    `soft` and `ends` are the sorted places of sentences' and documents' ends.
    """
    import numpy as np

    natural = np.union1d(soft, ends)
    natural = natural[(natural > 0) & (natural <= total)]
    edges = np.concatenate([[0], natural, [total]])
    gaps = np.diff(edges)
    wide = np.nonzero(gaps > costs.grain)[0]
    hard = [np.arange(edges[k] + costs.grain, edges[k + 1], costs.grain) for k in wide]
    at = np.unique(np.concatenate([natural, [total], *hard])).astype(np.int64)
    penalty = np.full(len(at), costs.hard, dtype=np.int64)
    penalty[np.isin(at, soft)] = costs.sentence
    penalty[np.isin(at, ends) | (at == total)] = 0
    return at, penalty


def cuts(at, penalty, costs: Costs, last: bool) -> list[int]:
    """The cheapest cuts of a stream. Neighbouring places are at most a window apart.

    What follows the cut that is chosen last fits one window. In the stream's last part it is cut as `tail_cuts`
    says, at its cost; else it costs nothing yet, as the next part begins with it.
    """
    window = costs.window
    position = [0, *at.tolist()]
    extra = [0, *penalty.tolist()]
    n = len(position)
    gain = [0] * n  # f + P
    back = [0] * n
    queue = deque([0])  # places with rising gain
    for i in range(1, n):
        p = position[i]
        while p - position[queue[0]] > window:
            queue.popleft()
        j = queue[0]
        back[i] = j
        g = gain[j] + window + extra[i]  # f(i) + P(i)
        gain[i] = g
        while queue and gain[queue[-1]] >= g:
            queue.pop()
        queue.append(i)
    total = position[-1]
    near = [i for i in range(n - 1) if total - position[i] <= window]
    rest = {i: tail_cost(total - position[i], costs) if last else 0 for i in near}
    i = min(near, key=lambda i: (gain[i] - position[i] + rest[i], -i))
    out = tail_cuts(position[i], total, costs)[::-1] if last else []
    while i > 0:
        out.append(position[i])
        i = back[i]
    return out[::-1]


def tail_cost(length: int, costs: Costs) -> int:
    """Of a last window: its padding, or the cuts into powers of two, which have none."""
    return min(costs.window - length, (length.bit_count() - 1) * costs.hard)


def tail_cuts(start: int, end: int, costs: Costs) -> list[int]:
    """The cuts of a last window, the cheaper way of the two."""
    length = end - start
    if (length.bit_count() - 1) * costs.hard >= costs.window - length:
        return [end]
    out = []
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            start += 1 << bit
            out.append(start)
    return out


class Packer:
    """Takes documents in order and gives pieces: (key, start, length, ids, tokens of the document, sequence, offset)."""

    def __init__(self, closing, size: int, costs: Costs, first_sequence: int):
        import numpy as np

        self.costs, self.sequence = costs, first_sequence
        self.closing = np.zeros(size, dtype=bool)
        self.closing[closing] = True
        self.parts: list = []  # (key, start of the part in its document, ids, tokens of the document)
        self.held = 0

    def add(self, key, ids) -> Iterator[tuple]:
        self.parts.append((key, 0, ids, len(ids)))
        self.held += len(ids)
        if self.held >= self.costs.horizon:
            yield from self.cut(last=False)

    def cut(self, last: bool) -> Iterator[tuple]:
        import numpy as np

        if not self.held:
            return
        sizes = np.cumsum([len(ids) for _, _, ids, _ in self.parts])
        stream = np.concatenate([ids for _, _, ids, _ in self.parts])
        soft = np.nonzero(self.closing[stream])[0] + 1
        chosen = cuts(*places(len(stream), soft, sizes, self.costs), self.costs, last)
        done = chosen[-1] if chosen else 0
        edges = np.unique(np.concatenate([[0], sizes[sizes < done], chosen])).astype(np.int64).tolist() if chosen else []
        k, begin, window = 0, 0, 0
        for a, b in zip(edges, edges[1:], strict=False):
            while sizes[k] <= a:
                begin = int(sizes[k])
                k += 1
            if a >= chosen[window]:
                window += 1
            key, skipped, _, tokens = self.parts[k]
            window_start = chosen[window - 1] if window else 0
            yield key, skipped + a - begin, b - a, stream[a:b].tobytes(), tokens, self.sequence + window, a - window_start
        self.sequence += len(chosen)
        left = []
        for (key, skipped, ids, tokens), stop in zip(self.parts, sizes.tolist(), strict=True):
            if stop > done:
                used = max(0, done - (stop - len(ids)))
                left.append((key, skipped + used, ids[used:].copy(), tokens))
        self.parts, self.held = left, len(stream) - done


PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, costs: Costs = Costs(), doc_id: str = "doc_id", text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """The pieces of all documents' token streams: doc_id and `PIECES`.

    `tokenizer` is the file's path on every executor. A document's stream is its ids and then `END_ID`, so
    a null or empty text has one token. Pieces of one sequence_id by offset make the sequence. Documents go by
    id, rows of one id by their texts' hash, nulls first; repeated rows are packed each. Other
    columns are ignored. An empty table has no pieces.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = rows.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0
    order = [F.col("doc_id"), row_key("body")]
    blocks = rows.repartitionByRange(max(1, -(-total // block_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words = WordCache(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        packer = Packer(words.closing, words.size, costs, TaskContext.get().partitionId() << 32)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", *(p.split()[0] for p in PIECES.split(", "))]

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(words.encode(body.as_py()) + end, dtype="<u4")
                if found := list(packer.add(key.as_py(), ids)):
                    yield batch_of(found)
        if found := list(packer.cut(last=True)):
            yield batch_of(found)

    return blocks.mapInArrow(run, f"doc_id bigint, {PIECES}")
