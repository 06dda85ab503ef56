"""Byte-level BPE encoding and decoding as a reduction over a tree.

Encodings form a monoid: halves are encoded recursively, and neighbours are joined by encoding
again only a window around the boundary. A sequence of tokens is the encoding of its bytes
exactly when every two neighbours are (each pair, encoded by itself, gives that pair back). So the
window grows until the pairs at both of its edges hold; all tokens outside are then final. A text
is the concatenation of the pattern's matches, whose encodings are concatenated in order, and
decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes encoded at a time at the leaves of the tree.
LEAF = 64
#: Rank of neighbours that do not merge.
NEVER = 1 << 40
#: Tokens on either side of a boundary that the first window takes.
WINDOW = 2
#: Bytes of ids that a task sends on at a time.
BATCH_BYTES = 1 << 22
#: Encoded matches of the pattern that a task remembers, and the longest one remembered.
REMEMBERED = 200_000
REMEMBERED_BYTES = 48
#: Characters that count as white space for the public pattern; the regex module counts four
#: control characters more.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def read_ranks(path: str) -> bytes:
    """A rank file as it is: lines of a base64 token and its rank (about 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def compiled(pattern: str) -> regex.Pattern:
    """``pattern`` with white space as Unicode defines it."""
    inside = pattern.replace(r"[^\s", "[^" + _SPACE)
    return regex.compile(inside.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


class Encoder:
    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        self.token = {r: t for t, r in self.rank.items()}
        self.split = compiled(pattern).findall
        self.known: dict[str, bytes] = {}
        self.holds = lru_cache(1 << 16)(self._holds)

    def _merge(self, data: bytes) -> list[int]:
        """Merges in the order of rank, then of place."""
        if data in self.rank:
            return [self.rank[data]]
        n = len(data)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        end = list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = self.rank.get(data[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank[data[i : end[i]]])
            i = after[i]
        return out

    def _merge_few(self, data: bytes) -> list[int]:
        """The same for a few bytes, where looking at all neighbours costs less than a heap."""
        rank = self.rank
        whole = rank.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return [rank[part] for part in parts]

    def _holds(self, a: int, b: int) -> bool:
        return self._merge(self.token[a] + self.token[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        a, b = min(WINDOW, len(left)), min(WINDOW, len(right))
        while True:
            inner = self._merge(b"".join(self.token[t] for t in left[len(left) - a :] + right[:b]))
            fine_left = a == len(left) or self.holds(left[len(left) - a - 1], inner[0])
            fine_right = b == len(right) or self.holds(inner[-1], right[b])
            if fine_left and fine_right:
                return left[: len(left) - a] + inner + right[b:]
            a = a if fine_left else min(2 * a, len(left))
            b = b if fine_right else min(2 * b, len(right))

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self._merge_few(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(self.encode_bytes(data), "<u4").tobytes()
        if len(data) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get = self.known.get
        return b"".join([get(p) or self._piece(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = (hash(ranks), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encoded(docs: DataFrame, ranks: bytes, pattern: str, text: Column) -> Column:
    """Ids of ``text`` as binary (little-endian unsigned 32-bit integers); empty for null."""
    given = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        encoder = _encoder(given.value, pattern)
        return pa.array([encoder.encode(v.as_py() or "") for v in column], pa.binary())

    return encode(text)


def decoded(docs: DataFrame, ranks: bytes, pattern: str, ids: Column) -> Column:
    """Bytes of ids that ``encoded`` made."""
    given = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        encoder = _encoder(given.value, pattern)
        return pa.array([encoder.decode(v.as_py() or b"") for v in column], pa.binary())

    return decode(ids)


def token_rows(docs: DataFrame, ranks: bytes, pattern: str, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row with ids (as of :func:`encoded`), n_tokens and decoded_sha256.

    A task sends its rows on in batches of about ``BATCH_BYTES`` of ids, so that it never holds the
    ids of many long texts. Null texts count as empty.
    """
    given = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(given.value, pattern)

        def out(part: pa.RecordBatch, ids: list[bytes], shas: list[str]) -> pa.RecordBatch:
            columns = {n: part.column(n) for n in keep}
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            return pa.RecordBatch.from_pydict(columns | {"ids": pa.array(ids, pa.binary()), "n_tokens": counts, "decoded_sha256": shas})

        for batch in batches:
            start, ids, shas, size = 0, [], [], 0
            for row, value in enumerate(batch.column("_text")):
                ids.append(encoder.encode(value.as_py() or ""))
                shas.append(hashlib.sha256(encoder.decode(ids[-1])).hexdigest())
                size += len(ids[-1])
                if size >= BATCH_BYTES:
                    yield out(batch.slice(start, row + 1 - start), ids, shas)
                    start, ids, shas, size = row + 1, [], [], 0
            if ids:
                yield out(batch.slice(start), ids, shas)

    schema = StructType([*docs.select(*keep).schema.fields])
    schema = schema.add("ids", "binary").add("n_tokens", "long").add("decoded_sha256", "string")
    return rows.mapInArrow(encode, schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null texts count as empty.

    Encodes and decodes a row in one visit, so ids do not leave the task. Repeated rows, null ids
    and further columns make no difference.
    """
    given = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(column: pa.Array) -> pa.Array:
        encoder = _encoder(given.value, pattern)
        counts, ids_sha, bytes_sha = [], [], []
        for value in column:
            ids = encoder.encode(value.as_py() or "")
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            bytes_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        fields = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
        return pa.StructArray.from_arrays(fields, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", both(F.col(text)).alias("x")).select("doc_id", "x.*")
