"""Fill-in-the-middle examples: a text is cut in three and its middle moved to the end.

Cuts are drawn in units of a text (words with the white space before them, or code points) and made
in its UTF-8 bytes. Between the two stands a sparse exception index: it holds only the characters of
several bytes, by position, with the bytes they have beyond one. A search in it converts a cut from
code points to bytes or back; where it holds nothing, in ASCII, the two differ by a constant. So no
text is decoded, and the index of a text in ASCII is empty.

``psm`` puts prefix, suffix, middle behind their marks, ``spm`` suffix, prefix, middle; ``plain``
leaves the text. A text that contains a mark stays plain, so every output gives its text back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and percent of those in the form ``spm``.
RATE, SPM = 50, 80
SEED = "42"

_P, _S, _M = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
_OUT = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: binary>"


class Exceptions:
    """The characters of several bytes in a UTF-8 text: where they start, in bytes and in code
    points, and the bytes beyond one that they and all earlier ones have."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.chars = self.bytes - self.excess[:-1]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        return cuts - self.excess[np.searchsorted(self.bytes, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        return cuts + self.excess[np.searchsorted(self.chars, cuts)]


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where the words of a UTF-8 text start, each with the white space before it; white space at
    the end is a word of its own. No byte of a longer character looks like white space."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.concatenate([[0], starts]) if len(data) else starts


def cut(text: bytes, first: int, second: int, words: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """Units of ``text``, and its two cuts in bytes and in code points. A draw is taken modulo one
    more than the units; the smaller result ends the prefix, the larger the middle."""
    data = np.frombuffer(text, np.uint8)
    index = Exceptions(data)
    if words:
        starts = np.append(word_starts(data), len(data))
        n = len(starts) - 1
        at = starts[np.sort([first % (n + 1), second % (n + 1)])]
        return n, at, index.to_chars(at)
    n = len(data) - int(index.excess[-1])
    chars = np.sort([first % (n + 1), second % (n + 1)])
    return n, index.to_bytes(chars), chars


def _row(text: bytes | None, first: int, second: int, form: str, words: bool):
    text = text or b""
    n, (a, b), (c, d) = cut(text, first, second, words)
    if form == "plain" or not text or _P in text or _S in text or _M in text:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    parts = (_P, prefix, _S, suffix, _M, middle) if form == "psm" else (_S, suffix, _P, prefix, _M, middle)
    return n, form, int(c), int(d - c), b"".join(parts)


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four draws below 2^32 from the hash of ``seed`` and the id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rate: int = RATE,
    spm: int = SPM,
    words: bool = True,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``infill``: the units of the text, the form, the code points of prefix and
    middle (null for plain) and the output.

    The form and the cuts depend on the id and the seed alone. Null and empty texts give an empty
    plain output; repeated rows give equal ones; an empty table stays empty. An own column
    ``infill`` is replaced, all others stay. No shuffle; a text is held once with its output.
    """

    @F.arrow_udf(_OUT)
    def made(texts: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
        rows = [
            _row(t, a, b, f, words)
            for t, a, b, f in zip(
                (t.as_py() for t in texts), first.to_pylist(), second.to_pylist(), form.to_pylist(), strict=True
            )
        ]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    form = F.when(h3 % 100 >= rate, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    out = docs.withColumn("infill", made(F.col(text).cast("binary"), h1, h2, form))
    return out.withColumn("infill", F.col("infill").withField("output", F.col("infill.output").cast("string")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
