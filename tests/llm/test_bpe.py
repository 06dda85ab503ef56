"""Encodings equal those of the public library; decoding gives the bytes back."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from clinframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(PATH).splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    signs = "aaaabcde  \n\t\x1c\x1d\x85\u00a0\u2003\u202f\u3000éß漢字🙂'sT09٣_-.!\u0301\u200b\ufeff"
    for k in range(400):
        yield "".join(rng.choice(signs) for _ in range(rng.randint(0, 300)))
        if k % 10 == 0:
            yield rng.choice(["a", "ab", "x ", "=", "é", "漢", " ", "\n"]) * rng.randint(100, 4000)
            yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))


def test_encoder(library):
    encoder = bpe.Encoder(bpe.read_ranks(PATH), PATTERN)
    for text in texts():
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_tree_equals_one_merge():
    """Joining halves gives what merging the whole gives, whatever the leaves."""
    encoder = bpe.Encoder(bpe.read_ranks(PATH), PATTERN)
    rng = random.Random(4)
    for _ in range(60):
        data = bytes(rng.choice(b"aaabcde tion\xc3\xa9") for _ in range(rng.randint(65, 900)))
        assert encoder.encode_bytes(data) == encoder._merge(data)


def test_queries_of_rows(spark, library):
    rows = [(1, "a text, with 12 words"), (2, None), (3, ""), (None, "x" * 5000), (1, "a text, with 12 words")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(df, bpe.read_ranks(PATH), PATTERN).collect()
    for (i, text), row in zip(rows, got, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row["doc_id"] == i and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    ids = df.select("text", bpe.encoded(df, bpe.read_ranks(PATH), PATTERN, df["text"]).alias("ids"))
    back = ids.select("text", bpe.decoded(ids, bpe.read_ranks(PATH), PATTERN, ids["ids"]).alias("bytes")).collect()
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in back)
    assert bpe.round_trip(df.limit(0), bpe.read_ranks(PATH), PATTERN).collect() == []
