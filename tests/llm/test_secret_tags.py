"""Fixed patterns by their definition, decoding against all tags, and held-out statements."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from clinframe.llm import secret_tags as S

WORDS = "the quick thering inst ation of and was Report page 12 2024-01-02 4785380592391135 x.y@mail2.example.com (499) Tokens a/b".split()


def text_of(rng, n=60):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(2)
    return S.fit([text_of(rng, rng.randint(20, 120)) for _ in range(250)])


def test_fixed_patterns():
    def plainly(text):
        found = []
        assign = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        for m in re.finditer(assign + "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
            if len(m.group(2)) >= 6:
                found.append((m.start(), 0, m.end()))
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        return [(S.KINDS[k], a, b) for a, k, b in sorted(found)]

    rng = random.Random(3)
    parts = ["password", "PassWD", "api_key", "apiKey", "TOKEN", "toKen", "ſecret", "secret", '"', "'", " ", ":", "=", "abc", "abcdef9", "\t"]
    parts += ["AKIA", "ABCDEFGH12345678", "é", "0123456789abcdef", "deadbeef", ".", "/+_-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in S.base_spans(text)] == plainly(text), text
    assert [s[3:] for s in S.base_spans('token = "abcdef12"')] == [(9, 17)]


def test_best_tags_by_all_tags():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        score, moves = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))

        def value(tags, score=score, moves=moves):
            row = [S.OUTSIDE, *tags, S.OUTSIDE]
            return sum(moves[a, b] for a, b in zip(row, row[1:])) + sum(s[t] for s, t in zip(score, tags))

        assert tuple(S.viterbi(score, moves)) == max(itertools.product(range(3), repeat=n), key=value)


def whole(tagger, text):
    """Tags of all tokens at once, without the stretches."""
    tokens = S._TOKEN.findall(text)
    if not tokens:
        return []
    score = tagger.weights[S.features(tokens, S.file_bucket(text))].sum(axis=1)
    return S.viterbi(score.astype(np.float64), tagger.moves)


def test_stretches_change_nothing(weights, monkeypatch):
    tagger, rng = S.Tagger(weights), random.Random(8)
    monkeypatch.setattr(S, "CHUNK", 300)
    monkeypatch.setattr(S, "REMEMBERED", 60)
    tagged = 0
    for _ in range(150):
        text = f"{text_of(rng)} {S._statement(rng)[0]} {text_of(rng)} {S._statement(rng)[0]}"
        tags = whole(tagger, text)
        spans = [m.span() for m in S._TOKEN.finditer(text)]
        merged = []
        for i, tag in enumerate(tags):
            if tag == S.OUTSIDE:
                continue
            joins = tag == S.INSIDE and i and tags[i - 1] != S.OUTSIDE and spans[i][0] == spans[i - 1][1]
            if joins:
                merged[-1][1] = spans[i][1]
            else:
                merged.append(list(spans[i]))
        want = [(a, b) for a, b in merged if b - a >= S.LEAST]
        assert tagger.secrets(text) == want
        tagged += len(want)
    assert tagged > 50


def test_held_out_statements(weights):
    tagger, rng = S.Tagger(weights), random.Random(77)
    found, false, secrets, harmless = 0, 0, 0, 0
    for _ in range(800):
        made, a, b = S._statement(rng)
        head = text_of(rng, 20) + " "
        spans = tagger.scan(head + made + " " + text_of(rng, 20))
        if a >= 0:
            secrets += 1
            found += any(s["start"] <= a + len(head) + 1 and s["end"] >= b + len(head) - 3 for s in spans)
        else:
            harmless += 1
            false += any(s["kind"] == "tagged" for s in spans)
    assert found / secrets > 0.95 and false / harmless < 0.03


def test_neighbours_count(weights):
    """The same token is likelier a secret behind a word that announces one."""
    tagger = S.Tagger(weights)

    def margin(tokens):
        score = tagger.weights[S.features(tokens, 0)].sum(axis=1)[-1]
        return score[S.BEGIN] - score[S.OUTSIDE]

    assert margin(["the", "pwd", ":", "hunter2Xy9"]) > margin(["the", "invoice", ":", "hunter2Xy9"])
    assert margin(["the", "pwd", ":", "hunter2Xy9"]) > margin(["the", "pwd", ":", "hunter"])


def test_odd_rows(spark, weights):
    rows = [(1, None, "a"), (2, "", "b"), (None, "token = abcdef99", "c"), (3, "x" * 300_000 + " é 🙂 token: 'abcdefgh'", None), (3, "\n\n", "")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, secrets string")
    got = S.scan(df, weights).collect()
    assert len(got) == 10
    by = {(r["doc_id"], r["text"]): [tuple(s) for s in r["secrets"] if s["kind"] != "tagged"] for r in got}
    assert by[None, "token = abcdef99"] == [("assign", 0, 16, 8, 16)]
    assert by[1, None] == by[2, ""] == by[3, "\n\n"] == []
    assert by[3, rows[3][1]] == [("assign", 300_005, 300_021, 300_013, 300_021)]
    empty = df.limit(0)
    assert S.scan(empty, S.train(empty)).collect() == []


def test_training_ignores_partitions(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, text_of(rng)) for k in range(60)] + [(None, "x"), (7, None)], "doc_id long, text string")
    assert S.train(docs) == S.train(docs.repartition(3))
