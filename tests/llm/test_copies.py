"""Near copies against all pairs of whole five-word sets."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from clinframe.llm import copies


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def edited(rng):
    """Ten texts of different lengths, each with copies of which more and more words are replaced."""
    for k in range(10):
        base = [f"Wort{rng.randrange(10**6)}" for _ in range(30 + 40 * k)]
        yield " ".join(base)
        for changes in (1, 2, 3, 5, 8, 12):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "other"
            yield "  ".join(copy).upper()


@pytest.mark.parametrize("leaders", [1, copies.LEADERS])
def test_edited_copies(spark, leaders):
    rng = random.Random(4)
    texts = [*edited(rng), "", None, " \t", "one two", "One  two", "one two three"]
    # One large group: every text is near the first, not each near each.
    base = [f"w{k}" for k in range(400)]
    texts += [" ".join([*base[:at], "x", *base[at + 1 :]]) for at in range(0, 400, 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in copies.keep_first(df, leaders=leaders).collect())
    assert kept == sorted(set(groups(texts)))


def test_stage_links_at_similarity(spark, sf):
    """A copy with a word replaced every 60 words is beyond three bits, and goes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 1500").limit(40)
    rows = [r.asDict() for r in docs.collect()]
    for r in list(rows):
        words = r["text"].split()
        words[30::60] = ["changed"] * len(words[30::60])
        rows.append({**r, "doc_id": r["doc_id"] + 10**9, "text": " ".join(words)})
    table = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    kept = corpus_pipeline.drop_near_copies(spark, table, sf).collect()
    label = groups([r["text"] for r in rows])
    assert sorted(r["doc_id"] for r in kept) == sorted(rows[i]["doc_id"] for i in set(label))
    assert len(kept) <= len(rows) / 2


def test_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts beside a large group agree with it in many bands, but have too many words of their own."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]

    def changed(places):
        copy = list(base)
        for at in places:
            copy[at] = f"own{rng.randrange(10**9)}"
        return " ".join(copy)

    texts = [changed([rng.randrange(150)]) for _ in range(120)]
    texts += [changed(range(start, 150, 25)) for start in rng.choices(range(25), k=120)]
    seen, links = [], copies._links

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(copies, "_links", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in copies.keep_first(df, leaders=1).collect())
    assert kept == sorted(set(groups(texts)))
    assert sum(seen) <= 15 * len(texts)


def test_fingerprints_come_first(spark, monkeypatch):
    """Pairs that the variants of the fingerprints find are verified, and need no band."""
    base = [f"w{k}" for k in range(2000)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base).upper(), "something else entirely"]
    first, links = [], copies._links

    def kept_first(pairs, *rest):
        found = links(pairs, *rest)
        first.append(found.count())
        return found

    monkeypatch.setattr(copies, "_links", kept_first)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in copies.keep_first(df).collect()) == [0, 3]
    assert first == [1, 0]


def test_links_of_later_rounds_are_joined_between_labels(spark, monkeypatch):
    """A group that the fingerprints have connected is not connected again by each later round."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(600)]
    texts = [" ".join([*base[:at], "x", *base[at + 1 :]]) for at in range(60)]
    texts += [*edited(rng)]
    seen, components = [], copies.components

    def counted(edges):
        seen.append(edges.count())
        return components(edges)

    monkeypatch.setattr(copies, "components", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in copies.keep_first(df, leaders=1).collect())
    assert kept == sorted(set(groups(texts)))
    assert len(seen) > 1 and sum(seen) < 2 * len(texts), seen
