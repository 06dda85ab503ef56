"""Entities are replaced by type, consistently and distinctly."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from clinframe.llm import pii

DOCS = [
    (1, "Mail Ann.Lee_7@Mail.example.com or ann.lee_7@mail.example.com, call +1 (415) 555-0199."),
    (2, "Same phone: +14155550199 and 415-555-0199; card 4111 1111 1111 1111, 4111111111111111."),
    (3, "Mr. John Smith met Mrs Smith and MR JONES; госпожа Анна Петрова came."),
    (4, 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" at 10.20.30.40!! end'),
    (5, "IBAN DE89 3704 0044 0532 0130 00 and SSN 123-45-6789."),
    (6, "Nothing here, version 2.0 of 1999, 3.14, 12345, section 1.2.3 (see p. 10)."),
    (7, None),
    (8, ""),
    (8, ""),
    (None, "ann.lee_7@mail.example.com"),
    (9, "Herr Müller-Lüdenscheidt, Mme Zoé Ångström; not a.b@c nor @x.y"),
]


@pytest.fixture(scope="module")
def replaced(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, kind string")
    return [(r["doc_id"], r["text"], r["n_entities"], r["kind"]) for r in pii.replace(df, "k").collect()]


def text_of(replaced, i):
    return next(r[1] for r in replaced if r[0] == i)


def test_rows_and_clean_texts(replaced):
    assert len(replaced) == len(DOCS) and {r[3] for r in replaced} == {"x"}
    for i in (6, 7, 8):
        assert text_of(replaced, i) == dict(DOCS)[i]
    assert [r[2] for r in replaced if r[0] == 6] == [0]


def test_nothing_real_is_left(replaced):
    whole = "\n".join(r[1] or "" for r in replaced)
    for secret in ("ann.lee", "Ann.Lee", "555-0199", "5550199", "4111", "Smith", "JONES", "Петрова", "0a1b2c", "10.20.30.40", "3704", "123-45-6789", "Müller", "Zoé"):
        assert secret not in whole, secret


def test_format_and_coreference(replaced):
    mail = re.findall(r"\S+@\S+[a-z]", text_of(replaced, 1))
    assert len(mail) == 2 and mail[0].lower() == mail[1] and mail[0] != mail[1] and mail[0].endswith(".com")
    assert text_of(replaced, None) == mail[1]
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", text_of(replaced, 1))
    assert f"+1{phone[1]}{phone[2]}{phone[3]}" in text_of(replaced, 2)
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), (\d{16})\.", text_of(replaced, 2))
    digits = cards[1].replace(" ", "")
    assert digits == cards[2] and digits[0] == "4"
    doubled = [int(c) * (2 if k % 2 == 0 else 1) for k, c in enumerate(digits)]
    assert sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    names = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) and MR (\w+); госпожа (\w+) (\w+) came\.", text_of(replaced, 3))
    assert names[2] == names[3] != names[4].title() and names[1] in pii.GIVEN["latin_m"]
    assert names[5] in pii.GIVEN["cyrillic_f"] and re.fullmatch(r"[А-Я][а-яё]+", names[6])
    assert re.fullmatch(r'token = "[0-9a-f]{40}" at (\d{1,3}\.){3}\d{1,3}!! end', text_of(replaced, 4))
    assert re.fullmatch(r"IBAN DE\d\d( \d{4}){4} \d\d and SSN \d{3}-\d\d-\d{4}\.", text_of(replaced, 5))


def test_keys_differ_and_reruns_agree(spark, replaced):
    df = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, kind string").repartition(3)
    again = [(r["doc_id"], r["text"]) for r in pii.replace(df, "k").collect()]
    other = [(r["doc_id"], r["text"]) for r in pii.replace(df, "other").collect()]
    assert sorted(again, key=str) == sorted((r[:2] for r in replaced), key=str) != sorted(other, key=str)


def test_distinct_entities_stay_distinct(spark):
    """Many given names share a short list: collisions are drawn again, and no real name is used."""
    real = [*(n.lower() for n in pii.GIVEN["latin_f"][:10]), *(f"name{k}" for k in range(400))]
    df = spark.createDataFrame([("given_latin_f", n) for n in real] + [("ip", f"1.2.3.{k}") for k in range(200)], "kind string, canon string")
    found = pii.surrogates(df, "k").collect()
    assert {(r["kind"], r["canon"]) for r in found} == {tuple(r) for r in df.collect()}
    drawn = [(r["kind"], r["drawn"]) for r in found]
    assert len(set(drawn)) == len(found) and not set(drawn) & {(r["kind"], r["canon"]) for r in found}


def test_empty_table_and_long_texts(spark):
    assert pii.replace(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []
    long = "word " * 100000 + "a.b@c.de " * 500
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    row = pii.replace(df, "k").collect()[0]
    assert row["n_entities"] == 500 and row["text"].startswith("word " * 100000) and "a.b@c.de" not in row["text"]


def test_native_plan(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = pii.replace(df, "k").select(F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


HEX = "9233a8ec0b1c2d3e4f5061728394a5b6c7d8e9f0"


def test_secrets_in_any_case_and_without_quotes(spark):
    texts = [
        f'token = "{HEX}"',
        f'TOKEN = "{HEX.upper()}"',
        "Password: hunter22x.",
        "API_KEY=AbCdEfGhIjKl and more",
        "PASSWD: Winters, then",
        'Secret: "Xy12!abcQ"',
        "The key: understanding; a secret: nobody.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.replace(df, "k").orderBy("doc_id").collect()]
    low, up = re.fullmatch('token = "([0-9a-f]{40})"', got[0]), re.fullmatch('TOKEN = "([0-9A-F]{40})"', got[1])
    assert low[1] != HEX and low[1].upper() == up[1]
    assert re.fullmatch(r"Password: [a-z]{6}\d\d[a-z]\.", got[2]) and "hunter" not in got[2]
    assert re.fullmatch(r"API_KEY=([A-Z][a-z]){6} and more", got[3]) and "AbCd" not in got[3]
    assert re.fullmatch(r"PASSWD: [A-Z][a-z]{6}, then", got[4]) and "Winters" not in got[4]
    assert re.fullmatch(r'Secret: "[A-Z][a-z]\d\d![a-z]{3}[A-Z]"', got[5]) and "Xy12" not in got[5]
    assert got[6] == texts[6]


def test_later_mentions_of_titled_names(spark):
    """Planted: 30 texts with a titled name, in seven mentions each; and the same surname without
    any title in 10 further texts, which is not found."""
    names = [(f"Gi{chr(97 + k)}va", f"Sur{chr(97 + k)}nom") for k in range(26)] + [("Zoé", "Ångström"), ("John", "Smith"), ("Анна", "Петрова"), ("Jo", "O'Neil")]
    form = "Mr. {g} {s} came. {s} said that\nMr.\n{s}'s friend and {S} saw {g}, {s}-like; not {s}x."
    texts = [form.format(g=g, s=s, S=s.upper()) for g, s in names] + [f"Here {s} stood." for _, s in names[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["text"], r["n_entities"]) for r in pii.replace(df, "k").orderBy("doc_id").collect()]
    for (g, s), (text, n) in zip(names, got, strict=False):
        new = re.match(r"Mr\. (\w+) (\w+) came", text)
        assert text == form.format(g=new[1], s=new[2], S=new[2].upper()).replace(new[2] + "x", s + "x") and n == 7
        assert g not in text and new[2] != s
    assert [t for t, _ in got[30:]] == texts[30:]


def test_masked_and_crowded(spark):
    """Masks are no secrets; where a format has no place left, surrogates grow."""
    masked = ['password: "****"', "password=********", 'PWD password: "----"', 'token = "########"']
    boxes = [f"mail {c}@mail.example.com now" for c in "abcdefghijklmnopqrstuvwxyz"]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(masked + boxes)], "doc_id long, text string, n_entities string, _found string")
    rows = {r["doc_id"]: r for r in pii.replace(docs, "key").collect()}
    assert [rows[k]["text"] for k in range(4)] == masked and all(rows[k]["n_entities"] == 0 for k in range(4))
    new = [rows[k]["text"].split()[1] for k in range(4, 30)]
    assert len(set(new)) == 26 and not {t.split()[1] for t in boxes} & set(new)
    assert all(rows[k]["_found"] == "y" and rows[k]["n_entities"] == 1 for k in range(4, 30))
