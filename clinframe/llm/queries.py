"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import bitsliced, bpe, dialogue, infill, licenses, mixing, pii, repeats, reputation, secret_tags, simhash, spotsigs, toxicity
from clinframe.llm.common import table
from clinframe.queries.registry import Query

#: Key of the surrogates. A deployment passes one of its own.
PII_KEY = "surrogates of the registered query"
#: Vocabulary of the registered query.
RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


TOP_SQL = """
WITH parts AS (
  SELECT vec_id, row_number() OVER () AS row, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings WHERE vec_id IS NOT NULL
), q AS (
  SELECT vec_id, list(CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) ORDER BY pos) AS v
  FROM parts GROUP BY vec_id, row HAVING bool_and(x IS NOT NULL AND isfinite(x))
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS score
  FROM q a, q b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query("op3_bitsliced_topk", TOP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.worst_start").alias("worst_start"),
        F.col("toxicity.worst_end").alias("worst_end"),
    )


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, key=PII_KEY)


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


@query("op7_licenses")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join("licenses", ",").alias("licenses")
    return found.select("doc_id", names, "license_sequence", "n_license_sentences")


def _level_sql(name: str, groups: str, prior: str) -> str:
    """CTEs: the strength of a prior over ``groups`` (n, good and the prior mean), and the means."""
    chance = f"{prior} * (1 - {prior})"
    return (
        f"{name}_rho AS (SELECT sum(pow(good - n * {prior}, 2) - n * {chance}) / nullif(sum(n * (n - 1) * {chance}), 0) AS rho "
        f"FROM {groups}), {name}_s AS (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, {reputation.WEAKEST}), "
        f"{reputation.STRONGEST}) ELSE {reputation.STRONGEST} END AS strength FROM {name}_rho), {name} AS (SELECT g.*, strength, "
        f"(good + strength * {prior}) / (n + strength) AS {name}_mean FROM {groups} g, {name}_s)"
    )


def _rules_sql(column: int) -> str:
    out = []
    for host, path, verdict in sorted(reputation.RULES, key=lambda r: -len(r[0] + r[1])):
        value = (host + path, verdict)[column]
        out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value}'")
    return f"CASE {' '.join(out)} END"


REPUTATION_SQL = (
    "WITH known AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL "
    "GROUP BY 1), cut AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']), "
    "{'h': '', 'p': ''}) AS x FROM pages), p AS (SELECT page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path FROM cut), hosts AS (SELECT host, count(good) AS n, "
    "coalesce(sum(good), 0)::DOUBLE AS good FROM p LEFT JOIN known USING (page_id) GROUP BY 1), parts AS (SELECT *, "
    "string_split(host, '.') AS l, array_to_string(l[-2:], '.') AS two FROM hosts), placed AS (SELECT host, n, good, "
    f"CASE WHEN two IN {reputation.TWO_LABELS} THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN two IN "
    f"{reputation.TWO_LABELS} THEN two ELSE l[-1] END AS suffix FROM parts), domains AS (SELECT domain, suffix, sum(n)::DOUBLE "
    "AS n, sum(good) AS good FROM placed GROUP BY 1, 2), suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good, "
    "coalesce((SELECT sum(good) / nullif(sum(n), 0) FROM domains), 1.0) AS m FROM domains GROUP BY 1), "
    + _level_sql("by_suffix", "suffixes", "m")
    + ", domains2 AS (SELECT d.*, by_suffix_mean AS m FROM domains d JOIN by_suffix USING (suffix)), "
    + _level_sql("by_domain", "domains2", "m")
    + ", hosts2 AS (SELECT h.host, h.n, h.good, by_domain_mean AS m FROM placed h JOIN by_domain USING (domain)), "
    + _level_sql("by_host", "hosts2", "m")
    + ", bounds AS (SELECT host, by_host_mean + "
    f"{reputation.DEVIATES} * sqrt(by_host_mean * (1 - by_host_mean) / (n + strength + 1)) AS upper FROM by_host) "
    f"SELECT page_id, host, path, {_rules_sql(0)} AS rule, coalesce({_rules_sql(1)}, CASE WHEN upper < {reputation.THRESHOLD} "
    "THEN 'block' ELSE 'allow' END) AS verdict, round(upper, 6) AS upper FROM p JOIN bounds USING (host)"
)


@query("op8_reputation", REPUTATION_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return reputation.judge(table(spark, sf_dir, "pages"), outcomes)


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op10_spotsigs")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


#: Tokens, draws and cuts as lists; the text is its own restoration.
INFILL_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS parts
  FROM documents
), drawn AS (
  SELECT doc_id, text, parts, CAST(len(parts) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1,
         CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM cut
), placed AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, parts,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), three AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(parts[1:a], ''), '') AS p,
         coalesce(array_to_string(parts[a + 1:b], ''), '') AS m, coalesce(array_to_string(parts[b + 1:], ''), '') AS s
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM three
"""


@query("op13_infill", INFILL_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("infill.output"), F.col("infill.form")
    return made.select(
        "doc_id",
        "infill.n",
        form.alias("form"),
        "infill.prefix_chars",
        "infill.middle_chars",
        F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(output, form).cast("binary"), 256).alias("restored_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` as op12 damages them; ``there`` is false for those it drops."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    marks = F.regexp_replace(text, "[.!?]", "")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, marks).otherwise(text).alias("text"),
        (kind != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit(state: str, price: str, letter: str) -> str:
    return f"{{'c': {state}.c + {price}, 'a': {state}.a || '{letter}'}}"


_NEVER = "{'c': 1000000000, 'a': ''}"
_ENTER = _least("b0", "b1", "b3")
#: The same edits as a recurrence over turns and states (b0: start, b1: system, b2: user, b3: assistant).
DIALOGUE_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
         THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i))
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM given, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE kind <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
), marked AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS open, role[1:1] AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY pos)[1:1] || role[1:1] AS two FROM placed
), coded AS (
  SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again AND open AS BIGINT) AS cut FROM marked
), search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS b0, {_NEVER} AS b1, {_NEVER} AS b2, {_NEVER} AS b3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, {_edit("b0", "3", "D")},
         {_least(_edit("b1", "3", "D"), f"CASE WHEN NOT gone AND i = 's' THEN {_edit('b0', 'cut', 'K')} ELSE {_NEVER} END")},
         {_least(_edit("b2", "3", "D"), f"CASE WHEN NOT gone THEN {_edit('entered', '2 + cut', 'R')} ELSE {_NEVER} END", f"CASE WHEN NOT gone AND i = 'u' THEN {_edit('entered', 'cut', 'K')} ELSE {_NEVER} END")},
         {_least(_edit("b3", "3", "D"), f"CASE WHEN NOT gone THEN {_edit('b2', '2 + cut', 'R')} ELSE {_NEVER} END", f"CASE WHEN NOT gone AND i = 'a' THEN {_edit('b2', 'cut', 'K')} ELSE {_NEVER} END")}
  FROM (
    SELECT *, {_ENTER} AS entered FROM (
      SELECT conv_id, pos, gone, cut, i, b0, b1, b2, {_least("b3", _edit("b2", "2", "I"))} AS b3 FROM (
        SELECT c.conv_id, c.pos, gone, cut, i, b0, b1, b3, {_least("b2", _edit(_ENTER, "2", "I"))} AS b2
        FROM search s JOIN coded c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND c.pos = s.pos + 1)))
), ends AS (
  SELECT conv_id, {_least("b0", "b3", _edit(_least("b2", _edit(_ENTER, "2", "I")), "2", "I"))} AS best
  FROM search QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, unnest(range(length(best.a))) AS k FROM ends WHERE best.a <> ''
), numbered AS (
  SELECT *, sum(CAST(letter <> 'I' AS INT)) OVER w AS pos, sum(CAST(letter <> 'D' AS INT)) OVER w - 1 AS place,
         sum(CAST(letter <> 'D' AS INT)) OVER (PARTITION BY conv_id) AS total FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), kept AS (
  SELECT n.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (total - place) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
         || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
  FROM numbered n LEFT JOIN placed p ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.pos = p.pos WHERE letter <> 'D' GROUP BY 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(again AND NOT blank) AS duplicate, sum(cut) AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY 1
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN kept k ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""


@query("op12_dialogue", DIALOGUE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return dialogue.repair(rows, there=F.col("there"))


@query("op11_secrets")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_tags.scan(docs, secret_tags.train(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "tagged")

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, secret_tags.KINDS),
        F.sha2(named(base).cast("binary"), 256).alias("base_sha256"),
        named(F.col("secrets")).alias("spans"),
    )
