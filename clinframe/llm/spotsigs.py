"""Document fingerprints from spot signatures.

A signature is a common word (the anchor) with the next ``CHAIN`` content words, common words in
between skipped. A document's fingerprint is the sorted set of its signatures' hashes. Likeness is
the Jaccard of two fingerprints.

Near copies are found without comparing all pairs: fingerprints are partitioned by set length into
bands so that only equal and neighbouring bands can hold a pair of the wanted likeness; within
them only the rarest signatures of a set are indexed (a pair that is alike must share one), and
candidates whose lengths differ too much are pruned before their Jaccard is taken.

Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinframe.llm.common import any_of, components
from clinframe.session import stored

#: Common words of four languages. Fixed values.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was with "
    "auf aus das dem den der des die ein eine er es ist mit nicht sich und von zu für im "
    "au aux avec ce dans de du elle en est et il la le les pas pour que qui sur un une par "
    "al como con del el los las lo no para por se su más una"
).split()
#: Content words of a signature.
CHAIN = 2
#: Likeness of near copies.
LIKE = 0.8
#: Ranges of ids at most, per level of two: neighbours are found range by range.
FANOUT = 256
#: Rows of one range, about.
RANGE = 2000

#: Stands before each common word.
_MARK = "\x01"
#: A common word, or a content word, with the common words before it.
_SKIPPED = f"(?:{_MARK}[^ ]+ )*+"
_CHAIN = f"(?<= )(?=({_MARK}[^ ]+ {f'{_SKIPPED}[^ ]+ ' * CHAIN}))"


def signed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted array of the signature hashes of ``text`` (longs), never empty.

    A text without anchors followed by content words takes every word as an anchor; one without
    two words has a single signature, the hash of the text itself (null counts as empty).
    """
    # Column by column, so that no pattern runs twice.
    whole = F.coalesce(F.col(text), F.lit(""))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(spaced, f"(?<= )(?={any_of(ANCHORS)} )", _MARK)
    # Overlapping chains, so a lookahead: the match itself is empty, and its group is the chain.
    rows = rows.withColumn("_marked", marked)
    rows = rows.withColumn("_chains", F.regexp_extract_all("_marked", F.lit(_CHAIN), 1))
    plain = F.transform("_chains", lambda c: F.xxhash64(F.regexp_replace(c, f"(?<= ){_MARK}[^ ]+ ", "")))
    pairs = F.regexp_extract_all("_marked", F.lit("(?<= )(?=([^ ]+ [^ ]+ ))"), 1)
    rows = rows.withColumn("_hashes", F.when(F.size("_chains") > 0, plain).otherwise(F.transform(pairs, lambda c: F.xxhash64(c))))
    alone = F.array(F.xxhash64(F.concat(F.lit("\n"), whole)))
    found = F.when(F.size("_hashes") > 0, F.array_sort(F.array_distinct("_hashes"))).otherwise(alone)
    return rows.withColumn(name, found).drop("_marked", "_chains", "_hashes")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature arrays."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprint(signs: Column) -> Column:
    """16 hex digits per signature, in the order of the hashes."""
    return F.lower(F.array_join(F.transform(signs, lambda s: F.lpad(F.hex(s), 16, "0")), ""))


def _ranges(ids: DataFrame) -> tuple[list[list[int]], int]:
    """Bounds that cut the ids into ranges of about ``RANGE`` rows: at most ``FANOUT`` ranges of
    at most ``FANOUT`` each, found from approximate quantiles (the result does not depend on
    them)."""
    rows = ids.count()
    parts = min(FANOUT * FANOUT, max(1, rows // RANGE))
    wide = math.isqrt(parts - 1) + 1
    points = [k / (wide * wide) for k in range(1, wide * wide)]
    found = ids.agg(F.percentile_approx("doc_id", points, 10 * wide * wide)).first()[0] if points else []
    bounds = sorted(set(found or []))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    return groups, len(bounds)


def _range_of(id_: Column, groups: list[list[int]]) -> Column:
    """Number of bounds below an id, looked up in two steps."""
    if not groups:
        return F.lit(0)
    wide = len(groups[0])
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    below = lambda values: F.size(F.filter(values, lambda b: b < id_))
    group = below(longs([g[-1] for g in groups]))
    inner = F.array(*[longs(g) for g in groups])
    rest = F.coalesce(F.when(group < len(groups), below(F.element_at(inner, group + 1))), F.lit(0))
    return group * wide + rest


def with_next(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, next_text of every row, and each of ``carried`` with the next row's as
    next_<name>: the next document in the order of descending doc_id, then of text; after the last
    comes the first. Null texts count as empty; null ids come last.

    Texts are shuffled once, to ranges of ids. The first row of a range is also sent to the range
    before it, so no range has to look into another.
    """
    low = -(2**63)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("_at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), *carried
    )
    groups, _ = _ranges(rows.select(F.col("_at").alias("doc_id")))
    number = _range_of(F.col("_at"), groups)
    firsts = rows.select("_at", number.alias("range")).groupBy("range").agg(F.max("_at").alias("_first")).collect()
    firsts = sorted((r["range"], r["_first"]) for r in firsts)
    if not firsts:
        return rows.withColumns({f"next_{c}": F.col(c) for c in ("text", *carried)}).drop("_at")
    # Ranges rise with ids, so the order by descending id visits the last range first.
    guest_of = {first: firsts[(k + 1) % len(firsts)][0] for k, (_, first) in enumerate(firsts)}
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(guest_of.items()), "_first long, _guest int"))
    placed = rows.withColumn("_range", number).join(table, F.col("_at") == F.col("_first"), "left")
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    other = F.struct(F.col("_guest").alias("range"), F.lit(1).alias("guest"))
    both = F.when(F.col("_guest").isNull(), F.array(own)).otherwise(F.array(own, other))
    sent = placed.select("_at", "doc_id", "text", *carried, F.explode(both).alias("_to"))
    order = Window.partitionBy("_to.range").orderBy("_to.guest", F.desc("_at"), "text")
    sent = sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *carried)})
    return sent.where("_to.guest = 0").drop("_at", "_to")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half of code points replaced by the first as many of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    kept = F.substring(text, F.lit(1), F.length(text) - half)
    return F.concat(kept, F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, fingerprint, and the same of its edited text,
    with the likeness of its fingerprint to that of the edited text and of the next document.

    A single document is its own next one. Repeated rows follow one another. Other columns are not
    read.
    """
    rows = signed(docs.select("doc_id", "text"), "text", "own")
    rows = with_next(rows, ("own",)).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = signed(rows, "edited", "changed")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints whose likeness is at least ``like``; a and b
    are the smallest doc_ids of their classes of equal fingerprints."""
    signs = signed(docs.select("doc_id", "text"), "text", "signs")
    sets = stored(signs.groupBy("signs").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    each = sets.select("rep", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    counted = each.groupBy("sign").agg(F.count(F.lit(1)).alias("seen"))
    ranked = each.join(counted, "sign").where("seen > 1")
    rare = Window.partitionBy("rep").orderBy("seen", "sign")
    kept = ranked.withColumn("k", F.row_number().over(rare) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("rep")))
    # A set shares at least ceil(like * n) signatures with its partner: one is among the first
    # n - ceil(like * n) + 1 in the common order.
    prefix = kept.where(F.col("k") <= F.col("n") - F.ceil(F.lit(like) * F.col("n")) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / like)).cast("int")
    index = stored(prefix.select("sign", "rep", "n", band.alias("band")))
    probe = index.select("sign", F.col("rep").alias("a"), F.col("n").alias("na"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    fits = (F.col("na") <= F.col("n")) & (F.col("n") * like <= F.col("na")) & ((F.col("na") < F.col("n")) | (F.col("a") < F.col("rep")))
    found = probe.join(index, ["sign", "band"]).where(fits).select("a", F.col("rep").alias("b")).distinct()
    left = sets.select(F.col("rep").alias("a"), F.col("signs").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("signs").alias("sb"))
    scored = found.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return scored.where(F.col("likeness") >= like)


def near_classes(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id and class_id of every row: the smallest doc_id that pairs of ``near_pairs`` reach."""
    labels = components(near_pairs(docs, like).select("a", "b")).withColumnRenamed("node", "rep")
    rows = signed(docs.select("doc_id", "text"), "text", "signs")
    rows = stored(rows.select("doc_id", F.sha2(fingerprint(F.col("signs")), 256).alias("key")))
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep")).join(labels, "rep", "left")
    reps = stored(reps.select("key", F.coalesce("label", "rep").alias("class_id")))
    return rows.join(reps, "key").select("doc_id", "class_id")
