"""Queries on sources, splits, scaling, sequences and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.operators import profile, scale, sequence, split
from clinframe.queries import inputs as i
from clinframe.queries.inputs import LABS, ORDER_VISITS, VISITS
from clinframe.queries.registry import query
from clinframe.schema import VisitSchema, col
from clinframe.session import scratch, stored
from clinframe.sources import corpus, tables, visits

DIGITS = 6


def rounded(names, digits: int = DIGITS) -> list[Column]:
    return [F.round(col(n), digits).alias(n) for n in names]


def rounded_sql(names, digits: int = DIGITS) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


# --- sources ---------------------------------------------------------------------------------------


@query(
    "read_visits",
    "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events",
)
def read_visits(spark: SparkSession, sf: str) -> DataFrame:
    df = visits.read_visits(spark, f"{sf}/events.parquet")
    return df.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "read_visits_csv",
    "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events",
)
def read_visits_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    kept = i.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    kept.write.option("header", True).csv(path)
    df = visits.read_visits(spark, path, "csv", kept.schema)
    return df.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "select_schema",
    f"WITH {i.VISITS_SQL} SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS record_id, user_id, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, outcome, los, readmission, "
    + ", ".join(LABS)
    + " FROM visits",
)
def select_schema(spark: SparkSession, sf: str) -> DataFrame:
    schema = VisitSchema(
        key="record_id",
        time="ts",
        tiebreak=("event_id",),
        patient="user_id",
        admission="admission",
        targets=VISITS.targets,
        numeric=LABS,
    )
    raw = i.visits(spark, sf).withColumn("admission", F.date_format("ts", "yyyyMMdd"))
    # NaN stands for a missing lab in files written elsewhere.
    raw = raw.withColumns({f: F.coalesce(col(f), F.lit(float("nan"))) for f in LABS})
    out = visits.select_schema(raw, schema)
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "read_corpus",
    "SELECT substr(text, 1, 40) AS title, length(text)::BIGINT AS characters, md5(text) AS digest "
    "FROM documents",
)
def read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    docs = i.corpus_docs(spark, sf).select("title", "content")
    docs.write.json(path)
    read = corpus.read_corpus(spark, path, "docs")
    return read.select(
        "title",
        F.length("content").cast("bigint").alias("characters"),
        F.md5(F.col("content").cast("binary")).alias("digest"),
    )


@query(
    "write_table",
    "SELECT event_type, count(*) AS visits, count(DISTINCT user_id) AS records, "
    "round(sum(value), 2) AS total FROM events GROUP BY 1",
)
def write_table(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.write_table(
        i.table(spark, sf, "events").select("event_type", "user_id", "value"),
        scratch(spark),
        ["event_type"],
    )
    # Distinct records by two-step counting: the first step is combined before its shuffle.
    per_record = spark.read.parquet(path).groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")
    )
    return per_record.groupBy("event_type").agg(
        F.sum("n").alias("visits"),
        F.count(F.lit(1)).alias("records"),
        F.round(F.sum("v"), 2).alias("total"),
    )


@query(
    "pending",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def pending(spark: SparkSession, sf: str) -> DataFrame:
    done = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    todo = i.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return visits.pending(todo, done, "o_orderkey")


# --- labels and splits -------------------------------------------------------------------------------


@query(
    "record_label_first",
    f"WITH {i.ORDER_VISITS_SQL} SELECT o_custkey, outcome FROM order_visits QUALIFY row_number() "
    "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
)
def record_label_first(spark: SparkSession, sf: str) -> DataFrame:
    return split.record_label(i.order_visits(spark, sf), ORDER_VISITS, "first")


@query(
    "record_label_last",
    f"WITH {i.VISITS_SQL} SELECT user_id, outcome, los, readmission FROM visits QUALIFY "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def record_label_last(spark: SparkSession, sf: str) -> DataFrame:
    return split.record_label(i.visits(spark, sf), VISITS, "last")


def visit_split(spark: SparkSession, sf: str) -> DataFrame:
    labels = split.record_label(i.visits(spark, sf), VISITS, "first", ["outcome"])
    return split.stratified_split(
        labels, "user_id", "outcome", i.SPLIT_TEST, i.SPLIT_VAL, i.SPLIT_SEED
    )


@query("stratified_split", f"WITH {i.SPLIT_SQL} SELECT user_id, outcome, split FROM split")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return visit_split(spark, sf)


@query(
    "stratified_split_icu_fractions",
    f"WITH {i.ORDER_VISITS_SQL}, labels_v AS (SELECT o_custkey, o_orderstatus FROM order_visits "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1), "
    + i.split_sql("labels_v", "o_custkey", "o_orderstatus", 1 / 100, 4 / 99, 7)
    + " SELECT o_custkey, o_orderstatus, split FROM split",
)
def stratified_split_icu_fractions(spark: SparkSession, sf: str) -> DataFrame:
    labels = split.record_label(i.order_visits(spark, sf), ORDER_VISITS, "first", ["o_orderstatus"])
    return split.stratified_split(labels, "o_custkey", "o_orderstatus", 1 / 100, 4 / 99, 7)


def split_visits(spark: SparkSession, sf: str) -> DataFrame:
    return split.apply_split(i.visits(spark, sf), stored(visit_split(spark, sf)), "user_id")


@query(
    "apply_split",
    f"WITH {i.SPLIT_VISITS_SQL} SELECT event_id, user_id, split FROM parted",
)
def apply_split(spark: SparkSession, sf: str) -> DataFrame:
    return split_visits(spark, sf).select("event_id", "user_id", "split")


@query(
    "shared_ids",
    f"WITH {i.SPLIT_VISITS_SQL}, per_id AS (SELECT user_id, count(DISTINCT split) AS n FROM parted "
    "GROUP BY 1) SELECT count(*) FILTER (n > 1) AS shared_ids FROM per_id",
)
def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    return split.shared_ids(split_visits(spark, sf), "user_id")


@query(
    "exclude_listed",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def exclude_listed(spark: SparkSession, sf: str) -> DataFrame:
    docs = i.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return split.exclude(docs, i.table(spark, sf, "labels"), "doc_id")


@query(
    "every_nth",
    "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k "
    "FROM orders) WHERE k > 600 AND k % 2 = 0",
)
def every_nth(spark: SparkSession, sf: str) -> DataFrame:
    return split.every_nth(
        i.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 2, 600
    )


# --- scaling -----------------------------------------------------------------------------------------

SCALED = (*LABS, "los")
STATS = ("lo", "hi", "mean", "std", "median", "default_fill")


def train_stats(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parted = stored(split_visits(spark, sf), ["split"])
    return parted, scale.fit_trimmed_stats(parted.where(F.col("split") == "train"), SCALED)


@query(
    "trimmed_stats",
    f"WITH {i.TRAIN_SQL}, {i.stats_sql('train', SCALED)} SELECT feature, {rounded_sql(STATS)} FROM stats",
)
def trimmed_stats(spark: SparkSession, sf: str) -> DataFrame:
    return train_stats(spark, sf)[1].select("feature", *rounded(STATS))


def _wide_stats_sql(fields: tuple[str, ...]) -> str:
    return "wide AS (SELECT " + ", ".join(
        f"max(CASE WHEN feature = '{f}' THEN {s} END) AS {s}_{f}" for f in SCALED for s in fields
    ) + " FROM stats)"


def _z_sql(f: str) -> str:
    return f"(({f} - mean_{f}) / (std_{f} + 1e-12))"


@query(
    "zscore",
    f"WITH {i.TRAIN_SQL}, {i.stats_sql('train', SCALED)}, {_wide_stats_sql(('mean', 'std'))} "
    "SELECT event_id, split, " + ", ".join(f"round({_z_sql(f)}, 6) AS {f}" for f in SCALED)
    + " FROM parted, wide",
)
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    parted, stats = train_stats(spark, sf)
    return scale.zscore(parted, stats, SCALED).select("event_id", "split", *rounded(SCALED))


@query(
    "clip_outliers",
    "SELECT o_orderkey, CASE WHEN abs(o_totalprice) > 1e4 THEN 0.0 ELSE o_totalprice END AS o_totalprice "
    "FROM orders",
)
def clip_outliers(spark: SparkSession, sf: str) -> DataFrame:
    o = i.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return scale.clip_outliers(o, ["o_totalprice"])


LOS_FIELDS = ("los_mean", "los_std", "los_median", "large_los", "threshold")


@query(
    "los_info",
    f"WITH {i.TRAIN_SQL}, {i.stats_sql('train', SCALED)}, stays AS (SELECT max(los) AS stay FROM train "
    "GROUP BY user_id), tails AS (SELECT quantile_cont(stay, 0.05) AS p5, quantile_cont(stay, 0.95) "
    "AS p95 FROM stays), half AS (SELECT avg(stay) * 0.5 AS threshold FROM stays, tails WHERE stay >= p5 "
    "AND stay <= p95) SELECT round(mean, 6) AS los_mean, round(std, 6) AS los_std, round(median, 6) AS "
    "los_median, round(p95, 6) AS large_los, round(threshold, 6) AS threshold "
    "FROM stats, tails, half WHERE feature = 'los'",
)
def los_info(spark: SparkSession, sf: str) -> DataFrame:
    parted, stats = train_stats(spark, sf)
    train = parted.where(F.col("split") == "train")
    return scale.los_info(train, VISITS, stats, "los").select(*rounded(LOS_FIELDS))


@query(
    "invert_scale",
    f"WITH {i.VISITS_SQL} SELECT event_id, round(los, 6) AS los FROM visits",
)
def invert_scale(spark: SparkSession, sf: str) -> DataFrame:
    parted, stats = train_stats(spark, sf)
    scaled = scale.zscore(parted, stats, SCALED)
    fit = scaled.withColumn("_s", scale.by_feature(stats, ["los"], ["mean", "std"]))
    back = scale.invert_scale(
        F.col("los"), scale.fitted("_s", 0, "mean"), scale.fitted("_s", 0, "std")
    )
    return fit.select("event_id", F.round(back, 6).alias("los"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(
        f"CASE WHEN o_orderstatus = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderstatus->{s}\""
        for s in STATUSES
    )
    + ", "
    + ", ".join(
        f"CASE WHEN o_orderpriority = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderpriority->{s}\""
        for s in PRIORITIES
    )
    + " FROM orders",
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    o = i.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return scale.one_hot(o, ORDER_VISITS.categorical)


@query("decode_one_hot", "SELECT o_orderkey, o_orderpriority AS priority FROM orders")
def decode_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    o = i.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    coded = scale.one_hot(o, ["o_orderpriority"])
    levels = [c for c in coded.columns if c.startswith("o_orderpriority->")]
    return coded.select("o_orderkey", scale.decode_one_hot(levels).alias("priority"))


@query(
    "drop_all_null",
    f"WITH {i.VISITS_SQL} SELECT event_id, f_click, f_view FROM visits "
    "WHERE f_click IS NOT NULL OR f_view IS NOT NULL",
)
def drop_all_null(spark: SparkSession, sf: str) -> DataFrame:
    v = i.visits(spark, sf).select("event_id", "f_click", "f_view")
    return scale.drop_all_null(v, ["f_click", "f_view"])


# --- sequences ---------------------------------------------------------------------------------------

LAST_SO_FAR = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def _filled_sql(source: str, fill, keep: str) -> str:
    return f"SELECT {keep}, " + ", ".join(
        f"coalesce(last_value({f} IGNORE NULLS) {LAST_SO_FAR}, {fill(f)}) AS {f}" for f in LABS
    ) + f" FROM {source}"


FILLED_SQL = (
    f"{i.VISITS_SQL}, filled AS ("
    + _filled_sql("visits", lambda f: "-1.0", "user_id, ts, event_id, outcome, los, readmission")
    + ")"
)


@query(
    "forward_fill",
    f"WITH {FILLED_SQL} SELECT event_id, user_id, {', '.join(LABS)} FROM filled",
)
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    out = sequence.forward_fill(i.visits(spark, sf), VISITS)
    return out.select("event_id", "user_id", *LABS)


@query(
    "forward_fill_scaled",
    f"WITH {i.TRAIN_SQL}, {i.stats_sql('train', SCALED)}, "
    f"{_wide_stats_sql(('mean', 'std', 'default_fill'))}, z AS (SELECT user_id, ts, event_id, split, "
    + ", ".join(f"CASE WHEN abs({_z_sql(f)}) > 1e4 THEN 0 ELSE {_z_sql(f)} END AS {f}" for f in LABS)
    + ", "
    + ", ".join(f"default_fill_{f}" for f in LABS)
    + " FROM parted, wide) SELECT event_id, split, "
    + ", ".join(
        f"round(coalesce(last_value({f} IGNORE NULLS) {LAST_SO_FAR}, default_fill_{f}), 6) AS {f}"
        for f in LABS
    )
    + " FROM z",
)
def forward_fill_scaled(spark: SparkSession, sf: str) -> DataFrame:
    parted, stats = train_stats(spark, sf)
    scaled = scale.clip_outliers(scale.zscore(parted, stats, SCALED), SCALED)
    out = sequence.forward_fill(scaled, VISITS, LABS, stats=stats)
    return out.select("event_id", "split", *rounded(LABS))


@query(
    "raw_fill",
    f"WITH {i.SPLIT_VISITS_SQL}, medians AS (SELECT split, "
    + ", ".join(f"median({f}) AS m_{f}" for f in LABS)
    + " FROM parted GROUP BY 1), joined AS (SELECT p.*, "
    + ", ".join(f"m_{f}" for f in LABS)
    + " FROM parted p JOIN medians m ON p.split = m.split) SELECT event_id, split, "
    + ", ".join(
        f"round(coalesce(last_value({f} IGNORE NULLS) {LAST_SO_FAR}, m_{f}), 6) AS {f}" for f in LABS
    )
    + " FROM joined",
)
def raw_fill(spark: SparkSession, sf: str) -> DataFrame:
    out = sequence.raw_fill(split_visits(spark, sf), VISITS)
    return out.select("event_id", "split", *rounded(LABS))


def numbers_text(x: Column) -> Column:
    """Nested numbers as text, for comparing sequences."""
    cell = lambda v: F.coalesce(F.format_string("%.2f", v), F.lit("nan"))
    visit = lambda v: F.array_join(F.transform(v, cell), ",")
    return F.array_join(F.transform(x, visit), ";")


def _visit_text_sql(names) -> str:
    return " || ',' || ".join(f"coalesce(printf('%.2f', {f}), 'nan')" for f in names)


IN_ORDER = "ORDER BY ts, event_id"


@query(
    "to_sequences",
    f"WITH {FILLED_SQL} SELECT user_id, 0 AS part, count(*)::INTEGER AS length, "
    f"string_agg({_visit_text_sql(LABS)}, ';' {IN_ORDER}) AS x, "
    f"string_agg(los::BIGINT::VARCHAR, ',' {IN_ORDER}) AS stays FROM filled GROUP BY 1",
)
def to_sequences(spark: SparkSession, sf: str) -> DataFrame:
    seqs = sequence.to_sequences(sequence.forward_fill(i.visits(spark, sf), VISITS), VISITS)
    stays = F.transform(F.col("y")["los"], lambda v: v.cast("bigint").cast("string"))
    return seqs.select(
        "user_id", "part", "length", numbers_text(F.col("x")).alias("x"),
        F.array_join(stays, ",").alias("stays"),
    )


@query(
    "missing_mask",
    f"WITH {i.VISITS_SQL} SELECT user_id, 0 AS part, string_agg("
    + " || ".join(f"CASE WHEN {f} IS NULL THEN '1' ELSE '0' END" for f in LABS)
    + f", ';' {IN_ORDER}) AS mask FROM visits GROUP BY 1",
)
def missing_mask(spark: SparkSession, sf: str) -> DataFrame:
    masks = sequence.missing_mask(i.visits(spark, sf), VISITS)
    flags = F.transform("mask", lambda v: F.array_join(v.cast("array<string>"), ""))
    return masks.select("user_id", "part", F.array_join(flags, ";").alias("mask"))


@query(
    "record_times",
    f"WITH {i.VISITS_SQL} SELECT user_id, 0 AS part, string_agg(strftime(ts, '%Y-%m-%d'), ',' {IN_ORDER}) AS times "
    "FROM visits GROUP BY 1",
)
def record_times(spark: SparkSession, sf: str) -> DataFrame:
    times = sequence.record_times(i.visits(spark, sf), VISITS)
    return times.select("user_id", "part", F.array_join("times", ",").alias("times"))


#: Bounds so small that every record counts as hot and continues in parts.
FEW_VISITS, FEW_ROWS = 7, 10


@query(
    "record_times_in_parts",
    f"WITH {i.VISITS_SQL}, placed AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // "
    f"{FEW_VISITS} AS part FROM visits) SELECT user_id, part::INTEGER AS part, count(*)::INTEGER AS length, "
    f"string_agg(strftime(ts, '%Y-%m-%d'), ',' {IN_ORDER}) AS times FROM placed GROUP BY 1, 2",
)
def record_times_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    times = sequence.record_times(i.visits(spark, sf), VISITS, part_visits=FEW_VISITS, hot_rows=FEW_ROWS)
    return times.select("user_id", "part", "length", F.array_join("times", ",").alias("times"))


@query(
    "forward_fill_in_slices",
    f"WITH {FILLED_SQL} SELECT event_id, {', '.join(LABS)} FROM filled",
)
def forward_fill_in_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows as without cutting, though every record is cut."""
    filled = sequence.forward_fill(i.visits(spark, sf), VISITS, hot_rows=FEW_ROWS)
    return filled.select("event_id", *LABS)


@query(
    "first_note",
    "SELECT source, md5(text) AS note FROM documents WHERE lang <> 'en' "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1",
)
def first_note(spark: SparkSession, sf: str) -> DataFrame:
    docs = i.table(spark, sf, "documents").select(
        "source", "doc_id", F.when(F.col("lang") != "en", F.col("text")).alias("note")
    )
    out = sequence.first_note(docs, VisitSchema(key="source", time="doc_id"), "note")
    return out.select("source", F.md5(F.col("note").cast("binary")).alias("note"))


@query(
    "pad_sequences",
    f"WITH {FILLED_SQL}, seqs AS (SELECT user_id, count(*) AS length, "
    f"string_agg({_visit_text_sql(LABS)}, ';' {IN_ORDER}) AS x FROM filled GROUP BY 1), "
    "longest AS (SELECT max(length) AS n FROM seqs) SELECT user_id, 0 AS part, "
    f"x || repeat(';' || '{','.join(['0.00'] * len(LABS))}', (n - length)::BIGINT) AS padded, "
    "repeat('1', length::BIGINT) || repeat('0', (n - length)::BIGINT) AS valid FROM seqs, longest",
)
def pad_sequences(spark: SparkSession, sf: str) -> DataFrame:
    seqs = sequence.to_sequences(sequence.forward_fill(i.visits(spark, sf), VISITS), VISITS)
    padded = sequence.pad_sequences(seqs, len(LABS))
    flags = F.transform("valid", lambda v: v.cast("int").cast("string"))
    return padded.select(
        "user_id", "part", numbers_text(F.col("padded")).alias("padded"), F.array_join(flags, "").alias("valid")
    )


@query(
    "pad_sequences_by_length_class",
    f"WITH {FILLED_SQL}, seqs AS (SELECT user_id, count(*) AS length, "
    f"string_agg({_visit_text_sql(LABS)}, ';' {IN_ORDER}) AS x FROM filled GROUP BY 1), "
    "sized AS (SELECT *, (2 ** ceil(log2(length)))::BIGINT AS n FROM seqs) SELECT user_id, 0 AS part, "
    f"x || repeat(';' || '{','.join(['0.00'] * len(LABS))}', n - length) AS padded, "
    "repeat('1', length) || repeat('0', n - length) AS valid FROM sized",
)
def pad_sequences_by_length_class(spark: SparkSession, sf: str) -> DataFrame:
    seqs = sequence.to_sequences(sequence.forward_fill(i.visits(spark, sf), VISITS), VISITS)
    padded = sequence.pad_sequences(seqs, len(LABS), to=sequence.length_class(F.col("length")))
    flags = F.transform("valid", lambda v: v.cast("int").cast("string"))
    return padded.select(
        "user_id", "part", numbers_text(F.col("padded")).alias("padded"), F.array_join(flags, "").alias("valid")
    )


@query(
    "last_visit",
    f"WITH {FILLED_SQL} SELECT user_id, {', '.join(LABS)}, outcome, los, readmission FROM filled QUALIFY "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def last_visit(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.last_visit(sequence.forward_fill(i.visits(spark, sf), VISITS), VISITS)


@query(
    "union_folds",
    f"WITH {i.SPLIT_VISITS_SQL} SELECT user_id, split, count(*) AS visits FROM parted GROUP BY 1, 2",
)
def union_folds(spark: SparkSession, sf: str) -> DataFrame:
    counted = split_visits(spark, sf).groupBy("user_id", "split").agg(F.count(F.lit(1)).alias("visits"))
    parts = {
        s: counted.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")
    }
    return sequence.union_folds(parts, "user_id")


# --- profiles ----------------------------------------------------------------------------------------

PROFILE = ("mean", "std", "min", "p25", "p50", "p75", "max")


def profile_sql(cells: str, by: str, digits: int) -> str:
    return (
        f"SELECT {by}, feature, count(*) AS count, round(avg(value), {digits}) AS mean, "
        f"round(stddev_samp(value), {digits}) AS std, round(min(value), {digits}) AS min, "
        f"round(quantile_cont(value, 0.25), {digits}) AS p25, round(quantile_cont(value, 0.5), {digits}) AS p50, "
        f"round(quantile_cont(value, 0.75), {digits}) AS p75, round(max(value), {digits}) AS max "
        f"FROM ({cells}) GROUP BY 1, 2"
    )


@query(
    "cohort_profile",
    f"WITH {FILLED_SQL} {profile_sql(i.unpivot_sql('filled', LABS, 'outcome'), 'outcome', 6)}",
)
def cohort_profile(spark: SparkSession, sf: str) -> DataFrame:
    filled = sequence.forward_fill(i.visits(spark, sf), VISITS)
    out = profile.cohort_profile(filled, "outcome", LABS)
    return out.select("outcome", "feature", "count", *rounded(PROFILE))


@query(
    "cohort_profile_orders",
    f"WITH {i.ORDER_VISITS_SQL} "
    + profile_sql(i.unpivot_sql("order_visits", ("o_totalprice", "c_acctbal"), "c_mktsegment"), "c_mktsegment", 5),
)
def cohort_profile_orders(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.cohort_profile(
        i.order_visits(spark, sf), "c_mktsegment", ("o_totalprice", "c_acctbal")
    )
    # Quartiles of cents have four decimals: five keep the comparison clear of ties.
    return out.select("c_mktsegment", "feature", "count", *rounded(PROFILE, 5))


_LAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(
    "profile_last",
    f"WITH {i.VISITS_SQL}, lasts AS (SELECT DISTINCT user_id, last_value(outcome IGNORE NULLS) {_LAST} AS "
    "outcome, "
    + ", ".join(f"last_value({f} IGNORE NULLS) {_LAST} AS {f}" for f in LABS)
    + f" FROM visits) {profile_sql(i.unpivot_sql('lasts', LABS, 'outcome'), 'outcome', 6)}",
)
def profile_last(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.profile_last(i.visits(spark, sf), VISITS, "outcome", LABS)
    return out.select("outcome", "feature", "count", *rounded(PROFILE))


_FIRST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(
    "patient_dim",
    f"WITH {i.VISITS_SQL} SELECT DISTINCT user_id, first_value(f_click IGNORE NULLS) {_FIRST} AS f_click, "
    f"first_value(readmission IGNORE NULLS) {_FIRST} AS readmission FROM visits",
)
def patient_dim(spark: SparkSession, sf: str) -> DataFrame:
    return profile.patient_dim(i.visits(spark, sf), VISITS, ["f_click", "readmission"])


@query(
    "split_sizes",
    f"WITH {i.SPLIT_SQL} SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, "
    "CASE WHEN grouping(outcome) = 1 THEN 'all' ELSE outcome::BIGINT::VARCHAR END AS outcome, "
    "count(*) AS records FROM split GROUP BY ROLLUP (split, outcome)",
)
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    labelled = visit_split(spark, sf).withColumn("outcome", F.col("outcome").cast("bigint"))
    return profile.split_sizes(labelled, "outcome")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts per conversation turn: what users say is prompt, what is answered completion."""
    c = i.table(spark, sf, "conversations")
    size = F.length("text").cast("bigint")
    return c.select(
        F.col("conv_id").alias("patient_id"),
        F.when(F.col("conv_id") % 10 == 0, "error")
        .when(F.col("conv_id") % 10 == 1, "skipped")
        .otherwise("ok")
        .alias("status"),
        F.when(F.col("role") != "assistant", size).otherwise(F.lit(0)).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", size).otherwise(F.lit(0)).alias("completion_tokens"),
        (F.col("turn") + 1).alias("seconds"),
    )


RUNS_SQL = (
    "runs AS (SELECT conv_id AS patient_id, CASE WHEN conv_id % 10 = 0 THEN 'error' WHEN conv_id % 10 = 1 "
    "THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END AS "
    "prompt_tokens, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS completion_tokens, "
    "turn + 1 AS seconds FROM conversations)"
)


@query(
    "run_totals",
    f"WITH {RUNS_SQL} SELECT CASE WHEN grouping(patient_id) = 1 THEN 'all' ELSE patient_id::VARCHAR END "
    "AS patient_id, coalesce(sum(prompt_tokens) FILTER (status = 'ok'), 0)::BIGINT AS prompt_tokens, "
    "coalesce(sum(completion_tokens) FILTER (status = 'ok'), 0)::BIGINT AS completion_tokens, "
    "coalesce(sum(seconds) FILTER (status = 'ok'), 0)::BIGINT AS seconds, "
    "count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'ok') AS processed "
    "FROM runs GROUP BY ROLLUP (patient_id)",
)
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return profile.run_totals(runs(spark, sf), "patient_id")


# --- profiles of batches -----------------------------------------------------------------------------

BATCH_FIELDS = ("mean", "std", "min", "max")


@query(
    "profile_merged",
    f"WITH {i.VISITS_SQL} "
    + " UNION ALL ".join(
        f"SELECT outcome, '{f}' AS feature, count({f}) AS count, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 5) AS std, "
        f"round(min({f}), 5) AS min, round(max({f}), 5) AS max FROM visits GROUP BY outcome"
        for f in LABS
    ),
)
def profile_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of all visits from the states of three batches, by the third of the month they fall in; the
    third joins what the first two were merged into. Visits of a batch are read once."""
    v = i.visits(spark, sf)
    day = F.day("ts")
    batches = [v.where(day <= 10), v.where((day > 10) & (day <= 20)), v.where(day > 20)]
    states = [stored(profile.profile_states(b, "outcome", LABS)) for b in batches]
    before = stored(profile.merge_states(states[0].unionByName(states[1]), "outcome"))
    merged = profile.merge_states(before.unionByName(states[2]), "outcome")
    return profile.profile_of(merged).select("outcome", "feature", "count", *rounded(BATCH_FIELDS, 5))
