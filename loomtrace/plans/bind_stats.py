"""Bindings: statistics, checkpoints, rates and readiness."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..operators import mergeable, stats
from ..session import ensure_checkpoint_dir
from ..sources import views
from ..sources.listing import THRESHOLDS
from ..sources.tables import table
from ..streaming import jobs
from . import checkpoint as cp
from .catalog import query
from .view_sql import EXCHANGES, FEATURES, NORM, TEXTS, TIMINGS, bucket2, rate, sha, wilson, with_views

HALF = "2024-01-16"

COUNTERS_SQL = """count(*) AS captures, count(*) AS complete, count(*) FILTER (request_parse) AS request_parsed,
  count(*) FILTER (response_parse) AS response_parsed, count(*) FILTER (parse) AS parsed,
  count(*) FILTER (success) AS successful, count(*) FILTER (model_completed) AS model_completed,
  count(*) FILTER (refusal) AS refusals, sum(tool_argument_total)::bigint AS tool_argument_total,
  sum(tool_argument_valid)::bigint AS tool_argument_valid"""


@query("structural_counters", with_views(FEATURES, body=f"SELECT {COUNTERS_SQL} FROM feature_rows"))
def structural_counters(spark, folder):
    return stats.structural_counters(views.feature_rows(spark, folder))


DIMS = {
    "endpoint": "endpoint", "model": "model", "status": "status::varchar", "status_class": "status_class",
    "streaming": "streaming::varchar", "route_target": "route_target", "fallback_reason": "fallback_reason",
    "structured_output": "structured_output::varchar", "reasoning_effort": "reasoning_effort", "outcome": "outcome",
    "hour_utc": "strftime(started_at, '%H')", "modalities": "unnest(modalities)",
}
DISTRIBUTIONS_SQL = "\nUNION ALL ".join(
    f"SELECT '{name}' AS dim, value, count(*) AS n FROM (SELECT {sql} AS value FROM feature_rows) GROUP BY value"
    for name, sql in DIMS.items()
)


@query("distributions", with_views(FEATURES, body=DISTRIBUTIONS_SQL))
def distributions(spark, folder):
    return stats.distributions(views.feature_rows(spark, folder))


SERIES_ROWS = ",\nseries_rows AS (" + " UNION ALL ".join(
    f"SELECT event_id, started_at, '{name}' AS series, {name}::bigint AS value FROM feature_rows" for name in stats.SERIES
) + ")"
SERIES_BUCKETS = f""",
series_buckets AS (SELECT series, {bucket2('value')} AS bucket, count(*) AS freq FROM series_rows
  WHERE value >= 0 GROUP BY ALL),
series_hist AS (SELECT series, string_agg(bucket || ':' || freq, ',' ORDER BY bucket) AS histogram FROM series_buckets GROUP BY series),
series_stats AS (SELECT series, count(*) AS "count", sum(value)::varchar AS "sum", sum(value::hugeint * value)::varchar AS sum_squares,
  min(value) AS "min", max(value) AS "max" FROM series_rows WHERE value >= 0 GROUP BY series)"""
SERIES_VIEWS = FEATURES + SERIES_ROWS + SERIES_BUCKETS
SERIES_SQL = with_views(SERIES_VIEWS, body="SELECT s.*, h.histogram FROM series_stats s JOIN series_hist h USING (series)")


def _accumulator_text(accumulators):
    return accumulators.select(
        "series", "count", F.col("sum").cast("string").alias("sum"), F.col("sum_squares").cast("string").alias("sum_squares"),
        "min", "max", stats.histogram_text().alias("histogram"),
    )


@query("series_stats", SERIES_SQL)
def series_stats(spark, folder):
    return _accumulator_text(stats.series_accumulators(stats.series_buckets(views.feature_rows(spark, folder))))


@query(
    "series_quantiles",
    with_views(
        SERIES_VIEWS,
        body="""SELECT s.series, s."count", ((s."sum"::hugeint * 1000 + s."count" // 2) // s."count")::bigint AS mean_milli,
  greatest(0, s.sum_squares::hugeint * 1000000 // s."count"
    - ((s."sum"::hugeint * 1000 + s."count" // 2) // s."count") * ((s."sum"::hugeint * 1000 + s."count" // 2) // s."count"))::varchar AS variance_milli2,
  (SELECT min(bucket) FROM running r WHERE r.series = s.series AND seen >= (s."count" * 50 + 99) // 100) AS p50,
  (SELECT min(bucket) FROM running r WHERE r.series = s.series AND seen >= (s."count" * 95 + 99) // 100) AS p95,
  (SELECT min(bucket) FROM running r WHERE r.series = s.series AND seen >= (s."count" * 99 + 99) // 100) AS p99
FROM series_stats s""",
    ).replace("series_stats AS (", "running AS (SELECT series, bucket, sum(freq) OVER (PARTITION BY series ORDER BY bucket) AS seen FROM series_buckets),\nseries_stats AS (", 1),
)
def series_quantiles(spark, folder):
    finished = stats.finish_series(stats.series_accumulators(stats.series_buckets(views.feature_rows(spark, folder))))
    return finished.select(
        "series", "count", F.col("mean_milli").cast("bigint").alias("mean_milli"),
        F.col("variance_milli2").cast("string").alias("variance_milli2"), *stats.PERCENTS,
    )


@query("series_merge", SERIES_SQL)
def series_merge(spark, folder):
    rows = views.feature_rows(spark, folder)
    early, late = F.col("started_at") < F.lit(HALF), F.col("started_at") >= F.lit(HALF)
    parts = [stats.series_accumulators(stats.series_buckets(rows.where(test))) for test in (early, late)]
    return _accumulator_text(stats.merge_accumulators(*parts))


MAX_CONCURRENCY_SQL = """SELECT coalesce(max(active), 0)::bigint AS max_concurrency FROM (
  SELECT sum(change) OVER (ORDER BY moment, change ROWS UNBOUNDED PRECEDING) AS active FROM (
    SELECT started_at AS moment, 1 AS change FROM timings UNION ALL SELECT completed_at, -1 FROM timings))"""


@query("max_concurrency", with_views(TIMINGS, body=MAX_CONCURRENCY_SQL))
def max_concurrency(spark, folder):
    return stats.max_concurrency(views.timings(spark, folder))


@query(
    "duplicate_counts",
    with_views(FEATURES, body="""SELECT model, count(content_sha256) AS contents, count(DISTINCT content_sha256) AS unique_contents,
  count(content_sha256) - count(DISTINCT content_sha256) AS duplicates FROM feature_rows GROUP BY model"""),
)
def duplicate_counts(spark, folder):
    return stats.duplicate_counts(views.feature_rows(spark, folder), ["model"])


GROUPS_SQL = """count(DISTINCT source_group_kind || source_group_sha256) AS source_groups,
  count(DISTINCT CASE WHEN source_group_kind = 'trajectory' THEN source_group_sha256 END) AS trajectory_groups,
  count(DISTINCT CASE WHEN source_group_kind = 'request' THEN source_group_sha256 END) AS {requests}"""


@query("group_counts", with_views(EXCHANGES, body="SELECT " + GROUPS_SQL.format(requests="untagged_request_groups") + " FROM exchanges"))
def group_counts(spark, folder):
    return stats.group_counts(views.exchanges(spark, folder))


CHECKPOINT_COUNTERS = " UNION ALL ".join(
    f"SELECT 'counter' AS part, '{name}' AS name, '' AS value, ({sql})::bigint AS n FROM feature_rows"
    for name, sql in {
        "captures": "count(*)", "complete": "count(*)", "request_parsed": "count(*) FILTER (request_parse)",
        "response_parsed": "count(*) FILTER (response_parse)", "parsed": "count(*) FILTER (parse)",
        "successful": "count(*) FILTER (success)", "model_completed": "count(*) FILTER (model_completed)",
        "refusals": "count(*) FILTER (refusal)", "tool_argument_total": "sum(tool_argument_total)",
        "tool_argument_valid": "sum(tool_argument_valid)", "unique_contents": "count(DISTINCT content_sha256)",
        "duplicates": "count(*) - count(DISTINCT content_sha256)",
        "source_groups": "count(DISTINCT source_group_kind || source_group_sha256)",
        "trajectory_groups": "count(DISTINCT CASE WHEN source_group_kind = 'trajectory' THEN source_group_sha256 END)",
        "untagged_request_groups": "count(DISTINCT CASE WHEN source_group_kind = 'request' THEN source_group_sha256 END)",
    }.items()
)


CHECKPOINT_SQL = with_views(
    SERIES_VIEWS,
    body=f"""{CHECKPOINT_COUNTERS}
UNION ALL SELECT 'counter', 'max_concurrency', '', max_concurrency FROM ({MAX_CONCURRENCY_SQL})
UNION ALL SELECT 'distribution', dim, value, n FROM ({DISTRIBUTIONS_SQL})
UNION ALL SELECT 'series', series, bucket::varchar, freq FROM series_buckets""",
)


def _halves(rows):
    return rows.where(F.col("started_at") < F.lit(HALF)), rows.where(F.col("started_at") >= F.lit(HALF))


@query("checkpoint_merge", CHECKPOINT_SQL)
def checkpoint_merge(spark, folder):
    """Two checkpoints are merged; the rows are not read again."""
    ensure_checkpoint_dir(spark)
    previous, delta = (cp.Checkpoint.of(half).stored_once() for half in _halves(views.feature_rows(spark, folder)))
    return previous.merge(delta).long()


@query("concurrency_merge", with_views(TIMINGS, body=MAX_CONCURRENCY_SQL))
def concurrency_merge(spark, folder):
    """Calls of even and odd users overlap all the time, so their checkpoints share nearly every busy second."""
    ensure_checkpoint_dir(spark)
    rows = views.feature_rows(spark, folder)
    even, odd = (cp.Checkpoint.of(rows.where(F.col("user_id") % 2 == k)).stored_once() for k in (0, 1))
    return stats.peak_of_seconds(even.merge(odd).seconds)


SKETCHED = {"unique_contents": "content_sha256", "source_groups": "source_group_sha256", "requests": "request_sha256", "events": "event_id"}


@query(
    "distinct_sketches",
    with_views(FEATURES, body=" UNION ALL ".join(
        f"SELECT model, '{name}' AS counter, count(DISTINCT {column}) AS exact, true AS within_bound FROM feature_rows GROUP BY model" for name, column in SKETCHED.items()
    )),
)
def distinct_sketches(spark, folder):
    """Sketches of two checkpoints are put together; their estimates must hold the exact counts within two standard errors."""
    rows = views.feature_rows(spark, folder)
    early, late = (mergeable.distinct_sketches(half, SKETCHED, ["model"]) for half in _halves(rows))
    guessed = mergeable.estimates(mergeable.add_sketches(early.unionByName(late), ["model"]))
    exact = rows.groupBy("model").agg(*[F.count_distinct(column).alias(name) for name, column in SKETCHED.items()])
    exact = exact.select("model", F.inline(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("exact")) for n in SKETCHED])))
    return exact.join(guessed, ["model", "counter"]).select("model", "counter", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within_bound"))


@query("stream_checkpoint", CHECKPOINT_SQL)
def stream_checkpoint(spark, folder):
    """All calls arrive in four files, in an order that has nothing to do with their keys, a third of them twice."""
    rows = views.feature_rows(spark, folder)
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-checkpoint-{uuid.uuid4().hex}"
    twice = rows.unionByName(rows.where(F.col("event_id") % 3 == 0))
    twice.repartition(4, F.xxhash64("user_id", F.hour("started_at"))).write.parquet(f"{place}/arrivals")
    arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/arrivals")
    # The last threshold is the number of calls, so that the last checkpoint holds all of them.
    total = rows.count()
    job = jobs.CheckpointStream(f"{place}/state", [t for t in THRESHOLDS if t < total] + [total])
    query = job.start(arrivals)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return job.read(spark, total).long()


@query(
    "wilson_by_group",
    with_views(FEATURES, body=f"""SELECT status_class, model, captures, parsed, {rate('parsed', 'captures')} AS parse_bps,
  {wilson('parsed', 'captures', '-')} AS parse_wilson_low_bps, {wilson('parsed', 'captures', '+')} AS parse_wilson_high_bps
FROM (SELECT status_class, model, count(*) AS captures, count(*) FILTER (parse) AS parsed FROM feature_rows GROUP BY ALL)"""),
)
def wilson_by_group(spark, folder):
    counted = stats.structural_counters(views.feature_rows(spark, folder), ["status_class", "model"])
    return stats.rates(counted.select("status_class", "model", "captures", "parsed"), "parsed", "captures", "parse")


@query(
    "checkpoint_quality",
    with_views(FEATURES, body="SELECT captures, parsed, successful, duplicates, " + ", ".join(
        f"{rate(s, 'captures')} AS {n}_bps, {wilson(s, 'captures', '-')} AS {n}_wilson_low_bps, {wilson(s, 'captures', '+')} AS {n}_wilson_high_bps"
        for s, n in (("parsed", "parse"), ("successful", "success"), ("duplicates", "duplicate"))
    ) + """ FROM (SELECT count(*) AS captures, count(*) FILTER (parse) AS parsed, count(*) FILTER (success) AS successful,
  count(*) - count(DISTINCT content_sha256) AS duplicates FROM feature_rows)"""),
)
def checkpoint_quality(spark, folder):
    rows = views.feature_rows(spark, folder)
    whole = cp.Checkpoint.of(rows)
    return cp.quality(whole.counters.unionByName(mergeable.distinct_counters(whole.cells)))


# Labels of the test documents: a fixed rule stands in for a labeller.
LABELS_SQL = TEXTS + f""",
doc_labels AS (
  SELECT t.doc_id, t.request_sha256 AS content_sha256, t.lang AS language, t.source AS domain,
    CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'success' ELSE 'partial' END AS outcome,
    CASE WHEN l.toxic = 1 THEN 'unsafe' ELSE 'benign' END AS safety, l.doc_id IS NULL AS abstain,
    CASE WHEN t.n_chars > 500 THEN ['knowledge', 'reasoning'] ELSE ['knowledge'] END AS capabilities, t.split,
    l.doc_id IS NOT NULL AS labelled
  FROM texts t LEFT JOIN labels l USING (doc_id))"""


def doc_labels(spark, folder):
    texts = views.texts(spark, folder)
    labels = table(spark, folder, "labels")
    return texts.join(labels, "doc_id", "left").select(
        "doc_id", F.col("request_sha256").alias("content_sha256"), F.col("lang").alias("language"), F.col("source").alias("domain"),
        F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "success").otherwise("partial").alias("outcome"),
        F.when(F.col("toxic") == 1, "unsafe").otherwise("benign").alias("safety"),
        F.col("quality").isNull().alias("abstain"),
        F.when(F.col("n_chars") > 500, F.array(F.lit("knowledge"), F.lit("reasoning"))).otherwise(F.array(F.lit("knowledge"))).alias("capabilities"),
        "split", F.col("quality").isNotNull().alias("labelled"),
    )


LABEL_DIMS = ("language", "domain", "outcome", "safety")


def _label_long(source: str) -> str:
    parts = [f"SELECT '{d}' AS dim, {d} AS value FROM {source}" for d in LABEL_DIMS]
    parts.append(f"SELECT 'capabilities', unnest(capabilities) FROM {source}")
    parts.append(f"SELECT 'classified', 'all' FROM {source}")
    parts.append(f"SELECT 'abstained', 'all' FROM {source} WHERE abstain")
    return "SELECT dim, value, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@query(
    "label_counts_delta",
    with_views(LABELS_SQL, body=f"""SELECT dim, value, coalesce(c.n, 0) AS n,
  CASE WHEN coalesce(c.n, 0) <> coalesce(p.n, 0) THEN coalesce(c.n, 0) - coalesce(p.n, 0) END AS delta
FROM ({_label_long('doc_labels')}) c FULL JOIN ({_label_long('(SELECT * FROM doc_labels WHERE labelled)')}) p USING (dim, value)"""),
)
def label_counts_delta(spark, folder):
    labels = doc_labels(spark, folder)
    count = lambda rows: stats.label_counts(rows, LABEL_DIMS, ["capabilities"])
    return stats.label_counts_delta(count(labels), count(labels.where("labelled")))


@query(
    "abstain_rate",
    with_views(LABELS_SQL, body=f"""SELECT language, classified, abstained, {rate('abstained', 'classified')} AS abstain_bps,
  {wilson('abstained', 'classified', '-')} AS abstain_wilson_low_bps, {wilson('abstained', 'classified', '+')} AS abstain_wilson_high_bps
FROM (SELECT language, count(*) AS classified, count(*) FILTER (abstain) AS abstained FROM doc_labels GROUP BY language)"""),
)
def abstain_rate(spark, folder):
    counted = doc_labels(spark, folder).groupBy("language").agg(F.count("*").alias("classified"), F.count_if("abstain").alias("abstained"))
    return stats.rates(counted, "abstained", "classified", "abstain")


@query(
    "readiness",
    with_views(LABELS_SQL, body=f"""SELECT captures >= 1000 AS minimum_complete_captures, parse_low >= 9500 AS parse_wilson_lower,
  abstain_high <= 2000 AS abstain_wilson_upper, sources >= 32 AS minimum_unique_sources, filled AS split_quotas,
  captures >= 1000 AND parse_low >= 9500 AND abstain_high <= 2000 AND sources >= 32 AND filled AS ready
FROM (SELECT captures, {wilson('parsed', 'captures', '-')} AS parse_low, {wilson('abstained', 'captures', '+')} AS abstain_high, sources, filled
  FROM (SELECT count(*) AS captures, count(*) FILTER (labelled OR NOT abstain) AS parsed, count(*) FILTER (abstain) AS abstained,
    count(DISTINCT content_sha256) FILTER (split <> 'train') AS sources,
    count(*) FILTER (split = 'dev') >= 16 AND count(*) FILTER (split = 'calibration') >= 8 AND count(*) FILTER (split = 'sealed') >= 8 AS filled
    FROM doc_labels))"""),
)
def readiness(spark, folder):
    labels = doc_labels(spark, folder)
    split = F.col("split")
    filled = None
    for name, quota in (("dev", 16), ("calibration", 8), ("sealed", 8)):
        test = F.count_if(split == name) >= quota
        filled = test if filled is None else filled & test
    facts = labels.agg(
        F.count("*").alias("captures"),
        F.count_if(F.col("labelled") | ~F.col("abstain")).alias("parsed"),
        F.count_if("abstain").alias("abstained"),
        F.count_distinct(F.when(split != "train", F.col("content_sha256"))).alias("sources"),
        filled.alias("quotas_filled"),
    )
    facts = stats.rates(stats.rates(facts, "parsed", "captures", "parse"), "abstained", "captures", "abstain")
    return stats.readiness(facts, 1000, 32, 9500, 2000)


@query(
    "split_counts",
    with_views(TEXTS, body="""SELECT s.split, count(t.doc_id) AS n, bool_and(count(t.doc_id) > 0) OVER () AS training_ready
FROM (VALUES ('train'), ('dev'), ('calibration'), ('sealed')) s(split) LEFT JOIN texts t USING (split) GROUP BY s.split"""),
)
def split_counts(spark, folder):
    return stats.split_counts(views.texts(spark, folder))


ELIGIBLE_SQL = "modalities = ['text'] AND tool_definitions = 0 AND tool_calls = 0 AND success AND model_completed"


def eligible():
    return (
        (F.col("modalities") == F.array(F.lit("text")))
        & (F.col("tool_definitions") == 0) & (F.col("tool_calls") == 0) & F.col("success") & F.col("model_completed")
    )


@query(
    "checkpoint_facts",
    with_views(FEATURES, body=f"""SELECT count(*) AS exchanges, {GROUPS_SQL.format(requests='request_groups')},
  count(*) FILTER (tool_definitions > 0 OR tool_calls > 0) AS tool_bearing_exchanges,
  count(*) FILTER ({ELIGIBLE_SQL}) AS text_eval_eligible_exchanges, max(completed_at) AS created_at, max(key) AS high_water_key
FROM feature_rows"""),
)
def checkpoint_facts(spark, folder):
    return stats.checkpoint_facts(views.feature_rows(spark, folder), eligible())


@query(
    "language_counts",
    with_views(LABELS_SQL, body="""SELECT label AS language, count(*) AS n FROM (
  SELECT CASE WHEN regexp_full_match(raw, '[a-z]{2,3}(-[A-Za-z]{2,4})?|mixed|unknown') THEN raw ELSE 'unknown' END AS label
  FROM (SELECT CASE outcome WHEN 'success' THEN language WHEN 'partial' THEN language || '-' || upper(language)
    ELSE language || '-' || domain END AS raw FROM doc_labels)) GROUP BY label"""),
)
def language_counts(spark, folder):
    labels = doc_labels(spark, folder)
    raw = (
        F.when(F.col("outcome") == "success", F.col("language"))
        .when(F.col("outcome") == "partial", F.concat_ws("-", "language", F.upper("language")))
        .otherwise(F.concat_ws("-", "language", "domain"))
    )
    return labels.groupBy(sf.language_code(raw).alias("language")).agg(F.count("*").alias("n"))


@query(
    "top_values",
    """WITH counted AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY source),
ranked AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM counted)
SELECT value, n, place FROM ranked WHERE place <= 5
UNION ALL SELECT '(others)', coalesce(sum(n), 0)::bigint, 6 FROM ranked WHERE place > 5""",
)
def top_values(spark, folder):
    return stats.top_values(table(spark, folder, "documents"), "source")


@query(
    "progress_view",
    with_views(FEATURES, body=f"""SELECT captured, processed, next_threshold, parsed, {rate('parsed', 'captured')} AS parse_bps,
  {wilson('parsed', 'captured', '-')} AS parse_wilson_low_bps, {wilson('parsed', 'captured', '+')} AS parse_wilson_high_bps
FROM (SELECT count(*) AS captured, count(*) FILTER (started_at < TIMESTAMP '{HALF}') AS processed, count(*) FILTER (parse) AS parsed,
  CASE WHEN processed < 100 THEN 100 WHEN processed < 1000 THEN 1000 WHEN processed < 10000 THEN 10000 WHEN processed < 100000 THEN 100000 END AS next_threshold
  FROM feature_rows)"""),
)
def progress_view(spark, folder):
    rows = views.feature_rows(spark, folder)
    facts = rows.agg(
        F.count("*").alias("captured"),
        F.count_if(F.col("started_at") < F.lit(HALF)).alias("processed"),
        F.count_if("parse").alias("parsed"),
    )
    limits = F.array(*[F.lit(v) for v in (100, 1000, 10000, 100000)])
    following = F.filter(limits, lambda v: v > F.col("processed"))
    facts = facts.withColumn("next_threshold", F.try_element_at(following, F.lit(1)))
    return stats.rates(facts, "parsed", "captured", "parse")


@query(
    "split_assign",
    with_views(TEXTS, body="SELECT doc_id, source_group_sha256, split FROM texts"),
)
def split_assign(spark, folder):
    return views.texts(spark, folder).select("doc_id", "source_group_sha256", "split")


@query(
    "text_normalise",
    f"""SELECT doc_id, {sha(NORM.format(t='text'))} AS ascii_sha256,
  {sha("trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')))")} AS unicode_sha256 FROM documents""",
)
def text_normalise(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        sf.sha256_text(sf.normalise_ascii("text")).alias("ascii_sha256"),
        sf.sha256_text(sf.normalise_unicode("text")).alias("unicode_sha256"),
    )


@query(
    "utc_parse",
    """SELECT event_id, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 4 = 2 THEN date_trunc('second', ts) ELSE ts END AS parsed
FROM (SELECT event_id, ts, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events)""",
)
def utc_parse(spark, folder):
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ts = F.col("ts").cast("timestamp")
    stem = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    # Four spellings of the event time; the last is not UTC and must not parse.
    text = (
        F.when(k % 4 == 0, F.concat(stem, fraction, F.lit("Z")))
        .when(k % 4 == 1, F.concat(stem, fraction, F.lit("789+00:00")))
        .when(k % 4 == 2, F.concat(stem, F.lit("Z")))
        .otherwise(F.concat(stem, F.lit("+02:00")))
    )
    return events.select("event_id", sf.parse_utc(text).alias("parsed"))
