"""Bindings: scoring, metrics, comparisons, ranking and label checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..operators import labels as lb
from ..operators import scoring
from ..operators.ordered import with_neighbour
from ..sources import sinks, views
from ..sources.tables import table
from .catalog import query
from .view_sql import FEATURES, OUTCOMES, RESULTS, TEXTS, TIMINGS, with_views

SCHEMA_TEXT = '{"type":"object","properties":{"answer":{"type":"string"},"n":{"type":"integer"}},"required":["answer"],"additionalProperties":false}'

# Answers of one conversation in a row: each is scored against the one before it.
PAIRS_SQL = f"""
said AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'exact' ELSE 'schema' END AS oracle, text, following FROM said WHERE following IS NOT NULL),
tokens AS (SELECT conv_id, turn, string_split(trim(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' ') AS l,
  string_split(trim(lower(regexp_replace(following, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' ') AS r FROM pairs WHERE oracle = 'reference'),
shared AS (SELECT *, list_intersect(l, r) AS common FROM tokens),
coded AS (SELECT conv_id, turn, len(l) AS n, len(r) AS m, len(common) AS k,
  array_to_string(list_transform(l, lambda t: CASE WHEN list_contains(common, t) THEN chr((35 + list_position(common, t))::int) ELSE '!' END), '') AS a,
  array_to_string(list_transform(r, lambda t: CASE WHEN list_contains(common, t) THEN chr((35 + list_position(common, t))::int) ELSE '"' END), '') AS b FROM shared)"""


@query(
    "score_cases",
    with_views(PAIRS_SQL, body="""SELECT p.conv_id, p.turn, p.oracle, CASE
  WHEN p.oracle = 'exact' THEN CASE WHEN p.turn % 4 = 1 THEN 10000 WHEN p.text = p.following THEN 10000 ELSE 0 END
  WHEN p.oracle = 'schema' THEN CASE WHEN p.turn % 6 = 1 OR p.turn % 6 = 2 THEN 10000 ELSE 0 END
  ELSE floor(greatest(0.0::double, 1.0::double - levenshtein(c.a, c.b)::double / greatest(c.n, c.m, 1)::double) * 10000)::bigint END AS score_bps
FROM pairs p LEFT JOIN coded c USING (conv_id, turn)"""),
)
def score_cases(spark, folder):
    answers = table(spark, folder, "conversations").where(F.col("role") == "assistant")
    pairs = with_neighbour(
        answers, ["conv_id"], "turn", {"following": "text"}, F.call_function("div", F.col("turn"), F.lit(views.TURNS_PER_PIECE))
    ).where(F.col("following").isNotNull())
    kind = F.col("conv_id") % 3
    oracle = F.when(kind == 0, "reference").when(kind == 1, "exact").otherwise("schema")
    padded = F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" \n"), "text", F.lit("\t "))).otherwise(F.col("following"))
    good = F.to_json(F.struct(F.col("following").alias("answer")))
    step = F.col("turn") % 6
    # Fitting, fitting with the optional field, wrong type, repeated key, not a number, text after the value.
    shaped = (
        F.when(step == 1, good)
        .when(step == 2, F.concat(F.expr("left(__good, length(__good) - 1)"), F.lit(',"n":3}')))
        .when(step == 3, F.concat(F.expr("left(__good, length(__good) - 1)"), F.lit(',"n":true}')))
        .when(step == 4, F.concat(F.expr("left(__good, length(__good) - 1)"), F.lit(',"answer":"x"}')))
        .when(step == 5, F.concat(F.expr("left(__good, length(__good) - 1)"), F.lit(',"n":NaN}')))
        .otherwise(F.concat(F.col("__good"), F.lit(" x")))
    )
    cases = pairs.withColumn("__good", good).select(
        "conv_id", "turn", oracle.alias("oracle"),
        F.when(kind == 2, F.lit(SCHEMA_TEXT)).otherwise(F.col("text")).alias("expected"),
        F.when(kind == 0, F.col("following")).when(kind == 1, padded).otherwise(shaped).alias("candidate"),
    )
    return scoring.score_cases(cases, parts=spark.sparkContext.defaultParallelism).select("conv_id", "turn", "oracle", "score_bps")


METRICS_SQL = """SELECT branch, split, count(*) AS case_count, (sum(score_bps) // count(*))::bigint AS mean_score_bps, 0 AS errors,
  sum(latency_ms)::bigint AS total_latency_ms, sum(output_tokens)::bigint AS output_tokens, quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
  round(sum(output_tokens)::double * 1000 / sum(latency_ms)::double, 3) AS tokens_per_second FROM results GROUP BY branch, split"""


def metrics(spark, folder):
    return scoring.eval_metrics(views.results(spark, folder), ["branch", "split"])


@query("eval_metrics", with_views(RESULTS, body=METRICS_SQL))
def eval_metrics(spark, folder):
    return metrics(spark, folder)


TIE_BREAK = ("N", "A", "R")


@query(
    "winner",
    with_views(RESULTS, body=f"""SELECT split, branch, mean_score_bps, p95_latency_ms, tokens_per_second, same_cases FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY mean_score_bps DESC, errors, p95_latency_ms, tokens_per_second DESC, list_position(['N', 'A', 'R'], branch)) AS place,
    min(case_count) OVER (PARTITION BY split) = max(case_count) OVER (PARTITION BY split) AS same_cases FROM ({METRICS_SQL})) WHERE place = 1"""),
)
def winner(spark, folder):
    best = scoring.winner(metrics(spark, folder), "branch", TIE_BREAK, ["split"])
    return best.select("split", "branch", "mean_score_bps", "p95_latency_ms", "tokens_per_second", "same_cases")


@query(
    "parent_comparison",
    with_views(RESULTS, body="""WITH m AS (SELECT branch, split, count(*) AS n, (sum(score_bps) // count(*))::bigint AS s FROM results GROUP BY ALL)
SELECT p.split, p.n = c.n AS comparable, p.s AS parent_mean_score_bps, c.s AS child_mean_score_bps, c.s - p.s AS delta_mean_score_bps,
  CASE WHEN c.s > p.s THEN 'child' ELSE 'parent' END AS selected FROM m p JOIN m c USING (split) WHERE p.branch = 'A' AND c.branch = 'R'"""),
)
def parent_comparison(spark, folder):
    runs = metrics(spark, folder)
    return scoring.parent_comparison(runs.where("branch = 'A'"), runs.where("branch = 'R'"), ["split"])


@query(
    "batch_latency_apportion",
    with_views(TIMINGS, body="""SELECT event_id, (greatest(n, total) // n + (place < greatest(n, total) % n)::int)::bigint AS latency_ms FROM (
  SELECT event_id, count(*) OVER b AS n, max(total_ms) OVER b AS total, row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1 AS place
  FROM timings WINDOW b AS (PARTITION BY event_id // 64))"""),
)
def batch_latency_apportion(spark, folder):
    rows = views.timings(spark, folder).withColumn("batch", F.call_function("div", F.col("event_id"), F.lit(64)))
    longest = rows.groupBy("batch").agg(F.max("total_ms").alias("elapsed"))
    return scoring.apportion_latency(rows.join(longest, "batch"), "batch", "elapsed", "event_id").select("event_id", "latency_ms")


LOAD_SQL = """SELECT model, count(*) FILTER (status = 200) AS succeeded, count(*) FILTER (status <> 200) AS failed,
  count(*) FILTER (status = 200 AND output_tokens % 10 <> 0) AS correct, sum(total_ms)::bigint AS total_elapsed_ms,
  round((epoch_us(max(completed_at)) - epoch_us(min(started_at)))::double / 1000000, 6) AS elapsed_wall_seconds,
  coalesce(sum(output_tokens) FILTER (status = 200), 0)::bigint AS output_tokens,
  quantile_disc(total_ms, 0.5) AS latency_ms_p50, quantile_disc(total_ms, 0.95) AS latency_ms_p95,
  quantile_disc(total_ms // 3, 0.5) FILTER (status = 200) AS ttft_ms_p50, quantile_disc(total_ms // 3, 0.95) FILTER (status = 200) AS ttft_ms_p95
FROM timings GROUP BY model"""
LOAD_FULL_SQL = f"""SELECT *, round(output_tokens::double / (total_elapsed_ms::double / 1000), 3) AS tokens_per_request_second,
  round(output_tokens::double / elapsed_wall_seconds, 3) AS tokens_per_wall_second, round(succeeded::double / elapsed_wall_seconds, 3) AS completed_per_second,
  round(2.5::double * elapsed_wall_seconds / 3600, 6) AS estimated_cost FROM ({LOAD_SQL})"""


def load_test(spark, folder):
    ok = F.col("status") == 200
    requests = views.timings(spark, folder).select(
        "model", F.col("total_ms").alias("latency_ms"), F.call_function("div", F.col("total_ms"), F.lit(3)).alias("ttft_ms"),
        "output_tokens", ok.alias("ok"), (F.col("output_tokens") % 10 != 0).alias("correct"), "started_at", "completed_at",
    )
    return scoring.load_test_summary(requests, ["model"], hourly_rate=2.5)


@query("load_test_summary", with_views(TIMINGS, body=LOAD_FULL_SQL))
def load_test_summary(spark, folder):
    return load_test(spark, folder)


@query(
    "load_test_compare",
    with_views(TIMINGS, f"summary AS ({LOAD_FULL_SQL})", body="""SELECT a.model, CASE WHEN a.failed = b.failed AND b.latency_ms_p95 > 0 THEN round((a.latency_ms_p95::double / b.latency_ms_p95 - 1) * 100, 3) END AS latency_ms_p95_change,
  CASE WHEN a.failed = b.failed AND b.tokens_per_wall_second > 0 THEN round((a.tokens_per_wall_second / b.tokens_per_wall_second - 1) * 100, 3) END AS tokens_per_wall_second_change
FROM summary a JOIN summary b ON b.model = 'click'"""),
)
def load_test_compare(spark, folder):
    runs = load_test(spark, folder)
    facts = F.struct(F.col("failed").alias("failed"), F.col("latency_ms_p95").alias("p95"), F.col("tokens_per_wall_second").alias("rate"))
    joined = runs.withColumn("base", runs.where("model = 'click'").select(facts).scalar())
    matched = F.col("failed") == F.col("base.failed")
    return joined.select(
        "model",
        scoring.percent_change(F.col("base.p95"), F.col("latency_ms_p95"), matched).alias("latency_ms_p95_change"),
        scoring.percent_change(F.col("base.rate"), F.col("tokens_per_wall_second"), matched).alias("tokens_per_wall_second_change"),
    )


@query(
    "best_under_targets",
    with_views(TIMINGS, body=f"""SELECT arg_max(model, tokens_per_wall_second) FILTER (failed = 0 AND latency_ms_p95 <= 60000 AND tokens_per_wall_second >= 0.01) AS selected,
  count(*) FILTER (failed = 0 AND latency_ms_p95 <= 60000 AND tokens_per_wall_second >= 0.01) AS eligible FROM ({LOAD_FULL_SQL})"""),
)
def best_under_targets(spark, folder):
    runs = load_test(spark, folder).select(
        "model", (F.col("failed") == 0).alias("all_correct"), F.col("tokens_per_wall_second").alias("rate"), F.col("latency_ms_p95").alias("p95")
    )
    return scoring.best_under_targets(runs, "model", 0.01, 60_000)


@query(
    "usage_coverage",
    with_views(FEATURES, body="""SELECT user_id, count(*) AS replies, count(output_tokens) FILTER (success) AS output_tokens_replies,
  CASE WHEN count(*) FILTER (success) = count(*) THEN sum(output_tokens)::bigint END AS output_tokens,
  count(cached_tokens) AS cached_tokens_replies, CASE WHEN count(cached_tokens) = count(*) THEN sum(cached_tokens)::bigint END AS cached_tokens
FROM feature_rows GROUP BY user_id"""),
)
def usage_coverage(spark, folder):
    rows = views.feature_rows(spark, folder).withColumn("output_tokens", F.when(F.col("success"), F.col("output_tokens")))
    return scoring.usage_coverage(rows, ["user_id"], ["output_tokens", "cached_tokens"])


@query(
    "reward_advantage",
    with_views(RESULTS, body="""WITH g AS (SELECT l_orderkey, count(*) AS n, sum(score_bps)::bigint AS s, sum(score_bps * score_bps)::bigint AS q FROM results GROUP BY 1)
SELECT r.l_orderkey, r.l_linenumber, r.score_bps, n AS rollout_count, round(s::double / n::double, 3) AS reward_mean_bps,
  round(sqrt((n * q - s * s)::double) / n::double, 3) AS reward_std_bps,
  CASE WHEN n * q <> s * s THEN round((score_bps::double - s::double / n::double) / (sqrt((n * q - s * s)::double) / n::double), 6) END AS advantage,
  CASE WHEN n * q = s * s THEN 'zero_reward_variance' END AS skip_reason FROM results r JOIN g USING (l_orderkey)"""),
)
def reward_advantage(spark, folder):
    rollouts = views.results(spark, folder).select("l_orderkey", "l_linenumber", "score_bps")
    return scoring.reward_advantage(rollouts, "l_orderkey", "score_bps")


@query(
    "result_reconcile",
    with_views(TIMINGS, body="""SELECT split, "order", reason FROM (SELECT model AS split, event_id AS "order", CASE
  WHEN output_tokens % 29 = 0 THEN 'missing_result' WHEN output_tokens % 23 = 0 THEN 'case_differs' WHEN output_tokens % 19 = 0 THEN 'score_out_of_range'
  WHEN status <> 200 THEN 'score_differs' WHEN total_ms < 1 THEN 'latency_invalid' WHEN output_tokens > 90 THEN 'tokens_invalid' END AS reason FROM timings) WHERE reason IS NOT NULL"""),
)
def result_reconcile(spark, folder):
    rows = views.timings(spark, folder)
    k = F.col("output_tokens")
    case = sf.sha256_text(F.concat(F.lit("case:"), "event_id"))
    cases = rows.select(
        F.col("model").alias("split"), F.col("event_id").alias("order"), case.alias("case_id"), F.when(F.col("status") == 200, 10_000).otherwise(0).alias("score_bps")
    )
    # Recorded results with planted differences; failed calls were recorded as if they had answered.
    results = rows.where(k % 29 != 0).select(
        F.col("model").alias("split"), F.col("event_id").alias("order"),
        F.when(k % 23 == 0, F.reverse(case)).otherwise(case).alias("case_id"),
        F.when(k % 19 == 0, 10_001).otherwise(10_000).alias("score_bps"), F.col("total_ms").alias("latency_ms"), "output_tokens",
    )
    return scoring.reconcile_results(cases, results, 90).where(F.col("reason").isNotNull())


SETTINGS_SQL = TEXTS + """,
runs AS (SELECT t.source AS run, l.quality, max(n_chars)::varchar AS max_chars, min(n_chars)::varchar AS min_chars, count(DISTINCT lang)::varchar AS langs,
  CASE WHEN max(toxic) = 1 THEN 'yes' END AS filtered FROM texts t JOIN labels l USING (doc_id) GROUP BY 1, 2),
entries AS (SELECT run, quality, unnest(['max_chars', 'min_chars', 'langs', 'filtered']) AS setting, unnest([max_chars, min_chars, langs, filtered]) AS value FROM runs)"""


@query(
    "setting_differences",
    with_views(SETTINGS_SQL, body="""SELECT coalesce(a.run, b.run) AS run, coalesce(a.setting, b.setting) AS setting, a.value AS before, b.value AS after
FROM (SELECT * FROM entries WHERE quality = 0) a FULL JOIN (SELECT * FROM entries WHERE quality = 1) b ON a.run = b.run AND a.setting = b.setting
WHERE a.value IS DISTINCT FROM b.value"""),
)
def setting_differences(spark, folder):
    rows = views.texts(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    facts = rows.groupBy(F.col("source").alias("run"), "quality").agg(
        F.max("n_chars").cast("string").alias("max_chars"), F.min("n_chars").cast("string").alias("min_chars"),
        F.count_distinct("lang").cast("string").alias("langs"), F.when(F.max("toxic") == 1, "yes").alias("filtered"),
    )
    names = ("max_chars", "min_chars", "langs", "filtered")
    settings = F.create_map(*[part for name in names for part in (F.lit(name), F.col(name))])
    runs = facts.select("run", "quality", settings.alias("settings"))
    return scoring.setting_differences(runs.where("quality = 0"), runs.where("quality = 1"))


@query(
    "preference_tally",
    with_views(TEXTS, body=f"""SELECT lang, CASE WHEN verdict NOT IN ('A', 'B') THEN verdict
  WHEN (verdict = 'A') = (('0x' || substr(request_sha256, 1, 2))::int % 2 = 0) THEN 'baseline' ELSE 'candidate' END AS preference, count(*) AS n FROM (
  SELECT *, CASE WHEN l.quality IS NULL THEN 'unclear' WHEN l.toxic = 1 THEN 'tie' WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS verdict
  FROM texts t LEFT JOIN labels l USING (doc_id)) GROUP BY 1, 2"""),
)
def preference_tally(spark, folder):
    rows = views.texts(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    verdict = F.when(F.col("quality").isNull(), "unclear").when(F.col("toxic") == 1, "tie").when(F.col("quality") == 1, "A").otherwise("B")
    return scoring.preference_tally(rows.withColumn("verdict", verdict), "request_sha256", "verdict", ["lang"])


@query(
    "outcome_matrix",
    with_views(OUTCOMES, body="""SELECT CASE WHEN task_correct IS NULL OR unsafe IS NULL THEN 'unknown' WHEN task_correct AND NOT unsafe THEN 'both_passed'
  WHEN task_correct THEN 'baseline_passed_only' WHEN NOT unsafe THEN 'candidate_passed_only' ELSE 'neither_passed' END AS outcome, count(*) AS n FROM outcomes GROUP BY 1"""),
)
def outcome_matrix(spark, folder):
    runs = views.outcomes(spark, folder)
    return scoring.outcome_matrix(
        runs.select("doc_id", "task_correct"), runs.select("doc_id", (~F.col("unsafe")).alias("task_correct")), "doc_id"
    )


@query(
    "valid_outcomes",
    with_views(OUTCOMES, body="""SELECT doc_id, CASE WHEN task_correct IS NOT NULL AND NOT unsafe THEN task_correct END AS task_correct FROM outcomes"""),
)
def valid_outcomes(spark, folder):
    runs = views.outcomes(spark, folder)
    exit_code = F.when(F.col("unsafe"), 1).otherwise(0)
    valid = lb.valid_outcome(F.col("task_correct"), F.col("task_correct"), exit_code, F.lit(None).cast("string"))
    return runs.select("doc_id", valid.alias("task_correct"))


@query(
    "throughput_milli",
    with_views(TIMINGS, body="""SELECT event_id, (status // 100) || 'xx' AS status_class, status BETWEEN 200 AND 299 AS success,
  CASE WHEN total_ms > 0 THEN output_tokens * 1000000 // total_ms END AS tps_milli FROM timings"""),
)
def throughput_milli(spark, folder):
    return views.timings(spark, folder).select(
        "event_id", sf.status_class("status").alias("status_class"), F.col("status").between(200, 299).alias("success"),
        sf.throughput_milli("output_tokens", "total_ms").alias("tps_milli"),
    )


@query(
    "label_contract_violations",
    with_views(TEXTS, body="""WITH rows_ AS (
  SELECT d.request_sha256 AS row_id, l.doc_id, l.quality, l.toxic, d.source, d.n_chars FROM labels l JOIN texts d USING (doc_id)
  UNION ALL SELECT sha256(encode(text)), NULL, 1, 0, 'src1', 1 FROM benchmark),
found AS (SELECT row_id, count(*) AS n, bool_or(toxic = 1) AS bad_value, bool_or(n_chars % 7 = 0) AS bad_caps, bool_or(n_chars % 11 = 0) AS bad_range FROM rows_ GROUP BY 1),
wanted AS (SELECT DISTINCT request_sha256 AS row_id FROM texts),
j AS (SELECT coalesce(f.row_id, w.row_id) AS row_id, f.n, w.row_id IS NULL AS extra, bad_value, bad_caps, bad_range FROM found f FULL JOIN wanted w USING (row_id))
SELECT row_id, unnest(list_filter([CASE WHEN n IS NULL THEN 'missing_row' END, CASE WHEN extra THEN 'unknown_row' END, CASE WHEN n > 1 THEN 'duplicate_row' END,
  CASE WHEN bad_value THEN 'unknown_taxonomy_value' END, CASE WHEN bad_caps THEN 'invalid_capabilities' END, CASE WHEN bad_range THEN 'invalid_values' END], lambda x: x IS NOT NULL)) AS reason FROM j"""),
)
def label_contract_violations(spark, folder):
    texts = views.texts(spark, folder)
    named = texts.join(table(spark, folder, "labels"), "doc_id").select(F.col("request_sha256").alias("row_id"), "quality", "toxic", "n_chars")
    extra = table(spark, folder, "benchmark").select(
        sf.sha256_text("text").alias("row_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"), F.lit(1).cast("bigint").alias("n_chars")
    )
    rows = named.unionByName(extra)
    # Toxic rows carry an unknown value, and lengths plant repeated capabilities and impossible confidences.
    labels = rows.select(
        "row_id",
        F.when(F.col("toxic") == 1, "guess").otherwise("answer").alias("operation"),
        F.lit("general").alias("domain"), F.lit("reference").alias("oracle"), F.lit("neutral").alias("sentiment"),
        F.when(F.col("quality") == 1, "success").otherwise("partial").alias("outcome"),
        F.lit("low").alias("complexity"), F.lit("benign").alias("safety"), F.lit("en").alias("language"),
        F.when(F.col("n_chars") % 7 == 0, F.array(F.lit("reasoning"), F.lit("reasoning"))).otherwise(F.array(F.lit("reasoning"))).alias("capabilities"),
        F.when(F.col("n_chars") % 11 == 0, 10_001).otherwise(9000).alias("confidence_basis_points"),
        F.lit(True).alias("answerable"), F.lit(False).alias("abstain"),
    )
    return lb.label_violations(labels, texts.select(F.col("request_sha256").alias("row_id")))


STAGES = ["summary", "eval", "dataset", "training"]
STALE_SQL = TEXTS + """,
f AS (SELECT source AS scope, ('0x' || substr(request_sha256, 1, 15))::bigint AS x, coalesce(toxic, 0) AS toxic, quality, lang FROM texts LEFT JOIN labels USING (doc_id)),
d AS (SELECT scope, bit_xor(x) AS all_x, bit_xor(CASE WHEN lang = 'en' AND toxic = 1 THEN 0 ELSE x END) AS seen_x, bit_xor(CASE WHEN lang = 'fr' AND quality = 0 THEN 0 ELSE x END) AS kept_x,
  max(CASE WHEN lang = 'de' AND toxic = 1 THEN 1 ELSE 0 END) AS untrained FROM f GROUP BY scope),
c AS (SELECT scope, true AS s, all_x = seen_x AS e, all_x = seen_x AND all_x = kept_x AS ds, all_x = seen_x AND all_x = kept_x AND untrained = 0 AS t FROM d)"""


@query(
    "stale_artifacts",
    with_views(STALE_SQL, body="""SELECT scope, s AS summary_current, e AS eval_current, ds AS dataset_current, t AS training_current,
  CASE WHEN NOT s THEN 'summary' WHEN NOT e THEN 'eval' WHEN NOT ds THEN 'dataset' WHEN NOT t THEN 'training' ELSE 'done' END AS next_stage FROM c"""),
)
def stale_artifacts(spark, folder):
    rows = views.texts(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    x = F.conv(F.substring("request_sha256", 1, 15), 16, 10).cast("bigint")
    hide = lambda test: F.when(F.coalesce(test, F.lit(False)), F.lit(0).cast("bigint")).otherwise(x)
    lang = F.col("lang")
    per_scope = rows.groupBy(F.col("source").alias("scope")).agg(
        F.bit_xor(x).alias("all"),
        F.bit_xor(hide((lang == "en") & (F.col("toxic") == 1))).alias("seen"),
        F.bit_xor(hide((lang == "fr") & (F.col("quality") == 0))).alias("kept"),
        F.max(F.when((lang == "de") & (F.col("toxic") == 1), 1).otherwise(0)).alias("untrained"),
    )
    # Each stage recorded the rows it saw; scopes without a training table have no row for it.
    text = lambda name: F.col(name).cast("string")
    row = lambda stage, digest, parent, parent_digest: F.struct(
        F.lit(stage).alias("stage"), digest.alias("digest"), F.lit(parent).cast("string").alias("parent_stage"), parent_digest.cast("string").alias("parent_digest")
    )
    artifacts = per_scope.select("scope", "untrained", F.inline(F.array(
        row("summary", text("all"), None, F.lit(None)),
        row("eval", F.concat(F.lit("e"), text("all")), "summary", text("seen")),
        row("dataset", F.concat(F.lit("d"), text("all")), "eval", F.concat(F.lit("e"), text("kept"))),
        row("training", F.concat(F.lit("t"), text("all")), "dataset", F.concat(F.lit("d"), text("all"))),
    ))).where((F.col("stage") != "training") | (F.col("untrained") == 0))
    return sinks.stale_artifacts(artifacts, STAGES)
