"""Bindings: key listings, samples, splits, plans and evaluation data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..operators import evaldata, features, sampling
from ..operators import labels as label_jobs
from ..session import ensure_checkpoint_dir
from ..sources import listing, shardfiles, sinks, views
from ..sources.tables import table
from ..streaming import jobs
from . import eval_plan
from .catalog import query
from .view_sql import EXCHANGES, FEATURES, NORM, TEXTS, sha, with_views


def doc_keys(spark, folder, name="documents"):
    return table(spark, folder, name).select(F.format_string("d/%09d", "doc_id").alias("key"))


@query(
    "unprocessed_next_batch",
    """WITH left_over AS (SELECT printf('d/%09d', doc_id) AS key FROM documents ANTI JOIN labels USING (doc_id)),
done AS (SELECT count(DISTINCT doc_id) AS n FROM labels),
need AS (SELECT (SELECT min(t) FROM (VALUES (100), (1000), (10000), (100000), (1000000), (10000000)) v(t) WHERE t > n) - n AS needed FROM done)
SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS have FROM left_over), need
WHERE place <= needed AND have >= needed""",
)
def unprocessed_next_batch(spark, folder):
    return listing.next_batch(doc_keys(spark, folder), doc_keys(spark, folder, "labels"))


@query(
    "threshold_probe",
    """SELECT n AS processed_count, t AS next_threshold, coalesce((SELECT count(*) FROM events) >= t, false) AS crossed
FROM (SELECT n, (SELECT min(t) FROM (VALUES (100), (1000), (10000), (100000), (1000000), (10000000)) v(t) WHERE t > n)::bigint AS t
  FROM (SELECT count(DISTINCT doc_id) AS n FROM labels))""",
)
def threshold_probe(spark, folder):
    keys = table(spark, folder, "events").select(F.col("event_id").alias("key"))
    return listing.threshold_probe(keys, doc_keys(spark, folder, "labels"))


PAGE_CURSOR = "d/000000049"


@query(
    "keyset_page",
    f"""SELECT printf('d/%09d', doc_id) AS key, n_chars FROM documents
WHERE printf('d/%09d', doc_id) > '{PAGE_CURSOR}' ORDER BY key LIMIT 1000""",
)
def keyset_page(spark, folder):
    rows = table(spark, folder, "documents").select(F.format_string("d/%09d", "doc_id").alias("key"), "n_chars")
    return listing.keyset_page(rows, PAGE_CURSOR, 1000)


@query(
    "pinned_inputs",
    f"""WITH stored AS (SELECT printf('d/%09d', doc_id) AS key, {sha('text')} AS sha256 FROM documents),
pinned AS (SELECT printf('d/%09d', doc_id) AS key, {sha("text || CASE WHEN toxic = 1 THEN '!' ELSE '' END")} AS sha256 FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT printf('b/%09d', item_id), {sha('text')} FROM benchmark),
once AS (SELECT key, count(*) AS n, min(sha256) AS sha256 FROM pinned GROUP BY key)
SELECT o.key, CASE WHEN n > 1 THEN 'repeated' WHEN s.sha256 IS NULL THEN 'missing' WHEN s.sha256 <> o.sha256 THEN 'differs' ELSE 'ok' END AS status
FROM once o LEFT JOIN stored s USING (key)""",
)
def pinned_inputs(spark, folder):
    docs = table(spark, folder, "documents")
    key = F.format_string("d/%09d", "doc_id").alias("key")
    stored = docs.select(key, sf.sha256_text("text").alias("sha256"))
    seen = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    labelled = docs.join(table(spark, folder, "labels"), "doc_id").select(key, sf.sha256_text(seen).alias("sha256"))
    bench = table(spark, folder, "benchmark").select(F.format_string("b/%09d", "item_id").alias("key"), sf.sha256_text("text").alias("sha256"))
    return listing.pinned_inputs(labelled.unionByName(bench), stored)


@query(
    "label_cache_split",
    with_views(TEXTS, body="""SELECT content_sha256, bool_or(hit) AS cached FROM (
  SELECT request_sha256 AS content_sha256, request_sha256 IN (SELECT request_sha256 FROM texts JOIN labels USING (doc_id) WHERE toxic = 0) AS hit
  FROM texts) GROUP BY content_sha256"""),
)
def label_cache_split(spark, folder):
    texts = views.texts(spark, folder).select("doc_id", F.col("request_sha256").alias("content_sha256"))
    labels = table(spark, folder, "labels")
    config = F.when(F.col("toxic") == 0, "current").otherwise("older")
    cache = texts.join(labels, "doc_id").select("content_sha256", config.alias("config_digest"), F.col("quality").alias("label"))
    hits, misses = listing.label_cache_split(texts, cache, "current")
    return hits.select("content_sha256", F.lit(True).alias("cached")).unionByName(misses.select("content_sha256", F.lit(False).alias("cached")))


# Chain of hourly checkpoints over the events: every hour points to the hour before.
@query(
    "lineage_rows",
    """WITH RECURSIVE days AS (SELECT date_trunc('hour', ts) AS day, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY 1),
edges AS (SELECT day, n, keys, lag(day) OVER (ORDER BY day) AS parent FROM days),
chain AS (SELECT day, parent, 0 AS depth FROM edges WHERE day = (SELECT max(day) FROM edges)
  UNION ALL SELECT e.day, e.parent, c.depth + 1 FROM chain c JOIN edges e ON e.day = c.parent)
SELECT strftime(c.day, '%Y-%m-%d %H') AS checkpoint, c.depth, e.n AS row_count, e.n - e.keys AS repeated_keys,
  sum(e.n) OVER (ORDER BY c.day)::bigint AS total_rows, (e.n - lag(e.n) OVER (ORDER BY c.day))::bigint AS change
FROM chain c JOIN edges e USING (day)""",
)
def lineage_rows(spark, folder):
    from ..sources import lineage

    events = table(spark, folder, "events").select(
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("checkpoint"), F.col("event_id").cast("string").alias("key")
    )
    parents = lineage.chain_by_order(events.select("checkpoint").distinct(), F.substring("checkpoint", 1, 7))
    return lineage.ancestry_summary(spark, parents, events)


SAMPLING_SQL = FEATURES + """,
eligible AS (SELECT * FROM feature_rows WHERE parse)"""


def eligible_features(spark, folder):
    return views.feature_rows(spark, folder).where("parse")


@query(
    "hash_sample",
    with_views(SAMPLING_SQL, body=f"SELECT key, model FROM eligible ORDER BY {sha(chr(39) + 'representative:' + chr(39) + ' || key')} LIMIT 256"),
)
def hash_sample(spark, folder):
    return sampling.hash_sample(eligible_features(spark, folder), 256, "representative:").select("key", "model")


@query(
    "tail_sample",
    with_views(
        SAMPLING_SQL,
        f"""
marked AS (SELECT key, {sha("'representative:' || key")} AS rd, {sha("'tail:' || key")} AS td,
  CASE WHEN NOT success OR NOT parse THEN 'error' END AS r1, CASE WHEN tool_definitions > 0 OR tool_calls > 0 THEN 'tool_use' END AS r2,
  CASE WHEN len(list_filter(modalities, lambda x: x NOT IN ('text', 'unknown'))) > 0 THEN 'multimodal' END AS r3,
  CASE WHEN request_bytes >= greatest(8192, (SELECT quantile_disc(request_bytes, 0.95) FROM eligible)) THEN 'long_context' END AS r4,
  CASE WHEN count(*) OVER (PARTITION BY endpoint, model, status_class, modalities) = 1 THEN 'rare' END AS r5 FROM eligible),
rep AS (SELECT key FROM marked ORDER BY rd LIMIT 256),
tails AS (SELECT key FROM marked WHERE key NOT IN (SELECT key FROM rep) AND coalesce(r1, r2, r3, r4, r5) IS NOT NULL ORDER BY td LIMIT 64)""",
        body="""SELECT m.key, concat_ws(',', CASE WHEN rep.key IS NOT NULL THEN 'representative' END, r1, r2, r3, r4, r5) AS reasons
FROM marked m LEFT JOIN rep ON rep.key = m.key WHERE m.key IN (SELECT key FROM rep UNION ALL SELECT key FROM tails)""",
    ),
)
def tail_sample(spark, folder):
    sample = sampling.tail_sample(eligible_features(spark, folder), 256, 64)
    return sample.select("key", F.array_join("selection_reasons", ",").alias("reasons"))


REPRESENTATIVE_SQL = """row_number() OVER (PARTITION BY source_group_kind, source_group_sha256
  ORDER BY CASE WHEN source_group_kind = 'trajectory' THEN completed_at END DESC NULLS LAST, content_sha256, key)"""


@query(
    "representative_per_group",
    with_views(EXCHANGES, body=f"SELECT key, source_group_sha256 FROM (SELECT *, {REPRESENTATIVE_SQL} AS rn FROM exchanges) WHERE rn = 1"),
)
def representative_per_group(spark, folder):
    return sampling.one_per_group(views.exchanges(spark, folder)).select("key", "source_group_sha256")


@query(
    "dedupe_by_request",
    with_views(TEXTS, body="""SELECT request_sha256, source_group_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY request_sha256
  ORDER BY source_group_sha256, norm_sha256) AS rn FROM texts) WHERE rn = 1"""),
)
def dedupe_by_request(spark, folder):
    texts = views.texts(spark, folder).withColumn("content_sha256", F.col("norm_sha256"))
    return sampling.dedupe_by_request(texts).select("request_sha256", "source_group_sha256")


# Documents as labelled rows of an evaluation plan; reasons follow from the tables.
OPERATION_LIST = "[" + ", ".join(f"'{name}'" for name in sampling.OPERATIONS) + "]"
EVAL_ROWS = TEXTS + f""",
eval_rows AS (
  SELECT t.doc_id, printf('d/%09d', t.doc_id) AS key, text, n_chars, request_sha256, {sha("text || '/' || t.source")} AS content_sha256,
    trajectory_id, source_group_kind, source_group_sha256, split, printf('2024-01-%02dT00:00:00Z', 1 + t.doc_id % 28) AS completed_at,
    {OPERATION_LIST}[(substr(t.source, 4)::int % 10) + 1] AS operation,
    CASE lang WHEN 'en' THEN 'exact' WHEN 'fr' THEN 'reference' WHEN 'de' THEN 'schema' ELSE 'reference' END AS oracle,
    CASE WHEN l.quality IS NULL THEN 9000 WHEN l.quality = 1 THEN 8000 ELSE 6500 END AS confidence_basis_points,
    list_filter([CASE WHEN coalesce(l.toxic, 0) = 0 THEN 'representative' END, CASE WHEN l.toxic = 1 THEN 'error' END,
      CASE WHEN n_chars > 2000 THEN 'long_context' END, CASE WHEN n_chars < 400 THEN 'rare' END], lambda x: x IS NOT NULL) AS selection_reasons
  FROM texts t LEFT JOIN labels l USING (doc_id))"""


def eval_rows(spark, folder):
    texts = views.texts(spark, folder)
    labels = table(spark, folder, "labels")
    number = F.substring("source", 4, 9).cast("int") % 10
    names = F.array(*[F.lit(name) for name in sampling.OPERATIONS])
    oracle = F.when(F.col("lang") == "en", "exact").when(F.col("lang") == "de", "schema").when(F.col("lang") == "fr", "reference").otherwise("human")
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("toxic", F.lit(0)) == 0, "representative"), F.when(F.col("toxic") == 1, "error"),
        F.when(F.col("n_chars") > 2000, "long_context"), F.when(F.col("n_chars") < 400, "rare"),
    ))
    return texts.join(labels, "doc_id", "left").select(
        "doc_id", F.format_string("d/%09d", "doc_id").alias("key"), "text", "n_chars", "request_sha256",
        sf.sha256_text(F.concat("text", F.lit("/"), "source")).alias("content_sha256"),
        "trajectory_id", "source_group_kind", "source_group_sha256", "split",
        F.format_string("2024-01-%02dT00:00:00Z", F.col("doc_id") % 28 + 1).alias("completed_at"),
        F.element_at(names, number + 1).alias("operation"), oracle.alias("oracle"),
        F.when(F.col("quality").isNull(), 9000).when(F.col("quality") == 1, 8000).otherwise(6500).alias("confidence_basis_points"),
        reasons.alias("selection_reasons"),
    )


REP_QUOTA = "(CASE split WHEN 'dev' THEN 12 WHEN 'calibration' THEN 6 WHEN 'sealed' THEN 6 END)"
TAIL_QUOTA = "(CASE split WHEN 'dev' THEN 4 WHEN 'calibration' THEN 2 WHEN 'sealed' THEN 2 END)"
HELD_SQL = EVAL_ROWS + f""",
held_groups AS (SELECT * FROM (SELECT *, {REPRESENTATIVE_SQL} AS rn FROM eval_rows WHERE split <> 'train') WHERE rn = 1),
held AS (SELECT * EXCLUDE (rn, rq) FROM (SELECT *, row_number() OVER (PARTITION BY request_sha256 ORDER BY source_group_sha256, content_sha256) AS rq
  FROM held_groups) WHERE rq = 1),
rep_ranked AS (SELECT *, row_number() OVER (PARTITION BY split, operation ORDER BY pick_sha256) AS turn, list_position({OPERATION_LIST}, operation) AS stratum
  FROM (SELECT *, {sha("'representative:' || split || ':' || source_group_sha256 || content_sha256")} AS pick_sha256 FROM held
    WHERE list_contains(selection_reasons, 'representative'))),
rep_picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY turn, stratum) AS pick FROM rep_ranked) WHERE pick <= {REP_QUOTA})"""


@query("round_robin_sample", with_views(HELD_SQL, body="SELECT split, key, operation, pick FROM rep_picked"))
def round_robin_sample(spark, folder):
    held = eval_plan.held_out_sources(eval_rows(spark, folder))
    digest = sf.sha256_text(F.concat(F.lit("representative:"), "split", F.lit(":"), "source_group_sha256", "content_sha256"))
    ready = held.where(F.array_contains("selection_reasons", "representative")).withColumn("pick_sha256", digest)
    picked = sampling.round_robin(ready, sampling.allocation(24), sampling.OPERATIONS, "operation", "pick_sha256")
    return picked.select("split", "key", "operation", "pick")


TAIL_NAMES = "[" + ", ".join(f"'{name}'" for name in sampling.TAIL_REASONS) + "]"
PLAN_SQL = "WITH RECURSIVE " + HELD_SQL + f""",
tail_rows AS (SELECT *, {sha("'tail:' || split || ':' || source_group_sha256 || content_sha256")} AS pick_sha256 FROM (
  SELECT h.*, list_concat(list_filter(selection_reasons, lambda x: list_contains({TAIL_NAMES}, x)),
    CASE WHEN confidence_basis_points < 7000 THEN ['low_confidence'] ELSE [] END) AS tail_reasons FROM held h
  WHERE source_group_sha256 NOT IN (SELECT source_group_sha256 FROM rep_picked)) WHERE len(tail_reasons) > 0),
turns AS (
  SELECT split, 0 AS step, []::varchar[] AS picked FROM (VALUES ('dev'), ('calibration'), ('sealed')) s(split)
  UNION ALL
  SELECT split, step + 1, CASE WHEN len(picked) < {TAIL_QUOTA} AND next_row IS NOT NULL THEN list_append(picked, next_row) ELSE picked END
  FROM (SELECT t.split, t.step, t.picked, (SELECT arg_min(r.source_group_sha256, r.pick_sha256) FROM tail_rows r
      WHERE r.split = t.split AND list_contains(r.tail_reasons, {TAIL_NAMES}[(t.step % 6) + 1]) AND NOT list_contains(t.picked, r.source_group_sha256)) AS next_row
    FROM turns t WHERE t.step < 24)),
tail_picked AS (SELECT r.*, list_position(t.picked, r.source_group_sha256) AS pick FROM turns t JOIN tail_rows r ON r.split = t.split
  AND list_contains(t.picked, r.source_group_sha256) WHERE t.step = 24),
plan_rows AS (SELECT split, 'representative' AS selection, NULL::varchar AS tail_reason, key, source_group_sha256, content_sha256 FROM rep_picked
  UNION ALL SELECT split, 'tail', tail_reasons[1], key, source_group_sha256, content_sha256 FROM tail_picked),
plan AS (SELECT *, row_number() OVER (ORDER BY list_position(['dev', 'calibration', 'sealed'], split) * 2 + (selection = 'tail')::int,
    {sha('source_group_sha256 || content_sha256')}) - 1 AS "order",
  {sha("concat_ws(chr(0), 'eval-plan.v1', split, selection, source_group_sha256, content_sha256)")} AS case_id FROM plan_rows)"""


@query("eval_plan", PLAN_SQL + ' SELECT "order", case_id, split, selection, tail_reason, key FROM plan')
def eval_plan_query(spark, folder):
    cases = eval_plan.plan_cases(eval_rows(spark, folder), 24, 8)
    return cases.select("order", "case_id", "split", "selection", "tail_reason", "key")


@query(
    "eval_plan_shortfall",
    PLAN_SQL + f""", wanted AS (SELECT split, 'representative' AS selection, {REP_QUOTA} AS required FROM (VALUES ('dev'), ('calibration'), ('sealed')) s(split)
  UNION ALL SELECT split, 'tail', {TAIL_QUOTA} FROM (VALUES ('dev'), ('calibration'), ('sealed')) s(split))
SELECT w.split, w.selection, required, count(p.key) AS chosen, required - count(p.key) AS missing
FROM wanted w LEFT JOIN plan p ON p.split = w.split AND p.selection = w.selection GROUP BY w.split, w.selection, required""",
)
def eval_plan_shortfall(spark, folder):
    return eval_plan.shortfall(eval_plan.plan_cases(eval_rows(spark, folder), 24, 8), 24, 8)


@query(
    "quota_select",
    with_views(HELD_SQL, body=f"""SELECT split, key FROM (SELECT split, key, row_number() OVER (PARTITION BY split
  ORDER BY {sha("'generation-selection:' || source_group_sha256 || content_sha256")}) AS n FROM held)
WHERE n <= CASE split WHEN 'dev' THEN 20 WHEN 'calibration' THEN 10 ELSE 10 END"""),
)
def quota_select(spark, folder):
    chosen, _ = sampling.quota_select(eval_plan.held_out_sources(eval_rows(spark, folder)), 40)
    return chosen.select("split", "key")


EVAL_UUID = "5f3c2f5e-6a0b-5f0e-9f6d-0d6a7f1f2b3c"
PER_SOURCE = 20
EXPANDED_SQL = HELD_SQL + f""",
seeds AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {sha("'generation-source:' || source_group_sha256 || content_sha256")}) - 1 AS seed_index,
  count(*) OVER (PARTITION BY split) AS size FROM held),
sizes AS (SELECT split, count(*) AS n, list_position(['dev', 'calibration', 'sealed'], split) AS place FROM held GROUP BY split),
starts AS (SELECT split, coalesce(sum(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes),
ordinals AS (SELECT s.split, s.n, unnest(range(s.n * {PER_SOURCE})) AS so,
  (('0x' || substr({sha(f"'{EVAL_UUID}' || chr(0) || s.split")}, 1, 16))::hugeint % s.n)::bigint AS seed_offset FROM sizes s),
expanded AS (SELECT o.so, k.*, (st.start * {PER_SOURCE} + o.so)::bigint AS case_order,
  (st.start * {PER_SOURCE} + (o.so // 256) * 256)::bigint AS shard_start, o.so // o.n AS example
  FROM ordinals o JOIN starts st ON st.split = o.split JOIN seeds k ON k.split = o.split AND k.seed_index = (o.seed_offset + o.so) % o.n),
cases AS (SELECT case_order AS "order", {sha(f"'{EVAL_UUID}' || chr(0) || case_order")} AS case_id, split, key, text, content_sha256, source_group_sha256,
  so AS split_ordinal, shard_start, example AS source_example_index, operation AS source_operation,
  ['answer', 'classify', 'extract', 'summarize', 'transform'][(example % 5) + 1] AS operation,
  CASE WHEN oracle = 'schema' THEN 'reference' ELSE oracle END AS oracle,
  ['object', 'array', 'string', 'number', 'integer', 'boolean'][(('0x' || substr({sha(f"'{EVAL_UUID}' || chr(0) || 'schema' || chr(0) || split || chr(0) || shard_start")}, 1, 16))::hugeint % 6)::int + 1] AS schema_kind
  FROM expanded)"""


def expanded_cases(spark, folder):
    return evaldata.expand_cases(eval_plan.held_out_sources(eval_rows(spark, folder)), EVAL_UUID, PER_SOURCE)


@query(
    "case_expansion",
    with_views(EXPANDED_SQL, body='SELECT "order", case_id, split, key, source_example_index, source_operation, operation, oracle, shard_start, schema_kind FROM cases'),
)
def case_expansion(spark, folder):
    return expanded_cases(spark, folder).select(
        "order", "case_id", "split", "key", "source_example_index", "source_operation", "operation", "oracle", "shard_start", "schema_kind"
    )


ORDERED_SQL = EVAL_ROWS + f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY order_sha256, doc_id) - 1 AS split_ordinal,
  row_number() OVER (ORDER BY list_position(['dev', 'calibration', 'sealed'], split), order_sha256, doc_id) - 1 AS "order",
  {sha("'case:' || doc_id")} AS case_id FROM (
  SELECT *, {sha("source_group_sha256 || content_sha256 || doc_id")} AS order_sha256 FROM eval_rows WHERE split <> 'train'))"""


def ordered_cases(spark, folder):
    digest = sf.order_digest("", "source_group_sha256", "content_sha256", F.col("doc_id").cast("string"))
    held = eval_rows(spark, folder).where(F.col("split") != "train").withColumn("order_sha256", digest)
    return evaldata.case_ordinals(held).withColumn("case_id", sf.sha256_text(F.concat(F.lit("case:"), "doc_id")))


SHARD = 32


@query(
    "shard_ranges",
    with_views(ORDERED_SQL, body=f"""SELECT split, split_ordinal // {SHARD} AS shard, min("order") AS start, max("order") + 1 AS "end", count(*) AS rows
FROM ordered GROUP BY 1, 2"""),
)
def shard_ranges(spark, folder):
    return evaldata.shard_ranges(ordered_cases(spark, folder), SHARD)


@query(
    "shard_digests",
    with_views(ORDERED_SQL, f"""
shards AS (SELECT split, split_ordinal // {SHARD} AS shard, sha256(from_hex(string_agg(case_id, '' ORDER BY "order"))) AS digest FROM ordered GROUP BY 1, 2),
blocks AS (SELECT split, shard // 256 AS block, count(*) AS n, sha256(from_hex(string_agg(digest, '' ORDER BY shard))) AS digest FROM shards GROUP BY 1, 2)""",
        body="SELECT split, sum(n)::bigint AS shards, sha256(from_hex(string_agg(digest, '' ORDER BY block))) AS root_digest FROM blocks GROUP BY 1"),
)
def shard_digests(spark, folder):
    return evaldata.root_digests(evaldata.shard_digests(ordered_cases(spark, folder), shard_rows=SHARD))


FINGERPRINT_SQL = """bit_xor(('0x' || substr({d}, 1, 15))::bigint)"""


@query(
    "split_manifest",
    with_views(TEXTS, body=f"""SELECT split, count(*) AS n, {FINGERPRINT_SQL.format(d=sha('text'))} AS content_xor,
  sum(('0x' || substr({sha('text')}, 1, 15))::hugeint)::varchar AS content_sum FROM texts GROUP BY split"""),
)
def split_manifest(spark, folder):
    from ..sources.sinks import split_manifest as manifest

    return manifest(views.texts(spark, folder), "split", F.col("text"))


def _shard_table(cases):
    shard = F.call_function("div", F.col("split_ordinal"), F.lit(SHARD))
    return cases.groupBy("split", shard.alias("shard")).agg(
        F.min("order").alias("start"), (F.max("order") + 1).alias("end"), F.count("*").alias("rows"), *evaldata.content_fingerprint(F.col("case_id"))
    ).drop("content_sum")


@query(
    "manifest_audit",
    with_views(ORDERED_SQL, f"""
found AS (SELECT split, split_ordinal // {SHARD} AS shard, min("order") AS start, max("order") + 1 AS "end", count(*) AS rows,
  {FINGERPRINT_SQL.format(d=sha('case_id'))} AS content_xor FROM ordered GROUP BY 1, 2),
recorded AS (SELECT split, CASE WHEN shard % 5 = 3 THEN start + 1 ELSE start END AS start, "end", CASE WHEN shard % 3 = 1 THEN rows + 1 ELSE rows END AS rows,
  CASE WHEN shard % 2 = 1 THEN content_xor + 1 ELSE content_xor END AS content_xor FROM found WHERE shard % 7 <> 2),
linked AS (SELECT *, lag("end") OVER (PARTITION BY split ORDER BY start) AS end_before FROM recorded),
joined AS (SELECT split, start, r."end" IS NOT NULL AS here, f."end" IS NOT NULL AS there, r.rows AS rr, f.rows AS fr, r."end" - start AS span,
  r.content_xor AS rx, f.content_xor AS fx, end_before FROM linked r FULL JOIN found f USING (split, start))""",
        body="""SELECT split, start, problem FROM (SELECT split, start, unnest(list_filter([CASE WHEN NOT here THEN 'not_listed' END,
  CASE WHEN NOT there THEN 'not_stored' END, CASE WHEN here AND rr <> span THEN 'count_differs_from_range' END,
  CASE WHEN here AND there AND rr <> fr THEN 'count_differs' END, CASE WHEN here AND there AND rx <> fx THEN 'content_differs' END,
  CASE WHEN start > end_before THEN 'gap' END, CASE WHEN start < end_before THEN 'overlap' END], lambda x: x IS NOT NULL)) AS problem FROM joined)"""),
)
def manifest_audit(spark, folder):
    found = _shard_table(ordered_cases(spark, folder))
    shard = F.col("shard")
    # A manifest with planted faults: moved starts, wrong counts and digests, and left-out shards.
    recorded = found.where(shard % 7 != 2).select(
        "split",
        F.when(shard % 5 == 3, F.col("start") + 1).otherwise(F.col("start")).alias("start"),
        "end",
        F.when(shard % 3 == 1, F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"),
        F.when(shard % 2 == 1, F.col("content_xor") + 1).otherwise(F.col("content_xor")).alias("content_xor"),
    )
    return evaldata.audit_manifest(recorded, found.drop("shard"))


@query(
    "shard_files",
    with_views(ORDERED_SQL, body=f"""SELECT split, split_ordinal // {SHARD} AS shard, min("order") AS start, max("order") + 1 AS "end", count(*) AS rows,
  {FINGERPRINT_SQL.format(d=sha('case_id'))} AS content_xor, NULL::varchar AS problem FROM ordered GROUP BY 1, 2"""),
)
def shard_files(spark, folder):
    """Shards are written as range files; the manifest that the writer made is audited against what lies in the files."""
    cases = ordered_cases(spark, folder).select("split", "split_ordinal", "order", "case_id")
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shard-files-{uuid.uuid4().hex}"
    sinks.write_shards(cases, place, SHARD)
    listed, stored = shardfiles.manifest(spark, place), shardfiles.read(spark, place)
    problems = evaldata.audit_manifest(listed, _shard_table(stored))
    return listed.join(problems, ["split", "start"], "left").select("split", "shard", "start", "end", "rows", "content_xor", "problem")


@query(
    "positional_contract",
    with_views(ORDERED_SQL, body="""SELECT "order", case_id, CASE WHEN quality IS NULL AND confidence_basis_points = 8000 THEN 'missing'
  WHEN n_chars % 10 = 7 THEN 'identity' WHEN octet_length(encode(text)) NOT BETWEEN 1 AND 4096 OR regexp_matches(text, '[\\x00-\\x08]') THEN 'input'
  WHEN octet_length(encode(answer)) NOT BETWEEN 1 AND 4096 THEN 'expected' END AS reason
FROM (SELECT o.*, l.quality, CASE WHEN n_chars % 10 = 3 THEN '' ELSE operation END AS answer FROM ordered o LEFT JOIN labels l USING (doc_id))"""),
)
def positional_contract(spark, folder):
    planned = ordered_cases(spark, folder)
    wrong = F.col("n_chars") % 10
    generated = planned.select(
        "order",
        F.when(wrong == 7, F.lower(F.concat(F.lit("x"), "case_id"))).otherwise(F.col("case_id")).alias("case_id"),
        F.col("text").alias("input"),
        F.when(wrong == 3, "").otherwise(F.col("operation")).alias("expected"),
    )
    return evaldata.generated_contract(planned, generated)


ROLES_SQL = TEXTS + """,
roles AS (SELECT t.*, l.doc_id IS NOT NULL AS labelled FROM texts t LEFT JOIN labels l USING (doc_id))"""


def roles(spark, folder):
    """Labelled documents play the earlier side, the others the new side."""
    return views.texts(spark, folder).join(
        table(spark, folder, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left"
    ).withColumn("labelled", F.coalesce("labelled", F.lit(False)))


@query(
    "copied_from_source",
    with_views(ROLES_SQL, body="SELECT doc_id, norm_sha256 FROM roles WHERE NOT labelled AND norm_sha256 IN (SELECT norm_sha256 FROM roles WHERE labelled)"),
)
def copied_from_source(spark, folder):
    rows = roles(spark, folder)
    sources = rows.where("labelled").select("norm_sha256").distinct()
    return rows.where("NOT labelled").join(sources, "norm_sha256", "left_semi").select("doc_id", "norm_sha256")


@query(
    "ledger_duplicates",
    with_views(ROLES_SQL, body="""SELECT doc_id, CASE WHEN in_ledger THEN 'ledger' ELSE 'batch' END AS found_in FROM (
  SELECT doc_id, norm_sha256 IN (SELECT norm_sha256 FROM roles WHERE labelled) AS in_ledger,
    row_number() OVER (PARTITION BY norm_sha256 ORDER BY doc_id) AS n FROM roles WHERE NOT labelled) WHERE in_ledger OR n > 1"""),
)
def ledger_duplicates(spark, folder):
    rows = roles(spark, folder)
    ledger = rows.where("labelled").select(F.col("norm_sha256").alias("input_sha256"))
    empty = ledger.limit(0)
    fresh = rows.where("NOT labelled").select("doc_id", "text")
    judged = evaldata.judge_cases(fresh, empty, ledger, order="doc_id", text="text")
    mine = judged.where(F.col("reason").isin("duplicate", "vacuous"))
    seen = ledger.distinct().withColumn("old", F.lit(True))
    return mine.join(seen, "input_sha256", "left").select("doc_id", F.when(F.col("old"), "ledger").otherwise("batch").alias("found_in"))


@query(
    "ledger_extend",
    with_views(ROLES_SQL, body="""SELECT count(*) FILTER (p > 0) AS prior, count(*) FILTER (c > 0) AS current, count(*) FILTER (p > 0 AND c > 0) AS overlap,
  count(*) FILTER (p > 1 OR c > 1) AS repeated, count(*) AS extended FROM (
  SELECT norm_sha256, count(*) FILTER (labelled) AS p, count(*) FILTER (NOT labelled) AS c FROM roles GROUP BY norm_sha256)"""),
)
def ledger_extend(spark, folder):
    rows = roles(spark, folder).withColumnRenamed("norm_sha256", "input_sha256")
    return evaldata.ledger_extend(rows.where("labelled"), rows.where("NOT labelled"))


@query(
    "set_difference_report",
    with_views(ROLES_SQL, body="""SELECT request_sha256, 'expected_only' AS side FROM (SELECT request_sha256 FROM roles EXCEPT ALL SELECT request_sha256 FROM roles WHERE labelled)
UNION ALL SELECT request_sha256, 'found_only' FROM (SELECT request_sha256 FROM roles WHERE labelled EXCEPT ALL SELECT request_sha256 FROM roles)"""),
)
def set_difference_report(spark, folder):
    rows = roles(spark, folder)
    return evaldata.set_difference(rows, rows.where("labelled"), "request_sha256")


@query(
    "labels_fanout",
    with_views(ROLES_SQL, body="""SELECT doc_id, label_doc, label_doc IS NULL AS missing FROM roles LEFT JOIN (
  SELECT request_sha256, min(doc_id) AS label_doc FROM roles WHERE labelled GROUP BY 1) USING (request_sha256)"""),
)
def labels_fanout(spark, folder):
    from ..operators.labels import fan_out

    rows = roles(spark, folder)
    labels = rows.where("labelled").groupBy("request_sha256").agg(F.min("doc_id").alias("label_doc"))
    return fan_out(rows, labels, "request_sha256", "label_doc").select("doc_id", "label_doc", "missing")


HELD_OUT_SQL = TEXTS + """,
held_sources AS (SELECT DISTINCT request_sha256, norm_sha256 FROM texts WHERE split <> 'train')"""


@query(
    "heldout_exclusion",
    with_views(HELD_OUT_SQL, body="""SELECT doc_id FROM texts WHERE split = 'train' AND request_sha256 NOT IN (SELECT request_sha256 FROM held_sources)
  AND norm_sha256 NOT IN (SELECT norm_sha256 FROM held_sources)"""),
)
def heldout_exclusion(spark, folder):
    texts = views.texts(spark, folder)
    held = texts.where(F.col("split") != "train")
    return sampling.exclude_held_out(texts.where(F.col("split") == "train"), held, ["request_sha256", "norm_sha256"]).select("doc_id")


# What the exchanges of the documents lack: every fault below keeps a row out of the training selection.
TRAIN_SQL = EVAL_ROWS + f""",
train_rows AS (SELECT * FROM eval_rows WHERE split = 'train' AND doc_id % 31 <> 0 AND doc_id % 37 <> 0 AND doc_id % 41 <> 0 AND doc_id % 13 NOT IN (0, 1)
  AND doc_id % 19 <> 0 AND doc_id % 23 <> 0 AND n_chars > 60 AND request_sha256 NOT IN (SELECT request_sha256 FROM eval_rows WHERE split <> 'train')
  AND content_sha256 NOT IN (SELECT content_sha256 FROM eval_rows WHERE split <> 'train')),
train_groups AS (SELECT * FROM (SELECT *, {REPRESENTATIVE_SQL} AS rn FROM train_rows) WHERE rn = 1)"""


@query(
    "train_selection",
    with_views(TRAIN_SQL, body=f"""SELECT key, source_group_sha256 FROM train_groups
ORDER BY {sha("'train.trajectory.v1:' || source_group_sha256 || content_sha256")} LIMIT 1000"""),
)
def train_selection(spark, folder):
    doc, text = F.col("doc_id"), F.lit("text")
    rows = eval_rows(spark, folder).withColumns({
        "modalities": F.when(doc % 31 == 0, F.array(F.lit("image"), text)).otherwise(F.array(text)),
        "tool_definitions": (doc % 37 == 0).cast("int"),
        "tool_calls": (doc % 41 == 0).cast("int"),
        "success": F.when(doc % 13 == 0, F.lit(None)).otherwise(doc % 13 != 1),
        "model_completed": doc % 19 != 0,
        "parse": doc % 23 != 0,
        "has_request_response_text": F.col("n_chars") > 60,
    })
    held = rows.where(F.col("split") != "train")
    eligible = features.eligible_for_training(F.col("split"))
    return sampling.train_selection(rows, held, 1000, ["request_sha256", "content_sha256"], eligible).select("key", "source_group_sha256")


@query(
    "split_leakage",
    with_views(TEXTS, body="""SELECT identity, value, count(*) AS n FROM (
  SELECT 'group' AS identity, source_group_sha256 AS value, split FROM texts UNION ALL SELECT 'request', request_sha256, split FROM texts
  UNION ALL SELECT 'text', norm_sha256, split FROM texts)
GROUP BY 1, 2 HAVING bool_or(split = 'train') AND bool_or(split <> 'train')"""),
)
def split_leakage(spark, folder):
    return sampling.split_leakage(
        views.texts(spark, folder), {"group": "source_group_sha256", "request": "request_sha256", "text": "norm_sha256"}
    )


FIRST_K_SQL = EXCHANGES + """,
first_base AS (SELECT e.*, CASE WHEN coalesce(l.quality, -1) = 1 THEN NULL WHEN l.quality = 0 THEN 'task_failed' ELSE 'task_outcome_unknown' END AS task,
  e.conv_id % 5 = 1 AS streaming FROM exchanges e LEFT JOIN labels l ON l.doc_id = e.conv_id),
first_split AS (SELECT f.*, %s AS split FROM first_base f),
first_marked AS (SELECT *, CASE WHEN split = 'train' THEN task END AS excluded,
  CASE WHEN streaming THEN 'streaming_not_supported' WHEN NOT model_completed THEN 'incomplete_or_invalid_exchange' END AS unsupported FROM first_split),
first_counted AS (SELECT *, sum((excluded IS NULL AND unsupported IS NULL)::int) OVER (PARTITION BY source_group_sha256 ORDER BY completed_at, key
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS supported_before FROM first_marked),
first_k AS (SELECT key, split, CASE WHEN excluded IS NOT NULL THEN excluded WHEN coalesce(supported_before, 0) >= 1 THEN 'per_group_limit' ELSE unsupported END AS reason FROM first_counted)"""
from .view_sql import split_bucket, split_of  # noqa: E402

FIRST_K_SQL = FIRST_K_SQL.replace("%s AS split", split_of(split_bucket("source_group_sha256", "source_group_kind")) + " AS split")


def first_k_marked(spark, folder):
    """The exchanges with the reasons that come before and after the cap."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    rows = views.exchanges(spark, folder).join(labels, "conv_id", "left").withColumn(
        "split", sf.split_of_group("source_group_sha256", "source_group_kind")
    ).withColumn("completed", sf.parse_utc("completed_at"))
    task = F.when(F.col("quality") == 0, "task_failed").when(F.col("quality").isNull(), "task_outcome_unknown")
    excluded = F.when(F.col("split") == "train", task)
    unsupported = F.when(F.col("conv_id") % 5 == 1, "streaming_not_supported").when(~F.col("model_completed"), "incomplete_or_invalid_exchange")
    return rows, excluded, unsupported


def first_k_rows(spark, folder):
    rows, excluded, unsupported = first_k_marked(spark, folder)
    return sampling.first_k_per_group(rows, "source_group_sha256", ["completed", "key"], 1, excluded, unsupported)


@query("first_k_per_group", with_views(FIRST_K_SQL, body="SELECT key, split, reason FROM first_k"))
def first_k_per_group(spark, folder):
    return first_k_rows(spark, folder).select("key", "split", "reason")


@query("stream_first_k", with_views(FIRST_K_SQL, body="SELECT key, split FROM first_k WHERE reason IS NULL"))
def stream_first_k(spark, folder):
    """The selected rows of `first_k_per_group`, from a stream of files in no order."""
    rows, excluded, unsupported = first_k_marked(spark, folder)
    rows = rows.select("source_group_sha256", "completed", "key", "split", (excluded.isNull() & unsupported.isNull()).alias("supported"))
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-first-{uuid.uuid4().hex}"
    rows.repartition(4, F.xxhash64("key")).write.parquet(f"{place}/arrivals")
    arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/arrivals")
    job = jobs.FirstKStream(place, "source_group_sha256", ["completed", "key"], 1, ["split"])
    query = job.start(arrivals, F.col("supported"))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return job.read(spark).select("key", "split")


@query("reject_reasons", with_views(FIRST_K_SQL, body="SELECT coalesce(reason, 'selected') AS reason, count(*) AS n FROM first_k GROUP BY 1"))
def reject_reasons(spark, folder):
    from ..operators.labels import reason_counts

    return reason_counts(first_k_rows(spark, folder), "reason", none="selected")


@query(
    "outcome_filter",
    with_views(FIRST_K_SQL, body="""SELECT split, coalesce(excluded, 'kept') AS result, count(*) AS n, count(DISTINCT source_group_sha256) AS groups
FROM first_marked GROUP BY 1, 2"""),
)
def outcome_filter(spark, folder):
    from ..operators.labels import outcome_filter as apply

    labels = table(spark, folder, "labels").select(
        sf.source_group_digest(F.lit(""), views.id_uuid(F.col("doc_id"))).alias("source_group_sha256"), (F.col("quality") == 1).alias("task_correct")
    )
    rows = views.exchanges(spark, folder).withColumn("split", sf.split_of_group("source_group_sha256", "source_group_kind"))
    untagged = table(spark, folder, "labels").select(F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("untagged_correct"))
    marked = apply(rows, labels, "source_group_sha256").join(untagged, "conv_id", "left")
    # Request groups have no trajectory; their outcome is recorded per conversation.
    own = F.when(F.col("untagged_correct"), "kept").when(~F.col("untagged_correct"), "task_failed").otherwise("task_outcome_unknown")
    result = F.when((F.col("source_group_kind") == "request") & (F.col("split") == "train"), own).otherwise(F.col("result"))
    return marked.groupBy("split", result.alias("result")).agg(
        F.count("*").alias("n"), F.count_distinct("source_group_sha256").alias("groups")
    )


CASE_BUILD_SQL = EXPANDED_SQL + f""",
generated AS (SELECT "order", case_id, split, operation || ' : ' || CASE WHEN source_example_index % 4 = 0 THEN '' ELSE text END AS input FROM cases),
built AS (SELECT *, {NORM.format(t='input')} AS norm FROM generated),
judged AS (SELECT *, {sha('norm')} AS h FROM built),
copies AS (SELECT DISTINCT norm_sha256 AS h FROM texts),
prior AS (SELECT DISTINCT {sha(NORM.format(t="'extract : ' || text"))} AS h FROM texts JOIN labels USING (doc_id)),
first_of AS (SELECT h, min("order") AS first_order FROM judged GROUP BY h)"""


@query(
    "eval_case_build",
    with_views(CASE_BUILD_SQL, body="""SELECT case_id, CASE WHEN norm = '' THEN 'vacuous' WHEN h IN (SELECT h FROM prior) THEN 'duplicate'
  WHEN h IN (SELECT h FROM copies) THEN 'copied' WHEN "order" > first_order THEN 'duplicate' ELSE 'accepted' END AS reason
FROM judged JOIN first_of USING (h)"""),
)
def eval_case_build(spark, folder):
    texts = views.texts(spark, folder)
    cases = expanded_cases(spark, folder)
    body = F.when(F.col("source_example_index") % 4 == 0, "").otherwise(F.col("text"))
    generated = cases.select("order", "case_id", "split", F.concat("operation", F.lit(" : "), body).alias("input"))
    labelled = texts.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    prior = evaldata.with_input_digest(labelled.select(F.concat(F.lit("extract : "), "text").alias("input"))).select("input_sha256")
    copies = texts.select(F.col("norm_sha256").alias("input_sha256"))
    return evaldata.judge_cases(generated, copies, prior).select("case_id", "reason")


@query(
    "prefix_repetition",
    """WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+', 0), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END) AS tokens FROM documents),
p AS (SELECT s AS prefix_tokens, array_to_string(tokens[1:s], ' ') AS prefix, count(*) AS n FROM t, (VALUES (8), (24)) v(s) WHERE len(tokens) >= s GROUP BY 1, 2)
SELECT prefix_tokens, sum(n)::bigint AS eligible_case_count, count(*) FILTER (n > 1) AS repeated_prefix_count,
  coalesce(sum(n) FILTER (n > 1), 0)::bigint AS cases_in_repeated_prefixes, max(n) AS max_case_count, (max(n) * 10000 // sum(n))::bigint AS max_bps FROM p GROUP BY 1""",
)
def prefix_repetition(spark, folder):
    return evaldata.prefix_repetition(table(spark, folder, "documents"), text="text")


@query(
    "quality_report",
    with_views(EVAL_ROWS, f"""
q AS (SELECT *, octet_length(encode(text)) AS b, {NORM.format(t='text')} AS norm, {sha(NORM.format(t='text'))} AS h FROM eval_rows),
per_source AS (SELECT source_group_sha256, count(*) AS n FROM q GROUP BY 1)""",
        body="""SELECT 'case_count' AS metric, count(*) AS value FROM q UNION ALL SELECT 'exact_unique_input_count', count(DISTINCT h) FROM q
UNION ALL SELECT 'boilerplate_case_count', count(*) FILTER (regexp_matches(norm, 'source example index|source example count|hidden deterministic creative seed|source binding|synthetic eval|synthetic sample|mechanics sample')) FROM q
UNION ALL SELECT 'input_bytes.min', min(b) FROM q UNION ALL SELECT 'input_bytes.max', max(b) FROM q
UNION ALL SELECT 'input_bytes.p50', quantile_disc(b, 0.5) FROM q UNION ALL SELECT 'input_bytes.p95', quantile_disc(b, 0.95) FROM q
UNION ALL SELECT 'source_count', count(*) FROM per_source UNION ALL SELECT 'cases_per_source.min', min(n) FROM per_source
UNION ALL SELECT 'cases_per_source.max', max(n) FROM per_source
UNION ALL SELECT 'operation.' || operation, count(*) FROM q GROUP BY 1
UNION ALL SELECT 'oracle.' || CASE WHEN lang IN ('en', 'fr', 'de') THEN oracle ELSE 'human' END, count(*) FROM q JOIN documents USING (doc_id) GROUP BY 1"""),
)
def quality_report(spark, folder):
    cases = eval_rows(spark, folder).withColumnRenamed("text", "input").withColumn("expected", F.lit(""))
    return evaldata.quality_report(cases)


def stored_sources(spark, folder):
    """Sources of the plan below with planted faults: some have gone, some changed, some are stored twice."""
    docs = table(spark, folder, "documents").where(F.col("doc_id") % 7 != 0)
    changed = F.concat("text", F.when(F.col("doc_id") % 11 == 3, "!").otherwise(""))
    rows = docs.select("doc_id", F.format_string("d/%09d", "doc_id").alias("key"), sf.sha256_text(changed).alias("content_sha256"))
    return rows.unionByName(rows.where(F.col("doc_id") % 13 == 1)).drop("doc_id")


SOURCES_SQL = f"""WITH planned AS (SELECT {sha("'case:' || doc_id")} AS case_id, printf('d/%09d', doc_id) AS key, {sha('text')} AS c FROM documents),
gone AS (SELECT * FROM documents WHERE doc_id % 7 <> 0),
stored AS (SELECT * FROM gone UNION ALL SELECT * FROM gone WHERE doc_id % 13 = 1),
s AS (SELECT printf('d/%09d', doc_id) AS key, count(*) AS n, min({sha("text || CASE WHEN doc_id % 11 = 3 THEN '!' ELSE '' END")}) AS c FROM stored GROUP BY 1),
bound AS (SELECT case_id, CASE WHEN n IS NULL THEN 'no_source' WHEN n > 1 THEN 'ambiguous_source' WHEN s.c <> planned.c THEN 'content_differs' END AS problem
  FROM planned LEFT JOIN s USING (key))
"""


def bound_plan(spark, folder):
    plan = table(spark, folder, "documents").select(
        sf.sha256_text(F.concat(F.lit("case:"), "doc_id")).alias("case_id"), F.format_string("d/%09d", "doc_id").alias("key"), sf.sha256_text("text").alias("content_sha256")
    )
    return evaldata.bind_sources(plan, stored_sources(spark, folder))


@query("source_binding", SOURCES_SQL + "SELECT case_id, problem FROM bound")
def source_binding(spark, folder):
    return bound_plan(spark, folder).select("case_id", "problem")


@query("unbound_sources", SOURCES_SQL + "SELECT problem, count(*) AS n FROM bound WHERE problem IS NOT NULL GROUP BY 1")
def unbound_sources(spark, folder):
    return evaldata.unbound_sources(bound_plan(spark, folder))


@query(
    "label_references",
    f"""WITH r AS (SELECT 'l/' || doc_id AS label_key, {sha("quality || ',' || toxic")} AS label_sha256, {sha("doc_id::varchar")} AS c, doc_id FROM labels)
SELECT label_key, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 10 = 3 THEN 'digest_differs' WHEN doc_id % 8 = 5 THEN 'content_differs' END AS problem FROM r""",
)
def label_references(spark, folder):
    kept = table(spark, folder, "labels").withColumn("label_key", F.concat(F.lit("l/"), "doc_id"))
    digest = lambda extra: sf.sha256_text(F.concat(F.col("quality").cast("string"), F.lit(","), F.col("toxic").cast("string"), extra))
    content = lambda extra: sf.sha256_text(F.concat(F.col("doc_id").cast("string"), extra))
    references = kept.select("label_key", digest(F.lit("")).alias("label_sha256"), content(F.lit("")).alias("content_sha256"))
    fault = lambda place, mark: F.when(place, mark).otherwise("")
    stored = kept.where(F.col("doc_id") % 9 != 0).select(
        "label_key", digest(fault(F.col("doc_id") % 10 == 3, "x")).alias("label_sha256"), content(fault(F.col("doc_id") % 8 == 5, "x")).alias("content_sha256")
    )
    return label_jobs.label_references(references, stored)
