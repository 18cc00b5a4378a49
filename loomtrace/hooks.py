"""Places where users plug in their own functions: labellers, generators, judges and scorers.

A plug-in is a pandas function, frame in and frame out, run by `mapInPandas` on Arrow batches. Its output is checked
by Spark jobs; bad rows become reasons, not exceptions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import evaldata
from .operators.labels import label_violations
from .session import ensure_checkpoint_dir
from .sources.listing import label_cache_split

Plugin = Callable[[pd.DataFrame], pd.DataFrame]
LABEL_SCHEMA = (
    "row_id string, operation string, domain string, capabilities array<string>, oracle string, sentiment string, outcome string,"
    " language string, complexity string, answerable boolean, safety string, confidence_basis_points int, abstain boolean"
)
MAX_ATTEMPTS = 8


def _mapped(plugin: Plugin) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames):
        for frame in frames:
            if len(frame):
                yield plugin(frame)

    return run


def label_with(rows: DataFrame, labeller: Plugin) -> tuple[DataFrame, DataFrame]:
    """Label each distinct content once. Returns the labels that hold the contract and the broken rules.

    Rows need content_sha256; the labeller answers with LABEL_SCHEMA, row_id being the content digest.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    distinct = rows.dropDuplicates(["content_sha256"])
    # A labeller may answer differently when run again, so its answers are fixed before they are checked.
    labels = distinct.mapInPandas(_mapped(labeller), LABEL_SCHEMA).checkpoint()
    broken = label_violations(labels, distinct.select(F.col("content_sha256").alias("row_id")))
    return labels.join(broken.select("row_id").distinct(), "row_id", "left_anti"), broken


def label_missing(sample: DataFrame, cache: DataFrame, config_digest: str, labeller: Plugin) -> tuple[DataFrame, DataFrame]:
    """Labels of a sample: taken from the cache (config_digest, content_sha256, label fields) or asked for once."""
    hits, misses = label_cache_split(sample, cache, config_digest)
    labels, broken = label_with(misses, labeller)
    names = labels.columns
    cached = hits.withColumn("row_id", F.col("content_sha256")).select(*names)
    return cached.unionByName(labels), broken


def keyword_labeller(frame: pd.DataFrame) -> pd.DataFrame:
    """A labeller that works without any model: a few key words decide; what they do not reach is marked as abstained."""
    text = frame["request_text"].fillna("").str.lower()
    operation = pd.Series("other", index=frame.index)
    for word, name in (("summar", "summarize"), ("extract", "extract"), ("classif", "classify"), ("?", "answer"), ("code", "code")):
        operation = operation.mask(operation.eq("other") & text.str.contains(word, regex=False), name)
    known = operation.ne("other")
    return pd.DataFrame(
        {
            "row_id": frame["content_sha256"], "operation": operation, "domain": "general",
            "capabilities": [["instruction_following"]] * len(frame), "oracle": "reference", "sentiment": "neutral", "outcome": "unknown",
            "language": "unknown", "complexity": "unknown", "answerable": known, "safety": "unknown",
            "confidence_basis_points": known.map({True: 8000, False: 3000}).astype("int32"), "abstain": ~known,
        }
    )


def generate_with(planned: DataFrame, generator: Plugin, schema: str = "order bigint, case_id string, input string, expected string") -> DataFrame:
    """Run a text generator over planned rows."""
    return planned.mapInPandas(_mapped(generator), schema)


def build_cases(
    planned: DataFrame, generator: Callable[[int], Plugin], source_digests: DataFrame, ledger: DataFrame, attempts: int = MAX_ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """Generate, check and accept cases; rejected ones are generated again, at most `attempts` times.

    Returns accepted cases and the (attempt, case_id, reason) history. `generator` gets the attempt number. The loop
    is over attempts, never over rows. Each attempt is fixed by a checkpoint, since a generator need not repeat itself.
    """
    if attempts < 1:
        raise ValueError(f"{attempts} attempts make no cases")
    ensure_checkpoint_dir(planned.sparkSession)
    pending, accepted, history = planned, None, None
    for attempt in range(attempts):
        generated = generate_with(pending, generator(attempt)).checkpoint()
        broken = evaldata.generated_contract(pending, generated).where(F.col("reason").isNotNull())
        sound = generated.join(broken.select("order"), "order", "left_anti")
        known = ledger.select("input_sha256") if accepted is None else ledger.select("input_sha256").unionByName(accepted.select("input_sha256"))
        judged = evaldata.judge_cases(sound, source_digests, known).checkpoint()
        fresh = judged.where("accepted").drop("accepted", "reason")
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        refused = judged.where("NOT accepted").select("case_id", "reason").unionByName(broken.select("case_id", "reason"))
        step = refused.withColumn("attempt", F.lit(attempt))
        history = step if history is None else history.unionByName(step)
        pending = pending.join(fresh.select("order"), "order", "left_anti")
        if pending.limit(1).count() == 0:
            break
    return accepted, history


def judge_with(pairs: DataFrame, judge: Plugin, keys: list[str]) -> DataFrame:
    """Ask a judge about pairs shown in an order that the pair digest decides; unknown answers become `unclear`.

    Pairs carry pair_sha256, baseline and candidate. The judge sees answer_a and answer_b and answers keys + verdict.
    """
    even = F.conv(F.substring("pair_sha256", 1, 2), 16, 10).cast("int") % 2 == 0
    shown = pairs.withColumn("answer_a", F.when(even, F.col("baseline")).otherwise(F.col("candidate"))).withColumn(
        "answer_b", F.when(even, F.col("candidate")).otherwise(F.col("baseline"))
    )
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{name} {types[name]}" for name in keys) + ", verdict string"
    said = shown.drop("baseline", "candidate").mapInPandas(_mapped(judge), schema)
    verdict = F.when(F.col("verdict").isin("A", "B", "tie", "unclear"), F.col("verdict")).otherwise("unclear")
    return pairs.select(*keys, "pair_sha256").join(said.withColumn("verdict", verdict), keys, "left")


#: What a checker may answer: members, most metrics, their names, and the longest reason.
ANSWER, METRICS, METRIC, REASON = ("task_correct", "metrics", "reason"), 32, "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$", 300


def checked_answers(said: DataFrame) -> DataFrame:
    """Checker answers (column `answer`, JSON) as typed columns, with the first problem of each as `problem`."""
    # Imported here: plug-ins that name this module are sent to workers with it, which a used function of Spark's cannot be.
    from .functions.jsonrules import strict_json_ok

    strict = F.coalesce(strict_json_ok("answer"), F.lit(False))
    free = F.when(strict, F.try_parse_json("answer"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get(free, f"$.{name}", "variant"))
    rows = said.withColumn("__names", F.when(strict, F.json_object_keys("answer"))).withColumn("__free", F.struct(*[kind(n).alias(n) for n in ANSWER]))
    typed = F.from_json("answer", "task_correct boolean, metrics map<string,double>, reason string")
    rows = rows.withColumn("__typed", typed)
    metrics, reason = F.coalesce("__typed.metrics", F.create_map().cast("map<string,double>")), F.coalesce("__typed.reason", F.lit(""))
    given = lambda name: F.array_contains("__names", name)
    bad_metric = F.exists(F.map_entries(metrics), lambda e: ~e["key"].rlike(METRIC) | e["value"].isNull() | F.isnan(e["value"]) | (F.abs(e["value"]) == float("inf")))
    numbers = F.coalesce(~F.col("__free.metrics").rlike(": (STRING|BOOLEAN|VOID|OBJECT|ARRAY)"), F.lit(True))
    problem = (
        F.when(F.col("__names").isNull() | (F.size(F.array_except("__names", F.array(*map(F.lit, ANSWER)))) > 0), "checker_invalid")
        .when(~F.coalesce(F.col("__free.task_correct") == "BOOLEAN", F.lit(False)), "checker_invalid")
        .when(given("metrics") & ~F.coalesce(F.col("__free.metrics").startswith("OBJECT"), F.lit(False)), "checker_invalid_metrics")
        .when(bad_metric | ~numbers | (F.size(metrics) > METRICS), "checker_invalid_metrics")
        .when(given("reason") & ~F.coalesce(F.col("__free.reason") == "STRING", F.lit(False)), "checker_invalid_reason")
        .when((F.char_length(reason) > REASON) | reason.rlike("[\\p{C}\\p{Zl}\\p{Zp}]|[\\p{Zs}&&[^ ]]"), "checker_invalid_reason")
    )
    rows = rows.withColumn("problem", problem)
    sound = lambda column: F.when(F.col("problem").isNull(), column)
    return rows.select(
        *[c for c in said.columns if c != "answer"],
        sound(F.col("__typed.task_correct")).alias("task_correct"),
        sound(metrics).alias("metrics"),
        sound(reason).alias("reason"),
        "problem",
    )


def score_with(results: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], key: str) -> DataFrame:
    """Run a checker over saved results. Rows stay as they were; task_correct, metrics, reason and problem are added.

    The checker returns one JSON text per row: {"task_correct": bool, "metrics": {...}, "reason": "..."}.
    """
    types = dict(results.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: frame[key], "answer": list(scorer(frame))})

    said = results.mapInPandas(_mapped(run), f"{key} {types[key]}, answer string")
    return results.join(checked_answers(said), key, "left")
