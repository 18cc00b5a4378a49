"""Evaluation cases: expansion, contracts, duplicate and copy checks, shards, manifests, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sf
from .ordered import hash_ordinals, nearest_rank_quantiles, with_neighbour

# Rotation of generated operations and kinds of answer schema.
GENERATION_OPERATIONS = ("answer", "classify", "extract", "summarize", "transform")
SCHEMA_KINDS = ("object", "array", "string", "number", "integer", "boolean")
SHARD_ROWS = 256
INPUT_BYTES = 4096
# Phrases that betray template text.
BOILERPLATE = (
    "source example index", "source example count", "hidden deterministic creative seed", "source binding",
    "synthetic eval", "synthetic sample", "mechanics sample",
)


def split_sizes(rows: DataFrame) -> DataFrame:
    """One row: the size of each held-out split and the ordinal at which it starts."""
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    size = lambda name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col("n"))), F.lit(0))
    wide = counts.agg(*[size(name).alias(name) for name in sf.HELD_OUT_SPLITS])
    starts, seen = [], F.lit(0).cast("bigint")
    for name in sf.HELD_OUT_SPLITS:
        starts.append(F.struct(F.lit(name).alias("split"), F.col(name).alias("size"), seen.alias("start")))
        seen = seen + F.col(name)
    return wide.select(F.inline(F.array(*starts)))


def source_order(sources: DataFrame) -> DataFrame:
    """Zero-based place of every source in its split, in hash order."""
    digest = sf.order_digest("generation-source:", "source_group_sha256", "content_sha256")
    return hash_ordinals(sources.withColumn("__digest", digest), ["split"], "__digest", "seed_index").drop("__digest")


def expand_cases(sources: DataFrame, eval_uuid: str, per_source: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`per_source` cases for every source.

    Ordinals walk the seeds of a split round and round from a hash-chosen offset. Turned around, seed i takes
    ordinal e*n + (i - offset) mod n in round e, so each source row unfolds on its own and no ordinal is joined.
    """
    sizes = split_sizes(sources)
    offset_digest = sf.sha256_text(F.concat(F.lit(eval_uuid), F.lit("\0"), F.col("split")))
    placed = source_order(sources).join(F.broadcast(sizes), "split")
    offset = (sf.hex_prefix_number(offset_digest, 16) % F.col("size").cast("decimal(20,0)")).cast("bigint")
    rounds = placed.withColumn("__place", F.pmod(F.col("seed_index") - offset, F.col("size"))).withColumn(
        "source_example_index", F.explode(F.sequence(F.lit(0), F.lit(per_source - 1)))
    )
    inside = F.col("source_example_index") * F.col("size") + F.col("__place")
    first = F.col("start") * per_source
    shard_start = first + F.call_function("div", F.col("__inside"), F.lit(shard_rows)) * shard_rows
    kind_digest = sf.sha256_text(
        F.concat(F.lit(f"{eval_uuid}\0schema\0"), F.col("split"), F.lit("\0"), F.col("shard_start").cast("string"))
    )
    rotation = F.array(*[F.lit(name) for name in GENERATION_OPERATIONS])
    return (
        rounds.withColumn("__inside", inside.cast("bigint"))
        .withColumn("order", first + F.col("__inside"))
        .withColumn("shard_start", shard_start)
        .withColumn("case_id", sf.case_id(F.lit(eval_uuid), "order"))
        .withColumn("source_operation", F.col("operation"))
        .withColumn("operation", F.element_at(rotation, (F.col("source_example_index") % len(GENERATION_OPERATIONS)).cast("int") + 1))
        .withColumn("oracle", F.when(F.col("oracle") == "schema", "reference").otherwise(F.col("oracle")))
        .withColumn("source_example_count", F.lit(per_source))
        .withColumn("schema_kind", sf.hash_choice(kind_digest, SCHEMA_KINDS))
        .drop("__place", "__inside", "size", "start")
    )


def generated_contract(planned: DataFrame, generated: DataFrame, text: str = "input", answer: str = "expected") -> DataFrame:
    """Join plan and output on position and give the first broken rule of each row, NULL if none."""
    joined = planned.alias("p").join(generated.alias("g"), F.col("p.order") == F.col("g.order"), "full")
    control = F.col(f"g.{text}").rlike(r"[\x00-\x08]")
    size = lambda name: F.octet_length(F.col(f"g.{name}"))
    reason = (
        F.when(F.col("g.order").isNull(), "missing")
        .when(F.col("p.order").isNull(), "unplanned")
        .when(~F.col("p.case_id").eqNullSafe(F.col("g.case_id")), "identity")
        .when(F.col(f"g.{text}").isNull() | ~size(text).between(1, INPUT_BYTES) | control, "input")
        .when(F.col(f"g.{answer}").isNull() | ~size(answer).between(1, INPUT_BYTES), "expected")
    )
    return joined.select(
        F.coalesce("p.order", "g.order").alias("order"), F.coalesce("p.case_id", "g.case_id").alias("case_id"), reason.alias("reason")
    )


def verdict_contract(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First broken rule of every verdict: same ids in the same places, known reason, guidance only on rejection."""
    known = ("accepted", "vacuous", "copied", "duplicate")
    joined = cases.alias("c").join(verdicts.alias("v"), F.col("c.order") == F.col("v.order"), "full")
    accepted = F.col("v.accepted")
    reason = (
        F.when(F.col("v.order").isNull(), "missing")
        .when(F.col("c.order").isNull(), "unplanned")
        .when(~F.col("c.case_id").eqNullSafe(F.col("v.case_id")), "identity")
        .when(accepted.isNull() | ~F.coalesce(F.col("v.reason").isin(*known), F.lit(False)), "reason")
        .when(accepted != (F.col("v.reason") == "accepted"), "reason")
        .when(F.col("v.guidance").isNull() | (F.octet_length("v.guidance") > 512) | (accepted != (F.col("v.guidance") == "")), "guidance")
    )
    return joined.select(F.coalesce("c.case_id", "v.case_id").alias("case_id"), reason.alias("violation"))


def target_contract(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """First broken rule of every training target: same group in the same place and 1 to 16384 bytes."""
    joined = sources.alias("s").join(targets.alias("t"), F.col("s.order") == F.col("t.order"), "full")
    reason = (
        F.when(F.col("t.order").isNull(), "missing")
        .when(F.col("s.order").isNull(), "unplanned")
        .when(~F.col("s.source_group_sha256").eqNullSafe(F.col("t.source_group_sha256")), "identity")
        .when(F.col("t.target").isNull() | ~F.octet_length("t.target").between(1, 16384), "target")
    )
    return joined.select(F.coalesce("s.order", "t.order").alias("order"), reason.alias("violation"))


def with_input_digest(cases: DataFrame, text: str = "input") -> DataFrame:
    normal = sf.normalise_ascii(text)
    return cases.withColumn("input_sha256", sf.sha256_text(normal)).withColumn("__vacuous", normal == "")


def judge_cases(cases: DataFrame, source_digests: DataFrame, ledger: DataFrame, order: str = "order", text: str = "input") -> DataFrame:
    """Verdict per case: vacuous, duplicate (of the ledger or of an earlier accepted case), copied or accepted.

    `source_digests` and `ledger` are one-column tables of `input_sha256`. The earliest row of each digest is found by
    an aggregate, so a heavily repeated text never gathers in one window.
    """
    keyed = with_input_digest(cases, text)
    earliest = keyed.groupBy("input_sha256").agg(F.min(order).alias("__earliest"))
    facts = (
        earliest.join(ledger.select("input_sha256").distinct().withColumn("__ledger", F.lit(True)), "input_sha256", "left")
        .join(source_digests.select("input_sha256").distinct().withColumn("__copied", F.lit(True)), "input_sha256", "left")
    )
    reason = (
        F.when(F.col("__vacuous"), "vacuous")
        .when(F.col("__ledger"), "duplicate")
        .when(F.col("__copied"), "copied")
        .when(F.col(order) > F.col("__earliest"), "duplicate")
        .otherwise("accepted")
    )
    judged = keyed.join(facts, "input_sha256")
    return judged.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted").drop(
        "__vacuous", "__ledger", "__copied", "__earliest"
    )


def ledger_extend(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Sizes of a ledger extension: it is sound when nothing overlaps and no digest repeats."""
    sides = prior.select("input_sha256", F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        current.select("input_sha256", F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    digests = sides.groupBy("input_sha256").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    return digests.agg(
        F.count_if(F.col("p") > 0).alias("prior"),
        F.count_if(F.col("c") > 0).alias("current"),
        F.count_if((F.col("p") > 0) & (F.col("c") > 0)).alias("overlap"),
        F.count_if((F.col("p") > 1) | (F.col("c") > 1)).alias("repeated"),
        F.count("*").alias("extended"),
    )


def set_difference(expected: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Values that are only on one side, counted with repeats; empty when the two sides agree."""
    left, right = expected.select(column), found.select(column)
    return (
        left.exceptAll(right).withColumn("side", F.lit("expected_only"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("found_only")))
    )


def case_ordinals(cases: DataFrame, digest: str = "order_sha256") -> DataFrame:
    """Position over all held-out splits: split order first, then digest order."""
    inside = hash_ordinals(cases, ["split"], digest, "__inside")
    return (
        inside.join(F.broadcast(split_sizes(cases)), "split")
        .withColumn("split_ordinal", F.col("__inside"))
        .withColumn("order", F.col("start") + F.col("__inside"))
        .drop("__inside", "size", "start")
    )


def shard_ranges(cases: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Contiguous ranges of at most `shard_rows` rows that never cross a split border."""
    shard = F.call_function("div", F.col("split_ordinal"), F.lit(shard_rows))
    return cases.groupBy("split", shard.alias("shard")).agg(
        F.min("order").alias("start"), (F.max("order") + 1).alias("end"), F.count("*").alias("rows")
    )


def content_fingerprint(column: Column) -> list[Column]:
    """Order-independent, mergeable digest of a set of rows from the digests of the rows."""
    number = F.conv(F.substring(sf.sha256_text(column), 1, 15), 16, 10).cast("bigint")
    return [F.bit_xor(number).alias("content_xor"), F.sum(number.cast("decimal(38,0)")).cast("string").alias("content_sum")]


def audit_manifest(recorded: DataFrame, found: DataFrame, span: int = SHARD_ROWS * 4096) -> DataFrame:
    """Problems of a shard manifest (split, start, end, rows, content_xor) against what is stored."""
    chained = with_neighbour(
        recorded, ["split"], "start", {"__end_before": "end"}, F.call_function("div", F.col("start"), F.lit(span)), back=True
    )
    joined = chained.alias("r").join(found.alias("f"), ["split", "start"], "full")
    here, there = F.col("r.end").isNotNull(), F.col("f.end").isNotNull()
    problems = F.array_compact(
        F.array(
            F.when(~here, "not_listed"),
            F.when(~there, "not_stored"),
            F.when(here & (F.col("r.rows") != F.col("r.end") - F.col("start")), "count_differs_from_range"),
            F.when(here & there & (F.col("r.rows") != F.col("f.rows")), "count_differs"),
            F.when(here & there & (F.col("r.content_xor") != F.col("f.content_xor")), "content_differs"),
            F.when(F.col("start") > F.col("__end_before"), "gap"),
            F.when(F.col("start") < F.col("__end_before"), "overlap"),
        )
    )
    return joined.select("split", "start", F.explode(problems).alias("problem"))


def shard_digests(cases: DataFrame, case_id: str = "case_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Digest of the ordered case ids of every shard; a group holds at most `shard_rows` ids."""
    shard = F.call_function("div", F.col("split_ordinal"), F.lit(shard_rows)).alias("shard")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("order", case_id))), lambda row: row[case_id])
    return cases.groupBy("split", shard).agg(F.count("*").alias("rows"), F.sha2(F.unhex(F.array_join(ids, "")), 256).alias("digest"))


def root_digests(shards: DataFrame, fan_out: int = SHARD_ROWS) -> DataFrame:
    """One digest per split over the shard digests, through a middle level of at most `fan_out` digests each."""
    ordered = lambda place: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(place, "digest"))), lambda row: row["digest"]), ""
    )
    middle = shards.groupBy("split", F.call_function("div", F.col("shard"), F.lit(fan_out)).alias("block")).agg(
        F.sha2(F.unhex(ordered("shard")), 256).alias("digest"), F.count("*").alias("n")
    )
    return middle.groupBy("split").agg(F.sum("n").alias("shards"), F.sha2(F.unhex(ordered("block")), 256).alias("root_digest"))


def prefix_repetition(cases: DataFrame, sizes=(8, 24), text: str = "input") -> DataFrame:
    """How often cases start with the same words; numbers count as one word."""
    tokens = F.transform(sf.ascii_tokens(text), lambda t: F.when(t.rlike("^[0-9]+$"), "#").otherwise(t))
    lengths = F.filter(F.array(*[F.lit(size) for size in sizes]), lambda size: F.size("__tokens") >= size)
    prefixes = cases.select(tokens.alias("__tokens")).select("__tokens", F.explode(lengths).alias("prefix_tokens"))
    digest = sf.sha256_text(F.array_join(F.slice("__tokens", F.lit(1), F.col("prefix_tokens")), " "))
    counted = prefixes.select("prefix_tokens", digest.alias("prefix")).groupBy("prefix_tokens", "prefix").agg(F.count("*").alias("n"))
    repeated = F.col("n") > 1
    return counted.groupBy("prefix_tokens").agg(
        F.sum("n").alias("eligible_case_count"),
        F.count_if(repeated).alias("repeated_prefix_count"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("cases_in_repeated_prefixes"),
        F.max("n").alias("max_case_count"),
        F.call_function("div", F.max("n") * 10_000, F.sum("n")).alias("max_bps"),
    )


def _contains_any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def quality_report(cases: DataFrame, text: str = "input", answer: str = "expected", phrases=BOILERPLATE) -> DataFrame:
    """Facts of a case set as (metric, value): sources, operations, oracles, input sizes, template text.

    Texts are read once: rows are folded by digest, source and kind, and grouping sets over the folded rows give every
    count. Only the size quantiles take a second, narrow pass.
    """
    sized = cases.withColumn("__bytes", F.octet_length(text).cast("bigint"))
    # A column of its own, since a chain of tests would work the text out once per phrase.
    worded = sized.withColumn("__words", sf.normalise_ascii(text)).withColumn("__all", F.concat_ws(" ", "__words", sf.normalise_ascii(answer)))
    keyed = worded.withColumn("input_sha256", sf.sha256_text("__words")).withColumn("__template", _contains_any(F.col("__all"), phrases))
    names = ["input_sha256", "source_group_sha256", "operation", "oracle"]
    folded = keyed.groupBy(*names).agg(
        F.count("*").alias("n"), F.count_if("__template").alias("boilerplate"), F.min("__bytes").alias("low"), F.max("__bytes").alias("high")
    )
    digests, sources, operations, oracles = 7, 11, 13, 14
    sets = folded.groupingSets([[name] for name in names], *names).agg(
        F.grouping_id().alias("set"), F.sum("n").alias("n"), F.sum("boilerplate").alias("boilerplate"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # Digest and source sets shrink to one row each; the kinds keep their names.
    counted = sets.groupBy("set", "operation", "oracle").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.sum("boilerplate").alias("boilerplate"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    metric = lambda name, value: F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), value.cast("bigint").alias("value"))
    lines = (
        F.when(F.col("set") == digests, F.array(
            metric("exact_unique_input_count", F.col("groups")), metric("case_count", F.col("n")), metric("boilerplate_case_count", F.col("boilerplate")),
            metric("input_bytes.min", F.col("low")), metric("input_bytes.max", F.col("high")),
        ))
        .when(F.col("set") == sources, F.array(
            metric("source_count", F.col("groups")), metric("cases_per_source.min", F.col("least")), metric("cases_per_source.max", F.col("most")),
        ))
        .when(F.col("set") == operations, F.array(metric(F.concat(F.lit("operation."), "operation"), F.col("n"))))
        .when(F.col("set") == oracles, F.array(metric(F.concat(F.lit("oracle."), "oracle"), F.col("n"))))
    )
    sizes = nearest_rank_quantiles(sized, [], "__bytes", {"p50": 50, "p95": 95}).select(F.inline(F.array(
        metric("input_bytes.p50", F.col("p50")), metric("input_bytes.p95", F.col("p95")),
    )))
    return counted.select(F.inline(lines)).unionByName(sizes)


def short_quotas(chosen: DataFrame, quotas: dict[str, dict[str, int]]) -> DataFrame:
    """Rows missing per split and selection; empty when every quota is filled exactly."""
    wanted = F.array(*[
        F.struct(F.lit(split).alias("split"), F.lit(selection).alias("selection"), F.lit(n).alias("required"))
        for selection, split_quota in quotas.items() for split, n in split_quota.items()
    ])
    found = chosen.groupBy(F.concat_ws(".", "split", "selection").alias("k")).agg(F.count("*").alias("n"))
    counts = found.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("found"))
    name = F.concat_ws(".", "split", "selection")
    listed = counts.select("found", F.inline(wanted)).withColumn("chosen", F.coalesce(F.col("found")[name], F.lit(0)))
    return listed.select("split", "selection", "required", "chosen", (F.col("required") - F.col("chosen")).alias("missing"))


def bind_sources(planned: DataFrame, sources: DataFrame, key: str = "key", identity: Sequence[str] = ("content_sha256",)) -> DataFrame:
    """Every planned case with the state of its source: `problem` is NULL where exactly one source with the same digests is stored.

    Otherwise it says no_source, ambiguous_source or which digest differs, so that a plan whose sources have gone or changed is
    seen before anything is made from it. Sources are counted per key before the join; nothing is matched in pairs.
    """
    counted = sources.groupBy(key).agg(F.count("*").alias("__n"), *[F.min(name).alias(f"__{name}") for name in identity])
    joined = planned.join(counted, key, "left")
    problem = F.when(F.col("__n").isNull(), "no_source").when(F.col("__n") > 1, "ambiguous_source")
    for name in identity:
        problem = problem.when(~F.col(name).eqNullSafe(F.col(f"__{name}")), f"{name.removesuffix('_sha256')}_differs")
    return joined.select(*planned.columns, problem.alias("problem"))


def unbound_sources(bound: DataFrame) -> DataFrame:
    """Planned cases per problem of `bind_sources`; no rows for a plan that can be run."""
    return bound.where(F.col("problem").isNotNull()).groupBy("problem").agg(F.count("*").alias("n"))
