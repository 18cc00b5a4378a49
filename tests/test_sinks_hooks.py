import json

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomtrace import hooks
from loomtrace.functions import scalar as sf
from loomtrace.operators import evaldata, labels
from loomtrace.plans import bind_select
from loomtrace.sources import lineage, listing, shardfiles, sinks
from tests.conftest import SMALL


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    assert sinks.create_same(spark, rows, path) is True
    assert sinks.create_same(spark, rows.repartition(5), path) is False
    with pytest.raises(sinks.DifferentContent):
        sinks.create_same(spark, rows.where("id > 0"), path)
    with pytest.raises(sinks.DifferentContent):
        sinks.create_same(spark, rows.unionByName(rows.limit(1)), path)


def shard_table(cases):
    found = cases.withColumn("shard", F.call_function("div", F.col("split_ordinal"), F.lit(8)))
    return found.groupBy("split", "shard").agg(
        F.min("order").alias("start"), (F.max("order") + 1).alias("end"), F.count("*").alias("rows"), *evaldata.content_fingerprint(F.col("case_id"))
    )


def test_shards_put_together_are_the_input(spark, tmp_path):
    cases = bind_select.ordered_cases(spark, SMALL).select("split", "split_ordinal", "order", "case_id")
    path = str(tmp_path / "shards")
    sinks.write_shards(cases, path, 8)
    back = shardfiles.read(spark, path)
    assert sorted(map(tuple, back.select("split", "order", "case_id").collect())) == sorted(map(tuple, cases.select("split", "order", "case_id").collect()))
    assert back.groupBy("split", "shard").count().agg(F.max("count")).first()[0] <= 8
    sizes = back.groupBy("split", "shard").agg(F.count("*").alias("n"), (F.max("order") - F.min("order") + 1).alias("span"))
    assert sizes.where("n <> span").count() == 0
    # A few files, no folder per shard; the manifest holds what the stored rows give, and the audit finds nothing.
    files = [f for f in (tmp_path / "shards").rglob("*") if f.suffix == ".parquet"]
    manifest = shardfiles.manifest(spark, path)
    assert not [f for f in (tmp_path / "shards").iterdir() if f.is_dir()] and len(files) < manifest.count()
    assert evaldata.audit_manifest(manifest, shard_table(back)).collect() == []
    assert evaldata.audit_manifest(manifest, shard_table(cases)).collect() == []
    for line in manifest.collect():
        group = pq.ParquetFile(f"{path}/{line.file}").read_row_group(line.row_group)
        assert (group["order"][0].as_py(), group["order"][-1].as_py() + 1, group.num_rows) == (line.start, line.end, line.rows)
    with pytest.raises(FileExistsError):
        sinks.write_shards(cases, path, 8)
    splits = str(tmp_path / "splits")
    sinks.write_splits(cases, splits)
    assert spark.read.parquet(splits).count() == cases.count()


def test_shards_of_failed_tasks_do_not_count(spark, tmp_path):
    cases = bind_select.ordered_cases(spark, SMALL).select("split", "split_ordinal", "order", "case_id")
    path = str(tmp_path / "shards")
    broken = cases.withColumn("case_id", F.when(F.col("order") == 5, F.raise_error(F.lit("planted"))).otherwise(F.col("case_id")))
    with pytest.raises(Exception, match="planted"):
        sinks.write_shards(broken, path, 8)
    with pytest.raises(shardfiles.NotCommitted):
        shardfiles.read(spark, path)
    sinks.write_shards(cases, path, 8)
    assert shardfiles.read(spark, path).count() == cases.count() == shardfiles.manifest(spark, path).agg(F.sum("rows")).first()[0]
    nothing = str(tmp_path / "nothing")
    sinks.write_shards(cases.limit(0), nothing, 8)
    assert shardfiles.manifest(spark, nothing).count() == 0


def test_lineage_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("z", None)], "checkpoint string, parent string")
    rows = lineage.ancestry(spark, edges, "c").collect()
    assert sorted((r.checkpoint, r.depth, r.cycle) for r in rows) == [("a", 2, True), ("b", 1, False), ("c", 0, False)]
    listed = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("b", "k2"), ("z", "k2")], "checkpoint string, key string")
    assert [tuple(r) for r in lineage.repeated_keys(lineage.ancestry_rows(spark, edges, listed, "c")).collect()] == [("k1", 2)]


def test_next_batch_waits_for_enough_rows(spark):
    keys = spark.range(30).select(F.format_string("k%02d", "id").alias("key"))
    done = keys.limit(0)
    assert listing.next_batch(keys, done, (20, 40)).orderBy("key").first().key == "k00"
    first = listing.next_batch(keys, done, (20, 40))
    assert first.count() == 20
    assert listing.next_batch(keys, first, (20, 40)).count() == 0
    assert listing.next_batch(keys, first, (20,)).count() == 0
    assert tuple(listing.threshold_probe(keys, first, (20, 40)).first()) == (20, 40, False)


def test_label_contract(spark):
    good = ("a", "answer", "general", ["reasoning"], "exact", "neutral", "success", "en", "low", True, "benign", 10_000, False)
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(names, good))
    names = [part.split()[0] for part in hooks.LABEL_SCHEMA.split(", ")]
    names_at = {n: i for i, n in enumerate(names)}
    good = tuple({
        "row_id": "a", "operation": "answer", "domain": "general", "capabilities": ["reasoning"], "oracle": "exact", "sentiment": "neutral", "outcome": "success",
        "language": "en", "complexity": "low", "answerable": True, "safety": "benign", "confidence_basis_points": 10_000, "abstain": False,
    }[n] for n in names)
    assert names_at["row_id"] == 0
    rows = [
        good, change(row_id="b", oracle="guess"), change(row_id="c", confidence_basis_points=10_001), change(row_id="d", capabilities=["x"]), change(row_id="e", language=""),
        change(row_id="f"), change(row_id="f"), change(row_id="zz"), change(row_id="g", abstain=None),
    ]
    expected = spark.createDataFrame([(r,) for r in "abcdefgh"], "row_id string")
    got = sorted(map(tuple, labels.label_violations(spark.createDataFrame(rows, hooks.LABEL_SCHEMA), expected).collect()))
    assert got == [
        ("b", "unknown_taxonomy_value"), ("c", "invalid_values"), ("d", "invalid_capabilities"), ("e", "invalid_values"), ("f", "duplicate_row"),
        ("g", "invalid_values"), ("h", "missing_row"), ("zz", "unknown_row"),
    ]


def test_label_references(spark):
    stored = spark.createDataFrame([("k1", "s1", "c1"), ("k2", "s2", "c2"), ("k3", "s3", "c3")], "label_key string, label_sha256 string, content_sha256 string")
    asked = spark.createDataFrame([("k1", "s1", "c1"), ("k2", "x", "c2"), ("k3", "s3", "x"), ("k4", "s", "c")], stored.schema)
    assert sorted(map(str, [r.problem for r in labels.label_references(asked, stored).collect()])) == ["None", "content_differs", "digest_differs", "missing"]


def test_labeller_with_cache(spark):
    texts = ["please summarize", "what?", "zzz", "what?", "extract it"]
    sample = spark.createDataFrame([(t,) for t in texts], "request_text string").withColumn("content_sha256", sf.sha256_text("request_text"))
    made, broken = hooks.label_with(sample, hooks.keyword_labeller)
    assert made.count() == 4 and broken.count() == 0
    cache = made.where("operation = 'answer'").withColumn("content_sha256", F.col("row_id")).withColumn("config_digest", F.lit("v1"))

    def never(frame):
        assert not frame["request_text"].eq("what?").any()
        return hooks.keyword_labeller(frame)

    again, broken = hooks.label_missing(sample, cache, "v1", never)
    assert again.count() == 4 and broken.count() == 0
    assert {r.operation for r in again.collect()} == {"summarize", "answer", "other", "extract"}


def test_repair_loop(spark):
    planned = spark.range(12).select(F.col("id").alias("order"), F.format_string("case%02d", "id").alias("case_id"), F.lit("exact").alias("oracle"))
    sources = evaldata.with_input_digest(spark.createDataFrame([("copied text",)], "input string"))
    ledger = evaldata.with_input_digest(spark.createDataFrame([("old text",)], "input string"))

    def generator(attempt):
        def write(frame):
            text = frame["order"].map(lambda o: "copied text" if o == 1 and attempt == 0 else "old text" if o == 2 and attempt < 2 else "!!" if o == 3 and not attempt else "same words" if o in (4, 5) and not attempt else f"new task {o} {attempt}")
            return pd.DataFrame({"order": frame["order"], "case_id": frame["case_id"], "input": text, "expected": frame["order"].map(lambda o: "" if o == 6 and not attempt else "x")})

        return write

    accepted, history = hooks.build_cases(planned, generator, sources, ledger)
    assert accepted.count() == 12 and accepted.select("input_sha256").distinct().count() == 12
    assert sorted(map(tuple, history.select("attempt", "case_id", "reason").collect())) == [
        (0, "case01", "copied"), (0, "case02", "duplicate"), (0, "case03", "vacuous"), (0, "case05", "duplicate"), (0, "case06", "expected"), (1, "case02", "duplicate")
    ]
    stubborn, _ = hooks.build_cases(planned, lambda attempt: generator(0), sources, ledger, attempts=2)
    assert stubborn.count() == 7


def test_judge_and_tally(spark):
    from loomtrace.operators.scoring import preference_tally

    pairs = spark.range(40).select("id", sf.sha256_text(F.col("id").cast("string")).alias("pair_sha256"), F.lit("short").alias("baseline"), F.lit("much longer").alias("candidate"))
    judge = lambda frame: pd.DataFrame({"id": frame["id"], "verdict": ["odd" if i == 0 else "A" if len(a) > len(b) else "B" for i, a, b in zip(frame["id"], frame["answer_a"], frame["answer_b"])]})
    tally = preference_tally(hooks.judge_with(pairs, judge, ["id"]), "pair_sha256", "verdict")
    assert sorted(map(tuple, tally.collect())) == [("candidate", 39), ("unclear", 1)]


def test_scorer_output_is_checked(spark):
    answers = {
        0: '{"task_correct": true, "metrics": {"n": 1}, "reason": "fine"}', 1: "no", 2: '{"task_correct": 1}', 3: '{"task_correct": true, "task_correct": false}',
        4: '{"task_correct": false, "metrics": {"bad name!": 1}}', 5: '{"task_correct": false, "metrics": {"x": true}}', 6: json.dumps({"task_correct": True, "reason": "x" * 301}), 7: '{"task_correct": false}',
    }
    rows = spark.range(8).withColumn("saved", F.lit("kept"))
    out = {r.id: r for r in hooks.score_with(rows, lambda frame: frame["id"].map(answers), "id").collect()}
    assert [out[i].problem for i in range(8)] == [None, *["checker_invalid"] * 3, *["checker_invalid_metrics"] * 2, "checker_invalid_reason", None]
    assert out[0].task_correct is True and out[0].metrics == {"n": 1.0} and out[7].task_correct is False and out[1].saved == "kept"


def test_contracts_of_verdicts_and_targets(spark):
    cases = spark.createDataFrame([(i, f"c{i}") for i in range(6)], "order long, case_id string")
    verdicts = spark.createDataFrame(
        [(0, "c0", True, "accepted", ""), (1, "c1", True, "copied", ""), (2, "x", True, "accepted", ""), (3, "c3", False, "copied", ""), (4, "c4", False, "vacuous", "do more"), (9, "c9", True, "accepted", "")],
        "order long, case_id string, accepted boolean, reason string, guidance string",
    )
    got = {r.case_id: r.violation for r in evaldata.verdict_contract(cases, verdicts).collect()}
    assert got == {"c0": None, "c1": "reason", "c2": "identity", "c3": "guidance", "c4": None, "c5": "missing", "c9": "unplanned"}
    sources = spark.createDataFrame([(i, f"g{i}") for i in range(3)], "order long, source_group_sha256 string")
    targets = spark.createDataFrame([(0, "g0", "ok"), (1, "g1", ""), (2, "zz", "ok")], "order long, source_group_sha256 string, target string")
    assert {r.order: r.violation for r in evaldata.target_contract(sources, targets).collect()} == {0: None, 1: "target", 2: "identity"}


def test_excerpt_marker(spark):
    from loomtrace.operators.features import classifier_excerpt

    frame = spark.createDataFrame([("a" * 50 + "b" * 50,), ("short",)], "t string")
    rows = [r[0] for r in frame.select(classifier_excerpt("t", 60, F.lit(True))).collect()]
    assert rows == ["a" * 12 + "\n...[middle omitted]...\n" + "b" * 24, "short"]
