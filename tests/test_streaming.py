"""Streams give what the batch jobs give, whatever the order of arrival, and replays change nothing."""

import shutil
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomtrace.operators import mergeable, sampling, stats
from loomtrace.operators.evaldata import with_input_digest
from loomtrace.plans import checkpoint as cp
from loomtrace.sources import listing, views
from loomtrace.streaming import jobs
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def rows(spark):
    return views.feature_rows(spark, SMALL).withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).withColumn(
        "completed_at", F.col("completed_at").cast("timestamp")
    )


@pytest.fixture(scope="module")
def source(spark, rows, tmp_path_factory):
    """The rows as files in an order that has nothing to do with their keys."""
    folder = str(tmp_path_factory.mktemp("arrivals") / "rows")
    rows.repartition(4, "user_id").write.parquet(folder)
    return folder


def read(spark, folder, rows):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def table(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def run(query):
    query.awaitTermination(240)
    assert query.exception() is None


def whole(checkpoint):
    return table(checkpoint.long()), table(checkpoint.cells), table(checkpoint.seconds)


def test_checkpoints_equal_the_batch_job(spark, rows, source, tmp_path):
    job = jobs.CheckpointStream(str(tmp_path / "state"), thresholds=(100, 400, 100_000))
    run(job.start(read(spark, source, rows)))
    assert job.reached(spark) == [100, 400]
    keys = job.processed(spark)
    assert keys.count() == 400 and keys.distinct().count() == 400
    assert whole(job.read(spark, 400)) == whole(cp.Checkpoint.of(rows.join(keys, "key", "left_semi")))
    assert job.rows(spark).count() == rows.count()

    # The last batch once more, then new files with old rows and a late row with the lowest key: finished checkpoints stay as they are.
    before = whole(job.read(spark, 400))
    last = spark.read.parquet(f"{tmp_path}/state/rows/3")
    job.on_batch(last.localCheckpoint(), 3)
    more = str(tmp_path / "more")
    rows.limit(60).unionByName(rows.limit(1).withColumn("key", F.lit("e/!late"))).write.parquet(more)
    rows.write.mode("append").parquet(more)
    job.on_batch(rows.limit(1).withColumn("key", F.lit("e/!late")), 4)
    assert job.reached(spark) == [100, 400] and whole(job.read(spark, 400)) == before
    assert listing.unprocessed(job.rows(spark), job.processed(spark)).where("key = 'e/!late'").count() == 1


def test_a_batch_below_the_threshold_reads_no_earlier_rows(spark, rows, tmp_path, monkeypatch):
    job = jobs.CheckpointStream(str(tmp_path / "state"), thresholds=(300, 100_000))
    parts = [rows.where(F.col("event_id") % 5 == k) for k in range(5)]
    job.on_batch(parts[0], 0)
    with monkeypatch.context() as patch:
        patch.setattr(job, "_pending", lambda *a: pytest.fail("pending rows were read"))
        job.on_batch(parts[1].limit(20), 1)
    job.on_batch(parts[2], 2)
    assert job.reached(spark) == [300]
    read_rows = []
    pending = job._pending
    monkeypatch.setattr(job, "_pending", lambda *a: read_rows.append(a) or pending(*a))
    for k, part in enumerate(parts[3:], 3):
        job.on_batch(part, k)
    assert not read_rows
    assert job._pending(spark, 2, 4).count() == sum(spark.read.parquet(f"{tmp_path}/state/rows/{k}").count() for k in range(5)) - 300


def test_lost_checkpoint_state_is_an_error(spark, rows, tmp_path):
    job = jobs.CheckpointStream(str(tmp_path / "state"), thresholds=(100_000,))
    with pytest.raises(jobs.StateLost):
        job.on_batch(rows, 1)
    job.on_batch(rows.limit(5), 0)
    job.on_batch(rows.limit(7), 1)
    with pytest.raises(jobs.StateLost):
        job.on_batch(rows.limit(5), 0)


def test_merged_concurrency_and_sketches(spark, rows):
    moments = "a string, started_at timestamp, completed_at timestamp"
    calls = spark.createDataFrame([("x", "2024-01-01 00:00:00", "2024-01-01 00:00:02"), ("y", "2024-01-01 00:00:01", "2024-01-01 00:00:01.5"), ("x", "2024-01-01 00:00:01.5", "2024-01-01 02:00:00"), ("y", "2024-01-01 01:00:00", "2024-01-01 01:00:00"), ("x", "1969-12-31 23:59:58.5", "1970-01-01 00:00:00.5"), ("y", "1969-12-31 23:59:58.5", None)], "a string, s string, c string")
    calls = calls.select("a", F.col("s").cast("timestamp").alias("started_at"), F.col("c").cast("timestamp").alias("completed_at"))
    assert calls.schema.simpleString() == f"struct<{moments.replace(' ', ':').replace(',:', ',')}>"
    wide = rows.limit(1).drop("started_at", "completed_at").crossJoin(calls)
    halves = [cp.Checkpoint.of(wide.where(F.col("a") == a)) for a in "xy"]
    merged = halves[0].merge(halves[1])
    assert table(merged.seconds) == table(cp.Checkpoint.of(wide).seconds)
    assert stats.peak_of_seconds(merged.seconds).first()[0] == stats.max_concurrency(calls).first()[0] == 3
    assert stats.max_concurrency(calls.limit(0)).first()[0] == 0
    nothing = cp.Checkpoint.of(rows.limit(0))
    assert whole(cp.Checkpoint.of(rows).merge(nothing)) == whole(cp.Checkpoint.of(rows))
    parts = [mergeable.distinct_sketches(rows.where(F.col("event_id") % 3 == k), {"keys": "key", "none": "reasoning_effort"}) for k in range(3)]
    got = mergeable.estimates(mergeable.add_sketches(parts[2].unionByName(parts[0]).unionByName(parts[1])))
    found = {r["counter"]: r for r in got.collect()}
    assert found["keys"]["low"] <= rows.count() <= found["keys"]["high"] and found["none"]["estimate"] == 2


def test_running_statistics(spark, rows, source):
    stream = read(spark, source, rows)
    query = jobs.running_distributions(stream).writeStream.outputMode("complete").format("memory").queryName("running_dist").trigger(availableNow=True).start()
    run(query)
    assert table(spark.table("running_dist")) == table(stats.distributions(rows))
    query = jobs.running_series(stream, ["total_ms"]).writeStream.outputMode("complete").format("memory").queryName("running_series").trigger(availableNow=True).start()
    run(query)
    assert table(spark.table("running_series")) == table(stats.series_buckets(rows, ["total_ms"]))


def test_stream_deduplication(spark, rows, source):
    stream = with_input_digest(read(spark, source, rows).withColumn("text", F.concat_ws(" ", "model", "output_tokens")), "text")
    query = jobs.deduplicate(stream.select("input_sha256")).writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).start()
    run(query)
    want = with_input_digest(rows.withColumn("text", F.concat_ws(" ", "model", "output_tokens")), "text").select("input_sha256").distinct().count()
    assert spark.table("seen_once").count() == want


def test_latest_per_group(spark, rows, source):
    text = F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stream = read(spark, source, rows).withColumn("completed_at", text)
    out = jobs.latest_per_group(stream, ["completed_at", "content_sha256"])
    query = out.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    run(query)
    want = sampling.one_per_group(rows.withColumn("completed_at", text)).select(
        "source_group_kind", "source_group_sha256", "content_sha256", F.when(F.col("source_group_kind") == "trajectory", F.col("completed_at")).alias("t")
    )
    got = spark.table("latest").select(
        "source_group_kind", "source_group_sha256", "content_sha256", F.when(F.col("source_group_kind") == "trajectory", F.col("completed_at")).alias("t")
    )
    assert table(got) == table(want)


def first_of(rows, k):
    ranked = sampling.first_k_per_group(rows, "source_group_sha256", ["completed_at", "key"], k, F.lit(None).cast("string"), F.when(~F.col("success"), "x"))
    return table(ranked.where("reason IS NULL").select("source_group_sha256", "key", "model", "total_ms", "ttft_ms"))


@pytest.mark.parametrize("arrival", ["user_id", "total_ms", "backwards"])
def test_first_rows_in_any_order_of_arrival(spark, rows, tmp_path, arrival):
    folder = str(tmp_path / "arrivals")
    if arrival == "backwards":
        rows.repartitionByRange(3, F.desc("completed_at")).write.parquet(folder)
    else:
        rows.unionByName(rows.limit(50)).repartition(3, arrival).write.parquet(folder)
    job = jobs.FirstKStream(str(tmp_path / "first"), "source_group_sha256", ["completed_at", "key"], 2, ["model", "total_ms", "ttft_ms"])
    run(job.start(read(spark, folder, rows), F.col("success")))
    got = job.read(spark)
    assert table(got.select("source_group_sha256", "key", "model", "total_ms", "ttft_ms")) == first_of(rows, 2)
    assert got.where("rank > 2 OR rank < 1 OR status <> 'first'").isEmpty()


def test_first_rows_go_on_after_a_restart_and_fail_without_their_state(spark, rows, tmp_path):
    folder = tmp_path / "arrivals"
    halves = [rows.where(F.col("event_id") % 2 == k).coalesce(1) for k in (1, 0)]
    job = lambda: jobs.FirstKStream(str(tmp_path / "first"), "source_group_sha256", ["completed_at", "key"], 2, ["model", "total_ms", "ttft_ms"])
    for half in halves:
        half.write.mode("append").parquet(str(folder))
        run(job().start(read(spark, str(folder), rows), F.col("success")))
    assert table(job().read(spark).select("source_group_sha256", "key", "model", "total_ms", "ttft_ms")) == first_of(rows, 2)
    lost = tmp_path / "first" / "progress" / "state"
    assert lost.exists()
    shutil.rmtree(lost)
    rows.limit(3).write.mode("append").parquet(str(folder))
    # The store of the running process is closed first, as after a crash.
    spark._jvm.org.apache.spark.sql.execution.streaming.state.StateStore.stop()
    with pytest.raises(StreamingQueryException):
        job().start(read(spark, str(folder), rows), F.col("success")).awaitTermination(240)


def test_quiet_groups_are_closed_and_late_rows_are_told(spark, tmp_path):
    folder = str(tmp_path / "arrivals")
    schema = "g string, t long, v string"
    arrive = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    job = jobs.FirstKStream(str(tmp_path / "first"), "g", ["t"], 2, ["v"], idle_ms=2000)
    arrive([("a", 3, "x"), ("a", 2, None), ("b", 1, "y"), (None, 5, "z")])
    query = job.start(spark.readStream.schema(schema).parquet(folder), F.lit(True))

    def wait(test):
        until = time.time() + 60
        while time.time() < until and query.isActive:
            if jobs.path_exists(spark, f"{job.folder}/versions/_spark_metadata/0") and not job.versions(spark).where(test).isEmpty():
                return
            time.sleep(0.5)
        pytest.fail(f"no row with {test}: {query.exception()}")

    try:
        wait("g = 'a' and status = 'closed'")
        arrive([("a", 1, "w"), ("d", None, "n")])
        wait("status = 'late'")
        wait("g = 'd' and status = 'closed'")
    finally:
        query.stop()
    got = {(r["g"], r["rank"], r["t"], r["v"], r["status"]) for r in job.versions(spark).collect()}
    assert {("a", 1, 2, None, "first"), ("a", 2, 3, "x", "first"), ("a", 1, 2, None, "closed"), ("a", 2, 3, "x", "closed"), ("b", 1, 1, "y", "closed")} <= got
    assert ("a", None, 1, "w", "late") in got and ("d", 1, None, "n", "first") in got and (None, 1, 5, "z", "first") in got
    assert {(r["g"], r["t"]) for r in job.read(spark).where("g is not null").collect()} == {("a", 2), ("a", 3), ("b", 1), ("d", None)}


def test_a_stored_checkpoint_works_its_rows_out_once(spark, rows, tmp_path):
    some = rows.limit(200).localCheckpoint()
    seen = spark.sparkContext.accumulator(0)

    def moment(text):
        seen.add(1)
        return text

    told = F.udf(moment, "string")(F.col("completed_at").cast("string")).cast("timestamp")
    half = cp.Checkpoint.of(some.withColumn("completed_at", told).where("event_id % 2 = 0")).stored_once()
    assert whole(half) == whole(cp.Checkpoint.of(some.where("event_id % 2 = 0")))
    assert seen.value == some.where("event_id % 2 = 0").count()
    other = cp.Checkpoint.of(some.where("event_id % 2 = 1")).stored(str(tmp_path / "other"))
    assert whole(half.merged_into(other, str(tmp_path / "both"))) == whole(cp.Checkpoint.of(some))


def test_a_pending_row_without_a_key_stays(spark, rows, tmp_path):
    job = jobs.CheckpointStream(str(tmp_path / "state"), thresholds=(10, 20, 100_000))
    job.on_batch(rows.limit(30).unionByName(rows.limit(1).withColumn("key", F.lit(None).cast("string"))), 0)
    assert job.reached(spark) == [10, 20]
    left = spark.read.parquet(f"{tmp_path}/state/left/0")
    assert left.count() == 31 - job.processed(spark).count() and left.where("key is null").count() == 1
