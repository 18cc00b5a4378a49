import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomtrace.operators import ordered, stats


def test_quantiles_are_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([0, 1, 2, rng.randrange(10**9), rng.randrange(50)])) for g in ("a", "b", "c") for _ in range(rng.randrange(1, 400))]
    got = ordered.nearest_rank_quantiles(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", {"p50": 50, "p95": 95, "p99": 99}).collect()
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert len(got) == len(groups)
    for row in got:
        values = sorted(groups[row.g])
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert row[name] == values[(len(values) * p + 99) // 100 - 1]


def test_neighbours_across_pieces(spark):
    rows = [(g, o, f"{g}{o}") for g in ("x", "y") for o in (0, 1, 5, 9, 10, 11, 30)]
    frame = spark.createDataFrame(rows, "g string, o long, t string")
    piece = F.call_function("div", F.col("o"), F.lit(4))
    out = ordered.with_neighbour(frame, ["g"], "o", {"n": "t"}, piece)
    back = ordered.with_neighbour(frame, ["g"], "o", {"p": "t"}, piece, back=True)
    places = [0, 1, 5, 9, 10, 11, 30]
    for row in out.collect():
        i = places.index(row.o)
        assert row.n == (f"{row.g}{places[i + 1]}" if i + 1 < len(places) else None)
    for row in back.collect():
        i = places.index(row.o)
        assert row.p == (f"{row.g}{places[i - 1]}" if i else None)


def test_running_sum_and_first_rows_on_one_hot_group(spark):
    frame = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    out = ordered.running_sum(frame, ["g"], ["o"], F.col("v"), F.call_function("div", F.col("o"), F.lit(64)), "s", inclusive=False)
    total = 0
    for row in out.orderBy("o").collect():
        assert row.s == total
        total += row.v
    near = ordered.first_rows(frame, ["g"], [F.desc("o")], 5, rank="n", salt_by=["o"])
    assert sorted((r.n, r.o) for r in near.collect()) == [(1, 999), (2, 998), (3, 997), (4, 996), (5, 995)]


def test_concurrency_counts_ends_before_starts(spark):
    rows = spark.sql(
        """SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0,0,0,s) AS started_at, timestamp'2024-01-01 00:00:00' + make_dt_interval(0,0,0,e) AS completed_at
        FROM VALUES (0, 10), (10, 20), (5, 10), (86399, 86402), (86400, 86401), (86400, 86400) AS v(s, e)"""
    )
    assert stats.max_concurrency(rows).first()[0] == 2
    assert stats.max_concurrency(rows.limit(0)).first()[0] == 0


def test_empty_side_of_a_merge(spark):
    rows = spark.createDataFrame([(3,), (9,)], "total_ms long")
    full = stats.series_accumulators(stats.series_buckets(rows, ["total_ms"]))
    none = stats.series_accumulators(stats.series_buckets(rows.limit(0), ["total_ms"]))
    assert stats.merge_accumulators(none, full).collect() == full.select(*stats.merge_accumulators(none, full).columns).collect()
    assert stats.finish_series(none).count() == 0
    done = stats.finish_series(full).first()
    assert (done.mean_milli, done.p50, done.p95, done.variance_milli2) == (6000, 4, 16, 9_000_000)
