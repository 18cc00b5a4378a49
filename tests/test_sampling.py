import hashlib
import random

from pyspark.sql import functions as F

from loomtrace.operators import sampling


def turns(rows, quota, names):
    """Plain take-turns selection, for comparison."""
    left, taken = list(rows), []
    while left and len(taken) < quota:
        before = len(taken)
        for name in names:
            hit = next((r for r in left if name in r[1]), None)
            if hit is not None and len(taken) < quota:
                taken.append(hit)
                left.remove(hit)
        if len(taken) == before:
            break
    return taken + left[: quota - len(taken)]


def digest(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def test_turns_over_single_strata(spark):
    rng = random.Random(3)
    rows = [(s, digest(f"{s}{i}"), rng.choice([*sampling.OPERATIONS[:4], "none"])) for s in ("dev", "sealed") for i in range(60)]
    frame = spark.createDataFrame(rows, "split string, d string, op string")
    quotas = {"dev": 25, "calibration": 3, "sealed": 60}
    got = sampling.round_robin(frame, quotas, sampling.OPERATIONS, "op", "d").collect()
    for split in ("dev", "sealed"):
        ordered = sorted((d, (op,)) for s, d, op in rows if s == split)
        want = [d for d, _ in turns(ordered, quotas[split], sampling.OPERATIONS)]
        assert [r.d for r in sorted((r for r in got if r.split == split), key=lambda r: r.pick)] == want


def test_turns_over_several_reasons(spark):
    rng = random.Random(5)
    rows = [(s, digest(f"{s}{i}"), rng.sample(sampling.TAIL_REASONS, rng.randrange(1, 4)), f"{s}-{i}") for s in ("dev", "sealed") for i in range(80)]
    frame = spark.createDataFrame(rows, "split string, d string, reasons array<string>, id string")
    quotas = {"dev": 9, "calibration": 2, "sealed": 70}
    got = sampling.greedy_turns(frame, quotas, "reasons", "d", "id").collect()
    for split in ("dev", "sealed"):
        ordered = sorted(((d, tuple(r), i) for s, d, r, i in rows if s == split), key=lambda x: x[0])
        want = [x[2] for x in turns(ordered, quotas[split], sampling.TAIL_REASONS)]
        assert [r.id for r in sorted((r for r in got if r.split == split), key=lambda r: r.pick)] == want


def test_first_k_counts_only_supported_rows(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), i, rng.choice([None, None, "x"]), rng.choice([None, "bad"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, o long, ex string, un string")
    for k in (1, 3):
        got = {r.o: r.reason for r in sampling.first_k_per_group(frame, "g", ["o"], k, F.col("ex"), F.col("un")).collect()}
        seen = dict.fromkeys("abc", 0)
        for g, o, ex, un in rows:
            want = ex or ("per_group_limit" if seen[g] >= k else un)
            seen[g] += want is None
            assert got[o] == want


def test_allocation():
    for n in range(40):
        shares = sampling.allocation(n)
        dev = (n + 1) // 2
        calibration = (n - dev + 1) // 2
        assert list(shares.values()) == [dev, calibration, n - dev - calibration]


def test_quota_shortfall_is_reported(spark):
    rows = [("dev", digest(i), digest(-i)) for i in range(10)] + [("sealed", digest(99), digest(98))]
    frame = spark.createDataFrame(rows, "split string, source_group_sha256 string, content_sha256 string")
    chosen, short = sampling.quota_select(frame, 8)
    assert chosen.count() == 5
    assert sorted(map(tuple, short.collect())) == [("calibration", 2, 0), ("sealed", 2, 1)]
