import hashlib
import json
import uuid
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from loomtrace.functions import scalar as sf


def one(frame):
    return [row[0] for row in frame.collect()]


def test_split_bucket_uses_two_bytes_and_a_salt_per_kind(spark):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), kind) for i in range(200) for kind in ("request", "trajectory")]
    frame = spark.createDataFrame(rows, "g string, kind string")
    got = {(r.g, r.kind): r.b for r in frame.select("g", "kind", sf.split_bucket("g", "kind").alias("b")).collect()}
    for digest, kind in rows:
        salt = sf.REQUEST_SALT if kind == "request" else sf.TRAJECTORY_SALT
        raw = hashlib.sha256(salt.encode() + b"\0" + bytes.fromhex(digest)).digest()
        assert got[digest, kind] == int.from_bytes(raw[:2], "big") % 10_000


def test_wilson_agrees_with_forty_digits(spark):
    pairs = [(s, n) for n in (0, 1, 2, 3, 7, 50, 399, 10_000) for s in {0, 1, n // 3, n // 2, n - 1, n} if 0 <= s <= n]
    frame = spark.createDataFrame(pairs, "s long, n long").select("s", "n", sf.wilson_lower_bps("s", "n").alias("l"), sf.wilson_upper_bps("s", "n").alias("h"))
    for row in frame.collect():
        if row.n == 0:
            assert (row.l, row.h) == (0, 0)
            continue
        with localcontext() as ctx:
            ctx.prec = 40
            n, p, z = Decimal(row.n), Decimal(row.s) / Decimal(row.n), Decimal("1.959963984540054")
            d = 1 + z * z / n
            c, m = (p + z * z / (2 * n)) / d, z * (p * (1 - p) / n + z * z / (4 * n * n)).sqrt() / d
            bound = lambda x: int((x * 10_000).to_integral_value(rounding=ROUND_HALF_UP))
            assert (row.l, row.h) == (bound(max(c - m, Decimal(0))), bound(min(c + m, Decimal(1))))


def test_name_uuid(spark):
    names = [f"x{i}" for i in range(100)]
    got = one(spark.createDataFrame([(n,) for n in names], "n string").select(sf.name_uuid(str(uuid.NAMESPACE_URL), "n")))
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_power_of_two_bucket(spark):
    values = [0, 1, 2, 3, 4, 5, 1023, 1024, 1025, 2**52 + 1, 2**61]
    got = one(spark.createDataFrame([(v,) for v in values], "v long").select(sf.power_of_two_bucket("v")))
    assert got == [0 if v == 0 else 1 << (v - 1).bit_length() for v in values]


def test_rates_round_half_up(spark):
    got = one(spark.createDataFrame([(1, 3), (2, 3), (1, 20_000), (5, 0), (9, 3)], "a long, b long").select(sf.rate_bps("a", "b")))
    assert got == [3333, 6667, 1, 0, 10_000]


def test_byte_cuts_never_split_a_character(spark):
    text = "aé€😀b ü�"
    raw = text.encode()
    frame = spark.createDataFrame([(text, n) for n in range(1, len(raw) + 2)], "t string, n int")
    for row in frame.select("n", sf.utf8_prefix("t", F.col("n")).alias("p"), sf.utf8_suffix("t", F.col("n")).alias("s")).collect():
        assert row.p == raw[: row.n].decode("utf-8", "ignore")
        assert row.s == raw[-row.n :].decode("utf-8", "ignore")


def test_utc_text(spark):
    good = {"2024-02-29T23:59:59Z": 0, "2024-01-01T00:00:00.5Z": 500_000, "2024-01-01T00:00:00.123456789+00:00": 123_456}
    bad = ["2024-01-01T00:00:00+02:00", "2024-01-01 00:00:00Z", "2024-13-01T00:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01T00:00:00.Z", "2024-01-01T00:00:00", "", None, "2024-01-01T24:00:00Z"]
    frame = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", F.unix_micros(sf.parse_utc("t")).alias("us"))
    for row in frame.collect():
        assert (row.us % 1_000_000 == good[row.t]) if row.t in good else row.us is None


def test_strip_and_normalisers(spark):
    texts = ["　 a ", "İ ½ ① x", "Ab-9_c", "\x1c\x85z "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sf.strip("t").alias("s"), sf.normalise_unicode("t").alias("u"), sf.normalise_ascii("t").alias("a"))
    for row in frame.collect():
        assert row.s == row.t.strip()
        assert row.u == " ".join("".join(c.lower() if c.isalnum() else " " for c in row.t).split())
    assert frame.where("t = 'Ab-9_c'").first().a == "ab 9 c"


def test_canonical_digest(spark):
    rows = [("é\n\"", 3, None, True), ("a", None, "x", False)]
    frame = spark.createDataFrame(rows, "t string, n long, o string, b boolean")
    got = one(frame.select(sf.canonical_digest(text=F.col("t"), n=F.col("n"), o=F.col("o"), b=F.col("b"))))
    write = lambda r: json.dumps({"text": r[0], "n": r[1], "o": r[2], "b": r[3]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
    assert got == [hashlib.sha256(write(r).encode()).hexdigest() for r in rows]


def test_one_hot_key_in_every_join(spark):
    """A third of all rows is one text in one group; results stay whole."""
    from loomtrace.operators import evaldata, sampling

    hot = F.col("id") % 3 == 0
    rows = spark.range(9000).select(
        F.col("id").alias("order"), F.format_string("k%05d", "id").alias("key"), F.when(hot, "hot text").otherwise(F.concat(F.lit("text "), F.col("id") % 2000)).alias("input"),
        F.when(hot, "g").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("source_group_sha256"), F.lit("trajectory").alias("source_group_kind"),
        F.format_string("2024-01-01T%05d", "id").alias("completed_at"), F.lit("c").alias("content_sha256"),
    )
    none = rows.select(F.lit("").alias("input_sha256")).limit(0)
    judged = evaldata.judge_cases(rows, none, none)
    distinct = rows.select("input").distinct().count()
    assert judged.count() == 9000 and judged.where("accepted").count() == distinct
    assert judged.where("accepted AND input = 'hot text'").first().order == 0
    single = sampling.one_per_group(rows)
    assert single.count() == rows.select("source_group_sha256").distinct().count()
    assert single.where("source_group_sha256 = 'g'").first().order == 8997


def test_display(spark):
    row = spark.range(1).select(sf.percent_text(F.lit(2500)), sf.percent_text(F.lit(2512)), sf.duration_text(F.lit(900)), sf.duration_text(F.lit(1500)), sf.duration_text(F.lit(2000))).first()
    assert list(row) == ["25%", "25.12%", "900ms", "1.5s", "2s"]
