import random

from pyspark.sql import functions as F

from loomtrace.functions import editdistance
from loomtrace.functions.jsonrules import canonical_json, schema_match, strict_json_ok
from loomtrace.functions.oraclespec import SPEC, compile_spec, spec_of_schema
from loomtrace.operators import scoring


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_token_similarity_equals_the_plain_table(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["漢字", "É"]
    pairs = [(rng.choices(words, k=rng.randrange(0, 25)), rng.choices(words, k=rng.randrange(0, 25))) for _ in range(300)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for row in frame.select("i", scoring.token_similarity_bps(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = pairs[row.i]
        assert row.s == int(max(0.0, 1.0 - distance(a, b) / max(len(a), len(b), 1)) * 10_000)


def test_distance_of_lists_that_share_ends_or_nothing():
    rng = random.Random(5)
    for _ in range(3000):
        letters = "abcde"[: rng.randint(1, 5)]
        a, b = (rng.choices(letters, k=rng.randrange(0, 40)) for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randrange(0, 40)] + b + a[rng.randrange(0, 40) :]
        assert editdistance.distance(a, b) == editdistance.distance(b, a) == distance(a, b)
    assert editdistance.distance([], []) == 0 and editdistance.distance(["x"], []) == 1 == editdistance.distance([], ["x"])


def test_texts_of_any_length_are_scored(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    left = rng.choices(words, k=20_000)
    right = list(left)
    changed = rng.sample(range(0, 20_000, 2), 1000)
    for k in changed:
        right[k] = "other"
    rows = [("reference", " ".join(left), " ".join(right)), ("reference", " ".join(left), " ".join(rng.choices(words, k=20_000))), ("reference", "a " * 2001, "b " * 2001)]
    rows += [("reference", "a", None), ("reference", None, "a"), ("reference", "", ""), ("odd", "a", "a")]
    got = scoring.score_cases(spark.createDataFrame(rows, "oracle string, expected string, candidate string").coalesce(1)).collect()
    found = {(r.expected, r.candidate, r.oracle): (r.score_bps, r.score_problem) for r in got}
    assert found[rows[0][1], rows[0][2], "reference"] == (9500, None)
    score, problem = found[rows[1][1], rows[1][2], "reference"]
    assert 0 < score < 3000 and problem is None
    assert found["a " * 2001, "b " * 2001, "reference"] == (0, None)
    assert found["a", None, "reference"] == (0, None) and found[None, "a", "reference"] == (0, None)
    assert found["", "", "reference"] == (10_000, None) and found["a", "a", "odd"] == (None, "unknown_oracle")


def test_strict_json(spark):
    good = ['{"a":1}', "[1.5]", '"x"', "null", " 1 "]
    bad = ['{"a":1,"a":2}', "NaN", "[Infinity]", "1e999", "[1] x", "", "{'a':1}"]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string").select("t", strict_json_ok("t").alias("ok")).collect()
    assert {r.t: r.ok for r in rows} == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False), None: None}


def test_schema_match(spark):
    deep = '{"type":"array","items":' * 16 + '{"type":"string"}' + "}" * 16
    deeper = '{"type":"array","items":' * 17 + '{"type":"string"}' + "}" * 17
    shape = '{"type":"object","properties":{"n":{"type":"integer"},"t":{"type":"array","items":{"type":"string"}}},"required":["n"],"additionalProperties":false}'
    cases = [
        ('{"type":"integer"}', "3", True), ('{"type":"integer"}', "true", False), ('{"type":"integer"}', "3.0", False), ('{"type":"number"}', "3.5", True),
        ('{"type":"null"}', "null", True), ('{"type":"string","enum":["a","b"]}', '"b"', True), ('{"type":"string","enum":["a","a"]}', '"a"', False),
        ('{"type":"string","minLength":1}', '"a"', False), (shape, '{"n":1,"t":["x"]}', True), (shape, '{"t":[]}', False), (shape, '{"n":1,"z":0}', False),
        (shape, '{"n":1,"t":[2]}', False), (deep, "[" * 16 + "]" * 16, True), (deeper, "[]", False), ('{"type":"object","required":["q"]}', '{"q":1}', False),
        ("not json", "1", False), ('{"type":"boolean"}', "false", True),
    ]
    rows = spark.createDataFrame(cases, "s string, t string, want boolean").select("*", schema_match("s", "t").alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": {"z":"é"}}',), ("x",)], "t string").select(canonical_json("t")).collect()
    assert [r[0] for r in rows] == ['{"a":{"z":"é"},"b":1}\n', None]


def test_oracle_specs(spark):
    field = lambda n, t="string", r=True: (n, t, r)
    cases = [
        (("object", [field("b"), field("a", "integer", False)], "none"), "schema", True),
        (("object", [field("a"), field("a")], "none"), "schema", False),
        (("object", [], "none"), "schema", False),
        (("object", [field("x" * 129)], "none"), "schema", False),
        (("object", [field("a", "object")], "none"), "schema", False),
        (("array", [], "none"), "schema", False),
        (("array", [], "number"), "schema", True),
        (("none", [], "none"), "schema", False),
        (("none", [], "none"), "exact", True),
        (("boolean", [], "none"), "schema", True),
        (("thing", [], "none"), "exact", False),
        (None, "exact", False),
    ]
    frame = spark.createDataFrame([(i, spec, oracle) for i, (spec, oracle, _) in enumerate(cases)], f"i int, spec {SPEC}, oracle string")
    made = frame.withColumn("c", compile_spec(F.col("spec"), F.col("oracle"))).withColumn("back", spec_of_schema(F.col("c.schema"), F.col("oracle")))
    rows = {r.i: r for r in made.collect()}
    assert [rows[i].c.valid for i in range(len(cases))] == [want for *_, want in cases]
    assert rows[0].c.schema == '{"type":"object","properties":{"a":{"type":"integer"},"b":{"type":"string"}},"required":["b"],"additionalProperties":false}'
    assert rows[0].back == rows[0].c.spec and rows[6].back == rows[6].c.spec and rows[8].c.schema is None


def test_metrics_can_be_worked_out_again(spark):
    rows = [("a", i % 3 * 5000, i + 1, i % 7) for i in range(41)]
    frame = spark.createDataFrame(rows, "run string, score_bps long, latency_ms long, output_tokens long")
    row = scoring.eval_metrics(frame, ["run"]).first()
    latencies = sorted(r[2] for r in rows)
    assert row.mean_score_bps == sum(r[1] for r in rows) // 41
    assert row.p95_latency_ms == latencies[(41 * 95 + 99) // 100 - 1]
    assert row.tokens_per_second == round(sum(r[3] for r in rows) * 1000 / sum(latencies), 3)


def test_weighted_loss(spark):
    frame = spark.createDataFrame([(2.0, 3), (1.0, 1)], "loss double, target_tokens long")
    assert scoring.token_weighted_loss(frame).first().mean_target_loss == 1.75
    assert scoring.token_weighted_loss(frame.limit(0)).first().mean_target_loss is None
