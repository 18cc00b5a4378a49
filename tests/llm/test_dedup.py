"""Words, bytes and near copies against plain Python, on odd rows."""

import random

from pyspark.sql import functions as F

from loomtrace.llm import jaccard, recompression, shared, suffix_dedup
from loomtrace.llm.components import components
from tests.llm import plain

NAMED = [r for r in plain.texts() if r[0] is not None]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=lambda r: (plain.order(r), r[1:]))


def test_words_removed(spark):
    rows = plain.texts()
    out = got(recompression.deduplicate(plain.fixture(spark)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert len(out) == len(rows)
    assert set(out) == set(plain.words_kept(rows))


def test_words_of_periodic_and_shifted_texts(spark):
    r = random.Random(7)
    say = [str(r.randrange(3)) for _ in range(400)]
    rows = [(i, " ".join(say[i * 3 : i * 3 + 120])) for i in range(60)] + [(100 + i, " ".join(["ab"[k // (i + 1) % 2] for k in range(150)])) for i in range(12)]
    out = got(recompression.deduplicate(plain.fixture(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert set(out) == set(plain.words_kept(rows))


def test_bytes_removed(spark):
    rows = [*NAMED, (None, "q" * 250)]
    for crowd in (2000, 2):
        out = got(suffix_dedup.deduplicate_bytes(plain.fixture(spark, rows), crowd=crowd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(out, key=str) == sorted(plain.bytes_kept(rows), key=str)


def test_many_rows_without_an_id(spark):
    """Each row's own repeats: rows that shared a key would cut one another's words, also behind a shorter text's end."""
    say = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    rows = [(None, " ".join(say(k, 5 + k % 90) + (say(k, 5 + k % 90) if k % 3 == 0 else []))) for k in range(3000)]
    out = got(recompression.deduplicate(plain.fixture(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(out, key=str) == sorted(plain.words_kept(rows), key=str)
    out = got(suffix_dedup.deduplicate_bytes(plain.fixture(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(out, key=str) == sorted(plain.bytes_kept(rows), key=str)


def test_suffix_order():
    import numpy as np

    r = np.random.default_rng(1)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    suffix = r.permutation(2900)[:500]
    block = np.sort(r.integers(0, 9, 500))
    out = suffix_dedup.SuffixOrder(data, 40).sort(suffix, block)
    for b in range(9):
        mine = [data[s : s + 40].tobytes() for s in out[block == b]]
        assert mine == sorted(mine) and sorted(out[block == b]) == sorted(suffix[block == b])


def test_near_copies(spark):
    rows = [r for r in dict(NAMED).items()]
    for width, percent in ((3, 90), (5, 80)):
        out = got(jaccard.jaccard_components(plain.fixture(spark, rows), width, percent), "doc_id", "n_shingles", "component_id")
        assert out == plain.components(rows, width, percent)


def test_near_copies_in_a_chain(spark):
    words = [f"w{k}" for k in range(140)]
    rows = [(50 - i, " ".join(words[i : i + 100])) for i in range(40)]
    out = got(jaccard.jaccard_components(plain.fixture(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert out == plain.components(rows)


def test_one_row_of_each_group_stays(spark):
    rows = plain.texts()
    kept = jaccard.keep_one(plain.fixture(spark), width=3, percent=90)
    assert kept.columns == plain.fixture(spark).columns
    named = dict(r for r in rows if r[0] is not None)
    stays = [c[0] for c in plain.components(list(named.items())) if c[0] == c[2]]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(stays)
    # Of the two rows without an id, one is a copy of rows with ids and goes.
    assert sum(r.doc_id is None for r in kept.collect()) == 1


def test_empty_tables(spark):
    none = plain.fixture(spark, [])
    assert recompression.deduplicate(none).count() == 0
    assert suffix_dedup.deduplicate_bytes(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    out = {r.node: r.component for r in components(links).collect()}
    assert out == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_rows_without_ids_lead_on_and_ids_are_one_document(spark):
    words = [f"w{k}" for k in range(60)]
    text = lambda *changed: " ".join(f"x{k}" if k in changed else w for k, w in enumerate(words))
    # One changed word costs three of 58 shingles: 0 and 30 link with 0 alone, 0 with 0 and 30, but 0 not with 30 and 59.
    rows = [(1, text()), (None, text(30)), (2, text(30, 59)), (3, "alone " * 9), (3, text(0, 10, 20)), (5, "alone " * 9), (None, "lone one here"), (None, "lone one here"), (None, None)]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(plain.fixture(spark, rows)).collect()), key=str)
    assert [c for i, n, c in out if i in (1, 2) or (i is None and n == 58)] == [1, 1, 1]
    assert {c for i, _, c in out if i in (3, 5)} == {3}
    assert [c for i, n, c in out if i is None and n == 1] == [None, None]
    docs = plain.fixture(spark, rows).withColumns({name: F.lit(name) for name in ("__id", "__said", "__a", "said", "component", "kept_id", "one")})
    kept = jaccard.keep_one(docs, width=3, percent=90)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [i for i, _ in got if i is not None] == [1, 3]
    assert sorted([t for i, t in got if i is None], key=str) == [None, "lone one here"]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_many_copies_without_an_id(spark):
    rows = [(None, "one two three four five six")] * 400 + [(7, "one two three four five six seven eight nine ten"), (None, "1 2 3 4 5")]
    kept = jaccard.keep_one(plain.fixture(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, rows[400][1]), (True, "1 2 3 4 5"), (True, rows[0][1])]


def test_loads_count_the_tokens_of_every_row(spark):
    import numpy as np

    rows = [(k, " ".join(f"w{(k * k + i) % 97}" for i in range(5 + k % 40))) for k in range(500)]
    sets = [jaccard.shingle_sets(jaccard.words_of(jaccard.texts_of(jaccard.pa.array([text])), lower=True), 3)[0] for _, text in rows]
    counts = np.bincount((np.concatenate(sets) & np.uint64(jaccard.PLACES - 1)).astype(np.int64), minlength=jaccard.PLACES)
    loads = jaccard.token_loads(plain.fixture(spark, rows).repartition(7), 3)
    assert (loads == np.floor(6 * np.log2(1 + counts))).all() and loads.max() > 6


def test_a_small_set_in_a_block_opens_no_others(spark):
    """A bitmap folded to that of a small set is full: sets of one size in its block would all seem similar."""
    import numpy as np

    r = np.random.default_rng(5)
    tokens = [r.integers(0, 2**63, n).astype(np.uint64) for n in (4, 2000, 2000, 1990)]
    tokens.append(np.concatenate([tokens[2][:1960], tokens[3][:40]]))
    nodes = spark.createDataFrame([(k, len(t), k, jaccard.token_bits(t)) for k, t in enumerate(tokens)], "node long, n long, component long, bits binary")
    placed = spark.createDataFrame([(9, 0, 0, kind, node) for kind, node in ((0, 0), (0, 1), (0, 2), (1, 3), (1, 4))], "grp long, mb int, qb int, kind int, node long")
    out = sorted((row.kind, row.node) for row in jaccard.qualifying(nodes, placed, 90).collect())
    assert out == [(0, 2), (1, 4)]


def test_lists_keep_all_sets_that_fit_and_leave_out_others(spark):
    r = random.Random(3)
    sizes = [9, 10, 90, 100, 111, 810, 900, 1000, *(r.randint(1, 1500) for _ in range(120))]
    rows = [(k, n, [*r.sample(range(60), 5), *([999] if n in (10, 100, 1000) else [])]) for k, n in enumerate(sizes)]
    nodes = spark.createDataFrame(rows, "node long, n long, prefix array<long>")
    for percent in (80, 90, 100):
        kept = {(row.token, row.node): row.rows for row in jaccard.together(nodes, percent).collect()}
        lists = {t: [(k, n) for k, n, tokens in rows if t in tokens] for t in (*range(60), 999)}
        assert all(c == len(lists[t]) for (t, _), c in kept.items())
        fitting = {(t, a) for t, those in lists.items() for a, n in those for b, m in those if a != b and min(n, m) * 100 >= percent * max(n, m)}
        assert fitting <= kept.keys()
        assert not [a for t, a in kept if t == 999]


def test_groups_are_asked_twice_only(spark, monkeypatch):
    """Behind their leaders first, then in all groups of the lists that are still open: each round costs tables and shuffles."""
    names = []
    monkeypatch.setattr(jaccard, "written", lambda df, name, write=jaccard.written: (names.append(name), write(df, name))[1])
    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        at, n = r.randrange(120), r.randint(60, 110)
        rows.append((k, " ".join(w if r.random() > 0.01 else "x" for w in words[at : at + n])))
    out = got(jaccard.jaccard_components(plain.fixture(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert out == plain.components(rows)
    assert names.count("qualifying") == 2


def test_few_rows_take_few_tasks(spark):
    many = spark.range(10, numPartitions=50)
    assert shared.few_tasks(many, 10).rdd.getNumPartitions() == 1
    assert shared.few_tasks(many, 100 * shared.ROWS_A_TASK).rdd.getNumPartitions() == 50
