"""Whitening, vector codes and top-k search against numpy and plain Python, on odd rows and whole fixture tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from loomtrace.llm import code_compression, cover_tree, queries, vector_search, vectors, whitening
from tests.conftest import SMALL

#: The last columns have names that the operators use themselves.
SCHEMA = "vec_id long, embedding array<double>, label int, v string, key string, near int, band int, n long, component int, code string, query_id long"


def made(rows):
    return [(i, None if x is None else [None if c is None else float(c) for c in x], y, "v", "k", 1, 2, 3, 4, "c", 5) for i, x, y in rows]


def odd(width=8, n=300, seed=3, spread=1.0):
    """Clusters, equal vectors under several ids, repeated rows, repeated and null ids, and vectors that take no part."""
    r = np.random.default_rng(seed)
    middles = r.standard_normal((4, width))
    rows = [(i, middles[i % 4 if i % 3 else 0] + 0.2 * spread * r.standard_normal(width), [None, 1, 2, 3, 1][i % 5]) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)] + [rows[3]] * 3 + [(3, -rows[4][1], None), (50, rows[5][1], 2)]
    bad = [None, [], [None] * width, [math.nan] * width, [math.inf] + [0.0] * (width - 1), [0.5] * (width - 1) + [None]]
    return rows + [(2000 + i, x, 1) for i, x in enumerate(bad)]


def kept(rows, factor, named=False):
    fine = lambda x: x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x)
    return [(i, [math.floor(factor * float(c)) for c in x], y) for i, x, y in rows if fine(x) and not (named and i is None)]


def frame(spark, rows):
    return spark.createDataFrame(made(rows), SCHEMA).repartition(3)


WITH_NULL_ID = [*odd(), (None, odd()[1][1], None)]


def whitened(rows):
    x = np.array([[c + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    whole = x * n - total
    centred = whole.astype(float) / n
    variance, axes = np.linalg.eigh(centred.T @ centred / n)
    variance, axes = variance[::-1], axes[:, ::-1]
    good = variance > 1e-12 * variance[0]
    return (whole**2).sum(axis=1), centred @ axes[:, good] / np.sqrt(variance[good]), (variance / variance.sum())[good]


@pytest.mark.parametrize("case", ["odd", "flat", "wide"])
def test_whitening(spark, case):
    rows = WITH_NULL_ID
    if case == "flat":  # an entry that never changes, and two that say the same
        rows = [(i, None if x is None or len(x) < 8 else [*x[:6], x[0], 7.0], y) for i, x, y in rows]
    if case == "wide":  # more entries than vectors
        rows = odd(40, 12)[:12]
    length, expected, share = whitened(kept(rows, 64))
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert got["identity_error"].max() < 1e-8 and got["identity_error"].nunique() == 1 and (got["n"] == len(length)).all()
    most = min(32, expected.shape[1])
    assert sorted(got["component"].unique()) == list(range(1, most + 1))
    one = got[got["component"] == 1]
    assert sorted(map(int, one["deviation"])) == sorted(map(int, length))
    for k in range(most):
        mine, theirs = np.sort(got.loc[got["component"] == k + 1, "whitened"]), np.sort(expected[:, k])
        assert min(np.abs(mine - theirs).max(), np.abs(np.sort(-mine) - theirs).max()) < 1e-6
    explained = got.drop_duplicates("component").sort_values("component")["explained"]
    assert np.allclose(explained, share[:most], rtol=1e-6)


def test_repeated_variances_have_all_their_components(spark):
    rows = [(i, [float(s) if k == j else 0.0 for k in range(6)], 1) for i, (j, s) in enumerate([(j, s) for j in range(6) for s in (-1, 1)] * 3)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert got["component"].max() == 6 and got["identity_error"].max() < 1e-10
    assert np.allclose(got["explained"], 1 / 6)


def test_whitening_of_large_entries_is_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(4) * 1e9).tolist(), 1) for i in range(40)]
    length, _, _ = whitened(kept(rows, 64))
    got = whitening.whiten(frame(spark, rows)).where("component = 1").collect()
    assert sorted(int(r["deviation"]) for r in got) == sorted(length)


def codes(rows, entries, rounds=4):
    rows = kept(rows, 1024)
    v = np.array([x for _, x, _ in rows], dtype=np.int64)
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    out, error, books = [], np.zeros(len(rows), np.int64), []
    for part in np.split(v, 4, axis=1):
        book = part[first].copy()
        for step in range(rounds + 1):
            away = ((part[:, None] - book[None]) ** 2).sum(axis=2)
            code = away.argmin(axis=1)
            if step < rounds:
                for e in set(code.tolist()):
                    book[e] = part[code == e].sum(axis=0) // (code == e).sum()
        out.append(code)
        error += away.min(axis=1)
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    label = {}
    for (_, _, y), e in zip(rows, error.tolist(), strict=True):
        label[y] = label.get(y, 0) + e
    text = ["".join(f"{c:02x}" for c in row) for row in np.column_stack(out).tolist()]
    return sorted(((i, t, e, label[y], digest) for (i, _, y), t, e in zip(rows, text, error.tolist(), strict=True)), key=str)


@pytest.mark.parametrize(("entries", "chunk"), [(256, None), (20, 64), (1000, 17), (1, 64)])
def test_codes(spark, entries, chunk):
    got = code_compression.compress(frame(spark, WITH_NULL_ID), entries=entries, chunk=chunk)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == codes(WITH_NULL_ID, entries)


def best(rows, every, k=5):
    rows = kept(rows, 256, named=True)
    out = []
    for i, q, _ in rows:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p, _ in rows if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "bands", "query_bands", "every"), [(None, None, None, 50), (16, 5, 3, 2), (40, 1, 1, 3), (7, 30, 4, 1)])
def test_top_products(spark, chunk, bands, query_bands, every):
    got = vector_search.top_products(frame(spark, WITH_NULL_ID), every=every, chunk=chunk, bands=bands, query_bands=query_bands)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(WITH_NULL_ID, every)


def test_few_candidates_and_large_entries(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [1e7, -1.0], 1), (3, [-1e7, 5.0], None)]
    assert sorted(map(tuple, vector_search.top_products(frame(spark, rows[::2])).collect())) == best(rows[::2], 50)
    rows = [(0, [2e6, 2.0], 1), (50, [1e6, -1.0], 1), (3, [-1e6, 5.0], None), (4, [3e5, 0.25], 2)]
    assert sorted(map(tuple, vector_search.top_products(frame(spark, rows)).collect())) == best(rows, 50)
    assert vector_search.top_products(frame(spark, rows[:1])).collect() == []


@pytest.mark.parametrize("job", [whitening.whiten, code_compression.compress, vector_search.top_products])
def test_empty_tables_and_mixed_widths(spark, job):
    nothing = frame(spark, odd()[-6:])
    assert job(nothing).collect() == [] and job(nothing.limit(0)).collect() == []
    assert job(nothing).columns == job(frame(spark, odd(8, 8))).columns
    with pytest.raises(ValueError, match="entries"):
        job(frame(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])).collect()
    with pytest.raises(Exception, match="too large"):
        job(frame(spark, [(0, [1e300] * 4, 1), (2, [1.0] * 4, 1)])).collect()


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_trees_hold_their_rows_and_spare_comparisons(spread):
    points = np.array([x for _, x, _ in kept(odd(16, 2000, spread=spread), 256)], np.int64)
    tree = cover_tree.build(points, leaf=8)
    for node in range(len(tree.begin)):
        rows = tree.order[tree.begin[node] : tree.end[node]]
        assert tree.centre[node] in rows
        assert np.sqrt(((points[rows] - points[tree.centre[node]]) ** 2).sum(axis=1)).max() <= tree.radius[node]
        if tree.first[node] < tree.last[node]:
            below = slice(tree.first[node], tree.last[node])
            assert tree.begin[below][0] == tree.begin[node] and tree.end[below][-1] == tree.end[node]
    unpacked, (again,) = cover_tree.unpack(cover_tree.pack(points, [tree]))
    assert (unpacked == points).all() and all((getattr(again, f) == getattr(tree, f)).all() for f in vars(tree))
    book = points[[0, 1, 2, 7]]
    code, sure, alone = code_compression.assign(points, tree, book)
    assert (code == vectors.squares(points, book).argmin(axis=1)).all()
    if spread < 1:
        assert len(alone) < len(points) / 4 and sum(map(len, sure)) > 0
    ids = np.arange(len(points))
    found = vector_search.Best(ids[::40], np.full(len(ids[::40]), vector_search.NONE), 5)
    asked = cover_tree.build(points[::40], leaf=4)
    compared = vector_search.search(points[::40], asked, found, points, ids, tree)
    assert compared < len(points) * len(ids[::40]) * (0.6 if spread < 1 else 1.01)


def test_whole_fixture(spark):
    emb = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    rows = [(int(i), x, int(y)) for i, x, y in zip(emb["vec_id"], emb["embedding"], emb["label"], strict=True)]
    length, expected, _ = whitened(kept(rows, 64))
    got = queries.op11(spark, SMALL).toPandas()
    assert len(got) == 32 * len(rows) and got["identity_error"].max() < 1e-10
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[emb["vec_id"]].to_numpy()
    sign = np.sign((wide * expected[:, :32]).sum(axis=0))
    assert np.abs(wide * sign - expected[:, :32]).max() < 1e-8
    first = got[got["component"] == 1].set_index("vec_id").loc[emb["vec_id"]]
    assert first["deviation"].tolist() == length.tolist()
    assert sorted(map(tuple, queries.op12(spark, SMALL).collect()), key=str) == codes(rows, 256)
    assert sorted(map(tuple, queries.op13(spark, SMALL).collect())) == best(rows, 50)
