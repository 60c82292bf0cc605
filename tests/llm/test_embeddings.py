"""Search, whitening and codes of embedding vectors beside brute force, and what they make of odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import ann_search, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, list int, k1 string, vec double, code string, error int, `v.w` int, n int"
EXTRA = (1, "x", 2.0, "c", 3, 4, 5)
DIMS = 12


def table(spark, rows, kind="float"):
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], label, *EXTRA) for i, v, label in rows]
    return spark.createDataFrame(rows, SCHEMA.replace("<float>", f"<{kind}>")).repartition(3)


def clustered(n, d=DIMS, seed=1, groups=9):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    x = centres[rng.integers(0, groups, n)] + 0.5 * rng.standard_normal((n, d))
    return x.astype(np.float32)


ODD = [
    (3, None, 1), (4, [], 1), (5, [1.0] * 11 + [None], 1), (6, [float("nan")] * DIMS, 1), (7, [float("inf")] + [0.0] * 11, 1),
    (8, [0.0] * DIMS, 1), (9, [1.0] * 5, 1), (9, [2.0] * 5, None),
]


@pytest.fixture(scope="module")
def good():
    """Plain rows, copies of one vector under many ids, a repeated row, negative and large ids, null labels."""
    x = clustered(400)
    rows = [(i, x[i - 20], None if i % 7 == 0 else i % 3) for i in range(20, 420)]
    rows += [(1000 + i, x[5], 2) for i in range(150)]
    return rows + [(40, x[20], 2), (40, x[20], 2), (-20, -x[3], 0), (2**40, x[9] * 3, 1)]


@pytest.fixture(scope="module")
def odd(spark, good):
    return table(spark, [*good, *ODD, (None, good[0][1], 1)]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


# --- search ---------------------------------------------------------------------------------------


def nearest(rows, k, every):
    """Brute force with sums in the order of dimensions."""
    rows = sorted({(i, tuple(map(float, v))) for i, v, _ in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = np.zeros(len(x))
        for j in range(x.shape[1]):
            score += x[q, j] * x[:, j]
        order = [c for c in np.lexsort((ids, -score)) if ids[c] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[c]), float(score[c])) for c in order]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_search_with_every_list_and_no_abandoning_is_brute_force(odd, good):
    """Ties, copies beyond the number of neighbours, repeated rows, unequal norms and odd rows included."""
    cfg = ann_search.AnnConfig(coverage=1.0, significance=1e9, rows_per_block=64, queries_per_block=8)
    rows = [r for r in good]
    assert results(ann_search.search(odd, cfg=cfg)) == nearest(rows, 20, 20)


def test_search_finds_nine_of_ten_with_tests_and_probes(spark):
    x = clustered(4000, 32, groups=40)
    rows = [(i, v / np.linalg.norm(v), 0) for i, v in enumerate(x)]
    got, want = results(ann_search.search(table(spark, rows))), nearest(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)
    exact = {(q, i): s for q, hits in nearest(rows, 4000, 20).items() for i, s in hits}
    assert all(exact[q, i] == s for q, hits in got.items() for i, s in hits)


@pytest.mark.parametrize("n", [1, 2, 19, 30])
def test_search_of_few_rows_gives_all_candidates(spark, n):
    rows = [(20 * i, v, 0) for i, v in enumerate(clustered(n, 3))]
    got = results(ann_search.search(table(spark, rows)))
    assert {q: len(v) for q, v in got.items()} == ({20 * i: min(20, n - 1) for i in range(n)} if n > 1 else {})


def test_search_of_tables_without_queries_or_vectors(spark, none):
    assert ann_search.search(none).collect() == []
    assert ann_search.search(table(spark, ODD)).where("query_id = 8").collect() == []
    assert ann_search.search(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 0.0], 0)])).collect() == []
    assert [f.name for f in ann_search.search(none).schema] == ["query_id", "rank", "vec_id", "score"]


def test_scan_abandons_far_vectors_and_keeps_near_ones():
    rng = np.random.default_rng(2)
    cfg = ann_search.AnnConfig()
    x = rng.standard_normal((3000, 64))
    q = x[:40] + 0.3 * rng.standard_normal((40, 64))
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    turn = ann_search.rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bound = np.full(40, 0.4)
    i, j = ann_search.adaptive_scan(q @ turn, x @ turn, bound, cfg)
    kept = set(zip(i.tolist(), j.tolist()))
    near = set(zip(*(v.tolist() for v in np.nonzero(q @ x.T >= 0.4))))
    assert kept <= near and len(kept) >= 0.95 * len(near) and len(near) < 0.01 * q.shape[0] * x.shape[0]


def test_a_hot_list_is_cut_in_blocks(spark):
    """Near copies of one vector fill a list; every block of it and of its queries stays small and nothing is lost."""
    rng = np.random.default_rng(4)
    hot = np.ones(8) + 1e-3 * rng.standard_normal((300, 8))
    rows = [(i, v, 0) for i, v in enumerate(np.concatenate([hot, rng.standard_normal((100, 8))]))]
    cfg = ann_search.AnnConfig(coverage=1.0, significance=1e9, rows_per_block=32, queries_per_block=4)
    assert results(ann_search.search(table(spark, rows, "double"), cfg=cfg)) == nearest(rows, 20, 20)


# --- whitening --------------------------------------------------------------------------------------


def plain_whitening(vectors, k=16):
    """Exact integer moments, dense eigenvectors."""
    x = [tuple(math.floor(64 * float(e)) + 1_000_000 for e in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((n * fit - s) / n).astype(float)
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    deviation = [int(sum((n * e - t) ** 2 for e, t in zip(v, s))) for v in x]
    rows = np.array([[float(n * e - t) / n for e, t in zip(v, s)] for v in x])
    return n, values[order], rows @ turned[:, order] / np.sqrt(values[order]), deviation, values.sum()


def check_whitening(df, rows, k):
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r.component, str(r.vec_id), r.deviation))
    n, values, z, deviation, trace = plain_whitening([v for _, v, _ in rows])
    order = sorted(range(len(rows)), key=lambda i: (str(rows[i][0]), deviation[i]))
    assert len(got) == k * len(rows) and {r.n for r in got} == {n}
    assert all(r.identity_error <= 1e-9 for r in got)
    for c in range(k):
        mine = got[c * len(rows) : (c + 1) * len(rows)]
        assert [r.component for r in mine] == [c + 1] * len(rows)
        assert [r.deviation for r in mine] == [deviation[i] for i in order]
        assert mine[0].explained == pytest.approx(values[c] / trace, rel=1e-10)
        w, want = np.array([r.whitened for r in mine]), z[order, c]
        assert np.allclose(w, want * np.sign(w @ want), atol=1e-8)


def test_whitening_equals_dense_eigenvectors(odd, good):
    rows = [*good, (8, [0.0] * DIMS, 1), (None, good[0][1], 1)]
    check_whitening(odd, rows, DIMS)


def test_whitening_of_more_dimensions_keeps_sixteen(spark):
    rows = [(i, v, 0) for i, v in enumerate(clustered(300, 40))]
    check_whitening(table(spark, rows), rows, 16)


def test_whitening_of_low_rank_and_equal_eigenvalues(spark):
    """Rank 2 in five dimensions; then a cross, whose covariance is a multiple of the identity."""
    plane = [(i, [a, b, a + b, 2 * a, 0.0], 0) for i, (a, b) in enumerate([(1, 0), (0, 1), (2, 3), (-4, 1), (5, 5)])]
    assert whitening.whiten(table(spark, plane)).select("component").distinct().count() == 2
    cross = [(2 * i + s, [(1 - 2 * s) * float(i == j) for j in range(4)], 0) for i in range(4) for s in (0, 1)]
    found = whitening.whiten(table(spark, cross)).collect()
    assert {r.component for r in found} == {1, 2, 3, 4} and all(r.identity_error < 1e-9 for r in found)
    assert all(r.explained == pytest.approx(0.25) for r in found)


def test_whitening_without_variance_gives_no_rows(spark, none):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(none).columns == columns and whitening.whiten(none).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)] * 3)).collect() == []
    assert whitening.whiten(table(spark, ODD[:5])).collect() == []


def test_bidiagonalisation_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 60)) * 0.8 ** np.arange(60)
    passes = []

    def product(w, others):
        u = x @ w
        passes.append(1)
        return x.T @ u, float(u @ u), np.array([(x @ o) @ u for o in others])

    cfg = whitening.WhiteningConfig(components=5, whole_dims=8)
    sigma, right = whitening.Bidiagonalisation(60, product, cfg).run()
    _, want, turned = np.linalg.svd(x)
    assert len(passes) < 50 and np.allclose(sigma[:5], want[:5], rtol=1e-12)
    assert np.allclose(np.abs(np.sum(right[:, :5] * turned[:5].T, axis=0)), 1, atol=1e-12)


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitener(2**40, (2**40 * 5 + 3, 0), np.zeros(0), np.zeros((2, 0)), 0.0, 0.0)
    got = whitening._squares(np.array([[5, 0], [6, 1000], [5, 2**20]]), model).to_pylist()
    assert got == [9, None, None]


# --- codes --------------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Every round scans every entry for every row, in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tuple(map(float, r[1]))))
    x = [[math.floor(1024 * float(e)) for e in v] for _, v, _ in rows]
    x = [v + [0] * (-len(v) % parts) for v in x]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[list(cut[i][p]) for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            code = [nearest(v[p], books[p])[1] for v in cut]
            for e in range(len(books[p])):
                if mine := [v[p] for v, c in zip(cut, code) if c == e]:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    final = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    by_label = {}
    for (_, _, label), f in zip(rows, final):
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in f)
    flat = np.array(books)
    return sorted(
        ((str(i), "".join(f"{c:02x}" for _, c in f), sum(d for d, _ in f), by_label[label], vector_codes.checksum(flat)) for (i, _, label), f in zip(rows, final))
    )


def coded(df, **settings):
    rows = vector_codes.compress(df, cfg=vector_codes.CodeConfig(**settings)).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows)


def test_codes_equal_plain_rounds(odd, good):
    rows = [*good, (8, [0.0] * DIMS, 1), (None, good[0][1], 1)]
    assert coded(odd, entries=16) == plain_codes(rows, entries=16)


@pytest.mark.parametrize("d,n", [(8, 5), (7, 40), (3, 40)])
def test_codes_of_few_rows_and_uneven_parts(spark, d, n):
    rows = [(i, v, i % 2) for i, v in enumerate(clustered(n, d))]
    assert coded(table(spark, rows), chunk=7) == plain_codes(rows)


def test_codes_of_nothing(spark, none):
    assert vector_codes.compress(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(none).collect() == [] and vector_codes.compress(table(spark, ODD[:5])).collect() == []


def test_looking_at_moved_entries_equals_a_scan_of_all():
    """Small whole numbers make ties common; some entries move, others stay."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        x, old = rng.integers(-2, 3, (60, 3)), rng.integers(-2, 3, (9, 3))
        code, error = vector_codes.assign_all(x, old)
        new = old.copy()
        some = rng.random(9) < rng.random()
        new[some] += rng.integers(-1, 2, (int(some.sum()), 3))
        moved = (new != old).any(axis=1)
        got, want = vector_codes.assign_moved(x, code, error, new, moved), vector_codes.assign_all(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_distances_are_exact_beyond_double_precision():
    x, e = np.array([[2**27, 3]]), np.array([[-(2**27), 5], [2**27 - 1, 3]])
    assert vector_codes.distances(x, e).tolist() == [[2**56 + 4, 1]]
