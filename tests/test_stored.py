"""Stored statistics (cubes and sketches) beside the direct operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import cohort, cube, distribution, sketches
from riskspark.operators.ordered import exact_quantiles
from riskspark.plans.binding import ENTITY, entity_table, labelled
from riskspark.plans.table_queries import CUBE_DIMS, CUBE_MEASURES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """Entities, some of them without a segment or a region."""
    out = labelled(entity_table(spark, SF_DIR)).withColumns({
        "seg": F.expr("if(entity_id % 11 = 0, null, seg)"), "region": F.expr("if(entity_id % 23 = 0, null, region)"),
    })
    return out.cache()


@pytest.fixture(scope="module")
def stored(rows):
    cells = [cube.cohort_cells(rows.filter(f"entity_id % 3 = {i}"), ENTITY, CUBE_DIMS, CUBE_MEASURES) for i in range(3)]
    return cube.cohort_cube(cells[0].unionByName(cells[1]).unionByName(cells[2]), ENTITY, CUBE_DIMS).cache()


def test_every_cell_of_the_cube_equals_the_direct_query(rows, stored):
    for n in range(4):
        for some in itertools.combinations(CUBE_DIMS, n):
            level = sum(1 << (2 - i) for i, d in enumerate(CUBE_DIMS) if d not in some)
            key = lambda r: tuple(str(r[c]) for c in (*some, "n_lines"))
            got = {key(r): r for r in stored.filter(f"level = {level}").collect()}
            want = rows.groupBy(*some, "n_lines").agg(
                F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("int")).alias("n_medium"), F.avg("score").alias("mean")
            ).collect()
            assert got.keys() == {key(r) for r in want}
            for r in want:
                mine = got[key(r)]
                assert (mine.n, mine.n_medium) == (r.n, r.n_medium)
                assert (mine.s0 / mine.c0 if mine.c0 else None) == pytest.approx(r["mean"])


@pytest.mark.parametrize("equals,age", [({}, None), ({"seg": "BUILDING"}, (2, 6)), ({"status": "F", "region": "ASIA", "seg": None}, None), ({"seg": "none"}, (1, 9))])
def test_kpis_from_the_cube_equal_those_from_rows(rows, stored, equals, age):
    direct = cohort.cohort_kpis(rows, ENTITY, equals, age).first().asDict()
    found = cube.kpis_from_cube(stored, ENTITY, CUBE_DIMS, CUBE_MEASURES, equals, age).first().asDict()
    assert found == pytest.approx(direct, nan_ok=True)


def test_contrasts_from_the_cube_equal_those_from_rows(rows, stored):
    direct = cohort.cohort_contrast(rows, ENTITY, {"asia": "region = 'ASIA'", "f": "status = 'F'"}, "seg").collect()
    found = cube.contrasts_from_cube(stored, ENTITY, CUBE_DIMS, CUBE_MEASURES, {"asia": ("region", "ASIA"), "f": ("status", "F")}, "seg").collect()
    key = lambda r: (r.contrast, str(r.cohort))
    for a, b in zip(sorted(direct, key=key), sorted(found, key=key), strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), abs=2e-4)


def test_a_dimension_outside_the_cube_is_refused(stored):
    with pytest.raises(ValueError, match="not in the cube"):
        cube.kpis_from_cube(stored, ENTITY, CUBE_DIMS, CUBE_MEASURES, {"prio": "1-URGENT"})


def test_cube_of_an_empty_table(rows):
    none = cube.cohort_cube(cube.cohort_cells(rows.filter("false"), ENTITY, CUBE_DIMS, CUBE_MEASURES), ENTITY, CUBE_DIMS)
    found = cube.kpis_from_cube(none, ENTITY, CUBE_DIMS, CUBE_MEASURES, {"seg": "BUILDING"}).first()
    assert (found.n, found.n_total, found.pct_high, found.avg_total) == (0, 0, None, None)


# --- sketches -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    """Values over twelve orders of magnitude, of both signs, with zeros, repeats, nulls and NaN, in five partitions."""
    rng = random.Random(9)
    pick = lambda: rng.choice([0.0, 7.5, None, float("nan"), 10 ** rng.uniform(-4, 8), -(10 ** rng.uniform(-2, 3)), rng.gauss(50, 3)])
    rows = [(i, i % 5, pick(), rng.gauss(0, 1)) for i in range(3000)]
    rows += [rows[5]] * 40
    return spark.createDataFrame(rows, "id long, part int, a double, b double").repartition(4).cache()


@pytest.mark.parametrize("error", [0.001, 0.02])
def test_sketched_quantiles_keep_their_error(numbers, error):
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0)
    cells = sketches.quantile_cells(numbers, ["a", "b"], "part", error)
    for r in sketches.merged_quantiles(cells, probs, error).collect():
        values = np.sort([v[r.feature] for v in numbers.collect() if v[r.feature] is not None and v[r.feature] == v[r.feature]])
        assert r.n == len(values)
        for p in probs:
            want = values[int(np.floor(p * (len(values) - 1)))]
            assert r[sketches.quantile_name(p)] == pytest.approx(want, rel=error * 1.000001, abs=1e-9)


def test_sketched_quantiles_stand_beside_the_exact_ones(rows):
    cells = sketches.quantile_cells(rows, ["s4", "s6"], "status")
    exact = {r.feature: r for r in exact_quantiles(rows, ["s4", "s6"], (0.25, 0.5, 0.75)).collect()}
    for r in sketches.merged_quantiles(cells, (0.25, 0.5, 0.75)).collect():
        for c in ("p25", "p50", "p75"):
            assert r[c] == pytest.approx(exact[r.feature][c], rel=0.01)  # exact ones lie between two ranks


def test_partitions_merge_in_any_order_and_new_ones_are_added(numbers):
    cells = [sketches.quantile_cells(numbers.filter(f"part = {i}"), ["a", "b"], "part") for i in range(5)]
    found = [sketches.distinct_cells(numbers.filter(f"part = {i}"), ["a", "b"], "part") for i in range(5)]
    results = set()
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1], [3, 4, 1, 0, 2]):
        both = []
        for parts, merge in ((cells, lambda c: sketches.merged_quantiles(c, (0.1, 0.5, 0.9))), (found, sketches.merged_distinct)):
            stored = parts[order[0]]
            for i in order[1:]:
                stored = stored.unionByName(parts[i])
            both.append(tuple(sorted(map(str, merge(stored.repartition(3)).collect()))))
        results.add(tuple(both))
    assert len(results) == 1
    whole = sketches.merged_quantiles(sketches.quantile_cells(numbers, ["a", "b"], "part"), (0.1, 0.5, 0.9)).collect()
    assert tuple(sorted(map(str, whole))) == next(iter(results))[0]


def test_distinct_counts_and_duplicates_are_near(numbers):
    rows = {r.feature: r for r in sketches.merged_distinct(sketches.distinct_cells(numbers, ["id", "a", "b"], "part")).collect()}
    for c in ("id", "b"):
        exact = numbers.select(c).distinct().count()
        assert rows[c].n_distinct == pytest.approx(exact, rel=0.03)
    exact = numbers.distinct().count()
    assert rows[None].rows == 3040 and rows[None].n_distinct == pytest.approx(exact, rel=0.03)
    assert abs(rows[None].n_duplicates - (3040 - exact)) <= 0.03 * 3040


# --- binned densities ---------------------------------------------------------------------------------


def test_binned_density_keeps_its_error(spark, monkeypatch):
    """Against the direct sum, in heights of the kernel; a coarse binning shows that the bound is not met by chance."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 200), [3.0] * 100, rng.normal(8, 0.2, 30)])
    df = spark.createDataFrame([(0, float(x)) for x in v], "label int, x double")
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 50)
    height = 1 / (h * np.sqrt(2 * np.pi))
    want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).mean(axis=1) * height
    error = {}
    for per_bandwidth in (4, 64):
        monkeypatch.setattr(distribution, "BINS_PER_BANDWIDTH", per_bandwidth)
        monkeypatch.setattr(distribution, "DENSITY_DIGITS", 15)
        got = [r.density for r in distribution.density_by_class(df, ["x"], "label", 50).orderBy("grid").collect()]
        error[per_bandwidth] = np.abs(np.array(got) - want).max() / height
        assert error[per_bandwidth] <= 0.0703 / per_bandwidth**4 + 1e-13
    assert error[64] < error[4] / 1000


def test_density_of_a_constant_column_is_unknown(spark):
    rows = distribution.density_by_class(spark.range(5).selectExpr("0 as label", "2D as x"), ["x"], "label", 4).collect()
    assert [r.density for r in rows] == [None] * 4 and [r.x for r in rows] == [2.0] * 4
