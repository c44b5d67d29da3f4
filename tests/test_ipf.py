import math
from itertools import combinations
import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citywright.operators import ipf as m
from citywright.plans.workloads import joint_distribution
from citywright.queries import ORACLE_SQL, QUERIES
from citywright.storage import checkpointed

ABC, XY, PQ = ["a", "b", "c"], ["x", "y"], ["p", "q"]


def reference_fit(tensor, targets, layers, rounds=500):
    """Plain loops over one tensor, by the documented stop rule."""
    tensor, last = tensor.astype(float), np.inf
    for _ in range(rounds):
        for layer, goal in zip(layers, targets, strict=True):
            for place in np.ndindex(*goal.shape):
                cut = tuple(place[layer.index(a)] if a in layer else slice(None) for a in range(tensor.ndim))
                if tensor[cut].sum() != 0:
                    tensor[cut] *= goal[place] / tensor[cut].sum()
        worst = 0.0
        for layer, goal in zip(layers, targets, strict=True):
            have = tensor.sum(axis=tuple(a for a in range(tensor.ndim) if a not in layer))
            worst = max([worst, *(abs(h / g - 1) for h, g in zip(have.ravel(), goal.ravel(), strict=True) if g)])
        if worst <= m.FITTED or abs(worst - last) <= m.STALLED:
            break
        last = worst
    return tensor


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 50), min_size=5, max_size=5), min_size=1, max_size=5), st.sampled_from([(), (("a", "x"),), (("a", "x"), ("b", "nowhere"))]))
def test_2d_batch_equals_single_fits(rows, impossible):
    spec = m.Spec([ABC, XY], impossible)
    data = np.array(rows, dtype=float)
    got, _, _ = m.fit_sections([data[:, :3], data[:, 3:]], spec)
    for k, row in enumerate(data):
        seed = np.ones((3, 2))
        if impossible:
            seed[0, 0] = 0
        assert np.allclose(got[k], reference_fit(seed, [row[:3], row[3:]], [[0], [1]]))


def test_3d_goes_by_sub_marginals_and_clears_projections():
    spec = m.Spec([ABC, XY, PQ], [("a", "x", "p"), ("zzz", "x", "p")])
    values = [np.array([[10.0, 20, 30]]), np.array([[25.0, 35]]), np.array([[40.0, 20]])]
    got = m.fit_sections(values, spec)[0][0]
    sub = []
    for axes in ([0, 1], [0, 2], [1, 2]):
        seed = np.ones([len(spec.dims[a]) for a in axes])
        # the second combination's unknown category lies outside of the last projection, so that one is cleared by it too
        seed[0, 0] = 0
        sub.append(reference_fit(seed, [values[a][0] for a in axes], [[0], [1]]))
    seed = np.ones((3, 2, 2))
    seed[0, 0, 0] = 0
    assert np.allclose(got, reference_fit(seed, sub, [[0, 1], [0, 2], [1, 2]]))
    assert got[0, 0, 0] == 0
    assert spec.projected((0, 1), "all") == set()


def test_closed_form_and_total_mode(spark):
    df = spark.createDataFrame([("s,1", 10.0, 20.0, 30.0, 25.0, 35.0), ("s2", 1.0, 0.0, 3.0, 2.0, 2.0)], "section string, a double, b double, c double, x double, y double")
    spec = m.Spec([ABC, XY])
    fitted = {(r.section, r.d1, r.d2): r.value for r in m.ipf(df, spec, "section").collect()}
    closed = {(r.section, r.d1, r.d2): r.value for r in m.independent_joint(df, spec, "section").collect()}
    assert fitted.keys() == closed.keys() and len(fitted) == 12
    assert all(abs(fitted[k] - closed[k]) < 1e-6 for k in fitted)
    total = {(r.d1, r.d2): r.value for r in m.ipf(df, spec).collect()}
    assert abs(total["a", "x"] - 11 * 27 / 64) < 1e-6
    assert m.ipf(df, spec, "section", drop_zero=True).count() == 10
    assert m.type_count(m.ipf(df, spec, "section")).first()[0] == 12
    report = m.ipf_report(df, spec, "section").collect()
    assert all(r.converged and not r.infeasible and r.rounds >= 1 and r.max_error < 1e-6 for r in report)


def test_nulls_and_unequal_totals(spark):
    df = spark.createDataFrame([("s", None, 20.0, 30.0, 25.0, 25.0)], "section string, a double, b double, c double, x double, y double")
    spec = m.Spec([ABC, XY])
    with pytest.raises(Exception, match="null"):
        m.ipf(df, spec, "section").collect()
    assert abs(sum(r.value for r in m.ipf(df, spec, "section", nulls="zero").collect()) - 50) < 1e-6
    off = spark.createDataFrame([("s", 1.0, 1.0, 1.0, 5.0, 5.0)], df.schema)
    with pytest.raises(ValueError, match="differ"):
        joint_distribution(off, spec, "section")
    assert not m.check_totals(off, spec).first().equal
    last_layer = m.ipf(off, spec, "section").groupBy("d2").sum("value").collect()
    assert {r[0]: round(r[1], 6) for r in last_layer} == {"x": 5.0, "y": 5.0}
    assert m.ipf(df.limit(0), spec, "section").count() == 0


def test_specification_is_checked():
    for dims in ([ABC], [ABC, []], [ABC, ["a"]]):
        with pytest.raises(ValueError):
            m.Spec(dims)


def test_batches_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(str(k), *map(float, rng.integers(1, 9, 3)), 6.0, float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "section string, a double, b double, c double, x double, y double")
    spec = m.Spec([ABC, XY], [("a", "x")])
    whole = {(r.section, r.cell_no): r.value for r in m.ipf(df, spec, "section").collect()}
    values = [np.array([[r[1], r[2], r[3]] for r in rows]), np.array([[r[4], r[5]] for r in rows])]
    for k in range(30):
        alone = m.fit_sections([v[k : k + 1] for v in values], spec)[0][0].ravel()
        assert np.array_equal(alone, [whole[str(k), c] for c in range(6)])


def test_impossible_tables_and_long_form(spark):
    combos = m.expand_impossible(spark, [["a", "b"], ["x"]])
    assert sorted(map(tuple, combos.collect())) == [("a", "x"), ("b", "x")]
    more = m.add_impossible(combos, combos)
    assert more.count() == 2
    assert [tuple(r) for r in m.remove_impossible(more, spark.createDataFrame([("a", "x")], "d1 string, d2 string")).collect()] == [("b", "x")]
    spec = m.Spec([ABC, XY], [("b", "x")])
    cells = m.all_cells(spark, spec)
    assert [(r.cell_no, r.d1, r.d2, r.weight) for r in cells.orderBy("cell_no").collect()][2] == (2, "b", "x", 0.0)
    t1 = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0)], "d1 string, target double")
    t2 = spark.createDataFrame([("x", 25.0), ("y", 35.0)], "d2 string, target double")
    long = {r.cell_no: r.value for r in m.ipf_long(cells, [["d1"], ["d2"]], [t1, t2], 5, by=None).collect()}
    short = m.fit_sections([np.array([[10.0, 20, 30]]), np.array([[25.0, 35]])], spec, rounds=5, fitted=-1, stalled=-1)[0][0].ravel()
    assert np.allclose([long[k] for k in range(6)], short)


def test_long_form_stops_as_the_batch_does(spark, monkeypatch):
    rng = np.random.default_rng(8)
    spec = m.Spec([ABC, XY], [("b", "x")])
    values = [rng.integers(1, 9, (6, 3)).astype(float), np.zeros((6, 2))]
    values[1][:, 0] = values[0].sum(axis=1) * 0.25
    values[1][:, 1] = values[0].sum(axis=1) * 0.75
    joint, ran, error = m.fit_sections(values, spec)
    cells = spark.createDataFrame([(k,) for k in range(6)], "section int").crossJoin(m.all_cells(spark, spec))
    target = lambda k, names: spark.createDataFrame([(i, n, float(v)) for i in range(6) for n, v in zip(names, values[k - 1][i], strict=True)], f"section int, d{k} string, target double")
    for most in (m.MOST_SLICES, 0):
        monkeypatch.setattr(m, "MOST_SLICES", most)
        got = m.ipf_long(cells, [["d1"], ["d2"]], [target(1, ABC), target(2, XY)]).collect()
        assert len(got) == 36 and len(set(ran.tolist())) > 1
        for r in got:
            assert math.isclose(r.value, joint[r.section].ravel()[r.cell_no], rel_tol=1e-9, abs_tol=1e-12) and r.rounds == ran[r.section] and math.isclose(r.error, error[r.section], abs_tol=1e-12)


def test_long_form_never_writes_cells(spark, monkeypatch):
    """Only tables of slices are written, and one total of all cells needs no section."""
    spec = m.Spec([ABC, XY], [("b", "x")])
    written = []
    monkeypatch.setattr(m, "checkpointed", lambda df: (written.append(set(df.columns)), checkpointed(df))[1])
    cells = m.all_cells(spark, spec)
    target = lambda k, names, values: spark.createDataFrame(list(zip(names, values, strict=True)), f"d{k} string, target double")
    monkeypatch.setattr(m, "MOST_SLICES", 0)
    got = m.ipf_long(cells, [["d1"], ["d2"]], [target(1, ABC, [3.0, 2.0, 5.0]), target(2, XY, [4.0, 6.0])], by=None).collect()
    want = m.fit_sections([np.array([[3.0, 2.0, 5.0]]), np.array([[4.0, 6.0]])], spec)[0].ravel()
    assert all(math.isclose(r.value, want[r.cell_no], abs_tol=1e-9) for r in got) and len(got) == 6
    assert written and all(c in ({"d1", "goal", "log", "have"}, {"d2", "goal", "log", "have"}, {"error", "rounds", "live"}) for c in written)


def test_long_form_with_three_layers_and_targets_that_cannot_be_met(spark):
    spec = m.Spec([ABC, XY, PQ], [("a", "x", "p")])
    rng = np.random.default_rng(3)
    joint = rng.integers(1, 9, (3, 2, 2)).astype(float)
    joint[0, 0, 0] = 0
    wants = [joint.sum(axis=tuple(a for a in range(3) if a != k)) for k in range(3)]
    wants[2] = wants[2] * np.array([1.0, 0.0])  # no q: totals differ, and cells with q die out
    want, ran, error = m.fit_batch(m._cleared(spec.shape, 1, spec.valid_impossible()), [w[None] for w in wants], [(0,), (1,), (2,)], rounds=8)
    target = lambda k: spark.createDataFrame(list(zip(spec.dims[k - 1], wants[k - 1].tolist(), strict=True)), f"d{k} string, target double")
    got = m.ipf_long(m.all_cells(spark, spec), [["d1"], ["d2"], ["d3"]], [target(1), target(2), target(3)], by=None, rounds=8).collect()
    assert all(math.isclose(r.value, want.ravel()[r.cell_no], rel_tol=1e-9, abs_tol=1e-9) and r.rounds == ran[0] for r in got)


def test_report_tells_what_cannot_be_fitted(spark):
    spec = m.Spec([ABC, XY], [("a", "x"), ("a", "y")])
    rows = [("no cell", 1.0, 2.0, 3.0, 3.0, 3.0), ("fits", 0.0, 2.0, 3.0, 1.0, 4.0), ("unequal", 0.0, 2.0, 3.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "section string, a double, b double, c double, x double, y double")
    got = {r.section: r for r in m.ipf_report(df, spec, "section").collect()}
    assert {k: r.infeasible for k, r in got.items()} == {"no cell": True, "fits": False, "unequal": True}
    assert got["fits"].converged and got["fits"].max_error < 1e-5 and not got["unequal"].converged and got["no cell"].max_error >= 1


def test_report_finds_categories_that_have_too_little_to_go_to(spark):
    spec = m.Spec([["a", "b"], XY], [("a", "y")])
    rows = [("too much", 10.0, 5.0, 5.0, 10.0), ("just", 5.0, 10.0, 5.0, 10.0), ("zero", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "section string, a double, b double, x double, y double")
    got = {r.section: (r.infeasible, r.blocked) for r in m.ipf_report(df, spec, "section").collect()}
    assert got == {"too much": (True, ["a", "y"]), "just": (False, []), "zero": (False, [])}


def test_greatest_flow_equals_a_search_over_all_sets():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n, k = rng.integers(1, 7), rng.integers(1, 6)
        rows, cols = rng.integers(0, 12, n).astype(float), rng.integers(0, 12, k).astype(float)
        allowed = rng.random((n, k)) < 0.45
        best, least = 0.0, ()
        for size in range(1, n + 1):
            for some in combinations(range(n), size):
                excess = rows[list(some)].sum() - cols[allowed[list(some)].any(axis=0)].sum()
                if excess > best:
                    best, least = excess, some
        excess, blocked = m.blocked_categories(rows, cols, allowed)
        assert abs(excess - best) < 1e-9
        assert tuple(np.flatnonzero(blocked)) == least


def test_feasibility_of_more_dimensions_is_unknown_where_nothing_settles_it():
    support = np.ones((2, 2, 2), dtype=bool)
    wants = [np.array([3.0, 5.0])] * 3
    assert m.feasibility(wants, support, 1.0) == (False, [])
    support[0, 0, 0] = False
    assert m.feasibility(wants, support, 1.0) == (None, []) and m.feasibility(wants, support, 1e-9) == (False, [])
    support[0, 0, 1] = support[0, 1, 0] = False
    # of the first categories, only 0, 1, 1 is left: the first of a dimension has to go with the second of the others
    assert m.feasibility([np.array([6.0, 2.0])] * 3, support, 1.0)[0] is True
    assert m.feasibility([np.array([3.0, 5.0]), np.array([3.0, 4.0]), np.array([3.0, 5.0])], support, 1.0)[0] is True


def test_unique_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "z")], "k int, same string, hole string")
    got = {r.column: (r.n_distinct, r.is_unique) for r in m.unique_columns(df).collect()}
    assert got == {"k": (2, True), "same": (None, False), "hole": (2, True)}
    assert {r.column: r.is_unique for r in m.unique_columns(df, count_null=False).collect()}["hole"] is False
    assert m.unique_columns(df.limit(0)).isEmpty()


def test_values_of_ruled_out_columns_are_not_shuffled(spark):
    df = spark.range(20_000).selectExpr("id AS key", "id % 19990 AS nearly", "id % 7 AS few", "CAST(null AS string) AS none")
    out = m.unique_columns(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "nearly" in plan and "few AS value" not in plan and "% 7" not in plan
    assert {r.column: (r.n_distinct, r.is_unique) for r in out.collect()} == {"key": (20_000, True), "nearly": (19_990, False), "few": (None, False), "none": (None, False)}


def test_every_column_is_counted(spark, tmp_path):
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    rows = [(k, None if k == 3 else f"n{k}", k % 7, -0.0 if k == 1 else float(k % 20 // 2), "a" if k % 2 else None) for k in range(1, 21)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty" / "customer.parquet"))
    for folder in (tmp_path, tmp_path / "empty"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
        want = sorted(con.execute(ORACLE_SQL["unique_columns"]).fetchall())
        assert sorted(tuple(r) for r in QUERIES["unique_columns"](spark, str(folder)).collect()) == want
        assert all(n is not None for _, n, _ in want)
    got = {r.column: (r.n_distinct, r.is_unique) for r in m.unique_columns(spark.createDataFrame(rows, schema), count_all=True).collect()}
    assert got == {"c_custkey": (20, True), "c_name": (20, True), "c_nationkey": (7, False), "c_acctbal": (10, False), "c_mktsegment": (2, False)}


def test_seed_of_a_projection(spark):
    spec = m.Spec([ABC, XY, PQ], [("a", "x", "p"), ("b", "y", "unknown")])
    cells = m.expand_impossible(spark, [ABC, XY])
    got = {(r.d1, r.d2): r.weight for r in m.seed_projection(cells, spec, (0, 1)).collect()}
    assert {k for k, w in got.items() if w == 0} == {("a", "x"), ("b", "y")} and len(got) == 6
    assert {r.weight for r in m.seed_projection(cells, spec, (0, 1), "all").collect()} == {1.0}
