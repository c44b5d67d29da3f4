import math
import random
from collections import Counter
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citywright.functions import scalars as s
from citywright.operators import compare, flows, geo, network, stats, trips
from citywright.sources import readers, writers

PLANS = """<population>
<person id="p1"><plan selected="yes" score="3.5">
<activity type="h" link="1" x="-8.6" y="41.1" end_time="07:00:00"/><leg mode="walk" dep_time="07:00:00" trav_time="00:05:00"><attributes><attribute name="routingMode" class="java.lang.String">bus</attribute></attributes></leg>
<activity type="pt interaction" max_dur="00:00:00"/><leg mode="pt" dep_time="07:05" trav_time="00:20:00"/>
<activity type="pt interaction"/><leg mode="walk" dep_time="07:25:00" trav_time="00:01:00"/>
<activity type="w" x="-8.5" y="41.2" end_time="25:30:00"/><leg mode="car" dep_time="25:30:00" trav_time="undefined"/><activity type="h"/>
</plan><plan><activity type="h"/></plan></person></population>"""


def test_plans_to_trips(spark, tmp_path):
    (tmp_path / "plans.xml").write_text(PLANS)
    pe = readers.read_plans(spark, str(tmp_path / "plans.xml"))
    assert pe.count() == 10 and trips.activities(pe).count() == 6
    legs = trips.legs_from_elements(pe).withColumn("distance_m", F.lit(100.0))
    assert [(r.from_type, r.to_type) for r in legs.orderBy("leg_no").collect()] == [("h", "pt interaction"), ("pt interaction", "pt interaction"), ("pt interaction", "w"), ("w", "h")]
    got = {r.trip_no: (r.from_type, r.to_type, r.main_mode, r.n_legs, r.distance_m) for r in trips.trips_from_legs(legs).collect()}
    assert got == {1: ("h", "w", "bus", 3, 300.0), 2: ("w", "h", "car", 1, 100.0)}
    assert legs.where("leg_no = 4").first().start_s == 25 * 3600 + 1800
    writers.write_plans(pe, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_elements_keep_their_order_and_files_are_split(spark, tmp_path):
    plan = "<plan selected='yes'><activity type='h'/><activity type='w &amp; x' x='1.5'/><leg mode='car'/><leg mode='walk' dep_time='08:00:00' trav_time='00:10:00'/><activity type='h'/></plan>"
    persons = "".join(f"<person id='{k}'><attributes><attribute name='a'>b</attribute></attributes>{plan if k % 3 else ''}</person>" if k % 5 else f"<person id='{k}'/>" for k in range(2000))
    (tmp_path / "plans.xml").write_text(f"<?xml version='1.0'?><!DOCTYPE population><population>{persons}</population>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        pe = readers.read_plans(spark, str(tmp_path / "plans.xml"))
        assert pe.rdd.getNumPartitions() > 3
        rows = pe.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {str(k) for k in range(2000) if k % 3 and k % 5}
    assert {r.person_id for r in rows} == want and len(rows) == 5 * len(want)
    assert {(r.pos, r.kind, r.type, r.mode, r.start_s, r.end_s) for r in rows} == {(0, "activity", "h", None, None, None), (1, "activity", "w & x", None, None, None), (2, "leg", None, "car", None, None), (3, "leg", None, "walk", 28800, 29400), (4, "activity", "h", None, None, None)}


def test_plans_in_xml_come_back_equal(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for person in ["p&1", '<"2">', *map(str, range(30))]:
        for plan in range(rng.randrange(1, 4)):
            for pos in range(rng.randrange(1, 9)):
                t = rng.randrange(100_000)
                if rng.random() < 0.4:
                    rows.append((person, plan, plan == 0, rng.random() * 100, pos, "leg", None, rng.choice(["car", "a&b"]), rng.choice([None, "pt<"]), None, None, None, t, t + 60, None))
                else:
                    rows.append((person, plan, plan == 0, rng.random() * 100, pos, "activity", rng.choice(["h", 'w"x']), None, None, "l1", rng.uniform(-9, 9), 0.1, None, rng.choice([None, t]), 5))
    score = {}
    rows = [(*r[:3], score.setdefault(r[:2], r[3]), *r[4:]) for r in rows]
    kind = "person_id string, plan_idx int, selected boolean, score double, pos int, kind string, type string, mode string, routing_mode string, link string, x double, y double, start_s int, end_s int, max_dur_s int"
    df = spark.createDataFrame(rows, kind)
    writers.write_plans_xml(df.repartition(7), str(tmp_path / "out"))
    back = readers.read_plans(spark, str(tmp_path / "out")).drop("iteration")
    assert Counter(map(tuple, back.collect())) == Counter(rows)
    for part in (tmp_path / "out").glob("part-*"):
        from xml.etree import ElementTree

        ids = [p.get("id") for p in ElementTree.parse(part).getroot()]
        assert ids == sorted(ids)
    writers.write_plans_xml(df.limit(0), str(tmp_path / "none"))
    assert readers.read_plans(spark, str(tmp_path / "none")).isEmpty()


def test_an_aborted_write_leaves_nothing_behind(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("string").alias("node_id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    links = spark.createDataFrame([], "link_id string, from_node string, to_node string, length double")
    with pytest.raises(Exception, match="no"):
        writers.write_network_xml(bad.repartition(5), links, str(tmp_path / "network"))
    assert not [p for p in (tmp_path / "network").rglob("*") if p.is_file() and p.name.startswith("part")]
    good = spark.createDataFrame([("a&b", 1.0, 2.5)], "node_id string, x double, y double")
    writers.write_network_xml(good, links, str(tmp_path / "good"))
    assert [tuple(r) for r in readers.read_network(spark, str(tmp_path / "good/*"))[0].collect()] == [("a&b", 1.0, 2.5)]


def test_tables_with_one_value_column(spark, tmp_path):
    (tmp_path / "0.t.txt").write_text("time\tcar\n00:00\t5\n\naverage: 5\n")
    (tmp_path / "1.t.txt").write_text("time\tcar\tpt\n00:00\t5\t7\nfooter\tx\n")
    got = {(r.iteration, r.time, r.column, r.value) for r in readers.read_iteration_table(spark, str(tmp_path / "*.t.txt"), "time").collect()}
    assert got == {(0, "00:00", "car", 5.0), (1, "00:00", "car", 5.0), (1, "00:00", "pt", 7.0)}


def test_statistics_identities(spark):
    rng = random.Random(5)
    legs = [(0, p, 0, k, "h" if k == 1 else "pt interaction", "pt interaction" if k < n else "w", rng.choice(["car", "pt", "walk"]), "bus", float(rng.randrange(5000)), rng.randrange(6000), 0, rng.randrange(90000), False) for p in range(200) for n in [rng.randrange(1, 4)] for k in range(1, n + 1)]
    df = spark.createDataFrame(legs, "iteration int, person_id int, plan_idx int, leg_no int, from_type string, to_type string, mode string, routing_mode string, distance_m double, travel_s int, wait_s int, dep_s int, stuck boolean").withColumn("arr_s", F.col("dep_s") + F.col("travel_s"))
    t = trips.trips_from_legs(df)
    assert t.count() == 200
    share = stats.mode_share(t, ["bus", "car"]).first()
    assert (share.bus, share.car) == (1.0, 0.0)
    table = stats.leg_durations(df).collect()
    assert sum(v for r in table for v in r[2:]) == len(legs)
    histogram = stats.leg_histogram(df, n_bins=1).where("mode = 'all'").first()
    assert (histogram.departures, histogram.arrivals, histogram.en_route) == (len(legs), len(legs), 0)
    end = stats.leg_histogram(df).where("mode = 'all'").orderBy(F.desc("bin")).first()
    assert end.en_route == 0
    mean = stats.travel_distance(df, t).first()
    total = sum(x[8] for x in legs)
    assert math.isclose(mean.avg_leg_distance, total / len(legs)) and math.isclose(mean.avg_trip_distance, total / 200)
    hours = stats.person_hours(df, ["car", "pt", "walk"]).first()
    assert math.isclose((hours.car_travel + hours.pt_travel + hours.walk_travel) * 3600 / len(legs), stats.avg_leg_duration(df).first().avg_s)


def test_scores(spark):
    plans = spark.createDataFrame([(1, 1, 0, 5.0), (1, 2, 1, 3.0), (2, 3, 1, 8.0), (2, 4, 1, 8.0)], "person_id int, plan_id int, iteration int, score double")
    marked = plans.withColumn("selected", F.col("score") == 8.0)
    assert [tuple(r) for r in stats.selected_plan(marked).collect()] == [(2, 3, 8.0)]
    assert [tuple(r) for r in stats.best_plan(plans).orderBy("person_id").collect()] == [(1, 1, 5.0), (2, 3, 8.0)]
    rows = {r.iteration: r for r in stats.score_stats(plans).collect()}
    assert rows[0].avg_best == 5.0 and rows[1].avg_executed == 5.5 and rows[1].avg_best == 6.5 and rows[1].avg_worst == 5.5


def test_scores_equal_every_iteration_written_out(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(9), k, rng.choice([0, 1, 3, 4, 8]), rng.random() * 100) for k in range(60)]
    df = spark.createDataFrame(rows, "person_id int, plan_id int, iteration int, score double")
    got = {r.iteration: tuple(r[1:]) for r in stats.score_stats(df).collect()}
    assert sorted(got) == list(range(min(r[2] for r in rows), max(r[2] for r in rows) + 1))
    for i, found in got.items():
        figures = []
        for p in range(9):
            known = sorted((it, plan, sc) for person, plan, it, sc in rows if person == p and it <= i)
            if known:
                scores = [x[2] for x in known]
                figures.append((known[-1][2], min(scores), sum(scores) / len(scores), max(scores)))
        assert all(math.isclose(a, sum(f[k] for f in figures) / len(figures), rel_tol=1e-9) for k, a in enumerate(found))
    plan = stats.score_stats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "explode" not in plan.lower() and "Generate" not in plan
    assert stats.score_stats(df.limit(0)).isEmpty()


def test_only_rows_of_differing_steps_are_compared(spark):
    kind = "time_s long, type string, attrs map<string,string>"
    rows = [(t, rng, {"b": str(k), "a": "x"}) for t in range(50) for k in range(20) for rng in ["view"]]
    other = [r for r in rows if r[0] != 7] + [(7, "view", {"a": "x", "b": str(k)}) for k in range(19)] + [(99, "new", None)] + [(None, "n", {})] * 2
    one, two = (spark.createDataFrame(r, kind) for r in (rows + [(None, "n", {})], other))
    assert {r.time_s for r in compare.differing_steps(one, two).collect()} == {7, 99, None}
    assert compare.differing_steps(one, one.orderBy(F.rand(3))).isEmpty()
    got = compare.compare_events(one, two)
    # the steps are joined before rows are counted, so what is shuffled is theirs
    plan = got._jdf.queryExecution().executedPlan().toString()
    semi = plan.index("LeftSemi")
    assert "BroadcastHashJoin" in plan and plan.rindex("Exchange hashpartitioning", 0, semi) < semi
    assert {(r.time_s, r.event, r.n_expected, r.n_actual) for r in got.collect()} == {(7, 'view {"a":"x","b":"19"}', 1, 0), (99, "new", 0, 1), (None, "n {}", 1, 2)}


def test_scalars(spark):
    df = spark.createDataFrame([("07:00:00",), ("25:61:00",), ("30:00:05",), ("09:30",), ("",), ("undefined",), (None,)], "t string")
    assert [r[0] for r in df.select(s.hms_to_s(F.col("t"))).collect()] == [25200, None, 108005, 34200, None, None, None]
    one = spark.range(1)
    assert one.select(s.s_to_hms(F.lit(511.925))).first()[0] == "00:08:31"
    x, y = s.web_mercator(F.lit(-8.61), F.lit(41.15))
    row = one.select(x, y).first()
    assert math.isclose(row[0], -958460.8, abs_tol=1) and math.isclose(row[1], 5034571.8, abs_tol=200)
    assert one.select(*s.web_mercator(F.lit(0.0), F.lit(90.0))).first()[1] is None


def star(rng, n, at=(0.0, 0.0), size=100.0, whole=False):
    """A closed ring of n corners around a point, in turn far and near."""
    out = []
    for k in range(n):
        r, turn = size * (0.3 + 0.7 * rng.random()), 2 * math.pi * k / n
        p = [at[0] + r * math.cos(turn), at[1] + r * math.sin(turn)]
        out.append([float(round(c)) for c in p] if whole else p)
    return [*out, out[0]]


def comb(n, high=50.0):
    """A ring of n tall teeth, all with tips at one height."""
    teeth = [p for k in range(n) for p in ([float(k), 1.0], [k + 0.5, high])]
    return [[0.0, 0.0], *teeth, [float(n), 0.0], [0.0, 0.0]]


def test_zones_equal_the_plain_test_on_rings_of_any_shape(spark, monkeypatch):
    """Whole coordinates put corners and points on each other's lines and on the cells' borders."""
    for seed in range(6):
        rng, whole = random.Random(seed), seed % 2 == 0
        rows = []
        for k in range(7):
            at = (rng.randrange(-80, 80), rng.randrange(-80, 80))
            outer, hole = star(rng, rng.choice([3, 5, 40, 700]), at, 90.0, whole), star(rng, 6, at, 25.0, whole)
            polygons = [[outer, hole], [star(rng, 9, (at[0] + 60, at[1]), 50.0, whole)]]
            rows.append((f"z{k}", polygons))
        rows += [("z8", [[comb(rng.choice([4, 300]))]]), ("z9", [[[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], []]), ("zz", [[star(rng, 200, (0, 0), 1000.0, whole)]])]
        zones = spark.createDataFrame(rows, "zone string, polygons array<array<array<array<double>>>>")
        value = (lambda: float(rng.randrange(-150, 150))) if whole else (lambda: rng.uniform(-150, 150))
        points = [(k, value(), value()) for k in range(400)] + [(500, None, 1.0), (501, float("nan"), 0.0), (502, 1e300, 0.0), (503, 0.0, float("-inf"))]
        points += [(600 + k, p[0], p[1]) for k, p in enumerate(rows[0][1][0][0][:20])]
        frame = spark.createDataFrame(points, "id int, x double, y double").selectExpr("*", "'old' AS zone", "1 AS near", "2 AS odd", "3 AS cx")
        plain = frame.drop("zone").crossJoin(zones).where(s.point_in_polygons(F.col("x"), F.col("y"), F.col("polygons"))).groupBy("id").agg(F.min("zone").alias("zone"))
        want = {r.id: r.zone for r in plain.collect()}
        for most in (geo.MOST_EDGES, 0):
            monkeypatch.setattr(geo, "MOST_EDGES", most)
            got = geo.assign_zone(frame, zones)
            assert got.columns == ["id", "x", "y", "near", "odd", "cx", "zone"]
            assert {r.id: r.zone for r in got.collect()} == {p[0]: want.get(p[0]) for p in points}


def test_cells_of_the_index_hold_few_edges_and_their_number_is_bounded(spark):
    for ring in (star(random.Random(1), 20_000), comb(10_000)):
        edges = geo.zone_edges(spark.createDataFrame([("z", [[ring]])], "zone string, polygons array<array<array<array<double>>>>"))
        grid, n = geo.zone_grid(edges)
        sizes = [len(r.near[0].edges) // 4 for r in geo.zone_index(edges, grid).collect()]
        assert n == len(ring) - 1 and sum(sizes) < 10 * n and max(sizes) < n / 20
        assert len(sizes) < 2 * max(geo.LEAST_CELLS, n / geo.EDGES_A_CELL) + n


def test_open_rings_are_closed_and_no_zones_give_no_zone(spark):
    kind = "zone string, polygons array<array<array<array<double>>>>"
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "id int, x double, y double")
    zones = spark.createDataFrame([("a", [[[[0.0, 0.0], [4.0, 0.0], [None, 1.0], [0.0, 4.0]]]]), ("b", None), ("c", []), ("d", [[[[8.0, 8.0], [10.0, 10.0]]]])], kind)
    assert {r.id: r.zone for r in geo.assign_zone(points, zones).collect()} == {1: "a", 2: None}
    assert {r.zone for r in geo.assign_zone(points, spark.createDataFrame([], kind)).collect()} == {None}
    assert geo.assign_zone(points.limit(0), zones).isEmpty()


def test_zones_and_bounds(spark, tmp_path, monkeypatch):
    square = "[[0,0],[10,0],[10,10],[0,10],[0,0]]"
    (tmp_path / "Holed.geojson").write_text('{"type":"MultiPolygon","coordinates":[[%s,[[4,4],[6,4],[6,6],[4,6],[4,4]]]]}' % square)
    (tmp_path / "Tri.geojson").write_text('{"type":"MultiPolygon","coordinates":[[[[20,0],[30,0],[20,10],[20,0]]]]}')
    zones = readers.read_zones(spark, str(tmp_path / "*.geojson"))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 21.0, 1.0), (4, 29.0, 9.0), (5, None, 1.0)], "id int, x double, y double")
    for most in (geo.MOST_EDGES, 0):
        monkeypatch.setattr(geo, "MOST_EDGES", most)
        got = Counter((r.id, r.zone) for r in geo.assign_zone(points.unionByName(points), zones).collect())
        assert got == {(1, "Holed"): 2, (2, None): 2, (3, "Tri"): 2, (4, None): 2, (5, None): 2}
    nodes = spark.createDataFrame([], "x double, y double")
    assert geo.extent(nodes).first().minx is None
    assert {r.inside for r in geo.check_boundaries(points, nodes).collect()} == {None}
    moved = {r.id: (r.ok, r.y) for r in geo.reproject_plans(points).collect()}
    assert moved[5] == (False, 1.0) and moved[1][0]


def brute_components(n, edges):
    reach = {a: {a} for a in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for r in reach.values():
                if a in r and b not in r:
                    r.add(b)
                    changed = True
    groups = {frozenset(b for b in reach[a] if a in reach[b]) for a in range(n)}
    return max(groups, key=lambda g: (len(g), -min(g)))


def test_largest_component(spark):
    rng = random.Random(2)
    cases = [[(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3)], [(5, 6), (6, 5), (1, 2), (2, 1), (2, 5)], [(0, 1), (1, 2)], []]
    cases += [[(rng.randrange(12), rng.randrange(12)) for _ in range(16)]]
    for edges in cases:
        links = spark.createDataFrame([(str(k), a, b) for k, (a, b) in enumerate(edges)], "link_id string, from_node int, to_node int")
        nodes = spark.createDataFrame([(k,) for k in range(12)], "node_id int")
        keep = {r.node for r in network.largest_scc(nodes, links).collect()}
        assert keep == set(brute_components(12, edges)), edges
        named = {r.node: r.component for r in network.strong_components(nodes, links).collect()}
        reach = {a: {a} for a in range(12)}
        for _ in range(12):
            for a, b in edges:
                for r in reach.values():
                    if a in r:
                        r.add(b)
        assert named == {a: min(b for b in reach[a] if a in reach[b]) for a in range(12)}, edges
    kept_nodes, kept_links = network.clean_network(nodes, links)
    assert {r.from_node for r in kept_links.collect()} | {r.to_node for r in kept_links.collect()} <= {r.node_id for r in kept_nodes.collect()}


def test_chains_end_in_rounds_logarithmic_in_their_length(spark):
    n = 3000
    kind = "node int, pred int, succ int"
    path = [(k, k - 1, k + 1) for k in range(1, n)]
    ring = [(10_000 + k, 10_000 + (k - 1) % n, 10_000 + (k + 1) % n) for k in range(n)]
    opened, rings, rounds = network.chain_ends(spark.createDataFrame(path + ring, kind))
    assert {(r.head, r.tail) for r in opened.collect()} == {(0, n)} and opened.count() == n - 1
    assert {r.component for r in rings.collect()} == {10_000} and rings.count() == n
    assert rounds <= math.ceil(math.log2(n)) + 2


def test_components_of_paths_trees_and_rings(spark):
    """A tree into a ring, a chain between two rings, a chain back to its own start, and a path."""
    rng = random.Random(6)
    ring = lambda base, n: [(base + k, base + (k + 1) % n) for k in range(n)]
    edges = ring(0, 7) + ring(20, 5) + [(3, 50), (50, 51), (51, 52), (52, 22)] + [(21, 60), (60, 61), (61, 21)] + [(70 + k, 71 + k) for k in range(9)]
    edges += [(100 + k, 100 + (k - 1) // 2 if k else 0) for k in range(31)] + ring(200, 12) + [(202, 300), (300, 301), (301, 206)]
    for case in (edges, [*(e for e in edges if rng.random() < 0.9), (22, 0)], ring(0, 30)):
        links = spark.createDataFrame([(str(k), a, b) for k, (a, b) in enumerate(case)], "link_id string, from_node int, to_node int")
        names = sorted({x for e in case for x in e})
        nodes = spark.createDataFrame([(k,) for k in names], "node_id int")
        reach = {a: {a} for a in names}
        grown = True
        while grown:
            grown = False
            for a, b in case:
                for r in reach.values():
                    if a in r and b not in r:
                        r.add(b)
                        grown = True
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in names}
        assert {r.node: r.component for r in network.strong_components(nodes, links).collect()} == want
        sizes = Counter(want.values())
        top = max(sizes, key=lambda c: (sizes[c], -c))
        assert {r.node for r in network.largest_scc(nodes, links).collect()} == {a for a in names if want[a] == top}


def test_flows_and_files(spark, tmp_path):
    record = lambda code, name, total, place, n: {"geocod": code, "geodsg": name, "dim_3_t": "H", "dim_4_t": "Estudante", "dim_5": total, "dim_6_t": place, "valor": str(n)}
    import json

    rows = [record("1", "Paranhos", "T", "Noutra freguesia, do mesmo", 5), record("2", "Paranhos", "T", "Na freguesia", 7), record("3", "Else", "T", "Na freguesia", 9), record("1", "Paranhos", "1", "Na freguesia", 3), record("1", "Paranhos", "T", "Estrangeiro", 2)]
    (tmp_path / "i.json").write_text(json.dumps([{"Dados": {"2021": rows}}]))
    records = readers.read_indicator(spark, str(tmp_path / "i.json"), "2021")
    assert readers.read_indicator(spark, str(tmp_path / "i.json"), "1999").count() == 0
    from citywright.plans.workloads import collected_flows

    table = collected_flows(records, ["Paranhos"])
    assert sorted((r.geocod, r.valor) for r in table.collect()) == [("1", 5), ("2", 7)]
    assert flows.homonyms(records).first().n_codes == 2
    writers.write_flows(table.drop("geocod"), str(tmp_path / "csv"))
    assert sorted(r.valor for r in readers.read_flows(spark, str(tmp_path / "csv")).collect()) == [5, 7]


def test_network_config_and_tables(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<network><nodes><node id="a" x="1" y="2"/><node id="b" x="3" y="4"/></nodes><links><link id="1" from="a" to="b" length="5"/></links></network>')
    nodes, links = readers.read_network(spark, str(tmp_path / "n.xml"))
    assert nodes.count() == 2 and links.first().to_node == "b"
    writers.write_network(nodes, links, str(tmp_path / "net"))
    (tmp_path / "c.xml").write_text('<config><module name="scoring"><parameterset type="activityParams"><param name="activityType" value="w"/><param name="openingTime" value="07:00:00"/><param name="closingTime" value=""/></parameterset><parameterset type="scoringParameters"><param name="x" value="1"/><parameterset type="activityParams"><param name="activityType" value="h"/><param name="typicalDuration" value="12:00:00"/></parameterset></parameterset></module></config>')
    params = {r.activity_type: r for r in readers.read_activity_params(spark, str(tmp_path / "c.xml")).collect()}
    assert params["w"].opening_s == 25200 and params["w"].closing_s is None and params["h"].typical_s == 43200
    (tmp_path / "f.xml").write_text('<facilities><facility id="1" x="1" y="2"><activity type="h"/><activity type="w"/></facility></facilities>')
    assert readers.read_facilities(spark, str(tmp_path / "f.xml")).count() == 2
    for k, head in enumerate(["time\tcar", "time\tcar\tpt"]):
        (tmp_path / f"{k}.hist.txt").write_text(head + "\n" + "00:05:00\t3" + "\t4" * k + "\n\naverage leg duration: 5\n")
    long = readers.read_iteration_table(spark, str(tmp_path / "*.hist.txt"), "time")
    assert sorted((r.iteration, r.column, r.value) for r in long.where("column != 'x'").collect()) in ([(0, "car", 3.0), (1, "car", 3.0), (1, "pt", 4.0)], [(1, "car", 3.0), (1, "pt", 4.0)])


def test_census_from_geopackage(spark, tmp_path):
    path = str(tmp_path / "c.gpkg")
    with sqlite3.connect(path) as base:
        base.execute("create table gpkg_contents (table_name text, data_type text)")
        base.execute("insert into gpkg_contents values ('sections', 'features')")
        base.execute("create table sections (label text, a real, b integer, geom blob)")
        base.executemany("insert into sections values (?, ?, ?, null)", [("s1", 1.5, 2), ("s2", None, 3)])
        base.execute("create table many (label integer, a real, b integer)")
        base.executemany("insert into many values (?, ?, ?)", [(k, k / 2, k % 10) for k in range(1000)])
        base.execute("create table empty (label text, a real, b integer)")
    got = readers.read_census(spark, path, "label", ["a", "b"]).orderBy("label").collect()
    assert [tuple(r) for r in got] == [("s1", 1.5, 2.0), ("s2", None, 3.0)]
    many = readers.read_census(spark, path, "label", ["a", "b"], layer="many")
    assert many.rdd.getNumPartitions() == 8 and many.count() == 1000
    some = readers.read_census(spark, path, "label", ["a", "b"], layer="many", where="b = 3 or a < 1")
    assert {r.label for r in some.where("label != '13'").collect()} == {"0", "1", *map(str, range(3, 1000, 10))} - {"13"}
    # a frame may be read with a filter and again without
    assert some.count() == 102 and many.where("b = 3.0").count() == 100 and many.count() == 1000
    assert readers.read_census(spark, path, "label", ["a", "b"], layer="empty").isEmpty()
    schema = StructType([StructField("label", StringType()), StructField("b", DoubleType())])
    assert readers.GeoPackageReader({"path": "/x.gpkg", "where": "b > 1"}, schema).sql("t") == 'select "label", "b" from "t" where rowid between ? and ? and (b > 1)'


def test_comparisons(spark):
    a = spark.createDataFrame([(1.0, "dep", {"x": "1", "y": "2"}), (1.0, "dep", {"y": "2", "x": "1"}), (2.0, "arr", {})], "time_s double, type string, attrs map<string,string>")
    b = a.limit(1).unionByName(a.where("time_s = 2"))
    got = compare.compare_events(a, b).collect()
    assert len(got) == 1 and (got[0].n_expected, got[0].n_actual) == (2, 1)
    assert compare.compare_events(a, a).isEmpty()
    e = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "person_id string, score double")
    assert [r.person_id for r in compare.compare_scores(e, e.where("score = 1")).collect()] == ["q"]
    volumes = spark.createDataFrame([(1, 7, 30)], "link_id int, hour int, volume int")
    counts = spark.createDataFrame([(1, 7, 20.0), (2, 7, 0.0)], "link_id int, hour int, count_volume double")
    rows = {r.link_id: r for r in compare.compare_counts(volumes, counts).collect()}
    assert rows[1].relative_error == 50.0 and math.isclose(rows[1].geh, 2.0) and rows[2].geh == 0.0 and rows[2].relative_error is None
