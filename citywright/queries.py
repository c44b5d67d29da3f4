"""Registered queries: one for each operator, over the shared test tables, with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import count_errors, hms_to_s, label, s_to_hms
from .operators import compare, flows, geo, network, stats, trips
from .operators import ipf as fitting
from .plans import standins as st
from .plans.workloads import collected_flows, joint_distribution, legs_and_trips
from .sources import readers, writers
from .sources.readers import INDICATOR, union_iterations
from .storage import checkpointed, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _counts(column: str, values: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{v}')::DOUBLE AS \"{v}\"" for v in values)


def _dim(number: int, values: list[str]) -> str:
    return f"d{number} AS (" + " UNION ALL ".join(f"SELECT section, '{v}' AS d{number}, \"{v}\" AS t{number}, {k}::BIGINT AS p{number} FROM census" for k, v in enumerate(values)) + ")"


CENSUS = f"""census AS (SELECT c_nationkey::VARCHAR AS section, {_counts('c_mktsegment', st.SEGMENTS)}, {_counts('o_orderpriority', st.PRIORITIES)}, {_counts('o_orderstatus', st.STATUSES)}
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"""
CELLS = f"WITH RECURSIVE {CENSUS}, {_dim(1, st.SEGMENTS)}, {_dim(2, st.PRIORITIES)}"


def _fit(name: str, source: str, layers: dict[str, str]) -> str:
    """CTE ``name`` (source's columns with ``v`` fitted, rnd, err): ``source`` is fitted to the targets of its layers (keys: target column), section by section, to the stop rule."""
    step = f"SELECT * FROM {name}_r WHERE live"
    for keys, goal in layers.items():
        step = f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h <> 0 THEN v * {goal} / h ELSE v END AS v) FROM (SELECT *, sum(v) OVER (PARTITION BY section, {keys}) AS h FROM ({step}))"
    sums = ", ".join(f"sum(v) OVER (PARTITION BY section, {keys}) AS h{k}" for k, keys in enumerate(layers))
    offs = ", ".join(f"CASE WHEN {goal} <> 0 THEN abs(h{k} / {goal} - 1) WHEN h{k} = 0 THEN 0 ELSE 'inf'::DOUBLE END" for k, goal in enumerate(layers.values()))
    gone = ", ".join(f"h{k}" for k in range(len(layers)))
    worst = f"SELECT * EXCLUDE ({gone}), max(greatest({offs})) OVER (PARTITION BY section) AS e FROM (SELECT *, {sums} FROM ({step}))"
    return f"""{name}_r AS (SELECT *, 0 AS rnd, 'inf'::DOUBLE AS err, true AS live FROM {source} UNION ALL
SELECT * EXCLUDE (e) REPLACE (rnd + 1 AS rnd, e AS err, NOT (e <= {fitting.FITTED} OR (isfinite(e) AND isfinite(err) AND abs(e - err) <= {fitting.STALLED})) AS live) FROM ({worst})),
{name} AS (SELECT * FROM {name}_r WHERE NOT live)"""


START_2D = "start AS (SELECT section, d1, d2, p1 * 5 + p2 AS cell_no, t1, t2, CASE WHEN d1 = 'AUTOMOBILE' AND d2 = '1-URGENT' THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM d1 JOIN d2 USING (section))"
FITTED_2D = f"{CELLS}, {START_2D}, {_fit('fit', 'start', {'d1': 't1', 'd2': 't2'})} SELECT section, d1, d2, cell_no, round(v, 6) AS value FROM fit"


@query(FITTED_2D)
def ipf_2d_impossible(spark, sf_dir):
    """Two dimensions, one impossible pair and one that names an unknown category, to the stop rule."""
    return _rounded(fitting.order_cells(joint_distribution(st.census(spark, sf_dir), st.SPEC_2D, "section")), 6)


def _long_fit(spark, sf_dir):
    census = checkpointed(st.census(spark, sf_dir))
    spec = st.SPEC_2D
    target = lambda k: census.select("section", F.explode(F.array(*[F.struct(F.lit(c).alias(f"d{k}"), F.col(f"`{c}`").alias("target")) for c in spec.dims[k - 1]])).alias("x")).select("section", "x.*")
    cells = checkpointed(census.select("section").join(F.broadcast(fitting.all_cells(spark, spec))))
    return fitting.ipf_long(cells, [["d1"], ["d2"]], [target(1), target(2)])


@query(f"{FITTED_2D.rsplit(' SELECT ', 1)[0]} SELECT section, d1, d2, cell_no, round(v, 6) AS value, rnd AS rounds FROM fit")
def ipf_long_cells(spark, sf_dir):
    """The same over long cells, which no task has to hold together."""
    return _rounded(_long_fit(spark, sf_dir).select("section", "d1", "d2", "cell_no", "value", "rounds"), 6)


def _projection(name: str, a: int, b: int, one: str, two: str) -> str:
    """A projection's cells, none where the impossible triple reaches it, fitted to the 1-D marginals."""
    return f"{name}_s AS (SELECT section, d{a}, d{b}, t{a}, t{b}, CASE WHEN d{a} = '{one}' AND d{b} = '{two}' THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM d{a} JOIN d{b} USING (section)), {_fit(name, f'{name}_s', {f'd{a}': f't{a}', f'd{b}': f't{b}'})}"


IMPOSSIBLE_3D = f"""{CELLS}, {_dim(3, st.STATUSES)}, {_projection('f12', 1, 2, 'AUTOMOBILE', '1-URGENT')}, {_projection('f13', 1, 3, 'AUTOMOBILE', 'P')}, {_projection('f23', 2, 3, '1-URGENT', 'P')},
start AS (SELECT section, d1, d2, d3, (p1 * 5 + p2) * 3 + p3 AS cell_no, f12.v AS t12, f13.v AS t13, f23.v AS t23, CASE WHEN d1 = 'AUTOMOBILE' AND d2 = '1-URGENT' AND d3 = 'P' THEN 0.0 ELSE 1.0 END::DOUBLE AS v
FROM d1 JOIN d2 USING (section) JOIN d3 USING (section) JOIN f12 USING (section, d1, d2) JOIN f13 USING (section, d1, d3) JOIN f23 USING (section, d2, d3)),
{_fit('fit', 'start', {'d1, d2': 't12', 'd1, d3': 't13', 'd2, d3': 't23'})}"""


@query(f"{IMPOSSIBLE_3D} SELECT section, d1, d2, d3, cell_no, round(v, 5) AS value FROM fit")
def ipf_3d_impossible(spark, sf_dir):
    """Three dimensions with an impossible triple, which clears its projections too."""
    return _rounded(fitting.ipf(st.census(spark, sf_dir), st.SPEC_3D_IMPOSSIBLE, "section"), 5)


@query(f"{CELLS} SELECT section, d1, d2, p1 * 5 + p2 AS cell_no, round(t1 * t2 / nullif(sum(t1) OVER (PARTITION BY section, d2), 0), 9) AS value FROM d1 JOIN d2 USING (section)")
def ipf_2d_free(spark, sf_dir):
    """Two dimensions without impossible pairs, to the stop rule: the closed form."""
    return _rounded(fitting.ipf(st.census(spark, sf_dir), st.SPEC_FREE, "section"), 9)


CLOSED_3D = f"{CELLS}, {_dim(3, st.STATUSES)} SELECT section, d1, d2, d3, (p1 * 5 + p2) * 3 + p3 AS cell_no, round(t1 * t2 * t3 / nullif((\"F\" + \"O\" + \"P\") * (\"F\" + \"O\" + \"P\"), 0), 9) AS value FROM d1 JOIN d2 USING (section) JOIN d3 USING (section) JOIN census USING (section)"


@query(CLOSED_3D)
def ipf_3d(spark, sf_dir):
    """Three dimensions by way of the two-dimensional sub-marginals."""
    return _rounded(fitting.ipf(st.census(spark, sf_dir), st.SPEC_3D, "section"), 9)


@query(CLOSED_3D)
def independent_joint(spark, sf_dir):
    """The closed form in plain columns."""
    return _rounded(fitting.independent_joint(st.census(spark, sf_dir), st.SPEC_3D, "section"), 9)


@query(f"""WITH {CENSUS}, t AS (SELECT {', '.join(f'sum("{c}") AS "{c}"' for c in st.SPEC_3D.columns)} FROM census),
a AS ({' UNION ALL '.join(f"SELECT '{v}' AS d1, {k}::BIGINT AS p1, \"{v}\" AS t1 FROM t" for k, v in enumerate(st.SEGMENTS))}), b AS ({' UNION ALL '.join(f"SELECT '{v}' AS d2, {k}::BIGINT AS p2, \"{v}\" AS t2 FROM t" for k, v in enumerate(st.PRIORITIES))})
SELECT d1, d2, p1 * 5 + p2 AS cell_no, round(t1 * t2 / (SELECT "F" + "O" + "P" FROM t), 9) AS value FROM a CROSS JOIN b""")
def ipf_total(spark, sf_dir):
    """The whole area: column totals are fitted."""
    return _rounded(fitting.ipf(st.census(spark, sf_dir), st.SPEC_FREE), 9)


_SUMS = [" + ".join(f'"{c}"' for c in d) for d in st.SPEC_3D.dims]


@query(f"WITH {CENSUS} SELECT section, {', '.join(f'{s} AS total{k}' for k, s in enumerate(_SUMS, 1))}, {_SUMS[0]} = {_SUMS[1]} AND {_SUMS[1]} = {_SUMS[2]} AS equal FROM (SELECT * REPLACE (CASE WHEN section = '7' THEN \"F\" + 1 ELSE \"F\" END AS \"F\") FROM census)")
def census_totals(spark, sf_dir):
    """Totals of each dimension by section, of which one has a count too many."""
    census = st.census(spark, sf_dir).withColumn("F", F.when(F.col("section") == "7", F.col("F") + 1).otherwise(F.col("F")))
    return fitting.check_totals(census, st.SPEC_3D, by="section")


@query(f"WITH {CENSUS} SELECT {', '.join(f'sum("{c}") AS "{c}"' for c in st.SPEC_3D.columns)} FROM census")
def total_marginals(spark, sf_dir):
    return fitting.total_marginals(st.census(spark, sf_dir), st.SPEC_3D)


@query(f"WITH {CENSUS} SELECT section, array_to_string([{', '.join(f'"{c}"::BIGINT' for c in st.SEGMENTS)}], ',') AS m1, array_to_string([{', '.join(f'"{c}"::BIGINT' for c in st.PRIORITIES)}], ',') AS m2 FROM census")
def census_marginals(spark, sf_dir):
    """Each dimension's values in column order."""
    text = lambda m: F.array_join(F.transform(m, lambda x: x.cast("long").cast("string")), ",").alias(m)
    return fitting.marginals(st.census(spark, sf_dir), st.SPEC_FREE).select("section", text("m1"), text("m2"))


@query("""WITH c AS (SELECT count(DISTINCT c_custkey) AS a, count(DISTINCT c_name) AS b, count(DISTINCT c_nationkey) AS c, count(DISTINCT c_acctbal) AS d, count(DISTINCT c_mktsegment) AS e, count(*) AS n FROM customer)
SELECT 'c_custkey' AS "column", a AS n_distinct, a = n AS is_unique FROM c UNION ALL SELECT 'c_name', b, b = n FROM c UNION ALL SELECT 'c_nationkey', c, c = n FROM c UNION ALL SELECT 'c_acctbal', d, d = n FROM c UNION ALL SELECT 'c_mktsegment', e, e = n FROM c""")
def unique_columns(spark, sf_dir):
    """Columns that could be keys, with the number of values of every column; a null is no value."""
    return fitting.unique_columns(st.table(spark, sf_dir, "customer"), count_null=False, count_all=True)


@query(f"WITH {CENSUS} SELECT count(*) * 75 AS n_types FROM census")
def type_count(spark, sf_dir):
    return fitting.type_count(fitting.ipf(st.census(spark, sf_dir), st.SPEC_3D, "section"))


def _feasible(spec: fitting.Spec) -> str:
    """CTEs up to ``feasible`` (section, shown, blocked): for every pair of dimensions, the set of categories whose sum exceeds most that of all it can meet, of all sets."""
    dims, gone = spec.dims, spec.valid_impossible()
    parts, ctes = [], []
    for one, two in permutations(range(len(dims)), 2):
        rest = [a for a in range(len(dims)) if a not in (one, two)]

        def allowed(i: int, j: int) -> str:
            place = {one: i, two: j}
            ways = [dict(zip(rest, p, strict=True)) for p in product(*[range(len(dims[a])) for a in rest])]
            possible = [w for w in ways if tuple((place | w)[a] for a in range(len(dims))) not in gone]
            return "(" + " OR ".join(" AND ".join(["true", *[f'"{dims[a][k]}" <> 0' for a, k in w.items()]]) for w in possible) + ")" if possible else "false"

        own = " + ".join(f'CASE WHEN m & {1 << i} <> 0 THEN "{c}" ELSE 0 END' for i, c in enumerate(dims[one]))
        met = " + ".join(f'CASE WHEN {" OR ".join(f"(m & {1 << i} <> 0 AND {allowed(i, j)})" for i in range(len(dims[one])))} THEN "{c}" ELSE 0 END' for j, c in enumerate(dims[two]))
        name = f"set{one}{two}"
        ctes.append(f"{name} AS (SELECT section, m, {own} - ({met}) AS excess FROM census, range(1, {1 << len(dims[one])}) AS r(m)), {name}_best AS (SELECT section, max(excess) AS excess, arg_min(m, (-excess, bit_count(m))) AS m FROM {name} GROUP BY section)")
        parts += [f"SELECT section, {one} AS dim, {i} AS place, '{c}' AS name FROM {name}_best WHERE excess > 0 AND m & {1 << i} <> 0" for i, c in enumerate(dims[one])]
    totals = [" + ".join(f'"{c}"' for c in d) for d in dims]
    unequal = " OR ".join(f"{totals[0]} <> {t}" for t in totals[1:])
    return f""", {', '.join(ctes)}, bad AS ({' UNION '.join(parts)}),
feasible AS (SELECT c.section, any_value({unequal}) OR count(name) > 0 AS shown, coalesce(string_agg(name, ',' ORDER BY dim, place), '') AS blocked FROM census c LEFT JOIN bad b ON b.section = c.section GROUP BY c.section)"""


_TRIPLE_SUMS = "SELECT section, max(greatest(o1, o2, o3)) AS e FROM (SELECT section, " + ", ".join(
    f"CASE WHEN t{k} <> 0 THEN abs(sum(v) OVER (PARTITION BY section, d{k}) / t{k} - 1) ELSE 0 END AS o{k}" for k in (1, 2, 3)
) + " FROM fit JOIN d1 USING (section, d1) JOIN d2 USING (section, d2) JOIN d3 USING (section, d3)) GROUP BY section"


@query(f"""{IMPOSSIBLE_3D}, off AS ({_TRIPLE_SUMS}), ends AS (SELECT section, max(rnd) AS rnd, max(err) AS err FROM fit GROUP BY section)
{_feasible(st.SPEC_3D_IMPOSSIBLE)}
SELECT section, rnd AS rounds, round(err, 5) AS last_error, round(off.e, 5) AS max_error, err <= {fitting.FITTED} AS converged, CASE WHEN shown THEN true WHEN off.e <= {fitting.FITTED} THEN false END AS infeasible, blocked FROM ends JOIN off USING (section) JOIN feasible USING (section)""")
def ipf_report(spark, sf_dir):
    """Rounds, last errors, and distance of the fitted sums from the 1-D targets, where the impossible triple leaves no exact fit of its projections."""
    report = fitting.ipf_report(st.census(spark, sf_dir), st.SPEC_3D_IMPOSSIBLE, "section")
    return _rounded(report.withColumn("blocked", F.array_join("blocked", ",")), 5)


@query(f"WITH {CENSUS}{_feasible(st.SPEC_BLOCKED)} SELECT section, shown AS infeasible, blocked FROM feasible")
def ipf_feasibility(spark, sf_dir):
    """Sections in which two segments have more orders than the two priorities they can have, by a greatest flow."""
    report = fitting.ipf_report(st.census(spark, sf_dir), st.SPEC_BLOCKED, "section", rounds=50)
    return report.select("section", "infeasible", F.array_join("blocked", ",").alias("blocked"))


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS d1, '{b}' AS d2" for a in st.SEGMENTS for b in st.PRIORITIES)


@query(f"WITH all_ AS ({_PAIRS}) SELECT d1, d2, d1 = 'AUTOMOBILE' AND d2 = '1-URGENT' AS gone, (SELECT count(DISTINCT o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = d1 AND o_orderpriority = d2) AS n FROM all_")
def seed_projection(spark, sf_dir):
    """The cells of a projection, those cleared that the impossible triple reaches, with the orders that fall into each."""
    cells = fitting.expand_impossible(spark, [st.SEGMENTS, st.PRIORITIES])
    seeded = fitting.seed_projection(cells, st.SPEC_3D_IMPOSSIBLE, (0, 1))
    o, c = st.table(spark, sf_dir, "orders"), st.table(spark, sf_dir, "customer")
    counts = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("d1"), F.col("o_orderpriority").alias("d2")).agg(F.count("*").alias("n"))
    return seeded.join(counts, ["d1", "d2"], "left").select("d1", "d2", (F.col("weight") == 0).alias("gone"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH pairs AS (SELECT c_mktsegment AS d1, o_orderpriority AS d2, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), held AS (SELECT d1, d2 FROM pairs WHERE n > (SELECT avg(n) FROM pairs)),
wanted AS (SELECT d1, d2 FROM (VALUES ('AUTOMOBILE'), ('BUILDING')) AS a(d1) CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW')) AS b(d2)), gone AS (SELECT d1, d2 FROM pairs WHERE d2 = '2-HIGH' OR n = (SELECT max(n) FROM pairs))
(SELECT d1, d2 FROM held UNION SELECT d1, d2 FROM wanted) EXCEPT SELECT d1, d2 FROM gone""")
def impossible_tables(spark, sf_dir):
    """Combinations added to those there are, each once, and others taken out."""
    o, c = st.table(spark, sf_dir, "orders"), st.table(spark, sf_dir, "customer")
    pairs = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("d1"), F.col("o_orderpriority").alias("d2")).agg(F.count("*").alias("n"))
    compared = pairs.join(F.broadcast(pairs.agg(F.avg("n").alias("mean"), F.max("n").alias("most"))))
    held = compared.where("n > mean").select("d1", "d2")
    more = fitting.add_impossible(held, fitting.expand_impossible(spark, [["AUTOMOBILE", "BUILDING"], ["1-URGENT", "5-LOW"]]))
    return fitting.remove_impossible(more, compared.where("d2 = '2-HIGH' or n = most").select("d1", "d2"))


# --- plans, legs, trips and their statistics -------------------------------------------------------------------

LEGS = """e AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, (day(ts) - 1) // 7 AS iteration, CASE event_type WHEN 'view' THEN 'h' WHEN 'purchase' THEN 'w' WHEN 'signup' THEN 'l' WHEN 'click' THEN 'car interaction' ELSE 'pt interaction' END AS type FROM events),
f AS (SELECT *, lead(type) OVER w AS to_type, row_number() OVER w AS leg_no FROM e WINDOW w AS (PARTITION BY iteration, user_id ORDER BY ts, event_id)),
legs AS (SELECT iteration::INTEGER AS iteration, user_id AS person_id, leg_no, type AS from_type, to_type, CASE WHEN k % 3 = 0 THEN 'car' WHEN event_id % 2 = 0 THEN 'pt' ELSE 'walk' END AS mode, CASE k % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'bus' ELSE 'subway' END AS routing_mode,
round(value * 100) AS distance_m, floor(value * 10)::INTEGER AS travel_s, (event_id % 300)::INTEGER AS wait_s, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INTEGER AS dep_s, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INTEGER + floor(value * 10)::INTEGER AS arr_s, event_id % 50 = 0 AS stuck FROM f WHERE to_type IS NOT NULL)"""
TRIPS = f"""{LEGS}, numbered AS (SELECT *, sum(CASE WHEN from_type LIKE '% interaction' THEN 0 ELSE 1 END) OVER (PARTITION BY iteration, person_id ORDER BY leg_no) AS trip_no FROM legs),
trips AS (SELECT iteration, person_id, trip_no::BIGINT AS trip_no, arg_min(from_type, leg_no) AS from_type, arg_max(to_type, leg_no) AS to_type, arg_min(routing_mode, leg_no) AS main_mode, sum(distance_m) AS distance_m, count(*) AS n_legs FROM numbered GROUP BY ALL)"""


def _legs(spark, sf_dir):
    return legs_and_trips(st.plan_elements(spark, sf_dir))


@query("SELECT ((day(ts) - 1) // 7)::INTEGER AS iteration, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def plan_activities(spark, sf_dir):
    """Activities of all plans, counted by type."""
    names = {"h": "view", "w": "purchase", "l": "signup", "car interaction": "click", "pt interaction": "error"}
    kind = reduce(lambda c, kv: F.when(F.col("type") == kv[0], kv[1]).otherwise(c), names.items(), F.lit(None).cast("string"))
    return trips.activities(st.plan_elements(spark, sf_dir)).groupBy("iteration", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {LEGS} SELECT iteration, person_id, leg_no::INTEGER AS leg_no, from_type, to_type, mode, travel_s FROM legs")
def plan_legs(spark, sf_dir):
    """Legs with the activities before and after."""
    return _legs(spark, sf_dir)[0].select("iteration", "person_id", "leg_no", "from_type", "to_type", "mode", "travel_s")


@query(f"WITH {TRIPS} SELECT * FROM trips")
def plan_trips(spark, sf_dir):
    """Trips between activities that are not stages, with their main mode."""
    return _legs(spark, sf_dir)[1].drop("plan_idx")


@query(f"WITH {TRIPS} SELECT iteration, {', '.join(f"round(avg(CASE WHEN main_mode = '{m}' THEN 1.0 ELSE 0.0 END), 6) AS {m}" for m in ('bus', 'car', 'subway'))} FROM trips GROUP BY iteration")
def mode_share(spark, sf_dir):
    return _rounded(stats.mode_share(_legs(spark, sf_dir)[1], ["bus", "car", "subway"]), 6)


@query(f"WITH {LEGS} SELECT iteration, {', '.join(f"round(coalesce(sum(distance_m) FILTER (WHERE mode = '{m}'), 0) / 1000)::BIGINT AS {m}" for m in ('car', 'pt', 'walk'))} FROM legs GROUP BY iteration")
def person_km(spark, sf_dir):
    return stats.person_km(_legs(spark, sf_dir)[0], ["car", "pt", "walk"])


@query(f"WITH {LEGS} SELECT iteration, {', '.join(f"round(coalesce(sum({c}_s) FILTER (WHERE mode = '{m}'), 0) / 3600, 9) AS {m}_{c}" for c in ('travel', 'wait') for m in ('car', 'pt', 'walk'))} FROM legs GROUP BY iteration")
def person_hours(spark, sf_dir):
    return _rounded(stats.person_hours(_legs(spark, sf_dir)[0], ["car", "pt", "walk"]))


@query(f"WITH {TRIPS} SELECT iteration, round(l.d, 9) AS avg_leg_distance, round(t.d, 9) AS avg_trip_distance FROM (SELECT iteration, avg(distance_m) AS d FROM legs GROUP BY 1) l JOIN (SELECT iteration, avg(distance_m) AS d FROM trips GROUP BY 1) t USING (iteration)")
def travel_distance(spark, sf_dir):
    return _rounded(stats.travel_distance(*_legs(spark, sf_dir)))


def _histogram_sql(n_bins: int | None) -> str:
    place = lambda c: f"{c} // 300" if n_bins is None else f"least({c} // 300, {n_bins - 1})"
    return f"""WITH {LEGS}, facts AS (SELECT iteration, mode, {place('dep_s')} AS bin, 1 AS d, 0 AS a, 0 AS s FROM legs UNION ALL SELECT iteration, mode, {place('arr_s')}, 0, CASE WHEN stuck THEN 0 ELSE 1 END, CASE WHEN stuck THEN 1 ELSE 0 END FROM legs),
both_ AS (SELECT * FROM facts UNION ALL SELECT iteration, 'all', bin, d, a, s FROM facts),
grid AS (SELECT m.iteration, m.mode, g.bin FROM (SELECT DISTINCT iteration, mode FROM both_) m JOIN (SELECT iteration, unnest(range(0, max(bin) + 1)) AS bin FROM facts GROUP BY iteration) g USING (iteration)),
sums AS (SELECT iteration, mode, bin, sum(d)::BIGINT AS departures, sum(a)::BIGINT AS arrivals, sum(s)::BIGINT AS stuck FROM both_ GROUP BY ALL),
wide AS (SELECT iteration, mode, bin::BIGINT AS bin, coalesce(departures, 0) AS departures, coalesce(arrivals, 0) AS arrivals, coalesce(stuck, 0) AS stuck FROM grid LEFT JOIN sums USING (iteration, mode, bin))
SELECT *, sum(departures - arrivals - stuck) OVER (PARTITION BY iteration, mode ORDER BY bin)::BIGINT AS en_route FROM wide"""


@query(_histogram_sql(None))
def leg_histogram(spark, sf_dir):
    return stats.leg_histogram(_legs(spark, sf_dir)[0])


@query(_histogram_sql(1))
def leg_histogram_one_bin(spark, sf_dir):
    """Everything clamped into one bin."""
    return stats.leg_histogram(_legs(spark, sf_dir)[0], n_bins=1)


@query(f"WITH {LEGS} SELECT iteration, from_type || '---' || to_type AS pattern, {', '.join(f'count(*) FILTER (WHERE least(travel_s // 300, 12) = {k}) AS c{5 * k}' for k in range(13))} FROM legs GROUP BY ALL")
def leg_durations(spark, sf_dir):
    return stats.leg_durations(_legs(spark, sf_dir)[0])


@query(f"WITH {LEGS} SELECT iteration, round(avg(travel_s), 9) AS avg_s, printf('%02d:%02d:%02d', floor(avg(travel_s) / 3600)::INTEGER, floor(avg(travel_s) / 60)::INTEGER % 60, floor(avg(travel_s))::INTEGER % 60) AS avg_hms FROM legs GROUP BY iteration")
def avg_leg_duration(spark, sf_dir):
    return _rounded(stats.avg_leg_duration(_legs(spark, sf_dir)[0]))


@query(f"WITH {LEGS} SELECT iteration, count(*) FILTER (WHERE mode = 'car') AS car, CASE WHEN iteration = 0 THEN 0 ELSE count(*) FILTER (WHERE mode = 'pt') END AS pt, CASE WHEN iteration = 0 THEN 0 ELSE count(*) FILTER (WHERE mode = 'walk') END AS walk FROM legs GROUP BY iteration")
def union_of_iterations(spark, sf_dir):
    """Departures by mode, where the first iteration's table lacks two of the columns."""
    legs = _legs(spark, sf_dir)[0]
    wide = lambda part, modes: part.groupBy("iteration").agg(*[F.count(F.when(F.col("mode") == m, 1)).alias(m) for m in modes])
    return union_iterations([wide(legs.where("iteration = 0"), ["car"]), wide(legs.where("iteration > 0"), ["car", "pt", "walk"])])


@query("SELECT o_custkey AS person_id, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS plan_id, max(o_totalprice) AS score FROM orders GROUP BY o_custkey")
def best_plan(spark, sf_dir):
    return stats.best_plan(st.scored_plans(spark, sf_dir))


@query("SELECT o_custkey AS person_id, min(o_orderkey) AS plan_id, arg_min(o_totalprice, o_orderkey) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def selected_plan(spark, sf_dir):
    """The plan that each person executes; persons without a selected one are left out."""
    return stats.selected_plan(st.scored_plans(spark, sf_dir))


@query("""WITH p AS (SELECT o_custkey AS person, year(o_orderdate)::INTEGER AS iteration, o_orderkey AS plan, o_totalprice AS score FROM orders),
grid AS (SELECT person, unnest(range(min(iteration), (SELECT max(iteration) FROM p) + 1))::INTEGER AS iteration FROM p GROUP BY person),
memory AS (SELECT g.iteration, g.person, arg_max(p.score, (p.iteration, p.plan)) AS executed, min(p.score) AS worst, avg(p.score) AS mean, max(p.score) AS best FROM grid g JOIN p ON p.person = g.person AND p.iteration <= g.iteration GROUP BY ALL)
SELECT iteration, round(avg(executed), 3) AS avg_executed, round(avg(worst), 3) AS avg_worst, round(avg(mean), 3) AS avg_avg, round(avg(best), 3) AS avg_best FROM memory GROUP BY iteration""")
def score_stats(spark, sf_dir):
    return _rounded(stats.score_stats(st.scored_plans(spark, sf_dir)), 3)


# --- counts and comparisons ------------------------------------------------------------------------------------


@query("SELECT user_id AS link_id, hour(ts)::BIGINT AS hour, count(*) AS volume FROM events GROUP BY ALL")
def link_volumes(spark, sf_dir):
    return stats.link_volumes(st.link_entries(spark, sf_dir))


@query("SELECT user_id AS link_id, round(count(*) / 30.0, 9)::DOUBLE AS daily_volume FROM events GROUP BY ALL")
def daily_volumes(spark, sf_dir):
    return _rounded(stats.daily_volumes(stats.link_volumes(st.link_entries(spark, sf_dir)), 30))


@query("""WITH obs AS (SELECT user_id AS link_id, hour(ts)::BIGINT AS hour, count(*)::DOUBLE AS o FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL), sim AS (SELECT user_id AS link_id, hour(ts)::BIGINT AS hour, count(*)::DOUBLE AS s FROM events WHERE event_type <> 'error' AND user_id % 7 <> 0 GROUP BY ALL),
b AS (SELECT link_id, hour, coalesce(s, 0) AS s, o FROM obs LEFT JOIN sim USING (link_id, hour))
SELECT link_id, hour, s AS sim_volume, o AS count_volume, round(100 * (s - o) / nullif(o, 0), 9) AS relative_error, round(abs(s - o) / greatest(s, o), 9) AS normalized_error, round(sqrt(2 * (s - o) * (s - o) / (s + o)), 9) AS geh FROM b""")
def compare_counts(spark, sf_dir):
    """Simulated volumes against counts, with relative errors and GEH."""
    entries = st.link_entries(spark, sf_dir)
    counted = stats.link_volumes(entries.where(F.col("event_type").isin("view", "click"))).select("link_id", "hour", F.col("volume").cast("double").alias("count_volume"))
    return _rounded(compare.compare_counts(stats.link_volumes(entries.where("event_type != 'error' and link_id % 7 != 0")), counted))


@query("SELECT c_custkey AS person_id, c_acctbal AS expected, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal + 1 END AS actual FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 5 = 0")
def compare_scores(spark, sf_dir):
    """Persons whose score is missing or differs."""
    c = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_acctbal").alias("score"))
    actual = c.where("person_id % 11 != 0").withColumn("score", F.when(F.col("person_id") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return compare.compare_scores(c, actual, 1e-6)


@query("""WITH a AS (SELECT date_trunc('day', ts) AS d, event_type || ' {"user":"' || (user_id % 10)::VARCHAR || '"}' AS event, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT date_trunc('day', ts) AS d, event_type || ' {"user":"' || (user_id % 10)::VARCHAR || '"}' AS event, count(*) AS n FROM events WHERE event_type <> 'signup' AND event_id % 9 <> 0 GROUP BY ALL)
SELECT epoch(d)::BIGINT AS time_s, event, coalesce(a.n, 0) AS n_expected, coalesce(b.n, 0) AS n_actual FROM a FULL JOIN b USING (d, event) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def compare_events(spark, sf_dir):
    """Events by day that one table has more often than its changed copy."""
    e = st.table(spark, sf_dir, "events")
    rows = e.select(F.unix_timestamp(F.date_trunc("day", "ts")).alias("time_s"), F.col("event_type").alias("type"), F.create_map(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("attrs"), "event_id")
    return compare.compare_events(rows, rows.where("type != 'signup' and event_id % 9 != 0"))


# --- coordinates and networks ----------------------------------------------------------------------------------

POINTS = "points AS (SELECT c_custkey, CASE WHEN c_custkey % 97 <> 0 THEN -8.7 + (c_custkey % 1000) * 0.0002::DOUBLE END AS x, 41.1 + (c_custkey % 700) * 0.0002::DOUBLE AS y FROM customer)"
MERCATOR = "6378137.0 * radians(x) AS px, 6378137.0 * ln(tan(pi() / 4 + radians(y) / 2)) AS py"


@query(f"WITH {POINTS} SELECT c_custkey, round(CASE WHEN x IS NULL THEN NULL ELSE 6378137.0 * radians(x) END, 3) AS x, round(CASE WHEN x IS NULL THEN y ELSE 6378137.0 * ln(tan(pi() / 4 + radians(y) / 2)) END, 3) AS y, x IS NOT NULL AS ok FROM points")
def reproject_plans(spark, sf_dir):
    """Web Mercator coordinates, the old ones where there is none."""
    return _rounded(geo.reproject_plans(st.points(spark, sf_dir)), 3)


@query(f"WITH {POINTS}, p AS (SELECT c_custkey, {MERCATOR} FROM points), box AS (SELECT min(a) AS a, max(b) AS b, min(c) AS c, max(d) AS d FROM (SELECT 6378137.0 * radians(min(s_nationkey * 0.008::DOUBLE - 8.69)) AS a, 6378137.0 * radians(max(s_nationkey * 0.008::DOUBLE - 8.69)) AS b, 6378137.0 * ln(tan(pi() / 4 + radians(min(s_nationkey * 0.005::DOUBLE + 41.11)) / 2)) AS c, 6378137.0 * ln(tan(pi() / 4 + radians(max(s_nationkey * 0.005::DOUBLE + 41.11)) / 2)) AS d FROM supplier)) SELECT c_custkey, CASE WHEN px IS NULL THEN NULL ELSE px BETWEEN a AND b AND py BETWEEN c AND d END AS inside FROM p CROSS JOIN box")
def check_boundaries(spark, sf_dir):
    """Activities against the extent of the network's nodes."""
    p = st.points(spark, sf_dir)
    return geo.check_boundaries(p, st.nodes(spark, sf_dir)).select("c_custkey", "inside")


@query(f"""WITH s AS (SELECT 6378137.0 * radians(s_nationkey * 0.008::DOUBLE - 8.69) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(s_nationkey * 0.005::DOUBLE + 41.11) / 2)) AS y FROM supplier), e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM s)
SELECT k AS corner, round(CASE WHEN k < 2 THEN a ELSE b END, 3) AS x, round(CASE WHEN k IN (0, 3) THEN c ELSE d END, 3) AS y FROM e, range(4) AS r(k)""")
def extent_corners(spark, sf_dir):
    """The network's extent as its four corners, from the lower left one round."""
    box = geo.extent(st.nodes(spark, sf_dir))
    return _rounded(box.select(F.posexplode("corners").alias("corner", "c")).select(F.col("corner").cast("long").alias("corner"), "c.x", "c.y"), 3)


@query(f"""WITH {POINTS} SELECT c_custkey, CASE WHEN x > -8.65005 AND x < -8.55005 AND y > 41.12005 AND y < 41.20005 AND NOT (x > -8.62005 AND x < -8.59005 AND y > 41.14005 AND y < 41.17005) THEN 'inner'
WHEN x > -8.70005 AND x < -8.66005 AND y > 41.10005 AND y < 41.15005 OR x > -8.54005 AND x < -8.50005 AND y > 41.10005 AND y < 41.23005 THEN 'outer' END AS zone FROM points""")
def assign_zone(spark, sf_dir):
    """Points in zones with a hole and with two parts."""
    return geo.assign_zone(st.points(spark, sf_dir), st.zones(spark)).select("c_custkey", "zone")


@query("""WITH p(type, typical, opening, latest, closing) AS (VALUES ('w', 28800, 25200, 32400, 64800), ('h', 43200, NULL, NULL, NULL), ('l', 7200, 36000, NULL, 82800)),
a AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'w' WHEN 'view' THEN 'h' WHEN 'signup' THEN 'l' ELSE event_type END AS type, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INTEGER AS s, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INTEGER + floor(value * 100)::INTEGER AS e FROM events),
b AS (SELECT *, greatest(0, least(e, coalesce(closing, e)) - greatest(s, coalesce(opening, s))) AS performed FROM a LEFT JOIN p USING (type))
SELECT event_id, greatest(0, least(e, coalesce(opening, s)) - s)::INTEGER AS wait_s, performed::INTEGER AS performed_s, greatest(0, s - coalesce(latest, s))::INTEGER AS late_s, greatest(0, coalesce(typical, 0) - performed)::INTEGER AS short_s FROM b""")
def activity_windows(spark, sf_dir):
    """Activities of all types against opening, closing, latest start and typical duration; some types have no times."""
    e = st.table(spark, sf_dir, "events")
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    kind = F.when(F.col("event_type") == "purchase", "w").when(F.col("event_type") == "view", "h").when(F.col("event_type") == "signup", "l").otherwise(F.col("event_type"))
    acts = e.select("event_id", kind.alias("type"), s.alias("start_s"), (s + F.floor(F.col("value") * 100)).cast("int").alias("end_s"))
    params = spark.createDataFrame([("w", "08:00:00", "07:00:00", "09:00:00", "18:00:00"), ("h", "12:00:00", "", "undefined", ""), ("l", "02:00:00", "10:00:00", "", "23:00:00")], "activity_type string, t string, o string, l string, c string")
    params = params.select("activity_type", hms_to_s(F.col("t")).alias("typical_s"), hms_to_s(F.col("o")).alias("opening_s"), hms_to_s(F.col("l")).alias("latest_start_s"), hms_to_s(F.col("c")).alias("closing_s"))
    return geo.activity_windows(acts, params).drop("type", "start_s", "end_s")


LINKS = "links AS (SELECT l_partkey AS a, nxt AS b FROM (SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND l_partkey <> nxt GROUP BY ALL)"
# the component of one node is the largest for certain if it has more than half of all nodes; else the SQL gives no row
COMPONENT = f"""WITH RECURSIVE {LINKS}, top_ AS (SELECT o.a AS n FROM (SELECT a, count(*) AS c FROM links GROUP BY 1) o JOIN (SELECT b, count(*) AS c FROM links GROUP BY 1) i ON o.a = i.b ORDER BY o.c * i.c DESC, o.a LIMIT 1),
ahead AS (SELECT n FROM top_ UNION SELECT b FROM links JOIN ahead ON a = n), behind AS (SELECT n FROM top_ UNION SELECT a FROM links JOIN behind ON b = n), whole AS (SELECT n FROM ahead INTERSECT SELECT n FROM behind),
keep AS (SELECT n FROM whole WHERE 2 * (SELECT count(*) FROM whole) > (SELECT count(*) FROM part))"""


def _network(spark, sf_dir):
    links = st.links(spark, sf_dir)
    return st.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")), links


@query(f"{COMPONENT} SELECT n AS node FROM keep")
def largest_scc(spark, sf_dir):
    """The largest set of nodes that all reach each other."""
    return network.largest_scc(*_network(spark, sf_dir))


@query(f"{COMPONENT} SELECT a AS from_node, b AS to_node FROM links WHERE a IN (SELECT n FROM keep) AND b IN (SELECT n FROM keep)")
def clean_network(spark, sf_dir):
    """Links of the cleaned network, each once and without loops."""
    nodes, links = _network(spark, sf_dir)
    return network.clean_network(nodes, links)[1].where("from_node != to_node").select("from_node", "to_node").distinct()


# --- flows -----------------------------------------------------------------------------------------------------

FLOWS = """flows AS (SELECT c_nationkey::VARCHAR AS geocod, CASE WHEN o_orderstatus = 'F' THEN 'H' ELSE 'M' END AS genero, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Estudante' ELSE 'Empregada' END AS ocupacao, CASE WHEN o_orderkey % 2 = 0 THEN 'Na freguesia onde reside' ELSE 'Noutra freguesia, do mesmo município' END AS destino, count(*) AS valor FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
named AS (SELECT *, 'area-' || CASE WHEN geocod = '6' THEN '5' ELSE geocod END AS freguesia FROM flows)"""


@query(f"WITH {FLOWS} SELECT geocod, freguesia, genero, ocupacao, destino, valor FROM named WHERE freguesia IN ('area-1', 'area-5', 'area-9')")
def indicator_flows(spark, sf_dir):
    """Nested indicator text to the flow table of three names, one of which two areas share."""
    parsed = st.indicator(spark, sf_dir).select(F.from_json("text", INDICATOR).alias("j")).select("j.*")
    return collected_flows(flows.records_of(parsed, "2021"), ["area-1", "area-5", "area-9"])


@query(f"WITH {FLOWS} SELECT freguesia AS geodsg, count(DISTINCT geocod) AS n_codes FROM named GROUP BY 1 HAVING count(DISTINCT geocod) > 1")
def homonyms(spark, sf_dir):
    """Names that several codes share."""
    parsed = st.indicator(spark, sf_dir).select(F.from_json("text", INDICATOR).alias("j")).select("j.*")
    return flows.homonyms(flows.records_of(parsed, "2021"))


CUBED = "SELECT geocod, coalesce(genero, 'HM') AS genero, coalesce(ocupacao, 'Total') AS ocupacao, destino, sum(valor)::BIGINT AS valor FROM flows GROUP BY geocod, destino, CUBE (genero, ocupacao)"


@query(f"WITH {FLOWS} {CUBED}")
def flow_totals(spark, sf_dir):
    """Totals over sex and occupation."""
    return flows.flow_totals(st.flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT geocod, genero, ocupacao, destino, valor + 1 AS published, valor AS computed FROM ({CUBED}) WHERE geocod = '3' AND genero = 'HM' AND ocupacao = 'Total'")
def reconcile_totals(spark, sf_dir):
    """Published totals that do not agree with the leaves."""
    totals = flows.flow_totals(st.flows(spark, sf_dir))
    wrong = F.when((F.col("geocod") == "3") & (F.col("genero") == "HM") & (F.col("ocupacao") == "Total"), 1).otherwise(0)
    return flows.reconcile_totals(totals.withColumn("valor", F.col("valor") + wrong))


@query(f"WITH {FLOWS} SELECT geocod, genero, ocupacao, destino, sum(valor)::BIGINT * 2 AS valor, count(*) * 2 AS n FROM flows GROUP BY ALL")
def union_areas(spark, sf_dir):
    """Two deliveries of the same records put together, repeated rows kept."""
    one = st.flows(spark, sf_dir)
    return flows.union_areas([one, one]).groupBy(*flows.KEYS).agg(F.sum("valor").alias("valor"), F.count("*").alias("n"))


# --- scalar functions ------------------------------------------------------------------------------------------


@query("SELECT event_id, (event_id * 37)::INTEGER AS seconds, CASE WHEN event_id % 3 = 0 THEN NULL ELSE printf('%02d:%02d:%02d', ((event_id * 37) // 3600)::INTEGER, ((event_id * 37) // 60 % 60)::INTEGER, (event_id * 37 % 60)::INTEGER) END AS hms, event_type || ' | ' || user_id::VARCHAR AS label FROM events")
def times_of_day(spark, sf_dir):
    """Seconds to text, hours past 24 included, and back."""
    e = st.table(spark, sf_dir, "events")
    hms = s_to_hms(F.col("event_id") * 37)
    return e.select("event_id", hms_to_s(hms).alias("seconds"), F.when(F.col("event_id") % 3 != 0, hms).alias("hms"), label(["event_type", "user_id"]).alias("label"))


@query("SELECT event_id, round(CASE WHEN value <> 0 THEN 100 * (user_id - value) / value END, 9) AS relative_error, round(CASE WHEN greatest(user_id, value) = 0 THEN 0 ELSE abs(user_id - value) / greatest(user_id, value) END, 9) AS normalized_error, round(CASE WHEN user_id + value = 0 THEN 0 ELSE sqrt(2 * (user_id - value) * (user_id - value) / (user_id + value)) END, 9) AS geh FROM events")
def count_error_functions(spark, sf_dir):
    """Relative errors and GEH as column functions."""
    e = st.table(spark, sf_dir, "events")
    return _rounded(e.select("event_id", *[c.alias(n) for n, c in count_errors(F.col("user_id").cast("double"), F.col("value")).items()]), 9)


# --- readers and writers: the stand-ins are written in each format and read back -------------------------------


@query(f"WITH {FLOWS} SELECT geocod, freguesia AS geodsg, genero AS dim_3_t, ocupacao AS dim_4_t, destino AS dim_6_t, x AS dim_5, valor::VARCHAR AS valor FROM named CROSS JOIN (VALUES ('T'), ('1')) AS t(x)")
def read_indicator(spark, sf_dir):
    """Indicator files, nested JSON."""
    return readers.read_indicator(spark, st.indicator_files(spark, sf_dir), "2021").select("geocod", "geodsg", "dim_3_t", "dim_4_t", "dim_6_t", "dim_5", "valor")


@query(f"WITH {CENSUS} SELECT section, {', '.join(f'2 * "{c}" AS "{c}"' for c in st.SEGMENTS)} FROM census")
def read_census(spark, sf_dir):
    """Census tables in CSV and in Parquet, added up."""
    both = [readers.read_census(spark, path, "section", st.SEGMENTS) for path in st.census_files(spark, sf_dir)]
    return both[0].unionByName(both[1]).groupBy("section").agg(*[F.sum(c).alias(c) for c in st.SEGMENTS])


@query(f"WITH {CENSUS} SELECT section, {', '.join(f'"{c}"' for c in st.SEGMENTS)} FROM census WHERE \"BUILDING\" > 10 AND section <> '7'")
def read_geopackage(spark, sf_dir):
    """Rows of a GeoPackage, of which SQLite filters those by number."""
    return readers.read_census(spark, st.census_geopackage(spark, sf_dir), "section", st.SEGMENTS, where='"BUILDING" > 10').where("section != '7'")


@query(f"WITH {FLOWS} SELECT geocod AS freguesia, genero, ocupacao, destino, valor FROM flows")
def flow_files(spark, sf_dir):
    """The flow table written as CSV and read back, names with commas quoted."""
    path = shared_path(spark, "flows")
    writers.write_flows(st.flows(spark, sf_dir).withColumnRenamed("geocod", "freguesia"), path)
    return readers.read_flows(spark, path)


JOINT_SQL = f"SELECT section AS \"Section\", d1 AS \"Var1\", d2 AS \"Var2\", round(t1 * t2 / nullif(sum(t1) OVER (PARTITION BY section, d2), 0), 6) AS \"Value\" FROM d1 JOIN d2 USING (section)"


@query(f"{CELLS} {JOINT_SQL}")
def joint_files(spark, sf_dir):
    """A joint distribution written as Parquet, zero cells included."""
    path = shared_path(spark, "joint")
    writers.write_joint(fitting.ipf(st.census(spark, sf_dir), st.SPEC_FREE, "section"), path)
    return _rounded(spark.read.parquet(path), 6)


@query(f"{FITTED_2D.rsplit(' SELECT ', 1)[0]} SELECT section AS \"Section\", d1 AS \"Var1\", d2 AS \"Var2\", round(v, 6) AS \"Value\" FROM fit WHERE v <> 0")
def joint_csv(spark, sf_dir):
    """A joint distribution with an impossible pair written as CSV without its zero cells, and read back."""
    path = shared_path(spark, "joint-csv")
    writers.write_joint(fitting.ipf(st.census(spark, sf_dir), st.SPEC_2D, "section"), path, drop_zero=True, as_csv=True)
    return _rounded(spark.read.schema("Section string, Var1 string, Var2 string, Value double").option("header", True).csv(path), 6)


WEEK = "(day(ts) - 1) // 7"


@query(f"""{f"WITH {LEGS}"}, weeks AS (SELECT user_id, {WEEK} AS week, count(*) AS n FROM events GROUP BY ALL),
plan AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY week) - 1 AS plan_idx, week, week = max(week) OVER (PARTITION BY user_id) AS selected, n FROM weeks)
SELECT l.person_id::VARCHAR AS person_id, p.plan_idx::INTEGER AS plan_idx, p.selected, p.n / 2.0::DOUBLE AS score, l.leg_no::INTEGER AS leg_no, l.from_type, l.to_type, l.mode, l.routing_mode, l.dep_s AS start_s, l.dep_s + l.travel_s AS end_s
FROM legs l JOIN plan p ON l.person_id = p.user_id AND l.iteration = p.week""")
def read_plans(spark, sf_dir):
    """Plans in XML, down to legs."""
    legs = trips.legs_from_elements(readers.read_plans(spark, st.plan_files(spark, sf_dir)))
    return legs.select("person_id", "plan_idx", "selected", "score", "leg_no", "from_type", "to_type", "mode", "routing_mode", "start_s", "end_s")


@query("SELECT (day(ts) - 1) // 7 AS iteration, count(*) * 2 AS n FROM events GROUP BY 1")
def plan_tables(spark, sf_dir):
    """Plan elements written by iteration, and counted from there."""
    path = shared_path(spark, "plan-tables")
    writers.write_plans(st.plan_elements(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("iteration").cast("long").alias("iteration")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id, {WEEK} ORDER BY ts, event_id) AS i, {WEEK} AS week FROM events),
k AS (SELECT user_id, week, 2 * i AS place, 'activity' AS kind, CASE event_type WHEN 'view' THEN 'h' WHEN 'purchase' THEN 'w' WHEN 'signup' THEN 'l' WHEN 'click' THEN 'car interaction' ELSE 'pt interaction' END AS type, NULL AS mode, NULL::INTEGER AS start_s FROM w
UNION ALL SELECT user_id, week, 2 * i + 1, 'leg', NULL, CASE WHEN CAST(props->>'$.k' AS INTEGER) % 3 = 0 THEN 'car' WHEN event_id % 2 = 0 THEN 'pt' ELSE 'walk' END, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INTEGER FROM w WHERE event_id % 300 % 7 <> 0)
SELECT user_id::VARCHAR AS person_id, (dense_rank() OVER (PARTITION BY user_id ORDER BY week) - 1)::INTEGER AS plan_idx, (row_number() OVER (PARTITION BY user_id, week ORDER BY place) - 1)::INTEGER AS pos, kind, type, mode, start_s FROM k""")
def plans_in_order(spark, sf_dir):
    """Plans in which some legs are missing, written as XML and read back: activities that follow each other keep their places."""
    elements = st.plan_elements(spark, sf_dir).where("kind = 'activity' or wait_s % 7 != 0")
    none = lambda kind: F.lit(None).cast(kind)
    leg = F.col("kind") == "leg"
    rows = elements.select(
        "person_id", F.col("iteration").alias("plan_idx"), F.lit(False).alias("selected"), none("double").alias("score"), "pos", "kind", "type", F.when(leg, F.col("mode")).alias("mode"), F.when(leg, F.col("routing_mode")).alias("routing_mode"),
        none("string").alias("link"), none("double").alias("x"), none("double").alias("y"), F.when(leg, F.col("dep_s")).alias("start_s"), F.when(leg, F.col("arr_s")).alias("end_s"), none("int").alias("max_dur_s"),
    )
    path = shared_path(spark, "population")
    writers.write_plans_xml(rows, path)
    return readers.read_plans(spark, path).select("person_id", "plan_idx", "pos", "kind", "type", "mode", "start_s")


NETWORK_LINKS = "l AS (SELECT l_orderkey || '-' || l_partkey || '-' || nxt AS id, l_partkey AS a, nxt AS b FROM (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"


NETWORK_SQL = f"WITH {NETWORK_LINKS}, o AS (SELECT a, count(*) AS n, sum(length(id) / 2.0) AS length FROM l GROUP BY a) SELECT p_partkey::VARCHAR AS node_id, p_retailprice / 2 AS x, p_size::DOUBLE AS y, coalesce(n, 0) AS n_out, coalesce(length, 0)::DOUBLE AS length FROM part LEFT JOIN o ON p_partkey = a"


@query(NETWORK_SQL)
def read_network(spark, sf_dir):
    """A network in XML: nodes with their outgoing links."""
    nodes, links = readers.read_network(spark, st.network_files(spark, sf_dir))
    out = links.groupBy(F.col("from_node").alias("node_id")).agg(F.count("*").alias("n_out"), F.sum("length").alias("length"))
    return nodes.join(out, "node_id", "left").na.fill(0, ["n_out", "length"]).select("node_id", "x", "y", "n_out", "length")


@query(NETWORK_SQL)
def network_xml(spark, sf_dir):
    """The same network, written as XML by the library and read back."""
    p = st.table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("node_id"), (F.col("p_retailprice") / 2).alias("x"), F.col("p_size").cast("double").alias("y"))
    path = shared_path(spark, "network-xml")
    writers.write_network_xml(nodes, st.links(spark, sf_dir).withColumn("length", F.length("link_id") / 2), path)
    read, links = readers.read_network(spark, f"{path}/*")
    out = links.groupBy(F.col("from_node").alias("node_id")).agg(F.count("*").alias("n_out"), F.sum("length").alias("length"))
    return read.join(out, "node_id", "left").na.fill(0, ["n_out", "length"]).select("node_id", "x", "y", "n_out", "length")


@query(f"WITH {NETWORK_LINKS} SELECT 'nodes' AS kind, count(*) AS n FROM part UNION ALL SELECT 'links', count(*) FROM l")
def network_tables(spark, sf_dir):
    """Nodes and links written as Parquet, and counted from there."""
    path = shared_path(spark, "network-tables")
    nodes, links = _network(spark, sf_dir)
    writers.write_network(nodes, links, path)
    count = lambda kind: spark.read.parquet(f"{path}/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("nodes").unionByName(count("links"))


@query("SELECT event_type AS activity_type, count(*)::DOUBLE AS priority, (floor(avg(event_id))::BIGINT % 86400)::INTEGER AS typical_s, NULL::INTEGER AS opening_s, NULL::INTEGER AS closing_s FROM events GROUP BY event_type")
def read_activity_params(spark, sf_dir):
    """Activity types of a configuration; empty and undefined times are null."""
    return readers.read_activity_params(spark, st.activity_files(spark, sf_dir)).select("activity_type", "priority", "typical_s", "opening_s", "closing_s")


@query("SELECT c_custkey AS facility_id, c_acctbal * 2 AS x, c_nationkey::DOUBLE AS y, t AS activity_type FROM customer, (VALUES (0), (1)) AS v(k), LATERAL (SELECT CASE WHEN k = 0 THEN 'h' WHEN c_mktsegment = 'BUILDING' THEN 'l' ELSE 'w' END AS t)")
def read_facilities(spark, sf_dir):
    """Facilities in XML, a row for each activity."""
    return readers.read_facilities(spark, st.facility_files(spark, sf_dir))


@query("SELECT n_name AS zone, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def read_zones(spark, sf_dir):
    """Zones in GeoJSON, and the suppliers in each."""
    zones = readers.read_zones(spark, f"{st.zone_files(spark, sf_dir)}/*")
    at = st.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 0.5).alias("x"), F.lit(0.5).alias("y"))
    return geo.assign_zone(at, zones).select("zone", "s_suppkey")


@query(f"""WITH e AS (SELECT {WEEK} AS iteration, hour(ts) AS hour, event_type FROM events WHERE {WEEK} > 0 OR event_type <> 'error'), h AS (SELECT DISTINCT iteration, hour FROM e), c AS (SELECT DISTINCT iteration, event_type FROM e)
SELECT h.iteration::INTEGER AS iteration, h.hour::VARCHAR AS hour, c.event_type AS "column", count(e.hour)::DOUBLE AS value FROM h JOIN c USING (iteration) LEFT JOIN e ON e.iteration = h.iteration AND e.hour = h.hour AND e.event_type = c.event_type GROUP BY ALL""")
def read_iteration_table(spark, sf_dir):
    """Per-iteration tables whose columns differ, with footers."""
    return readers.read_iteration_table(spark, f"{st.iteration_files(spark, sf_dir)}/*", "hour")
