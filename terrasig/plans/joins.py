"""Join queries: equi, semi, anti, spatial proximity, boxes, as-of and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.functions import grids
from terrasig.operators import descent, sampling, spatial
from terrasig.plans.registry import query
from terrasig.plans.tables import Tables
from terrasig.plans.views import with_views

DIST_M = """2*6371000e0*asin(sqrt(LEAST(1e0, pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2))))"""
DIST = DIST_M.format(a="a", b="b")
DIST_KM = DIST.replace("6371000e0", "63710088e-4")


@query(
    "join_case_features",
    with_views(
        "event rain",
        """SELECT e.event_id, e.cell, e.d, r.p3d, r.s3 FROM event e JOIN rain r ON r.cell = e.cell AND r.d = e.d""",
    ),
)
def join_case_features(t: Tables) -> DataFrame:
    return t.event.join(t.rain.select("cell", "d", "p3d", "s3"), ["cell", "d"]).select("event_id", "cell", "d", "p3d", "s3")


@query(
    "join_left_optional",
    with_views(
        "place",
        """SELECT p.id, p.name, c.c_acctbal AS people FROM place p LEFT JOIN customer c ON c.c_custkey = p.id*31""",
    ),
)
def join_left_optional(t: Tables) -> DataFrame:
    c = t.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("people"))
    p = t.place.withColumn("k", F.col("id") * 31)
    return p.join(c, "k", "left").select("id", "name", "people")


STRATA_SQL = (
    "strata",
    """SELECT event_id // 3 AS stratum, cell, d, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS label, event_id FROM event""",
)


def strata(t: Tables) -> DataFrame:
    return t.event.select(
        F.floor(F.col("event_id") / 3).alias("stratum"),
        "cell",
        "d",
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("label"),
        "event_id",
    )


@query(
    "semi_complete_strata",
    with_views(
        "event",
        """SELECT stratum, event_id, label FROM (SELECT *, MAX(label) OVER (PARTITION BY stratum) AS hi, MIN(label) OVER (PARTITION BY stratum) AS lo FROM strata)
           WHERE hi = 1 AND lo = 0""",
        STRATA_SQL,
    ),
)
def semi_complete_strata(t: Tables) -> DataFrame:
    return sampling.complete_strata(strata(t)).select("stratum", "event_id", "label")


@query(
    "semi_min_events",
    with_views("event", "SELECT event_id, cell FROM event WHERE cell IN (SELECT cell FROM event GROUP BY 1 HAVING COUNT(*) >= 4)"),
)
def semi_min_events(t: Tables) -> DataFrame:
    return sampling.keys_with_at_least(t.event, ["cell"], 4).select("event_id", "cell")


@query(
    "anti_banned_dates",
    with_views(
        "daily event_day",
        """SELECT cell, d FROM daily x WHERE NOT EXISTS (SELECT 1 FROM event_day e WHERE e.cell = x.cell AND abs(e.d - x.d) <= 7)""",
    ),
)
def anti_banned_dates(t: Tables) -> DataFrame:
    widen = F.explode(F.sequence(F.lit(-7), F.lit(7)))
    banned = t.event_day.withColumn("k", widen).select("cell", F.date_add("d", F.col("k")).alias("d")).distinct()
    return t.daily.select("cell", "d").join(banned, ["cell", "d"], "left_anti")


CONTROL_SQL = (
    (
        "cc",
        """SELECT DISTINCT event_id AS stratum, cell, d FROM event""",
    ),
    (
        "cand",
        """SELECT stratum, cell, a + o AS control FROM (
             SELECT c.stratum, c.cell, make_date(y.y, month(c.d), CASE WHEN month(c.d) = 2 AND day(c.d) = 29 AND y.y % 4 <> 0 THEN 28 ELSE day(c.d) END) AS a
             FROM cc c, (SELECT UNNEST(generate_series(1996, 2001)) AS y) y WHERE y.y <> year(c.d)), (SELECT UNNEST(generate_series(-45, 45))::INTEGER AS o)
           WHERE year(a + o) BETWEEN 1996 AND 2001""",
    ),
    (
        "cand_ok",
        """SELECT x.stratum, x.cell, x.control FROM cand x WHERE NOT EXISTS (SELECT 1 FROM (SELECT cell, d + k AS b FROM event_day, (SELECT UNNEST(generate_series(-7, 7))::INTEGER AS k)) e
           WHERE e.cell = x.cell AND e.b = x.control)""",
    ),
)


def cases(t: Tables) -> DataFrame:
    return t.event.select(F.col("event_id").alias("stratum"), "cell", "d")


@query(
    "control_candidates",
    with_views("event event_day", "SELECT stratum, cell, control FROM cand_ok", *CONTROL_SQL),
)
def control_candidates(t: Tables) -> DataFrame:
    return sampling.control_candidates(cases(t), t.event, 1996, 2001).select("stratum", "cell", "control")


@query("controls")
def controls(t: Tables) -> DataFrame:
    """Four drawn controls per case, with the design checked per row: distance in days to the nearest own event."""
    return sampling.draw_controls(cases(t), t.event, 1996, 2001, 4, seed=17).select("stratum", "cell", "control")


def boxes(t: Tables) -> DataFrame:
    return t.place.select(
        F.col("name").alias("region"),
        (F.col("lon") - 12.0).alias("x0"),
        (F.col("lat") - 8.0).alias("y0"),
        (F.col("lon") + 12.0).alias("x1"),
        (F.col("lat") + 8.0).alias("y1"),
    )


@query(
    "range_point_in_box",
    with_views(
        "point place",
        """SELECT p.id, MIN(b.name) AS region FROM point p LEFT JOIN place b ON p.lon BETWEEN b.lon - 12e0 AND b.lon + 12e0
           AND p.lat BETWEEN b.lat - 8e0 AND b.lat + 8e0 GROUP BY 1""",
    ),
)
def range_point_in_box(t: Tables) -> DataFrame:
    return spatial.first_box(t.point, boxes(t))


@query(
    "anti_proximity",
    with_views(
        "point place",
        f"SELECT a.id FROM point a WHERE NOT EXISTS (SELECT 1 FROM place b WHERE {DIST} < 15e4)",
    ),
)
def anti_proximity(t: Tables) -> DataFrame:
    return spatial.without_neighbours(t.point, t.place, "id", 150_000.0).select("id")


@query(
    "radius_sum",
    with_views(
        "point place",
        f"""SELECT a.id, ROUND(COALESCE(SUM(b.people), 0), 2) AS people FROM place a LEFT JOIN point b ON {DIST_KM} <= 10e2 GROUP BY 1""",
    ),
)
def radius_sum(t: Tables) -> DataFrame:
    return descent.radius_sum(t.place, t.point, 1000.0, "people", "people").withColumn("people", F.round("people", 2))


@query(
    "radius_sum_10km",
    with_views(
        "point place",
        f"""SELECT a.id, ROUND(COALESCE(SUM(b.people), 0), 2) AS people FROM place a LEFT JOIN point b ON {DIST_KM} <= 1e1 GROUP BY 1""",
    ),
)
def radius_sum_10km(t: Tables) -> DataFrame:
    """People within ten kilometres of every registered location."""
    return descent.radius_sum(t.place, t.point, 10.0, "people", "people").withColumn("people", F.round("people", 2))


NEAREST_SQL = (
    "nn",
    f"""SELECT a.id, arg_min(b.id, ROUND(m, 6)) AS vertex, MIN(m) AS metres FROM (SELECT a.id AS aid, b.id AS bid, {DIST} AS m FROM point a, place b) x
        JOIN point a ON a.id = x.aid JOIN place b ON b.id = x.bid GROUP BY 1""",
)


@query("nearest_neighbour", with_views("point place", "SELECT id, ROUND(metres, 3) AS metres FROM nn", NEAREST_SQL))
def nearest_neighbour(t: Tables) -> DataFrame:
    return descent.nearest(t.point, t.place).select("id", F.round("metres", 3).alias("metres"))


@query(
    "nearest_valid_cell",
    with_views(
        "point place",
        """SELECT p.id, COALESCE(b.i, p.i) AS i, COALESCE(b.j, p.j) AS j, COALESCE(b.d2 > 0, FALSE) AS snapped
           FROM (SELECT id, CAST(floor(lat/3e0) AS BIGINT) AS i, CAST(floor(lon/3e0) AS BIGINT) AS j FROM place) p
           LEFT JOIN (SELECT * FROM (SELECT p.id, v.i, v.j, (v.i-p.i)*(v.i-p.i)+(v.j-p.j)*(v.j-p.j) AS d2,
               ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY (v.i-p.i)*(v.i-p.i)+(v.j-p.j)*(v.j-p.j), v.i-p.i, v.j-p.j) AS rn
             FROM (SELECT id, CAST(floor(lat/3e0) AS BIGINT) AS i, CAST(floor(lon/3e0) AS BIGINT) AS j FROM place) p
             JOIN (SELECT DISTINCT CAST(floor(lat/3e0) AS BIGINT) AS i, CAST(floor(lon/3e0) AS BIGINT) AS j FROM point WHERE people >= 5e3) v
               ON abs(v.i-p.i) <= 2 AND abs(v.j-p.j) <= 2) WHERE rn = 1) b ON b.id = p.id""",
    ),
)
def nearest_valid_cell(t: Tables) -> DataFrame:
    ij = lambda df: df.select(
        "*", grids.snap(F.col("lat"), 3.0).alias("i"), grids.snap(F.col("lon"), 3.0).alias("j")
    )
    valid = ij(t.point.filter(F.col("people") >= 5000.0)).select("i", "j").distinct()
    return spatial.nearest_valid_cell(ij(t.place), valid)


@query(
    "grid_node_nearest",
    with_views(
        "point",
        """SELECT gi, gj, id FROM (SELECT n.gi, n.gj, p.id, ROW_NUMBER() OVER (PARTITION BY n.gi, n.gj ORDER BY pow(p.lat - n.la, 2) + pow(p.lon - n.lo, 2), p.id) AS rn,
             pow(p.lat - n.la, 2) + pow(p.lon - n.lo, 2) AS d2
           FROM (SELECT i.i AS gi, j.j AS gj, -5e1 + i.i*4e0 AS la, -17e1 + j.j*4e0 AS lo FROM (SELECT UNNEST(generate_series(0, 24))::INTEGER AS i) i, (SELECT UNNEST(generate_series(0, 84))::INTEGER AS j) j) n
           JOIN point p ON abs(p.lat - n.la) <= 2 AND abs(p.lon - n.lo) <= 2) WHERE rn = 1 AND d2 < 4e0""",
    ),
)
def grid_node_nearest(t: Tables) -> DataFrame:
    return spatial.node_representatives(t.point, -50.0, -170.0, 25, 85, 4.0)


@query(
    "asof_latest",
    with_views(
        "run",
        """SELECT o.o_orderkey AS id, arg_max(r.run_id, (r.trained_at - DATE '1990-01-01')*1000000000 + r.run_id) AS run_id FROM orders o
           LEFT JOIN run r ON r.status = 'complete' AND r.layer = o.o_orderstatus AND r.name = o.o_orderpriority
             AND r.trained_at BETWEEN CAST(o.o_orderdate AS DATE) - 6 AND CAST(o.o_orderdate AS DATE) - 1 GROUP BY 1""",
    ),
)
def asof_latest(t: Tables) -> DataFrame:
    """Freshest complete run at most five days older than the day before each request."""
    freshest = (
        t.run.filter(F.col("status") == "complete")
        .groupBy("name", "layer", "trained_at")
        .agg(F.max("run_id").alias("run_id"))
    )
    back = F.explode(F.sequence(F.lit(1), F.lit(6)))
    asked = t.read("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("layer"),
        F.to_date("o_orderdate").alias("on"),
    )
    near = asked.withColumn("k", back).withColumn("trained_at", F.date_sub("on", F.col("k")))
    found = near.join(freshest, ["name", "layer", "trained_at"], "left")
    return found.groupBy("id").agg(F.max_by("run_id", F.when(F.col("run_id").isNotNull(), F.col("trained_at"))).alias("run_id"))


@query(
    "latest_run",
    with_views(
        "run",
        """SELECT layer, arg_max(run_id, (trained_at - DATE '1990-01-01')*1000000000 + run_id) AS run_id, MAX(trained_at) AS trained_at FROM run WHERE status = 'complete' GROUP BY 1""",
    ),
)
def latest_run(t: Tables) -> DataFrame:
    best = F.max(F.struct("trained_at", "run_id"))
    r = t.run.filter(F.col("status") == "complete").groupBy("layer").agg(best.alias("b"))
    return r.select("layer", F.col("b.run_id").alias("run_id"), F.col("b.trained_at").alias("trained_at"))


@query(
    "ring_neighbourhood",
    with_views(
        "point place",
        """SELECT p.id, MAX(CASE WHEN a.o = 0 AND b.o = 0 THEN f.people END) AS own, MAX(f.people) AS nearby_max FROM place p,
             (SELECT UNNEST([-2e0, 0e0, 2e0]) AS o) a, (SELECT UNNEST([-2e0, 0e0, 2e0]) AS o) b
           LEFT JOIN (SELECT CAST(floor(lat/2e0) AS BIGINT) AS i, CAST(floor(lon/2e0) AS BIGINT) AS j, MAX(people) AS people FROM point GROUP BY 1, 2) f
             ON f.i = CAST(floor((p.lat + a.o)/2e0) AS BIGINT) AND f.j = CAST(floor((p.lon + b.o)/2e0) AS BIGINT) GROUP BY 1""",
    ),
)
def ring_neighbourhood(t: Tables) -> DataFrame:
    field = t.point.groupBy(grids.snap(F.col("lat"), 2.0).alias("i"), grids.snap(F.col("lon"), 2.0).alias("j")).agg(
        F.max("people").alias("people")
    )
    return spatial.ring_max(t.place, field, 2.0, 2.0, "people")
