"""SQL text of the derived inputs, composed on demand into one WITH clause per check query."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cell_day": (
        (),
        """SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS d, SUM(l_quantity) AS qty,
           CAST(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS ext,
           CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS BIGINT) AS disc,
           CAST(SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS BIGINT) AS tax, COUNT(*) AS n
           FROM lineitem GROUP BY 1, 2""",
    ),
    "spine": (
        ("cell_day",),
        """SELECT c.cell, CAST(g.d AS DATE) AS d FROM (SELECT DISTINCT cell FROM cell_day) c,
           (SELECT UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS d
            FROM (SELECT MIN(d) AS lo, MAX(d) AS hi FROM cell_day)) g""",
    ),
    "daily": (
        ("cell_day", "spine"),
        """SELECT s.cell, s.d,
           CASE WHEN (s.cell*7 + dayofyear(s.d)) % 97 <> 0 THEN COALESCE(r.qty, 0e0)/2e0 END AS precip,
           CASE WHEN (s.cell*5 + dayofyear(s.d)) % 89 <> 0
                THEN COALESCE(CAST(r.ext AS DOUBLE)/r.n/1e2,
                     CAST(20000 + 150*(183 - abs(183 - dayofyear(s.d))) AS DOUBLE))/25e2 END AS tmax,
           COALESCE(CAST(r.disc AS DOUBLE)/r.n*9e0, CAST(30 + (s.cell*13 + dayofyear(s.d)*7) % 50 AS DOUBLE)) AS rh,
           COALESCE(CAST(r.tax AS DOUBLE)/r.n, CAST((s.cell*3 + dayofyear(s.d)) % 9 AS DOUBLE)) AS ws
           FROM spine s LEFT JOIN cell_day r ON r.cell = s.cell AND r.d = s.d""",
    ),
    "rain2": (
        (),
        """SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS d,
           SUM(CASE WHEN l_partkey % 4 < 1 + l_suppkey % 4 THEN l_quantity ELSE 0e0 END)/2e0 AS precip2
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY 1, 2""",
    ),
    "event": (
        (),
        """SELECT event_id, event_id % (SELECT COUNT(*) FROM supplier) AS cell,
           DATE '1996-03-01' + CAST((event_id*37 + user_id*13) % 1990 AS INTEGER) AS d, event_type AS kind
           FROM events""",
    ),
    "event_day": (("event",), "SELECT DISTINCT cell, d FROM event"),
    "point": (
        (),
        """SELECT c_custkey AS id, ((c_custkey*7919) % 11000)/1e2 - 55e0 AS lat,
           ((c_custkey*104729) % 36000)/1e2 - 180e0 AS lon, abs(c_acctbal) AS people, c_mktsegment AS segment,
           c_nationkey AS nation FROM customer""",
    ),
    "place": (
        (),
        """SELECT s_suppkey AS id, ((s_suppkey*7919) % 11000)/1e2 - 55e0 AS lat,
           ((s_suppkey*104729) % 36000)/1e2 - 180e0 AS lon, s_name AS name, s_acctbal AS bal, s_nationkey AS nation
           FROM supplier""",
    ),
    "scored": (
        (),
        """SELECT l.doc_id AS id, d.source AS grp, d.lang, l.quality AS label, l.toxic,
           ROUND(LEAST(1e0, ln(1e0 + d.n_chars)/12e0), 2) AS score
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    ),
    "patch": (
        (),
        """SELECT vec_id AS id, 'r' || label AS region,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE)*1e2 + 5e2) AS z FROM embeddings""",
    ),
    "river_day": (
        ("cell_day", "spine"),
        """SELECT s.cell, s.cell // 10 AS i, s.cell % 10 AS j, s.d,
           GREATEST(1e0, CAST(COALESCE(r.ext, 0) AS DOUBLE)/5e5 + CAST(s.cell % 7 AS DOUBLE)) AS m3s
           FROM spine s LEFT JOIN cell_day r ON r.cell = s.cell AND r.d = s.d""",
    ),
    "forecast": (
        ("cell_day",),
        """SELECT c.cell, DATE '2001-06-26' AS init, h.lead_h, ((c.cell*31 + h.lead_h*7) % 900)/1e1 AS m3s
           FROM (SELECT DISTINCT cell FROM cell_day) c, (SELECT UNNEST([24,48,72,96,120,144,168]) AS lead_h) h""",
    ),
    "run": (
        (),
        """SELECT o_orderkey AS run_id, o_orderpriority AS name, o_orderstatus AS layer,
           CAST(o_orderdate AS DATE) AS trained_at, o_totalprice AS score,
           CASE WHEN o_custkey % 5 = 0 THEN 'failed' ELSE 'complete' END AS status FROM orders""",
    ),
    "truth": (
        ("daily",),
        """SELECT cell AS fips, d,
           ROUND(GREATEST(0e0, LEAST(1e2, (dry/18e1 - 75e-2)*1e3)), 6) AS d1,
           ROUND(GREATEST(0e0, LEAST(1e2, (dry/18e1 - 78e-2)*1e3)), 6) AS d2,
           ROUND(GREATEST(0e0, LEAST(1e2, (dry/18e1 - 81e-2)*1e3)), 6) AS d3,
           ROUND(GREATEST(0e0, LEAST(1e2, (dry/18e1 - 84e-2)*1e3)), 6) AS d4
           FROM (SELECT cell, d, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY d) AS rn,
                 SUM(CASE WHEN COALESCE(precip, 0) = 0 THEN 1e0 ELSE 0e0 END)
                   OVER (PARTITION BY cell ORDER BY d ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS dry FROM daily)
           WHERE rn % 7 = 0 AND rn > 180""",
    ),
    "roll": (
        ("daily",),
        """SELECT *, ROW_NUMBER() OVER w AS rn, month(d)*31 + day(d) AS sk,
           """
        + ", ".join(
            f"CASE WHEN ROW_NUMBER() OVER w >= {n} THEN SUM(COALESCE(precip, 0)) OVER "
            f"(PARTITION BY cell ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS p{n}d"
            for n in (1, 3, 7, 14, 30, 90, 180, 365)
        )
        + " FROM daily WINDOW w AS (PARTITION BY cell ORDER BY d)",
    ),
    "rain": (
        ("roll",),
        "__SEASONAL__ roll cell p3d:s3 p30d:s30",
    ),
    "replay": (
        ("rain", "event_day"),
        """SELECT r.cell, r.d, CASE WHEN r.cell % 2 = 0 THEN 'us' ELSE 'canada' END AS domain,
           ROUND(7e-1*r.s3 + 3e-1*r.s30 + 1e-7, 2) AS p, r.s3 AS rule, e.cell IS NOT NULL AS event
           FROM rain r LEFT JOIN event_day e ON e.cell = r.cell AND e.d = r.d
           WHERE r.d > DATE '1998-12-31' AND r.s3 IS NOT NULL AND r.s30 IS NOT NULL""",
    ),
}


def seasonal_sql(src: str, cols: dict[str, str], key: str = "cell", missing: str = "NULL", keep: str = "a.*") -> str:
    """Season percentile by brute-force self join: every row against every same-season row of its key."""
    aggs = ", ".join(
        f"COUNT(b.{v}) AS n_{o}, SUM(CASE WHEN b.{v} <= a.{v} THEN 1 ELSE 0 END) AS k_{o}" for v, o in cols.items()
    )
    outs = ", ".join(
        f"CASE WHEN n_{o} < 30 THEN NULL WHEN a.{v} IS NULL THEN {missing} ELSE CAST(k_{o} AS DOUBLE)/n_{o} END AS {o}"
        for v, o in cols.items()
    )
    vals = ", ".join(f"a.{v}" for v in cols)
    return f"""SELECT {keep}, {outs} FROM {src} a JOIN (
        SELECT a.{key}, a.d, {aggs} FROM (SELECT {key}, d, {', '.join(cols)}, UNNEST(generate_series(sk-15, sk+15)) AS ok
        FROM {src}) a JOIN {src} b ON b.{key} = a.{key} AND b.sk = a.ok GROUP BY a.{key}, a.d) s
        ON s.{key} = a.{key} AND s.d = a.d -- {vals}
        """


def _body(name: str) -> str:
    text = VIEWS[name][1]
    if text.startswith("__SEASONAL__"):
        _, src, key, *pairs = text.split()
        text = seasonal_sql(src, dict(p.split(":") for p in pairs), key)
    return text


def with_views(names: str, query: str, *extra: tuple[str, str]) -> str:
    """``WITH`` the named views and their dependencies, then ``extra`` (name, body) pairs, then the query."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in VIEWS[n][0]:
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS MATERIALIZED ({_body(n)})" for n in ordered] + [
        f"{n} AS MATERIALIZED ({b})" for n, b in extra
    ]
    return (("WITH RECURSIVE " if any("UNION ALL SELECT /*rec*/" in b for _, b in extra) else "WITH ") + ",\n".join(parts) + "\n" + query) if parts else query
