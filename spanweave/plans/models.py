"""Queries over the trees and graphs that the provided tables hold: users and their phases, and customers, orders and lines.

Mappings, metadata and faults are derived from the numbers in paths, so that they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.session import stored
from ..operators import attribution as A
from ..operators import bottlenecks as B
from ..operators import graphs as G
from ..operators import hierarchy as H
from ..operators import intervals as I
from ..sources import views as V
from .catalog import _CURVE, _SHARES, WIDTH, C, query, r6, times


def user_path():
    return F.concat(F.lit("/user[id="), C("user_id").cast("string"), F.lit("]"))


SQL_USER = "'/user[id=' || user_id || ']'"


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phases with the number n in their path and their user's path."""
    return V.phases(spark, sf_dir).withColumns({"n": F.regexp_extract("path", r"n=(\d+)", 1).cast("long"), "user": user_path()})


SQL_N = f", numbered AS (SELECT *, regexp_extract(path, 'n=(\\d+)', 1)::BIGINT AS n, {SQL_USER} AS owner FROM phases)"


# Phases and resources


def _mapping(p: DataFrame) -> DataFrame:
    """Entries at three depths: the root, every third user, every fifth phase (every tenth twice, every fiftieth wrongly)."""
    own = p.filter("n % 5 = 0").select(C("path").alias("phase"), F.concat("user", F.lit(":click")).alias("resource"))
    more = p.filter("n % 10 = 0").select(C("path").alias("phase"), F.concat("user", F.lit(":view")).alias("resource"))
    wrong = p.filter("n % 50 = 0").select(C("path").alias("phase"), F.concat(F.lit("/user[id="), (C("user_id") + 1).cast("string"), F.lit("]:view")).alias("resource"))
    users = p.filter("user_id % 3 = 0").select(C("user").alias("phase"), C("user").alias("resource")).distinct()
    root = p.sparkSession.createDataFrame([("/", "/user[id=1]")], "phase string, resource string")
    return root.union(users).union(own).union(more).union(wrong)


SQL_MAPPING = f"""{SQL_N}, mapping AS (
  SELECT '/' AS phase, '/user[id=1]' AS resource, 1 AS user_id, NULL AS parent UNION ALL SELECT DISTINCT owner, owner, user_id, '/' FROM numbered WHERE user_id % 3 = 0
  UNION ALL SELECT path, unnest(CASE WHEN n % 50 = 0 THEN [owner || ':click', owner || ':view', '/user[id=' || (user_id + 1) || ']:view'] WHEN n % 10 = 0 THEN [owner || ':click', owner || ':view'] ELSE [owner || ':click'] END),
    user_id, CASE WHEN user_id % 3 = 0 THEN owner ELSE '/' END FROM numbered WHERE n % 5 = 0)"""


@query(
    SQL_MAPPING
    + """, nearest AS (SELECT path, CASE WHEN n % 5 = 0 THEN path WHEN user_id % 3 = 0 THEN owner ELSE '/' END AS place FROM numbered)
SELECT DISTINCT n.path AS phase, place AS mapped_at, m.path AS resource FROM nearest n JOIN mapping g ON g.phase = n.place JOIN (SELECT DISTINCT path FROM metrics) m ON m.path = g.resource OR starts_with(m.path, g.resource || ':')"""
)
def mapping_nearest(spark, sf_dir):
    """The metrics that each phase may use, by its nearest mapped ancestor."""
    p = _phases(spark, sf_dir)
    return H.mapped_resources(p.select(C("path").alias("phase")), _mapping(p), V.metrics(spark, sf_dir).select(C("path").alias("resource")))


@query(
    SQL_MAPPING
    + """ SELECT DISTINCT phase, resource, parent FROM mapping g WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mapping h WHERE h.phase = g.parent AND (g.resource = h.resource OR starts_with(g.resource, h.resource || ':') OR starts_with(g.resource, h.resource || '/')))"""
)
def mapping_violations(spark, sf_dir):
    """Entries that are not inside the next mapped ancestor's."""
    return H.mapping_violations(_mapping(_phases(spark, sf_dir)))


# Metadata


NAMES = ["device", "rack"]


def _metadata(p: DataFrame, m: DataFrame) -> DataFrame:
    """Values of users, of some of their phases and of some of their metrics; D0 to D2 are aliases."""
    user = p.select("user", "user_id").distinct()
    row = lambda path, name, *value: [path.alias("path"), F.lit(name).alias("name"), F.concat(*value).alias("value")]
    number = lambda c: c.cast("string")
    m = m.select("path", "user_id", "type").distinct()
    return (
        user.filter("user_id % 4 <> 0").select(*row(C("user"), "device", F.lit("d"), number(C("user_id") % 3)))
        .union(user.select(*row(C("user"), "rack", F.lit("r"), number(C("user_id") % 2))))
        .union(p.filter("type = '/user/view'").select(*row(C("path"), "device", F.lit("D"), number(C("n") % 3))))
        .union(m.filter("type = '/user:click' and user_id % 2 = 0").select(*row(C("path"), "device", F.lit("D"), number((C("user_id") + 1) % 3))))
        .union(m.filter("type = '/user:error'").select(*row(C("path"), "rack", F.lit("r"), number((C("user_id") + 1) % 2))))
    )


def _inherited(spark, sf_dir):
    p, m = _phases(spark, sf_dir), V.metrics(spark, sf_dir)
    aliases = spark.createDataFrame([(f"D{k}", f"d{k}") for k in range(3)], "alias string, canonical string")
    return H.inherited(p.select("path").union(m.select("path")), _metadata(p, m), NAMES, aliases), p, m


SQL_DEVICE_P = "CASE WHEN p.type = '/user/view' THEN 'd' || (regexp_extract(p.path, 'n=(\\d+)', 1)::BIGINT % 3) WHEN p.user_id % 4 <> 0 THEN 'd' || (p.user_id % 3) END"
SQL_DEVICE_M = "CASE WHEN m.path LIKE '%:click' AND m.user_id % 2 = 0 THEN 'd' || ((m.user_id + 1) % 3) WHEN m.user_id % 4 <> 0 THEN 'd' || (m.user_id % 3) END"
SQL_AGREE = f"coalesce({SQL_DEVICE_P} = {SQL_DEVICE_M}, true) AND NOT m.path LIKE '%:error'"


@query(
    f""" SELECT p.path, {SQL_DEVICE_P} AS device, 'r' || (p.user_id % 2) AS rack FROM phases p
UNION ALL SELECT DISTINCT m.path, {SQL_DEVICE_M}, 'r' || ((m.user_id + (m.path LIKE '%:error')::INT) % 2) FROM metrics m"""
)
def metadata_inherited(spark, sf_dir):
    """The nearest value of each name up the lineage, aliases made canonical."""
    found = _inherited(spark, sf_dir)[0]
    return found.select("path", F.get("mapped", F.lit(0)).alias("device"), F.get("mapped", F.lit(1)).alias("rack"))


_MAPPED_SQL = _CURVE.replace("m.s < p.e AND p.s < m.e JOIN rules", f"m.s < p.e AND p.s < m.e AND {SQL_AGREE} JOIN rules") + _SHARES.replace(
    "c.s < p.e AND p.s < c.e JOIN rules", "c.s < p.e AND p.s < c.e AND " + SQL_AGREE.replace("m.path", "c.metric").replace("m.user_id", "c.user_id") + " JOIN rules"
)


@query(_MAPPED_SQL + " SELECT metric, phase, round(s, 6) AS start_time, round(e, 6) AS end_time, round(usage, 6) AS usage, round(capacity, 6) AS capacity FROM leaves")
def attribute_mapped(spark, sf_dir):
    """Attribution only between phases and metrics whose inherited metadata agrees."""
    found, p, m = _inherited(spark, sf_dir)
    found = stored(found)
    m = stored(m.withColumn("metric", C("path")).join(found, "path"))
    p = stored(p.select("_start_time", "_end_time", "_duration", "path", "type", "user_id").withColumn("phase", C("path")).join(found, "path").drop("path"))
    out = A.attributed(m, p, V.rules(spark), ["user_id"], WIDTH, "mapped")
    return out.select("metric", "phase", *times(), r6("usage"), r6("capacity"))


# Blocked time

_BLOCKING = "type = '/user:error' AND usage > 100"

#: The type of blocked pieces of phases, which demand nothing.
BLOCKED = "blocked"


def _blocked(spark, sf_dir):
    """Phases that large errors of their user block (clicks and views), those that nothing blocks, the blocking intervals, and metrics."""
    m = V.metrics(spark, sf_dir).withColumn("metric", C("path"))
    p = V.phases(spark, sf_dir).withColumn("phase", C("path"))
    held = C("type").isin("/user/click", "/user/view")
    return p.filter(held), p.filter(~held), m.filter(_BLOCKING).select("user_id", "_start_time", "_end_time"), m


SQL_BLOCKED = f"""
, gone AS (SELECT user_id, s, e FROM metrics WHERE {_BLOCKING}),
marks0 AS (SELECT user_id, s AS t FROM gone UNION SELECT user_id, e FROM gone UNION SELECT user_id, s FROM phases0 UNION SELECT user_id, e FROM phases0),
cells0 AS (SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM marks0),
cells1 AS (SELECT c.*, EXISTS (SELECT 1 FROM gone g WHERE g.user_id = c.user_id AND g.s <= c.s AND g.e >= c.e) AS blocked FROM cells0 c WHERE e IS NOT NULL),
parts0 AS (SELECT p.path, p.type, p.user_id, c.s, c.e, c.blocked AND p.type IN ('/user/click', '/user/view') AS blocked FROM phases0 p JOIN cells1 c ON c.user_id = p.user_id AND p.s <= c.s AND p.e >= c.e),
runs0 AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(blocked) OVER w = blocked THEN 0 ELSE 1 END AS fresh FROM parts0 WINDOW w AS (PARTITION BY path ORDER BY s)),
pieces AS (SELECT path, any_value(type) AS type, any_value(user_id) AS user_id, min(s) AS s, max(e) AS e, max(e) - min(s) AS d, blocked FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY s) AS run FROM runs0) GROUP BY path, blocked, run),
phases AS (SELECT * FROM pieces WHERE NOT blocked)"""


def _sql_blocked(body: str) -> str:
    return f"WITH {V.SQL.replace('phases AS (', 'phases0 AS (')}{SQL_BLOCKED}{body}"


@query(_sql_blocked(" SELECT path, round(s, 6) AS start_time, round(e, 6) AS end_time, blocked FROM pieces"), views=False)
def phases_active(spark, sf_dir):
    """Phases in pieces, active and blocked."""
    held, free, blocking, _ = _blocked(spark, sf_dir)
    active = H.active_time(held, blocking, ["user_id"], ["path"], WIDTH).unionByName(free).withColumn("blocked", F.lit(False))
    blocked = H.blocked_time(held, blocking, ["user_id"], ["path"], WIDTH).withColumn("blocked", F.lit(True))
    blocked = I.coalesce_intervals(blocked, ["path"], ["blocked"], WIDTH)
    return active.select("path", *times(), "blocked").unionByName(blocked.select("path", *times(), "blocked"))


@query(
    _sql_blocked(
        _CURVE + _SHARES
        + """, idle AS (SELECT c.metric, p.path AS phase, greatest(c.s, p.s) AS s, least(c.e, p.e) AS e FROM up c JOIN pieces p ON p.user_id = c.user_id AND p.blocked AND c.s < p.e AND p.s < c.e)
SELECT metric, phase, round(s, 6) AS start_time, round(e, 6) AS end_time, CASE WHEN sampled >= 0.95 * most THEN 'GLOBAL' WHEN usage >= 0.95 * capacity THEN 'LOCAL' ELSE 'NONE' END AS status FROM leaves
UNION ALL SELECT metric, phase, round(s, 6), round(e, 6), 'NONE' FROM idle UNION ALL SELECT 'blocked', path, round(s, 6), round(e, 6), 'GLOBAL' FROM pieces WHERE blocked"""
    ),
    views=False,
)
def bottleneck_blocked(spark, sf_dir):
    """Statuses where phases may be blocked: a blocked phase demands nothing, is no bottleneck of what it would use, and one of what blocks it."""
    held, free, blocking, m = _blocked(spark, sf_dir)
    active = stored(H.active_time(held, blocking, ["user_id"], ["path"], WIDTH).unionByName(free).drop("path"))
    blocked = H.blocked_time(held, blocking, ["user_id"], ["path", "phase", "user_id"], WIDTH)
    blocked = stored(I.coalesce_intervals(blocked, ["path", "phase", "user_id"], [], WIDTH))
    idle = blocked.select("_start_time", "_end_time", "_duration", "phase", F.lit(BLOCKED).alias("type"), "user_id")
    rules = V.rules(spark).unionByName(spark.createDataFrame([(BLOCKED, "none", 0.0)], "type string, rule string, demand double"))
    met = A.attributed(m, active, rules, ["user_id"], WIDTH, idle=idle)
    columns = lambda df, metric, status: df.select(metric.alias("metric"), "phase", *times(), status.alias("status"))
    found = columns(met, C("metric"), F.when(C("type") == BLOCKED, B.NONE).otherwise(B.status(C("usage"), C("capacity"), C("sampled"), C("most"))))
    return found.unionByName(columns(blocked, F.lit("blocked"), F.lit(B.GLOBAL)))


@query(
    _sql_blocked(
        f""", up_of AS (SELECT unnest(['/', {SQL_USER}]) AS path, s, e FROM pieces WHERE blocked),
reach AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM up_of),
runs AS (SELECT *, sum(CASE WHEN r >= s THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM reach)
SELECT path, round(min(s), 6) AS start_time, round(max(e), 6) AS end_time FROM runs GROUP BY path, run"""
    ),
    views=False,
)
def blocked_ancestors(spark, sf_dir):
    """When users, and the root, have a blocked phase."""
    held, _, blocking, _ = _blocked(spark, sf_dir)
    return H.blocked_above(H.blocked_time(held, blocking, ["user_id"], ["path"], WIDTH), WIDTH).select("path", *times())


# Folds

#: Days in a bucket.
DAYS = 64.0


def _line_statuses(spark, sf_dir):
    q = C("quantity")
    status = F.when(q >= 40, B.GLOBAL).when(q >= 25, B.LOCAL).otherwise(B.NONE)
    return V.shipments(spark, sf_dir).withColumn("status", status)


def _sql_fold(rules: list[str]) -> str:
    """Day by day, from the lines up; rules by depth of the parent, the root first."""
    holds = {"any": "hits > 0", "all": "hits = n", "majority": "hits > 0 AND 2 * hits >= n"}
    out = """
WITH o AS (SELECT *, epoch_us(o_orderdate) / 86400e6 AS d0 FROM orders), least AS (SELECT min(d0) AS d FROM o),
lines AS (SELECT (d0 - d)::BIGINT AS s, (epoch_us(l_shipdate) / 86400e6 - d)::BIGINT AS e, '/' || r_name || '/' || n_name || '/' || c_custkey || '/' || o_orderkey || '/' || l_linenumber AS path, CASE WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS sev
FROM o, least, lineitem, customer, nation, region WHERE o_orderkey = l_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_shipdate > o_orderdate),
f5 AS (SELECT path, unnest(range(s, e)) AS day, sev FROM lines)"""
    for level in range(4, -1, -1):
        parent = "CASE WHEN regexp_matches(path, '^/[^/]*$') THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END"
        out += f""",
f{level} AS (SELECT path, day, CASE WHEN {holds[rules[level]]} THEN worst ELSE 0 END AS sev FROM (SELECT {parent} AS path, day, count(*) AS n, count(*) FILTER (sev > 0) AS hits, max(sev) AS worst FROM f{level + 1} GROUP BY ALL))"""
    return out + """, every AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4),
runs AS (SELECT *, day - row_number() OVER (PARTITION BY path, sev ORDER BY day) AS run FROM every)
SELECT path, min(day)::DOUBLE AS start_time, max(day)::DOUBLE + 1 AS end_time, CASE sev WHEN 2 THEN 'GLOBAL' WHEN 1 THEN 'LOCAL' ELSE 'NONE' END AS status FROM runs GROUP BY path, sev, run"""


@query(_sql_fold(["majority"] * 5), views=False)
def fold_majority(spark, sf_dir):
    """Majorities of majorities: from order lines to orders, customers, nations, regions and the root."""
    return H.fold_statuses(_line_statuses(spark, sf_dir), [], H.Predicate("majority"), bucket=DAYS).select("path", *times(), "status")


@query(_sql_fold(["any", "all", "majority", "any", "all"]), views=False)
def fold_per_parent(spark, sf_dir):
    """A predicate for each kind of parent: here by its depth."""
    depth = lambda path: P.depth_of(path).cast("string")
    rules = {"0": H.Predicate("any"), "1": H.Predicate("all"), "3": H.Predicate("any"), "4": H.Predicate("all")}
    return H.fold_statuses(_line_statuses(spark, sf_dir), [], H.Predicate("majority"), rules, DAYS, depth).select("path", *times(), "status")


# Best fit


def fit_overrides(p: DataFrame) -> DataFrame:
    """Exact, variable and no demand for three in seven phases."""
    n = F.regexp_extract("phase", r"n=(\d+)", 1).cast("long") % 7
    rule = F.when(n == 0, "exact").when(n == 1, "variable").when(n == 2, "none")
    return p.select("phase", rule.alias("rule"), F.when(n == 0, 2.0).when(n == 1, 3.0).otherwise(0.0).alias("demand")).filter("rule IS NOT NULL")


@query()
def best_fit_overrides(spark, sf_dir):
    """Rules for each metric type fitted beside overriding ones: an active-set solver, so no SQL."""
    m = V.metrics(spark, sf_dir).withColumn("metric", C("path")).withColumn("kind", C("type"))
    p = V.phases(spark, sf_dir).withColumn("phase", C("path"))
    return A.best_fit(m, p, ["user_id"], "kind", fit_overrides(p), WIDTH).select("kind", "type", "phase", "rule", r6("demand"))


# Graphs


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Order lines (group: the customer, order, type, duration in days) and the orders' dependencies (group, after, node)."""
    s = V.shipments(spark, sf_dir)
    order = P.parent_of(C("path"))
    lines = stored(s.select(P.parent_of(order).alias("group"), order.alias("order"), F.when(C("quantity") >= 25, "bulk").otherwise("small").alias("type"), C("_duration").alias("duration"), "_start_time", "_end_time"))
    spans = lines.groupBy("group", C("order").alias("node")).agg(F.min("_start_time").alias("start"), F.max("_end_time").alias("end"))
    return lines, stored(G.direct_predecessors(spans, width=DAYS))


SQL_ORDERS = """
, least AS (SELECT min(epoch_us(o_orderdate) / 86400e6) AS d FROM orders),
lines AS (SELECT epoch_us(o_orderdate) / 86400e6 - d AS s, epoch_us(l_shipdate) / 86400e6 - d AS e, '/' || r_name || '/' || n_name || '/' || c_custkey AS grp, '/' || r_name || '/' || n_name || '/' || c_custkey || '/' || o_orderkey AS o, '/' || r_name || '/' || n_name || '/' || c_custkey || '/' || o_orderkey || '/' || l_linenumber AS node, CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'small' END AS type
FROM orders, least, lineitem, customer, nation, region WHERE o_orderkey = l_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_shipdate > o_orderdate),
spans AS (SELECT grp, o, min(s) AS s, max(e) AS e FROM lines GROUP BY grp, o),
deps AS (SELECT a.grp, a.o AS after, b.o AS node FROM spans a JOIN spans b ON a.grp = b.grp AND a.e <= b.s WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.grp = a.grp AND a.e <= c.s AND c.e <= b.s))
"""


@query("WITH ev AS (SELECT 1)" + SQL_ORDERS + "SELECT grp AS customer, after, node AS \"order\" FROM deps", views=False)
def order_dependencies(spark, sf_dir):
    """An order waits for those that were shipped before it was placed, but for those that another such order waits for."""
    return _orders(spark, sf_dir)[1].select(C("group").alias("customer"), "after", C("node").alias("order"))


@query(
    "WITH RECURSIVE ev AS (SELECT 1)" + SQL_ORDERS
    + """, r(k, grp, node, f) AS (SELECT 0, grp, o, e - s FROM spans UNION ALL
  SELECT k + 1, d.grp, d.node, max(f) + any_value(p.e - p.s) FROM r JOIN deps d ON d.grp = r.grp AND d.after = r.node JOIN spans p ON p.grp = d.grp AND p.o = d.node GROUP BY k, d.grp, d.node)
SELECT grp AS customer, node AS "order", round(max(f), 6) AS finish FROM r GROUP BY grp, node""",
    views=False,
)
def critical_paths(spark, sf_dir):
    """When each order is done if orders start as those they wait for end: longest paths by doubling."""
    lines, edges = _orders(spark, sf_dir)
    spans = lines.groupBy("group", C("order").alias("node")).agg((F.max("_end_time") - F.min("_start_time")).alias("duration"))
    return G.longest_paths(spans, edges).select(C("group").alias("customer"), C("node").alias("order"), r6("finish"))


@query(
    "WITH RECURSIVE ev AS (SELECT 1)" + SQL_ORDERS
    + """, classes AS (SELECT grp, o, type, count(*) AS n, avg(e - s) AS mean FROM lines GROUP BY ALL),
cases AS (SELECT grp, type AS kind, sum(n) AS n FROM classes WHERE n > 1 GROUP BY ALL), every AS (SELECT grp, kind FROM cases UNION SELECT grp, '-' FROM cases),
work AS (SELECT l.grp, l.o, kind, max(CASE WHEN l.type = kind THEN c.mean ELSE l.e - l.s END) AS d FROM lines l JOIN classes c ON c.grp = l.grp AND c.o = l.o AND c.type = l.type JOIN every v ON v.grp = l.grp GROUP BY ALL),
r(k, grp, kind, o, f) AS (SELECT 0, grp, kind, o, d FROM work UNION ALL SELECT k + 1, w.grp, w.kind, w.o, max(f) + any_value(w.d) FROM r JOIN deps p ON p.grp = r.grp AND p.after = r.o JOIN work w ON w.grp = r.grp AND w.o = p.node AND w.kind = r.kind GROUP BY k, w.grp, w.kind, w.o),
spans2 AS (SELECT grp, kind, max(f) AS f FROM r GROUP BY ALL)
SELECT c.grp AS customer, c.kind AS type, c.n::DOUBLE AS n, round(m.f, 6) AS measured, round(b.f, 6) AS balanced, round(m.f - b.f, 6) + 0.0 AS impact FROM cases c JOIN spans2 b USING (grp, kind) JOIN spans2 m ON m.grp = c.grp AND m.kind = '-'""",
    views=False,
)
def imbalance_siblings(spark, sf_dir):
    """What balance among interchangeable lines would save a customer: those of one type in one order, as they wait for the same lines."""
    lines, edges = _orders(spark, sf_dir)
    out = G.imbalance_impact(lines, edges, "order", "order")
    return out.select(C("group").alias("customer"), "type", C("n").cast("double").alias("n"), r6("measured"), r6("balanced"), (F.round("impact", 6) + F.lit(0.0)).alias("impact"))


# Validation


def _records(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of users and phases, and edges from each phase to the next, with planted faults."""
    row = lambda df, path, s="_start_time", e="_end_time": df.select(path.alias("path"), C(s).alias("start"), C(e).alias("end"))
    users = p.groupBy("user", "user_id").agg(F.min("_start_time").alias("_start_time"), F.max("_end_time").alias("_end_time"))
    root = p.agg(F.min("_start_time").alias("_start_time"), F.max("_end_time").alias("_end_time")).filter("_start_time IS NOT NULL")
    back = p.filter("n % 101 = 0")
    phases = row(root, F.lit("/")).union(row(users.filter("user_id % 10 <> 3"), C("user"))).union(row(p.filter("n % 101 <> 0"), C("path"))).union(row(p.filter("n % 97 = 0"), C("path"))).union(row(back, C("path"), "_end_time", "_start_time"))
    ahead = p.withColumn("next", F.lead(F.struct("path", "n")).over(Window.partitionBy("user_id").orderBy("_start_time"))).filter("next IS NOT NULL")
    on = ahead.filter("n % 4 <> 0").select(C("path").alias("after"), C("next.path").alias("path"))
    round_ = ahead.filter("n % 50 = 1").select(C("next.path").alias("after"), C("path"))
    unknown = p.filter("n % 211 = 0").select(C("path").alias("after"), F.concat("path", F.lit("x")).alias("path"))
    apart = p.filter("n % 307 = 0").select(C("user").alias("after"), "path")
    return phases, on.union(round_).union(unknown).union(apart)


@query(
    SQL_N
    + """, ahead AS (SELECT *, lead(path) OVER (PARTITION BY user_id ORDER BY s) AS next FROM numbered)
SELECT 'parent' AS rule, path, owner AS other FROM numbered WHERE user_id % 10 = 3
UNION ALL SELECT 'repeated', path, NULL FROM numbered WHERE n % 97 = 0 UNION ALL SELECT 'time', path, NULL FROM numbered WHERE n % 101 = 0
UNION ALL SELECT 'unknown', path || 'x', path FROM numbered WHERE n % 211 = 0 UNION ALL SELECT 'parents', path, owner FROM numbered WHERE n % 307 = 0
UNION ALL SELECT 'unknown', owner, path FROM numbered WHERE n % 307 = 0 AND user_id % 10 = 3
UNION ALL (SELECT 'circle', path, NULL FROM ahead WHERE n % 50 = 1 AND next IS NOT NULL UNION SELECT 'circle', next, NULL FROM ahead WHERE n % 50 = 1 AND next IS NOT NULL)"""
)
def model_violations(spark, sf_dir):
    """What keeps records from being one model."""
    return G.model_violations(*_records(_phases(spark, sf_dir)))


# Paths


@query(
    f"""{SQL_N}, made AS (SELECT owner || '/./' || n || '/../' || n || '//x/.' AS a, 'u/../../' || n || '/..' AS b, '/..' || path AS c, owner, n, path FROM numbered)
SELECT path, owner || '/' || n || '/x' AS a, '..' AS b, NULL::VARCHAR AS c, owner || '/../' || n AS resolved, n % 2 = 0 AS inside FROM made"""
)
def path_canonical(spark, sf_dir):
    """Canonical forms (one leads out of the root), a path resolved against another, and containment."""
    p = _phases(spark, sf_dir)
    n = C("n").cast("string")
    a = F.concat("user", F.lit("/./"), n, F.lit("/../"), n, F.lit("//x/."))
    b, out = F.concat(F.lit("u/../../"), n, F.lit("/..")), F.concat(F.lit("/.."), "path")
    other = F.when(C("n") % 2 == 0, C("path")).otherwise(F.concat("user", F.lit("/../x")))
    return p.select("path", P.canonical(a).alias("a"), P.canonical(b).alias("b"), P.canonical(out).alias("c"), P.resolve(C("user"), F.concat(F.lit("../"), n)).alias("resolved"), P.contains(F.concat("user", F.lit("/.")), other).alias("inside"))


PATTERNS = ["/user[id=1*]/click", "/user/purchase[n=*7]/../view", "/user/**", "/**/.."]


@query(
    SQL_N
    + """ SELECT '/user[id=1*]/click' AS pattern, path FROM numbered WHERE type = '/user/click' AND starts_with(user_id::VARCHAR, '1')
UNION ALL SELECT '/user/purchase[n=*7]/../view', path FROM numbered v WHERE type = '/user/view' AND EXISTS (SELECT 1 FROM numbered w WHERE w.user_id = v.user_id AND w.type = '/user/purchase' AND w.n % 10 = 7)
UNION ALL SELECT '/user/**', path FROM numbered UNION ALL SELECT DISTINCT '/**/..', owner FROM numbered UNION ALL SELECT DISTINCT '/**/..', '/' FROM numbered"""
)
def path_patterns(spark, sf_dir):
    """Nodes that patterns find."""
    p = _phases(spark, sf_dir)
    nodes = p.select("path").union(p.select("user").distinct())
    found = [H.find(nodes, x).select(F.lit(x).alias("pattern"), "path") for x in PATTERNS]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


@query(f" SELECT DISTINCT {SQL_USER} AS resource, split_part(path, ':', 2) AS metric FROM metrics WHERE starts_with(user_id::VARCHAR, '2') AND split_part(path, ':', 2) LIKE '%e%'")
def metric_patterns(spark, sf_dir):
    """Metrics that a pattern with a metric's name finds."""
    m = V.metrics(spark, sf_dir).select(user_path().alias("resource"), F.element_at(F.split("path", ":"), -1).alias("metric"))
    return H.find_metrics(m, "/user[id=2*]:*e*", m.select(C("resource").alias("path")).distinct())


# Series


@query(
    f""", spans AS (SELECT user_id, min(s) AS s, max(e) AS e FROM metrics GROUP BY user_id), clicks AS (SELECT user_id, s, e, usage FROM metrics WHERE type = '/user:click'),
marks AS (SELECT user_id, s AS t FROM clicks UNION SELECT user_id, e FROM clicks UNION SELECT user_id, s FROM spans UNION SELECT user_id, e FROM spans),
steps AS (SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM marks)
SELECT t.user_id, round(t.s, 6) AS start_time, round(t.e, 6) AS end_time, round(coalesce(c.usage, 0), 6) AS usage FROM steps t LEFT JOIN clicks c ON c.user_id = t.user_id AND c.s <= t.s AND c.e >= t.e WHERE t.e IS NOT NULL"""
)
def series_padded(spark, sf_dir):
    """A series over a longer time: zero where it has no sample."""
    m = V.metrics(spark, sf_dir)
    spans = m.groupBy("user_id").agg(F.min("_start_time").alias("_start_time"), F.max("_end_time").alias("_end_time"))
    return I.covered_from(m.filter("type = '/user:click'"), ["user_id"], "usage", spans, WIDTH).select("user_id", *times(), r6("usage"))
