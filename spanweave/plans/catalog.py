"""All queries over the provided tables, by name, each with its SQL where SQL can express it.

Numbers are rounded to six digits and counts are doubles, as results are compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import paths as P
from ..functions.session import cut, stored
from ..operators import attribution as A
from ..operators import bottlenecks as B
from ..operators import intervals as I
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Buckets of time in seconds: about as long as a sample of a metric lasts.
WIDTH = 172800.0


def C(name):  # noqa: N802
    return F.col(name)


def query(sql: str | None = None, views: bool = True):
    """Register a query; its SQL sees the views ev, metrics, phases (s, e, d for the reserved columns) and rules."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {V.SQL}{sql if sql.lstrip().startswith(',') else sql}" if views else sql
        return f

    return register


def r6(value, name: str | None = None):
    out = F.round(value if not isinstance(value, str) else C(value), 6)
    return out.alias(name or value)


def times() -> list:
    return [r6("_start_time", "start_time"), r6("_end_time", "end_time")]


SQL_TIMES = "round(s, 6) AS start_time, round(e, 6) AS end_time"


# Scans, projections, filters, order


@query(f"SELECT {SQL_TIMES}, round(d, 6) AS duration, round(utilization, 6) AS utilization, round(usage, 6) AS usage, round(capacity, 6) AS capacity, path, type FROM metrics")
def scan_metrics(spark, sf_dir):
    return V.metrics(spark, sf_dir).select(*times(), r6("_duration", "duration"), r6("utilization"), r6("usage"), r6("capacity"), "path", "type")


@query(f"SELECT {SQL_TIMES}, round(d, 6) AS duration, path, type FROM phases")
def scan_phases(spark, sf_dir):
    return V.phases(spark, sf_dir).select(*times(), r6("_duration", "duration"), "path", "type")


@query(
    """
WITH o AS (SELECT *, epoch_us(o_orderdate) / 86400e6 AS d0 FROM orders), least AS (SELECT min(d0) AS d FROM o)
SELECT round(d0 - d, 6) AS start_time, round(epoch_us(l_shipdate) / 86400e6 - d, 6) AS end_time, '/' || r_name || '/' || n_name || '/' || c_custkey || '/' || o_orderkey || '/' || l_linenumber AS path, round(l_quantity, 6) AS quantity
FROM o, least, lineitem, customer, nation, region
WHERE o_orderkey = l_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_shipdate > o_orderdate""",
    views=False,
)
def scan_shipments(spark, sf_dir):
    return V.shipments(spark, sf_dir).select(*times(), "path", r6("quantity"))


@query("SELECT path, round(s, 6) AS start_time, round(usage * 2 - capacity + 1, 6) AS a, round(usage / (capacity + 1), 6) AS b FROM metrics")
def project_arith(spark, sf_dir):
    m = V.metrics(spark, sf_dir)
    return m.select("path", times()[0], r6(C("usage") * 2 - C("capacity") + 1, "a"), r6(N.divide(C("usage"), C("capacity") + 1), "b"))


@query("SELECT path, round(s, 6) AS start_time, round((usage + capacity) * 2, 6) AS sum_first, round(usage + capacity * 2, 6) AS product_first FROM metrics")
def project_precedence(spark, sf_dir):
    """In the reference's language + and - bind tighter than * and /; both readings, spelled out."""
    m = V.metrics(spark, sf_dir)
    return m.select("path", times()[0], r6((C("usage") + C("capacity")) * 2, "sum_first"), r6(C("usage") + C("capacity") * 2, "product_first"))


@query(
    """
SELECT path, round(s, 6) AS start_time, CASE WHEN capacity = usage THEN (CASE WHEN usage = 0 THEN 'nan' WHEN usage > 0 THEN 'inf' ELSE '-inf' END) ELSE 'finite' END AS kind,
  CASE WHEN capacity <> usage THEN round(usage / (capacity - usage), 6) END AS quotient FROM metrics"""
)
def safe_divide(spark, sf_dir):
    q = N.divide(C("usage"), C("capacity") - C("usage"))
    kind = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").otherwise("finite")
    return V.metrics(spark, sf_dir).select("path", times()[0], kind.alias("kind"), F.when(kind == "finite", F.round(q, 6)).alias("quotient"))


@query("SELECT path, round(s, 6) AS start_time, round(usage, 6) AS usage FROM metrics WHERE usage > 50 AND utilization <= 0.9")
def filter_numeric(spark, sf_dir):
    return V.metrics(spark, sf_dir).filter(N.greater(C("usage"), F.lit(50.0)) & N.at_least(F.lit(0.9), C("utilization"))).select("path", times()[0], r6("usage"))


@query("SELECT path, round(s, 6) AS start_time FROM metrics WHERE NOT (usage > 10 AND type = '/user:click') AND (utilization = 1.0 OR d > 3600)")
def filter_bool_logic(spark, sf_dir):
    keep = ~((C("usage") > 10) & (C("type") == "/user:click")) & (N.equal(C("utilization"), F.lit(1.0)) | (C("_duration") > 3600))
    return V.metrics(spark, sf_dir).filter(keep).select("path", times()[0])


@query(r"SELECT path, round(s, 6) AS start_time FROM phases WHERE regexp_full_match(path, '/user\[id=1[^/]*\]/.*')")
def filter_glob_eq(spark, sf_dir):
    return V.phases(spark, sf_dir).filter(P.matches(C("path"), "/user[id=1*]/**")).select("path", times()[0])


@query(r"SELECT path, round(s, 6) AS start_time FROM phases WHERE NOT regexp_full_match(path, '/[^/]*/c[^/]*')")
def filter_glob_neq(spark, sf_dir):
    return V.phases(spark, sf_dir).filter(~P.matches(C("path"), "/*/c*")).select("path", times()[0])


@query("SELECT type, path, round(s, 6) AS start_time, row_number() OVER (ORDER BY type, usage DESC, path, s)::DOUBLE AS place FROM metrics WHERE usage > 100")
def sort_asc_desc(spark, sf_dir):
    """A total order over the rows that are left; the place is taken by range, so no task sees all rows."""
    rows = V.metrics(spark, sf_dir).filter("usage > 100")
    return numbered(rows, [C("type"), C("usage").desc(), C("path"), C("_start_time")]).select("type", "path", times()[0], C("place").cast("double").alias("place"))


@query("SELECT path, round(s, 6) AS start_time, round(usage, 6) AS usage FROM metrics ORDER BY usage DESC, path, s LIMIT 20")
def sort_limit(spark, sf_dir):
    return V.metrics(spark, sf_dir).orderBy(C("usage").desc(), "path", "_start_time").limit(20).select("path", times()[0], r6("usage"))


@query("SELECT path, round(s, 6) AS start_time, round(usage, 6) AS usage FROM metrics ORDER BY usage, path DESC, s DESC LIMIT 20")
def limit_last(spark, sf_dir):
    """The last rows of an order: the first of its reverse."""
    return V.metrics(spark, sf_dir).orderBy("usage", C("path").desc(), C("_start_time").desc()).limit(20).select("path", times()[0], r6("usage"))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """df with place, counting from 1 in a total order: ranges are counted, then numbered inside."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - C("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn("place", C("_start") + C("_inside")).drop("_range", "_inside", "_start")


# Aggregates


@query("SELECT count(*)::DOUBLE AS n, round(sum(usage), 6) AS total, round(min(s), 6) AS start_time, round(max(e), 6) AS end_time FROM metrics HAVING count(*) > 0")
def agg_global(spark, sf_dir):
    """One row, none for an empty input; the aggregate's interval spans all rows."""
    m = V.metrics(spark, sf_dir)
    return m.agg(N.count().alias("n"), r6(F.sum("usage"), "total"), r6(F.min("_start_time"), "start_time"), r6(F.max("_end_time"), "end_time")).filter("n > 0")


def _by_type(aggregate, source=V.metrics):
    return lambda spark, sf_dir: source(spark, sf_dir).groupBy("type").agg(aggregate())


def _aggregate(name: str, aggregate, sql: str, source: str = "metrics") -> None:
    f = _by_type(aggregate, getattr(V, source))
    f.__name__ = name
    query(f"SELECT type, {sql} FROM {source} GROUP BY type")(f)


_aggregate("agg_count", lambda: N.count().alias("n"), "count(*)::DOUBLE AS n")
_aggregate("agg_count_if", lambda: N.count_if(C("usage") > 50).alias("n"), "(count(*) FILTER (usage > 50))::DOUBLE AS n")
_aggregate("agg_min", lambda: r6(N.minimum(C("usage")), "least"), "round(min(usage), 6) AS least")
_aggregate("agg_max", lambda: r6(F.max("usage"), "most"), "round(max(usage), 6) AS most")
_aggregate("agg_min_string", lambda: F.min("path").alias("least"), "min(path) AS least")
_aggregate("agg_max_bool", lambda: F.max(C("usage") > 300).alias("any_large"), "bool_or(usage > 300) AS any_large")
_aggregate("agg_sum", lambda: r6(F.sum("usage"), "total"), "round(sum(usage), 6) AS total")
_aggregate("agg_avg", lambda: r6(F.avg("usage"), "mean"), "round(avg(usage), 6) AS mean")
_aggregate("agg_weighted_avg", lambda: r6(N.weighted_avg(C("usage"), C("capacity")), "mean"), "round(sum(usage * capacity) / sum(capacity), 6) AS mean")
_aggregate("agg_avg_over_time", lambda: r6(N.avg_over_time(C("usage")), "avg_usage"), "round(sum(usage * (e - s)) / sum(e - s), 6) AS avg_usage")
_aggregate("agg_first_row", lambda: r6(N.first_row(C("usage"), "_start_time", "path"), "first_usage"), "round(arg_min(usage, (s, path)), 6) AS first_usage")
_aggregate(
    "agg_find_or_default",
    lambda: r6(N.find_or_default(C("usage") > 200, C("usage"), -C("usage"), "_start_time", "path"), "found"),
    "round(coalesce(arg_min(usage, (s, path)) FILTER (usage > 200), arg_min(-usage, (s, path))), 6) AS found",
)


# Scalar functions


@query("SELECT path, round(s, 6) AS start_time, round(least(usage, capacity / 2, 40), 6) AS least, usage > 10 AND utilization > 0.5 AS both FROM metrics")
def fn_min_of(spark, sf_dir):
    return V.metrics(spark, sf_dir).select("path", times()[0], r6(N.min_of(C("usage"), C("capacity") / 2, F.lit(40.0)), "least"), N.all_of(C("usage") > 10, C("utilization") > 0.5).alias("both"))


@query("SELECT path, round(s, 6) AS start_time, round(greatest(usage, capacity / 2, 40), 6) AS most, usage > 10 OR utilization > 0.5 AS either FROM metrics")
def fn_max_of(spark, sf_dir):
    return V.metrics(spark, sf_dir).select("path", times()[0], r6(N.max_of(C("usage"), C("capacity") / 2, F.lit(40.0)), "most"), N.any_of(C("usage") > 10, C("utilization") > 0.5).alias("either"))


@query("SELECT type, sum((usage > 50)::INT)::DOUBLE AS n FROM metrics GROUP BY type")
def fn_as_numeric(spark, sf_dir):
    return V.metrics(spark, sf_dir).groupBy("type").agg(F.sum(N.as_numeric(C("usage") > 50)).alias("n"))


def _path_function(name: str, column, sql: str) -> None:
    def f(spark, sf_dir):
        return V.phases(spark, sf_dir).select("path", column())

    f.__name__ = name
    query(f"SELECT path, {sql} FROM phases")(f)


_path_function("fn_is_parent_of", lambda: P.is_parent_of(F.lit("/user[id=1]"), C("path")).alias("found"), r"regexp_full_match(path, '/user\[id=1\][/:][^/:]+') AS found")
_path_function("fn_is_child_of", lambda: P.is_child_of(C("path"), F.regexp_extract("path", r"^(/user\[id=\d+\])", 1)).alias("found"), r"regexp_full_match(path, '/user\[id=\d+\][/:][^/:]+') AS found")
_path_function("fn_is_ancestor_of", lambda: P.is_ancestor_of(F.lit("/user[id=2]"), C("path")).alias("found"), r"regexp_full_match(path, '/user\[id=2\][/:].+') AS found")
_path_function("fn_is_descendant_of", lambda: P.is_descendant_of(C("path"), F.lit("/")).alias("found"), "starts_with(path, '/') AND length(path) > 1 AS found")
_path_function("fn_parent_of", lambda: P.parent_of(C("path")).alias("parent"), "regexp_extract(path, '^(.+)[/:][^/:]*$', 1) AS parent")
_path_function("fn_path_prefix", lambda: F.concat_ws("|", P.path_prefix(C("path"), 1), P.path_prefix(C("path"), -1), P.path_prefix(C("path"), 0), P.path_prefix(C("path"), 5)).alias("parts"), "'/' || split_part(path, '/', 2) || '|/' || split_part(path, '/', 2) || '|/|' || path AS parts")
_path_function("fn_path_suffix", lambda: F.concat_ws("|", P.path_suffix(C("path"), 1), P.path_suffix(C("path"), -1), P.path_suffix(C("path"), 0), P.path_suffix(C("path"), 5)).alias("parts"), "split_part(path, '/', 3) || '|' || split_part(path, '/', 3) || '||' || path AS parts")


# Temporal joins

_JOINED = "round(greatest(m.s, p.s), 6) AS start_time, round(least(m.e, p.e), 6) AS end_time, round(least(m.e, p.e) - greatest(m.s, p.s), 6) AS duration"


def times3() -> list:
    return [*times(), r6("_duration", "duration")]


@query(f"SELECT {_JOINED}, m.path AS m_path, p.path AS p_path FROM metrics m, metrics p WHERE m.usage > 150 AND p.usage > 150 AND m.type = '/user:click' AND p.type = '/user:view' AND m.s < p.e AND p.s < m.e")
def tjoin_cross(spark, sf_dir):
    """No column to agree in: rows meet in buckets of time."""
    m = V.metrics(spark, sf_dir).filter("usage > 150")
    return I.overlap_join(m.filter("type = '/user:click'"), m.filter("type = '/user:view'"), ("m", "p"), bucket=86400.0).select(*times3(), "m_path", "p_path")


@query(f"SELECT {_JOINED}, m.path AS m_path, p.path AS p_path, round(m.usage, 6) AS usage FROM metrics m JOIN phases p ON m.user_id = p.user_id AND m.s < p.e AND p.s < m.e")
def tjoin_equi(spark, sf_dir):
    return I.overlap_join(V.metrics(spark, sf_dir), V.phases(spark, sf_dir), ("m", "p"), [("user_id", "user_id")], WIDTH).select(*times3(), "m_path", "p_path", r6("m_usage", "usage"))


@query(f"SELECT {_JOINED}, m.path AS m_path, p.path AS p_path FROM metrics m JOIN phases p ON split_part(m.path, ':', 1) = regexp_extract(p.path, '^(.+)[/:][^/:]*$', 1) AND m.s < p.e AND p.s < m.e")
def tjoin_computed_key(spark, sf_dir):
    m = V.metrics(spark, sf_dir).withColumn("owner", P.parent_of(C("path")))
    p = V.phases(spark, sf_dir).withColumn("owner", P.parent_of(C("path")))
    return I.overlap_join(m, p, ("m", "p"), [("owner", "owner")], WIDTH).select(*times3(), "m_path", "p_path")


@query(
    """
SELECT round(greatest(a.s, b.s, p.s), 6) AS start_time, round(least(a.e, b.e, p.e), 6) AS end_time, a.path AS a_path, b.path AS b_path, p.path AS p_path
FROM metrics a JOIN metrics b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e JOIN phases p ON p.user_id = a.user_id AND greatest(a.s, b.s) < p.e AND p.s < least(a.e, b.e)
WHERE a.type = '/user:click' AND b.type = '/user:error' AND p.type = '/user/view'"""
)
def tjoin_three_way(spark, sf_dir):
    m, p = V.metrics(spark, sf_dir), V.phases(spark, sf_dir).filter("type = '/user/view'")
    two = I.overlap_join(m.filter("type = '/user:click'"), m.filter("type = '/user:error'"), ("a", "b"), [("user_id", "user_id")], WIDTH)
    three = I.overlap_join(two, p, ("j", "p"), [("a_user_id", "user_id")], WIDTH)
    return three.select(*times(), C("j_a_path").alias("a_path"), C("j_b_path").alias("b_path"), "p_path")


# Temporal aggregates and merging


def _sweep(keys: str, source: str, values: str) -> str:
    """SQL for aggregates over elementary slices, merged where neighbours agree. values: name = aggregate; ..."""
    names = [v.split("=")[0].strip() for v in values.split(";")]
    aggs = ", ".join(f"{v.split('=', 1)[1]} AS {n}" for n, v in zip(names, values.split(";")))
    k, on = (f"{keys}, ", f"JOIN src r USING ({keys})") if keys else ("", "CROSS JOIN src r")
    part = f"PARTITION BY {keys} " if keys else ""
    same = " AND ".join([f"lag(e) OVER (w) = s", *[f"lag({n}) OVER (w) IS NOT DISTINCT FROM {n}" for n in names]]).replace("OVER (w)", f"OVER ({part}ORDER BY s)")
    return f""", src AS ({source}), pts AS (SELECT {k}s AS t FROM src UNION SELECT {k}e FROM src),
cuts AS (SELECT {k}t AS s, lead(t) OVER ({part}ORDER BY t) AS e FROM pts),
agg AS (SELECT {k}c.s, c.e, {aggs} FROM (SELECT * FROM cuts WHERE e IS NOT NULL) c {on.replace('r USING', 'r USING') } WHERE r.s <= c.s AND r.e >= c.e GROUP BY {k}c.s, c.e),
runs AS (SELECT *, CASE WHEN {same} THEN 0 ELSE 1 END AS fresh FROM agg),
numbered AS (SELECT *, sum(fresh) OVER ({part}ORDER BY s) AS run FROM runs)
SELECT {k}round(min(s), 6) AS start_time, round(max(e), 6) AS end_time, {', '.join(f'round(any_value({n}), 6) AS {n}' for n in names)} FROM numbered GROUP BY {k}run"""


@query(_sweep("", "SELECT s, e, usage FROM metrics WHERE usage > 100", "n = count(*)::DOUBLE; most = max(usage)"))
def tagg_global(spark, sf_dir):
    rows = V.metrics(spark, sf_dir).filter("usage > 100")
    return I.temporal_aggregate(rows, [], {"n": N.count(), "most": F.max("usage")}, bucket=86400.0, combine={"n": F.sum, "most": F.max}).select(*times(), "n", r6("most"))


@query(_sweep("user_id", "SELECT s, e, user_id, usage FROM metrics", "most = max(usage); least = min(usage)"))
def tagg_keyed(spark, sf_dir):
    return I.temporal_aggregate(V.metrics(spark, sf_dir), ["user_id"], {"most": F.max("usage"), "least": F.min("usage")}, WIDTH).select("user_id", *times(), r6("most"), r6("least"))


@query(_sweep("user_id", "SELECT s, e, user_id, path, usage FROM metrics", "n = count(*)::DOUBLE; first_usage = arg_min(usage, (r.s, path))"))
def tagg_first_row(spark, sf_dir):
    """A bare column beside an aggregate: its value in the active row that comes first."""
    found = {"n": N.count(), "first_usage": N.first_row(C("usage"), "_start_time", "path")}
    return I.temporal_aggregate(V.metrics(spark, sf_dir), ["user_id"], found, WIDTH).select("user_id", *times(), "n", r6("first_usage"))


@query(_sweep("user_id", "SELECT s, e, user_id FROM metrics", "n = count(*)::DOUBLE"))
def tagg_count_active(spark, sf_dir):
    counts = I.temporal_sum(V.metrics(spark, sf_dir).withColumn("n_", F.lit(1.0)), ["user_id"], "n_", WIDTH).withColumnRenamed("n_", "n")
    return I.coalesce_intervals(counts, ["user_id"], ["n"], WIDTH).select("user_id", *times(), "n")


_MERGED = """, src AS ({source}), runs AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM src WINDOW w AS (PARTITION BY k ORDER BY s)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s) AS run FROM runs)
SELECT k AS path, round(min(s), 6) AS start_time, round(max(e), 6) AS end_time, any_value(v) AS large FROM numbered GROUP BY k, run"""


@query(_MERGED.format(source="SELECT s, e, path AS k, usage > 50 AS v FROM metrics"))
def coalesce_project(spark, sf_dir):
    rows = V.metrics(spark, sf_dir).withColumn("large", C("usage") > 50)
    return I.coalesce_intervals(rows, ["path"], ["large"]).select("path", *times(), "large")


@query(_MERGED.replace("k AS path", "k::BIGINT AS user_id").format(source=""" SELECT c.s, c.e, c.user_id AS k, max(r.usage) > 50 AS v FROM
(SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM (SELECT user_id, s AS t FROM metrics UNION SELECT user_id, e FROM metrics)) c
JOIN metrics r ON r.user_id = c.user_id AND r.s <= c.s AND r.e >= c.e GROUP BY ALL"""))
def coalesce_after_tagg(spark, sf_dir):
    return I.temporal_aggregate(V.metrics(spark, sf_dir), ["user_id"], {"large": F.max(C("usage") > 50)}, WIDTH).select("user_id", *times(), "large")


# Subqueries and views


@query("SELECT type, round(avg(total), 6) AS mean_total FROM (SELECT type, path, sum(usage) AS total FROM metrics GROUP BY type, path HAVING sum(usage) > 20) GROUP BY type")
def subquery(spark, sf_dir):
    totals = V.metrics(spark, sf_dir).groupBy("type", "path").agg(F.sum("usage").alias("total")).filter("total > 20")
    return totals.groupBy("type").agg(r6(F.avg("total"), "mean_total"))


@query("SELECT type, count(*)::DOUBLE AS n, round(sum(usage), 6) AS total FROM metrics WHERE usage > 25 GROUP BY type")
def view_inline(spark, sf_dir):
    """A view is Spark's temporary view: not stored, and planned together with the query on it."""
    V.metrics(spark, sf_dir).filter("usage > 25").createOrReplaceTempView("large_usage")
    return spark.sql("SELECT type, CAST(count(*) AS DOUBLE) AS n, round(sum(usage), 6) AS total FROM large_usage GROUP BY type")


@query("SELECT type, count(*)::DOUBLE AS n, round(max(usage), 6) AS most FROM metrics WHERE usage > 30 GROUP BY type")
def cached_view(spark, sf_dir):
    """CACHE TABLE keeps the view's rows; lost parts are computed again."""
    V.metrics(spark, sf_dir).filter("usage > 30").createOrReplaceTempView("cached_usage")
    spark.sql("CACHE TABLE cached_usage")
    return spark.sql("SELECT type, CAST(count(*) AS DOUBLE) AS n, round(max(usage), 6) AS most FROM cached_usage GROUP BY type")


# Series algebra, demand and attribution


@query(_sweep("user_id", "SELECT s, e, user_id, (usage * 100)::BIGINT AS cents FROM metrics WHERE type IN ('/user:click', '/user:view')", "cents = sum(cents)::BIGINT"))
def series_sum(spark, sf_dir):
    m = V.metrics(spark, sf_dir).withColumn("cents", F.round(C("usage") * 100).cast("long"))
    parts = [m.filter(f"type = '/user:{t}'") for t in ("click", "view")]
    return I.series_sum(parts, ["user_id"], "cents", WIDTH).select("user_id", *times(), "cents")


@query(
    """
, gone AS (SELECT user_id, s, e FROM phases WHERE type = '/user/error'), pieces AS (
  SELECT m.path, m.s AS ms, greatest(m.s, t.t) AS s, least(m.e, t.u) AS e FROM metrics m JOIN (
    SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS u FROM (SELECT user_id, s AS t FROM gone UNION SELECT user_id, e FROM gone UNION SELECT user_id, -1 FROM metrics UNION SELECT user_id, 1e12 FROM metrics)
  ) t ON m.user_id = t.user_id AND t.t < m.e AND t.u > m.s
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = m.user_id AND g.s <= t.t AND g.e >= t.u))
SELECT path, round(s, 6) AS start_time, round(e, 6) AS end_time FROM pieces WHERE s < e"""
)
def interval_minus(spark, sf_dir):
    m, p = V.metrics(spark, sf_dir), V.phases(spark, sf_dir).filter("type = '/user/error'")
    m = m.withColumn("_row", F.struct("path", "_start_time"))
    return I.interval_minus(m, p, ["user_id"], ["_row"], WIDTH).select("path", *times())


_CURVE = """
, met AS (SELECT m.user_id, m.path AS metric, m.s AS sample, m.e AS until, m.usage, m.capacity, p.s, p.e, r.exact, r.variable FROM metrics m JOIN phases p ON m.user_id = p.user_id AND m.s < p.e AND p.s < m.e JOIN rules r ON r.type = p.type),
pts AS (SELECT metric, sample, greatest(s, sample) AS t FROM met UNION SELECT metric, sample, least(e, until) FROM met UNION SELECT path, s, s FROM metrics UNION SELECT path, s, e FROM metrics),
cuts AS (SELECT metric, sample, t AS s, lead(t) OVER (PARTITION BY metric, sample ORDER BY t) AS e FROM pts),
curve AS (SELECT c.metric, c.sample, c.s, c.e, any_value(m.user_id) AS user_id, any_value(m.usage) AS usage, any_value(m.capacity) AS capacity, coalesce(sum(x.exact), 0) AS exact, coalesce(sum(x.variable), 0) AS variable
  FROM cuts c JOIN metrics m ON m.path = c.metric AND m.s = c.sample LEFT JOIN met x ON x.metric = c.metric AND x.sample = c.sample AND x.s <= c.s AND x.e >= c.e WHERE c.e IS NOT NULL GROUP BY c.metric, c.sample, c.s, c.e)
"""


def _curve(spark, sf_dir):
    m = V.metrics(spark, sf_dir).withColumn("metric", C("path"))
    p = V.phases(spark, sf_dir).withColumn("phase", C("path"))
    return A.demand_curve(m, p, V.rules(spark), ["user_id"], WIDTH), p


@query(_CURVE + "SELECT metric, round(s, 6) AS start_time, round(e, 6) AS end_time, round(exact, 6) AS exact, round(variable, 6) AS variable FROM curve")
def demand_curve(spark, sf_dir):
    return _curve(spark, sf_dir)[0].select("metric", *times(), r6("exact"), r6("variable"))


#: The three passes over the slices of each sample, in SQL: each folds a list in the pass's order.
_FOLD = """list_reduce(l, lambda a, z: {{'rest': greatest(a.rest - (CASE WHEN a.left > {least} AND a.rest > 0 THEN least(a.rest / a.left * {weight}, {most}) ELSE 0 END) * z.p, 0), 'left': a.left - {weight} * z.p,
  'out': list_append(a.out, CASE WHEN a.left > {least} AND a.rest > 0 THEN least(a.rest / a.left * {weight}, {most}) ELSE 0 END)}}, {{'rest': rest, 'left': l0, 'out': []::DOUBLE[]}})"""


def _fold(name: str, source: str, rank: str, weight: str, most: str, left: str, least: str = "0") -> str:
    item = "{'s': s, 'e': e, 'p': p, 'x': exact, 'v': variable, 'o': got, 'c': capacity}"
    return f"""
, {name}_l AS (SELECT metric, sample, any_value(rest) AS rest, list({item} ORDER BY {rank} DESC, s) AS l, {left} AS l0 FROM {source} GROUP BY metric, sample),
{name}_f AS (SELECT metric, sample, l, {_FOLD.format(weight=weight, most=most, least=least)} AS f FROM {name}_l),
{name} AS (SELECT metric, sample, z.s, z.e, z.p, z.x AS exact, z.v AS variable, z.c AS capacity, z.o + more AS got, rest FROM (SELECT metric, sample, unnest(l) AS z, unnest(f.out) AS more, f.rest AS rest FROM {name}_f))"""


_UPSAMPLED = (
    """, cut0 AS (SELECT metric, sample, s, e, (e - s) / sum(e - s) OVER w AS p, exact, variable, capacity, 0.0::DOUBLE AS got, usage AS rest, count(*) OVER w AS n FROM curve WINDOW w AS (PARTITION BY metric, sample)),
many AS (SELECT * FROM cut0 WHERE n > 1)"""
    + _fold("f1", "many", "exact", "z.x", "least(z.x, z.c)", "sum(exact * p)")
    + _fold("f2", "f1", "(CASE WHEN capacity = got THEN (CASE WHEN variable > 0 THEN 1e308 ELSE -1 END) ELSE variable / (capacity - got) END)", "z.v", "z.c - z.o", "sum(variable * p)")
    + _fold("f3", "f2", "got", "1.0::DOUBLE", "z.c - z.o", "1.0::DOUBLE", "1e-12")
    + """, flat AS (SELECT metric, sample, s, e, got AS usage FROM f3 UNION ALL SELECT metric, sample, s, e, rest FROM cut0 WHERE n = 1),
up AS (SELECT c.metric, c.sample, c.s, c.e, c.user_id, f.usage, c.capacity, c.exact, c.variable FROM curve c JOIN flat f USING (metric, sample, s, e))"""
)


@query(_CURVE + _UPSAMPLED + "SELECT metric, round(s, 6) AS start_time, round(e, 6) AS end_time, round(usage, 6) AS usage FROM up")
def upsample(spark, sf_dir):
    """Usage over the slices of each sample, by greedy passes."""
    return A.upsample(_curve(spark, sf_dir)[0], ["user_id"]).select("metric", *times(), r6("usage"))


_SHARES = (
    _UPSAMPLED
    + """
, leaves AS (SELECT c.metric, p.path AS phase, p.type, c.s, c.e, c.user_id, c.usage AS sampled, c.capacity AS most, r.exact AS d, r.variable AS v,
  CASE WHEN r.exact > 0 THEN least(c.usage * r.exact / c.exact, r.exact) WHEN r.variable > 0 THEN greatest(c.usage - c.exact, 0) * r.variable / c.variable ELSE 0 END AS usage,
  CASE WHEN r.exact > 0 THEN least(c.capacity * r.exact / c.exact, r.exact) WHEN r.variable > 0 THEN greatest(c.capacity - c.exact, 0) * r.variable / c.variable ELSE c.capacity END AS capacity
  FROM up c JOIN phases p ON p.user_id = c.user_id AND c.s < p.e AND p.s < c.e JOIN rules r ON r.type = p.type)
"""
)


def _leaves(spark, sf_dir):
    """Usage of each metric by each phase: over the metric's upsampled usage."""
    m = V.metrics(spark, sf_dir).withColumn("metric", C("path"))
    p = V.phases(spark, sf_dir).withColumn("phase", C("path"))
    return A.attributed(m, p, V.rules(spark), ["user_id"], WIDTH)


def _attributed(kind: str):
    def f(spark, sf_dir):
        types = ["/user/click"] if kind == "exact" else ["/user/purchase", "/user/view", "/user/signup"]
        return _leaves(spark, sf_dir).filter(C("type").isin(*types)).select("metric", "phase", *times(), r6("usage"), r6("capacity"))

    f.__name__ = f"attribute_{kind}"
    query(_CURVE + _SHARES + f"SELECT metric, phase, round(s, 6) AS start_time, round(e, 6) AS end_time, round(usage, 6) AS usage, round(capacity, 6) AS capacity FROM leaves WHERE {'d' if kind == 'exact' else 'v'} > 0")(f)


_attributed("exact")
_attributed("variable")


@query(_CURVE + _SHARES + "SELECT metric, phase, round(s, 6) AS start_time, round(e, 6) AS end_time, round(usage, 6) AS usage FROM leaves WHERE usage > 1 AND usage <= 0.5 * sampled")
def attribute_filtered(spark, sf_dir):
    """Attributed usage under a filter."""
    return _leaves(spark, sf_dir).filter("usage > 1 AND usage <= 0.5 * sampled").select("metric", "phase", *times(), r6("usage"))


@query(
    _CURVE + _SHARES
    + """
, up_of AS (SELECT metric, unnest(['/', '/user[id=' || user_id || ']']) AS parent, s, e, usage, capacity FROM leaves),
spans AS (SELECT parent, min(s) AS s, max(e) AS e FROM (SELECT unnest(['/', '/user[id=' || user_id || ']']) AS parent, s, e FROM phases) GROUP BY parent),
zero AS (SELECT DISTINCT metric, parent, spans.s, spans.e FROM (SELECT DISTINCT metric, parent FROM up_of) JOIN spans USING (parent)),
marks AS (SELECT metric, parent, s AS t FROM up_of UNION SELECT metric, parent, e FROM up_of UNION SELECT metric, parent, s FROM zero UNION SELECT metric, parent, e FROM zero),
steps AS (SELECT metric, parent, t AS s, lead(t) OVER (PARTITION BY metric, parent ORDER BY t) AS e FROM marks),
sums AS (SELECT metric, parent, s, e, sum(usage) AS usage, sum(capacity) AS capacity FROM up_of GROUP BY ALL)
SELECT metric, parent AS phase, round(s, 6) AS start_time, round(e, 6) AS end_time, round(coalesce(usage, 0), 6) AS usage, round(coalesce(capacity, 0), 6) AS capacity FROM steps LEFT JOIN sums USING (metric, parent, s, e) WHERE e IS NOT NULL"""
)
def attribute_composite(spark, sf_dir):
    """All ancestors of the leaves, each over its whole time."""
    above = lambda df, path: df.withColumn("parent", F.explode(P.ancestors_of(C(path))))
    own = above(V.phases(spark, sf_dir), "path").groupBy("user_id", "parent").agg(F.min("_start_time").alias("s"), F.max("_end_time").alias("e"))
    own = stored(own)  # a row for each user and ancestor
    whole = own.groupBy("parent").agg(F.min("s").alias("_start_time"), F.max("e").alias("_end_time"))
    spans = own.select("user_id", "parent").join(whole, "parent")
    out = A.attribute_composite(above(_leaves(spark, sf_dir), "phase"), "parent", spans, WIDTH, ["user_id"])
    return out.select("metric", C("parent").alias("phase"), *times(), r6("usage"), r6("capacity"))


@query()
def nnls_fit(spark, sf_dir):
    """Fitted demand of each phase type for each metric type: an active-set solver, so no SQL."""
    fitted = A.best_fit_rules(V.metrics(spark, sf_dir).withColumn("metric", C("path")).withColumn("kind", C("type")), V.phases(spark, sf_dir), ["user_id"], "kind", WIDTH)
    return fitted.select("kind", "type", r6("demand"))


# Bottlenecks and issues

_STATUS = """
, st AS (SELECT *, e - s AS dur, CASE WHEN sampled >= 0.95 * most THEN 'GLOBAL' WHEN usage >= 0.95 * capacity THEN 'LOCAL' ELSE 'NONE' END AS status FROM leaves)
"""


def _statuses(spark, sf_dir):
    return _leaves(spark, sf_dir).withColumn("status", B.status(C("usage"), C("capacity"), C("sampled"), C("most")))


@query(_CURVE + _SHARES + _STATUS + "SELECT metric, phase, round(s, 6) AS start_time, status FROM st")
def bottleneck_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("metric", "phase", times()[0], "status")


@query(_CURVE + _SHARES + _STATUS + "SELECT user_id, round(s, 6) AS start_time, bool_or(status <> 'NONE') AS \"any\", bool_and(status <> 'NONE') AS \"all\", 2 * count(*) FILTER (status <> 'NONE') >= count(*) AS majority FROM st GROUP BY user_id, s")
def bottleneck_predicates(spark, sf_dir):
    return B.combine(_statuses(spark, sf_dir), ["user_id", "_start_time"]).select("user_id", times()[0], "any", "all", "majority")


@query(_CURVE + _SHARES + _STATUS + "SELECT phase, CASE WHEN bool_and(status = 'GLOBAL') THEN 'GLOBAL' WHEN bool_or(status <> 'NONE') THEN 'LOCAL' ELSE 'NONE' END AS status FROM st GROUP BY phase")
def bottleneck_of_type(spark, sf_dir):
    return B.of_type(_statuses(spark, sf_dir), ["phase"])


@query(
    _CURVE + _SHARES + _STATUS
    + """, n AS (SELECT phase, s, count(*) FILTER (status <> 'NONE') AS k FROM st GROUP BY phase, s)
SELECT metric, type, round(coalesce(sum(dur) FILTER (status <> 'NONE'), 0), 2) AS bottlenecked, round(coalesce(sum(dur) FILTER (status <> 'NONE' AND k = 1), 0), 2) AS uniquely, round(coalesce(sum(dur) FILTER (status = 'NONE'), 0), 2) AS free
FROM st JOIN n USING (phase, s) GROUP BY metric, type"""
)
def bottleneck_durations(spark, sf_dir):
    out = B.durations(_statuses(spark, sf_dir), ["user_id", "phase", "_start_time"], "metric", ["type"])
    return out.select("metric", "type", *[F.round(c, 2).alias(c) for c in ("bottlenecked", "uniquely", "free")])


@query(
    _CURVE + _SHARES + _STATUS
    + """, hits AS (SELECT phase, metric, s, e FROM st WHERE status <> 'NONE'),
marks AS (SELECT phase, s AS t FROM hits UNION SELECT phase, e FROM hits),
steps AS (SELECT phase, t AS a, lead(t) OVER (PARTITION BY phase ORDER BY t) AS b FROM marks),
cells AS (SELECT phase, a, b, count(*) AS n, min(metric) AS metric FROM steps JOIN hits USING (phase) WHERE s <= a AND e >= b GROUP BY phase, a, b),
active AS (SELECT phase, sum(b - a) AS t FROM cells GROUP BY phase)
SELECT phase, metric, round(any_value(t), 2) AS bottlenecked, round(any_value(t) - sum(b - a), 2) + 0.0 AS remaining, round(sum(b - a), 2) AS saving FROM cells JOIN active USING (phase) WHERE n = 1 GROUP BY phase, metric"""
)
def bottleneck_issues(spark, sf_dir):
    """What removing each bottleneck would save of each phase's time."""
    out = B.duration_issues(stored(_statuses(spark, sf_dir).select("phase", "metric", "_start_time", "_end_time", "status")), "phase", "metric", WIDTH)
    return out.select("phase", "metric", F.round("bottlenecked", 2).alias("bottlenecked"), (F.round("remaining", 2) + F.lit(0.0)).alias("remaining"), F.round("saving", 2).alias("saving"))


@query(
    _CURVE + _SHARES + _STATUS
    + """, kinds AS (SELECT user_id, s, type, bool_or(status <> 'NONE') AS in_some, bool_and(status <> 'NONE') AS whole FROM st GROUP BY user_id, s, type)
SELECT user_id, round(s, 6) AS start_time, bool_and(in_some) AS every_type, bool_or(whole) AS whole_type FROM kinds GROUP BY user_id, s"""
)
def bottleneck_predicates_by_type(spark, sf_dir):
    out = B.combine_by_type(_statuses(spark, sf_dir), ["user_id", "_start_time"], "type")
    return out.select("user_id", times()[0], "every_type", "whole_type")


@query("SELECT user_id, type, count(*)::DOUBLE AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS longest, round(max(d) - avg(d), 6) AS saving FROM phases GROUP BY user_id, type")
def imbalance_mean(spark, sf_dir):
    return B.imbalance(V.phases(spark, sf_dir), "user_id", "type").select("user_id", "type", "n", r6("mean"), r6("longest"), r6("saving"))


@query(", a AS (SELECT type, avg(d) AS mean FROM phases GROUP BY type) SELECT user_id, round(sum(d), 4) AS measured, round(sum(mean), 4) AS balanced FROM phases JOIN a USING (type) GROUP BY user_id")
def balanced_makespan(spark, sf_dir):
    out = B.balanced_makespan(V.phases(spark, sf_dir), "user_id", "type")
    return out.select("user_id", F.round("measured", 4).alias("measured"), F.round("balanced", 4).alias("balanced"))


@query(
    _sweep(
        "user_id, type",
        "SELECT greatest(m.s, p.s) AS s, least(m.e, p.e) AS e, m.user_id, p.type, m.utilization FROM metrics m JOIN phases p ON m.user_id = p.user_id AND m.s < p.e AND p.s < m.e",
        "peak = max(m_util)",
    ).replace("m.utilization", "m.utilization AS m_util")
)
def tagg_after_tjoin(spark, sf_dir):
    """The reference's typical question: utilization over time by phase type."""
    return peak_by_phase_type(spark, sf_dir).select("user_id", "type", *times(), r6("peak"))


def peak_by_phase_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = I.overlap_join(V.metrics(spark, sf_dir), V.phases(spark, sf_dir), ("m", "p"), [("user_id", "user_id")], WIDTH)
    rows = met.select("_start_time", "_end_time", C("m_user_id").alias("user_id"), C("p_type").alias("type"), C("m_utilization").alias("utilization"))
    return I.temporal_aggregate(rows, ["user_id", "type"], {"peak": F.max("utilization")}, WIDTH)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagg_after_tjoin(spark, sf_dir)


from . import exports, models  # noqa: E402, F401  register their queries
