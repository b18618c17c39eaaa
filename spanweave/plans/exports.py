"""Queries for the layouts of exports: lists, and values by time slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import export as X
from ..sources import views as V
from .catalog import _CURVE, _SHARES, _STATUS, C, _statuses, query, r6

#: Seconds of a time slice.
DAY = 86400.0

_FIRST, _END = (f"floor({c} / {DAY} + 0.5)::BIGINT" for c in ("s", "e"))
_ID = "left(md5({}), 16)"
_EVERY = """, every AS (SELECT unnest(['/', '/user[id=' || user_id || ']', path]) AS path, s, e FROM phases),
spans AS (SELECT path, regexp_replace(path, '\\[[^\\]]*\\]', '', 'g') AS type, min(s) AS s, max(e) AS e FROM every GROUP BY path),
placed AS (SELECT *, CASE WHEN path = '/' THEN NULL WHEN path LIKE '/%/%' THEN regexp_extract(path, '^(.+)/', 1) ELSE '/' END AS parent,
  CASE WHEN path = '/' THEN 0 ELSE length(path) - length(replace(path, '/', '')) END AS depth FROM spans)
"""


def _sql_runs(source: str, ids: dict[str, str], value: str) -> str:
    keys = ", ".join(ids.values())
    same = f"lag(l) OVER w = f AND lag(v) OVER w = v"
    return f"""{source}, src AS (SELECT {keys}, {value} AS v, {_FIRST} AS f, {_END} AS l FROM rows_ WHERE {_FIRST} < {_END}),
runs AS (SELECT *, CASE WHEN {same} THEN 0 ELSE 1 END AS fresh FROM src WINDOW w AS (PARTITION BY {keys} ORDER BY f)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY f) AS run FROM runs)
SELECT {', '.join(f'{_ID.format(c)} AS {n}' for n, c in ids.items())}, min(f) AS start_time_slice, max(l) - 1 AS end_time_slice_inclusive, any_value(v) AS """


@query(_EVERY + f"""SELECT {_ID.format('path')} AS phase_id, {_ID.format('type')} AS phase_type_id, path AS phase_path, {_ID.format('parent')} AS parent_phase_id, depth,
{_FIRST} AS start_time_slice, {_END} - 1 AS end_time_slice_inclusive, row_number() OVER (PARTITION BY parent ORDER BY s, path) - 1 AS canonical_index FROM placed""")
def export_phase_list(spark, sf_dir):
    """Every phase and its ancestors; a hot parent's children are numbered by buckets of time."""
    return X.phase_list(X.with_ancestors(V.phases(spark, sf_dir)), DAY)


@query(_EVERY + f"SELECT DISTINCT {_ID.format('type')} AS phase_type_id, type AS phase_type_path, CASE type WHEN '/' THEN NULL WHEN '/user' THEN {_ID.format(chr(39) + '/' + chr(39))} ELSE {_ID.format(chr(39) + '/user' + chr(39))} END AS parent_phase_type_id, depth FROM placed")
def export_phase_types(spark, sf_dir):
    return X.phase_types(X.with_ancestors(V.phases(spark, sf_dir)))


@query(f"SELECT DISTINCT {_ID.format('type')} AS metric_type_id, type AS metric_type_path, 'consumable' AS metric_class FROM metrics")
def export_metric_types(spark, sf_dir):
    return X.metric_types(V.metrics(spark, sf_dir))


@query(f"SELECT {_ID.format('path')} AS metric_id, {_ID.format('type')} AS metric_type_id, path AS metric_path, round(max(capacity), 6) AS capacity FROM metrics GROUP BY path, type")
def export_metric_list(spark, sf_dir):
    """The layout's capacity is text; here it is a number, as numbers are spelled differently elsewhere."""
    return X.metric_list(V.metrics(spark, sf_dir)).withColumn("capacity", F.round(C("capacity").cast("double"), 6))


@query(_sql_runs(", rows_ AS (SELECT * FROM metrics)", {"metric": "path"}, "usage") + f"observed_usage FROM numbered GROUP BY path, run")
def export_metric_runs(spark, sf_dir):
    return X.metric_runs(V.metrics(spark, sf_dir), DAY)


@query(f", days AS (SELECT *, unnest(range({_FIRST}, {_END})) AS slice FROM metrics) SELECT {_ID.format('path')} AS metric, slice AS time_slice, round(usage, 6) AS usage, round(capacity, 6) AS capacity FROM days")
def export_usage_slices(spark, sf_dir):
    return X.usage_by_slice(V.metrics(spark, sf_dir), DAY).select("metric", "time_slice", r6("usage"), r6("capacity"))


_PIECES = _CURVE + _SHARES + _STATUS + ", rows_ AS (SELECT * FROM st)"


@query(_sql_runs(_PIECES, {"phase_id": "phase", "metric": "metric"}, "left(status, 1)") + "bottleneck_status FROM numbered GROUP BY phase, metric, run")
def export_status_runs(spark, sf_dir):
    """Statuses of each phase and metric in runs of slices."""
    return X.status_runs(_statuses(spark, sf_dir), DAY)


@query(
    _CURVE + _SHARES + _STATUS
    + _sql_runs(", rows_ AS (SELECT phase, regexp_replace(metric, '\\[[^\\]]*\\]', '', 'g') AS kind, s, e, status FROM st)", {"phase_id": "phase", "metric_type_id": "kind"}, "status <> 'NONE'")
    + "is_bottleneck FROM numbered GROUP BY phase, kind, run"
)
def export_bottleneck_runs(spark, sf_dir):
    """Whether a metric's type is a bottleneck of a phase; a user has one metric of each type."""
    kind = F.regexp_replace("metric", r"\[[^\]]*\]", "")
    return X.bottleneck_runs(_statuses(spark, sf_dir).withColumn("type", kind), DAY)
