"""Snapshot queries: event counters per user, first against second half of the month."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import diff as D
from keyloom.plans import inputs as I
from keyloom.plans import oracle as O
from keyloom.plans.registry import query
from keyloom.sources.reports import json_rows


def _side(spark, sf, d):
    return d.df(spark, sf).filter("n > 0").selectExpr("project_id", "key", "cast(n as string) AS value", "pos")


def sides(spark, sf):
    return _side(spark, sf, I.SNAP_A), _side(spark, sf, I.SNAP_B)


def _sql(d: I.Derived) -> str:
    return f"SELECT project_id, key, CAST(CAST(n AS BIGINT) AS VARCHAR) AS value, pos FROM ({d.sql()}) WHERE n > 0"


def _changes(a: I.Derived = I.SNAP_A, b: I.Derived = I.SNAP_B, where: str = "true") -> str:
    red = lambda v: f"CASE WHEN {O.sensitive('key')} THEN left({v}, 2) || '***' END"
    return f"""WITH a AS (SELECT * FROM ({_sql(a)}) WHERE {where}), b AS (SELECT * FROM ({_sql(b)}) WHERE {where}),
changes AS (
  SELECT b.project_id, b.key, 'missing' AS status, NULL AS left_value, b.value AS right_value, NULL AS left_redacted, NULL AS right_redacted, b.pos
  FROM b ANTI JOIN a USING (project_id, key)
  UNION ALL SELECT a.project_id, a.key, 'extra', a.value, NULL, NULL, NULL, a.pos FROM a ANTI JOIN b USING (project_id, key)
  UNION ALL SELECT project_id, key, 'different', l, r, {red('l')}, {red('r')}, pos FROM (
    SELECT a.project_id, a.key, a.value AS l, b.value AS r, a.pos FROM a JOIN b USING (project_id, key) WHERE a.value <> b.value))"""


@query("diff_status", _changes() + " SELECT project_id, key, status, left_value, right_value, pos FROM changes")
def diff_status(spark, sf):
    return D.diff(*sides(spark, sf)).select("project_id", "key", "status", "left_value", "right_value", "pos")


@query("diff_redacted", _changes() + " SELECT project_id, key, left_redacted, right_redacted FROM changes WHERE status = 'different'")
def diff_redacted(spark, sf):
    changed = D.diff(*sides(spark, sf)).filter(F.col("status") == "different")
    return changed.select("project_id", "key", "left_redacted", "right_redacted")


_FIELD = lambda c: f"coalesce(',\"{c}\":' || to_json({c}), '')"


@query("diff_json", _changes() + f""" SELECT project_id, key, '{{"status":' || to_json(status) || {_FIELD('left_value')} || {_FIELD('right_value')}
|| {_FIELD('left_redacted')} || {_FIELD('right_redacted')} || '}}' AS json FROM changes""")
def diff_json(spark, sf):
    """Report entries; what does not apply to an entry is left out of it."""
    fields = ["status", "left_value", "right_value", "left_redacted", "right_redacted"]
    return json_rows(D.diff(*sides(spark, sf)).select("project_id", "key", *fields), ["project_id", "key"], nulls=False)


@query("diff_ignore_reverse", _changes(I.SNAP_B, I.SNAP_A, "key NOT IN ('CLICK_1', 'VIEW_TOKEN_2', 'ERROR_TOKEN_3')")
       + " SELECT project_id, key, status FROM changes")
def diff_ignore_reverse(spark, sf):
    ignored = ["CLICK_1", "VIEW_TOKEN_2", "ERROR_TOKEN_3"]
    return D.diff(*sides(spark, sf), ignore=ignored, reverse=True).select("project_id", "key", "status")


@query("diff_similarity", f"""WITH a AS ({_sql(I.SNAP_A)}), b AS ({_sql(I.SNAP_B)}), k AS (
SELECT coalesce(a.project_id, b.project_id) AS project_id, a.key IS NOT NULL AS l, b.key IS NOT NULL AS r
FROM a FULL JOIN b ON a.project_id = b.project_id AND a.key = b.key)
SELECT project_id, CAST(count(*) FILTER (l) AS BIGINT) AS total_left, CAST(count(*) FILTER (r) AS BIGINT) AS total_right,
CAST(count(*) FILTER (l AND r) AS BIGINT) AS overlap,
round(200.0 * count(*) FILTER (l AND r) / (count(*) FILTER (l) + count(*) FILTER (r)), 2) AS similarity_percent FROM k GROUP BY project_id""")
def diff_similarity(spark, sf):
    return D.similarity(*sides(spark, sf))


def _projects(spark, sf):
    return I.SNAP_A.df(spark, sf).select("project_id").distinct()


@query("diff_has_changes", _changes() + """, p AS (SELECT DISTINCT 'u' || user_id AS project_id FROM events)
SELECT project_id, project_id IN (SELECT project_id FROM changes) AS has_changes FROM p""")
def diff_has_changes(spark, sf):
    return D.has_changes(D.diff(*sides(spark, sf)), _projects(spark, sf))


@query("diff_patch", _changes() + """, p AS (SELECT DISTINCT 'u' || user_id AS project_id FROM events)
SELECT project_id, 1 AS section, CAST(pos AS INTEGER) AS pos, 0 AS sub, '+ ' || key || '=' || right_value AS text FROM changes WHERE status = 'missing'
UNION ALL SELECT project_id, 2, CAST(pos AS INTEGER), 0, '- ' || key || '=' || left_value FROM changes WHERE status = 'extra'
UNION ALL SELECT project_id, 3, CAST(pos AS INTEGER), 0, '- ' || key || '=' || left_value FROM changes WHERE status = 'different'
UNION ALL SELECT project_id, 3, CAST(pos AS INTEGER), 1, '+ ' || key || '=' || right_value FROM changes WHERE status = 'different'
UNION ALL SELECT project_id, 1, -1, 0, '# Add these to .env:' FROM p UNION ALL SELECT project_id, 2, -1, 0, '# Remove these from .env:' FROM p
UNION ALL SELECT project_id, 3, -1, 0, '# Update these in .env:' FROM p""")
def diff_patch(spark, sf):
    return D.patch_lines(D.diff(*sides(spark, sf)), _projects(spark, sf))
