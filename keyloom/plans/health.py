"""Project health queries over the file inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import health as H
from keyloom.plans import inputs as I
from keyloom.plans import oracle as O
from keyloom.plans.registry import query

_BAD = "NOT regexp_matches(line, '^(?:\\s*$|\\s*#|\\s*[A-Za-z_][A-Za-z0-9_]*\\s*=)')"
_FLAGS = f"""f AS ({I.INVENTORY.sql()}),
bad AS (SELECT file_id, min(line_no) AS line_no, arg_min(left(line, 50) || CASE WHEN strlen(line) > 50 THEN '...' ELSE '' END, line_no) AS snippet
  FROM ({O.lines("(SELECT * FROM f WHERE path = '.env')", keep_all=True, keys='file_id')}) WHERE {_BAD} GROUP BY file_id),
ig AS (SELECT DISTINCT project_id FROM (SELECT project_id, {O.trim('line')} AS t FROM ({O.lines("(SELECT * FROM f WHERE path = '.gitignore')", keys='project_id')})) WHERE t = '.env' OR starts_with(t, '/.env')),
req AS (SELECT DISTINCT project_id FROM (SELECT project_id, {O.trim('line')} AS t FROM ({O.lines("(SELECT * FROM f WHERE path = 'requirements.txt')", keys='project_id')}))
  WHERE starts_with(t, 'python-dotenv') OR (starts_with(t, 'dotenv') AND NOT contains(t, 'django-dotenv'))),
p AS (SELECT project_id, bool_or(path = 'poetry.lock' OR (path = 'pyproject.toml' AND contains(content, '[tool.poetry]'))) AS poetry,
  bool_or(path = 'Pipfile') AS pipfile, bool_or(path = 'pyproject.toml') AS pyproject, bool_or(path = 'requirements.txt') AS requirements,
  bool_or(path = 'package.json') AS node, bool_or(path = 'Cargo.toml') AS cargo, bool_or(path = 'go.mod') AS gomod, bool_or(path = 'composer.json') AS composer,
  bool_or(path = '.env') AS has_env, bool_or(path = '.env.example') AS has_example,
  bool_or(path IN ('docker-compose.yml', 'docker-compose.yaml', 'Dockerfile', 'Containerfile', '.dockerignore')) AS has_container,
  bool_or(path = '.env' AND (mode & 511) IN (384, 256)) AS private, max(CASE WHEN path = '.env' THEN mode & 511 END) AS env_mode,
  bool_or(path = 'pyproject.toml' AND regexp_matches(content, 'python-dotenv|pydantic-settings|dynaconf')) AS py_dep,
  bool_or(path = 'package.json' AND regexp_matches(json_keys(coalesce(json_extract(pkg, '$.dependencies'), json_extract(pkg, '$.devDependencies'))) :: VARCHAR, '\\bdotenv(-cli)?\\b')) AS node_dep,
  bool_or(path = 'Cargo.toml' AND contains(content, 'dotenv')) AS cargo_dep, max(struct_pack(line_no := bad.line_no, snippet := snippet)) FILTER (bad.line_no IS NOT NULL) AS problem
  FROM (SELECT *, CASE WHEN path = 'package.json' THEN content ELSE '{{}}' END AS pkg FROM f) LEFT JOIN bad USING (file_id) GROUP BY project_id),
k AS (SELECT *, project_id IN (SELECT project_id FROM ig) AS ignored, CASE WHEN poetry THEN 'Python (Poetry)' WHEN pipfile THEN 'Python (Pipenv)' WHEN pyproject THEN 'Python (pyproject)'
  WHEN requirements THEN 'Python (requirements)' WHEN node THEN 'Node.js' WHEN cargo THEN 'Rust' WHEN gomod THEN 'Go' WHEN composer THEN 'PHP' END AS kind FROM p),
d AS (SELECT *, CASE WHEN kind = 'Python (requirements)' THEN project_id IN (SELECT project_id FROM req) WHEN starts_with(kind, 'Python') THEN py_dep
  WHEN kind = 'Node.js' THEN coalesce(node_dep, false) WHEN kind = 'Rust' THEN cargo_dep END AS dep FROM k)"""


@query("project_types", f"""WITH {_FLAGS} SELECT project_id, kind AS project_type, CASE dep WHEN true THEN 'yes' WHEN false THEN 'no' ELSE 'n/a' END AS dotenv, has_container, ignored AS env_ignored, private AS env_private FROM d""")
def project_types(spark, sf):
    rows = H.classify_projects(I.INVENTORY.df(spark, sf))
    dep = F.when(F.col("has_dotenv_dependency"), "yes").when(~F.col("has_dotenv_dependency"), "no").otherwise("n/a")
    return rows.select("project_id", "project_type", dep.alias("dotenv"), "has_container", "env_ignored", "env_private")


_CHECKS = f"""{_FLAGS}, c AS (
SELECT project_id, 'env_file' AS name, CASE WHEN NOT has_env THEN 'warning' WHEN NOT ignored THEN 'error' WHEN problem IS NOT NULL THEN 'warning' ELSE 'ok' END AS severity,
  CASE WHEN NOT has_env THEN '.env file not found - create from .env.example' ELSE nullif(concat_ws(chr(10), CASE WHEN NOT ignored THEN '.env is NOT in .gitignore (security risk)' END,
  CASE WHEN problem IS NOT NULL THEN 'Syntax issues: Line ' || problem.line_no || ': invalid syntax ''' || problem.snippet || '''' END), '') END AS details, has_env AND NOT ignored AS fixable FROM d
UNION ALL SELECT project_id, 'env_example', CASE WHEN has_example THEN 'ok' ELSE 'warning' END, CASE WHEN NOT has_example THEN '.env.example not found - consider creating a template' END, false FROM d
UNION ALL SELECT project_id, 'project_structure', CASE WHEN kind IS NULL THEN 'info' WHEN kind = 'Python (requirements)' AND NOT dep THEN 'warning' ELSE 'ok' END,
  CASE WHEN kind IS NULL THEN 'No recognized project configuration' WHEN kind = 'Python (requirements)' AND NOT dep THEN 'python-dotenv not in requirements.txt' END, false FROM d
UNION ALL SELECT project_id, 'docker_config', CASE WHEN has_container THEN 'ok' ELSE 'info' END, CASE WHEN NOT has_container THEN 'No Docker configuration detected' END, false FROM d
UNION ALL SELECT project_id, 'file_permissions', CASE WHEN NOT has_env THEN 'info' WHEN private THEN 'ok' ELSE 'warning' END,
  CASE WHEN has_env AND NOT private THEN 'Permissions: ' || printf('%o', env_mode) || ' (recommended: 600)' END, has_env AND NOT private FROM d)"""


@query("health_checks", f"WITH {_CHECKS} SELECT * FROM c")
def health_checks(spark, sf):
    return H.project_checks(H.classify_projects(I.INVENTORY.df(spark, sf)))


@query("health_rollup", f"""WITH {_CHECKS}, s AS (SELECT project_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors,
CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warnings, CAST(count(*) FILTER (severity = 'ok') AS BIGINT) AS passed, CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS info,
CAST(count(*) FILTER (fixable) AS BIGINT) AS fixable FROM c GROUP BY project_id)
SELECT *, CASE WHEN errors > 0 THEN 'Action required' WHEN warnings > 0 THEN 'Needs attention' ELSE 'Excellent' END AS health FROM s""")
def health_rollup(spark, sf):
    return H.health_summary(H.project_checks(H.classify_projects(I.INVENTORY.df(spark, sf))))


@query("ignore_coverage", f"""WITH f AS ({I.INVENTORY.sql()}), g AS (SELECT file_id, list({O.trim('line')}) AS ls FROM ({O.lines("(SELECT * FROM f WHERE path = '.gitignore')", keys='file_id')}) GROUP BY file_id)
SELECT f.file_id, coalesce(list_contains(ls, '.env'), false) AS exact, coalesce(list_contains(ls, 'target'), false) AS target FROM f LEFT JOIN g USING (file_id) WHERE path = '.gitignore'""")
def ignore_coverage(spark, sf):
    rows = I.INVENTORY.df(spark, sf).filter("path = '.gitignore'")
    return rows.select("file_id", H.ignores("content", ".env").alias("exact"), H.ignores("content", " target ").alias("target"))


@query("report_health_json", f"""WITH {_CHECKS} SELECT project_id, '{{"name":"' || name || '","severity":"' || severity || '","details":' || coalesce(CAST(to_json(details) AS VARCHAR), 'null')
|| ',"fixable":' || fixable || '}}' AS json FROM c""")
def report_health_json(spark, sf):
    from keyloom.sources.reports import json_rows

    return json_rows(H.project_checks(H.classify_projects(I.INVENTORY.df(spark, sf))), ["project_id"])
