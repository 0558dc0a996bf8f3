"""Validation, fix and rewrite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import checks
from keyloom.operators import validate as V
from keyloom.plans import inputs as I
from keyloom.plans import oracle as O
from keyloom.plans.registry import query
from keyloom.sources import reports

_PLACEHOLDER = f"(value = '' OR {O.any_in('lower(value)', checks.PLACEHOLDER_PARTS)})"
_WEAK = f"(key = 'SECRET_KEY' AND (strlen(value) < 32 OR {O.any_in('lower(value)', checks.WEAK_PARTS)}))"
_SECRETISH = O.any_in("upper(key)", ["SECRET", "KEY"])
_IN_BOX = f"project_id IN (SELECT project_id FROM ({I.ENV_FILES.sql()}) WHERE regexp_extract(path, '[^/]*$') IN ('Dockerfile', 'Containerfile', 'docker-compose.yml', 'docker-compose.yaml'))"


def _issue(severity: str, kind: str, message: str, suggestion: str, fixable: bool, source: str, where: str) -> str:
    return (f"SELECT project_id, '{severity}' AS severity, '{kind}' AS type, key AS variable, {message} AS message, '.env:?' AS location, "
            f"{suggestion} AS suggestion, {str(fixable).lower()} AS auto_fixable FROM {source} WHERE {where}")


_PARTS = {
    "missing": _issue("error", "missing_variable", "'Missing required variable: ' || key", "'Add ' || key || '=<value> to .env'", True,
                      "(SELECT x.* FROM x ANTI JOIN e USING (project_id, key))", "true"),
    "extra": _issue("warning", "extra_variable", "'Extra variable not in .env.example: ' || key",
                    "'Add ' || key || ' to .env.example or remove from .env'", False, "(SELECT e.* FROM e ANTI JOIN x USING (project_id, key))", "true"),
    "placeholder": _issue("error", "placeholder_value", "key || ' looks like a placeholder'",
                          "CASE WHEN key = 'SECRET_KEY' THEN 'Run: openssl rand -hex 32' WHEN contains(key, 'AWS') THEN 'Get from AWS Console' WHEN contains(key, 'STRIPE') THEN 'Get from Stripe Dashboard' END",
                          True, "e", _PLACEHOLDER),
    "boolean": _issue("warning", "boolean_trap", "key || ' is set to \"' || value || '\" (string, not boolean)'",
                      "'Use ' || lower(value) || ' or 0 for proper boolean handling'", True, "e", "value IN ('True', 'False')"),
    "weak": _issue("error", "weak_secret", "'SECRET_KEY is too weak or predictable'", "'Run: openssl rand -hex 32'", True, "e", _WEAK),
    "localhost": _issue("warning", "localhost_in_docker", "key || ' uses localhost/127.0.0.1'",
                        "'In Docker, use service name instead (e.g., db:5432)'", False, "e",
                        f"(contains(value, 'localhost') OR contains(value, '127.0.0.1')) AND {O.any_in('key', ['URL', 'HOST', 'ADDR'])} AND {_IN_BOX}"),
    "url": _issue("warning", "invalid_url", "key || ' does not appear to be a valid URL'", "'Expected format: https://example.com/path'", False, "e",
                  f"value <> '' AND {O.any_in('upper(key)', ['URL', 'URI', 'ENDPOINT'])} AND NOT regexp_matches(value, '^https?://[^\\s/$.?#].[^\\s]*$')"),
    "port": _issue("error", "invalid_port", "key || ' is not a valid port number (1-65535)'", "'Expected format: 8080'", False, "e",
                   "value <> '' AND contains(upper(key), 'PORT') AND NOT (regexp_full_match(value, '[0-9]{1,5}') AND coalesce(TRY_CAST(value AS INTEGER), 0) BETWEEN 1 AND 65535)"),
    "email": _issue("warning", "invalid_email", "key || ' does not appear to be a valid email'", "'Expected format: user@example.com'", False, "e",
                    "value <> '' AND contains(upper(key), 'MAIL') AND NOT regexp_full_match(value, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')"),
}
_SIDES = f"WITH e AS ({I.ENV.sql()}), x AS ({I.EXAMPLE.sql()})"


def _issues(*names: str) -> str:
    return " UNION ALL ".join(_PARTS[n] for n in names or _PARTS)


def _inputs(spark, sf):
    return I.ENV.df(spark, sf), I.EXAMPLE.df(spark, sf), V.container_projects(I.ENV_FILES.df(spark, sf))


@query("validate_issues", f"{_SIDES} {_issues()}")
def validate_issues(spark, sf):
    return V.validate(*_inputs(spark, sf), strict=True)


def _one_check(name: str, kinds: list[str], parts: list[str]) -> None:
    @query(name, f"{_SIDES} {_issues(*parts)}")
    def run(spark, sf):
        others = ["missing_variable", "extra_variable", "placeholder_value", "boolean_trap", "weak_secret",
                  "localhost_in_docker", "invalid_url", "invalid_port", "invalid_email"]
        return V.validate(*_inputs(spark, sf), strict=True, ignore=[k for k in others if k not in kinds])


_one_check("check_missing", ["missing_variable"], ["missing"])
_one_check("check_extra", ["extra_variable"], ["extra"])
_one_check("check_placeholder", ["placeholder_value"], ["placeholder"])
_one_check("check_boolean", ["boolean_trap"], ["boolean"])
_one_check("check_weak_secret", ["weak_secret"], ["weak"])
_one_check("check_localhost", ["localhost_in_docker"], ["localhost"])
_one_check("check_formats", ["invalid_url", "invalid_port", "invalid_email"], ["url", "port", "email"])

_FIXES = f"""fixes AS (
SELECT project_id, key, 1 AS prio, 'add_missing' AS action, NULL AS old_value, CASE WHEN {_SECRETISH} THEN 'CHANGE_ME_SECURE_32_CHARS_MIN' ELSE 'your_value_here' END AS new_value
FROM (SELECT x.* FROM x ANTI JOIN e USING (project_id, key))
UNION ALL SELECT project_id, key, 2, CASE WHEN {_SECRETISH} THEN 'generate_secret' ELSE 'replace_placeholder' END, value,
  CASE WHEN {_SECRETISH} THEN sha256(project_id || key) WHEN contains(key, 'URL') THEN 'https://example.com' WHEN contains(key, 'MAIL') THEN 'user@example.com'
  WHEN contains(key, 'PORT') THEN '8080' ELSE 'your_value_here' END FROM e WHERE {_PLACEHOLDER}
UNION ALL SELECT project_id, key, 3, 'fix_boolean', value, lower(value) FROM e WHERE value IN ('True', 'False')
UNION ALL SELECT project_id, key, 4, 'generate_secret', value, sha256(project_id || key) FROM e WHERE {_WEAK})"""


def _fixes(spark, sf):
    return V.plan_fixes(I.ENV.df(spark, sf), I.EXAMPLE.df(spark, sf), secret=F.sha2(F.concat("project_id", "key"), 256))


@query("fix_plan", f"{_SIDES}, {_FIXES} SELECT * FROM fixes")
def fix_plan(spark, sf):
    return _fixes(spark, sf)


@query("fix_apply", f"""{_SIDES}, {_FIXES}, f AS (SELECT project_id, key, arg_max(new_value, prio) AS new_value FROM fixes GROUP BY project_id, key)
SELECT coalesce(e.project_id, f.project_id) AS project_id, coalesce(e.key, f.key) AS key, coalesce(f.new_value, e.value) AS value,
f.new_value IS NOT NULL AS fixed FROM e FULL JOIN f ON e.project_id = f.project_id AND e.key = f.key""")
def fix_apply(spark, sf):
    return V.apply_fixes(I.ENV.df(spark, sf), _fixes(spark, sf)).drop("pos")


@query("validate_summary", f"""{_SIDES}, {_FIXES}, i AS ({_issues()}), p AS (SELECT DISTINCT project_id FROM e UNION SELECT DISTINCT project_id FROM x)
SELECT project_id, CASE WHEN (SELECT count(*) FROM i WHERE i.project_id = p.project_id AND severity = 'error') > 0 THEN 'failed' ELSE 'passed' END AS status,
(SELECT count(*) FROM i WHERE i.project_id = p.project_id AND severity = 'error') AS errors,
(SELECT count(*) FROM i WHERE i.project_id = p.project_id AND severity = 'warning') AS warnings,
(SELECT count(*) FROM i WHERE i.project_id = p.project_id AND severity = 'style') AS style,
(SELECT count(*) FROM fixes f WHERE f.project_id = p.project_id) AS fixed_count,
least((SELECT count(*) FROM e WHERE e.project_id = p.project_id) + (SELECT count(*) FROM fixes f WHERE f.project_id = p.project_id AND prio = 1),
  (SELECT count(*) FROM x WHERE x.project_id = p.project_id)) AS required_present,
(SELECT count(*) FROM x WHERE x.project_id = p.project_id) AS required_total,
(SELECT count(*) FROM x JOIN e USING (project_id, key) WHERE x.project_id = p.project_id) AS required_matched FROM p""")
def validate_summary(spark, sf):
    env, example, boxes = _inputs(spark, sf)
    return V.summarise(V.validate(env, example, boxes, strict=True), env, example, _fixes(spark, sf))


@query("annotation_lines", f"""{_SIDES}, {_FIXES}, i AS ({_issues()})
SELECT project_id, variable, type, 0 AS sub, '::' || severity || ' file=.env,line=1::' || message AS text FROM i
UNION ALL SELECT project_id, variable, type, 1, '::' || severity || ' file=.env,line=1::Suggestion: ' || suggestion FROM i WHERE suggestion IS NOT NULL
UNION ALL SELECT project_id, key, 'fix', 2, '::notice file=.env,line=1::Fixed: ' || key || ' → ' || CASE action WHEN 'generate_secret' THEN 'Generated secure secret'
WHEN 'replace_placeholder' THEN 'Replaced placeholder' WHEN 'fix_boolean' THEN 'Fixed boolean format' ELSE 'Added missing variable' END FROM fixes""")
def annotation_lines(spark, sf):
    return reports.annotations(V.validate(*_inputs(spark, sf), strict=True), _fixes(spark, sf))


@query("validation_json", f"""{_SIDES}, i AS ({_issues()}) SELECT project_id, '{{"severity":"' || severity || '","type":"' || type || '","variable":' || to_json(variable)
|| ',"message":' || to_json(message) || ',"location":' || to_json(location) || ',"suggestion":' || coalesce(to_json(suggestion), 'null')
|| ',"auto_fixable":' || auto_fixable || '}}' AS json FROM i""")
def validation_json(spark, sf):
    return reports.json_rows(V.validate(*_inputs(spark, sf), strict=True), ["project_id"])


_REWRITE = f"""WITH f AS ({I.CONFIGS.sql()}), v AS ({I.CONFIG_VALUES.sql()}), l AS (SELECT *, {O.trim('line')} AS t FROM ({O.lines('f', keep_all=True, keys='file_id')})),
k AS (SELECT *, CASE WHEN t <> '' AND NOT starts_with(t, '#') AND contains(line, '=') THEN {O.trim('line[:instr(line, chr(61)) - 1]')} END AS k FROM l)
SELECT k.file_id, 0 AS section, k.line_no, CASE WHEN v.value IS NULL THEN line ELSE k.k || '=' || v.value END AS text FROM k LEFT JOIN v ON v.file_id = k.file_id AND v.key = k.k
UNION ALL SELECT v.file_id, 1, v.pos, v.key || '=' || v.value FROM v JOIN f USING (file_id) WHERE NOT contains(content, v.key || '=')"""


@query("line_rewrite", _REWRITE)
def line_rewrite(spark, sf):
    return V.rewrite_lines(I.CONFIGS.df(spark, sf), I.CONFIG_VALUES.df(spark, sf))
