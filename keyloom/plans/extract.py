"""Extraction and expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import expand as X
from keyloom.operators import extract as E
from keyloom.operators import template as T
from keyloom.operators.checkpoints import cut
from keyloom.plans import inputs as I
from keyloom.plans import oracle as O
from keyloom.plans.registry import query

_PARSED = f"WITH RECURSIVE {O.parsed(I.CONFIGS.sql())}"


def _rows(spark, sf):
    return E.parse_rows(I.CONFIGS.df(spark, sf))


@query("parse_rows", f"{_PARSED} SELECT file_id, line_no, key, raw_value, value, quote, error FROM parsed")
def parse_rows(spark, sf):
    return _rows(spark, sf).select("file_id", "line_no", "key", "raw_value", "value", "quote", "error")


@query("parse_line_rows", f"{_PARSED} SELECT file_id, line_no, key, raw_value, value, quote, error FROM parsed")
def parse_line_rows(spark, sf):
    lines = E.to_lines(I.CONFIGS.df(spark, sf).select("file_id", "content"), keep="all")
    return E.parse_lines(lines, ["file_id"]).select("file_id", "line_no", "key", "raw_value", "value", "quote", "error")


@query("parse_errors", f"{_PARSED} SELECT project_id, file_id, line_no, error, key FROM parsed WHERE error IS NOT NULL")
def parse_errors(spark, sf):
    return E.parse_errors(_rows(spark, sf))


@query("parse_prose", f"""WITH l AS ({O.lines('(' + I.DOCS.sql() + ')')}), k AS (SELECT *, regexp_replace({O.trim('line')}, '^export[{O.WS_CLASS}]+', '') AS body FROM l)
SELECT file_id, CAST(count(*) FILTER (NOT contains(body, '=')) AS BIGINT) AS no_separator, CAST(count(*) FILTER (contains(body, '=') AND NOT
regexp_full_match({O.trim("split_part(body, '=', 1)")}, '[A-Za-z][A-Za-z0-9_]*')) AS BIGINT) AS bad_key, CAST(count(*) AS BIGINT) AS n_lines FROM k GROUP BY file_id""")
def parse_prose(spark, sf):
    rows = E.parse_rows(I.DOCS.df(spark, sf))
    return rows.groupBy("file_id").agg(
        F.count_if(F.col("error") == "InvalidFormat").alias("no_separator"),
        F.count_if(F.col("error") == "InvalidKey").alias("bad_key"),
        F.count(F.lit(1)).alias("n_lines"),
    )


@query("file_status", f"""{_PARSED} SELECT project_id, file_id, arg_min(error, line_no) FILTER (error IS NOT NULL) AS first_error,
coalesce(min(line_no) FILTER (error IS NOT NULL), 0) AS first_error_line, CAST(count(*) FILTER (error IS NULL) AS BIGINT) AS assignments FROM parsed GROUP BY project_id, file_id""")
def file_status(spark, sf):
    status = E.file_status(_rows(spark, sf))
    return status.withColumn("first_error_line", F.coalesce("first_error_line", F.lit(0)))


_VARS = """vars AS (SELECT project_id, file_id, key, min(line_no) AS pos, max(line_no) AS line_no, arg_max(value, line_no) AS value
FROM parsed WHERE error IS NULL GROUP BY project_id, file_id, key)"""


@query("parse_vars", f"{_PARSED}, {_VARS} SELECT * FROM vars")
def parse_vars(spark, sf):
    return E.parse_vars(I.CONFIGS.df(spark, sf)).select("project_id", "file_id", "key", "pos", "line_no", "value")


@query("strict_keys", f"""{_PARSED} SELECT file_id, line_no, CASE WHEN error IS NULL AND key <> upper(key) THEN 'InvalidKey' ELSE error END AS error FROM parsed""")
def strict_keys(spark, sf):
    return E.parse_rows(I.CONFIGS.df(spark, sf), strict=True).select("file_id", "line_no", "error")


_LINES = O.lines("(" + I.CONFIGS.sql() + ")", keys="file_id")


@query("lenient_pairs", f"""SELECT file_id, line_no, {O.trim("regexp_replace(" + O.trim("split_part(line, '=', 1)") + ", '^(export)+', '')")} AS key,
{O.trim("substr(line, instr(line, '=') + 1)")} AS value FROM ({_LINES}) WHERE contains(line, '=')""")
def lenient_pairs(spark, sf):
    return E.lenient_pairs(E.to_lines(I.CONFIGS.df(spark, sf).select("file_id", "content")))


@query("key_names", f"""SELECT file_id, line_no, {O.trim("split_part(" + O.trim("line") + ", '=', 1)")} AS key FROM ({_LINES})""")
def key_names(spark, sf):
    return E.key_names(I.CONFIGS.df(spark, sf).select("file_id", "content"))


def _classified(d: I.Derived) -> str:
    return f"""WITH f AS ({d.sql()}), l AS (SELECT file_id, {O.trim('line')} AS t FROM ({O.lines('f', keep_all=True, keys='file_id')})),
g AS (SELECT *, starts_with(t, '#') OR (contains(t, '=') AND regexp_full_match({O.trim("split_part(t, '=', 1)")}, '[\\pL\\pN_]+')) AS good FROM l WHERE t <> '')
SELECT f.file_id, coalesce(count(*) FILTER (good) * 10 >= count(t) * 8, true) AS is_kv,
CAST(count(*) FILTER (contains(t, '=') AND NOT starts_with(t, '#')) AS INTEGER) AS n_vars, CAST(count(t) AS INTEGER) AS n_lines
FROM f LEFT JOIN g USING (file_id) GROUP BY f.file_id"""


@query("kv_classifier", _classified(I.CONFIGS))
def kv_classifier(spark, sf):
    return E.classify_kv(I.CONFIGS.df(spark, sf).select("file_id", "content"))


@query("kv_classifier_docs", _classified(I.DOCS))
def kv_classifier_docs(spark, sf):
    return E.classify_kv(I.DOCS.df(spark, sf).select("file_id", "content"))


@query("first_syntax_error", f"""WITH b AS (SELECT * FROM ({O.lines('(' + I.CONFIGS.sql() + ')', keep_all=True, keys='file_id')})
WHERE NOT regexp_matches(line, '^(?:[{O.WS_CLASS}]*$|[{O.WS_CLASS}]*#|[{O.WS_CLASS}]*[A-Za-z_][A-Za-z0-9_]*[{O.WS_CLASS}]*=)'))
SELECT file_id, min(line_no) AS line_no, arg_min(left(line, 50) || CASE WHEN strlen(line) > 50 THEN '...' ELSE '' END, line_no) AS snippet FROM b GROUP BY file_id""")
def first_syntax_error(spark, sf):
    return E.first_syntax_error(I.CONFIGS.df(spark, sf).select("file_id", "content"))


_SNAPSHOT = I.Derived("part", {"host": I.text("p_brand"), "key": I.pick("p_partkey", ["'PATH'", "'HOME'", "'APP_KEY'", "'_'", "'LANGUAGE'", "'TMP'", "'PWD'", "'path'"]), "value": "p_name"})


@query("system_variables", f"""SELECT host, key, value FROM ({_SNAPSHOT.sql()}) WHERE key NOT IN ('PATH', 'HOME', 'USER', 'SHELL', 'PWD', 'TERM', 'LANG', 'LOGNAME', 'TMPDIR', 'TEMP', 'TMP', 'OLDPWD', 'SHLVL', '_')""")
def system_variables(spark, sf):
    return E.drop_system_variables(_SNAPSHOT.df(spark, sf))


# One reference per value, so the chain can be followed link by link.
_CHAIN = f"""WITH RECURSIVE v AS (SELECT *, regexp_extract(value, '\\$\\{{?([A-Za-z0-9_]+)\\}}?$', 1) AS ref, contains(value, '{{') AS braced,
  regexp_replace(value, '\\$\\{{?[A-Za-z0-9_]+\\}}?$', '') AS head FROM ({I.CHAINS.sql()})),
walk AS (
  SELECT file_id, key, head AS done, ref, braced, [] :: VARCHAR[] AS path, CASE WHEN ref = '' THEN 'ok' END AS state, value FROM v
  UNION ALL
  SELECT w.file_id, w.key, w.done || CASE WHEN t.key IS NULL AND NOT w.braced THEN '$' || w.ref WHEN t.key IS NULL OR list_contains(w.path, w.ref) OR len(w.path) >= 10 THEN '' ELSE t.head END,
    t.ref, t.braced, list_append(w.path, w.ref),
    CASE WHEN list_contains(w.path, w.ref) THEN 'CircularExpansion' WHEN t.key IS NULL AND w.braced THEN 'UndefinedVariable' WHEN t.key IS NULL THEN 'ok'
      WHEN len(w.path) >= 10 THEN 'ExpansionDepthExceeded' WHEN t.ref = '' THEN 'ok' END, w.value
  FROM walk w LEFT JOIN v t ON t.file_id = w.file_id AND t.key = w.ref WHERE w.state IS NULL)
SELECT file_id, key, CASE WHEN state = 'ok' THEN done END AS value, nullif(state, 'ok') AS error,
  CASE WHEN state = 'CircularExpansion' THEN array_to_string(path, ' → ') WHEN state <> 'ok' THEN path[len(path)] END AS detail FROM walk WHERE state IS NOT NULL"""


@query("expand_vars", _CHAIN)
def expand_vars(spark, sf):
    return X.expand(I.CHAINS.df(spark, sf)).select("file_id", "key", "value", "error", "detail")


@query("expand_configs", f"""{_PARSED}, {_VARS} SELECT v.file_id, v.key, replace(replace(v.value, '${{ORDER_ID}}', i.value), '$STATUS', coalesce(s.value, '$STATUS')) AS value
FROM vars v LEFT JOIN vars i ON i.file_id = v.file_id AND i.key = 'ORDER_ID' LEFT JOIN vars s ON s.file_id = v.file_id AND s.key = 'STATUS'""")
def expand_configs(spark, sf):
    # Every round looks the variables up: they are parsed and written once.
    vars_ = cut(E.parse_vars(I.CONFIGS.df(spark, sf)).select("project_id", "file_id", "key", "line_no", "value"))
    return X.expand(vars_).select("file_id", "key", "value")


@query("undefined_refs", f"""WITH v AS ({I.CHAINS.sql()}), r AS (SELECT file_id, key, regexp_extract(value, '\\$\\{{?([A-Za-z0-9_]+)\\}}?$', 1) AS name, contains(value, '{{') AS braced FROM v)
SELECT file_id, key, name, braced, CASE WHEN braced THEN 'UndefinedVariable' END AS error FROM r WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM v WHERE v.file_id = r.file_id AND v.key = r.name)""")
def undefined_refs(spark, sf):
    return X.undefined_references(I.CHAINS.df(spark, sf)).drop("project_id")


_ENV_WIDE = f"""env AS ({I.ENV.sql()}), w AS (SELECT project_id, {', '.join(f"max(value) FILTER (key = '{k}') AS {k}" for k in I.ENV_KEYS)} FROM env GROUP BY project_id)"""


@query("render_templates", f"""WITH {_ENV_WIDE}, t AS (SELECT * FROM ({I.TEMPLATES.sql()}) LEFT JOIN w USING (project_id)),
s AS (SELECT *, contains(body, '{{{{SERVER_PORT|int}}}}') AND NOT regexp_full_match(SERVER_PORT, '[+-]?[0-9]+') AS failed FROM t)
SELECT project_id, template_id, CASE WHEN NOT coalesce(failed, false) THEN
CASE WHEN API_URL IS NULL THEN body ELSE
replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(body, '${{API_URL}}', API_URL), '{{{{APP_NAME|upper}}}}', upper(APP_NAME)), '$DB_HOST:', DB_HOST || ':'),
'$SERVER_PORT/', SERVER_PORT || '/'), '{{{{DEBUG|bool}}}}', CASE WHEN lower(DEBUG) IN ('true', 'yes', '1') THEN 'true' ELSE 'false' END),
'{{{{SERVER_PORT|int}}}}', coalesce(CAST(TRY_CAST(SERVER_PORT AS BIGINT) AS VARCHAR), '')), '{{{{APP_NAME|json}}}}', CAST(to_json(APP_NAME) AS VARCHAR)),
'{{{{MAIL_FROM|default:nobody at all}}}}', CASE WHEN trim(MAIL_FROM) = '' THEN 'nobody at all' ELSE MAIL_FROM END),
'{{{{stripe_token|title}}}}', upper(left(stripe_token, 1)) || substr(stripe_token, 2)), '{{{{APP_NAME|lower}}}}', lower(APP_NAME)) END END AS text,
CASE WHEN failed THEN 'not an integer: SERVER_PORT' END AS error FROM s""")
def render_templates(spark, sf):
    return T.render(I.TEMPLATES.df(spark, sf), I.ENV.df(spark, sf))


_REFS = "(?:\\$\\{([A-Za-z_][A-Za-z0-9_]*)\\})|(?:\\{\\{([A-Za-z_][A-Za-z0-9_]*)(?:\\|[^}]+)?\\}\\})|(?:\\$([A-Za-z_][A-Za-z0-9_]*))\\b"


@query("template_references", f"""SELECT template_id, name, CAST(count(*) AS BIGINT) AS uses FROM (SELECT template_id, regexp_extract(unnest(regexp_extract_all(body, '{_REFS}')), '[A-Za-z_][A-Za-z0-9_]*') AS name
FROM ({I.TEMPLATES.sql()})) GROUP BY template_id, name""")
def template_references(spark, sf):
    return T.references(I.TEMPLATES.df(spark, sf)).groupBy("template_id", "name").agg(F.count(F.lit(1)).alias("uses"))


@query("template_undefined", f"""WITH r AS (SELECT DISTINCT project_id, template_id, regexp_extract(unnest(regexp_extract_all(body, '{_REFS}')), '[A-Za-z_][A-Za-z0-9_]*') AS name
FROM ({I.TEMPLATES.sql()})) SELECT template_id, name FROM r ANTI JOIN (SELECT project_id, key AS name FROM ({I.ENV.sql()})) USING (project_id, name)""")
def template_undefined(spark, sf):
    return T.undefined(I.TEMPLATES.df(spark, sf), I.ENV.df(spark, sf)).select("template_id", "name")
