"""Scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import secrets, text
from keyloom.operators import detect, pattern_table, rule_table
from keyloom.operators.extract import to_lines
from keyloom.plans import inputs as I
from keyloom.plans import oracle as O
from keyloom.plans.registry import query
from keyloom.sources import files as paths
from keyloom.sources import reports

FINDING = ["project_id", "file_id", "path", "line_no", "detector", "pattern", "confidence", "value_preview", "location",
           "variable", "action_url"]


def _files(d: I.Derived) -> str:
    return f"({d.sql()})"


def _found(d: I.Derived, units=O.mixed_units) -> str:
    return O.findings(units(O.lines(_files(d))))


def _rollup(d: I.Derived) -> str:
    return f"""WITH files AS ({d.sql()}), found AS ({_found(d)})
SELECT f.file_id, {O.COUNTS} FROM files f LEFT JOIN found x ON x.file_id = f.file_id GROUP BY f.file_id"""


@query("scan_rollup", _rollup(I.DOCS))
def scan_rollup(spark, sf):
    return detect.scan_rollup(I.DOCS.df(spark, sf), ["file_id"])


@query("scan_rollup_pages", _rollup(I.PAGES))
def scan_rollup_pages(spark, sf):
    return detect.scan_rollup(I.PAGES.df(spark, sf), ["file_id"])


@query("scan_findings_kv", _found(I.DOCS_ENV))
def scan_findings_kv(spark, sf):
    return detect.scan(I.DOCS_ENV.df(spark, sf)).select(*FINDING)


@query("scan_findings_token", _found(I.TOKEN_PAGES))
def scan_findings_token(spark, sf):
    return detect.scan(I.TOKEN_PAGES.df(spark, sf)).select(*FINDING)


@query("scan_tokens", f"""SELECT file_id, line_no, CAST(count(*) AS BIGINT) AS n_tokens, max(value) AS last_token
FROM ({O.token_units(O.lines(_files(I.PAGES)))}) GROUP BY file_id, line_no""")
def scan_tokens(spark, sf):
    units = detect.line_units(to_lines(I.PAGES.df(spark, sf)), F.lit(False))
    return units.groupBy("file_id", "line_no").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.max("value").alias("last_token")
    )


@query("scan_patterns_derived", _found(I.SECRETS))
def scan_patterns_derived(spark, sf):
    return detect.scan(I.SECRETS.df(spark, sf)).select(*FINDING)


@query("confidence_summary", f"""WITH files AS ({I.SECRETS.sql()}), found AS ({_found(I.SECRETS)}),
marks AS (SELECT project_id, 1 AS f, NULL AS confidence FROM files UNION ALL SELECT project_id, 0, confidence FROM found)
SELECT project_id, CAST(sum(f) AS BIGINT) AS files_scanned, {O.COUNTS} FROM marks GROUP BY project_id""")
def confidence_summary(spark, sf):
    files = I.SECRETS.df(spark, sf)
    return detect.scan_summary(files, detect.scan(files))


@query("entropy", f"""WITH c AS (SELECT doc_id, strlen(text) AS n, unnest(string_split(text, '')) AS c FROM documents),
p AS (SELECT doc_id, c, count(*) / any_value(n) AS p FROM c GROUP BY doc_id, c)
SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY doc_id""")
def entropy(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.round(secrets.entropy("text"), 6).alias("entropy"))


@query("placeholder_flags", f"""SELECT id, {O.placeholder('v')} AS is_placeholder FROM ({I.PLACEHOLDER_VALUES.sql()})""")
def placeholder_flags(spark, sf):
    return I.PLACEHOLDER_VALUES.df(spark, sf).select("id", secrets.is_placeholder("v").alias("is_placeholder"))


_RULES = [
    {"name": "card", "regex": r"(?:^|[^0-9])[0-9]{16}(?:[^0-9]|$)", "confidence": "medium", "prio": 1},
    {"name": "dotted", "regex": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "confidence": "low", "prio": 2},
    {"name": "generic", "regex": secrets.GENERIC_API_KEY_RE, "confidence": "low", "prio": 3},
]


@query("rule_findings", f"""SELECT file_id, line_no, {O.preview('line')} AS value_preview, CASE WHEN c THEN 'card' WHEN d THEN 'dotted' ELSE 'generic' END AS pattern,
CASE WHEN c THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, regexp_matches(line, {O.lit(_RULES[0]['regex'])}) AS c,
regexp_matches(line, {O.lit(_RULES[1]['regex'])}) AS d, regexp_matches(line, {O.lit(_RULES[2]['regex'])}) AS g FROM ({O.lines(_files(I.DOCS))})) WHERE c OR d OR g""")
def rule_findings(spark, sf):
    lines = to_lines(I.DOCS.df(spark, sf))
    return detect.scan_lines(lines, [secrets.rules_detector(_RULES)]).select(
        "file_id", "line_no", "value_preview", "pattern", "confidence"
    )


@query("custom_detectors", O.findings(O.mixed_units(O.lines(_files(I.SECRETS))), """
  UNION ALL SELECT *, 'rules', 'starts with pw', 'low', '' FROM (""" + O.mixed_units(O.lines(_files(I.SECRETS))) + f""")
  WHERE regexp_matches(value, '^pw[0-9a-f]+$') AND NOT {O.placeholder('value')}"""))
def custom_detectors(spark, sf):
    rules = secrets.rules_detector([{"name": "starts with pw", "regex": r"\Apw[0-9a-f]+\z", "confidence": "low"}])
    return detect.scan(I.SECRETS.df(spark, sf), [*secrets.DEFAULT_DETECTORS, rules]).select(*FINDING)


@query("line_rules", f"""SELECT file_id, line_no FROM ({O.lines(_files(I.SECRETS))})
WHERE contains(line, '-----BEGIN ') AND regexp_matches(line, '-----BEGIN [A-Z ]+ PRIVATE KEY-----')
AND NOT {O.placeholder('line')}""")
def line_rules(spark, sf):
    pem = secrets.rules_detector([{"name": "Private Key", "regex": secrets.VENDOR_RULES[-1][2], "confidence": "high"}])
    lines = to_lines(I.SECRETS.df(spark, sf))
    return detect.scan_lines(lines.filter(~secrets.is_placeholder("line")), [pem]).select("file_id", "line_no")


@query("sarif_rows", f"""SELECT file_id, '{{"ruleId":' || to_json('secret/' || replace(lower(pattern), ' ', '-')) || ',"level":"'
|| CASE confidence WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":'
|| to_json(pattern || ' detected') || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(path)
|| '}},"region":{{"startLine":' || line_no || '}}}}}}]}}' AS result FROM ({_found(I.SECRETS)})""")
def sarif_rows(spark, sf):
    return reports.sarif_rows(detect.scan(I.SECRETS.df(spark, sf)), ["file_id"])


_SARIF_HEAD = ('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"keyloom scan","version":"1"}},"results":[')


@query("sarif_documents", f"""WITH r AS (SELECT project_id, file_id, line_no, '{{"ruleId":' || to_json('secret/' || replace(lower(pattern), ' ', '-')) || ',"level":"'
|| CASE confidence WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":'
|| to_json(pattern || ' detected') || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(path)
|| '}},"region":{{"startLine":' || line_no || '}}}}}}]}}' AS result FROM ({_found(I.SECRETS)})),
f AS (SELECT *, min(struct_pack(a := file_id, b := line_no, c := result)) OVER (PARTITION BY project_id) AS first FROM r)
SELECT project_id, 1 AS section, file_id, line_no, CASE WHEN struct_pack(a := file_id, b := line_no, c := result) = first THEN '' ELSE ',' END || result AS text FROM f
UNION ALL SELECT DISTINCT project_id, 0, NULL, NULL, {O.lit(_SARIF_HEAD)} FROM r UNION ALL SELECT DISTINCT project_id, 2, NULL, NULL, ']}}]}}' FROM r""")
def sarif_documents(spark, sf):
    return reports.sarif_documents(detect.scan(I.SECRETS.df(spark, sf)))


@query("report_json", f"""SELECT file_id, '{{"pattern":' || to_json(pattern) || ',"confidence":"' || confidence || '","value_preview":' || to_json(value_preview)
|| ',"location":' || to_json(location) || ',"variable":' || coalesce(to_json(variable), 'null') || ',"action_url":' || coalesce(to_json(action_url), 'null')
|| '}}' AS json FROM ({_found(I.SECRETS)})""")
def report_json(spark, sf):
    found = detect.scan(I.SECRETS.df(spark, sf))
    fields = ["pattern", "confidence", "value_preview", "location", "variable", "action_url"]
    return reports.json_rows(found.select("file_id", *fields), ["file_id"])


_SIZES = "CASE WHEN x < 1024 THEN printf('%.2f B', x) WHEN x < 1048576 THEN printf('%.2f KB', x / 1024) WHEN x < 1073741824 THEN printf('%.2f MB', x / 1048576) WHEN x < 1099511627776 THEN printf('%.2f GB', x / 1073741824) ELSE printf('%.2f TB', x / 1099511627776) END"


@query("string_helpers", f"""SELECT doc_id, CASE WHEN strlen(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS truncated,
CASE WHEN strlen(t) <= 8 THEN repeat('*', CAST(strlen(t) AS INTEGER)) ELSE left(t, 4) || '...****' END AS redacted,
CASE WHEN k = 1 THEN '1 file' ELSE k || ' files' END AS counted, {_SIZES} AS size,
{O.sensitive("secret_key")} AS sensitive, contains(text, 'token') AS mentions
FROM (SELECT d.doc_id, text, split_part(text, ' ', 1) AS t, d.doc_id % 4 AS k, CAST(n_chars AS DOUBLE) * n_chars * n_chars AS x, secret_key
FROM documents d JOIN ({I.SECRET_VALUES.sql()}) s ON s.doc_id = d.doc_id)""")
def string_helpers(spark, sf):
    docs = I.Derived("documents", {"doc_id": "doc_id", "text": "text", "n_chars": "n_chars", "secret_key": I.SECRET_VALUES.columns["secret_key"]}).df(spark, sf)
    size = F.col("n_chars").cast("double") * F.col("n_chars") * F.col("n_chars")
    return docs.select(
        "doc_id",
        text.truncate("text", 40).alias("truncated"),
        text.redact(F.substring_index("text", " ", 1)).alias("redacted"),
        text.pluralize(F.col("doc_id") % 4, "file", "files").alias("counted"),
        text.human_readable_size(size).alias("size"),
        secrets.is_sensitive_key("secret_key").alias("sensitive"),
        F.col("text").contains("token").alias("mentions"),
    )


_EXCLUDE = ["logs/*.json", "notes", "c?nf/*"]
_BUILT_IN, _EXT = paths.ALWAYS_EXCLUDED, paths.SCANNABLE_EXTENSIONS


@query("path_filter", f"""WITH p AS (SELECT file_id, path, regexp_extract(path, '[^/]*$') AS name FROM ({I.INVENTORY.sql()})),
e AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN lower(regexp_extract(name, '[^.]*$')) END AS ext FROM p)
SELECT file_id, path, regexp_matches(path, '^logs/.*\\.json$') OR regexp_matches(path, '^c.nf/.*$') OR contains(path, 'notes') OR {O.any_in('path', _BUILT_IN)} AS excluded,
(ext IS NOT NULL AND {O.in_list('ext', _EXT)}) OR (ext IS NULL AND (starts_with(name, '.env') OR name IN ('Dockerfile', 'Makefile'))) AS scannable,
contains(path, 'app') AS found FROM e""")
def path_filter(spark, sf):
    return I.INVENTORY.df(spark, sf).select(
        "file_id", "path", paths.is_excluded("path", _EXCLUDE).alias("excluded"),
        paths.is_scannable("path").alias("scannable"), F.col("path").contains("app").alias("found"),
    )


# As many exclude patterns as suppliers, globs and plain parts, beside the regex that means the same.
_N = I.text("s_suppkey")
EXCLUDES = I.Derived("supplier", {
    "pattern": I.pick("s_suppkey", [f"concat('*', {_N}, '/src/*')", f"concat('*', {_N}, '?/*.y[am]*')", f"concat({_N}, '/docs')", f"concat('*', {_N}, '/**/a.json')", f"concat('*', {_N}, '/notes.??')", f"concat({_N}, '/*[!a-z]*')"]),
    "regex": I.pick("s_suppkey", [f"concat('^.*', {_N}, '/src/.*$')", f"concat('^.*', {_N}, './.*[.]y[am].*$')", f"concat({_N}, '/docs')", f"concat('^.*', {_N}, '/(.*/)?a[.]json$')", f"concat('^.*', {_N}, '/notes[.]..$')", f"concat('^', {_N}, '/.*[^a-z].*$')"]),
})
_IN_FOLDERS = I.Derived(I.INVENTORY, {"file_id": "file_id", "path": "concat(file_id, '/', path)"})


@query("exclude_table", f"""SELECT DISTINCT path, pattern FROM ({_IN_FOLDERS.sql()}) JOIN ({EXCLUDES.sql()}) ON regexp_matches(path, regex)""")
def exclude_table(spark, sf):
    return pattern_table.excluded_paths(_IN_FOLDERS.df(spark, sf), EXCLUDES.df(spark, sf))


@query("exclude_table_targets", f"""SELECT file_id, path FROM ({_IN_FOLDERS.sql()}) i WHERE NOT {O.any_in('path', _BUILT_IN)}
AND NOT EXISTS (SELECT 1 FROM ({EXCLUDES.sql()}) WHERE regexp_matches(i.path, regex))""")
def exclude_table_targets(spark, sf):
    return pattern_table.without_excluded(_IN_FOLDERS.df(spark, sf), EXCLUDES.df(spark, sf)).select("file_id", "path")


@query("scan_targets", f"""SELECT file_id FROM ({I.INVENTORY.sql()}) WHERE regexp_matches(path, '(^|/)(\\.env|Dockerfile|Makefile|[^/]+\\.(json|yml|yaml|toml|txt|py|js))$')
AND NOT {O.any_in('path', _BUILT_IN)}""")
def scan_targets(spark, sf):
    return paths.scan_targets(I.INVENTORY.df(spark, sf)).select("file_id")


# Every page's bytes; some get a byte that UTF-8 never has, or a NUL, behind them.
_RAW = f"concat(hex(encode(html)), {I.pick('page_id', [repr(''), repr('FF'), repr('00'), repr('C3'), repr('C3A9')])})"


@query("text_gate", f"""SELECT page_id, TRY(decode(unhex(h))) IS NOT NULL AND NOT regexp_matches(h, '^(..)*00') AS is_text FROM (
SELECT page_id, {_RAW} AS h FROM pages)""")
def text_gate(spark, sf):
    raw = F.unhex(F.expr(_RAW.replace("encode(html)", "encode(html, 'UTF-8')")))
    return I.table(spark, sf, "pages").select("page_id", paths.is_text(raw).alias("is_text"))


@query("find_files", f"SELECT file_id, path FROM ({I.INVENTORY.sql()}) WHERE contains(path, 'app')")
def find_files(spark, sf):
    return paths.find_files(I.INVENTORY.df(spark, sf), "app").select("file_id", "path")


@query("history_pickaxe", """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, turn AS ver, CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS INTEGER) AS occurrences FROM conversations),
l AS (SELECT *, coalesce(lag(occurrences) OVER (PARTITION BY file_id ORDER BY ver), 0) AS previous FROM c)
SELECT file_id, ver, previous, occurrences FROM l WHERE occurrences <> previous""")
def history_pickaxe(spark, sf):
    return detect.history(I.VERSIONS.df(spark, sf), "en")


# As many rules as suppliers: some with a literal that no value has, some without any.
_S = "s_suppkey"
RULE_TABLE = I.Derived("supplier", {
    "name": f"concat('rule', {I.text(_S)})",
    "regex": I.pick(_S, [f"concat('^sk_live_[0-9a-f]*', substr(md5({I.text(_S)}), 1, 1), '$')", f"concat('ghp_', substr(md5({I.text(_S)}), 1, 2))", f"concat('never', {I.text(_S)}, '[a-z]+')",
                         f"concat('(pw|sk)[-_]?[0-9a-f]', substr(md5({I.text(_S)}), 1, 2))", f"concat('example', {I.text(_S)}, '?$')"]),
    "confidence": I.pick(_S, ["'high'", "'medium'", "'low'"]), "action_url": "s_name", "prio": "cast(s_suppkey % 11 as int)",
})


@query("rule_table_findings", f"""SELECT doc_id, pattern, confidence, action_url FROM (
SELECT v.doc_id, r.name AS pattern, r.confidence, r.action_url, row_number() OVER (PARTITION BY v.doc_id ORDER BY r.prio, r.name, r.regex) AS place
FROM ({I.SECRET_VALUES.sql()}) v JOIN ({RULE_TABLE.sql()}) r ON regexp_matches(v.secret_value, r.regex)) WHERE place = 1""")
def rule_table_findings(spark, sf):
    values = I.SECRET_VALUES.df(spark, sf).select("doc_id", F.col("secret_value").alias("value"))
    return rule_table.scan_rules(values, RULE_TABLE.df(spark, sf), ["doc_id"])


@query("history_by_time", """WITH c AS (SELECT user_id, ts, event_id, CAST((length(event_type) - length(replace(event_type, 'e', ''))) AS INTEGER) AS occurrences FROM events),
u AS (SELECT user_id, ts, max(occurrences) AS occurrences FROM c GROUP BY user_id, ts),
l AS (SELECT *, coalesce(lag(occurrences) OVER (PARTITION BY user_id ORDER BY ts), 0) AS previous FROM u)
SELECT user_id, ts, previous, occurrences FROM l WHERE occurrences <> previous""")
def history_by_time(spark, sf):
    count = F.char_length("event_type") - F.char_length(F.replace("event_type", F.lit("e"), F.lit("")))
    events = I.table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max(count.cast("int")).alias("n"))
    return detect.history(events.select("user_id", "ts", F.repeat(F.lit("e"), F.col("n")).alias("content")), "e", by=("user_id",), order="ts")
