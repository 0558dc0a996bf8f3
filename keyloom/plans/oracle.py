"""SQL fragments of the checking database, written apart from the Spark code."""

from __future__ import annotations

from keyloom.functions import secrets
from keyloom.functions.text import WHITESPACE, WS_CLASS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = lit(WHITESPACE)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def any_in(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def in_list(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(lit(w) for w in words)})"


def lines(source: str, keep_all: bool = False, keys: str = "project_id, file_id, path") -> str:
    """Rows (keys, line_no, line) of ``source``."""
    data = "" if keep_all else f" AND {trim('line')} <> '' AND NOT starts_with({trim('line')}, '#')"
    return f"""SELECT {keys}, CAST(n AS INTEGER) AS line_no, line FROM (
  SELECT {keys}, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM (
    SELECT {keys}, regexp_split_to_array(content, '\\r?\\n') AS ls FROM {source}))
WHERE NOT (line = '' AND n = total){data}"""


def placeholder(v: str) -> str:
    """The scan's placeholder test."""
    x = f"lower({trim(v)})"
    words = "|".join(secrets.PLACEHOLDER_WORDS)
    exact, parts = secrets.PLACEHOLDER_EXACT, secrets.PLACEHOLDER_PARTS
    return (
        f"({in_list(x, exact)} OR {any_in(x, parts)} OR regexp_matches({x}, '^(?:{words})(?:[0-9]*$|_)')"
        f" OR regexp_matches({x}, '^your[_-]')"
        f" OR ({x} <> '' AND strlen({x}) >= 3 AND {x} = repeat(left({x}, 1), CAST(length({x}) AS INTEGER)))"
        f" OR (regexp_full_match({x}, '[a-z0-9]{{6}}') AND length(regexp_replace({x}, '[0-9]', '', 'g')) = 3))"
    )


def entropy(v: str) -> str:
    return (
        f"(CASE WHEN {v} = '' THEN 0.0 ELSE -list_sum(list_transform(list_transform(list_distinct(string_split({v}, '')), "
        f"lambda c: (length({v}) - length(replace({v}, c, ''))) / length(c) / strlen({v})), lambda p: p * log2(p))) END)"
    )


def sensitive(key: str) -> str:
    return any_in(f"upper({key})", secrets.SENSITIVE_KEY_PARTS)


def preview(v: str) -> str:
    return f"(CASE WHEN length({v}) > 20 THEN left({v}, 8) || '...' || right({v}, 5) ELSE {v} END)"


# (condition on value v and key k, pattern, confidence, url) in priority order.
def _shapes(k: str, v: str) -> list[tuple[str, str, str, str]]:
    m = lambda regex: f"regexp_matches({v}, {lit(regex.removeprefix('(?U)'))})"
    name, _, regex, confidence, url = secrets.ACCESS_KEY_RULE
    near = any_in(f"upper({k})", ["AWS", "SECRET"])
    return [
        (m(regex), name, confidence, url),
        (f"({m(secrets.SECRET_RUN_RE)} AND {near} AND {entropy(v)} > 4.5)", "AWS Secret Access Key", "medium", url),
        *[(m(r), n, c, u or "") for n, _, r, c, u in secrets.VENDOR_RULES],
        (f"(strlen({v}) >= 32 AND {entropy(v)} > 4.8)", secrets.HIGH_ENTROPY_NAME, "low", ""),
    ]


def findings(units: str, extra: str = "") -> str:
    """Findings of units (project_id, file_id, path, line_no, key, value, variable)."""
    shapes = _shapes("key", "value")

    def case(i: int) -> str:
        body = " ".join(f"WHEN {s[0]} THEN {lit(s[i])}" for s in shapes)
        return f"CASE WHEN {placeholder('value')} THEN NULL {body} END"

    base = "project_id, file_id, path, line_no"
    config = any_in("lower(key)", secrets.CONFIG_KEY_PARTS)
    spot = "path || ':' || CAST(line_no AS VARCHAR) || CASE WHEN variable IS NULL THEN '' ELSE ' (' || variable || ')' END"
    return f"""SELECT {base}, detector, pattern, confidence, {preview('value')} AS value_preview, {spot} AS location, variable,
  nullif(action_url, '') AS action_url FROM (
  SELECT *, 'pattern-matcher' AS detector, {case(1)} AS pattern, {case(2)} AS confidence, {case(3)} AS action_url FROM ({units})
  UNION ALL
  SELECT *, 'config-key-matcher', 'Sensitive config key: ' || key, CASE WHEN strlen(value) < 16 THEN 'medium' ELSE 'high' END, ''
  FROM ({units}) WHERE {config} AND value <> '' AND NOT {placeholder('value')}
  {extra}) WHERE pattern IS NOT NULL"""


def kv_units(rows: str) -> str:
    """Pairs of the lines in ``rows``."""
    key = trim(f"regexp_replace({trim('line[:instr(line, chr(61)) - 1]')}, '^(export)+', '')")
    return (
        f"SELECT project_id, file_id, path, line_no, {key} AS key, {trim('substr(line, instr(line, chr(61)) + 1)')} AS value, "
        f"{key} AS variable FROM ({rows}) WHERE contains(line, '=')"
    )


def token_units(rows: str) -> str:
    split = f"unnest(regexp_split_to_array(line, {lit(f'[{WS_CLASS}=:' + chr(34) + chr(39) + ']')}))"
    return (
        f"SELECT project_id, file_id, path, line_no, '' AS key, value, CAST(NULL AS VARCHAR) AS variable FROM ("
        f"SELECT project_id, file_id, path, line_no, {split} AS value FROM ({rows})) WHERE strlen(value) > 20"
    )


def mixed_units(rows: str) -> str:
    return (
        kv_units(f"SELECT * FROM ({rows}) WHERE contains(path, '.env')") + " UNION ALL "
        + token_units(f"SELECT * FROM ({rows}) WHERE NOT contains(path, '.env')")
    )


COUNTS = """CAST(count(confidence) AS BIGINT) AS secrets_found,
  CAST(count(*) FILTER (confidence = 'high') AS BIGINT) AS high_confidence,
  CAST(count(*) FILTER (confidence = 'medium') AS BIGINT) AS medium_confidence,
  CAST(count(*) FILTER (confidence = 'low') AS BIGINT) AS low_confidence,
  coalesce(bool_or(confidence IN ('high', 'medium')), false) AS critical"""


def unescape(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(?s)\\\\.|[^\\\\]+|\\\\'), lambda t: CASE t "
        f"WHEN '\\n' THEN chr(10) WHEN '\\r' THEN chr(13) WHEN '\\t' THEN chr(9) WHEN '\\\\' THEN '\\' "
        f"WHEN '\\\"' THEN '\"' WHEN '\\''' THEN '''' ELSE t END), '')"
    )


def parsed(files: str) -> str:
    """CTEs ending in ``parsed``: the strict parse of ``files``, by a walk over the lines."""
    ws = WS_CLASS
    return f"""
files AS ({files}),
raw AS (SELECT project_id, file_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (
  SELECT project_id, file_id, path, regexp_split_to_array(content, '\\r?\\n') AS ls FROM files)),
cut AS (SELECT *, regexp_replace({trim('line')}, '^export[{ws}]+', '') AS body FROM raw),
pair AS (SELECT *, {trim('body[:instr(body, chr(61)) - 1]')} AS k, ltrim(substr(body, instr(body, '=') + 1), {WS}) AS v,
  contains(body, '=') AS has FROM cut),
opener AS (SELECT *, CASE WHEN has AND regexp_full_match(k, '[A-Za-z][A-Za-z0-9_]*') AND left(v, 1) IN (chr(34), chr(39), '`')
  AND NOT (length(v) >= 2 AND right(v, 1) = left(v, 1)) THEN left(v, 1) END AS oq FROM pair),
walk AS (
  SELECT file_id, n, n AS grp, oq, CASE WHEN oq IS NOT NULL THEN n END AS start, false AS ends FROM opener WHERE n = 1
  UNION ALL
  SELECT o.file_id, o.n,
    CASE WHEN w.oq IS NOT NULL THEN w.start ELSE o.n END,
    CASE WHEN w.oq IS NULL THEN o.oq WHEN ends_with(rtrim(o.line, {WS}), w.oq) THEN NULL ELSE w.oq END,
    CASE WHEN w.oq IS NULL THEN CASE WHEN o.oq IS NOT NULL THEN o.n END
         WHEN ends_with(rtrim(o.line, {WS}), w.oq) THEN NULL ELSE w.start END,
    w.oq IS NOT NULL AND ends_with(rtrim(o.line, {WS}), w.oq)
  FROM walk w JOIN opener o ON o.file_id = w.file_id AND o.n = w.n + 1),
stmt AS (SELECT o.project_id, o.file_id, o.path, w.grp AS n, bool_or(w.ends) AS ended, bool_or(o.oq IS NOT NULL AND o.n = w.grp) AS multi,
    string_agg(CASE WHEN o.oq IS NOT NULL AND o.n = w.grp THEN rtrim(o.line, {WS}) ELSE o.line END, chr(10) ORDER BY o.n) AS line
  FROM opener o JOIN walk w ON o.file_id = w.file_id AND o.n = w.n GROUP BY ALL),
again AS (SELECT *, regexp_replace({trim('line')}, '^export[{ws}]+', '') AS body FROM stmt
  WHERE {trim('line')} <> '' AND (multi OR NOT starts_with({trim('line')}, '#'))),
kv AS (SELECT *, CASE WHEN contains(body, '=') THEN {trim('body[:instr(body, chr(61)) - 1]')} END AS key,
  CASE WHEN contains(body, '=') THEN substr(body, instr(body, '=') + 1) END AS raw_value FROM again),
qv AS (SELECT *, ltrim(raw_value, {WS}) AS v,
  CASE WHEN left(ltrim(raw_value, {WS}), 1) IN (chr(34), chr(39), '`') THEN left(ltrim(raw_value, {WS}), 1) END AS quote FROM kv),
err AS (SELECT *, CASE WHEN key IS NULL THEN 'InvalidFormat' WHEN NOT regexp_full_match(key, '[A-Za-z][A-Za-z0-9_]*') THEN 'InvalidKey'
  WHEN quote IS NOT NULL AND multi AND NOT ended THEN 'UnterminatedString' END AS error FROM qv),
parsed AS (SELECT project_id, file_id, path, CAST(n AS INTEGER) AS line_no, key, raw_value, CASE WHEN error IS NOT NULL THEN NULL
  WHEN quote IS NULL THEN {trim("split_part(v, '#', 1)")}
  WHEN quote = chr(34) AND NOT multi THEN {unescape('v[2:length(v) - 1]')} ELSE v[2:length(v) - 1] END AS value, quote, error FROM err)"""
