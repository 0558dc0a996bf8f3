"""Rule validation of project variables, fixes, and line-preserving rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import checks
from keyloom.functions.text import any_contains, trim
from keyloom.operators.extract import to_lines
from keyloom.operators.joins import join_skewed

# Files that mark a project as containerised.
CONTAINER_FILES = ["docker-compose.yml", "docker-compose.yaml", "Dockerfile", "Containerfile"]
ISSUE_COLUMNS = ["project_id", "severity", "type", "variable", "message", "location", "suggestion", "auto_fixable"]


def _issue(severity: str, kind: str, message: Column, location: Column, suggestion: Column, fixable: bool) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(kind).alias("type"), message.alias("message"),
        location.alias("location"), suggestion.cast("string").alias("suggestion"),
        F.lit(fixable).alias("auto_fixable"),
    )


def row_issues(env_path: str, validate_formats: bool) -> dict[str, tuple[Column, Column]]:
    """Checks that need one variable only: name -> (condition, issue)."""
    key, value = F.col("key"), F.col("value")
    up, loc = F.upper(key), F.lit(f"{env_path}:?")
    says = lambda text: F.concat(key, F.lit(text))
    out = {
        "placeholder_value": (
            checks.is_placeholder(value),
            _issue("error", "placeholder_value", says(" looks like a placeholder"), loc,
                   F.when(key == "SECRET_KEY", "Run: openssl rand -hex 32")
                   .when(key.contains("AWS"), "Get from AWS Console")
                   .when(key.contains("STRIPE"), "Get from Stripe Dashboard"), True),
        ),
        "boolean_trap": (
            checks.is_boolean_trap(value),
            _issue("warning", "boolean_trap",
                   F.concat(key, F.lit(' is set to "'), value, F.lit('" (string, not boolean)')), loc,
                   F.concat(F.lit("Use "), F.lower(value), F.lit(" or 0 for proper boolean handling")), True),
        ),
        "weak_secret": (
            (key == "SECRET_KEY") & checks.is_weak_secret(value),
            _issue("error", "weak_secret", F.lit("SECRET_KEY is too weak or predictable"), loc,
                   F.lit("Run: openssl rand -hex 32"), True),
        ),
        "localhost_in_docker": (
            checks.points_to_localhost(key, value),
            _issue("warning", "localhost_in_docker", says(" uses localhost/127.0.0.1"), loc,
                   F.lit("In Docker, use service name instead (e.g., db:5432)"), False),
        ),
    }
    if validate_formats:
        filled = value != ""
        out["invalid_url"] = (
            any_contains(up, ["URL", "URI", "ENDPOINT"]) & filled & ~checks.is_url(value),
            _issue("warning", "invalid_url", says(" does not appear to be a valid URL"), loc,
                   F.lit("Expected format: https://example.com/path"), False),
        )
        out["invalid_port"] = (
            up.contains("PORT") & filled & ~checks.is_port(value),
            _issue("error", "invalid_port", says(" is not a valid port number (1-65535)"), loc,
                   F.lit("Expected format: 8080"), False),
        )
        out["invalid_email"] = (
            any_contains(up, ["EMAIL", "MAIL"]) & filled & ~checks.is_email(value),
            _issue("warning", "invalid_email", says(" does not appear to be a valid email"), loc,
                   F.lit("Expected format: user@example.com"), False),
        )
    return out


def container_projects(files: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    return files.filter(name.isin(CONTAINER_FILES)).select("project_id").distinct()


def missing_keys(env: DataFrame, example: DataFrame) -> DataFrame:
    return example.select("project_id", "key").join(env.select("project_id", "key"), ["project_id", "key"], "left_anti")


def validate(
    env: DataFrame,
    example: DataFrame,
    containers: DataFrame | None = None,
    env_path: str = ".env",
    strict: bool = False,
    validate_formats: bool = True,
    ignore: list[str] | None = None,
) -> DataFrame:
    """Issues table. ``env``/``example`` hold one row per (project, key).

    All single-variable checks run in one pass over ``env``; the key comparison is
    one join on (project, key); only rows that mention localhost meet the (distinct)
    container projects.
    """
    ignore = ignore or []
    checks_ = {k: v for k, v in row_issues(env_path, validate_formats).items() if k not in ignore}
    parts = []
    local = {k: v for k, v in checks_.items() if k != "localhost_in_docker"}
    if local:
        found = F.array_compact(F.array(*[F.when(c, i) for c, i in local.values()]))
        parts.append(
            env.select("project_id", F.col("key").alias("variable"), F.explode(found).alias("i"))
            .select("project_id", "variable", "i.*")
        )
    if containers is not None and "localhost_in_docker" in checks_:
        cond, issue = checks_["localhost_in_docker"]
        rows = env.filter(cond).select("project_id", F.col("key").alias("variable"), issue.alias("i"))
        inside = join_skewed(rows, containers, "project_id", "left_semi")
        parts.append(inside.select("project_id", "variable", "i.*"))

    want_missing = "missing_variable" not in ignore
    want_extra = strict and "extra_variable" not in ignore
    loc, key = F.lit(f"{env_path}:?"), F.col("key")
    missing = _issue(
        "error", "missing_variable", F.concat(F.lit("Missing required variable: "), key), loc,
        F.concat(F.lit("Add "), key, F.lit(f"=<value> to {env_path}")), True,
    )
    extra = _issue(
        "warning", "extra_variable", F.concat(F.lit("Extra variable not in .env.example: "), key), loc,
        F.concat(F.lit("Add "), key, F.lit(f" to .env.example or remove from {env_path}")), False,
    )
    if want_extra:
        sides = env.select("project_id", "key", F.lit(1).alias("_e")).join(
            example.select("project_id", "key", F.lit(1).alias("_x")), ["project_id", "key"], "full_outer"
        )
        which = F.when(F.col("_e").isNull(), missing if want_missing else F.lit(None)).when(F.col("_x").isNull(), extra)
        rows = sides.select("project_id", key.alias("variable"), which.alias("i")).filter(F.col("i").isNotNull())
        parts.append(rows.select("project_id", "variable", "i.*"))
    elif want_missing:
        rows = missing_keys(env, example).select("project_id", key.alias("variable"), missing.alias("i"))
        parts.append(rows.select("project_id", "variable", "i.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*ISSUE_COLUMNS)


# -- fixes ---------------------------------------------------------------------

def suggest_fix(kind: Column, key: Column, value: Column) -> Column:
    """(action, new_value) for an issue kind; ``new_value`` is null where a secret must be made."""
    secretish = any_contains(F.upper(key), ["SECRET", "KEY"])
    fix = lambda action, new: F.struct(
        F.lit(action).alias("action"), (F.lit(new) if not isinstance(new, Column) else new).cast("string").alias("new_value")
    )
    sample = (
        F.when(key.contains("URL"), "https://example.com")
        .when(any_contains(key, ["EMAIL", "MAIL"]), "user@example.com")
        .when(key.contains("PORT"), "8080")
        .otherwise("your_value_here")
    )
    return (
        F.when((kind == "placeholder_value") & secretish, fix("generate_secret", None))
        .when(kind == "placeholder_value", fix("replace_placeholder", sample))
        .when(kind == "boolean_trap", fix("fix_boolean", F.when(F.lower(value) == "true", "true").otherwise("false")))
        .when(kind == "weak_secret", fix("generate_secret", None))
        .when(
            kind == "missing_variable",
            fix("add_missing", F.when(secretish, "CHANGE_ME_SECURE_32_CHARS_MIN").otherwise("your_value_here")),
        )
        .otherwise(fix("skip", None))
    )


def plan_fixes(
    env: DataFrame,
    example: DataFrame,
    ignore: list[str] | None = None,
    secret: Column | None = None,
) -> DataFrame:
    """Every fix, in application order ``prio`` (missing, placeholder, boolean, weak secret).

    ``secret`` builds the value of a generated secret; without it the action is
    listed with a null value and leaves the variable alone.
    """
    ignore = ignore or []
    key, value = F.col("key"), F.col("value")
    conds = {k: c for k, (c, _) in row_issues(".env", False).items()}
    entries = []
    for prio, kind in ((2, "placeholder_value"), (3, "boolean_trap"), (4, "weak_secret")):
        if kind not in ignore:
            entry = F.struct(F.lit(prio).alias("prio"), suggest_fix(F.lit(kind), key, value).alias("fix"))
            entries.append(F.when(conds[kind], entry))
    parts = []
    if entries:
        parts.append(
            env.select("project_id", key, value.alias("old_value"),
                       F.explode(F.array_compact(F.array(*entries))).alias("e"))
            .select("project_id", "key", "e.prio", "e.fix.action", "old_value", "e.fix.new_value")
        )
    if "missing_variable" not in ignore:
        none = F.lit(None).cast("string")
        parts.append(
            missing_keys(env, example)
            .select("project_id", "key", F.lit(1).alias("prio"),
                    suggest_fix(F.lit("missing_variable"), key, none).alias("fix"))
            .select("project_id", "key", "prio", "fix.action", none.alias("old_value"), "fix.new_value")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if secret is not None:
        made = F.when(F.col("action") == "generate_secret", secret).otherwise(F.col("new_value"))
        out = out.withColumn("new_value", made)
    return out


def apply_fixes(env: DataFrame, fixes: DataFrame) -> DataFrame:
    """Variables after the fixes; for one key the last fix in order wins.

    ``max_by`` pre-aggregates, so the join meets at most one fix per (project, key).
    """
    final = fixes.filter(F.col("new_value").isNotNull()).groupBy("project_id", "key").agg(
        F.max_by("new_value", "prio").alias("_new")
    )
    joined = env.select("project_id", "key", "value", "pos").join(final, ["project_id", "key"], "full_outer")
    return joined.select(
        "project_id", "key", F.coalesce("_new", "value").alias("value"), "pos",
        F.col("_new").isNotNull().alias("fixed"),
    )


def rewrite_lines(files: DataFrame, values: DataFrame) -> DataFrame:
    """Ordered lines of the rewritten files ``(file_id, section, line_no, text)``.

    Comments, blank and malformed lines stay; ``k=v`` lines take the value of
    ``values(file_id, key, value, pos)``; keys whose ``KEY=`` occurs nowhere in the
    text are appended (section 1, in ``pos`` order).
    """
    lines = to_lines(files.select("file_id", "content"), keep="all")
    line, text = F.col("line"), trim("line")
    assigns = (text != "") & ~text.startswith("#") & line.contains("=")
    name = trim(F.substring_index(line, "=", 1))
    # Lines without a key take one no variable can have, so they neither match nor
    # pile up under one null.
    own = F.concat(F.lit("\n"), F.col("line_no").cast("string"))
    keyed = lines.withColumn("_k", F.when(assigns, name).otherwise(own))
    new = values.select("file_id", F.col("key").alias("_k"), F.col("value").alias("_v"), F.col("pos").cast("bigint").alias("_p"))
    both = keyed.join(new, ["file_id", "_k"], "full_outer")
    assignment = F.concat("_k", F.lit("="), "_v")
    kept = both.filter(F.col("line_no").isNotNull()).select(
        "file_id", F.lit(0).alias("section"), "line_no",
        F.when(F.col("_v").isNull(), line).otherwise(assignment).alias("text"),
    )
    lost = both.filter(F.col("line_no").isNull()).select("file_id", "_k", "_v", "_p")
    present = assigned_names(files, lost)
    known = files.filter(F.col("content").isNotNull()).select("file_id")
    appended = (
        lost.join(known, "file_id", "left_semi").join(present, ["file_id", "_k"], "left_anti")
        .select("file_id", F.lit(1).alias("section"), F.col("_p").alias("line_no"), assignment.alias("text"))
    )
    return kept.unionByName(appended)


def assigned_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """``(file_id, _k)`` of the ``names`` that stand right before a ``=`` anywhere in their file's text.

    A file's text is met once, whatever the number of its names: what precedes each ``=`` is
    cut to the lengths that the file's names have, and the pieces meet the names in a join.
    Names that hold a ``=`` themselves cannot come from a line; the few that there may be
    are looked up one by one.
    """
    plain = names.filter(~F.col("_k").contains("="))
    # a file's distinct lengths, not its names
    lengths = plain.groupBy("file_id").agg(F.collect_set(F.char_length("_k")).alias("_lengths"))
    texts = files.select("file_id", "content").join(lengths, "file_id")
    before = F.split("content", "=")
    pieces = texts.select("file_id", "_lengths", F.explode(F.slice(before, F.lit(1), F.size(before) - 1)).alias("_before"))
    tail = pieces.withColumn("_before", F.right("_before", F.array_max("_lengths")))
    ends = F.transform(F.filter("_lengths", lambda n: n <= F.char_length("_before")), lambda n: F.right("_before", n))
    found = tail.select("file_id", F.explode(ends).alias("_k")).distinct()
    odd = names.filter(F.col("_k").contains("=")).select("file_id", "_k").join(files.select("file_id", "content"), "file_id").filter(
        F.contains("content", F.concat("_k", F.lit("=")))
    )
    return found.unionByName(odd.select("file_id", "_k"))


def summarise(
    issues: DataFrame, env: DataFrame, example: DataFrame, fixes: DataFrame | None = None
) -> DataFrame:
    """Report per project. ``required_present`` is a minimum of counts, as reported
    by the tool users know; ``required_matched`` is the true overlap.
    """
    counts = issues.groupBy("project_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "style").alias("style"),
    )
    marks = env.select("project_id", "key", F.lit(1).alias("e"), F.lit(0).alias("x")).unionByName(
        example.select("project_id", "key", F.lit(0).alias("e"), F.lit(1).alias("x"))
    )
    per_key = marks.groupBy("project_id", "key").agg(F.max("e").alias("e"), F.max("x").alias("x"))
    sizes = per_key.groupBy("project_id").agg(
        F.sum("e").alias("n_env"), F.sum("x").alias("required_total"),
        F.sum(F.col("e") * F.col("x")).alias("required_matched"),
        F.count_if((F.col("e") == 0) & (F.col("x") == 1)).alias("n_missing"),
    )
    out = sizes.join(counts, "project_id", "left")
    added = F.lit(0)
    if fixes is not None:
        applied = fixes.filter(F.col("new_value").isNotNull()).groupBy("project_id").agg(
            F.count(F.lit(1)).alias("fixed_count"),
            F.count_if(F.col("action") == "add_missing").alias("_added"),
        )
        out = out.join(applied, "project_id", "left")
        added = F.coalesce("_added", F.lit(0))
    else:
        out = out.withColumn("fixed_count", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "project_id",
        F.when(F.coalesce("errors", F.lit(0)) > 0, "failed").otherwise("passed").alias("status"),
        zero("errors"), zero("warnings"), zero("style"), zero("fixed_count"),
        F.least(F.col("n_env") + added, F.col("required_total")).cast("bigint").alias("required_present"),
        zero("required_total"), zero("required_matched"),
    )
