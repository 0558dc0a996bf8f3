"""Expansion of ``${NAME}`` / ``$NAME`` inside a file's own variables.

Only values that hold a reference take part. A value is a list of pieces, each a literal
text with at most one open reference behind it; a piece is a row of its own. Each round
joins the open references on (file, name) and puts the pieces of the named value in their
place, so the number of rounds is the nesting depth, not the number of keys. A round is one
exchange of pieces; they are put together once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 10
# Plain runs, ${..} (to the end of the text if unclosed), $name, lone $.
_SEGMENTS = r"(?s)[^$]+|\$\{[^}]*\}?|\$[A-Za-z0-9_]+|\$"
# A literal (lone $ included) and the reference behind it.
_REF = r"\$\{[^}]*\}?|\$[A-Za-z0-9_]+"
_PIECES = rf"(?s)(?:[^$]++|\$(?![{{A-Za-z0-9_]))*+(?:{_REF})?"
_FILE = ["project_id", "file_id"]


def _name(segment: Column) -> Column:
    braced = F.regexp_replace(F.substr(segment, F.lit(3)), r"\}\z", "")
    return F.when(segment.startswith("${"), braced).when(F.char_length(segment) > 1, F.substr(segment, F.lit(2)))


def segments(value: Column | str) -> Column:
    """Segments of a raw value: kind ``lit`` or ``ref``, in text order."""
    return F.transform(
        F.regexp_extract_all(value, F.lit(_SEGMENTS), F.lit(0)),
        lambda s: F.struct(
            F.when(s.startswith("$") & (F.char_length(s) > 1), "ref").otherwise("lit").alias("kind"),
            s.alias("text"),
            F.when(s.startswith("$"), _name(s)).alias("name"),
            F.array().cast("array<string>").alias("path"),
        ),
    )


def references(vars_: DataFrame) -> DataFrame:
    """Every reference: the variable columns, ``ref_pos``, ``name``, ``braced``."""
    return (
        vars_.filter(F.col("value").contains("$"))
        .select(*_FILE, "key", F.posexplode(segments("value")).alias("ref_pos", "_s"))
        .filter(F.col("_s.kind") == "ref")
        .select(*_FILE, "key", "ref_pos", "_s.name", F.col("_s.text").startswith("${").alias("braced"))
    )


def undefined_references(vars_: DataFrame) -> DataFrame:
    """References to names the file does not define; only braced ones are errors."""
    known = vars_.select(*_FILE, F.col("key").alias("name"))
    return references(vars_).join(known, [*_FILE, "name"], "left_anti").select(
        *_FILE, "key", "name", "braced", F.when(F.col("braced"), "UndefinedVariable").alias("error")
    )


def _pieces(value: Column) -> Column:
    """Pieces of a raw value, in text order: literal ``text``, and its open reference ``ref`` or null."""
    ref = lambda p: F.regexp_extract(p, rf"(?s)({_REF})\z", 1)
    return F.transform(
        F.filter(F.regexp_extract_all(value, F.lit(_PIECES), F.lit(0)), lambda p: p != ""),
        lambda p: F.struct(F.left(p, F.char_length(p) - F.char_length(ref(p))).alias("text"), F.nullif(ref(p), F.lit("")).alias("ref")),
    )


def expand(vars_: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Expanded ``value`` per (file, key), or null with an ``error`` kind and its ``detail``.

    ``vars_`` holds one row per (project, file, key); a ``line_no`` stays beside its key.
    The first error in text order is reported: UndefinedVariable, CircularExpansion or
    ExpansionDepthExceeded. The plan is one chain of rounds without driver jobs; the
    looked-up variables are the same exchange in all of them.
    """
    keys = [*_FILE, "key", *(["line_no"] if "line_no" in vars_.columns else [])]
    has_ref = F.col("value").contains("$")
    no_text = F.lit(None).cast("string")
    base = vars_.select(*keys, "value")
    plain = base.filter(~has_ref).select(*keys, "value", no_text.alias("error"), no_text.alias("detail"))
    # Without expressions on the value, so that Spark sees the same exchange in every round.
    table = base.select(*_FILE, F.col("key").alias("_k"), F.col("value").alias("target"))
    state = base.filter(has_ref).select(*keys, F.posexplode(_pieces(F.col("value"))).alias("_at", "_p")).select(
        *keys, F.array("_at").alias("place"), "_p.text", "_p.ref", F.array().cast("array<string>").alias("path"),
        no_text.alias("error"), no_text.alias("detail"),
    )
    for depth in range(max_depth + 1):
        state = _round(state, table, keys, depth == max_depth)
    # The group is one value's own pieces, never a file or a project.
    gathered = state.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "text", "error", "detail"))).alias("_g"))
    first_error = F.get(F.filter("_g", lambda p: p["error"].isNotNull()), F.lit(0))
    resolved = gathered.select(
        *keys,
        F.when(first_error.isNull(), F.array_join(F.col("_g.text"), "")).alias("value"),
        first_error["error"].alias("error"), first_error["detail"].alias("detail"),
    )
    return plain.unionByName(resolved)


def _round(state: DataFrame, table: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Replace every open reference by what it stands for: an error, a literal, or its target's pieces."""
    ref, path, text, place = F.col("ref"), F.col("path"), F.col("text"), F.col("place")
    # A closed piece has a key no variable can have, so it neither matches nor piles up under null.
    own = F.concat(F.lit("\n"), F.col("key"), F.lit("\n"), F.array_join(place.cast("array<string>"), ","))
    joined = state.withColumn("_k", F.coalesce(_name(ref), own)).join(table, [*_FILE, "_k"], "left").withColumn("_t", _pieces(F.col("target")))
    name, target, none = F.col("_k"), F.col("target"), F.lit(None).cast("string")

    def one(text_: Column, error: Column = none, detail: Column = none) -> Column:
        return F.array(F.struct(place.alias("place"), text_.alias("text"), none.alias("ref"), path.alias("path"), error.alias("error"), detail.alias("detail")))

    def err(kind: str, detail: Column) -> Column:
        return one(text, F.lit(kind), detail)

    cycle = F.concat(F.array_join(path, " → "), F.lit(" → "), name)
    spliced = F.transform(
        "_t",
        lambda p, i: F.struct(
            F.when(F.size("_t") > 1, F.concat(place, F.array(i))).otherwise(place).alias("place"),
            F.when(i == 0, F.concat(text, p["text"])).otherwise(p["text"]).alias("text"), p["ref"].alias("ref"),
            F.concat(path, F.array(name)).alias("path"), none.alias("error"), none.alias("detail"),
        ),
    )
    kept = F.array(F.struct("place", "text", "ref", "path", "error", "detail"))
    new = (
        F.when(ref.isNull(), kept)
        .when(F.array_contains(path, name), err("CircularExpansion", cycle))
        .when(target.isNull() & ref.startswith("${"), err("UndefinedVariable", name))
        .when(target.isNull(), one(F.concat(text, ref)))
        .otherwise(err("ExpansionDepthExceeded", name) if last else F.when(target == "", one(text)).otherwise(spliced))
    )
    return joined.select(*keys, F.explode(new).alias("_p")).select(*keys, "_p.*")
