"""Lines and key/value rows from configuration text.

A file is one row, so everything that depends on line order inside a file is done
within that row; no operator here needs a shuffle until rows are grouped by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.checks import is_valid_key
from keyloom.functions.text import WS_CLASS, after_first, any_contains, ltrim, rtrim, trim, unescape
from keyloom.operators.stitch import OPENS, QUOTES, line_values

_SPANS = "array<struct<first:int,last:int>>"


def line_array(content: Column | str) -> Column:
    """Lines of a text; a final line break does not start another line."""
    content = F.col(content) if isinstance(content, str) else content
    # One-character separators take the fast path of split; most texts have no CR.
    return F.when(content.contains("\r"), F.split(content, "\r?\n")).otherwise(F.split(content, "\n"))


def _drop_last_empty(lines: Column) -> Column:
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def to_lines(files: DataFrame, keep: str = "data", content: str = "content") -> DataFrame:
    """One row per line, 1-based ``line_no``; every other column is kept but the text.

    ``keep='data'`` drops blank and ``#`` lines, ``keep='all'`` keeps every line.
    """
    others = [c for c in files.columns if c != content]
    staged = files.select(*others, line_array(content).alias("_lines"))
    lines = staged.select(*others, F.posexplode(_drop_last_empty(F.col("_lines"))).alias("_p", "line")).select(
        *others, (F.col("_p") + 1).alias("line_no"), "line"
    )
    if keep == "all":
        return lines
    text = ltrim("line")
    return lines.filter((text != "") & ~text.startswith("#"))


def lenient_pairs(lines: DataFrame) -> DataFrame:
    """Key/value pairs the way the scanner reads them: value trimmed, quotes kept."""
    key = F.regexp_replace(trim(F.substring_index("line", "=", 1)), r"\A(?:export)+", "")
    return lines.filter(F.col("line").contains("=")).select(
        *[c for c in lines.columns if c != "line"],
        trim(key).alias("key"),
        trim(after_first(F.col("line"), "=")).alias("value"),
    )


def key_names(files: DataFrame) -> DataFrame:
    """Text before the first ``=`` of every data line, in order; values never leave."""
    lines = to_lines(files)
    return lines.select(
        *[c for c in lines.columns if c != "line"], trim(F.substring_index(trim("line"), "=", 1)).alias("key")
    )


def _statements(files: DataFrame, multiline: bool) -> DataFrame:
    """Physical lines, with quoted values that span lines stitched into one row.

    Only files that hold an unclosed opening quote run the fold; it remembers where
    the open value began and emits one (first, last) span when its quote ends a line.
    """
    others = [c for c in files.columns if c != "content"]
    rows = files.select(
        *others, line_array("content").alias("_lines"), any_contains(F.col("content"), QUOTES).alias("_quoted")
    )
    if not multiline:
        rows = rows.withColumn("_spans", F.array().cast(_SPANS))
    else:
        marks = F.transform(
            F.col("_lines"),
            lambda line, i: F.struct(
                i.alias("i"), rtrim(line).alias("text"), F.when(any_contains(line, QUOTES), F.regexp_extract(line, OPENS, 1)).otherwise("").alias("q"),
            ),
        )
        zero = F.struct(
            F.lit(None).cast("int").alias("open"), F.lit(None).cast("string").alias("q"),
            F.array().cast(_SPANS).alias("spans"),
        )

        def step(acc: Column, mark: Column) -> Column:
            closed = F.struct(
                F.lit(None).cast("int").alias("open"),
                F.lit(None).cast("string").alias("q"),
                F.concat(
                    acc["spans"], F.array(F.struct(acc["open"].alias("first"), mark["i"].alias("last")))
                ).alias("spans"),
            )
            opened = F.struct(mark["i"].alias("open"), mark["q"].alias("q"), acc["spans"].alias("spans"))
            return (
                F.when(acc["open"].isNull() & (mark["q"] == ""), acc)
                .when(acc["open"].isNull(), opened)
                .when(F.endswith(mark["text"], acc["q"]), closed)
                .otherwise(acc)
            )

        # A value still open at the end of the file becomes a span with no last line.
        def finish(acc: Column) -> Column:
            dangling = F.array(F.struct(acc["open"].alias("first"), F.lit(None).cast("int").alias("last")))
            return F.when(acc["open"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], dangling))

        needs_fold = F.col("_quoted") & F.exists("_lines", lambda line: any_contains(line, QUOTES) & line.rlike(OPENS))
        rows = rows.withColumn("_marks", F.when(needs_fold, marks)).withColumn(
            "_spans",
            F.when(F.col("_marks").isNull(), F.array().cast(_SPANS)).otherwise(
                F.aggregate("_marks", zero, step, finish)
            ),
        )

    def single(first: Column, count: Column) -> Column:
        part = F.slice(F.col("_lines"), first + 1, F.greatest(count, F.lit(0)))
        return F.transform(
            part,
            lambda line, i: F.struct(
                (first + i + 1).alias("line_no"), line.alias("text"),
                F.lit(False).alias("multi"), F.lit(True).alias("ended"),
            ),
        )

    total = F.size("_lines")

    def gap_and_value(span: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("_spans"), k - 1)["last"] + 1)
        last = F.coalesce(span["last"], total - 1)
        text = F.concat_ws(
            "\n",
            rtrim(F.get(F.col("_lines"), span["first"])),
            F.when(
                last > span["first"],
                F.array_join(F.slice(F.col("_lines"), span["first"] + 2, last - span["first"]), "\n"),
            ),
        )
        value = F.struct(
            (span["first"] + 1).alias("line_no"), text.alias("text"),
            F.lit(True).alias("multi"), span["last"].isNotNull().alias("ended"),
        )
        return F.concat(single(start, span["first"] - start), F.array(value))

    final = F.element_at("_spans", -1)
    tail_start = F.when(F.size("_spans") == 0, F.lit(0)).otherwise(F.coalesce(final["last"] + 1, total))
    # Exploded as an expression: over a plain column Spark would infer a not-empty
    # filter and push copies of the whole fold below it.
    pieces = F.concat(
        F.flatten(F.transform(F.col("_spans"), gap_and_value)), single(tail_start, total - tail_start)
    )
    rows = rows.select(*others, F.explode(pieces).alias("_s")).select(*others, "_s.*")
    text = trim("text")
    return rows.filter((text != "") & (F.col("multi") | ~text.startswith("#")))


def parse_rows(
    files: DataFrame,
    strict: bool = False,
    inline_comments: bool = True,
    trim_values: bool = True,
    multiline: bool = True,
    loose_export: bool = False,
) -> DataFrame:
    """Key/value rows of strict extraction, bad lines included with an ``error`` kind.

    Output: the file columns (text aside), ``line_no``, ``key``, ``raw_value``,
    ``value``, ``quote``, ``error``. ``export`` must be followed by white space
    unless ``loose_export`` (which strips the bare word too).
    """
    others = [c for c in files.columns if c != "content"]
    return _parsed(_statements(files, multiline), others, strict, inline_comments, trim_values, loose_export)


def parse_lines(
    lines: DataFrame, by: list[str], strict: bool = False, inline_comments: bool = True, trim_values: bool = True,
    loose_export: bool = False, levels: int = 1,
) -> DataFrame:
    """:func:`parse_rows` of files that come as lines ``(by, line_no, line)``, in any order and spread over any tasks.

    No row holds a file: values that span lines are stitched from blocks (``stitch.line_values``).
    """
    return _parsed(line_values(lines, by, levels), by, strict, inline_comments, trim_values, loose_export)


def _parsed(statements: DataFrame, others: list[str], strict: bool, inline_comments: bool, trim_values: bool, loose_export: bool) -> DataFrame:
    gap = "*" if loose_export else "+"
    rows = (
        statements
        .withColumn("_text", trim("text"))
        .withColumn(
            "_body",
            F.when(
                F.col("_text").startswith("export"), F.regexp_replace("_text", rf"\Aexport[{WS_CLASS}]{gap}", "")
            ).otherwise(F.col("_text")),
        )
        .withColumn("_has_eq", F.col("_body").contains("="))
        .withColumn("key", F.when(F.col("_has_eq"), trim(F.substring_index("_body", "=", 1))))
        .withColumn("raw_value", F.when(F.col("_has_eq"), after_first(F.col("_body"), "=")))
        .withColumn("_v", ltrim("raw_value"))
        .withColumn("quote", F.when(F.left("_v", F.lit(1)).isin(QUOTES), F.left("_v", F.lit(1))))
    )
    v, quote = F.col("_v"), F.col("quote")
    closed = F.col("ended") & (F.char_length(v) >= 2) & F.endswith(v, quote)
    inner = F.substr(v, F.lit(2), F.char_length(v) - F.lit(2))
    bare = F.substring_index(v, "#", 1) if inline_comments else v
    bare = trim(bare) if trim_values else rtrim(bare)
    error = (
        F.when(~F.col("_has_eq"), "InvalidFormat")
        .when(~is_valid_key("key", strict), "InvalidKey")
        .when(quote.isNotNull() & ~closed, "UnterminatedString")
    )
    value = (
        F.when(quote.isNull(), bare)
        .when(F.col("multi") | (quote != '"'), inner)
        .otherwise(unescape(inner))
    )
    parsed = F.struct(
        "line_no", "key", "raw_value", F.when(F.col("error").isNull(), value).alias("value"), "quote", "error"
    )
    # The one-element explode keeps filters on the result above the parsing.
    return rows.withColumn("error", error).select(*others, F.explode(F.array(parsed)).alias("_r")).select(
        *others, "_r.*"
    )


def parse_errors(rows: DataFrame) -> DataFrame:
    """The bad lines of :func:`parse_rows`."""
    return rows.filter(F.col("error").isNotNull()).select("project_id", "file_id", "line_no", "error", "key")


def file_status(rows: DataFrame) -> DataFrame:
    """First error per file, as a parser that stops there would report it."""
    return rows.groupBy("project_id", "file_id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("first_error"),
        F.min(F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("first_error_line"),
        F.count_if(F.col("error").isNull()).alias("assignments"),
    )


def resolve_duplicates(rows: DataFrame, keys: tuple[str, ...] = ("project_id", "file_id", "key")) -> DataFrame:
    """Last assignment wins, first position stays.

    ``max_by``/``min`` combine on the map side, so one hot key costs one row per task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in ("line_no", "error")]
    good = rows.filter(F.col("error").isNull()) if "error" in rows.columns else rows
    last = F.max_by(F.struct(*rest), F.col("line_no"))
    return good.groupBy(*keys).agg(
        F.min("line_no").alias("pos"), F.max("line_no").alias("line_no"), last.alias("_last")
    ).select(*keys, "pos", "line_no", "_last.*")


def parse_vars(files: DataFrame, **options) -> DataFrame:
    """Variables of every file: strict rows, duplicates resolved."""
    return resolve_duplicates(parse_rows(files, **options))


def classify_kv(files: DataFrame) -> DataFrame:
    """Row-local file classifier: ``is_kv`` if blank or at least 80 % good lines; ``n_vars`` too."""
    lines = F.filter(F.transform(line_array(F.coalesce("content", F.lit(""))), lambda x: trim(x)), lambda x: x != "")
    key_ok = rf"(?U)\A[{WS_CLASS}]*[\p{{Alpha}}\p{{N}}_]+[{WS_CLASS}]*="
    staged = files.withColumn("_lines", lines)
    good = F.filter("_lines", lambda x: x.startswith("#") | x.rlike(key_ok))
    assigned = F.filter("_lines", lambda x: ~x.startswith("#") & x.contains("="))
    return staged.select(
        *[c for c in files.columns if c != "content"],
        (F.size(good) * 10 >= F.size("_lines") * 8).alias("is_kv"),
        F.size(assigned).alias("n_vars"),
        F.size("_lines").alias("n_lines"),
    )


SYNTAX_RE = rf"\A(?:[{WS_CLASS}]*\z|[{WS_CLASS}]*#|[{WS_CLASS}]*[A-Za-z_][A-Za-z0-9_]*[{WS_CLASS}]*=)"


def syntax_error(content: Column | str) -> Column:
    """First line that is neither blank, comment nor assignment: (line_no, snippet), or null."""
    bad = F.filter(
        F.transform(line_array(content), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))),
        lambda x: ~x["line"].rlike(SYNTAX_RE),
    )

    def report(x: Column) -> Column:
        dots = F.when(F.octet_length(x["line"]) > 50, "...").otherwise("")
        return F.struct(
            x["line_no"].alias("line_no"), F.concat(F.left(x["line"], F.lit(50)), dots).alias("snippet")
        )

    return F.get(F.transform(F.slice(bad, 1, 1), report), F.lit(0))


def first_syntax_error(files: DataFrame) -> DataFrame:
    others = [c for c in files.columns if c != "content"]
    found = F.array_compact(F.array(syntax_error("content")))
    return files.select(*others, F.explode(found).alias("_e")).select(*others, "_e.*")


# Variables of the operating system, never exported.
SYSTEM_VARIABLES = [
    "PATH", "HOME", "USER", "SHELL", "PWD", "TERM", "LANG", "LOGNAME",
    "TMPDIR", "TEMP", "TMP", "OLDPWD", "SHLVL", "_",
]


def drop_system_variables(vars_: DataFrame) -> DataFrame:
    return vars_.filter(~F.col("key").isin(SYSTEM_VARIABLES))
