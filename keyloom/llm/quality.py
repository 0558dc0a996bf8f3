"""Quality rules: text counts, and cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, digits to 0, white space runs to one space) and
hashed; a line is removed where more distinct texts of one host hold it than ``max_docs``
and than ``max_share`` of the host's distinct texts, and a document that keeps less than
``min_share`` of its words is rejected, as are those that fail the base rules. Copies of a
text count once: a document is not boilerplate because it was stored often. ``documents``
name their host in ``source``.

Defined results: a null or empty text has no words and fails the base rules; a null host
is the host ""; every row is judged on its own, repeated ids and rows included (rows that
share an id, or have none, get a stored key); lines without a word are neither counted nor
removed, texts without one are no texts of their host. All other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ROW, cut, marked, with_keys

MAX_DOCS = 50
MAX_SHARE = 0.01
MIN_SHARE = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# The contract's symbols and white space.
SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\u000b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS, _ZEROS = "0123456789", "0000000000"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def _joined(tokens: Column) -> Column:
    return F.translate(F.array_join(tokens, " "), _UPPER + _DIGITS, _LOWER + _ZEROS)


def _normal(line: Column) -> Column:
    return _joined(words(line))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: _without(line, " " + WHITE) != "")


def _repeated_words(tokens: Column, windows: Column) -> Column:
    """How many words stand in windows of three that the text has twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def covered(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda x, i: F.when((F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["p"]))
        places = F.array_sort(F.array_compact(marked))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    # the sorted windows are bound once by a one-element transform
    n = F.get(F.transform(F.array(placed), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(n)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of the base rules in ``_q_`` columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.withColumn("_q_words", words(text)).withColumn("_q_lines", _lines(text))
    step = step.withColumn("_q_n", F.size("_q_words").cast("long"))
    starts = F.when(F.col("_q_n") >= 3, F.sequence(F.lit(0), F.size("_q_words") - 3)).otherwise(F.array().cast("array<int>"))
    tokens = F.col("_q_words")
    step = step.withColumn("_q_windows", F.transform(starts, lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))))
    step = step.withColumns({
        "_q_chars": F.length(_without(text, " " + WHITE)).cast("long"),
        "_q_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "_q_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_repeat": _repeated_words(tokens, F.col("_q_windows")).cast("long"),
    })
    return step.withColumn("_q_failed", (F.col("_q_n") < MIN_WORDS) | (100 * F.col("_q_repeat") > MAX_REPEAT_PERCENT * F.col("_q_n"))).drop("_q_words", "_q_lines", "_q_windows")


def frequent_lines(rows: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_q_row, h, n): the lines of each row that too many texts of its host hold, with their words.

    Only hosts of so many texts that their share is above ``max_docs`` are joined, and only
    to lines above ``max_docs``; distinct texts are pre-aggregated in the tasks.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.filter(F.transform(F.split(text, "\n"), words), lambda w: F.size(w) > 0)  # each line is split once
    line = F.explode(F.transform(found, lambda w: F.struct(F.xxhash64(_joined(w)).alias("h"), F.size(w).alias("n"))))
    lines = cut(
        rows.select("_q_row", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("t"), line.alias("line"))
        .select("_q_row", "host", "t", "line.h", "line.n")
    )
    large = lines.groupBy("host").agg(F.count_distinct("t").alias("texts")).where(F.col("texts") * max_share > max_docs)
    often = lines.groupBy("host", "h").agg(F.count_distinct("t").alias("docs")).where(F.col("docs") > max_docs)
    frequent = often.join(large, "host", "left").where(F.col("docs") > F.coalesce(F.col("texts") * max_share, F.lit(0.0))).select("host", "h")
    return lines.join(frequent, ["host", "h"]).select("_q_row", "h", "n")


def _numbered(docs: DataFrame) -> DataFrame:
    return with_keys(docs).withColumnRenamed(ROW, "_q_row")


def _kept(min_share: float) -> Column:
    left = F.col("_q_n") - F.coalesce("_q_removed", F.lit(0))
    return ~F.col("_q_failed") & (left >= min_share * F.col("_q_n"))


def _judged(rows: DataFrame, host: str, max_docs: int, min_share: float, max_share: float) -> DataFrame:
    """The counts and the verdict of each row, and the hashes of its frequent lines (null for none)."""
    removed = frequent_lines(rows, host, max_docs, max_share).groupBy("_q_row").agg(F.sum("n").alias("_q_removed"), F.collect_set("h").alias("_q_hashes"))
    digest = measured(rows.select("_q_row", "doc_id", "text")).drop("text")
    return digest.join(removed, "_q_row", "left").withColumn("_q_kept", _kept(min_share))


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    return _judged(_numbered(docs), host, max_docs, min_share, max_share).select(
        "doc_id", F.col("_q_n").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeat").alias("n_repeat_words"), F.col("_q_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"), F.coalesce("_q_removed", F.lit(0)).cast("long").alias("n_removed_words"),
    )


def clean(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """The kept documents without their frequent lines; ``n_chars``, where there is one, is counted anew.

    The verdicts are stored first: a filter on them would be pushed below the steps that
    share the words of a text. Only documents that go or change are shuffled.
    """
    rows = _numbered(docs)
    touched = cut(_judged(rows, host, max_docs, min_share, max_share).select("_q_row", "_q_kept", "_q_hashes")).where("not _q_kept or _q_hashes is not null")
    likely = marked(rows, "_q_row", touched.select("_q_row"))
    changed = likely.where("_marked").join(touched, "_q_row", "left").where("_q_kept is null or _q_kept")
    hashes = F.col("_q_hashes")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: (_without(x, " " + WHITE) == "") | ~F.array_contains(hashes, F.xxhash64(_normal(x)))), "\n")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hashes.isNull(), F.col("n_chars")).otherwise(F.length(left).cast(dict(docs.dtypes)["n_chars"])))
    changed = changed.withColumn("text", F.when(hashes.isNull(), F.col("text")).otherwise(left))
    return likely.where("not _marked").select(*docs.columns).union(changed.select(*docs.columns))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), tri AS (
  SELECT r, i AS p, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1
), repeated AS (
  SELECT r, count(DISTINCT p + k) AS n FROM again, (SELECT unnest(range(0, 3)) AS k) GROUP BY r
), lines AS (
  SELECT r, host, t, translate(array_to_string(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' '),
    '{_UPPER}{_DIGITS}', '{_LOWER}{_ZEROS}') AS line,
    len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT r, host, t, unnest(ls) AS l FROM w)
), hosts AS (
  SELECT host, count(DISTINCT t) AS texts FROM lines GROUP BY host
), frequent AS (
  SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line, texts
  HAVING count(DISTINCT t) > {MAX_DOCS} AND count(DISTINCT t) > texts * CAST({MAX_SHARE} AS double)
), removed AS (
  SELECT r, sum(n) AS n FROM lines JOIN frequent USING (host, line) GROUP BY r
), x AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM w LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)
), y AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM x
)
SELECT doc_id, CAST(n_words AS bigint) AS n_words, CAST(word_chars AS bigint) AS word_chars, CAST(n_symbols AS bigint) AS n_symbols,
  CAST(n_dup_lines AS bigint) AS n_dup_lines, CAST(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= {MIN_SHARE} * n_words AS kept, CAST(n_removed_words AS bigint) AS n_removed_words
FROM y
"""
