"""Report rows as text: JSON lines, SARIF, CI annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.secrets import severity_level
from keyloom.operators.documents import document_rows

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def json_rows(df: DataFrame, keys: list[str], nulls: bool = True, name: str = "json") -> DataFrame:
    """One JSON object per row, beside its keys; optional fields are written as null."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, to_json(F.struct(*rest), nulls).alias(name))


def to_json(record: Column, nulls: bool = True) -> Column:
    return F.to_json(record, {"ignoreNullFields": "false" if nulls else "true"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def sarif_result(pattern: Column, confidence: Column, path: Column, line_no: Column) -> Column:
    """One SARIF result object."""
    rule = F.concat(F.lit("secret/"), F.translate(F.lower(pattern), " ", "-"))
    region = F.struct(line_no.alias("startLine"))
    place = F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region"))
    return F.struct(
        rule.alias("ruleId"),
        severity_level(confidence).alias("level"),
        F.struct(F.concat(pattern, F.lit(" detected")).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )


def sarif_rows(findings: DataFrame, keys: list[str]) -> DataFrame:
    result = sarif_result(F.col("pattern"), F.col("confidence"), F.col("path"), F.col("line_no"))
    return findings.select(*keys, to_json(result).alias("result"))


def sarif_documents(findings: DataFrame, by: str = "project_id") -> DataFrame:
    """One SARIF document per group as rows ``(by, section, file_id, line_no, text)``.

    The rows in order concatenate to the document, however many results it has.
    """
    head = (
        f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}",'
        '"runs":[{"tool":{"driver":{"name":"keyloom scan","version":"1"}},"results":['
    )
    rows = sarif_rows(findings, [by, "file_id", "line_no"])
    return document_rows(rows, [by], ["file_id", "line_no"], "result", F.lit(head), ",", F.lit("]}]}"))


def annotations(issues: DataFrame, fixes: DataFrame | None = None, env_path: str = ".env") -> DataFrame:
    """CI lines ``(project_id, variable, sub, text)``: an issue, its suggestion, and fixes."""
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("notice")
    place = F.concat(F.lit("::"), level, F.lit(f" file={env_path},line=1::"))
    texts = F.array(
        F.concat(place, F.col("message")),
        F.when(F.col("suggestion").isNotNull(), F.concat(place, F.lit("Suggestion: "), F.col("suggestion"))),
    )
    out = issues.select(
        "project_id", "variable", "type", F.posexplode(F.array_compact(texts)).alias("sub", "text")
    )
    if fixes is not None:
        names = F.create_map(*[F.lit(x) for pair in FIX_NAMES.items() for x in pair])
        out = out.unionByName(
            fixes.select(
                "project_id", F.col("key").alias("variable"), F.lit("fix").alias("type"), F.lit(2).alias("sub"),
                F.concat(
                    F.lit(f"::notice file={env_path},line=1::Fixed: "), F.col("key"), F.lit(" → "),
                    names[F.col("action")],
                ).alias("text"),
            )
        )
    return out


# How reports name the fixes.
FIX_NAMES = {
    "generate_secret": "Generated secure secret",
    "replace_placeholder": "Replaced placeholder",
    "fix_boolean": "Fixed boolean format",
    "add_missing": "Added missing variable",
}
