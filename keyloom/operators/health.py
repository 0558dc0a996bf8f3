"""Project health: flags per file, one aggregate per project, checks and a summary.

Every test on a file is made inside its row, so only booleans reach the shuffle and
a project with most files arrives pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import any_contains, trim
from keyloom.operators.extract import line_array, syntax_error

# File names that carry container configuration.
CONTAINER_FILES = ["docker-compose.yml", "docker-compose.yaml", "Dockerfile", "Containerfile", ".dockerignore"]
# Project kinds by marker, in priority order.
PROJECT_KINDS = [
    ("is_poetry", "Python (Poetry)"), ("has_pipfile", "Python (Pipenv)"), ("has_pyproject", "Python (pyproject)"),
    ("has_requirements", "Python (requirements)"), ("has_package", "Node.js"), ("has_cargo", "Rust"),
    ("has_gomod", "Go"), ("has_composer", "PHP"),
]


def ignore_lines(content: Column | str) -> Column:
    return F.filter(F.transform(line_array(content), lambda x: trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def ignores(content: Column | str, entry: str, prefixed: bool = False) -> Column:
    """An exact line for ``entry``; with ``prefixed`` also any line starting ``/entry``."""
    entry = entry.strip()
    return F.exists(
        ignore_lines(content), lambda x: (x == entry) | (x.startswith("/" + entry) if prefixed else F.lit(False))
    )


def requirements_has_dotenv(content: Column | str) -> Column:
    return F.exists(
        ignore_lines(content),
        lambda x: x.startswith("python-dotenv") | (x.startswith("dotenv") & ~x.contains("django-dotenv")),
    )


def pyproject_has_dotenv(content: Column) -> Column:
    return any_contains(content, ["python-dotenv", "pydantic-settings", "dynaconf"])


def package_has_dotenv(content: Column | str) -> Column:
    """Names under ``dependencies``, or under ``devDependencies`` if there are none."""
    parsed = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    deps = F.coalesce(parsed["dependencies"], parsed["devDependencies"])
    has = lambda k: F.coalesce(F.map_contains_key(deps, k), F.lit(False))
    return has("dotenv") | has("dotenv-cli")


def cargo_has_dotenv(content: Column) -> Column:
    return any_contains(content, ["dotenvy", "dotenv"])


def project_flags(files: DataFrame) -> DataFrame:
    """Flags per project from ``files(project_id, path, content, mode)`` with paths from its root."""
    path, content = F.col("path"), F.col("content")
    is_ = lambda name: path == name
    bits = F.col("mode").bitwiseAND(0o777)
    flags = {
        "is_poetry": is_("poetry.lock") | (is_("pyproject.toml") & content.contains("[tool.poetry]")),
        "has_pipfile": is_("Pipfile"),
        "has_pyproject": is_("pyproject.toml"),
        "has_requirements": is_("requirements.txt"),
        "has_package": is_("package.json"),
        "has_cargo": is_("Cargo.toml"),
        "has_gomod": is_("go.mod"),
        "has_composer": is_("composer.json"),
        "has_env": is_(".env"),
        "has_example": is_(".env.example"),
        "has_container": path.isin(CONTAINER_FILES),
        "env_ignored": F.when(is_(".gitignore"), ignores("content", ".env", prefixed=True)),
        "env_private": F.when(is_(".env"), bits.isin(0o600, 0o400)),
        "requirements_dotenv": F.when(is_("requirements.txt"), requirements_has_dotenv("content")),
        "pyproject_dotenv": F.when(is_("pyproject.toml"), pyproject_has_dotenv(content)),
        "package_dotenv": F.when(is_("package.json"), package_has_dotenv("content")),
        "cargo_dotenv": F.when(is_("Cargo.toml"), cargo_has_dotenv(content)),
    }
    # Flags first: no text stands below the aggregate, whatever way it is computed.
    per_file = files.select(
        "project_id", *[c.alias(n) for n, c in flags.items()],
        F.when(is_(".env"), syntax_error("content")).alias("syntax_problem"), F.when(is_(".env"), bits).alias("env_mode"),
    )
    return per_file.groupBy("project_id").agg(
        *[F.coalesce(F.max(n), F.lit(False)).alias(n) for n in flags],
        F.max("syntax_problem").alias("syntax_problem"), F.max("env_mode").alias("env_mode"),
    )


def project_type() -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for flag, kind in PROJECT_KINDS:
        chain = chain.when(F.col(flag), kind)
    return chain.otherwise(F.lit(None))


def has_dotenv_dependency() -> Column:
    """Null for project kinds without a dependency test."""
    kind = F.col("project_type")
    return (
        F.when(kind == "Python (requirements)", F.col("requirements_dotenv"))
        .when(kind.startswith("Python"), F.col("pyproject_dotenv"))
        .when(kind == "Node.js", F.col("package_dotenv"))
        .when(kind == "Rust", F.col("cargo_dotenv"))
    )


def classify_projects(files: DataFrame) -> DataFrame:
    return project_flags(files).withColumn("project_type", project_type()).withColumn(
        "has_dotenv_dependency", has_dotenv_dependency()
    )


def project_checks(projects: DataFrame) -> DataFrame:
    """Five checks per classified project: ``name, severity, details, fixable``."""
    env = F.col("has_env")
    bad_syntax = F.col("syntax_problem").isNotNull()
    env_severity = (
        F.when(~env, "warning").when(~F.col("env_ignored"), "error").when(bad_syntax, "warning").otherwise("ok")
    )
    syntax_text = F.concat(
        F.lit("Syntax issues: Line "), F.col("syntax_problem.line_no").cast("string"),
        F.lit(": invalid syntax '"), F.col("syntax_problem.snippet"), F.lit("'"),
    )
    env_details = F.when(~env, ".env file not found - create from .env.example").otherwise(
        F.nullif(
            F.concat_ws(
                "\n", F.when(~F.col("env_ignored"), ".env is NOT in .gitignore (security risk)"),
                F.when(bad_syntax, syntax_text),
            ),
            F.lit(""),
        )
    )
    kind = F.col("project_type")
    lacks = (kind == "Python (requirements)") & ~F.col("has_dotenv_dependency")
    private = F.col("env_private")

    def check(name: str, severity: Column, details: Column, fixable: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), severity.alias("severity"), details.cast("string").alias("details"),
            F.coalesce(fixable, F.lit(False)).alias("fixable"),
        )

    no = F.lit(False)
    checks = F.array(
        check("env_file", env_severity, env_details, env_severity == "error"),
        check("env_example", F.when(F.col("has_example"), "ok").otherwise("warning"),
              F.when(~F.col("has_example"), ".env.example not found - consider creating a template"), no),
        check("project_structure",
              F.when(kind.isNull(), "info").when(lacks, "warning").otherwise("ok"),
              F.when(kind.isNull(), "No recognized project configuration")
              .when(lacks, "python-dotenv not in requirements.txt"), no),
        check("docker_config", F.when(F.col("has_container"), "ok").otherwise("info"),
              F.when(~F.col("has_container"), "No Docker configuration detected"), no),
        check("file_permissions",
              F.when(~env, "info").when(private, "ok").otherwise("warning"),
              F.when(env & ~private, F.concat(F.lit("Permissions: "), F.conv(F.col("env_mode").cast("string"), 10, 8),
                                              F.lit(" (recommended: 600)"))),
              env & ~private),
    )
    return projects.select("project_id", F.explode(checks).alias("c")).select("project_id", "c.*")


def health_summary(checks: DataFrame) -> DataFrame:
    severity = F.col("severity")
    out = checks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(severity == "error").alias("errors"),
        F.count_if(severity == "warning").alias("warnings"),
        F.count_if(severity == "ok").alias("passed"),
        F.count_if(severity == "info").alias("info"),
        F.count_if("fixable").alias("fixable"),
    )
    health = (
        F.when(F.col("errors") > 0, "Action required").when(F.col("warnings") > 0, "Needs attention").otherwise("Excellent")
    )
    return out.withColumn("health", health)
