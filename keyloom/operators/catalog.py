"""Catalog resolution, search, sectioned documents and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import after_first, any_contains, trim
from keyloom.operators import pattern_table
from keyloom.operators.extract import to_lines
from keyloom.operators.joins import join_skewed, shuffle_width
from keyloom.sources.catalog import SERVICE_GROUPS

_META = ["source_kind", "source_id", "example_value", "description", "category", "required"]


def category_by_name(name: Column | str) -> Column:
    """Category of a variable from its name, first rule wins."""
    n = F.lower(name)
    return (
        F.when(any_contains(n, ["secret", "key", "token"]), "Security")
        .when(any_contains(n, ["database", "db_", "postgres", "mysql"]), "Database")
        .when(n.contains("redis"), "Cache")
        .when(any_contains(n, ["auth", "oauth"]), "Auth")
        .when(any_contains(n, ["url", "host", "port"]), "Connection")
        .when(any_contains(n, ["aws", "s3"]), "Cloud")
        .otherwise("Application")
    )


def category_by_service(service_id: Column | str) -> Column:
    """Category of a service from its id, first rule wins."""
    s = F.col(service_id) if isinstance(service_id, str) else service_id
    return (
        F.when(any_contains(s, ["postgres", "mysql", "mongo"]), "Database")
        .when(s.contains("redis"), "Cache")
        .when(any_contains(s, ["s3", "storage", "cloudinary"]), "Storage")
        .when(any_contains(s, ["auth", "oauth", "clerk"]), "Auth")
        .when(any_contains(s, ["stripe", "payment", "razorpay"]), "Payments")
        .when(any_contains(s, ["sentry", "datadog", "log"]), "Monitoring")
        .when(any_contains(s, ["openai", "anthropic", "ai"]), "AI/ML")
        .otherwise("Service")
    )


def lookup_service(components: DataFrame, service_id: str) -> DataFrame:
    return first_groups(components).filter((F.col("kind") == "service") & (F.col("component_id") == service_id))


def first_groups(components: DataFrame) -> DataFrame:
    """One entry per service id: the first group in lookup order holds it."""
    keys = ["catalog_id", "kind", "_scope", "component_id"]
    scope = F.when(F.col("kind") == "service", "").otherwise(F.col("scope"))
    rest = [c for c in components.columns if c not in keys]
    first = components.withColumn("_scope", scope).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "group_rank").alias("_s")
    )
    return first.select("catalog_id", "kind", "component_id", "_s.*")


def flatten(components: DataFrame) -> DataFrame:
    """Variables of every component, with defaults and inferred categories."""
    kind, var = F.col("kind"), F.col("var")
    rows = components.select("*", F.posexplode("vars").alias("pos", "var"))
    category = (
        F.when(kind == "framework", F.coalesce(F.element_at("categories", var), category_by_name("var")))
        .when(kind == "service", F.coalesce("category", category_by_service("component_id")))
        .otherwise(F.coalesce("category", F.lit("Infrastructure")))
    )
    required = (kind == "framework") | (
        (kind == "service") & F.coalesce(F.array_contains("required", var), F.lit(False))
    )
    fallback = F.concat(F.lit("your_"), F.lower("var"), F.lit("_value"))
    return rows.select(
        "catalog_id", kind.alias("source_kind"), "scope", F.col("component_id").alias("source_id"), "pos", "var",
        F.coalesce(F.element_at("defaults", var), fallback).alias("example_value"),
        F.element_at("descriptions", var).alias("description"),
        category.alias("category"), required.alias("required"),
    )


def selections(stacks: DataFrame) -> DataFrame:
    """Chosen components in resolution order: framework, services, infrastructure.

    Works for catalog stacks and for any table of ad-hoc choices with the same columns.
    """
    def pick(stage: int, kind: str, ids: Column, scope: Column) -> Column:
        return F.transform(
            F.coalesce(ids, F.array().cast("array<string>")),
            lambda x, i: F.struct(
                F.lit(stage).alias("stage"), i.alias("ord"), F.lit(kind).alias("source_kind"),
                scope.cast("string").alias("language"), x.alias("source_id"),
            ),
        )

    none = F.lit(None)
    chosen = F.concat(
        pick(1, "framework", F.array("framework"), F.col("language")),
        pick(2, "service", F.col("services"), none),
        pick(3, "infrastructure", F.col("infrastructure"), none),
    )
    return stacks.select("catalog_id", "stack_id", F.explode(chosen).alias("_c")).select(
        "catalog_id", "stack_id", "_c.*"
    )


def resolve(selected: DataFrame, catalog_vars: DataFrame) -> DataFrame:
    """Variables of every stack; the first source of a variable wins.

    First is the least (stage, ord, pos, id). Only names travel by stack: a stack's choices
    meet in one task, as in a catalog, where a stack is one row. What has won meets its
    texts in a join by component, as one row for each component of a stack. A component
    that most stacks choose is dealt over copies of its variables in both joins.
    """
    ids = ["catalog_id", "source_kind", "source_id", "_scope"]
    framework = F.col("source_kind") == "framework"
    texts = [c for c in _META if c not in ids]
    # A component's variables are one row of the catalog; a scope tells frameworks apart, nothing else.
    held = catalog_vars.groupBy(*ids[:3], F.when(framework, F.col("scope")).otherwise("").alias("_scope")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "var", *texts))).alias("_vars")
    )
    names = held.select(*ids, F.col("_vars.var").alias("_names"), F.col("_vars.pos").alias("_places"))
    asked = selected.select("catalog_id", "stack_id", "stage", "ord", "source_kind", "source_id",
                            F.when(framework, F.col("language")).otherwise("").alias("_scope"))
    # as many tasks as the session asks for: gathered rows are large, and fewer tasks would sort them on disk
    chosen = join_skewed(asked, names, ids).repartition(shuffle_width(selected.sparkSession), "catalog_id", "stack_id")
    stacks = chosen.groupBy("catalog_id", "stack_id").agg(
        F.sort_array(F.collect_list(F.struct("stage", "ord", "source_kind", "source_id", "_scope", "_names", "_places"))).alias("_chosen")
    )
    entries = F.flatten(F.transform("_chosen", lambda c, i: F.transform(c["_names"], lambda n, j: F.struct(
        n.alias("var"), c["stage"].alias("stage"), c["ord"].alias("ord"), F.get(c["_places"], j).alias("pos"), c["source_id"].alias("source_id"),
        i.alias("_in"), j.alias("_at"),
    ))))
    ordered = stacks.withColumn("_e", F.sort_array(entries))
    first = F.filter("_e", lambda e, i: (i == 0) | ~e["var"].eqNullSafe(F.get("_e", i - 1)["var"]))
    winners = ordered.withColumn("_w", F.sort_array(F.transform(first, lambda e: F.struct(e["_in"], e["_at"]))))
    # where the winners of each component begin, and their number behind the last
    starts = F.filter(F.transform("_w", lambda w, i: F.when((i == 0) | (w["_in"] != F.get("_w", i - 1)["_in"]), i)), lambda i: i.isNotNull())
    parted = winners.withColumn("_from", F.concat(starts, F.array(F.size("_w"))))
    by_component = F.transform(F.slice("_from", 1, F.size("_from") - 1), lambda a, i: F.struct(
        F.get("_chosen", F.get("_w", a)["_in"]).alias("c"),
        F.transform(F.slice("_w", a + 1, F.get("_from", i + 1) - a), lambda w: w["_at"]).alias("_ats"),
    ))
    won = parted.select("catalog_id", "stack_id", F.explode(by_component).alias("_g")).select(
        "catalog_id", "stack_id", "_g.c.source_kind", "_g.c.source_id", "_g.c._scope", "_g._ats"
    )
    joined = join_skewed(won, held, ids, frequencies=asked)
    rows = joined.select("catalog_id", "stack_id", *ids[1:3], F.explode(F.transform("_ats", lambda i: F.get("_vars", i))).alias("_v"))
    return rows.select("catalog_id", "stack_id", "_v.var", *[F.col(c if c in ids else f"_v.{c}") for c in _META])


# -- listing and search --------------------------------------------------------

def list_services(components: DataFrame) -> DataFrame:
    """Service names by group; groups without services do not appear."""
    titles = F.create_map(*[F.lit(x) for pair in SERVICE_GROUPS.items() for x in pair])
    return components.filter(F.col("kind") == "service").select(
        "catalog_id", titles[F.col("scope")].alias("group_title"), "group_rank", "component_id", "display_name"
    )


def list_frameworks(components: DataFrame, language: str | None = None) -> DataFrame:
    rows = components.filter(F.col("kind") == "framework")
    rows = rows.filter(F.col("scope") == language) if language else rows
    return rows.select("catalog_id", F.col("scope").alias("language"), "component_id", "display_name")


def lookup_framework(components: DataFrame, language: str, framework_id: str) -> DataFrame:
    return list_frameworks(components, language).filter(F.col("component_id") == framework_id)


def list_stacks(stacks: DataFrame) -> DataFrame:
    return stacks.select("catalog_id", "stack_id", "name")


def lookup_stack(stacks: DataFrame, stack_id: str) -> DataFrame:
    return stacks.filter(F.col("stack_id") == stack_id)


# Titles a search reports per service group; databases are reported
# under two titles and message queues are not searched.
SEARCH_TITLES = {
    "databases": ["Database", "Cache"], "auth_providers": ["Auth"], "storage": ["Storage"],
    "monitoring_logging": ["Monitoring"], "payments": ["Payments"], "ai_ml": ["AI/ML"], "email_sms": ["Email/SMS"],
}


def search_services(components: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """Case-insensitive search in id, display name and category, for a few terms or a table ``(term)`` of any length."""
    titles = F.when(F.lit(False), F.array().cast("array<string>"))
    for group, names in SEARCH_TITLES.items():
        titles = titles.when(F.col("scope") == group, F.array(*map(F.lit, names)))
    found = _matches(components.filter(F.col("kind") == "service"), terms, with_category=True)
    return found.withColumn("_t", titles).select(
        "catalog_id", "term", "component_id", "display_name", F.explode("_t").alias("group_title")
    )


def search_frameworks(components: DataFrame, language: str, terms: list[str] | DataFrame) -> DataFrame:
    rows = components.filter((F.col("kind") == "framework") & (F.col("scope") == language))
    return _matches(rows, terms, with_category=False).select("catalog_id", "term", "component_id", "display_name")


def _matches(rows: DataFrame, terms: list[str] | DataFrame, with_category: bool) -> DataFrame:
    fields = ["component_id", "display_name"] + (["category"] if with_category else [])
    if isinstance(terms, DataFrame):
        return pattern_table.search(rows, ["catalog_id", "scope", "component_id", "display_name"], fields, terms)
    text = F.array(*[F.lower(F.coalesce(f, F.lit(""))) for f in fields])

    def has(term: str) -> Column:
        return F.exists(text, lambda x: x.contains(term.lower()))

    hits = F.array_compact(F.array(*[F.when(has(t), F.lit(t)) for t in terms]))
    return rows.select("*", F.explode(hits).alias("term"))


def stacks_by_tag(stacks: DataFrame, tag: str) -> DataFrame:
    return stacks.filter(F.array_contains("tags", tag)).select("catalog_id", "stack_id", "name", "description")


def list_tags(stacks: DataFrame) -> DataFrame:
    return stacks.select("catalog_id", F.explode("tags").alias("tag")).distinct()


# -- sectioned documents -------------------------------------------------------

# Section order; other sections follow alphabetically.
SECTION_ORDER = [
    "Framework", "Application", "Security", "Database", "Cache", "Auth", "Storage", "Service",
    "Infrastructure", "CI/CD",
]
SECTION_KEYS = ["catalog_id", "stack_id", "rank", "category", "part", "var", "sub"]


def section_rank(category: Column | str) -> Column:
    position = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.coalesce(category, F.lit("")))
    return F.when(position > 0, position - 1).otherwise(999).cast("int")


def sections(resolved: DataFrame, variant: str = "example") -> DataFrame:
    """Document lines, ordered by ``SECTION_KEYS`` inside a stack.

    Variants: ``example``; ``template`` (assignments as TODO comments);
    ``addition`` (alphabetical, no required marks). Rows sort into the document.
    """
    name = F.coalesce("category", F.lit("General"))
    rank = F.lit(0) if variant == "addition" else section_rank("category")
    title = F.concat(F.lit("# [ADDED] "), name) if variant == "addition" else F.concat(F.lit("# ── "), name, F.lit(" ──"))
    ids = ["catalog_id", "stack_id"]
    assign = F.concat("var", F.lit("="), "example_value")
    if variant == "template":
        assign = F.concat(F.lit("# TODO: "), assign)
    mark = {"example": "  # (required)", "template": "  # (required - must be set)"}.get(variant)

    def line(sub: int, text: Column, condition: Column | None = None) -> Column:
        record = F.struct(F.lit(sub).alias("sub"), text.alias("text"))
        return record if condition is None else F.when(condition, record)

    described = line(0, F.concat(F.lit("# "), "description"), F.col("description").isNotNull())
    lines = [described, line(1, assign)]
    if mark:
        lines.append(line(2, F.lit(mark), F.col("required")))
    body = resolved.select(
        *ids, rank.alias("rank"), "category", F.lit(1).alias("part"), "var",
        F.explode(F.array_compact(F.array(*lines))).alias("_l"),
    )
    edges = [F.struct(F.lit(0).alias("part"), F.lit(0).alias("sub"), F.lit("").alias("text")),
             F.struct(F.lit(0).alias("part"), F.lit(1).alias("sub"), title.alias("text"))]
    if variant == "example":
        edges.append(F.struct(F.lit(2).alias("part"), F.lit(0).alias("sub"), F.lit("").alias("text")))
    heads = resolved.select(*ids, "category").distinct().select(
        *ids, rank.alias("rank"), "category", F.explode(F.array(*edges)).alias("_l")
    ).select(*ids, "rank", "category", "_l.part", F.lit("").alias("var"), "_l.sub", "_l.text")
    out = body.select(*ids, "rank", "category", "part", "var", "_l.sub", "_l.text").unionByName(heads)
    if variant == "template":
        opening = F.lit("# TODO: Replace placeholder values with real credentials")
        first = resolved.select(*ids).distinct().select(
            *ids, F.lit(-1).alias("rank"), F.lit(None).cast("string").alias("category"), F.lit(0).alias("part"),
            F.lit("").alias("var"), F.lit(0).alias("sub"), opening.alias("text"),
        )
        out = out.unionByName(first)
    return out


def rollup_sources(resolved: DataFrame) -> DataFrame:
    """Variables per source kind and distinct categories, as rows."""
    return resolved.groupBy("catalog_id", "stack_id", "source_kind").agg(F.count(F.lit(1)).alias("n_vars"))


def rollup_categories(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("category").isNotNull()).select("catalog_id", "stack_id", "category").distinct()


# -- merging into existing text ------------------------------------------------

def conflicts(files: DataFrame, new_vars: DataFrame) -> DataFrame:
    """Assignments whose key is among the new variables with another value.

    ``new_vars(project_id, var, example_value)``; every line of the text counts.
    """
    lines = to_lines(files.select("project_id", "content"))
    text = trim("line")
    existing = lines.withColumn("_t", text).filter(F.col("_t").contains("=")).select(
        "project_id", F.col("line_no").alias("existing_line"),
        trim(F.substring_index("_t", "=", 1)).alias("var"),
        trim(after_first(F.col("_t"), "=")).alias("existing_value"),
    )
    fresh = new_vars.select("project_id", "var", F.col("example_value").alias("new_value"))
    return existing.join(fresh, ["project_id", "var"]).filter(F.col("existing_value") != F.col("new_value"))


def merge_without_conflicts(
    new_vars: DataFrame, found: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """New variables to append: conflicting names are left out.

    With ``existing(project_id, var)`` names that are already there with an equal
    value are left out too; without it they are appended again.
    """
    out = new_vars.join(found.select("project_id", "var").distinct(), ["project_id", "var"], "left_anti")
    if existing is not None:
        out = out.join(existing.select("project_id", "var"), ["project_id", "var"], "left_anti")
    return out
