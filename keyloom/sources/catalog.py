"""The catalog of frameworks, services, infrastructure and stacks: nested JSON to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
_PAIRS = T.MapType(T.StringType(), T.StringType())


def _component(*extra: T.StructField) -> T.MapType:
    fields = [
        T.StructField("display_name", T.StringType()),
        T.StructField("vars", _STRINGS),
        T.StructField("defaults", _PAIRS),
        T.StructField("descriptions", _PAIRS),
        *extra,
    ]
    return T.MapType(T.StringType(), T.StructType(fields))


_CATEGORY = T.StructField("category", T.StringType())
_SERVICES = _component(_CATEGORY, T.StructField("required", _STRINGS))

# Service groups in lookup order, with the title used in listings.
SERVICE_GROUPS = {
    "databases": "Databases", "messaging_queues": "Messaging", "auth_providers": "Auth", "storage": "Storage",
    "monitoring_logging": "Monitoring", "payments": "Payments", "ai_ml": "AI/ML", "email_sms": "Email/SMS",
}

CATALOG_SCHEMA = T.StructType([
    T.StructField("languages", T.MapType(T.StringType(), T.StructType([
        T.StructField("display_name", T.StringType()),
        T.StructField("frameworks", _component(T.StructField("categories", _PAIRS))),
    ]))),
    T.StructField("services", T.StructType([T.StructField(g, _SERVICES) for g in SERVICE_GROUPS])),
    T.StructField("infrastructure", _component(_CATEGORY)),
    T.StructField("stacks", T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("components", T.StructType([
            T.StructField("language", T.StringType()),
            T.StructField("framework", T.StringType()),
            T.StructField("services", _STRINGS),
            T.StructField("infrastructure", _STRINGS),
        ])),
        T.StructField("tags", _STRINGS),
    ]))),
])


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """One row per catalog file, explicit schema; absent optional fields are null."""
    return spark.read.schema(CATALOG_SCHEMA).option("multiLine", "true").json(path).select(
        F.col("_metadata.file_path").alias("catalog_id"), "*"
    )


def parse_catalogs(texts: DataFrame, text: str = "json") -> DataFrame:
    """Catalogs kept as JSON text in a table column."""
    rest = [c for c in texts.columns if c != text]
    # The one-element explode makes Spark parse each text once, not once per field.
    parsed = F.explode(F.array(F.from_json(text, CATALOG_SCHEMA)))
    return texts.select(*rest, parsed.alias("_c")).select(*rest, "_c.*")


def components(catalogs: DataFrame) -> DataFrame:
    """One row per framework, service and infrastructure entry, in one pass.

    ``scope`` is the language of a framework and the group of a service; an id found
    in several service groups belongs to the first (``group_rank``).
    """
    no_map = F.lit(None).cast("map<string,string>")
    no_list = F.lit(None).cast("array<string>")
    no_text = F.lit(None).cast("string")

    def entries(of: Column, kind: str, scope: Column, rank: int, categories=None, required=None, category=None) -> Column:
        def entry(e: Column) -> Column:
            c = e["value"]
            return F.struct(
                F.lit(kind).alias("kind"), scope.alias("scope"), e["key"].alias("component_id"),
                F.coalesce(c["display_name"], e["key"]).alias("display_name"),
                (c[category] if category else no_text).alias("category"), F.lit(rank).alias("group_rank"),
                c["vars"].alias("vars"), c["defaults"].alias("defaults"), c["descriptions"].alias("descriptions"),
                (c[categories] if categories else no_map).alias("categories"),
                (c[required] if required else no_list).alias("required"),
            )

        return F.transform(F.map_entries(of), entry)

    frameworks = F.flatten(F.transform(
        F.map_entries("languages"),
        lambda l: entries(l["value"]["frameworks"], "framework", l["key"], 0, categories="categories"),
    ))
    services = [
        entries(F.col(f"services.{g}"), "service", F.lit(g), i, required="required", category="category")
        for i, g in enumerate(SERVICE_GROUPS)
    ]
    infra = entries(F.col("infrastructure"), "infrastructure", F.lit(""), 0, category="category")
    found = F.flatten(F.array_compact(F.array(frameworks, *services, infra)))
    return catalogs.select("catalog_id", F.explode(found).alias("_e")).select("catalog_id", "_e.*")


def stacks(catalogs: DataFrame) -> DataFrame:
    return catalogs.select("catalog_id", F.explode("stacks").alias("stack_id", "s")).select(
        "catalog_id", "stack_id", "s.name", "s.description", "s.components.*", "s.tags"
    )
