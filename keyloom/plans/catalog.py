"""Catalog queries: a catalog per nation group built from nations, suppliers and regions;
every order is a stack that picks its lines' suppliers as services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import catalog as C
from keyloom.operators.extract import parse_vars
from keyloom.plans import inputs as I
from keyloom.plans import oracle as O
from keyloom.plans.registry import query
from keyloom.sources import catalog as source

GROUPS = list(source.SERVICE_GROUPS)


def _entry(cols: str = "v0, v1, v2", extra: str = "") -> str:
    """JSON of one component, as SQL that both engines read."""
    return (
        "concat('{\"display_name\":\"', display, '\",\"vars\":[\"', v0, '\",\"', v1, '\",\"', v2, '\"],"
        "\"defaults\":{\"', v0, '\":\"', display, ' default\"},\"descriptions\":{\"', v1, '\":\"about ', v1, '\"}'"
        + extra + ", '}')"
    )


_SERVICE_JSON = _entry(extra=", ',\"required\":[\"', v1, '\"]', CASE WHEN category IS NULL THEN '' ELSE concat(',\"category\":\"', category, '\"') END")
_FRAMEWORK_JSON = _entry(extra=", ',\"categories\":{\"', v2, '\":\"Framework\"}'")


def _texts(spark, sf) -> DataFrame:
    """Catalog documents: JSON text of one component each, in a catalog of its kind.

    One document per component keeps the texts small however many there are.
    """
    services = I.SERVICES.df(spark, sf).selectExpr(
        "'c' AS catalog_id", f"concat('{{\"services\":{{\"', scope, '\":{{\"', id, '\":', {_SERVICE_JSON}, '}}}}}}') AS json"
    )
    frameworks = I.FRAMEWORKS.df(spark, sf).selectExpr(
        "'c' AS catalog_id", f"concat('{{\"languages\":{{\"', scope, '\":{{\"frameworks\":{{\"', id, '\":', {_FRAMEWORK_JSON}, '}}}}}}}}') AS json"
    )
    infra = I.INFRA.df(spark, sf).selectExpr(
        "'c' AS catalog_id", f"concat('{{\"infrastructure\":{{\"', id, '\":', {_entry()}, '}}}}') AS json"
    )
    return services.unionByName(frameworks).unionByName(infra)


def _components(spark, sf) -> DataFrame:
    return source.components(source.parse_catalogs(_texts(spark, sf)))


def _flat(spark, sf) -> DataFrame:
    return C.flatten(C.first_groups(_components(spark, sf)))


def _vars_sql() -> str:
    by_name = """CASE WHEN regexp_matches(lower(var), 'secret|key|token') THEN 'Security' WHEN regexp_matches(lower(var), 'database|db_|postgres|mysql') THEN 'Database'
WHEN contains(lower(var), 'redis') THEN 'Cache' WHEN regexp_matches(lower(var), 'auth|oauth') THEN 'Auth' WHEN regexp_matches(lower(var), 'url|host|port') THEN 'Connection'
WHEN regexp_matches(lower(var), 'aws|s3') THEN 'Cloud' ELSE 'Application' END"""
    by_id = """CASE WHEN regexp_matches(id, 'postgres|mysql|mongo') THEN 'Database' WHEN contains(id, 'redis') THEN 'Cache' WHEN regexp_matches(id, 's3|storage|cloudinary') THEN 'Storage'
WHEN regexp_matches(id, 'auth|oauth|clerk') THEN 'Auth' WHEN regexp_matches(id, 'stripe|payment|razorpay') THEN 'Payments' WHEN regexp_matches(id, 'sentry|datadog|log') THEN 'Monitoring'
WHEN regexp_matches(id, 'openai|anthropic|ai') THEN 'AI/ML' ELSE 'Service' END"""

    def rows(kind: str, src: str, category: str, required: str) -> str:
        return f"""SELECT '{kind}' AS source_kind, scope, id AS source_id, CAST(pos AS INTEGER) AS pos, var, CASE WHEN pos = 0 THEN display || ' default' ELSE 'your_' || lower(var) || '_value' END AS example_value,
CASE WHEN pos = 1 THEN 'about ' || var END AS description, {category} AS category, {required} AS required
FROM (SELECT *, unnest([v0, v1, v2]) AS var, unnest([0, 1, 2]) AS pos FROM {src})"""

    return f"""svc AS ({I.SERVICES.sql()}), fw AS ({I.FRAMEWORKS.sql()}), inf AS ({I.INFRA.sql()}),
cv AS ({rows('framework', 'fw', f"CASE WHEN pos = 2 THEN 'Framework' ELSE {by_name} END", 'true')}
UNION ALL {rows('service', 'svc', f'coalesce(category, {by_id})', 'pos = 1')} UNION ALL {rows('infrastructure', 'inf', "'Infrastructure'", 'false')})"""


@query("catalog_flatten", f"WITH {_vars_sql()} SELECT * FROM cv")
def catalog_flatten(spark, sf):
    return _flat(spark, sf).drop("catalog_id")


# Stacks: order = customer's nation as framework, suppliers of its lines as services in
# line order, one region as infrastructure.
_LINES_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem"


def _stacks(spark, sf) -> DataFrame:
    """Selections ``(stack, stage, ord, kind, id)`` read from orders and their lines."""
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nation = I.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = I.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    suppliers = I.table(spark, sf, "supplier").selectExpr("s_suppkey", f"{I.SERVICES.columns['id']} AS service_id")
    stack = F.col("o_orderkey").cast("string").alias("stack_id")
    none = F.lit(None).cast("string")
    owned = orders.join(nation, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    pick = F.array(
        F.struct(F.lit(1).alias("stage"), F.lit("framework").alias("source_kind"),
                 F.concat(F.lit("lang"), F.col("n_regionkey").cast("string")).alias("language"),
                 F.concat(F.lit("fw"), F.col("c_nationkey").cast("string")).alias("source_id")),
        F.struct(F.lit(3).alias("stage"), F.lit("infrastructure").alias("source_kind"), none.alias("language"),
                 F.concat(F.lit("infra"), F.col("n_regionkey").cast("string")).alias("source_id")),
    )
    fixed = owned.select(stack, F.explode(pick).alias("p")).select(
        F.lit("c").alias("catalog_id"), "stack_id", "p.stage", F.lit(0).alias("ord"), "p.source_kind", "p.language", "p.source_id"
    )
    services = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lit("c").alias("catalog_id"), F.col("l_orderkey").cast("string").alias("stack_id"), F.lit(2).alias("stage"),
        F.col("l_linenumber").cast("int").alias("ord"), F.lit("service").alias("source_kind"), none.alias("language"),
        F.col("service_id").alias("source_id"),
    )
    return fixed.unionByName(services)


_SEL = f"""sel AS (SELECT CAST(o_orderkey AS VARCHAR) AS stack_id, 1 AS stage, 0 AS ord, 'framework' AS source_kind, 'fw' || c_nationkey AS source_id FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 2, l_linenumber, 'service', id FROM lineitem JOIN (SELECT s_suppkey, {I.SERVICES.columns['id']} AS id FROM supplier) ON l_suppkey = s_suppkey
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 3, 0, 'infrastructure', 'infra' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
res AS (SELECT stack_id, var, source_kind, source_id, example_value, description, category, required FROM (
SELECT *, row_number() OVER (PARTITION BY stack_id, var ORDER BY stage, ord, pos, source_id) AS rn FROM sel JOIN cv USING (source_kind, source_id)) WHERE rn = 1)"""


def _resolved(spark, sf) -> DataFrame:
    return C.resolve(_stacks(spark, sf), _flat(spark, sf))


@query("resolve_stacks", f"WITH {_vars_sql()}, {_SEL} SELECT * FROM res")
def resolve_stacks(spark, sf):
    return _resolved(spark, sf).drop("catalog_id")


def _stack_texts(spark, sf) -> DataFrame:
    """Catalog documents of one stack each: the components of an order, nested as a catalog file has them."""
    chosen = _stacks(spark, sf)
    kind, source_id = F.col("source_kind"), F.col("source_id")
    # an order has at most seven lines
    services = F.transform(F.array_sort(F.collect_list(F.when(kind == "service", F.struct("ord", source_id.alias("id"))))), lambda x: x["id"])
    parts = chosen.groupBy("catalog_id", "stack_id").agg(
        F.max(F.when(kind == "framework", F.col("language"))).alias("language"), F.max(F.when(kind == "framework", source_id)).alias("framework"),
        services.alias("services"), F.max(F.when(kind == "infrastructure", source_id)).alias("infra"),
    )
    components = F.struct("language", "framework", "services", F.array_compact(F.array("infra")).alias("infrastructure"))
    stack = F.create_map("stack_id", F.struct(F.concat(F.lit("Stack "), "stack_id").alias("name"), components.alias("components")))
    return parts.select("catalog_id", F.to_json(F.struct(stack.alias("stacks"))).alias("json"))


@query("resolve_nested", f"WITH {_vars_sql()}, {_SEL} SELECT * FROM res")
def resolve_nested(spark, sf):
    """From nested catalog documents: stacks, their selections, and the variables of both kinds of components."""
    catalogs = source.parse_catalogs(_texts(spark, sf).unionByName(_stack_texts(spark, sf)))
    flat = C.flatten(C.first_groups(source.components(catalogs)))
    return C.resolve(C.selections(source.stacks(catalogs)), flat).drop("catalog_id")


@query("source_rollup", f"WITH {_vars_sql()}, {_SEL} SELECT stack_id, source_kind, CAST(count(*) AS BIGINT) AS n_vars FROM res GROUP BY stack_id, source_kind")
def source_rollup(spark, sf):
    return C.rollup_sources(_resolved(spark, sf)).drop("catalog_id")


@query("category_rollup", f"WITH {_vars_sql()}, {_SEL} SELECT DISTINCT stack_id, category FROM res")
def category_rollup(spark, sf):
    return C.rollup_categories(_resolved(spark, sf)).drop("catalog_id")


_RANK = "coalesce(list_position(['Framework','Application','Security','Database','Cache','Auth','Storage','Service','Infrastructure','CI/CD'], category) - 1, 999)"


def _sections_sql(variant: str) -> str:
    rank = "0" if variant == "addition" else f"CAST({_RANK} AS INTEGER)"
    title = "'# [ADDED] ' || category" if variant == "addition" else "'# ── ' || category || ' ──'"
    assign = "'# TODO: ' || var || '=' || example_value" if variant == "template" else "var || '=' || example_value"
    out = f"""SELECT stack_id, {rank} AS rank, category, 1 AS part, var, 0 AS sub, '# ' || description AS text FROM res WHERE description IS NOT NULL
UNION ALL SELECT stack_id, {rank}, category, 1, var, 1, {assign} FROM res
UNION ALL SELECT stack_id, {rank}, category, 0, '', 0, '' FROM (SELECT DISTINCT stack_id, category FROM res)
UNION ALL SELECT stack_id, {rank}, category, 0, '', 1, {title} FROM (SELECT DISTINCT stack_id, category FROM res)"""
    if variant == "example":
        out += f""" UNION ALL SELECT stack_id, {rank}, category, 2, '', 0, '' FROM (SELECT DISTINCT stack_id, category FROM res)
UNION ALL SELECT stack_id, {rank}, category, 1, var, 2, '  # (required)' FROM res WHERE required"""
    if variant == "template":
        out += f""" UNION ALL SELECT stack_id, {rank}, category, 1, var, 2, '  # (required - must be set)' FROM res WHERE required
UNION ALL SELECT DISTINCT stack_id, -1, CAST(NULL AS VARCHAR), 0, '', 0, '# TODO: Replace placeholder values with real credentials' FROM res"""
    return f"WITH {_vars_sql()}, {_SEL} {out}"


def _section_query(name: str, variant: str) -> None:
    @query(name, _sections_sql(variant))
    def run(spark, sf):
        return C.sections(_resolved(spark, sf), variant).drop("catalog_id")


_section_query("sections", "example")
_section_query("sections_template", "template")
_section_query("sections_addition", "addition")

_TITLES = "MAP {'databases': ['Database', 'Cache'], 'auth_providers': ['Auth'], 'storage': ['Storage'], 'monitoring_logging': ['Monitoring'], 'payments': ['Payments'], 'ai_ml': ['AI/ML'], 'email_sms': ['Email/SMS']}"


@query("catalog_search", f"""WITH t AS (SELECT unnest(['REDIS', '1', 'group 2']) AS term), s AS ({I.SERVICES.sql()})
SELECT term, id AS component_id, display AS display_name, unnest({_TITLES}[scope]) AS group_title FROM s JOIN t
ON contains(lower(id), lower(term)) OR contains(lower(display), lower(term)) OR contains(lower(coalesce(category, '')), lower(term))""")
def catalog_search(spark, sf):
    return C.search_services(_components(spark, sf), ["REDIS", "1", "group 2"]).drop("catalog_id")


@query("framework_search", f"""SELECT t.term, id AS component_id, display AS display_name FROM ({I.FRAMEWORKS.sql()}) JOIN (SELECT unnest(['2', 'NATION_1']) AS term) t
ON contains(lower(id), lower(t.term)) OR contains(lower(display), lower(t.term)) WHERE scope = 'lang1'""")
def framework_search(spark, sf):
    return C.search_frameworks(_components(spark, sf), "lang1", ["2", "NATION_1"]).drop("catalog_id")


# As many terms as suppliers; some are short, empty, or differ in case only.
_TERMS = I.Derived("supplier", {"term": I.pick("s_suppkey", ["upper(s_name)", I.text("s_suppkey"), "'s'", "'S'", "concat('group ', cast(s_nationkey as string))", "''", "concat('dis', cast(s_nationkey as string))"])})


@query("catalog_search_table", f"""WITH t AS (SELECT DISTINCT term FROM ({_TERMS.sql()})), s AS ({I.SERVICES.sql()})
SELECT term, id AS component_id, display AS display_name, unnest({_TITLES}[scope]) AS group_title FROM s JOIN t
ON contains(lower(id), lower(term)) OR contains(lower(display), lower(term)) OR contains(lower(coalesce(category, '')), lower(term))""")
def catalog_search_table(spark, sf):
    return C.search_services(C.first_groups(_components(spark, sf)).withColumn("kind", F.lit("service")), _TERMS.df(spark, sf)).drop("catalog_id")


@query("service_listing", f"""SELECT id AS component_id, display AS display_name, CAST(list_position({GROUPS}, scope) - 1 AS INTEGER) AS group_rank,
{list(source.SERVICE_GROUPS.values())}[list_position({GROUPS}, scope)] AS group_title FROM ({I.SERVICES.sql()})""")
def service_listing(spark, sf):
    return C.list_services(_components(spark, sf)).drop("catalog_id")


@query("framework_listing", f"SELECT scope AS language, id AS component_id, display AS display_name FROM ({I.FRAMEWORKS.sql()})")
def framework_listing(spark, sf):
    return C.list_frameworks(_components(spark, sf)).drop("catalog_id")


@query("service_lookup", f"SELECT id AS component_id, scope, display AS display_name, category FROM ({I.SERVICES.sql()}) WHERE id = 'redis9'")
def service_lookup(spark, sf):
    return C.lookup_service(_components(spark, sf), "redis9").select("component_id", "scope", "display_name", "category")


# Part types as tags of parts.
_TAGGED = I.Derived("part", {"catalog_id": "'c'", "stack_id": I.text("p_partkey"), "name": "p_name", "description": "p_brand", "tags": "split(concat(p_type, ' ', p_name), ' ')"})
_TAGS = "SELECT CAST(p_partkey AS VARCHAR) AS stack_id, p_name AS name, p_brand AS description, string_split(p_type || ' ' || p_name, ' ') AS tags FROM part"


@query("tags", f"SELECT DISTINCT unnest(tags) AS tag FROM ({_TAGS})")
def tags(spark, sf):
    return C.list_tags(_TAGGED.df(spark, sf)).select("tag")


@query("stack_listing", f"SELECT stack_id, name FROM ({_TAGS})")
def stack_listing(spark, sf):
    return C.list_stacks(_TAGGED.df(spark, sf)).drop("catalog_id")


@query("stack_lookup", f"SELECT stack_id, name, description FROM ({_TAGS}) WHERE stack_id = (SELECT min(stack_id) FROM ({_TAGS}))")
def stack_lookup(spark, sf):
    stacks = _TAGGED.df(spark, sf)
    wanted = stacks.agg(F.min("stack_id")).first()[0]
    return C.lookup_stack(stacks, wanted).select("stack_id", "name", "description")


@query("framework_lookup", f"SELECT scope AS language, id AS component_id, display AS display_name FROM ({I.FRAMEWORKS.sql()}) WHERE scope = 'lang3' AND id = 'fw8'")
def framework_lookup(spark, sf):
    return C.lookup_framework(_components(spark, sf), "lang3", "fw8").drop("catalog_id")


@query("stacks_by_tag", f"SELECT stack_id, name, description FROM ({_TAGS}) WHERE list_contains(tags, 'red')")
def stacks_by_tag(spark, sf):
    return C.stacks_by_tag(_TAGGED.df(spark, sf), "red").drop("catalog_id")


# New variables meet the configuration files of orders (one project per file here).
_FILES = I.Derived(I.CONFIGS, {"project_id": "file_id", "content": "content"})
_NEW = I.Derived("orders", {"project_id": f"concat('o', {I.text('o_orderkey')})",
                            "var": I.pick("o_orderkey", ["'ORDER_ID'", "'REF'", "'TAIL'", "'FRESH'", "'EMPTY'"]),
                            "example_value": I.pick("o_orderkey", [I.text("o_orderkey"), "'x'", "'end'", "'new'", "''"])})
_CONFLICT = f"""WITH cl AS (SELECT *, {O.trim('line')} AS t FROM ({O.lines('(' + _FILES.sql() + ')', keys='project_id')})),
ckv AS (SELECT project_id, line_no AS existing_line, {O.trim("split_part(t, '=', 1)")} AS var, {O.trim("substr(t, instr(t, '=') + 1)")} AS existing_value FROM cl WHERE contains(t, '=')),
n AS ({_NEW.sql()}), c AS (SELECT project_id, var, existing_line, existing_value, example_value AS new_value FROM ckv JOIN n USING (project_id, var) WHERE existing_value <> example_value)"""


@query("conflicts", f"{_CONFLICT} SELECT * FROM c")
def conflicts(spark, sf):
    return C.conflicts(_FILES.df(spark, sf), _NEW.df(spark, sf))


@query("merge_again", f"{_CONFLICT} SELECT * FROM n ANTI JOIN c USING (project_id, var)")
def merge_again(spark, sf):
    new = _NEW.df(spark, sf)
    return C.merge_without_conflicts(new, C.conflicts(_FILES.df(spark, sf), new))


@query("merge_new", f"""WITH RECURSIVE {O.parsed(I.CONFIGS.sql())}, n AS ({_NEW.sql()}), {_CONFLICT[5:].replace(f"n AS ({_NEW.sql()}), ", "")}
SELECT * FROM n ANTI JOIN c USING (project_id, var) ANTI JOIN (SELECT file_id AS project_id, key AS var FROM parsed WHERE error IS NULL) p USING (project_id, var)""")
def merge_new(spark, sf):
    new = _NEW.df(spark, sf)
    existing = parse_vars(I.CONFIGS.df(spark, sf)).select(F.col("file_id").alias("project_id"), F.col("key").alias("var"))
    return C.merge_without_conflicts(new, C.conflicts(_FILES.df(spark, sf), new), existing)
