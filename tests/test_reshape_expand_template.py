import json
import random
import re

from pyspark.sql import functions as F

from keyloom.operators import expand, reshape, template, upsert


def test_filters_and_rename(make_vars):
    v = make_vars({"p": {"APP_DB_URL": "u", "APP_SECRET": "s", "UNRELATED": "x"}})
    keys = lambda df, c="key": sorted(r[c] for r in df.collect())
    assert keys(reshape.select_keys(v, include="APP_*", exclude="*SECRET")) == ["APP_DB_URL"]
    kept = reshape.select_keys_any(v, include=["APP_*", "U?RELATED"], exclude=["*_URL"])
    assert keys(kept) == ["APP_SECRET", "UNRELATED"]
    assert keys(reshape.select_keys_any(v, include=[])) == []
    assert keys(reshape.restrip(reshape.select_keys_any(v, ["APP_*"]), strip="APP_"), "new_key") == ["DB_URL", "SECRET"]
    assert keys(reshape.restrip(v, add="X_"), "new_key") == ["X_APP_DB_URL", "X_APP_SECRET", "X_UNRELATED"]
    assert keys(reshape.rename(v, prefix="my_", style="camel"), "new_key") == ["myAppDbUrl", "myAppSecret", "myUnrelated"]


def _documents(rows, key):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.section, r.pos or 0)):
        out[r[key]] = out.get(r[key], "") + r.text
    return out


def test_exports(make_vars):
    v = make_vars({"p": {"A_B": 'x "y" \\', "C": "2"}})
    out = _documents(reshape.export(v, list(reshape.FORMAT_ALIASES)), "format")
    assert json.loads(out["json"]) == {"A_B": 'x "y" \\', "C": "2"} == json.loads(out["aws-secrets"])
    assert list(json.loads(out["railway"])) == ["A_B", "C"]
    assert json.loads(out["doppler"])["C"] == {"value": "2", "computed": False}
    assert json.loads(out["vercel"])["C"] == {"type": "plain", "value": "2", "target": ["production", "preview", "development"]}
    assert out["yaml"] == 'A_B: "x \\"y\\" \\\\"\nC: "2"\n'
    assert out["shell"].endswith('\n\nexport A_B="x \\"y\\" \\"\nexport C="2"\n')
    assert out["docker-compose"] == 'environment:\n  - A_B=x "y" \\\n  - C=2\n'
    assert out["kubernetes"].endswith('type: Opaque\nstringData:\n  A_B: x "y" \\\n  C: 2\n')
    assert out["terraform"].endswith('\n\na_b = "x \\"y\\" \\\\"\nc = "2"\n')
    b64 = _documents(reshape.export(v, ["k8s", "json"], base64=True), "format")
    assert "data:\n" in b64["kubernetes"] and json.loads(b64["json"])["C"] == "Mg=="


def test_export_of_any_size_is_one_document(spark):
    rows = spark.range(0, 500).selectExpr("'f' as file_id", "cast(id as int) as pos", "concat('K', id) as key", "'v' as value")
    out = _documents(reshape.export(rows, ["json"], salts=3), "format")
    assert json.loads(out["json"]) == {f"K{i}": "v" for i in range(500)}


def test_collisions(make_vars):
    v = reshape.rename(make_vars({"p": {"A_B": "1", "a_b": "2", "C": "3"}}), style="lower")
    assert [(r.new_key, r.n_keys, r.first_key, r.last_key) for r in reshape.collisions(v).collect()] == [("a_b", 2, "A_B", "a_b")]
    assert sorted(r.key for r in reshape.collision_members(v).collect()) == ["A_B", "a_b"]
    assert {r.new_key: r.new_value for r in reshape.collapse(v).collect()} == {"a_b": "2", "c": "3"}


def test_destination_keys(one):
    rows = [("azure", "A_B"), ("gcp", "A_B"), ("terraform", "A_B"), ("github", "A_B")]
    got = one("d k", rows, reshape.destination_key(F.col("d"), F.col("k")))
    assert [g[0] for g in got] == ["A-B", "a-b", "a_b", "A_B"]


def test_upsert(spark):
    secrets = spark.createDataFrame([("d", "A"), ("d", "B"), ("e", "A")], "destination string, key string")
    existing = spark.createDataFrame([("d", "A"), ("d", "A")], "destination string, key string")

    def run(**kw):
        return sorted((r.destination, r.key, r.action, r.conflict) for r in upsert.plan(secrets, existing, **kw).collect())

    rest = [("d", "B", "upload", False), ("e", "A", "upload", False)]
    assert run() == [("d", "A", "skip", False), *rest] == run(skip_existing=True) == run(skip_existing=True, overwrite=True)
    assert run(overwrite=True) == [("d", "A", "upload", True), *rest]
    assert run(dry_run=True) == [("d", "A", "upload", False), *rest]
    s = {r.destination: r for r in upsert.summary(upsert.plan(secrets, existing, overwrite=True)).collect()}
    assert (s["d"].uploaded, s["d"].skipped, s["d"].conflicts) == (2, 0, 1)
    dry = upsert.plan(secrets, existing, dry_run=True)
    s = {r.destination: r for r in upsert.summary(dry, dry_run=True, lists_existing=False).collect()}
    assert (s["d"].uploaded, s["d"].skipped) == (0, 2)


def brute_expand(vars_, key, limit=10):
    class Stop(Exception):
        pass

    def go(value, stack, depth):
        if depth > limit:
            raise Stop("ExpansionDepthExceeded")

        def sub(m):
            braced, bare = m.group(1), m.group(2)
            name = braced if braced is not None else bare
            if name in stack:
                raise Stop("CircularExpansion")
            if name in vars_:
                return go(vars_[name], [*stack, name], depth + 1)
            if braced is not None:
                raise Stop("UndefinedVariable")
            return m.group(0)

        return re.sub(r"\$\{([^}]*)\}?|\$([A-Za-z0-9_]+)", sub, value)

    try:
        return go(vars_[key], [], 0), None
    except Stop as e:
        return None, str(e)


def test_expand_cases(make_vars):
    v = make_vars({"p": {"BASE": "http://localhost", "API": "${BASE}/api", "FULL": "${API}/v1:$BASE:80", "L": "a$ $UNDEF ${BASE",
                         "BAD": "x${NOPE}", "C1": "${C2}", "C2": "${C1}", "SELF": "$SELF", "PRICE": "5$"},
                   "q": {"X": "${BASE}"}})
    got = {(r.project_id, r.key): (r.value, r.error, r.detail) for r in expand.expand(v).collect()}
    assert got["p", "FULL"] == ("http://localhost/api/v1:http://localhost:80", None, None)
    assert got["p", "L"] == ("a$ $UNDEF http://localhost", None, None)
    assert got["p", "BAD"] == (None, "UndefinedVariable", "NOPE") and got["q", "X"][1] == "UndefinedVariable"
    assert got["p", "C1"] == (None, "CircularExpansion", "C2 → C1 → C2")
    assert got["p", "SELF"] == (None, "CircularExpansion", "SELF → SELF")
    assert got["p", "PRICE"][0] == "5$" and len(got) == 10
    chain = make_vars({"p": {"A": "base", "B": "${A}", "C": "${B}", "D": "${C}"}})
    deep = {r.key: r.error for r in expand.expand(chain, max_depth=2).collect()}
    assert deep == {"A": None, "B": None, "C": None, "D": "ExpansionDepthExceeded"}


def test_expand_against_brute_force(make_vars):
    rnd = random.Random(11)
    projects = {}
    for p in range(25):
        names = [f"V{i}" for i in range(14)]
        kv = {}
        for i, n in enumerate(names):
            low = max(0, i - 2) if p % 2 else 0
            picks = [rnd.choice(names[low:i] or names[:1]) if rnd.random() < 0.9 else rnd.choice(names + ["NONE"])
                     for _ in range(rnd.randint(0, 2))]
            kv[n] = "t" + "".join(rnd.choice(["${%s}", "-$%s."]) % x for x in picks)
        projects[f"p{p}"] = kv
    got = {(r.project_id, r.key): (r.value, r.error) for r in expand.expand(make_vars(projects)).collect()}
    want = {(p, k): brute_expand(kv, k) for p, kv in projects.items() for k in kv}
    assert got == want
    assert len({e for _, e in want.values()}) >= 3


def test_expand_hot_reference(spark):
    """A third of all references point at one key of one file."""
    rows = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('p', id % 50)) as project_id", "if(id % 3 = 0, 'hot', concat('p', id % 50)) as file_id",
        "concat('K', id) as key", "if(id % 3 = 0 and id > 0, concat('<$', '{K0}>'), 'plain') as value")
    out = expand.expand(rows)
    assert out.count() == 6000 and out.filter("value = '<plain>'").count() == 1999


def test_undefined_references(make_vars):
    v = make_vars({"p": {"A": "${B} $C ${A}", "B": "1"}})
    got = sorted((r.key, r.name, r.braced, r.error) for r in expand.undefined_references(v).collect())
    assert got == [("A", "C", False, None)]


def templates(spark, *bodies):
    return spark.createDataFrame([("p", f"t{i}", b) for i, b in enumerate(bodies)], "project_id string, template_id string, body string")


def test_render(spark, make_vars):
    v = make_vars({"p": {"HOST": "localhost", "PORT": "3000", "EMPTY": "", "Q": 'say "hi" $HOST', "FLAG": "yes"}})
    bodies = {
        "host={{HOST|upper}}, port=${PORT}": "host=LOCALHOST, port=3000",
        "$HOST:$PORT $HOSTNAME $HOSTé": "localhost:3000 $HOSTNAME $HOSTé",
        "{{Q}} {{Q|json}}": 'say "hi" $HOST "say \\"hi\\" $HOST"',
        "{{EMPTY|default:x y}} {{HOST|default:z}} {{NONE|default:n}}": "x y localhost {{NONE|default:n}}",
        "{{FLAG|bool}} {{HOST|title}} {{HOST|nope}} ${{HOST}} $ { {{": "true Localhost {{HOST|nope}} $localhost $ { {{",
        "": None, "no refs": "no refs",
    }
    out = {r.template_id: (r.text, r.error) for r in template.render(templates(spark, *bodies), v).collect()}
    for i, want in enumerate(bodies.values()):
        if want is not None:
            assert out[f"t{i}"] == (want, None)
    bad = template.render(templates(spark, "{{HOST|int}} {{PORT|int}}"), v).collect()[0]
    assert bad.text is None and "HOST" in bad.error
    absent = template.render(templates(spark, "{{NONE|default:n}}"), v, default_when_absent=True).collect()[0]
    assert absent.text == "n"


def test_undefined_names(spark, make_vars):
    t = templates(spark, "${B} {{A|upper}} $C {{D}} $B")
    got = template.undefined(t, make_vars({"p": {"A": "1"}})).orderBy("pos").collect()
    assert [r.name for r in got] == ["B", "C", "D"]


def test_pieces_are_put_together_once(make_vars):
    chain = {f"K{i}": f"{i}/${{K{i - 1}}}" for i in range(1, 9)}
    out = expand.expand(make_vars({"p": {"K0": "", "L": "$ $$K0|$NO.${K2", "M": "${K3}-${GONE}${K4}", **chain}}))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    rows = {r.key: (r.value, r.error, r.detail) for r in out.collect()}
    assert rows["K8"] == ("8/7/6/5/4/3/2/1/", None, None) and rows["K0"] == ("", None, None)
    assert rows["L"] == ("$ $|$NO.2/1/", None, None)
    assert rows["M"] == (None, "UndefinedVariable", "GONE")


def test_configs_are_parsed_once_for_all_rounds(spark):
    from __spark_entry__ import queries

    plan = queries()["expand_configs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan
