import json
import os
import tempfile

import pytest

from keyloom.operators import catalog, detect, health, validate
from keyloom.operators.documents import write_lines
from keyloom.sources import catalog as source
from keyloom.sources import files, reports

# A small catalog of our own.
CATALOG = {
    "languages": {"ruby": {"display_name": "Ruby", "frameworks": {
        "rails": {"vars": ["SECRET_BASE", "SHARED", "RAILS_PORT"], "defaults": {"RAILS_PORT": "3100"},
                  "categories": {"SHARED": "Framework"}, "descriptions": {"SHARED": "shared thing"}},
        "sinatra": {"display_name": "Sinatra", "vars": ["RACK_NAME"]}}}},
    "services": {
        "databases": {"pg_postgres": {"display_name": "Postgres", "vars": ["PG_URL", "SHARED"], "required": ["PG_URL"]}},
        "storage": {"blob": {"vars": ["BLOB_X"], "category": "Files"}, "pg_postgres": {"vars": ["WRONG"]}},
        "messaging_queues": {"queue": {"vars": ["Q_URL"]}},
    },
    "infrastructure": {"ci": {"vars": ["CI_TOKEN", "PG_URL"]}},
    "stacks": {
        "s1": {"name": "One", "description": "d1", "tags": ["web", "db"],
               "components": {"language": "ruby", "framework": "rails", "services": ["pg_postgres", "missing"], "infrastructure": ["ci"]}},
        "s2": {"name": "Two", "description": "d2", "components": {"language": "perl", "framework": "rails", "services": ["pg_postgres"]}},
    },
}


def load(spark):
    df = spark.createDataFrame([("c", json.dumps(CATALOG))], "catalog_id string, json string")
    parsed = source.parse_catalogs(df)
    return source.components(parsed), source.stacks(parsed)


def test_read_catalog_file(spark):
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "c.json")
        with open(path, "w") as f:
            json.dump(CATALOG, f, indent=1)
        assert source.components(source.read_catalogs(spark, path)).count() == 7


def test_resolve_first_source_wins(spark):
    comps, stacks = load(spark)
    flat = catalog.flatten(catalog.first_groups(comps))
    picks = catalog.selections(stacks)
    rows = {(r.stack_id, r["var"]): r for r in catalog.resolve(picks, flat).collect()}
    s1 = {k[1]: v for k, v in rows.items() if k[0] == "s1"}
    assert set(s1) == {"SECRET_BASE", "SHARED", "RAILS_PORT", "PG_URL", "CI_TOKEN"}
    assert (s1["SHARED"].source_kind, s1["SHARED"].category, s1["SHARED"].description) == ("framework", "Framework", "shared thing")
    assert (s1["PG_URL"].source_id, s1["PG_URL"].category, s1["PG_URL"].required) == ("pg_postgres", "Database", True)
    assert s1["SECRET_BASE"].category == "Security" and s1["SECRET_BASE"].example_value == "your_secret_base_value"
    assert s1["RAILS_PORT"].example_value == "3100" and s1["CI_TOKEN"].category == "Infrastructure"
    assert {k[1] for k in rows if k[0] == "s2"} == {"PG_URL", "SHARED"}  # unknown language, no framework
    again = catalog.resolve(picks.unionByName(picks), flat).count()
    assert again == len(rows)


def test_search_list_tags(spark):
    comps, stacks = load(spark)
    found = {(r.term, r.component_id, r.group_title) for r in catalog.search_services(comps, ["POST", "files", "queue"]).collect()}
    assert found == {("POST", "pg_postgres", "Database"), ("POST", "pg_postgres", "Cache"), ("POST", "pg_postgres", "Storage"),
                     ("files", "blob", "Storage")}
    assert [r.component_id for r in catalog.search_frameworks(comps, "ruby", ["sin"]).collect()] == ["sinatra"]
    assert [r.stack_id for r in catalog.stacks_by_tag(stacks, "db").collect()] == ["s1"]
    assert sorted(r.tag for r in catalog.list_tags(stacks).collect()) == ["db", "web"]
    titles = {r.group_title for r in catalog.list_services(comps).collect()}
    assert titles == {"Databases", "Storage", "Messaging"}
    assert catalog.list_frameworks(comps, "ruby").count() == 2
    assert catalog.lookup_framework(comps, "ruby", "rails").collect()[0].display_name == "rails"
    assert sorted(r.name for r in catalog.list_stacks(stacks).collect()) == ["One", "Two"]
    assert catalog.lookup_stack(stacks, "s2").collect()[0].language == "perl"
    assert catalog.lookup_service(comps, "pg_postgres").collect()[0].scope == "databases"


def text_of(rows):
    return [r.text for r in rows.filter("stack_id = 's1'").orderBy(*catalog.SECTION_KEYS).collect()]


def test_sections(spark):
    comps, stacks = load(spark)
    resolved = catalog.resolve(catalog.selections(stacks), catalog.flatten(catalog.first_groups(comps)))
    assert text_of(catalog.sections(resolved)) == [
        "", "# ── Framework ──", "# shared thing", "SHARED=your_shared_value", "  # (required)", "",
        "", "# ── Security ──", "SECRET_BASE=your_secret_base_value", "  # (required)", "",
        "", "# ── Database ──", "PG_URL=your_pg_url_value", "  # (required)", "",
        "", "# ── Infrastructure ──", "CI_TOKEN=your_ci_token_value", "",
        "", "# ── Connection ──", "RAILS_PORT=3100", "  # (required)", ""]
    todo = text_of(catalog.sections(resolved, "template"))
    assert todo[0].startswith("# TODO: Replace") and "# TODO: RAILS_PORT=3100" in todo and "  # (required - must be set)" in todo
    added = [t for t in text_of(catalog.sections(resolved, "addition")) if t.startswith("# [")]
    assert added == [f"# [ADDED] {c}" for c in ["Connection", "Database", "Framework", "Infrastructure", "Security"]]
    assert {r.source_kind: r.n_vars for r in catalog.rollup_sources(resolved).filter("stack_id='s1'").collect()} == {
        "framework": 3, "service": 1, "infrastructure": 1}
    assert catalog.rollup_categories(resolved).filter("stack_id='s1'").count() == 5


def test_conflicts(make_files, spark):
    existing = make_files([("p", ".env", "A=1\n# B=2\nB = 3\nC=4\nA=9")])
    new = spark.createDataFrame([("p", "A", "1"), ("p", "B", "2"), ("p", "C", "4"), ("p", "D", "5")], "project_id string, var string, example_value string")
    found = catalog.conflicts(existing, new)
    assert sorted((r["var"], r.existing_value, r.new_value, r.existing_line) for r in found.collect()) == [("A", "9", "1", 5), ("B", "3", "2", 3)]
    assert sorted(r["var"] for r in catalog.merge_without_conflicts(new, found).collect()) == ["C", "D"]
    have = spark.createDataFrame([("p", "A"), ("p", "B"), ("p", "C")], "project_id string, var string")
    assert [r["var"] for r in catalog.merge_without_conflicts(new, found, have).collect()] == ["D"]


def test_health(make_files):
    f = make_files([
        ("good", ".env", "A=1\n", 0o100600), ("good", ".env.example", "A="), ("good", ".gitignore", "# x\n/.env*\n"),
        ("good", "package.json", '{"devDependencies": {"dotenv": "^1"}}'), ("good", "Dockerfile", ""),
        ("risky", ".env", "A=1\nexport B=1\n", 0o644), ("risky", "requirements.txt", "django-dotenv\n#python-dotenv"),
        ("poetry", "pyproject.toml", "[tool.poetry]\npydantic-settings"), ("poetry", "package.json", "{}"),
        ("bare", "sub/Cargo.toml", ""),
    ])
    projects = {r.project_id: r for r in health.classify_projects(f).collect()}
    assert {p: r.project_type for p, r in projects.items()} == {
        "good": "Node.js", "risky": "Python (requirements)", "poetry": "Python (Poetry)", "bare": None}
    assert projects["good"].has_dotenv_dependency and projects["poetry"].has_dotenv_dependency
    assert projects["risky"].has_dotenv_dependency is False
    checks = {(r.project_id, r.name): r for r in health.project_checks(health.classify_projects(f)).collect()}
    assert {n: checks["good", n].severity for p, n in checks if p == "good"} == {
        "env_file": "ok", "env_example": "ok", "project_structure": "ok", "docker_config": "ok", "file_permissions": "ok"}
    assert {n: checks["risky", n].severity for p, n in checks if p == "risky"} == {
        "env_file": "error", "env_example": "warning", "project_structure": "warning", "docker_config": "info", "file_permissions": "warning"}
    assert "Line 2: invalid syntax 'export B=1'" in checks["risky", "env_file"].details
    assert checks["risky", "file_permissions"].details == "Permissions: 644 (recommended: 600)"
    s = {r.project_id: r for r in health.health_summary(health.project_checks(health.classify_projects(f))).collect()}
    assert (s["good"].health, s["risky"].health, s["bare"].health) == ("Excellent", "Action required", "Needs attention")
    assert (s["risky"].errors, s["risky"].warnings, s["risky"].fixable, s["risky"].total) == (1, 3, 2, 5)


def test_paths(one):
    rows = [(p,) for p in ["a/.env", "a/.env.local", "a/X.PY", "Makefile", "a.b/noext", "x/dist/a.py", "a/.env.example",
                           "logs/z.json", "foo."]]
    got = one("p", rows, files.is_scannable("p"), files.is_scannable("p", True), files.is_excluded("p", ["logs/*.json", "X.P", "a**"]), files.extension("p"))
    assert [g[0] for g in got] == [True, False, True, True, False, True, False, True, False]
    assert got[1][1] is True
    assert [g[2] for g in got] == [False, False, True, False, False, True, True, True, False]
    assert [g[3] for g in got] == [None, "local", "PY", None, None, "py", "example", "json", ""]


def test_read_files_and_scan(spark):
    with tempfile.TemporaryDirectory() as d:
        os.makedirs(os.path.join(d, "node_modules")), os.makedirs(os.path.join(d, "a b+c"))
        def put(name, data):
            with open(os.path.join(d, name), "wb") as f:
                f.write(data)
        put("a b+c/.env", b"DB_PASSWORD=hunter2hunter2\n")
        put("node_modules/x.js", b"no"), put("bin.py", b"a\x00b"), put("bad.py", b"\xff\xfe"), put("pic.png", b"ok")
        got = files.read_files(spark, d)
        assert sorted(os.path.relpath(r.path, d) for r in got.collect()) == ["a b+c/.env", "bin.py"]
        raw = spark.read.format("binaryFile").load(d).select("path", files.is_text("content").alias("t"))
        assert {os.path.basename(r.path): r.t for r in raw.collect()} == {"bin.py": False, "bad.py": False, "pic.png": True}
        assert [r.variable for r in detect.scan(got).collect()] == ["DB_PASSWORD"]


def test_reports(make_files, make_vars, spark):
    f = make_files([("p", f"{i}.env", "DB_PASSWORD=hunter2hunter2xx\nTOKEN=abcdefgh") for i in range(20)])
    found = detect.scan(f)
    rows = sorted(reports.sarif_documents(found).collect(), key=lambda r: (r.section, r.file_id or "", r.line_no or 0))
    results = json.loads("".join(r.text for r in rows))["runs"][0]["results"]
    assert len(results) == 40
    assert {r["level"] for r in results} == {"error", "warning"} and results[0]["ruleId"].startswith("secret/sensitive-config-key:-")
    line = json.loads(reports.json_rows(found, ["project_id"]).filter("json like '%TOKEN%'").first().json)
    assert line["action_url"] is None and line["variable"] == "TOKEN"
    env, ex = make_vars({"p": {"A": "True"}}), make_vars({"p": {"A": "", "B": ""}})
    issues, fixes = validate.validate(env, ex), validate.plan_fixes(env, ex)
    lines = sorted(r.text for r in reports.annotations(issues, fixes).collect())
    assert "::error file=.env,line=1::Missing required variable: B" in lines
    assert "::error file=.env,line=1::Suggestion: Add B=<value> to .env" in lines
    assert "::notice file=.env,line=1::Fixed: B → Added missing variable" in lines and len(lines) == 6
    with tempfile.TemporaryDirectory() as d:
        rows = spark.range(100).selectExpr("cast(id as int) pos", "concat('l', id) text")
        write_lines(rows, os.path.join(d, "out"), ["pos"], partitions=3)
        text = "".join(open(os.path.join(d, "out", n)).read() for n in sorted(os.listdir(os.path.join(d, "out"))) if n.endswith(".txt"))
        assert text.split() == [f"l{i}" for i in range(100)]


def test_write_payloads(spark, make_vars):
    from keyloom.operators.documents import write_documents
    from keyloom.operators.reshape import export

    docs = export(make_vars({"p": {"A": "1"}, "q": {"B": "2"}}), ["json", "tf"])
    with tempfile.TemporaryDirectory() as d:
        out = os.path.join(d, "out")
        write_documents(docs, out, ["file_id"], ["pos"], partition_by="format")
        back = spark.read.text(out)
        assert sorted(r.value for r in back.filter("format = 'json'").collect()) == ['"A":"1"', '"B":"2"', "{", "{", "}", "}"]


def test_stream_scan(spark, make_files):
    from keyloom.streaming.scan import start_scan, watch_table

    with tempfile.TemporaryDirectory() as d:
        src, out, chk = (os.path.join(d, x) for x in ("in", "out", "chk"))
        make_files([("p", ".env", "TOKEN=abcdefgh")]).write.parquet(src)
        stream = watch_table(spark, src, "project_id string, file_id string, path string, content string, mode int")
        for _ in range(2):
            start_scan(stream, out, chk).awaitTermination(120)
            make_files([("q", ".env", "PASSWORD=abcdefgh")]).write.mode("append").parquet(src)
        assert sorted(r.variable for r in spark.read.parquet(out).collect()) == ["PASSWORD", "TOKEN"]


def test_reader_walks_levels_and_fails_on_unreadable(spark):
    from keyloom.sources import files

    with tempfile.TemporaryDirectory() as d:
        wanted = ["a.env", "x/b.env", "x/y/c.env", "x/y/z/w/d.env"]
        for name in wanted:
            os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
            with open(os.path.join(d, name), "wb") as out:
                out.write(b"A=1\n")
        with open(os.path.join(d, "x/bad.env"), "wb") as out:
            out.write(b"\xff\xfe")
        os.makedirs(os.path.join(d, "empty"))
        for root in (d, f"file://{d}"):
            got = [r.path for r in files.read_files(spark, root).collect()]
            assert sorted(os.path.relpath(p.removeprefix("file://"), d) for p in got) == sorted(wanted)
        with pytest.raises(Exception, match="missing"):
            files.list_files(spark, [os.path.join(d, "missing")]).collect()


def test_null_content_keeps_its_file(spark):
    from keyloom.operators import detect, extract

    rows = spark.createDataFrame([("p", "f", "a.env", None), ("p", "g", "b.env", "DB_PASSWORD=hunter2hunter2xx")], "project_id string, file_id string, path string, content string")
    out = {r.file_id: r.secrets_found for r in detect.scan_rollup(rows, ["file_id"]).collect()}
    assert out == {"f": 0, "g": 1}
    assert {r.file_id: (r.is_kv, r.n_vars) for r in extract.classify_kv(rows).collect()} == {"f": (True, 0), "g": (True, 1)}


def test_patch_positions_beyond_32_bits(spark):
    from keyloom.operators import diff

    rows = [("p", "K", "missing", None, "v", 2147483653)]
    changes = spark.createDataFrame(rows, "project_id string, key string, status string, left_value string, right_value string, pos long")
    out = diff.patch_lines(changes, spark.createDataFrame([("p",)], "project_id string")).collect()
    assert 2147483653 in {r.pos for r in out}
