import pytest
from pyspark.sql import functions as F

from keyloom.operators import sync, validate
from keyloom.operators.documents import document_rows


def kinds(issues):
    return sorted((r.type, r.variable) for r in issues.collect())


def test_missing_and_extra(make_vars):
    env, ex = make_vars({"p": {"A": "1", "Z": "1"}}), make_vars({"p": {"A": "1", "API_KEY": "x1"}, "q": {"B": "1"}})
    got = validate.validate(env, ex, validate_formats=False)
    assert kinds(got) == [("missing_variable", "API_KEY"), ("missing_variable", "B")]
    row = got.filter("variable = 'API_KEY'").collect()[0]
    assert (row.severity, row.message, row.location, row.suggestion, row.auto_fixable) == (
        "error", "Missing required variable: API_KEY", ".env:?", "Add API_KEY=<value> to .env", True)
    assert ("extra_variable", "Z") in kinds(validate.validate(env, ex, strict=True))
    only_extra = validate.validate(env, ex, strict=True, ignore=["missing_variable"])
    assert kinds(only_extra) == [("extra_variable", "Z")]


def test_row_checks(make_vars, make_files):
    env = make_vars({
        "p": {"SECRET_KEY": "short", "AWS_ID": "changeme", "DEBUG": "True", "DB_HOST": "localhost", "API_URL": "nope",
              "PORT": "70000", "MAIL": "a@b", "EMPTY_URL": "", "OK": "fine"},
        "q": {"DB_HOST": "localhost"},
    })
    containers = validate.container_projects(make_files([("p", "sub/Dockerfile", ""), ("q", "x.txt", "")]))
    got = validate.validate(env, env, containers)
    assert kinds(got) == sorted([
        ("placeholder_value", "AWS_ID"), ("placeholder_value", "EMPTY_URL"), ("boolean_trap", "DEBUG"),
        ("weak_secret", "SECRET_KEY"), ("localhost_in_docker", "DB_HOST"), ("invalid_url", "API_URL"),
        ("invalid_port", "PORT"), ("invalid_email", "MAIL")])
    by = {r.type: r for r in got.collect() if r.variable != "EMPTY_URL"}
    assert by["placeholder_value"].suggestion == "Get from AWS Console"
    assert by["boolean_trap"].suggestion == "Use true or 0 for proper boolean handling"
    assert by["boolean_trap"].message == 'DEBUG is set to "True" (string, not boolean)'
    assert kinds(validate.validate(env, env, containers, ignore=[k for k in by if k != "weak_secret"])) == [
        ("weak_secret", "SECRET_KEY")]


def test_fixes_and_summary(make_vars):
    env = make_vars({"p": {"SECRET_KEY": "changeme", "SITE_URL": "todo", "DEBUG": "False", "X": "v"}})
    ex = make_vars({"p": {"X": "", "NEW_TOKEN": "", "NEW_KEY": ""}})
    secret = F.sha2(F.concat("project_id", "key"), 256)
    fixes = validate.plan_fixes(env, ex, secret=secret)
    acts = sorted((r.key, r.prio, r.action) for r in fixes.collect())
    assert acts == [("DEBUG", 3, "fix_boolean"), ("NEW_KEY", 1, "add_missing"), ("NEW_TOKEN", 1, "add_missing"),
                    ("SECRET_KEY", 2, "generate_secret"), ("SECRET_KEY", 4, "generate_secret"), ("SITE_URL", 2, "replace_placeholder")]
    after = {r.key: r.value for r in validate.apply_fixes(env, fixes).collect()}
    assert after["DEBUG"] == "false" and after["SITE_URL"] == "https://example.com" and after["X"] == "v"
    assert after["NEW_TOKEN"] == "your_value_here" and after["NEW_KEY"] == "CHANGE_ME_SECURE_32_CHARS_MIN"
    assert len(after["SECRET_KEY"]) == 64
    dry = {r.key: r.value for r in validate.apply_fixes(env, validate.plan_fixes(env, ex)).collect()}
    assert dry["SECRET_KEY"] == "changeme"
    s = validate.summarise(validate.validate(env, ex), env, ex, fixes).collect()[0]
    assert (s.status, s.errors, s.warnings, s.fixed_count) == ("failed", 5, 2, 6)
    assert (s.required_present, s.required_total, s.required_matched) == (3, 3, 1)


def rewritten(files, values):
    rows = validate.rewrite_lines(files, values).orderBy("file_id", "section", "line_no").collect()
    return [r.text for r in rows]


def test_rewrite(make_files, spark):
    content = "# head\n\nA=1\n  B = old # note\nbad line\nMY_KEY=z\n"
    files = make_files([("p", ".env", content)])
    values = spark.createDataFrame(
        [("p/.env", "A", "2", 1), ("p/.env", "B", "new", 2), ("p/.env", "C", "3", 3), ("p/.env", "KEY", "hidden", 4)],
        "file_id string, key string, value string, pos int")
    # KEY= occurs inside MY_KEY=, so it is not appended.
    assert rewritten(files, values) == ["# head", "", "A=2", "B=new", "bad line", "MY_KEY=z", "C=3"]
    unchanged = values.filter("key = 'none'")
    assert rewritten(files, unchanged) == content.splitlines()


def test_sync_plans(make_vars):
    env = make_vars({"p": {"NEW_VAR": "v", "SHARED": "1", "bad-name": "x"}, "solo": {"DB_PASSWORD": "pw"}})
    ex = make_vars({"p": {"SHARED": "1", "PORT": "9"}, "fresh": {"A": "localhost", "B": "real"}})
    fwd = {(r.project_id, r.key): r for r in sync.forward(env, ex).collect()}
    assert set(fwd) == {("p", "NEW_VAR"), ("p", "bad-name"), ("solo", "DB_PASSWORD")}
    assert fwd["solo", "DB_PASSWORD"].new_value == "YOUR_PASSWORD_HERE" and fwd["p", "bad-name"].naming_violation
    actual = {r.key: (r.new_value, r.is_placeholder) for r in sync.forward(env, ex, actual_values=True).collect()}
    assert actual["NEW_VAR"] == ("v", False)
    rev = {(r.project_id, r.key): (r.new_value, r.is_placeholder) for r in sync.reverse(env, ex).collect()}
    assert rev == {("p", "PORT"): ("8000", True), ("fresh", "A"): ("localhost", True), ("fresh", "B"): ("real", False)}
    total = {(r.project_id, r.target): r.n_keys for r in sync.summary(sync.forward(env, ex)).collect()}
    assert total == {("p", ".env.example"): 2, ("solo", ".env.example"): 1}
    with pytest.raises(Exception, match="Non-standard variable name"):
        sync.forward(env, ex, naming="error").collect()
    assert sync.masked_copy(env).filter("value = 'YOUR_PASSWORD_HERE'").count() == 1


def test_document_rows(spark):
    rows = spark.range(0, 1000).selectExpr("if(id = 999, 'b', 'a') as k", "id + 3000000000 as pos", "concat('r', id) as text")
    out = document_rows(rows, ["k"], ["pos"], header=F.lit("<"), separator=",", footer=F.lit(">"))
    docs = {}
    for r in out.orderBy("k", "section", "pos").collect():
        docs[r.k] = docs.get(r.k, "") + r.text
    assert docs == {"a": "<" + ",".join(f"r{i}" for i in range(999)) + ">", "b": "<r999>"}
