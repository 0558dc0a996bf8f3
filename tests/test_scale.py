"""Hot keys, long files and long rule tables: plans that spread, and results equal to the plain way."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from keyloom.operators import catalog, detect, extract, joins, rule_table, stitch, template, validate
from keyloom.operators.documents import document_rows
from keyloom.sources import reports


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def _hot(spark, n=60_000):
    """A third of all rows on one key, the rest on many."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2_000)).alias("key"), F.col("id").alias("row"))


def test_skewed_join_spreads_a_hot_key(spark, no_broadcast):
    rows = _hot(spark)
    groups = rows.select("key").distinct().where("key <> 'k7'").withColumn("name", F.upper("key"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, plain = joins.join_skewed(rows, groups, "key", how), rows.join(groups, "key", how)
        assert got.columns == plain.columns
        assert got.agg(F.count("*"), F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first() == plain.agg(F.count("*"), F.sum(F.xxhash64(*plain.columns).cast("decimal(38,0)"))).first()
    sizes = sorted(r["count"] for r in joins.join_skewed(rows, groups, "key").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    width = joins.shuffle_width(spark)
    hot = joins.heavy_hitters(rows, ["key"], width).collect()
    assert len(hot) == 1 and 20 <= hot[0]["_copies"] <= joins.PARTS_PER_TASK * width


def test_no_key_is_hot_in_an_even_table(spark):
    rows = spark.range(10_000).selectExpr("id % 1000 as key", "id as row")
    assert joins.heavy_hitters(rows, ["key"], 8).count() == 0
    assert joins.heavy_hitters(rows.limit(0), ["key"], 8).count() == 0
    empty = joins.join_skewed(rows, rows.limit(0).select("key"), "key", "left_anti")
    assert empty.count() == 10_000


def test_rendering_with_a_hot_name(spark, no_broadcast):
    templates = spark.createDataFrame([("p", f"t{i}", f"${{HOT}} ${{K{i % 50}}} $GONE") for i in range(3_000)], "project_id string, template_id string, body string")
    vars_ = spark.createDataFrame([("p", "HOT", "h")] + [("p", f"K{i}", str(i)) for i in range(50)], "project_id string, key string, value string")
    out = {r.template_id: r.text for r in template.render(templates, vars_).collect()}
    assert out == {f"t{i}": f"h {i % 50} $GONE" for i in range(3_000)}
    assert {(r.template_id, r.name) for r in template.undefined(templates, vars_).collect()} == {(f"t{i}", "GONE") for i in range(3_000)}


def test_equal_entries_of_a_document(spark):
    findings = spark.createDataFrame([("p", "f", 1, "a.env", "Key", "high")] * 3 + [("p", "f", 1, "a.env", "Other", "low"), ("q", None, None, "b", "Key", "high"), ("q", None, None, "b", "Key", "high")],
                                     "project_id string, file_id string, line_no int, path string, pattern string, confidence string")
    rows = reports.sarif_documents(findings).orderBy("project_id", "section", "file_id", "line_no", F.col("text").startswith(",")).collect()
    docs = {p: json.loads("".join(r.text for r in rows if r.project_id == p)) for p in ("p", "q")}
    assert [len(d["runs"][0]["results"]) for d in docs.values()] == [4, 2]
    assert sorted(r["ruleId"] for r in docs["p"]["runs"][0]["results"]) == ["secret/key"] * 3 + ["secret/other"]
    none = document_rows(findings.limit(0).select("project_id", "line_no", "path"), ["project_id"], ["line_no"], "path", F.lit("<"))
    assert none.count() == 0


def test_rewrite_meets_a_text_once(spark):
    keys = [f"KEY_{i}" for i in range(10_000)]
    text = "\n".join(["A=1", "# KEY_5=commented", "x KEY_77=1", "NOT_KEY_8=2", "é=ü", "last"])
    files = spark.createDataFrame([("f", text), ("g", "B=1"), ("h", None), ("i", "")], "file_id string, content string")
    values = spark.createDataFrame(
        [("f", k, "v", i) for i, k in enumerate(keys)] + [("g", "C", "v", 1), ("g", "=", "v", 2), ("g", "", "v", 3), ("h", "C", "v", 1), ("i", "C", "v", 1), ("nowhere", "C", "v", 1), ("f", "A=1\n# KEY_5", "v", 10_001)],
        "file_id string, key string, value string, pos int")
    out = validate.rewrite_lines(files, values)
    added = {(r.file_id, r.text) for r in out.where("section = 1").collect()}
    contents = {"f": text, "g": "B=1", "i": ""}
    expected = {(r.file_id, f"{r.key}=v") for r in values.collect() if r.file_id in contents and r.key + "=" not in contents[r.file_id]}
    assert added == expected and ("f", "KEY_5=v") not in added and ("f", "KEY_8=v") not in added and len(added) > 9_990


@pytest.mark.parametrize("bucket", [None, 7, 1_000])
def test_history_by_time_in_a_large_file(spark, bucket):
    rng = random.Random(1)
    rows = [("big" if i % 2 else f"f{i % 40}", i * 3_600 * 24 * 40 + i, "key " * rng.randint(0, 2)) for i in range(3_000)]
    versions = spark.createDataFrame(rows, "file_id string, s long, content string").select("file_id", F.timestamp_seconds("s").alias("ts"), "s", "content")
    got = {(r.file_id, r.previous, r.occurrences, r.ts) for r in detect.history(versions, "key", order="ts", bucket_size=bucket).collect()}
    expected, last = set(), {}
    by_second = {r.s: r.ts for r in versions.select("s", "ts").collect()}
    for f, s, text in sorted(rows, key=lambda r: r[1]):
        n = text.count("key")
        if n != last.get(f, 0):
            expected.add((f, last.get(f, 0), n, by_second[s]))
        last[f] = n
    assert got == expected


def _walked(lines):
    """The sequential walk over quote states."""
    out, open_at, quote = [], None, ""
    white = " \t\n\x0b\x0c\r"
    for i, line in enumerate(lines):
        if open_at is None:
            found = re.match(r"""[ \t]*(?:export[ \t]+)?[A-Za-z][A-Za-z0-9_]*[ \t]*=[ \t]*(["'`])(.*)\Z""", line, re.S)
            if found and not found.group(2).rstrip(white).endswith(found.group(1)):
                open_at, quote = i, found.group(1)
            elif line.strip(white) and not line.strip(white).startswith("#"):
                out.append((i + 1, line, False, True))
        elif line.rstrip(white).endswith(quote):
            out.append((open_at + 1, "\n".join([lines[open_at].rstrip(white), *lines[open_at + 1:i + 1]]), True, True))
            open_at = None
    if open_at is not None:
        out.append((open_at + 1, "\n".join([lines[open_at].rstrip(white), *lines[open_at + 1:]]), True, False))
    return out


@pytest.mark.parametrize(("levels", "block"), [(0, 4096), (2, 7), (1, 64)])
def test_stitching_equals_the_walk(spark, levels, block):
    rng = random.Random(block)
    kinds = ['A="open', "B='open ", "C=`x", 'end" ', "end'", "end`", "D=plain", "# note", "", '"', "export E=\"a\" # '", "F='x' y'", "  middle"]
    files = {f"f{k}": [rng.choice(kinds) for _ in range(rng.choice([1, 5, 60, 300]))] for k in range(12)}
    rows = [(f, i + 1, line) for f, lines in files.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "file_id string, line_no int, line string").repartition(5)
    got = sorted((r.file_id, r.line_no, r.text, r.multi, r.ended) for r in stitch.line_values(lines, ["file_id"], levels, block).collect())
    assert got == sorted((f, *s) for f, text in files.items() for s in _walked(text))


def test_stitched_lines_parse_like_whole_files(spark, make_files):
    text = 'A="one\ntwo"\nexport B=x # c\n\n# note\nBAD LINE\nC=\'never'
    files = make_files([("p", ".env", text)])
    lines = extract.to_lines(files, keep="all")
    whole = [tuple(r) for r in extract.parse_rows(files).drop("mode").orderBy("line_no").collect()]
    by_lines = extract.parse_lines(lines.select("project_id", "file_id", "path", "line_no", "line"), ["project_id", "file_id", "path"])
    assert [tuple(r) for r in by_lines.orderBy("line_no").collect()] == whole


def test_stitching_takes_marked_lines_only_and_keeps_files_without_a_name(spark):
    text = ["A=1", "B='x", "y", "z' ", "C=2", 'D="never', "E=3"]
    lines = spark.createDataFrame([(f, i + 1, t) for f in (None, "f") for i, t in enumerate(text)], "file_id string, line_no int, line string")
    states = stitch.entry_states(stitch._marked(lines, ["file_id"]), ["file_id"], 1, 2).where("file_id = 'f'").orderBy("i")
    assert [(r.i, r.state, r.after) for r in states.collect()] == [(1, 0, 2), (3, 2, 0), (5, 0, 1)]
    got = stitch.line_values(lines, ["file_id"], 1, 2).where("file_id is null").orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.ended) for r in got] == [(1, "A=1", True), (2, "B='x\ny\nz' ", True), (5, "C=2", True), (6, 'D="never\nE=3', False)]


def test_stitching_gathers_nothing_on_the_driver(spark, tmp_path):
    text = ["A=1", "B='x", "y", "z' ", 'D="never', "E=3"]
    spark.createDataFrame([("f", "\n".join(text))], "file_id string, content string").write.parquet(f"{tmp_path}/files")
    lines = extract.to_lines(spark.read.parquet(f"{tmp_path}/files"), keep="all")  # its size is estimated by the small scan
    plan = stitch.line_values(lines, ["file_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize(("regex", "literal"), [
    ("sk_live_[0-9a-z]{24}", "sk_live_"), ("(?:a|b)token=[0-9]+", "token="), ("ab?cde", "cde"), ("abc{0,2}de", "ab"), ("abc+def", "abc"), ("x|abcdef", ""),
    (r"\bghp_\w{36}\b", "ghp_"), (r"[abc]def[]x]gh", "def"), (r"a\.b\.c", "a.b.c"), ("(?i)SECRET", ""), ("(abc)", ""), (r"\x41BCD", "bcd"), (r"\Qa.b\E", ""), ("a", ""),
    (r"\p{Alpha}key", "key"), ("PassWord", "password"), ("(?=x)hello", "hello"), ("ab{2}cd", "ab"), ("^start$", "start"),
])
def test_required_literals(regex, literal):
    assert rule_table.required_literal(regex) == literal


def test_rule_table_equals_running_all(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef0123") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rules = [(f"rule{i}", rng.choice([re.escape(w), f"^{w}[0-9]+", f"{w}|{w[::-1]}", f"(?i){w}", f"{w[:3]}.{{2}}{w[-2:]}"]), "low", None, i % 7) for i, w in enumerate(words)]
    rules += [(f"many{i}", f"zz{i}q[0-9]", "high", "u", 3) for i in range(10_000)]
    table = spark.createDataFrame(rules, "name string, regex string, confidence string, action_url string, prio int")
    values = [(i, rng.choice(words).upper() if i % 5 == 0 else rng.choice(words) + rng.choice(words) + rng.choice(["", " zz77q1", " zz9999q5"])) for i in range(300)] + [(300, ""), (301, None)]
    units = spark.createDataFrame(values, "id long, value string")
    expected = {}
    compiled = [(r[4], r[0], r[1], re.compile(r[1])) for r in rules]
    for i, v in values:
        met = [(p, n, x) for p, n, x, c in compiled if v is not None and c.search(v)]
        if met:
            expected[i] = min(met)[1]
    for chunk in (rule_table.CHUNK_BYTES, 300_000):
        got = {r.id: r.pattern for r in rule_table.scan_rules(units, table, ["id"], chunk_bytes=chunk).collect()}
        assert got == expected
    pairs = rule_table.candidates(units.withColumn("_unit", F.col("id")), rule_table.numbered(table))
    assert pairs.count() < 0.1 * len(values) * len(rules)
    assert rule_table.scan_rules(units, table.limit(0), ["id"]).count() == 0


def test_resolve_shuffles_names_only(spark, no_broadcast):
    rng = random.Random(11)
    texts = [("c", "service", "", f"s{i}", p, f"V{rng.randrange(40)}", f"{i}-{p}" + "x" * 500, None, "Service", p == 1) for i in range(30) for p in range(4)]
    texts += [("c", "framework", f"l{i}", "f", 0, f"V{i}", f"f{i}", "d", None, True) for i in range(3)]
    flat = spark.createDataFrame(texts, "catalog_id string, source_kind string, scope string, source_id string, pos int, var string, example_value string, description string, category string, required boolean")
    picks = [("c", f"t{t}", 2, o, "service", None, f"s{rng.randrange(33)}") for t in range(200) for o in range(rng.randint(0, 9))]
    picks += [("c", f"t{t}", 1, 0, "framework", rng.choice(["l0", "l1", "l9", None]), "f") for t in range(0, 200, 2)] + [("c", None, 2, 0, "service", "l1", "s1")]
    selected = spark.createDataFrame(picks, "catalog_id string, stack_id string, stage int, ord int, source_kind string, language string, source_id string")
    expected = {}
    for _, stack, stage, o, kind, language, source in picks:
        for _, k, scope, s, pos, var, *meta in texts:
            if (k, s) == (kind, source) and (kind != "framework" or scope == language):
                order = (stage, o, pos, source)
                expected[stack, var] = min(expected.get((stack, var), (order, kind, source, *meta)), (order, kind, source, *meta), key=lambda e: e[0])
    resolved = catalog.resolve(selected, flat)
    got = {(r.stack_id, r["var"]): r[3:] for r in resolved.collect()}
    assert got == {k: tuple(v[1:]) for k, v in expected.items()} and resolved.count() == len(expected)
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    by_stack = [line for line in plan.split("\n") if "hashpartitioning(catalog_id" in line and "stack_id" in line]
    assert len(by_stack) == 1 and "var#" not in by_stack[0]


def test_winners_travel_as_one_row_for_each_component(spark, no_broadcast):
    texts = [("c", "service", "", s, p, v, f"{s}{v}", None, "Service", False) for s, names in (("a", "PQRQ"), ("b", "SPT"), ("d", "PQ"), ("e", "")) for p, v in enumerate(names)]
    flat = spark.createDataFrame(texts, "catalog_id string, source_kind string, scope string, source_id string, pos int, var string, example_value string, description string, category string, required boolean")
    picks = [("c", t, 2, o, "service", None, s) for t, order in (("t", "abd"), ("u", "dba"), ("v", "aa"), ("w", "e")) for o, s in enumerate(order)]
    resolved = catalog.resolve(spark.createDataFrame(picks, "catalog_id string, stack_id string, stage int, ord int, source_kind string, language string, source_id string"), flat)
    expected = {("t", "P", "a"), ("t", "Q", "a"), ("t", "R", "a"), ("t", "S", "b"), ("t", "T", "b"), ("u", "P", "d"), ("u", "Q", "d"), ("u", "R", "a"), ("u", "S", "b"), ("u", "T", "b")} | {("v", x, "a") for x in "PQR"}
    rows = [(r.stack_id, r["var"], r.source_id) for r in resolved.collect()]
    assert sorted(rows) == sorted(expected) and {r.example_value for r in resolved.where("stack_id = 'u'").collect()} == {"dP", "dQ", "aR", "bS", "bT"}
    plan = resolved._jdf.queryExecution().executedPlan().toString().split("\n")
    by_component = [line for line in plan if "hashpartitioning" in line and "_copy" in line]
    assert by_component and not any("_at#" in line for line in plan) and any("_ats#" in line for line in plan)


def test_entries_are_dealt_before_they_are_counted(spark, no_broadcast):
    rows = spark.range(1000).selectExpr("'d' as k", "id % 500 as pos", "concat('r', id % 500) as text").coalesce(1)
    out = document_rows(rows, ["k"], ["pos"], separator=",")
    assert sorted(r.text for r in out.collect()) == sorted(["r0"] + [",r0"] + [f",r{i}" for i in range(1, 500)] * 2)
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    counts = [i for i, line in enumerate(plan) if "partial_count" in line]
    assert counts and all("Exchange hashpartitioning" in plan[i + 1] for i in counts)


def test_rule_candidates_are_not_shuffled(spark, no_broadcast):
    rules = spark.createDataFrame([(f"r{i}", f"[a-z]{i % 7}{i % 3}", "low" if i % 2 else None, None, None if i == 41 else i % 5) for i in range(300)] + [("none", None, None, None, 0)],
                                  "name string, regex string, confidence string, action_url string, prio int")
    units = spark.createDataFrame([(i, f"{i % 7}{i % 3}a{i % 7}{i % 3}") for i in range(400)] + [(9, None), (None, "a00")], "id long, value string")
    out = rule_table.scan_rules(units, rules, ["id"])
    rows = [(-1 if p is None else p, n, r, c) for n, r, c, _, p in rules.collect() if r]
    expected = {u: min((p, n, c) for p, n, r, c in rows if v and re.search(r, v)) for u, v in units.collect() if v}
    assert {r.id: (r.pattern, r.confidence) for r in out.collect()} == {u: (n, c) for u, (p, n, c) in expected.items()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("hashpartitioning(_rule" in line or "hashpartitioning(_unit" in line for line in plan)
