import random

from pyspark.sql import functions as F

from keyloom.functions import secrets
from keyloom.operators import detect, diff


def test_tokens(one):
    got = one("v", [("short aVeryLongTokenOf21Bytes:k='otherLongTokenOf22Bytesx' ééééééééééé",)], detect.tokens("v"))
    assert got[0][0] == ["aVeryLongTokenOf21Bytes", "otherLongTokenOf22Bytesx", "é" * 11]


def corpus(make_files):
    key = "AKIA" + "QWERTYUIOPASDFGH"
    return make_files([
        ("p1", ".env", f"AWS_ACCESS_KEY_ID={key}\n# SECRET={key}\nAPI_KEY=changeme\nexport DB_PASSWORD='pw'\nNOEQ {key}"),
        ("p1", "notes.txt", f"some text {key}Z and 'ghp_{'a1B2' * 9}'\n\n#{key}"),
        ("p2", "clean.txt", "nothing here"),
        ("p2", ".env.local", ""),
    ])


def test_scan(make_files):
    rows = sorted(
        (r.path, r.line_no, r.detector, r.pattern, r.confidence, r.variable, r.location)
        for r in detect.scan(corpus(make_files)).collect()
    )
    assert [r[:5] for r in rows] == [
        (".env", 1, "pattern-matcher", "AWS Access Key", "high"),
        (".env", 4, "config-key-matcher", "Sensitive config key: DB_PASSWORD", "medium"),
        ("notes.txt", 1, "pattern-matcher", "AWS Access Key", "high"),
        ("notes.txt", 1, "pattern-matcher", "GitHub Token", "high"),
    ]
    assert rows[0][6] == ".env:1 (AWS_ACCESS_KEY_ID)" and rows[2][6] == "notes.txt:1" and rows[2][5] is None


def test_summaries_agree(make_files):
    files = corpus(make_files)
    by_join = {r.project_id: r.asDict() for r in detect.scan_summary(files, detect.scan(files)).collect()}
    assert by_join["p1"]["files_scanned"] == 2 and by_join["p1"]["high_confidence"] == 3 and by_join["p1"]["critical"]
    assert by_join["p2"]["secrets_found"] == 0 and not by_join["p2"]["critical"]
    rollup = {r.project_id: r.asDict() for r in detect.scan_rollup(files, ["project_id"]).collect()}
    for p, want in by_join.items():
        assert {k: v for k, v in want.items() if k != "files_scanned"} == rollup[p]


def test_custom_detector_and_line_rules(make_files, spark):
    rules = secrets.rules_detector([{"name": "internal", "regex": "zz[0-9]+", "confidence": "low"}])
    files = make_files([("p", "a.txt", "token zz1234567890123456789012 -----BEGIN RSA " + "PRIVATE KEY-----")])
    found = detect.scan(files, [*secrets.DEFAULT_DETECTORS, rules]).collect()
    assert [r.pattern for r in found] == ["internal"]
    from keyloom.operators.extract import to_lines

    on_lines = detect.scan_lines(to_lines(files), [secrets.pattern_detector]).collect()
    assert [r.pattern for r in on_lines] == ["Private Key"]


def test_pandas_udf_as_detector(make_files):
    import pandas as pd

    @F.pandas_udf(secrets.DETECTION_TYPE)
    def shouting(key: pd.Series, value: pd.Series) -> pd.DataFrame:
        hit = value.str.isupper()
        return pd.DataFrame({
            "detector": "shout", "pattern": value.where(hit), "confidence": "low", "action_url": None,
        }).where(hit, None)

    def detector(key, value):
        found = shouting(key, value)
        return F.when(found["pattern"].isNotNull(), found)

    files = make_files([("p", ".env", "A=LOUD\nB=quiet\nTOKEN=abcdefgh")])
    found = detect.scan(files, [*secrets.DEFAULT_DETECTORS, detector]).collect()
    assert sorted(r.pattern for r in found) == ["LOUD", "Sensitive config key: TOKEN"]


def test_history_with_split_files(spark):
    rnd = random.Random(2)
    rows, want = [], set()
    for f in ("hot", "b"):
        prev = 0
        for ver in sorted(rnd.sample(range(5000), 400 if f == "hot" else 7)):
            n = rnd.randint(0, 2)
            rows.append((f, ver, "x key " * n + "other"))
            if n != prev:
                want.add((f, ver, prev, n))
            prev = n
    versions = spark.createDataFrame(rows, "file_id string, ver bigint, content string")
    for size in (8, 64, 4096):
        got = detect.history(versions, "key", bucket_size=size)
        assert {tuple(r) for r in got.collect()} == want


def test_diff(make_vars):
    left = make_vars({"p": {"A": "1", "B": "2", "C": "3", "API_KEY": "secret1", "AUTH": ""}, "q": {"X": "1"}})
    right = make_vars({"p": {"C": "3", "D": "4", "A": "9", "API_KEY": "s2", "AUTH": "x"}, "q": {"X": "1"}})
    rows = {(r.project_id, r.key): r for r in diff.diff(left, right).collect()}
    assert {k[1]: v.status for k, v in rows.items()} == {
        "A": "different", "B": "extra", "D": "missing", "API_KEY": "different", "AUTH": "different"}
    assert (rows["p", "API_KEY"].left_redacted, rows["p", "API_KEY"].right_redacted) == ("se***", "s2***")
    assert (rows["p", "AUTH"].left_redacted, rows["p", "AUTH"].right_redacted) == ("***", "x***")
    assert rows["p", "A"].left_redacted is None
    assert diff.diff(left, left).count() == 0
    swapped = {(r.key, r.status) for r in diff.diff(left, right, reverse=True).collect()}
    assert ("B", "missing") in swapped and ("D", "extra") in swapped
    assert {r.key for r in diff.diff(left, right, ignore=["A", "D", "B"]).collect()} == {"API_KEY", "AUTH"}
    flags = diff.has_changes(diff.diff(left, right), left.select("project_id").distinct())
    assert {r.project_id: r.has_changes for r in flags.collect()} == {"p": True, "q": False}


def test_similarity(make_vars):
    a = make_vars({"half": {"A": "", "B": ""}, "same": {"A": "1"}, "none": {"A": ""}, "third": {"A": "", "B": "", "C": ""}})
    b = make_vars({"half": {"A": "", "C": ""}, "same": {"A": "2"}, "none": {"B": ""}, "third": {"A": "", "D": "", "E": ""}})
    got = {r.project_id: r.similarity_percent for r in diff.similarity(a, b).collect()}
    assert got == {"half": 50.0, "same": 100.0, "none": 0.0, "third": 33.33}


def test_patch(make_vars):
    left = make_vars({"p": {"A": "1", "B": "2"}})
    right = make_vars({"p": {"C": "3", "A": "9"}})
    rows = diff.patch_lines(diff.diff(left, right), left.select("project_id").distinct())
    text = [r.text for r in rows.orderBy("section", "pos", "sub").collect()]
    assert text == ["# Add these to .env:", "+ C=3", "# Remove these from .env:", "- B=2",
                    "# Update these in .env:", "- A=1", "+ A=9"]
