import random

from keyloom.operators import extract


def parsed(make_files, content, **options):
    rows = extract.parse_rows(make_files([("p", ".env", content)]), **options).orderBy("line_no").collect()
    return [(r.line_no, r.key, r.value, r.error) for r in rows]


def values(make_files, content, **options):
    rows = extract.parse_vars(make_files([("p", ".env", content)]), **options).orderBy("pos").collect()
    return {r.key: r.value for r in rows}


def test_lines(make_files):
    files = make_files([("p", "a", "x\r\n\n# c\n y \n"), ("p", "b", ""), ("p", "c", "z\n\n")])
    got = sorted((r.path, r.line_no, r.line) for r in extract.to_lines(files, keep="all").collect())
    assert got == [("a", 1, "x"), ("a", 2, ""), ("a", 3, "# c"), ("a", 4, " y "), ("c", 1, "z"), ("c", 2, "")]
    got = sorted((r.path, r.line_no, r.line) for r in extract.to_lines(files).collect())
    assert got == [("a", 1, "x"), ("a", 4, " y "), ("c", 1, "z")]


def test_basic_values(make_files):
    content = "\n".join([
        "# comment", "", "KEY1=value1", "  KEY2  =  value2  ", "EMPTY=", "export KEY3=v3", "exporter=1",
        'D="hello world"', "S='no\\nescape'", "B=`back tick`", 'DD=""', r'E="line1\nline2\ttab"',
        r'Q="He said \"hi\"\\path"', "PORT=8080 # web server", 'H="value#notacomment"', "EQ=a=b=c", "MyKey=v",
    ])
    assert values(make_files, content) == {
        "KEY1": "value1", "KEY2": "value2", "EMPTY": "", "KEY3": "v3", "exporter": "1", "D": "hello world",
        "S": "no\\nescape", "B": "back tick", "DD": "", "E": "line1\nline2\ttab", "Q": 'He said "hi"\\path',
        "PORT": "8080", "H": "value#notacomment", "EQ": "a=b=c", "MyKey": "v",
    }
    assert list(values(make_files, "Z=last\nA=first\nM=middle")) == ["Z", "A", "M"]
    assert values(make_files, "PORT=8080 # web", inline_comments=False) == {"PORT": "8080 # web"}
    assert values(make_files, "exporter=1", loose_export=True) == {"er": "1"}


def test_errors(make_files):
    content = "1KEY=v\nMY-KEY=v\nno separator\nOK=1\nMY KEY=v\n=v\nlower=x"
    assert parsed(make_files, content, strict=True) == [
        (1, "1KEY", None, "InvalidKey"), (2, "MY-KEY", None, "InvalidKey"), (3, None, None, "InvalidFormat"),
        (4, "OK", "1", None), (5, "MY KEY", None, "InvalidKey"), (6, "", None, "InvalidKey"),
        (7, "lower", None, "InvalidKey")]
    rows = extract.parse_rows(make_files([("p", ".env", content)]))
    status = extract.file_status(rows).collect()[0]
    assert (status.first_error, status.first_error_line, status.assignments) == ("InvalidKey", 1, 2)
    assert extract.parse_errors(rows).count() == 5


def test_multiline(make_files):
    content = 'A=1\nKEY="line one  \n  # line two\nline "three""  \nB=2\nC=\'x\ny\'\nD=`never\nends'
    assert parsed(make_files, content) == [
        (1, "A", "1", None), (2, "KEY", 'line one\n  # line two\nline "three"', None), (5, "B", "2", None),
        (6, "C", "x\ny", None), (8, "D", None, "UnterminatedString")]
    assert parsed(make_files, 'K="a" # c\nL="')[0] == (1, "K", 'a" # c\nL=', None)
    assert parsed(make_files, 'KEY="unclosed', multiline=False) == [(1, "KEY", None, "UnterminatedString")]
    assert parsed(make_files, 'KEY="') == [(1, "KEY", None, "UnterminatedString")]
    assert parsed(make_files, 'KEY="\n"') == [(1, "KEY", "\n", None)]


def reference_statements(lines):
    """A plain state machine over the same rules, to check the fold."""
    out, i = [], 0
    while i < len(lines):
        line = lines[i].strip()
        body = line[len("export "):].lstrip() if line.startswith("export ") else line
        key, eq, raw = body.partition("=")
        raw = raw.lstrip()
        ok = eq and key.strip().isidentifier() and key.strip()[0] != "_"
        if ok and raw[:1] and raw[0] in "\"'`" and not (len(raw) >= 2 and raw.endswith(raw[0])):
            j = i + 1
            while j < len(lines) and not lines[j].rstrip().endswith(raw[0]):
                j += 1
            if j == len(lines):
                out.append((i + 1, None))
            else:
                inner = [raw[1:], *lines[i + 1:j], lines[j].rstrip()[:-1]]
                out.append((i + 1, "\n".join(inner)))
            i = j + 1
            continue
        if line and not line.startswith("#"):
            out.append((i + 1, "single"))
        i += 1
    return out


def test_multiline_against_state_machine(make_files):
    rnd = random.Random(5)
    atoms = ['A="x', "y\"", "B='q", "z'  ", "C=1", "# n", "", "D=`t", "w`", 'E="ok"', "free text", "F=", 'export G="o', "  H = 'm"]
    rows, want = [], {}
    for n in range(60):
        lines = [rnd.choice(atoms) for _ in range(rnd.randint(1, 14))]
        rows.append(("p", f"f{n}", "\n".join(lines) + "\n"))
        want[f"f{n}"] = reference_statements(lines)
    got = {}
    for r in extract.parse_rows(make_files(rows)).orderBy("path", "line_no").collect():
        multi = r.raw_value is not None and "\n" in r.raw_value or r.error == "UnterminatedString"
        got.setdefault(r.path, []).append((r.line_no, (r.value if multi else "single")))
    assert got == {k: v for k, v in want.items() if v}


def test_duplicates_keep_first_position(make_files):
    rows = extract.parse_vars(make_files([("p", ".env", "A=1\nB=2\nA=3")])).collect()
    assert sorted((r.key, r.value, r.pos) for r in rows) == [("A", "3", 1), ("B", "2", 2)]


def test_classifier_and_counts(make_files):
    ok = "A=1\nB=2\n# c\nC=3\nbad line"
    files = make_files([("p", "ok", ok), ("p", "prose", "Hello there.\nThis is = prose\nmore"), ("p", "empty", " \n"),
                        ("p", "uni", "é1=x")])
    got = {r.path: (r.is_kv, r.n_vars) for r in extract.classify_kv(files).collect()}
    assert got == {"ok": (True, 3), "prose": (False, 1), "empty": (True, 0), "uni": (True, 1)}


def test_names_and_lenient_pairs(make_files):
    files = make_files([("p", ".env", " A = 1\nexport B='x'\nflag\n#c=1")])
    assert sorted(r.key for r in extract.key_names(files).collect()) == ["A", "export B", "flag"]
    pairs = extract.lenient_pairs(extract.to_lines(files)).collect()
    assert sorted((r.key, r.value) for r in pairs) == [("A", "1"), ("B", "'x'")]


def test_syntax_error(make_files):
    long = "x" * 60
    files = make_files([("p", "good", "A=1\n#c\n\n _B =2\n"), ("p", "bad", f"A=1\n{long}\n-"), ("p", "exp", "export A=1")])
    got = {r.path: (r.line_no, r.snippet) for r in extract.first_syntax_error(files).collect()}
    assert got == {"bad": (2, "x" * 50 + "..."), "exp": (1, "export A=1")}


def test_system_variables(make_vars):
    v = make_vars({"p": {"PATH": "x", "APP": "y", "_": "z", "HOME": "h"}})
    assert [r.key for r in extract.drop_system_variables(v).collect()] == ["APP"]
