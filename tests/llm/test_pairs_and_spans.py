"""Joins, deduplication and decontamination against brute force."""

import random
import re
import time
from itertools import combinations

import numpy as np
import pytest

from keyloom.llm import decontaminate, line_dedup, ngram_join, sentence_dedup
from keyloom.llm.tables import DONE_SHUFFLES, components, cut

from .conftest import invented

SPACE = re.compile("[^\x20\x09-\x0d]+")


def near_copies(base, n):
    words = base.split()
    return [" ".join(words[:10 * i] + [f"edit{i}"] + words[10 * i + 1:]) for i in range(n)]


def brute_components(rows, size=3, percent=90):
    sets = {}
    for i, t in rows:
        w = SPACE.findall((t or "").lower())
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1 << 20, 2_000])
def test_jaccard_components(make_docs, block):
    """Also with blocks so small that regions are split over many."""
    base, other = invented(1, 400), invented(2, 60)
    texts = [base, base, *near_copies(base, 30), other, *near_copies(other, 5), invented(3, 300), "x y z", "x y z w", "", None, " ".join(["again"] * 50)]
    chain = base.split()
    for _ in range(4):  # each links with the one before, the ends do not link
        chain = chain[8:] + [f"new{len(texts)}{k}" for k in range(8)]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts, 10))
    found = {r[0]: (r[1], r[2]) for r in ngram_join.join(make_docs(rows), block_elements=block).collect()}
    assert found == brute_components(rows)


def test_jaccard_components_at_five_and_eighty(make_docs, monkeypatch):
    """Sets whose parts are small, some empty; the blocks of one region are dealt out by an exchange on (region, block)."""
    base, other = invented(1, 400), invented(2, 60)
    boilerplate = invented(6, 30)
    rows = list(enumerate([base, *near_copies(base, 20), other, *near_copies(other, 5), *[boilerplate + invented(100 + i, 25) for i in range(30)], *[invented(200 + i, 12) for i in range(30)], "a b c d e", "a b c d e f", ""]))
    plans = []
    monkeypatch.setattr(ngram_join, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    found = {r[0]: (r[1], r[2]) for r in ngram_join.join(make_docs(rows), 5, 80, block_elements=1_500).collect()}
    assert found == brute_components(rows, 5, 80)
    grouped = [p for p in plans if "FlatMapGroupsInPandas" in p]
    assert len(grouped) == 1 and re.search(r"hashpartitioning\(region#\d+L?, block#\d+L?", grouped[0])


@pytest.mark.parametrize(("percent", "sizes"), [(80, [6, 10, 30, 100, 1_000, 100_000]), (90, [12, 40, 300, 100_000])])
def test_linked_sets_share_a_root(percent, sizes):
    """Pairs at the threshold meet at a part that has elements, also sets that leave many parts empty."""
    rng = np.random.default_rng(5)
    lows = ngram_join.intervals(1 << 18, percent)
    sparse = 0
    for size in sizes:
        for trial in range(200 if size < 1_000 else 4):
            pool = rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64)
            if trial % 4 == 3:  # crowded in an eighth of the hash range: most parts of the first order are empty
                pool >>= np.uint64(3)
                sparse += 1
            swap = size * (100 - percent) // (100 + percent)
            a, b = np.unique(pool[:size]), np.unique(pool[swap:size + swap])
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            ka, kb = ngram_join._keys(a, lows, percent), ngram_join._keys(b, lows, percent)
            assert np.array_equal(a, b) or len(np.intersect1d(ka, kb)), (size, trial)
            if trial % 4 < 3 and size >= 1_000:  # chance alone needs no second order
                assert len(ka) <= 2 * size * (100 - percent) / 100 * 2.5
    assert sparse


def test_common_passages_make_no_region(make_docs, monkeypatch):
    """Texts that share a passage, but are not alike, are left alone; near copies among them still meet."""
    common = invented(7, 40)
    texts = [invented(300 + i, 150) + common + invented(400 + i, 150) for i in range(60)]
    copies = near_copies(texts[0], 3)
    rows = list(enumerate([*texts, *copies], 1))
    sets, stored = [], ngram_join.cut

    def watched(df):
        out = stored(df)
        if out.columns == ["region", "doc", "n", "elements"]:
            sets.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", watched)
    found = {r[0]: (r[1], r[2]) for r in ngram_join.join(make_docs(rows), 5, 80).collect()}
    assert found == brute_components(rows, 5, 80)
    assert sets == [1 + len(copies)]  # 54 met at roots of the passage before


@pytest.mark.parametrize(("percent", "sizes"), [(80, [8, 30, 300]), (90, [12, 40, 400])])
def test_linked_sets_share_more_roots_than_they_leave_out(percent, sizes):
    """Whatever order roots are ranked in, the last one that a linked pair shares stays with both sets."""
    rng = np.random.default_rng(6)
    lows = ngram_join.intervals(1 << 12, percent)
    for size in sizes:
        for trial in range(100):
            pool = rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64) >> np.uint64(3 if trial % 4 == 3 else 0)
            swap = size * (100 - percent) // (100 + percent)
            a, b = np.unique(pool[:size]), np.unique(pool[swap:size + swap])
            stay = [np.concatenate([np.sort(keys)[spare:] for keys, _, spare in ngram_join._cuts(s, lows, percent)]) for s in (a, b)]
            assert np.array_equal(a, b) or len(np.intersect1d(*stay)), (size, trial)


def test_one_row_of_a_group_stays(make_docs):
    """Near copies, repeated rows and rows that share an id or have none are rows of one group."""
    base = invented(61, 120)
    edits = near_copies(base, 3)
    own = invented(62, 120)
    kept = ngram_join.keep_one(make_docs([(5, edits[0]), (None, base), (4, base), (4, base), (None, edits[1]), (4, own), (None, ""), (None, None)]), 5, 80)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == sorted([(4, base), (4, own)])
    assert kept.where("doc_id is null").count() == 2


def test_jaccard_edges(make_docs, edge_rows):
    rows = ngram_join.join(make_docs(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    found = sorted(((r[0] or 0), r[1] > 0, r[2]) for r in rows)
    assert (7, True, 6) in found and (6, True, 6) in found and (1, False, 1) in found and (2, False, 2) in found
    assert (0, True, 5) in found  # a null id follows its equal set
    assert ngram_join.join(make_docs([])).count() == 0
    docs = make_docs(edge_rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {7} & {r.doc_id for r in kept.collect()} == set()


def test_components(spark):
    edges = [(i, i + 1) for i in range(10)] + [(20, 22), (22, 21), (30, 30)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(11), 0), 20: 20, 21: 20, 22: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(rows, items, size=13):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = pattern.findall((t or "").lower())
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w = pattern.findall((t or "").lower())
        hit, met = [False] * len(w), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    met |= owners
                    hit[k:k + len(window)] = [True] * len(window)
        out[i] = (len(w), sum(hit), len(met))
    return out


def test_decontamination(spark, make_docs, edge_rows):
    passage = invented(4, 40)
    items = [(1, passage), (2, invented(5, 20)), (3, "tiny item"), (4, ""), (5, None), (6, passage), (7, "la la la la la la la la la la la la la la")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, passage), (2, invented(6, 300) + passage[60:] + invented(6, 20)), (3, "TINY, item! tiny"), (4, "la " * 40), (5, ""), (6, None), (7, invented(9, 100)), (8, passage.replace(" ", "; "))]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.hits(make_docs(rows), benchmark).collect()}
    assert found == brute_hits(rows, items)
    small = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.hits(make_docs(rows), benchmark, every=1).collect()}
    assert small == found
    docs = make_docs(rows)
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [5, 6, 7]
    assert decontaminate.decontaminate(make_docs(edge_rows), benchmark.limit(0)).count() == len(edge_rows)
    assert decontaminate.hits(make_docs([]), benchmark).count() == 0


def test_sentence_spans(make_docs, edge_rows):
    passage = "This passage has several words in it. It goes on for a while here. And then it ends at last."
    rows = [(1, f"Own start is here now. {passage} Own end."), (2, f"{passage}\nSomething else follows it."), (3, "Short. One. Two."), (4, "Short. One. Two."), (5, None)]
    out = {r.doc_id: (r.text, [tuple(x) for x in r["_removed"]]) for r in sentence_dedup.dedup(make_docs(rows)).collect()}
    assert out[1] == (rows[0][1], [])
    assert out[2][0] == "Something else follows it."
    assert out[3][1] == out[4][1] == [] and out[5][0] is None
    docs = make_docs(edge_rows)
    result = sentence_dedup.dedup(docs)
    assert result.columns == [*docs.columns, "_removed"] and result.count() == len(edge_rows)
    assert [r.text for r in result.where("doc_id is null and lang = 'en'").collect() if r.text] == []  # null comes last, after 5
    assert sentence_dedup.dedup(make_docs([])).count() == 0


def test_line_runs(make_docs, edge_rows):
    a, b, c = "first line of the run here", "second line of the run", "third line of the run"
    rows = [(1, f"{a}\n{b}\n{c}\nown"), (2, f"x\n{a}\n\n{b}\ny"), (3, f"{b}\nz"), (4, f"{a}\n{b}\n{a}\n{b}"), (5, ""), (6, f"{c}\n{b}")]
    out = {r.doc_id: [tuple(x) for x in r["_removed"]] for r in line_dedup.dedup(make_docs(rows)).collect()}
    assert out == {1: [], 2: [(1, 2)], 3: [], 4: [(0, 3)], 5: [], 6: []}
    texts = {r.doc_id: r.text for r in line_dedup.dedup(make_docs(rows)).collect()}
    assert texts[2] == "x\ny" and texts[4] == ""
    docs = make_docs(edge_rows)
    result = line_dedup.dedup(docs)
    assert result.count() == len(edge_rows) and line_dedup.dedup(make_docs([])).count() == 0
    depths = [level.select("name").distinct().count() for level in line_dedup.intervals(make_docs(rows))]
    assert depths == [3, 1]


def brute_runs(rows, min_words=8, min_line_words=20):
    """The lines of every run that stands earlier too, in documents by id and places in order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = [" ".join(SPACE.findall(lower)) for lower in (text or "").lower().split("\n") if SPACE.findall(lower)]
        gone = set()
        for start in range(len(lines)):
            new = []
            for end in range(start + 1, len(lines) + 1):
                run = tuple(lines[start:end])
                n = sum(len(x.split()) for x in run)
                if run in seen and (n >= min_line_words if len(run) == 1 else n >= min_words):
                    gone |= set(range(start, end))
                new.append(run)
            seen |= set(new)
        out[i] = gone
    return out


def test_runs_of_every_length(make_docs):
    """Few lines in many orders: the lines of all repeated runs go, and no others. Three lines of three words are one run."""
    rnd = random.Random(11)
    pool = ["a", "b b", "c c c", "D d d", "e " * 9, "f " * 21, "g", "h h"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    rows += [(100, "p q r\ns t u\nv w x\nown of it"), (101, "before it\np q r\ns t u\nv w x"), (102, "p q r\ns t u")]
    rows += [(110, "\n".join("jklmnopq")), (111, "x1\n" + "\n".join("jklmnopq") + "\nx2"), (112, "\n".join("jklmnop"))]
    out = {r.doc_id: {k for x in r["_removed"] for k in range(x["first"], x["last"] + 1)} for r in line_dedup.dedup(make_docs(rows)).collect()}
    assert out == brute_runs(rows)
    assert out[101] == {1, 2, 3} and out[111] == set(range(1, 9)) and out[102] == out[112] == set()


def brute_spans(rows, least=2, min_words=10):
    """The sentences of every shortest run from a sentence on that stands earlier too."""
    first, spans, out = {}, [], {}
    for i, text in sorted(rows):
        sentences = [s for line in (text or "").lower().split("\n") for s in re.findall(r"(?:[^ ]*[^ .!?] +|[^ ]*[^ .!?]$)*(?:[^ ]*[.!?](?= |$))?", line) if s.strip()]
        out[i] = (sentences, set())
        for start in range(len(sentences)):
            for end in range(start + least, len(sentences) + 1):
                if sum(len(s.split()) for s in sentences[start:end]) >= min_words:
                    run = tuple(" ".join(s.split()) for s in sentences[start:end])
                    if first.setdefault(run, (i, start)) != (i, start):
                        out[i][1].update(range(start, end))
                    break
    return {i: gone for i, (_, gone) in out.items()}


def test_spans_of_whole_sentences(make_docs):
    """All repeated spans, by brute force; a long sentence is never cut inside."""
    rnd = random.Random(12)
    pool = ["One two.", "Three four five six!", "Seven eight nine ten eleven twelve?", "And no end of it", "Short.", "long " * 30 + "end."]
    rows = [(i, "".join(rnd.choice(pool) + rnd.choice([" ", "\n"]) for _ in range(rnd.randint(0, 9)))) for i in range(50)]
    whole = " ".join(f"w{k}" for k in range(120))
    rows += [(100, whole + "."), (101, f"Other {whole} ends."), (102, " ".join(whole.split()[20:100]))]
    out = {r.doc_id: {k for x in r["_removed"] for k in range(x["first"], x["last"] + 1)} for r in sentence_dedup.dedup(make_docs(rows)).collect()}
    assert out == brute_spans(rows)
    assert not out[101] and not out[102]


@pytest.mark.parametrize("same_id", [None, 9])
def test_rows_without_an_id_of_their_own(spark, make_docs, same_id):
    """Null and shared ids name no row: what one row repeats is cut there, and only there."""
    run = "\n".join(invented(41, 36).strip().split("\n"))
    own = [invented(42 + i, 72) for i in range(3)]
    rows = [(1, run), (same_id, run + "\n" + own[0]), (same_id, own[1]), (same_id, own[2]), (same_id, own[2])]
    wanted = sorted([run, own[0], own[1], own[2], ""])
    for dedup in (line_dedup.dedup, sentence_dedup.dedup):
        docs = make_docs(rows)
        result = dedup(docs)
        assert result.columns == [*docs.columns, "_removed"]
        assert sorted(r.text for r in result.collect()) == wanted
    benchmark = spark.createDataFrame([(1, own[1])], "item_id long, text string")
    kept = decontaminate.decontaminate(make_docs(rows), benchmark)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted(t for _, t in rows if t != own[1])


def test_null_ids_do_not_multiply(make_docs):
    """As many suffixes in an interval as there are rows, not all pairs of them."""
    run = invented(51, 90)
    docs = make_docs([(None, run)] * 12)
    assert [level.where("place = 0").count() for level in line_dedup.intervals(docs)] == [12, 12, 12]
    assert sum(r.text != "" for r in line_dedup.dedup(docs).collect()) == 1


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}

    before = files()
    stored = cut(spark.range(20_000).repartition(4, "id").groupBy("id").count())
    deadline = time.monotonic() + 20
    while (left := files() - before) and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not left and stored.count() == 20_000
    assert spark.conf.get(DONE_SHUFFLES) == "false"
