"""Scores, labels, extraction, quality and packing against brute force and held-out accuracy."""

import math
import random
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import licenses, lm_score, packing, quality, site_style, toxicity
from keyloom.llm.textbytes import FOLDED, SPACES, blocks, hashes, runs

from .conftest import invented

WORDS = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_of_bytes():
    texts = ["Ab  cd", "", "x\ty\nab", "éÀ ab "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    start, end, row = runs(data, offsets, SPACES)
    found = [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
    assert found == [w for t in texts for w in WORDS.findall(t)] and row.tolist() == [0, 0, 2, 2, 2, 3, 3]
    h = hashes(data, start, end, FOLDED)
    assert h[0] == h[4] == h[6] and len(set(h.tolist())) == 5
    assert [b[:2] for b in blocks(data, offsets, 4)] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_base_scores_and_model(make_docs, edge_rows):
    rows = [(i, invented(i % 40, 80)) for i in range(200)] + [(1000 + i, t) for i, (_, t, *_) in enumerate(edge_rows)]
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*WORDS.findall(lower(t)), None])
    total, size = sum(train.values()), len(train)
    found = {r.doc_id: r for r in lm_score.score(make_docs(rows), frequent_words=20).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        tokens, r = [*WORDS.findall(lower(t)), None], found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(train[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (total + size + 1)) for w in tokens))
        assert r.score < 0 and r.bits_per_byte > 0
    assert lm_score.score(make_docs([(None, None), (2, "a")])).count() == 2
    assert lm_score.score(make_docs([])).count() == 0


def test_tables_grow_with_the_vocabulary():
    sizes = [lm_score.table_bits(n) for n in (0, 1, 1 << 13, (1 << 13) + 1, 1 << 15, 1 << 16, 1 << 30)]
    assert sizes == [18, 18, 18, 19, 20, 21, lm_score.MOST_BITS] and lm_score.MOST_BITS == 21
    words = pa.array([b"\x01abc", b"\x01"], pa.binary())
    for bits in (18, 20):
        slots = [s for _, _, _, each in lm_score.Bits(words, bits).each() for s in each]
        assert len(slots) == 8 * lm_score.ORDERS and all(0 <= s.min() and s.max() < 1 << bits for s in slots)


def test_larger_tables_predict_unseen_texts_better(make_docs, monkeypatch):
    docs = make_docs([(i, invented(i, 60)) for i in range(300)])
    found = {}
    for bits in (8, 18):
        monkeypatch.setattr(lm_score, "LEAST_BITS", bits)
        monkeypatch.setattr(lm_score, "MOST_BITS", bits)
        rows = lm_score.score(docs).where("held_out").collect()
        found[bits] = sum(r.bits_per_byte for r in rows) / len(rows)
    assert found[18] < found[8]


def test_scores_read_running_bytes(make_docs, monkeypatch):
    pairs = [("red", "fox"), ("blue", "sky"), ("cold", "sea"), ("wet", "dog"), ("old", "oak"), ("big", "map")]

    def text(seed, shuffled=False):
        rnd = random.Random(seed)
        words = [w for _ in range(40) for w in rnd.choice(pairs)]
        if shuffled:
            rnd.shuffle(words)
        return " ".join(words)

    held = next(i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = make_docs([(i, text(i)) for i in range(200)] + [(held, text(1)), (None, text(1, True))])
    found = {r.doc_id: r for r in lm_score.score(docs).where("doc_id is null or doc_id >= 10000").collect()}
    assert found[held].base_score == pytest.approx(found[None].base_score)
    assert found[held].score > found[None].score + 10  # the same words in another order
    monkeypatch.setattr(lm_score, "PIECE_BYTES", 50)
    texts = pa.array([text(3), text(4) + " d\u00e9 \u0431" + " x" * 80 + " " + text(5).upper(), "", None, "w" * 120 + " " + "v" * 90 + " end "], pa.string())
    data, offsets = lm_score.texts(texts)
    slots = {}
    for limit in (50, 1 << 20):
        monkeypatch.setattr(lm_score, "PIECE_BYTES", limit)
        parts, skips, rows = lm_score._streams(data, offsets, *runs(data, offsets, SPACES))
        bits = lm_score.Bits(pa.array(parts, pa.binary()), 18, np.array(skips))
        slots[limit] = (np.array(rows)[bits.word], bits.byte, *bits.first, *bits.second)
        assert (len(parts) > len(texts)) == (limit == 50)
    assert all((a == b).all() for a, b in zip(*slots.values(), strict=True))


def _bit_by_bit(pieces, width):
    """Counts, weights, map and scores of the model as it is defined: every bit on its own."""
    bits, shape = lm_score.Bits(pieces, width), (lm_score.ORDERS, 1 << width)
    zeros, ones = np.zeros(shape), np.zeros(shape)
    for _, bit, _, slots in bits.each():
        for k, slot in enumerate(slots):
            np.add.at(ones[k], slot[bit], 1)
            np.add.at(zeros[k], slot[~bit], 1)
    weights, hits, scores = np.full((lm_score.GATES, lm_score.ORDERS), 0.2), np.zeros((2, 256 * lm_score.BUCKETS)), np.zeros(len(bits.byte))
    step, squash = (lambda x, steps: np.searchsorted(steps, x)), (lambda x: 1 / (1 + np.exp(-np.clip(x, -15, 15))))
    seen = np.zeros(lm_score.GATES)
    for own in (True, False):
        refine = np.clip((hits[1] + 4 * squash((np.arange(hits.shape[1]) % 33 - 16) / 2)) / (hits.sum(0) + 4), 1e-6, 1 - 1e-6)
        before = weights.astype(np.float32)
        for position, bit, node, slots in bits.each():
            up, down = (np.array([t[k][s] for k, s in enumerate(slots)]) for t in (ones, zeros))
            if own:
                up, down = np.maximum(up - bit, 0), np.maximum(down - ~bit, 0)
            inputs = np.log((up + lm_score.LEAST) / (down + lm_score.LEAST))
            gate = position * 18 + 3 * step((up + down)[-1], [0.5, 2, 8, 64, 1024]) + step((up + down)[-2], [2, 1024])
            mixed = (before[gate].T * inputs).sum(0)
            p, cell = squash(mixed), node * 33 + np.rint(np.clip(mixed, -8, 8) * 2).astype(int) + 16
            if not own:
                p = p / 2 + refine[cell] / 2
                scores += np.log10(np.where(bit, p, 1 - p))
                continue
            np.add.at(hits, (bit.astype(int), cell), 1)
            for g in np.unique(gate):
                x, at = inputs[:, gate == g], gate == g
                weights[g] += np.linalg.solve(20 * np.eye(lm_score.ORDERS) + (x * (p * (1 - p))[at]) @ x.T, x @ (bit - p)[at])
                seen[g] = at.sum()
    return zeros, ones, weights * seen[:, None], hits, np.bincount(bits.word, scores)


def test_half_bytes_count_and_score_like_bits(monkeypatch):
    width, rows = 14, [invented(i, 30) + " d\u00e9j\u00e0 \u0431\u0443\u043a" * (i % 3) for i in range(12)] + ["", None, "w" * 300, "a"]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"])]
    monkeypatch.setattr(lm_score, "TUNE_FIRST", 1 << 16)  # all in one turn
    (pieces, skip), = lm_score._pieces(iter(batches), 1 << 16)
    zeros, ones, weights, hits, scores = _bit_by_bit(pieces, width)

    def added(chunks, sizes):
        kinds = [np.zeros(n) for n in sizes]
        for b in chunks:
            for c, sums in zip(b["chunk"].to_pylist(), b["sums"].to_pylist(), strict=True):
                part, at = np.frombuffer(sums, np.float32), (c & ((1 << 20) - 1)) * lm_score.CHUNK
                kinds[c >> 20][at:at + len(part)] += part
        return kinds

    for part, flush in ((1 << 16, 1 << 30), (32, 100)):  # small parts cut pieces and let counts leave early
        monkeypatch.setattr(lm_score, "PART_BYTES", part)
        monkeypatch.setattr(lm_score, "FLUSH_BYTES", flush)
        counts = added(lm_score._fill(width)(iter(batches)), [lm_score.ORDERS << width])[0].reshape(lm_score.ORDERS, -1)
        for level in range(4):
            at = (np.arange(0, 1 << width, 16)[:, None] + (1 << level) + np.arange(1 << level)).ravel()
            for found, wanted in zip(lm_score.nodes(counts, level), (zeros, ones), strict=True):
                assert (found.reshape(lm_score.ORDERS, -1) == wanted[:, at]).all()
        packed = [lm_score._packed(c.astype(np.float32)) for c in counts]
        tuned = added(
            lm_score._tune(SimpleNamespace(value={"counts": list(packed)}), width)(iter(batches)),
            [lm_score.GATES * lm_score.ORDERS, lm_score.GATES, 2 * 256 * lm_score.BUCKETS],
        )
        assert tuned[0] == pytest.approx(weights.ravel(), rel=1e-3, abs=1e-2)
        assert np.abs(tuned[2] - hits.ravel()).sum() <= 4  # a rounding may fall on the other side
        score = lm_score._scorer(lm_score.model(list(packed), tuned))
        assert score(pieces, skip) == pytest.approx(scores, rel=1e-3, abs=1e-3)


def test_toxicity(spark, make_docs, edge_rows):
    bad = ["moron", "scumbag", "vilou"]
    rows, labels = [], []
    for i in range(400):
        words = invented(i, 60).split()
        if i % 4 == 0:
            words[10:10] = [bad[i // 4 % 3]]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    disguised = [(9001, "the m0r0n " + invented(901, 30)), (9002, "a ѕсum8ag " + invented(902, 30)), (9003, "plain " + invented(903, 30)), (9004, "oxymoronic " + invented(904, 30))]
    docs = make_docs(rows + disguised)
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = [i for i in range(400) if (found[i] >= toxicity.THRESHOLD) != (i % 4 == 0)]
    assert len(wrong) <= 4
    assert found[9001] > 0.7 and found[9002] > 0.7 and found[9003] < 0.7 and found[9004] < 0.7
    assert toxicity.score(make_docs(edge_rows), model).count() == len(edge_rows)
    nothing = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score < 0.01 for r in toxicity.score(docs, nothing).collect()} == {True}


def test_exception_phrases():
    hits = toxicity.matcher({"trash": 5.0}, frozenset({"trash can"}))
    assert hits(toxicity.fold("You TRASH!")) and not hits(toxicity.fold("the trash can")) and not hits(toxicity.fold("trashy"))
    assert toxicity.fold("$tup1d!!") == toxicity.fold("stupid  ")


PAGE = (
    '<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>One <b>two</b>three<br>four<p>Five&nbsp;six'
    '<div class="share">Share this</div><ul class="comments"><li>Nice</li></ul></article><aside>Side</aside><footer>&copy; x</footer></body></html>'
)


def test_pages(spark):
    rows = [(1, "http://a.b/c", PAGE), (2, None, None), (3, "x", ""), (4, "http://a.b/d", "<p>loose <i>text</i> &lt;kept&gt;"), (1, "http://a.b/c", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id, r.text) for r in site_style.extract(pages).collect())
    whole = "Head & line One twothree four Five six"
    assert found == [(1, whole), (1, whole), (2, ""), (3, ""), (4, "loose text <kept>")]
    assert site_style.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("attributes, kept", [
    ('style="overflow:hidden"', True), ('aria-hidden="false"', True), ('href="/hidden-gem"', True), ("href=/hidden-gem", True), ("title='the hidden sea'", True),
    ('data-role="banner"', True), ('data-id="search" data-class=menu', True), ('title="class=menu id=ad"', True), ('class="story"', True),
    ("hidden", False), ('HIDDEN=""', False), ("x=1 hidden", False), ('title="a" role = "banner"', False), ('CLASS="ad"', False), ("id=search", False), ("x='y'class='menu'", False),
])
def test_attributes_are_whole(attributes, kept):
    """Only class, id, role and hidden themselves count, not names and values that contain them."""
    assert site_style.Page(f"<body><div {attributes}><p>Some text</p></div></body>").text() == ("Some text" if kept else "")


@pytest.mark.parametrize(("name", "kept"), [
    *((n, True) for n in ("share-price", "side-effects", "tags-story", "ad-hoc", "legal", "meta", "header-image", "byline", "promotion-of-health", "search-for-truth", "story", "s1")),
    *((n, False) for n in ("cookie-notice", "footer-links", "left_sidebar", "ad-slot-3", "related-list", "share-buttons", "comments", "nav-main", "ad1", "newsletter-signup")),
])
def test_class_names_are_read_whole(name, kept):
    """A part of a name that says something else too cuts nothing; captions and bylines are text."""
    page = f"<article><p>One</p><div class='{name}'><p>Two</p></div><figure><img><figcaption>Three</figcaption></figure></article>"
    assert site_style.Page(page).text() == ("One Two Three" if kept else "One Three")


def test_broken_markup():
    """Defined results for what never ends."""
    cases = {
        "<p>a <b>b<p>c": "a b c", "a < b and c > d": "a < b and c > d", '<p title="x>a</p><p>b': "a b", "<p>a<!-- never": "a", "<p>a<script>x": "a", "a <b": "a <b",
        "<ul><li>a<ul><li>b</ul><li>c</ul>": "a b c", "<table><tr><td>a<td>b<tr><td>c</table>d": "a b c d", "</p>a</div>b": "a b", "<p>a</p x='>'>b": "a b",
        "<div><p>a</div>b": "a b", "<p a='>'>x": "x", "<?pi?>a<!x>b</>c": "abc", "<span>a<div>b</span>c</div>d": "a bc d", "<h1>a</h1 <p>b": "a b",
    }
    assert {html: site_style.Page(html).text() for html in cases} == cases


@pytest.mark.parametrize("piece", ["<b>", "<a href=\"", "<a ", "<!", "</script ", "<td><ul><b>", "<div>", "<p><b><table>", "</x>", "<a b='\"", "<", "<script", "<li><i>", "<p title='x>y</p>", "&amp", "<!--"])
def test_long_broken_pages(piece):
    """A megabyte of anything takes time in proportion."""
    began = time.process_time()
    page = site_style.Page(piece * (1_000_000 // len(piece)))
    page.paths()
    page.text()
    assert time.process_time() - began < 6


def test_boxes_without_telling_names(spark):
    """Generated sites: the article of every page is found though boxes, tags and classes are chosen at random."""
    rnd, rows, wanted = random.Random(8), [], {}
    for site in range(3):
        boxes = [(f"<{tag} class=x{rnd.randrange(10**6)}>{invented(500 + 10 * site + k, 8)}</{tag}>") for k, tag in enumerate(rnd.choices(["div", "section", "p"], k=4))]
        body = f"c{rnd.randrange(10**6)}"
        for i in range(40):
            n = 100 * site + i
            parts = [f"<p>{invented(n, 12 + n % 5)}</p>" for n in (1000 + n, 2000 + n)]
            rows.append((n, f"https://h{site}.x/{n}", f"<body>{boxes[0]}{boxes[1]}<div class={body}>{parts[0]}{boxes[2]}{parts[1]}</div>{boxes[3]}</body>"))
            wanted[n] = " ".join(" ".join(re.sub("<[^>]*>", " ", p) for p in parts).split())
    found = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == wanted


def test_site_style_cuts_repeated_branches(spark):
    """A box without a telling name goes when all pages of the host repeat it; articles stay."""
    rows = [(i, f"http://h.x/{i}", f"<body><article><p>{invented(i, 30)}</p><div class=q7>Always the same words</div></article></body>") for i in range(30)]
    found = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == " ".join(invented(i, 30).split()) for i in range(30))


def test_rare_nodes_of_large_hosts_are_judged(spark):
    """Eight pages that repeat a notice are enough, also where the host has a hundred times as many."""
    notice = "<div class=q8>Always the same words</div>"
    rows = [(i, f"http://h.x/{i}", f"<body><div class=s><p>{invented(i, 12)}</p>{notice if i < 8 else ''}</div></body>") for i in range(900)]
    found = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == " ".join(invented(i, 12).split()) for i in range(900))


def test_licenses(make_docs, edge_rows):
    rows = [(1, "Released under the MIT License.\nThe MIT license, again"), (2, "licensed under cc by-nc 4.0"), (3, "no licence"), (4, None), (5, ""),
            (6, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software without limits\n\nother"),
            (7, "mit\nlicense")]
    found = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (2, 3, 6, ["mit"])
    assert found[1].template_labels == ["mit-notice"] and found[2].base_labels == ["cc-by"]
    assert found[6].template_labels == ["mit-permission"] and found[6].n_base == 0 and found[6].containment >= 0.8
    assert found[7].n_base == 1 and found[3].n_base == 0 and found[4].n_words == found[5].n_words == 0 and found[4].first_word is None
    assert licenses.scan(make_docs(edge_rows)).count() == len(edge_rows) and licenses.scan(make_docs([])).count() == 0


def brute_blocks(text, n_words):
    """The blocks of a text for a template of ``n_words`` words, as sets of words."""
    paragraphs = [[]]
    for line in text.lower().split("\n"):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", line)
        if words:
            paragraphs[-1].append(words)
        elif paragraphs[-1]:
            paragraphs.append([])
    paragraphs = [p for p in paragraphs if p]
    for lines in paragraphs:
        for i, line in enumerate(lines):
            yield set(line)
            j, after = i, 0
            while after < n_words - 1 and j + 1 < len(lines):
                j += 1
                after += len(lines[j])
            yield {w for x in lines[i:j + 1] for w in x}
        if len(paragraphs) > 1:
            yield {w for x in lines for w in x}


def test_similarity_join_is_exact(make_docs):
    """The containment of every template in every line, run of lines and paragraph, counted directly."""
    templates = [("one", "a b c d e f g h i j"), ("two", "c d x"), ("none", ""), ("twice", "x a x b x c")]
    rows = [(i, "\n".join(" ".join("abcdefghijxyz"[(i * k + j * j) % 13] for j in range(k + 3)) for k in range(12))) for i in range(40)]
    rnd = random.Random(3)
    rows += [(100 + i, "".join(rnd.choice("abcdefghijxyz") + rnd.choice(" " * sparse + "\n\n") for _ in range(rnd.randint(1, 60)))) for i in range(300) for sparse in [rnd.choice([1, 4, 12])]]
    found = {r.doc_id: (set(r.template_labels), r.containment) for r in licenses.scan(make_docs(rows), {}, templates).collect()}
    several = 0
    for i, text in rows:
        share = {label: max(len(set(t.split()) & b) / len(set(t.split())) for b in brute_blocks(text, len(t.split()))) for label, t in templates if t}
        wanted = {label: s for label, s in share.items() if s >= math.ceil(0.8 * len(set(dict(templates)[label].split()))) / len(set(dict(templates)[label].split()))}
        several += 0 < len(wanted) < 3
        assert found[i] == (set(wanted), pytest.approx(max(wanted.values(), default=0.0)))
    assert several > 50


def test_wrapped_passages(make_docs):
    """A passage wrapped over lines of a text without blank lines, beginning inside a line; common words far apart are no passage."""
    passage = licenses.TEMPLATES[0][1]
    wrapped = re.sub(r"((?:\S+ ){6})", r"\1\n", passage)
    far = "\n".join(f"{w} {invented(i, 30).split(chr(10))[0]} {invented(50 + i, 40).split(chr(10))[0]}" for i, w in enumerate(passage.split()))
    docs = make_docs([(1, f"{invented(5, 60)}some words before {wrapped}\n{invented(6, 60)}"), (2, wrapped), (3, far), (4, passage)])
    found = {r.doc_id: (r.template_labels, r.containment) for r in licenses.scan(docs).collect()}
    assert found == {1: (["mit-permission"], 1.0), 2: (["mit-permission"], 1.0), 3: ([], 0.0), 4: (["mit-permission"], 1.0)}


def test_quality(make_docs, edge_rows):
    shared = "this line stands in very many documents of the host"
    rows = [(i, f"{shared}\n{invented(i, 70)}", "h") for i in range(8)] + [(100 + i, shared + "\n" + shared, "h") for i in range(3)] + [(200, shared + "\n" + invented(99, 60), "other")]
    judged = {r.doc_id: r for r in quality.judge(make_docs(rows), max_docs=5).collect()}
    assert all(judged[i].kept and judged[i].n_removed_words == 10 for i in range(8))
    assert judged[200].n_removed_words == 0 and judged[100].n_dup_lines == 1 and not judged[100].kept
    docs = make_docs(rows)
    cleaned = quality.clean(docs, max_docs=5)
    texts = {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()}
    assert cleaned.columns == docs.columns and set(texts) == {*range(8), 200}
    assert texts[0] == (invented(0, 70), len(invented(0, 70))) and texts[200][0] == rows[-1][1]
    assert quality.judge(make_docs(edge_rows)).count() == len(edge_rows)
    assert quality.clean(make_docs(edge_rows)).count() == 4 and quality.clean(make_docs([])).count() == 0


def test_copies_are_one_text_of_their_host(make_docs):
    """Fifty-one copies are no boilerplate; a line of fifty-one texts is, unless these are a small share of the host."""
    shared = "this line stands in fifty-one texts"
    rows = [(i, invented(1, 80), "h") for i in range(51)] + [(100 + i, f"{shared}\n{invented(100 + i, 60)}", "h") for i in range(51)] + [(None, invented(1, 80), "h")]
    judged = [(r.doc_id, r.kept, r.n_removed_words) for r in quality.judge(make_docs(rows)).collect()]
    assert sorted((i, n) for i, kept, n in judged if kept and i is not None) == [(i, 0) for i in range(51)] + [(100 + i, 6) for i in range(51)]
    assert (None, True, 0) in judged and len(judged) == len(rows)
    assert {r.n_removed_words for r in quality.judge(make_docs(rows), max_share=0.99).collect()} == {0}
    assert {r.n_removed_words for r in quality.judge(make_docs(rows), max_share=0.97).collect()} == {0, 6}


def test_repeated_windows(make_docs):
    text = "a b c d a b c e a b c d x"
    assert quality.judge(make_docs([(1, text)])).first().n_repeat_words == 11
    assert quality.judge(make_docs([(1, "z " * 10)])).first().n_repeat_words == 10


def test_packing(make_docs, edge_rows):
    rows = [(i, invented(i, 20 + i * 7 % 400)) for i in range(150)] + edge_rows + [(500, "odd <|endoftext|> text")]
    docs = make_docs(rows)
    packed = packing.pack_documents(docs, with_ids=True).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.vocabulary_files()[0])
    wanted = Counter()
    for i, t, *_ in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        first = len(ids) % 1024 or 1024
        while at < len(ids):
            n = first if at == 0 else 1024
            wanted[i, at, n, tuple(ids[at:at + n])] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, tuple(r.ids)) for r in packed) == wanted
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in packed)
    assert len(bins) <= -(-total // 1024) + 2
    assert packing.pack_documents(make_docs([])).count() == 0


def test_local_search_empties_bins():
    """Best fit leaves four bins where three do; exchanges find them."""
    sizes = [6, 5, 5, 4, 4, 3, 3]
    start = [[0, 3], [1, 2], [4, 5], [6]]
    better = packing.local_search([list(b) for b in start], sizes, 10)
    assert len(better) == 3 and sorted(i for b in better for i in b) == list(range(7))
    assert all(sum(sizes[i] for i in b) <= 10 for b in better)
