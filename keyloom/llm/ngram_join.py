"""N-gram Jaccard self-join: sets of word shingles, joined through prefix trees.

1. One pass turns each text into its sorted set of 64-bit shingle hashes. Equal sets are
   one class; only its smallest document goes on.
2. The hash range is cut into more parts than two linked sets can differ in elements, so
   linked sets agree on a whole part: each part is the root path of a prefix tree, and
   its hash is the key that sends a set to that tree. Sets that share a root with no
   other set have no link. A set size belongs to an interval, and a set serves its own
   interval and the one below, so both sets of a link use the same number of parts.
   A part without elements is no root. There are spare parts, more than twice those that
   chance leaves empty; a set that leaves more empty is also cut by a second and a third
   hash order, where its partners of that kind meet it, and only one that all three
   orders leave sparse is sent to the roots of its empty parts as well. Linked sets agree
   on more parts than the spare ones, so each set leaves out as many of its commonest
   roots as it has spare parts with elements: the rarest root of a link always stays, and
   passages that many texts share bring nobody together.
3. Sets that meet at a root, directly or through others, form a region. A region's sets
   are sent once, in blocks of bounded size, and each block stores them in one prefix
   tree, commonest shingle first. A query walks all branches at once, sharing the overlap
   of common paths, and leaves a branch as soon as the elements left on either side
   cannot reach the threshold. What it reaches is decided exactly.
4. Every block first links the region's smallest document. Sets in the largest component
   of a block need no query of their own, as their links within it change nothing and
   links to other sets are found from those. Sets that are not connected with the
   region's smallest document are then searched in those other blocks of the region that
   hold a set with one of their roots.

Defined results: null and empty texts, and texts without words, have an empty set, link
with nothing and are their own component; equal rows share a component; a null doc_id
gets the component of its equal sets and takes part in no other link. A text of fewer
words than a shingle is one shingle. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import ROW, components, cut, ids_are_keys, in_batches, kept, keyed, marked, scratch, spread
from .textbytes import SPACES, blocks, combine, mix, texts, words

SHINGLE = 3
PERCENT = 90
SPARE = 2
SPARE_SHARE = 0.25  # spare parts for each part that may differ: so many common roots can be left out
ORDERS = 3
BLOCK_ELEMENTS = 1 << 19
TURN_BLOCKS = 2  # sets that visit a block come in turns of so many blocks' elements: a tree takes some ten times the memory of its sets
BAND_BLOCKS = 1 << 30
CUT_BITS = 32
BAND_MARGIN = 1.000001  # a band is a little wider than the ratio of linked sizes, so rounding parts no pair by two


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    row, h = words(data, offsets, SPACES)
    rows = len(offsets) - 1
    begin = np.searchsorted(row, np.arange(rows + 1))
    shingles = combine(*[h[i:len(h) - size + 1 + i] for i in range(size)]) if len(h) >= size else np.zeros(0, np.uint64)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(shingles[a:b - size + 1])
        elif b > a:
            yield combine(*[h[i:i + 1] for i in range(a, b)])
        else:
            yield h[:0]


def intervals(limit: int, percent: int) -> np.ndarray:
    """Lower ends of the size intervals up to ``limit``; the upper end is ``100 * lower // percent``."""
    lows = [1]
    while lows[-1] <= limit:
        lows.append(100 * lows[-1] // percent + 1)
    return np.array(lows, np.int64)


def _cut(s: np.ndarray, parts: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The filled parts of a set in one of the hash orders, and a hash of the elements in each."""
    by = s if not order else mix(s + np.uint64(order))
    part = (((by >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    held = mix(s)
    if order:
        at = np.argsort(part, kind="stable")
        part, held = part[at], held[at]
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    first = np.flatnonzero(new)
    with np.errstate(over="ignore"):
        return part[first], np.add.reduceat(held, first)


def spare_parts(low: int, differ: int) -> int:
    """Spare parts for sets of at least ``low`` elements: two, a share of those that may differ, and twice what chance leaves empty."""
    parts = differ + 1 + int(SPARE_SHARE * differ)
    return SPARE + int(SPARE_SHARE * differ) + int(2 * parts * np.exp(-low / parts))


def _cuts(s: np.ndarray, lows: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(keys, number, spare) of each cut of a set into root paths, for its own size interval and the one below.

    Two linked sets agree on more parts than the spare ones. If one of them leaves no more than those empty, a
    part they agree on has elements. If both leave more empty, both go on to the next hash order. Of the parts
    with elements in a cut that both have, linked sets agree on more than either set's ``spare``.
    """
    if not len(s):
        return
    own = int(np.searchsorted(lows, len(s), "right")) - 1
    for at in sorted({max(0, own - 1), own}):
        low = int(lows[at])
        high = 100 * low // percent
        differ = (high + 100 * high // percent) * (100 - percent) // (100 + percent)
        if not differ:
            continue  # equal sets only
        spare = spare_parts(low, differ)
        for order in range(ORDERS):
            filled, total = _cut(s, differ + 1 + spare, order)
            yield combine(total, filled, np.full(len(filled), at * ORDERS + order)), at * ORDERS + order, max(0, len(filled) - differ - 1)
            if differ + 1 <= len(filled):
                break
        else:
            empty = np.setdiff1d(np.arange(differ + 1 + spare), filled)
            yield combine(np.zeros(len(empty), np.uint64), empty, np.full(len(empty), at * ORDERS)), at * ORDERS, 0


def _keys(s: np.ndarray, lows: np.ndarray, percent: int) -> np.ndarray:
    """Keys of all root paths of a set."""
    return np.concatenate([s[:0], *[keys for keys, _, _ in _cuts(s, lows, percent)]])


def _texts_in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, shingle sets) of (id, text) rows, a block of texts at a time."""
    for batch in batches:
        data, offsets = texts(batch.column(1))
        for first, last, part, bounds in blocks(data, offsets):
            yield batch.column(0).slice(first, last - first), list(shingle_sets(part, bounds, size))


def prints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, s1, s2) of every document; (n, s1, s2) names the set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _texts_in_blocks(batches, size):
            with np.errstate(over="ignore"):
                s1 = [mix(s).sum(dtype=np.uint64) for s in sets]
                s2 = [mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
            ], names=["doc_id", "n_shingles", "s1", "s2"])

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_shingles long, s1 long, s2 long")


class _Roots:
    """Keys of sets and their cuts, with size intervals that grow with the largest set met."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, intervals(1 << 10, percent)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(s) >= self.lows[-1]:
            self.lows = intervals(2 * len(s), self.percent)
        cuts = list(_cuts(s, self.lows, self.percent))
        of = np.array([(number << CUT_BITS) + spare for _, number, spare in cuts], np.int64)
        return np.concatenate([s[:0], *[keys for keys, _, _ in cuts]]), np.repeat(of, [len(keys) for keys, _, _ in cuts])


def roots_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, doc, cut): every root of every document, made from the texts and never stored with them.

    ``cut`` is the cut's number, and in the lower ``CUT_BITS`` how many of its roots can be left out.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _Roots(percent)
        for ids, sets in _texts_in_blocks(batches, size):
            keys, of = zip(*map(roots, sets), strict=True)
            again = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), ids.take(again), pa.array(np.concatenate(of))], names=["key", "doc", "cut"])

    return in_batches(docs).select(F.col("doc").cast("long"), "text").mapInArrow(task, "key long, doc long, cut long")


def rare_roots(roots: DataFrame) -> DataFrame:
    """(key, doc) of the roots that other documents have too, without the commonest ones that each cut can spare; stored.

    All sets rank roots alike, and linked sets share more roots of a cut than either leaves out, so the rarest
    of those stays with both.
    """
    counted = roots.repartition(spread(roots.sparkSession), "key").withColumn("n", F.count("*").over(Window.partitionBy("key")))
    met = cut(counted.where("n > 1"))
    place = F.row_number().over(Window.partitionBy("doc", "cut").orderBy(F.desc("n"), "key"))
    return cut(met.withColumn("place", place).where(F.col("place") > F.col("cut").bitwiseAND(F.lit((1 << CUT_BITS) - 1))).select("key", "doc"))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc): join each further document of a key with the key's first."""
    held_key, held_doc = None, None
    for batch in batches:
        key, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = held_key is None or key[0] != held_key
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        leader = np.where(first >= 0, doc[first], held_doc if held_doc is not None else 0)
        held_key, held_doc = key[-1], leader[-1]
        pair = np.unique(np.stack([leader, doc], 1)[leader != doc], axis=0) if (leader != doc).any() else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


class PrefixTree:
    """Ranked sets in a radix tree; each node holds a run of elements shared by all sets below it."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        self.values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int32)  # a block has fewer elements
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        self.rank = rank
        ends = np.cumsum([len(s) for s in sets])
        ranked = [np.sort(x) for x in np.split(rank[inverse], ends[:-1])]
        del flat, inverse, count
        order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        start, end, owner, parent, depth, smallest, largest, sets_at = [], [], [], [], [], [], [], []

        def node(of: int, a: int, b: int, above: int) -> int:
            owner.append(of), start.append(a), end.append(b), parent.append(above), depth.append(b)
            smallest.append(1 << 60), largest.append(0), sets_at.append([])
            return len(owner) - 1

        path = [node(order[0], 0, 0, -1)] if order else []
        previous = None
        for i in order:
            s = ranked[i]
            shared = 0
            if previous is not None:
                m = min(len(previous), len(s))
                other = np.flatnonzero(previous[:m] != s[:m])
                shared = int(other[0]) if len(other) else m
            while depth[path[-1]] > shared:
                top = path.pop()
                if depth[path[-1]] < shared:  # part the run: what is shared becomes a node of its own
                    middle = node(owner[top], depth[path[-1]], shared, path[-1])
                    start[top], parent[top] = shared, middle
                    smallest[middle], largest[middle] = smallest[top], largest[top]
                    path.append(middle)
            if len(s) > shared:
                path.append(node(i, shared, len(s), path[-1]))
            sets_at[path[-1]].append(i)
            for x in path:
                smallest[x], largest[x] = min(smallest[x], len(s)), max(largest[x], len(s))
            previous = s
        base = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.elements = np.concatenate(ranked)
        self.start = base[owner] + np.array(start)
        self.length = np.array(end) - np.array(start)
        self.depth, self.smallest, self.largest = np.array(depth), np.array(smallest), np.array(largest)
        children = np.argsort(parent, kind="stable")
        held = np.array(parent)[children]
        self.children = children
        self.child_from, self.child_to = np.searchsorted(held, np.arange(len(owner))), np.searchsorted(held, np.arange(len(owner)), "right")
        self.sets_at = sets_at

    def linked(self, query: np.ndarray, percent: int) -> list[int]:
        """Indices of the stored sets whose Jaccard similarity with ``query`` reaches the threshold."""
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        known = np.sort(self.rank[at[self.values[at] == query]])
        member = np.zeros(len(self.values), np.int64)
        member[known] = 1
        size, found = len(query), []
        node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            count = self.child_to[node] - self.child_from[node]
            overlap = np.repeat(overlap, count)
            node = self.children[_ragged(self.child_from[node], count)]
            if not len(node):
                break
            length = self.length[node]
            inside = member[self.elements[_ragged(self.start[node], length)]]
            overlap = overlap + np.add.reduceat(inside, np.cumsum(length) - length)
            last = self.elements[self.start[node] + length - 1]
            missed_here = self.depth[node] - overlap
            reachable = size - (len(query) - len(known)) - (np.searchsorted(known, last, "right") - overlap)
            best = np.clip(missed_here + reachable, self.smallest[node], self.largest[node])
            alive = (100 + percent) * np.minimum(best - missed_here, reachable) >= percent * (best + size)
            node, overlap = node[alive], overlap[alive]
            for x, o in zip(node.tolist(), overlap.tolist(), strict=True):
                if self.sets_at[x] and (100 + percent) * o >= percent * (int(self.depth[x]) + size):
                    found += self.sets_at[x]
        return found


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i] + count[i]."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _within(percent: int):
    """(region, block) -> a star of edges for each component; the region's first document leads its own."""

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        docs = pdf["doc"].tolist()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
        tree, root = PrefixTree(sets), list(range(len(docs)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def query(i: int) -> None:
            for j in tree.linked(sets[i], percent):
                root[find(j)] = find(i)

        lead = docs.index(key[0])
        query(lead)
        # any component may go without queries as long as every other one is queried
        pending = [i for i in range(len(docs)) if find(i) != find(lead)]
        for i in pending:
            query(i)
        name: dict[int, int] = {find(lead): docs[lead]}
        for i in range(len(docs)):
            name.setdefault(find(i), docs[i])
        return pd.DataFrame({"region": key[0], "block": key[1], "a": [name[find(i)] for i in range(len(docs))], "b": docs})

    return group


def _across(percent: int):
    """Links of query sets with the sets of another block."""

    def group(_: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        pairs: list[tuple[int, int]] = []
        if len(held) and len(asked):
            docs = held["doc"].tolist()
            tree = PrefixTree([np.frombuffer(x, np.uint64) for x in held["elements"]])
            for doc, elements in zip(asked["doc"].tolist(), asked["elements"], strict=True):
                linked = tree.linked(np.frombuffer(elements, np.uint64), percent)
                pairs += [(doc, docs[j]) for j in linked]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return group


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(region, doc, n, elements) of documents that have a region."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(2))
            for first, last, part, bounds in blocks(data, offsets):
                found = list(shingle_sets(part, bounds, size))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                    pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()),
                ], names=["region", "doc", "n", "elements"])

    return docs.select("region", "doc", "text").mapInArrow(task, "region long, doc long, n long, elements binary")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``, stored."""
    with scratch(docs.sparkSession):
        return kept(_joined(docs, size, percent, block_elements))


def _joined(docs: DataFrame, size: int, percent: int, block_elements: int) -> DataFrame:
    parts = spread(docs.sparkSession)
    printed = cut(prints(docs, size))
    same_set = ["n_shingles", "s1", "s2"]
    classes = printed.where("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("rep"))
    members = printed.select("doc_id", *same_set).join(classes, same_set, "left")
    # only copies of a set are shuffled to find out that they are not the first of their class
    copies = cut(members.where("doc_id <> rep").select(F.col("doc_id").alias("_copy")).distinct())
    own_texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null")
    told = marked(own_texts, "doc", copies)
    firsts = told.where("not _marked").union(told.where("_marked").join(copies, F.col("doc") == F.col("_copy"), "left_anti"))
    roots = rare_roots(roots_of(firsts, size, percent))
    met = roots.repartition(parts, "key").sortWithinPartitions("key", "doc").mapInArrow(_meetings, "a long, b long")
    regions = components(met).select(F.col("node").alias("doc"), F.col("component").alias("region"))
    regions = cut(regions)
    likely = marked(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), "doc", regions.select("doc")).where("_marked")
    found = cut(_sets(likely.join(regions, "doc"), size))
    # a region of several blocks is cut by size first: linked sets lie in one band of sizes or in two that touch
    band = F.floor(F.log("n") / (math.log(100 / percent) * BAND_MARGIN)).cast("long")
    split = found.groupBy("region").agg(F.ceil(F.sum("n") / block_elements).alias("blocks"))
    bands = found.join(split.where("blocks > 1"), "region").groupBy("region", band.alias("band")).agg(F.ceil(F.sum("n") / block_elements).alias("shares"))
    placed = found.join(split, "region").withColumn("band", F.when(F.col("blocks") > 1, band).otherwise(0)).join(bands, ["region", "band"], "left")
    own = (F.col("band") * BAND_BLOCKS + F.pmod(F.xxhash64("doc"), F.coalesce("shares", F.lit(1)))).alias("block")
    all_blocks = placed.select("region", own).distinct()
    first = placed.where("doc = region").select("region", "doc", "elements").join(all_blocks, "region").select("region", "block", "doc", "elements")
    others = placed.where("doc <> region").select("region", own, "doc", "elements")
    # an exchange of its own: the partitioning by region that the join left would keep all blocks of a region in one task
    stars = cut(first.union(others).repartition("region", "block").groupBy("region", "block").applyInPandas(_within(percent), "region long, block long, a long, b long"))

    # sets not connected with their region's first document meet those blocks of the region that share a root with them
    several = placed.where("blocks > 1").select("region", "doc", "n", own, "elements")
    homes = cut(several.select("region", "doc", "n", "block"))
    loose = cut(homes.join(stars.where("a <> region").select("region", F.col("b").alias("doc")), ["region", "doc"], "left_semi"))
    rooted = roots.join(homes.select("region", "doc", "block"), "doc")
    told = rooted.join(loose.select("region", "doc", F.lit(True).alias("loose")), ["region", "doc"], "left")
    asking = told.where("loose").select("region", "doc", F.col("block").alias("home"), "key")
    holding = told.groupBy("region", "key", "block").agg(F.max(F.col("loose").isNull()).alias("firm"))
    touching = F.abs(F.floor(F.col("block") / BAND_BLOCKS) - F.floor(F.col("home") / BAND_BLOCKS)) <= 1
    # of two loose sets the one in the earlier block visits the other; one that is connected with the region's first makes no visits
    visits = cut(asking.join(holding, ["region", "key"]).where((F.col("block") > F.col("home")) | ((F.col("block") != F.col("home")) & F.col("firm"))).where(touching).select("region", "doc", "block").distinct())
    asks = visits.join(loose.select("region", "doc", "n"), ["region", "doc"]).groupBy("region", "block").agg(F.ceil(F.sum("n") / (TURN_BLOCKS * block_elements)).alias("asks"))
    turn = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("asks"))
    place = ["region", "block", "turn"]
    asked = cut(visits.join(asks, ["region", "block"]).join(several.select("region", "doc", "elements"), ["region", "doc"]).select("region", "block", turn.alias("turn"), "doc", "elements"))
    held = several.join(asks, ["region", "block"]).select("region", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)).alias("turn"), "doc", "elements")
    across = held.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(_across(percent), "a long, b long")

    grouped = components(stars.select("a", "b").union(across))
    return members.join(grouped, members["rep"] == grouped["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, null last, and of rows with one id the one read first.

    Every row is a document of its own here. Where ids are missing or repeated, rows get stored keys first. Only rows
    that go, and the few that a bitmap cannot tell from them, are shuffled with their texts.
    """
    unique = ids_are_keys(docs)
    rows = docs if unique else keyed(docs)
    key = "doc_id" if unique else ROW
    with scratch(docs.sparkSession):
        rest = kept(_others(rows, key, size, percent))
    likely = marked(rows, key, rest)
    stay = likely.where("_marked").join(rest, F.col(key) == F.col("_other_row"), "left_anti")
    return likely.where("not _marked").select(*docs.columns).union(stay.select(*docs.columns))


def _others(rows: DataFrame, key: str, size: int, percent: int) -> DataFrame:
    """The keys of all rows that are not the first of their component."""
    joined = join(rows.select(F.col(key).cast("long").alias("doc_id"), "text"), size, percent).where("n_shingles > 0")
    if key == "doc_id":  # a component's name is its smallest id
        return joined.where("doc_id <> component_id").select(F.col("doc_id").alias("_other_row"))
    place = rows.select(F.col(key).alias("row"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key)).alias("place"))
    named = cut(joined.join(place, F.col("doc_id") == F.col("row")).select("row", "place", "component_id"))
    first = named.groupBy("component_id").agg(F.min("place").alias("first"))
    return named.join(first, "component_id").where(F.col("place") > F.col("first")).select(F.col("row").alias("_other_row"))
