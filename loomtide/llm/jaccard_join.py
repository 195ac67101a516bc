"""N-gram Jaccard self-join with signature trees.

Texts become sets of hashed five-word shingles; equal sets are one class and one leaf. Two leaves with Jaccard 0.8 or
more share one of the first 20 % of their shingles in any common order (here: shingles that a sample found frequent
come last, the others by hash). The shingles that two or more leaves have there root signature trees over these leaves, one
for all shingles with the same smallest leaf: a leaf is a token bitmap and a size, a node the OR of its children's bitmaps
and their size range. A dual traversal of the tree with itself goes down from node pairs whose largest possible overlap
reaches what their sizes need; leaf pairs that are left are compared exactly.

Links inside a group of near copies are not all spelled out. Round one takes of every tree's possible pairs a spanning
forest that prefers those whose bitmaps are most alike. Round two takes, in trees whose leaves are in several components,
every possible pair across components, so no link between components is missed. Trees over more than TILE leaves are dealt
out: round one by tiles, round two by pairs of tiles.

A shingle has two independent 64-bit hashes. The first finds pairs, the second decides them, and a class is told by both,
so no link rests on one hash.

Null and empty texts have the empty set, link with nothing and are their own component. A row with a null id keeps its
size and has no component. Rows that repeat an id are one node. Texts are whole however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, among, mixed, range_hashes, settled, shared_dir, sorted_groups, utf8_blocks, word_ranges
from .components import components

WORDS = 5
FAN = 16
TILE = 4096
#: Documents in the sample that tells frequent shingles (they only order the shingles), and how many to flag at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 10_000, 10, 50_000


def shingles(offsets: np.ndarray, data: np.ndarray, lanes: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text of a block the hashes of its shingles in order, in one or two independent lanes."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    start, end, of = word_ranges(offsets, data)
    n = len(offsets) - 1
    words = range_hashes(data, start, end, lanes)
    factors = mixed(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)
    m = max(0, len(start) - WORDS + 1)
    rolled = []
    for word in words:
        h = np.zeros(m, np.uint64)
        for j in range(WORDS):
            h = mixed(h + word[j : j + m] * factors[j])
        rolled.append(h)
    bounds = np.searchsorted(of, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield tuple(h[a : b - WORDS + 1] for h in rolled)
        elif b > a:
            out = []
            for word in words:
                x = np.zeros(1, np.uint64)
                for j in range(a, b):
                    x = mixed(x + word[j : j + 1] * factors[j - a])
                out.append(mixed(x + np.uint64(b - a)))
            yield tuple(out)
        else:
            yield (np.empty(0, np.uint64),) * lanes


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (of the first lane) of each text of a block."""
    return (np.unique(h) for (h,) in shingles(offsets, data))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle, in a power of two of bits: four times the set's size or more, 64 at least."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap matrix, folded to ``words`` words."""
    return np.bitwise_or.reduce(b.reshape(len(b), -1, words), axis=1)


class Tree:
    """Levels of nodes from the leaves up: OR of bitmaps, smallest and largest size, largest excess of size over bits."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, group: np.ndarray) -> None:
        # leaves are sorted by size; group: a component of each leaf, -1 in a node of several
        self.levels = [(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64), group)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, over, g = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            first, last = np.minimum.reduceat(g, at), np.maximum.reduceat(g, at)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(over, at), np.where(first == last, first, -1)))


def possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, leaves: bool) -> np.ndarray:
    """Which node pairs may hold a link: sizes fit, the overlap can be large enough, and not all is one component."""
    (bx, lox, hix, ox, gx), (by, loy, hiy, oy, gy) = x, y
    ok = (5 * hix[i] >= 4 * loy[j]) & (5 * hiy[j] >= 4 * lox[i]) & ((gx[i] != gy[j]) | (gx[i] < 0))
    k = np.flatnonzero(ok)
    for part in np.array_split(k, len(k) * bx.shape[1] // (1 << 21) + 1):
        a, b = i[part], j[part]
        both = np.bitwise_count(bx[a] & by[b]).sum(1, dtype=np.int64)
        most = np.minimum(both + np.minimum(ox[a], oy[b]) if leaves else both + np.maximum(ox[a], oy[b]), np.minimum(hix[a], hiy[b]))
        ok[part] = 9 * most >= 4 * (lox[a] + loy[b])
    return ok


def traverse(x: Tree, y: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (i of x, j of y) that are left; i < j where the trees are the same."""
    top = max(len(x.levels), len(y.levels)) - 1
    at = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        keep = possible(at(x, k), at(y, k), i, j, k == 0)
        if same:
            keep &= i < j if k == 0 else i <= j
        i, j = i[keep], j[keep]
        if k == 0 or not len(i):
            break

        def down(t: Tree, node: np.ndarray, k: int = k) -> tuple[np.ndarray, np.ndarray]:
            if k >= len(t.levels):
                return node[:, None], np.ones((len(node), 1), bool)
            kids = node[:, None] * FAN + np.arange(FAN)
            return kids, kids < len(t.levels[k - 1][1])

        (a, has_a), (b, has_b) = down(x, i), down(y, j)
        both = (has_a[:, :, None] & has_b[:, None, :]).ravel()
        shape = (len(i), a.shape[1], b.shape[1])
        i = np.broadcast_to(a[:, :, None], shape).ravel()[both]
        j = np.broadcast_to(b[:, None, :], shape).ravel()[both]
    return (i, j) if len(i) else (i[:0], j[:0])


def tree_pairs(doc: np.ndarray, size: np.ndarray, bits: list[bytes], group: np.ndarray | None, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs among the leaves of one root, or a spanning forest of them that prefers those with most common bits.

    Leaves of one bitmap width are a tree; a width meets itself and the next."""
    order = np.lexsort((doc, size))
    doc, size, bits = doc[order], size[order], [bits[k] for k in order]
    group = np.arange(len(doc)) if group is None else group[order]
    width = np.array([len(b) // 8 for b in bits])
    out_a, out_b, alike = [], [], []
    trees = {}

    def told(x: Tree, y: Tree, kx: np.ndarray, ky: np.ndarray, same: bool) -> None:
        i, j = traverse(x, y, same)
        out_a.append(kx[i])
        out_b.append(ky[j])
        if spanning:
            alike.append(_likeness(x.levels[0][0], y.levels[0][0], i, j))

    for w in np.unique(width).tolist():
        k = np.flatnonzero(width == w)
        trees[w] = (k, np.frombuffer(b"".join(bits[q] for q in k), np.uint64).reshape(len(k), w))
    for w, (k, b) in trees.items():
        own = Tree(size[k], b, group[k])
        told(own, own, k, k, True)
        if 2 * w in trees:
            k2, b2 = trees[2 * w]
            told(own, Tree(size[k2], folded(b2, w), group[k2]), k, k2, False)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    if spanning and len(b):
        keep = _forest(a, b, np.concatenate(alike), len(doc))
        a, b = a[keep], b[keep]
    return doc[a], doc[b]


def _likeness(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common bits over all bits of leaf pairs."""
    out = np.empty(len(i))
    for part in np.array_split(np.arange(len(i)), len(i) * x.shape[1] // (1 << 21) + 1):
        a, b = x[i[part]], y[j[part]]
        out[part] = np.bitwise_count(a & b).sum(1, dtype=np.int64) / np.maximum(1, np.bitwise_count(a | b).sum(1, dtype=np.int64))
    return out


def _forest(a: np.ndarray, b: np.ndarray, alike: np.ndarray, n: int) -> list[int]:
    """The places of the pairs of a spanning forest that takes the likeliest pairs first."""
    top, keep = list(range(n)), []
    order = np.argsort(-alike, kind="stable")
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            top[max(x, y)] = min(x, y)
            keep.append(k)
            if len(keep) == n - 1:
                break
    return keep


def _documents(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, h1, h2, first, bits): set size, two hashes of the set, the first shingles and the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            n, h1, h2, first, bits = [], [], [], [], []
            for _, o, d in utf8_blocks(b.column("text")):
                for one, two in shingles(o, d, 2):
                    s, at = np.unique(one, return_index=True)
                    n.append(len(s))
                    h1.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(mixed(two[at]).sum(dtype=np.uint64).view(np.int64)))
                    take = len(s) // 5 + 1
                    if len(often) and len(s):
                        common = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                        rare = s[~common]
                        f = rare[:take] if len(rare) >= take else np.concatenate((rare, s[common][: take - len(rare)]))
                    else:
                        f = s[:take]
                    first.append(f.tobytes())
                    bits.append(bitmap(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(first, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "h1", "h2", "first", "bits"])

    return docs.mapInArrow(made, "doc_id long, n long, h1 long, h2 long, first binary, bits binary")


def _tokens(docs: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, o, d in utf8_blocks(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingle_sets(o, d), np.empty(0, np.uint64)]).view(np.int64))], ["token"])

    return docs.mapInArrow(made, "token long")


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of FREQUENT or more documents of a sample of about SAMPLE; sorted; at most MOST_FREQUENT."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    got = _tokens(some.select("text")).groupBy("token").count().where(F.col("count") >= FREQUENT)
    got = got.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["token"] for r in got], np.int64).view(np.uint64))


def _roots(leaves: DataFrame) -> DataFrame:
    """(root, members, doc_id): under each root the leaves that share one of their first shingles with it.

    All shingles whose smallest leaf is the same are one root, named by that leaf: a group of near copies has a root or
    a few, and not one for each of its shingles."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b.column("first").to_pylist()
            token = np.frombuffer(b"".join(first), np.int64)
            doc = np.repeat(b.column("doc_id").to_numpy(), [len(f) // 8 for f in first])
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(doc)], ["token", "doc_id"])

    # minima are taken before the shuffle, and they are settled, so that Spark can split the join of a very common shingle
    rows = leaves.select("doc_id", "first").mapInArrow(spelled, "token long, doc_id long")
    least = settled(rows.groupBy("token").agg(F.min("doc_id").alias("root"), F.max("doc_id").alias("last")).where("root < last").select("token", "root"), "tokens")
    rows = settled(rows.join(least, "token").select("root", "doc_id").distinct(), "roots")
    return rows.join(settled(rows.groupBy("root").agg(F.count("*").alias("members")), "members"), "root")


def _tree_pairs(rows: DataFrame, spanning: bool) -> DataFrame:
    """Distinct (a, b), a < b, from rows (key, doc_id, n, bits, grp, root, also).

    also: all roots of the leaf. Where all pairs are wanted, a pair is told only below the smallest root of both."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "key"):
            key, doc, size, group = (t.column(c).to_numpy() for c in ("key", "doc_id", "n", "grp"))
            bits = t.column("bits").to_pylist()
            root, also = t.column("root").to_numpy(), t.column("also").combine_chunks()
            # a key is a hash of a root and a tile: roots whose hashes meet stay apart
            at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (root[1:] != root[:-1])))).tolist()
            a, b = [], []
            for lo, hi in zip(at, [*at[1:], len(key)], strict=True):
                if hi - lo > 1:
                    x, y = tree_pairs(doc[lo:hi], size[lo:hi], bits[lo:hi], None if spanning else group[lo:hi], spanning)
                    if not spanning and len(x):
                        before = {d: {r for r in also[lo + k].as_py() if r < root[lo]} for k, d in enumerate(doc[lo:hi].tolist())}
                        new = np.array([before[p].isdisjoint(before[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)])
                        x, y = x[new], y[new]
                    a.append(x)
                    b.append(y)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = rows.repartition("key").sortWithinPartitions("key", "root")
    return rows.mapInArrow(made, "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets in the second lane."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(s).tobytes() for _, o, d in utf8_blocks(b.column("text")) for _, s in shingles(o, d, 2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], ["doc_id", "s"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    s = among(docs.select("doc_id", "text"), ids).mapInArrow(sets, "doc_id long, s binary")
    s = settled(s, "sets")
    rows = pairs.join(s.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(s.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    return rows.select("a", "b", "sa", "sb").mapInArrow(linked, "a long, b long").distinct()


def join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id (the smallest id with the same set) and component_id."""
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    with Scratch(docs.sparkSession) as tables:
        made = settled(_documents(docs, frequent_shingles(known)), "leaves")
        full = made.where("n > 0 and doc_id is not null")
        # settled, so that the join below is of two plain shuffles: Spark splits the one that a large class skews
        classes = settled(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last")).where("class_id < last").drop("last"), "groups")
        copies = full.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
        member = settled(copies, "classes")  # of documents that are not alone in their class
        leaves = among(full, member.where("doc_id <> class_id").select("doc_id"), "left_anti")
        with Scratch(docs.sparkSession) as inner:
            roots = settled(_roots(leaves), "roots")
            inner.keep(roots)
        held = leaves.select("doc_id", "n", "bits")
        tile = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.ceil(F.col("members") / TILE)))
        rows = roots.withColumn("tile", tile).join(held, "doc_id").select(F.xxhash64("root", "tile").alias("key"), "doc_id", "n", "bits", F.lit(0).cast("long").alias("grp"), "root", F.array().cast("array<long>").alias("also"))
        pairs = settled(_tree_pairs(rows, True), "pairs")
        links = settled(_verified(known, pairs), "links")
        comp = settled(components(links), "components")
        # round two: trees whose leaves are in several components
        grp = roots.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("root", "members", "doc_id", F.coalesce("component", "doc_id").alias("grp"))
        mixed_roots = settled(grp.groupBy("root").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("root"), "mixed")
        grp = settled(grp.join(mixed_roots, "root"), "roots")
        held = held.join(grp.groupBy("doc_id").agg(F.collect_list("root").alias("also")), "doc_id")  # as many as the leaf has first shingles
        rows = grp.withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("members") / TILE)).cast("int"))
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("tiles")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.join(held, "doc_id").select(F.xxhash64("root", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), "doc_id", "n", "bits", "grp", "root", "also")
        more = settled(_tree_pairs(rows, False).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = settled(_verified(known, more), "links")
        if found.limit(1).count():
            comp = settled(components(links.union(found)), "components")
        # a document's component is its own node's, or its class's where it has no node
        told = member.where("doc_id <> class_id").join(comp.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component"))
        own = comp.select(F.col("node").alias("doc_id"), F.col("node").alias("class_id"), "component")
        told = settled(told.union(own), "told")
        tables.keep(made, told)
    out = made.select("doc_id", F.col("n").alias("n_shingles")).join(told, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: the one of the smallest id; of rows that repeat that
    id the one whose text has the least SHA-256. Rows with a null id stay."""
    with Scratch(docs.sparkSession) as tables:
        gone = settled(join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "copies")
        tables.keep(gone)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = among(docs, gone, "left_anti")
    again = settled(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "again")
    if not again.take(1):
        return kept.select(*columns)
    first = Window.partitionBy("doc_id").orderBy("__told")
    told = among(kept, again).withColumn("__told", F.sha2(F.coalesce("text", F.lit("")), 256))
    told = told.withColumn("__at", F.row_number().over(first)).where("__at = 1")
    return among(kept, again, "left_anti").select(*columns).union(told.select(*columns))
