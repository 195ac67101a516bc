"""A prefix trie over conversations, built as double-array tries by prefix shard.

Conversations are put in order by turn (null first; equal turns by a hash of what they say) and rebuilt: the first h turns of
conversation c - c % 20 stand before c's own turns after its first h, h being crc32(c) % 4. A node is a distinct
sequence of first turns (role and text, null is empty), from the root without turns. Sequences are told by two 64-bit hashes
that xor what each turn and its place hash to, so a prefix's hash is a running sum that can be cut anywhere.

Nodes with more than MAX_ROWS rows below them (turns of members from that depth on) are upper nodes; the root always is. Every
child of an upper node that is none itself is the top of a prefix shard, so a shard has at most MAX_ROWS rows, whatever turn or
conversation is frequent. A task packs its shards into one double array: dense ids of the turns are the codes, the child of
node s by code c stands at BASE[s] + c, and CHECK there names s. Walks through it give every member's nodes, and sums from the
lowest level up those of the subtrees. Upper nodes are counted globally with sums before the shuffle; what the shards give
for their tops is added to the upper parents, and subtree sums go up by pointer doubling, in as many rounds as the
logarithm of the height of the upper part. The digest of an upper node's ids streams through a task in pieces, since SHA-256 can
only go through them one after another; nothing else brings a node's members together.

A null conv_id is a conversation of its own, before all others, whose decimal is empty and whose h is 0 (so is the id -2**63, which
stands for it inside). A conversation whose every turn is taken by h and whose base is absent has no turns and counts at the root.
Repeated rows are turns of their own. An empty table has no nodes. Other columns are not read; texts are whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, settled, sorted_groups

#: Rows below a node from which on it is an upper node.
MAX_ROWS = 1 << 14
#: Turns of a conversation whose hashes are summed in one window.
CHUNK = 1 << 12
#: Stands for a null conv_id.
NO_ID = -(1 << 63)
#: Conversations that share a base, turns taken from it at most.
FAMILY, TAKEN = 20, 3
_EMPTY = hashlib.sha256(b"").hexdigest()


def _decimal(conv: Column) -> Column:
    return F.when(conv == NO_ID, "").otherwise(conv.cast("string"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with part and r, the place within (conv, part). Parts are ranges of (conv, turn), so a long conversation spans
    many of them."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column("conv").to_numpy()
            if len(conv):
                first = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
                r = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
                if last == conv[0]:
                    r[: first[1] if len(first) > 1 else None] += seen
                last, seen = conv[-1], r[-1] + 1
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "a", "b", "words")), pa.array(np.full(len(r), part, np.int32)), pa.array(r)], ["conv", "a", "b", "words", "part", "r"])

    ranged = rows.repartitionByRange("conv", "turn", "a", "b").sortWithinPartitions("conv", "turn", "a", "b")
    return ranged.mapInArrow(places, "conv long, a long, b long, words long, part int, r long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): the rebuilt conversations as rows (conv, d, a, b, words), depth from 1, with the two hashes of role and
    text; and all ids as rows (conv). The texts are not shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = settled(_numbered(rows), "numbered")
    per = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    parts = settled(per.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before")), "parts")
    convs = settled(parts.select("conv").distinct(), "convs")
    ranked = lambda some: some.join(parts, ["conv", "part"]).withColumn("rank", F.col("before") + F.col("r")).drop("before", "r")
    heads = ranked(rows.where((F.col("conv") % FAMILY == 0) & (F.col("conv") != NO_ID) & (F.col("r") < TAKEN))).where(F.col("rank") < TAKEN)
    heads = settled(heads.select(F.col("conv").alias("base"), "rank", "a", "b", "words"), "heads")
    h = F.when(F.col("conv") == NO_ID, F.lit(0)).otherwise(F.crc32(F.col("conv").cast("string")) % (TAKEN + 1))
    taking = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base")).where("h > 0")
    grafts = taking.join(heads, "base").where("rank < h").select("conv", (F.col("rank") + 1).alias("d"), "a", "b", "words")
    got = taking.join(heads.groupBy("base").agg(F.count("*").alias("has")), "base", "left")
    got = got.select("conv", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    # by (conv, part), which no long conversation makes large
    parts = settled(parts.join(got, "conv", "left").fillna(0, ["h", "taken"]), "parts")
    own = ranked(rows).where("rank >= h").select("conv", (F.col("rank") - F.col("h") + F.col("taken") + 1).alias("d"), "a", "b", "words")
    return settled(own.unionByName(grafts), "turns"), convs


def _paths(turns: DataFrame) -> DataFrame:
    """``turns`` with the hashes of the prefix up to each (pa, pb) and before it (qa, qb), and rest, the turns from it on."""
    each = turns.withColumns({"chunk": F.expr(f"(d - 1) div {CHUNK}"), "xa": F.xxhash64("d", "a"), "xb": F.xxhash64("b", "d")})
    sums = each.groupBy("conv", "chunk").agg(F.bit_xor("xa").alias("ca"), F.bit_xor("xb").alias("cb"), F.count("*").alias("n"))
    before, all_of = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv")
    sums = sums.select("conv", "chunk", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("ca", "cb")], F.sum("n").over(all_of).alias("length"))
    so_far = Window.partitionBy("conv", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"wa": F.bit_xor("xa").over(so_far), "wb": F.bit_xor("xb").over(so_far)}).join(sums, ["conv", "chunk"])
    pa_, pb_ = F.col("wa").bitwiseXOR(F.col("ca")), F.col("wb").bitwiseXOR(F.col("cb"))
    return each.select("conv", "d", "a", "b", "words", pa_.alias("pa"), pb_.alias("pb"), pa_.bitwiseXOR(F.col("xa")).alias("qa"), pb_.bitwiseXOR(F.col("xb")).alias("qb"), (F.col("length") - F.col("d") + 1).alias("rest"))


class DoubleArray:
    """A trie as two arrays: the child of node s by code c (1 or more) is BASE[s] + c, where CHECK is s. The root is 0."""

    def __init__(self) -> None:
        self.base, self.check, self.free, self.taken = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1, 1
        self.check[0] = 0

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.concatenate((self.base, np.zeros(more, np.int64))), np.concatenate((self.check, np.full(more, -1, np.int64)))

    def _skip_taken(self) -> None:
        while self.free < len(self.check) and self.check[self.free] >= 0:
            run = self.check[self.free : self.free + 4096] >= 0
            self.free += len(run) if run.all() else int(run.argmin())

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Adds children by distinct pairs (parent, code), sorted; a parent gets all its children in one call."""
        if not len(parents):
            return
        first = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        size = np.diff(np.append(first, len(parents)))
        for k in np.flatnonzero(size > 1).tolist():
            self._place(int(parents[first[k]]), codes[first[k] : first[k] + size[k]])
        one = first[size == 1]  # a single child fits any free place
        self._skip_taken()
        self._room(self.taken + len(one))
        look = 2 * len(one)
        while len(at := np.flatnonzero(self.check[self.free : self.free + look] < 0)) < len(one):
            look *= 2
        at = self.free + at[: len(one)]
        self.base[parents[one]], self.check[at] = at - codes[one], parents[one]
        self.taken += len(one)

    def _place(self, parent: int, codes: np.ndarray) -> None:
        """Puts all children of a node at the first places tried where each falls on a free one."""
        self._skip_taken()
        span = codes - codes[0]
        look = self.free
        while True:
            self._room(look + 512 + int(span[-1]) + 1)
            tried = look + np.flatnonzero(self.check[look : look + 512] < 0)[:64]
            fits = (self.check[tried[:, None] + span] < 0).all(1)
            if fits.any():
                at = int(tried[fits.argmax()])
                self.base[parent], self.check[at + span] = at - int(codes[0]), parent
                self.taken += len(span)
                return
            look += 512

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` by ``codes``; -1 where there is none."""
        at = self.base[nodes] + codes
        good = (at > 0) & (at < len(self.check))
        good[good] = self.check[at[good]] == nodes[good]
        return np.where(good, at, -1)


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Rows of equal columns get equal numbers, from 1 without gaps."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = 1 + np.cumsum(new)
    return out


def walk(shard: np.ndarray, conv: np.ndarray, turn: np.ndarray) -> tuple[DoubleArray, np.ndarray, list[np.ndarray]]:
    """The double array of whole shards, the node of each row, and the nodes by level. Rows are sorted by conversation and depth
    inside each shard; ``shard`` and ``turn`` are dense codes from 1. The first code of a conversation is its shard's."""
    first = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (conv[1:] != conv[:-1])))) if len(conv) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(conv)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    code = turn.copy()
    code[first] = shard[first]
    trie, node, levels = DoubleArray(), np.empty(len(conv), np.int64), []
    state = np.zeros(len(first), np.int64)
    for level in range(int(size[0]) if len(size) else 0):
        on = int(np.searchsorted(-size, -level, "left"))  # conversations with more than ``level`` turns
        at, state = first[:on] + level, state[:on]
        pairs = np.unique(np.stack((state, code[at]), 1), axis=0) if on > 1 else np.stack((state, code[at]), 1)
        trie.add(pairs[:, 0], pairs[:, 1])
        state = trie.step(state, code[at])
        node[at] = state
        levels.append(np.unique(state))
    return trie, node, levels


_NODE = "depth long, owner long, parent long, qa long, qb long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of whole shards; the tops of shards have qa and qb, the hashes of their upper parents, and no parent."""
    names = [x.split()[0] for x in _NODE.split(", ")]
    for t in sorted_groups(batches, "sa"):
        c = {k: t.column(k).to_numpy() for k in t.column_names}
        conv, d = c["conv"], c["d"]
        shard = _dense(c["sa"], c["sb"])
        trie, node, levels = walk(shard, conv, _dense(c["a"], c["b"]))
        size = len(trie.check)
        n = np.bincount(node, minlength=size)
        owner, depth, words = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.minimum.at(owner, node, conv)
        depth[node], words[node] = d, c["words"]
        nodes = np.concatenate(levels)
        children = np.bincount(trie.check[nodes], minlength=size)
        leaves, saved = (children == 0).astype(np.int64), (n - 1) * words
        for level in reversed(levels[1:]):
            np.add.at(leaves, trie.check[level], leaves[level])
            np.add.at(saved, trie.check[level], saved[level])
        last = np.flatnonzero(np.append((shard[1:] != shard[:-1]) | (conv[1:] != conv[:-1]), True))
        last = last[np.lexsort((conv[last], node[last]))]
        cut = np.flatnonzero(np.concatenate(([True], node[last[1:]] != node[last[:-1]], [True])))
        ends = dict.fromkeys(nodes.tolist(), _EMPTY)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            ends[int(node[last[i]])] = hashlib.sha256(_joined(conv[last[i:j]]).encode()).hexdigest()
        top = trie.check[nodes] == 0
        from_upper = np.zeros((2, size), np.int64)
        from_upper[:, node] = c["qa"], c["qb"]
        columns = [
            depth[nodes], owner[nodes], pa.array(owner[trie.check[nodes]], mask=top), *(pa.array(q[nodes], mask=~top) for q in from_upper),
            n[nodes], children[nodes], leaves[nodes], saved[nodes], [ends[k] for k in nodes.tolist()],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _joined(conv: np.ndarray) -> str:
    return ",".join("" if x == NO_ID else str(x) for x in conv.tolist())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node in rows sorted by node and id, joined."""
    for b in batches:
        key = np.stack([b.column(k).to_numpy() for k in ("d", "pa", "pb")], 1)
        conv = b.column("conv").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True]))) if len(conv) else np.zeros(1, np.int64)
        first = cut[:-1]
        texts = [_joined(conv[i:j]) for i, j in zip(first.tolist(), cut[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(key[first, k]) for k in range(3)), pa.array(conv[first]), pa.array(texts, pa.string())], ["d", "pa", "pb", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from pieces sorted by node and first id; only the digest's state is held."""
    names, now, told = ["d", "pa", "pb", "ends_sha256"], None, None
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*now, told.hexdigest()), strict=True))], pa.schema([*((x, pa.int64()) for x in names[:3]), ("ends_sha256", pa.string())]))
    for b in batches:
        for *key, ids in zip(*(b.column(k).to_pylist() for k in ("d", "pa", "pb", "ids")), strict=True):
            if now == key:
                told.update(b"," + ids.encode())
                continue
            if now is not None:
                yield row()
            now, told = key, hashlib.sha256(ids.encode())
    if now is not None:
        yield row()


def _upper_sums(upper: DataFrame) -> DataFrame:
    """``upper`` (d, pa, pb, qa, qb, ..., n_leaves, saved_tokens) with the sums over all upper nodes below each, by pointer doubling."""
    key, to = ["d", "pa", "pb"], ["td", "ta", "tb"]
    sums = settled(upper.select(*key, F.when(F.col("d") > 0, F.col("d") - 1).alias("td"), F.col("qa").alias("ta"), F.col("qb").alias("tb"), "n_leaves", "saved_tokens"), "sums")
    while sums.where("td IS NOT NULL").limit(1).count():
        given = sums.where("td IS NOT NULL").groupBy(*to).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).toDF(*key, "l", "s")
        on = sums.select(*key, *[F.col(t).alias(f"{t}2") for t in to]).toDF(*to, "td2", "ta2", "tb2")
        sums = sums.join(given, key, "left").join(on, to, "left").select(*key, F.col("td2").alias("td"), F.col("ta2").alias("ta"), F.col("tb2").alias("tb"), *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_leaves", "l"), ("saved_tokens", "s"))])
        sums = settled(sums, "sums")
    return upper.drop("n_leaves", "saved_tokens").join(sums.drop(*to), key)


def nodes(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key = ["d", "pa", "pb"]
    with Scratch(conversations.sparkSession) as tables:
        turns, convs = rebuilt(conversations)
        paths = settled(_paths(turns), "paths")
        below = paths.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv").alias("owner"), F.min("words").alias("words"), F.min("qa").alias("qa"), F.min("qb").alias("qb"), F.sum("rest").alias("below"))
        zero = F.lit(0).cast("long")
        root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("owner")).where("n_convs > 0").select(zero.alias("d"), zero.alias("pa"), zero.alias("pb"), "n_convs", "owner", zero.alias("words"), F.lit(None).cast("long").alias("qa"), F.lit(None).cast("long").alias("qb"))
        upper = settled(below.where(F.col("below") > MAX_ROWS).drop("below").unionByName(root), "upper")

        light = paths.join(upper, key, "left_anti")
        tops = light.groupBy("conv").agg(F.min_by(F.struct("pa", "pb"), "d").alias("s")).select("conv", F.col("s.pa").alias("sa"), F.col("s.pb").alias("sb"))
        # at most MAX_ROWS rows of a conversation are left here, and as many of a shard
        dealt = light.join(tops, "conv").select("sa", "sb", "conv", "d", "a", "b", "words", "qa", "qb").repartition("sa").sortWithinPartitions("sa", "sb", "conv", "d")
        lower = settled(dealt.mapInArrow(_shard_nodes, _NODE), "lower")

        parent = [(F.col("d") - 1).alias("d"), F.col("qa").alias("pa"), F.col("qb").alias("pb")]
        shard_tops = lower.where("qa IS NOT NULL").withColumnRenamed("depth", "d")
        given = shard_tops.select(*parent, "n_leaves", "saved_tokens").unionByName(upper.where("d > 0").select(*parent, zero.alias("n_leaves"), zero.alias("saved_tokens")))
        given = given.groupBy(*key).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        summed = upper.join(given, key, "left").fillna(0, ["n_children", "l", "s"])
        summed = summed.withColumns({"n_leaves": F.col("l") + (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words") + F.col("s")})
        summed = _upper_sums(settled(summed.drop("l", "s", "words"), "summed"))

        ended = paths.where("rest = 1").join(upper, key, "left_semi").select(*key, "conv")
        silent = convs.join(paths.where("d = 1").select("conv"), "conv", "left_anti").select(zero.alias("d"), zero.alias("pa"), zero.alias("pb"), "conv")
        pieces = ended.unionByName(silent).repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_pieces, "d long, pa long, pb long, first long, ids string")
        digests = pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digested, "d long, pa long, pb long, ends_sha256 string")

        owners = upper.select(F.col("d").alias("pd"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("owner").alias("parent"))
        named = lambda some: some.join(owners, (some["d"] - 1 == owners["pd"]) & (some["qa"] == owners["qa"]) & (some["qb"] == owners["qb"]), "left").drop(owners["qa"], owners["qb"])
        shown = ["owner", "d", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        parts = [
            lower.where("qa IS NULL").withColumnRenamed("depth", "d").select(*shown),
            named(shard_tops.drop("parent")).select(*shown),
            named(summed.join(digests, key, "left")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).select(*shown),
        ]
        out = parts[0].unionAll(parts[1]).unionAll(parts[2])
        told = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        out = settled(out.select(told("owner").alias("conv_id"), F.col("d").alias("depth"), told("parent").alias("parent_conv_id"), *shown[3:]), "nodes")
        tables.keep(out)
    return out
