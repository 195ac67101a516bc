"""Ranked lexical search with impact lists and the best position algorithm.

Terms are runs of letters, digits and all characters beyond ASCII, A to Z in lower case. One pass over the documents keeps
for each its number of terms and how often it holds each term that any item asks for; that table is settled. Sums over it
give the counts of the whole corpus. A second pass reads it in shards of whole documents: a shard sorts the impacts of each
term into a list, highest first, and each item runs the best position algorithm over its lists. A document found by sorted
access in one list is looked up directly in all others, which marks its positions there as seen. The best position of a list is
the last one of the run of seen positions from its top, and no unseen document can exceed the sum of the impacts at the best
positions. An item stops when that sum is strictly below its k-th score, so equal scores are told by their ids exactly. The k
best of each task are merged in two steps, so what is shuffled doesn't grow with a term's frequency.

Nothing is broadcast but the items' terms: at most MAX_TERMS at a time, more items than that take turns. A task holds a
shard of about SHARD postings. Null and empty texts have no term: they count nowhere and are never found. Rows that
repeat are documents of their own; a null doc_id is found like others and comes after equal scores with an id. Items without
a term that any document holds have no rows; items that repeat each have theirs. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWERED, Scratch, Vocabulary, lowered, settled, utf8_blocks, word_ranges

#: A term; nothing else parts terms but the other ASCII characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Terms of items that one pass over the documents looks for.
MAX_TERMS = 200_000
#: Postings of a shard.
SHARD = 1 << 21
#: Sorted accesses to each list at first; every round doubles them up to the last number.
FIRST_STEP, LAST_STEP = 16, 4096


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per document with a term: doc_id, n (its terms with repeats), terms (numbers of those asked for, rising) and tfs."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for b in batches:
            for first, offsets, data in utf8_blocks(b.column("text")):
                data = LOWERED[data]
                start, end, of = word_ranges(offsets, data, _BETWEEN)
                texts = len(offsets) - 1
                n = np.bincount(of, minlength=texts)
                number = told.numbers(data, start, end)
                known = number >= 0
                key, tf = np.unique(of[known] * np.int64(max(told.size, 1)) + number[known], return_counts=True)
                text, term = np.divmod(key, max(told.size, 1))
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=texts)))).astype(np.int32)
                whole = [pa.ListArray.from_arrays(ends, x.astype(np.int32)) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, texts), pa.array(n.astype(np.int64)), *whole], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "doc_id long, n long, terms array<int>, tfs array<int>")


class ImpactLists:
    """The impact lists of a shard: for each term its documents by falling impact, and direct access by (document, term).

    ``ids`` must be sorted; documents are then told by their places, and equal impacts stand in the order of ids."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, all_docs: int, all_terms: int) -> None:
        self.width = len(weights)
        m = 10 + (90 * n * all_docs) // all_terms
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        order = np.lexsort((doc, -impact, terms))
        self.doc, self.impact = doc[order], impact[order]
        self.size = np.bincount(terms, minlength=self.width)
        self.start = np.cumsum(self.size) - self.size
        #: direct access: keys rise, since documents rise and so do the terms of each; a last key ends all searches
        self.key = np.append(doc * self.width + terms, np.iinfo(np.int64).max)
        self.position = np.empty(len(order) + 1, np.int64)
        self.position[order] = np.arange(len(order))
        self.seen, self.done = np.zeros(len(order), bool), np.zeros(len(n), bool)
        self.sorted_accesses = self.direct_accesses = 0

    def best(self, terms: np.ndarray, k: int, least: int = -1) -> list[tuple[int, int]]:
        """The (score, document) of ``terms`` with the highest scores over 0, ties by place. ``least`` is a score that k
        documents of other shards reach: documents below it may be left out."""
        terms = terms[self.size[terms] > 0]
        start, size = self.start[terms], self.size[terms]
        reached, depth, step = np.zeros(len(terms), np.int64), 0, FIRST_STEP
        top: list[tuple[int, int]] = []
        touched, found = [], []
        while len(terms):
            at = depth + np.arange(step)
            at = (start[:, None] + at)[at < size[:, None]]
            self.sorted_accesses += len(at)
            docs = np.unique(self.doc[at])
            docs = docs[~self.done[docs]]
            depth, step = depth + step, min(2 * step, LAST_STEP)
            if len(docs):
                self.done[docs] = True
                found.append(docs)
                key = docs[:, None] * self.width + terms
                place = np.searchsorted(self.key, key)
                hit = self.key[place] == key
                self.direct_accesses += key.size
                position = self.position[place]
                score = np.where(hit, self.impact[np.where(hit, position, 0)], 0).sum(1)
                touched.append(position[hit])
                self.seen[touched[-1]] = True
                first = np.lexsort((docs, -score))[:k]
                top += [(s, d) for s, d in zip(score[first].tolist(), docs[first].tolist(), strict=True) if s > 0]
                top = sorted(top, key=lambda x: (-x[0], x[1]))[:k]
            bound = 0
            for i in range(len(terms)):
                run = self.seen[start[i] + reached[i] : start[i] + size[i]]
                gap = int(run.argmin()) if len(run) else 0
                reached[i] = size[i] if len(run) == 0 or run[gap] else reached[i] + gap
                if reached[i] < size[i]:
                    bound += int(self.impact[start[i] + reached[i] - 1])
            if bound == 0 or max(top[-1][0] if len(top) == k else -1, least) > bound:
                break
        for x in touched:
            self.seen[x] = False
        for x in found:
            self.done[x] = False
        return top


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, postings = [], 0
    for b in batches:
        held.append(b)
        postings += len(b.column("terms").flatten())
        if postings >= SHARD:
            yield pa.Table.from_batches(held)
            held, postings = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _searched(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, item_id, doc_id, score) of the k best documents of each item, from one settled pass."""
    terms = sorted({t for _, ts in items for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    table = settled(counted(docs, terms), "counted")
    all_docs, all_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row a term asked for
        df[r["t"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked = [(i, None if d is None else int(d), np.array([number[t] for t in ts], np.int64)) for i, (d, ts) in enumerate(items)]
    shared = docs.sparkSession.sparkContext.broadcast((asked, weights, all_docs, all_terms))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, all_docs, all_terms = shared.value
        kept: dict[int, list] = {}
        for t in _shards(batches):
            t = t.sort_by("doc_id").combine_chunks()  # nulls last
            ids = t.column("doc_id").to_pylist()
            lists = t.column("terms").combine_chunks()
            sizes = np.asarray(pc.list_value_length(lists))
            flat = [np.asarray(t.column(c).combine_chunks().flatten()).astype(np.int64) for c in ("terms", "tfs")]
            shard = ImpactLists(np.asarray(t.column("n")), np.concatenate(([0], np.cumsum(sizes))), *flat, weights, all_docs, all_terms)
            for i, _, ts in asked:
                old = kept.get(i, [])
                new = shard.best(ts, k, -old[-1][0] if len(old) == k else -1)
                if new:
                    kept[i] = sorted([*old, *((-s, ids[d] is None, ids[d] or 0) for s, d in new)])[:k]
        out = [(i, asked[i][1], None if none else d, -s) for i, best in kept.items() for s, none, d in best]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["item", "item_id", "doc_id", "score"])

    return table.mapInArrow(rows, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` documents with the highest scores over 0 of each item."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0))).alias("terms"))
    turns = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 1) // MAX_TERMS)
    turns = 2 * turns if turns > 1 else 1
    out, tables = None, []
    with Scratch(docs.sparkSession) as scratch:
        for turn in range(turns):
            mine = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(turns)) == turn).orderBy("item_id", "terms").collect()
            best = _searched(docs, [(r["item_id"], r["terms"]) for r in mine], k).withColumn("item", F.concat_ws("-", F.lit(turn), "item"))
            # k of each task are left; those of a stretch of tasks first, so that no task gets all
            order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
            best = best.withColumn("part", F.spark_partition_id() % 64)
            for keys in (("item", "part"), ("item",)):
                best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
            tables.append(settled(best.select("item_id", "rank", "doc_id", "score"), "found"))
            out = tables[-1] if out is None else out.unionAll(tables[-1])
        scratch.keep(*tables)
    return out
