"""The Jaccard join and passage removal against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.llm import jaccard_join, suffix_dedup
from loomtide.llm.common import range_hashes, window_hashes
from loomtide.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    want = brute(rows)
    got = jaccard_join.join(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_join_on_edge_rows(odd):
    check(odd)


def test_join_without_broadcasts_and_with_tiles(spark, monkeypatch):
    from loomtide.llm import common

    monkeypatch.setattr(common, "MAX_IDS", 0)
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            w[k] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_join_chains_and_sizes(spark):
    words = [f"v{k}" for k in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60 + i])) for i in range(40)] + [(100 + n, " ".join(words[:n])) for n in range(1, 30)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_keep_one(odd, empty):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    want = brute([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if r["doc_id"] is not None])
    got = sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").collect())  # once each
    assert got == sorted(d for d, (_, c) in want.items() if d == c)
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.keep_one(empty).columns == empty.columns


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Made

    from loomtide.llm.common import shared_dir

    made = lambda master, folder, seen: Made(sparkContext=Made(master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append), conf=Made(get=lambda k, d: folder))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(made("spark://host:7077", None, []))
    assert shared_dir(made("spark://host:7077", "hdfs://there", [])) == "hdfs://there" and "spark-" in shared_dir(made("local[4]", None, []))


def test_scratch_tables_go(spark):
    import os

    from loomtide.llm.common import Scratch, settled, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    there = lambda t: os.path.exists(t.settled_path.removeprefix("file:"))
    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            a, b = settled(spark.range(3), "a"), settled(spark.range(4), "b")
            inner.keep(b)
        c = settled(spark.range(5), "c")
        assert not there(a) and there(b) and there(c)
        outer.keep(c)
    assert not there(b) and there(c) and c.count() == 5 and os.path.isdir(folder)
    with pytest.raises(ValueError), Scratch(spark):
        d = settled(spark.range(2), "d")
        raise ValueError
    assert there(d)


def test_components_of_a_path(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(200, 100), (100, 300)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components(path).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}


def test_components_that_run_out_of_rounds(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError, match="not complete"):
        components(path, most_rounds=1)


def test_words_that_differ_link_with_nothing(spark):
    """Words whose differences cancel in sums of powers modulo a power of two: a Thue-Morse word and its complement."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    rows = []
    for n in (8, 64, 512, 1024, 2048, 4096):
        rows += [(n, "".join("ab"[b] for b in bits[:n])), (n + 1, "".join("ba"[b] for b in bits[:n]))]
    rows += [(9000, "x " + rows[-1][1] + " y z end"), (9001, "x " + rows[-2][1] + " y z end")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    check_passages(spark.createDataFrame([(i, "start " + t + " stop") for i, t in rows], "doc_id long, text string"))


def test_hashes_of_ranges():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    start = rng.integers(0, 5000, 3000)
    end = start + np.concatenate((rng.integers(0, 40, 2900), rng.integers(900, 1000, 100)))
    a, b = range_hashes(data, start, end, 2)
    text = [data[x:y].tobytes() for x, y in zip(start, end, strict=True)]
    for h in (a, b):
        assert len(set(h.tolist())) == len(set(text)) == len(set(zip(text, h.tolist(), strict=True)))
    assert (range_hashes(data, start, end)[0] == a).all() and not (a == b).any()
    again = np.concatenate((data[1:], data[:1]))
    assert (range_hashes(again, start - 1, end - 1, 2)[1][start > 0] == b[start > 0]).all()
    for n in (8, 11, 24, 200):
        w = [data[k : k + n].tobytes() for k in range(len(data) - n + 1)]
        h = window_hashes(data, n).tolist()
        assert len(set(h)) == len(set(w)) == len(set(zip(w, h, strict=True)))


def removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for k in range(len(b) - 199):
            h = b[k : k + 200]
            seen[h] = seen.get(h, 0) + 1
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                m[k : k + 200] = True
        runs = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check_passages(docs):
    texts = [r["text"] for r in docs.select("text").collect()]
    got = sorted(tuple(r)[1:] for r in suffix_dedup.digests(docs).collect())
    assert got == sorted(removed(texts))


def test_passages_on_edge_rows(spark, odd):
    check_passages(odd)


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_passages_at_the_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "MAX_IDS", limit)
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    p199, p200, p350 = letters(199), letters(200), letters(350)
    texts = [letters(300) + p199 + letters(90), p199 + "Q" + letters(300), letters(40) + p200 + letters(7), "Z" + p200 + "Y", p350 + letters(100), letters(500) + p350[:260] + "!" + letters(9), p350[100:] + "?", "ab" * 400, letters(10) + "ab" * 150, p200, p200, "é" * 150, "xé" + "é" * 120]
    check_passages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4))


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_hot_names_are_counted(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "MAX_IDS", limit)
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    p, q = letters(420), letters(230)
    texts = [letters(150) + p + letters(150) for _ in range(40)] + [letters(40) + q + letters(90) for _ in range(12)] + [letters(60) + p[k : k + 260] + letters(60) for k in range(0, 160, 8)]
    texts += ["ab" * 300 + p[:210], letters(30) + p + p + letters(9), texts[0], texts[1][60:], letters(600), "é" * 150, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    check_passages(docs)
    # what is dealt by name alone has no hot name, and the starts of the hottest lie in several tasks
    base, _ = suffix_dedup._keyed(docs)
    suffixes = suffix_dedup._suffixes(base)
    hot = suffix_dedup._hot_names(suffixes)
    assert suffixes.where("off >= 0").join(hot, "name", "left_anti").groupBy("name").count().where("count > 8").count() == 0 < hot.count()
    _, checks = suffix_dedup._counted(suffixes.join(hot, "name", "left_semi"))
    spelled = suffix_dedup._spelled(suffix_dedup._fetched(base, checks))
    top = spelled.groupBy("name").count().orderBy(F.desc("count")).first()["name"]
    dealt = spelled.where(F.col("name") == top).repartition(4, "name", "o", "h", "h2").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 0.6 * sum(r["count"] for r in dealt)


def test_remove_keeps_columns(odd, empty):
    out = suffix_dedup.remove(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    for r in out.select("text", "n_chars").collect():
        assert r["n_chars"] is None or r["n_chars"] == len(r["text"] or "") or r["text"] is None
    assert suffix_dedup.digests(empty).count() == 0 and suffix_dedup.remove(empty).count() == 0
