"""Fingerprints, mixing and quality rules against plain Python."""

import collections
import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from loomtide.llm import fingerprints as fp
from loomtide.llm import mixing, quality_rules
from loomtide.llm.common import settled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    t = text or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def plain_verdict(rules, text):
    """The learned list, evaluated in plain Python."""
    t = text or ""
    w, s = WORD.findall(t), stats(text)
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    ratio = lambda a, b: a / b if b else 0.0
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    x = {"n_words": s[0], "r_symbols": ratio(s[2], s[0]), "r_repeat": ratio(s[4], s[0]), "r_dup_lines": ratio(s[3], lines), "r_distinct": ratio(len(set(w)), s[0]), "r_length": ratio(s[1], s[0]), "r_upper": ratio(upper, s[1]), "r_stops": ratio(sum(c in "!?" for c in t), s[0])}
    for rule in rules.rules:
        if all(x[n] <= b if op == "<=" else x[n] > b for n, op, b in rule.tests):
            return rule.keep
    return rules.default_keep


def test_the_emitted_list_is_the_learned_one(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, known)
    assert rules.rules
    got = quality_rules.judge(docs, rules).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert [r["kept"] for r in got] == [not r["base_failed"] and plain_verdict(rules, r["text"]) for r in got]
    assert 0 < sum(not plain_verdict(rules, r["text"]) for r in got if not r["base_failed"])


def test_rules_statistics_and_verdict(odd, labels):
    rules = quality_rules.fit(odd, labels)
    got = quality_rules.judge(odd, rules).join(odd.select("doc_id", "text"), "doc_id").collect()
    assert got
    for r in got:
        n = stats(r["text"])
        assert tuple(r[k] for k in quality_rules.BASE) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"] and plain_verdict(rules, r["text"]))
    assert quality_rules.judge(odd, rules).count() == odd.count()


def test_rules_filter_keeps_columns(odd, labels):
    rules = quality_rules.fit(odd, labels)
    kept = quality_rules.keep_good(odd, rules)
    assert kept.columns == odd.columns
    assert kept.count() == quality_rules.judge(odd, rules).where("kept").count()


def test_rules_learn_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 1] <= 0.7) | (x[:, 2] <= 0.4)).astype(int)
    rules = quality_rules.learn(x, y, ("a", "b", "c"))
    out = np.ones(600, int)
    left = np.ones(600, bool)
    for r in rules.rules:
        m = quality_rules._holds(x, [("abc".index(n), o, b) for n, o, b in r.tests]) & left
        out[m], left = int(r.keep), left & ~m
    assert (out == y).mean() > 0.95 and rules.text().endswith("keep")
    assert quality_rules.learn(x, np.ones(600)).rules == []


def test_empty_tables(empty, no_labels):
    rules = quality_rules.fit(empty, no_labels)
    assert quality_rules.judge(empty, rules).count() == 0 and quality_rules.keep_good(empty, rules).columns == empty.columns
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).columns == empty.columns and mixing.mix(empty).count() == 0
    assert fp.fingerprints_with_edits(empty).count() == 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, rest = set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= set(over)
        rest -= sum(3 * sizes[s] for s in over)


def test_mixing_targets_and_copies(odd):
    got = mixing.mix_counts(odd).collect()
    texts = [(r["source"], len(WORD.findall(r["text"] or ""))) for r in odd.select("source", "text").collect()]
    sizes = collections.Counter()
    for s, n in texts:
        sizes[s] += n
    want = targets(sizes)
    assert len(got) == odd.count()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["taken"] <= 3 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(odd.repartition(7)).collect()))
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["copies"] for r in got)


def test_mixing_without_a_broadcast(odd, monkeypatch):
    want = sorted(map(str, mixing.mix_counts(odd).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 1)
    assert sorted(map(str, mixing.mix_counts(odd).collect())) == want


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    for r in mixing.mix_counts(rows).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r["n"] - r["t"]) < 0.01 * r["t"]


def test_fingerprints_of_edits(edge):
    got = {r["doc_id"]: r for r in fp.fingerprints_with_edits(edge).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in edge.select("doc_id", "text").collect()), reverse=True)
    by_text = {}
    for i, (d, t) in enumerate(rows):
        k = len(t) // 3
        edited = t[: len(t) - k] + rows[(i + 1) % len(rows)][1][:k]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        by_text.setdefault("\n".join(sorted(t.split("\n"))), set()).add(got[d]["fingerprint"])
    # a fingerprint is the multiset of paragraphs: their order does not matter, anything else does
    assert all(len(v) == 1 for v in by_text.values())
    assert len(set.union(*by_text.values())) == len(by_text)
    long = [d for d, t in rows if len(t.split()) > 100]
    assert np.median([got[d]["near_edited"] for d in long]) > 0.5


def plain_sketch(text):
    """The 126 centred sums, and the equality lanes, by plain arithmetic; hashes of pieces come from Spark's function."""
    lines = (text or "").split("\n")
    exact = [sum(int(hashlib.sha512(x.encode()).hexdigest()[j * 8 : j * 8 + 8], 16) for x in lines) % 2**32 for j in range(16)]
    return exact, [m[0] for x in lines for m in re.finditer(fp.PIECE, x)]


def test_likeness_equals_plain_arithmetic(spark, edge):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in edge.select("doc_id", "text").collect()), reverse=True)
    rows = [(d, t) for d, t in rows if len(t) < 20_000]
    got = {r["doc_id"]: r for r in fp.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = {}
    for i, (d, t) in enumerate(rows):
        k = len(t) // 3
        texts[d, 0], texts[d, 1], texts[d, 2] = t, t[: len(t) - k] + rows[(i + 1) % len(rows)][1][:k], rows[(i + 1) % len(rows)][1]
    pieces = sorted({p for t in texts.values() for p in plain_sketch(t)[1]})
    hashed = spark.createDataFrame([(p,) for p in pieces], "p string").select("p", F.xxhash64("p").alias("h0"), F.xxhash64("p", F.lit(1)).alias("h1")).collect()
    bits = {r["p"]: np.array([(h >> (k + 21 * j)) & 1 for j in range(3) for h in (r["h0"] % 2**64, r["h1"] % 2**64) for k in range(21)]) for r in hashed}
    sums = {}
    for key, t in texts.items():
        exact, p = plain_sketch(t)
        sums[key] = exact, (2 * sum((bits[x] for x in p), np.zeros(126)) - len(p))
    for d, _ in rows:
        (e0, a), (e1, b), (e2, c) = (sums[d, v] for v in range(3))
        assert got[d]["fingerprint"].split(".")[0] == "".join(f"{x:08x}" for x in e0)
        for name, e, x in (("near_edited", e1, b), ("near_next", e2, c)):
            size = np.sqrt((a @ a) * (x @ x))
            want = 1.0 if e == e0 else min(1.0, max(0.0, a @ x / size)) if size else 0.0
            assert abs(got[d][name] - want) < 1e-9


def test_fingerprints_with_null_and_repeated_ids(spark, odd):
    got = fp.fingerprints_with_edits(odd).collect()
    assert len(got) == odd.count() and sum(r["doc_id"] is None for r in got) == 1
    rows = [(5, "e f g h i j"), (5, "e f g h i j"), (5, "e f g h i j"), (5, "zz"), (9, "nine nine nine"), (None, "none a"), (None, "none a"), (None, None), (2, "")]
    got = fp.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    ring = [(9, "nine nine nine"), (5, "zz"), *rows[:3], (2, ""), (None, ""), (None, "none a"), (None, "none a")]
    want = []
    for i, (d, t) in enumerate(ring):
        k = len(t) // 3
        after = ring[(i + 1) % len(ring)][1]
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest(), t == after))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_next"] == 1.0) for r in got) == sorted(want)


def test_fingerprints_add_and_remove(spark):
    df = spark.createDataFrame([(1, "x y z\nq r"), (2, "x y z"), (3, "q r")], "id int, text string")
    s = fp.sketches(df, ["id"]).collect()
    v = {r["id"]: r["vector"] for r in s}
    t = spark.createDataFrame([(v[1], v[2], v[3])], "a array<long>, b array<long>, c array<long>")
    r = t.select((fp.added(F.col("b"), F.col("c")) == F.col("a")).alias("x"), (fp.removed(F.col("a"), F.col("b")) == F.col("c")).alias("y")).first()
    assert r["x"] and r["y"]
    e = df.select("id", fp.exact_lanes(F.col("text")).alias("e")).collect()
    h = {r["id"]: r["e"] for r in e}
    t = spark.createDataFrame([(h[1], h[2], h[3])], "a string, b string, c string")
    r = t.select((fp.exact_added(F.col("b"), F.col("c")) == F.col("a")).alias("x"), (fp.exact_added(F.col("a"), F.col("b"), -1) == F.col("c")).alias("y")).first()
    assert r["x"] and r["y"]


def test_ring_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 3)
    ids = [3, 4, 9, 10, 500, 501, 100_000, -7, None, *range(1000, 1040)]
    df = spark.createDataFrame([(i, (i or 0) % 5, str(i).encode()) for i in ids], "doc_id long, n long, k binary")
    order = [str(i).encode() for i in sorted(ids, key=lambda i: (i is None, -(i or 0)))]
    size = {str(i).encode(): (i or 0) % 5 for i in ids}
    got = fp.ring(df).collect()
    assert len(got) == len(ids)
    for r in got:
        at = order.index(bytes(r["k"]))
        assert bytes(r["next_k"]) == order[(at + 1) % len(order)] and bytes(r["prev_k"]) == order[at - 1] and r["prev_n"] == size[order[at - 1]]


def test_one_far_id_makes_no_large_window(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fp, "settled", lambda df, name: seen.append(out := settled(df, name)) or out)
    ids = spark.range(150_000).select(F.when(F.col("id") == 7, F.lit(1 << 60)).otherwise(F.col("id")).alias("doc_id"), F.lit(1).cast("long").alias("n"))
    fp.ring(ids.withColumn("k", F.unhex(F.md5(F.col("doc_id").cast("string"))))).count()
    assert seen[0].groupBy("block").count().agg(F.max("count")).first()[0] < 1 << 15
