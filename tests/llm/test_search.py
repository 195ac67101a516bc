"""Ranked search, licence scans and the conversation trie against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from loomtide.llm import conversation_trie, license_scan, ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    docs = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 10 + (90 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


ITEMS = [(0, "Same LINE of words here"), (1, "w1 w2 w3 w17 w17"), (2, "nothing held"), (3, None), (4, ""), (5, "Éa ñ 日本 one"), (6, "be some text id"), (6, "w5 w6 w7 changed"), (None, "one two three")]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("shard", [1, 300, 1 << 21])
def test_search_equals_brute_force(spark, odd, monkeypatch, shard):
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    items = spark.createDataFrame([(*x, "y") for x in ITEMS], "item_id long, text string, score string")
    want = brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS)
    assert plain(ranked_search.search(odd, items).collect()) == plain(want)


def test_search_in_turns(spark, odd, monkeypatch):
    monkeypatch.setattr(ranked_search, "MAX_TERMS", 5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS)
    assert plain(ranked_search.search(odd, items).collect()) == plain(want)


def test_search_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(odd, items.limit(0)).count() == 0


def test_best_positions_stop_early_and_exactly():
    rng = np.random.default_rng(4)
    docs, width = 5000, 6
    held = rng.random((docs, width)) < 0.6
    doc, term = np.nonzero(held)
    ends = np.concatenate(([0], np.cumsum(held.sum(1))))
    tfs = rng.zipf(1.6, len(doc)).clip(1, 500)
    n = 50 + np.bincount(doc, weights=tfs, minlength=docs).astype(np.int64)
    weights = np.array([900, 700, 1500, 1100, 0, 40], np.int64)
    lists = ranked_search.ImpactLists(n, ends, term, tfs, weights, docs, int(n.sum()))
    impact = np.zeros((docs, width), np.int64)
    m = 10 + (90 * n * docs) // n.sum()
    impact[doc, term] = weights[term] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
    for asked in ([0], [0, 2], [1, 3, 5], list(range(width)), [4]):
        score = impact[:, asked].sum(1)
        order = np.lexsort((np.arange(docs), -score))[:10]
        assert lists.best(np.array(asked), 10) == [(int(score[d]), int(d)) for d in order if score[d] > 0]
    assert lists.sorted_accesses < len(doc)
    assert not lists.seen.any() and not lists.done.any()
    copies = ranked_search.ImpactLists(np.full(100, 7), np.arange(101), np.zeros(100, np.int64), np.ones(100, np.int64), np.array([5], np.int64), 100, 700)
    assert [d for _, d in copies.best(np.array([0]), 3)] == [0, 1, 2]


NOTICES = [
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "All rights reserved.", "licensed under the GNU General Public License, version 2", "Licenced under the Apache Licence 2.0", "apache apache apache license license 2.0 2.0", "under the license version apache",
    "licensed under a the new Apache fine License, the Version 2.0", "cc by cc by\ncc-by 4.0 licensed under cc, by", "mit license " * 40, "general public\nlicense", "general public license " * 3,
]


def brute_scan(texts):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [split(t) for t in texts]
    n, df = sum(map(bool, docs)), collections.Counter(w for d in docs for w in set(d))
    weight = lambda w: max(1, math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))))
    has = lambda words, phrase: any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))
    slack, out = license_scan.SLACK, []
    for d in docs:
        base = sorted((o, label) for p, label in license_scan.PHRASES.items() for o in range(len(d)) if d[o : o + len(split(p))] == split(p))
        labels, best = {x for _, x in base}, float(bool(base))
        for label, passage, keys in license_scan.TEMPLATES:
            p = split(passage)
            for o in range(-len(p) - slack, len(d) + slack):
                window = [d[i] if 0 <= i < len(d) else None for i in range(o - slack, o + len(p) + slack)]
                got = sum(weight(w) for k, w in enumerate(p) if w in window[k : k + 2 * slack + 1])
                total = sum(map(weight, p))
                if 100 * got >= license_scan.SHARE * total and all(has(window, split(k)) for k in keys):
                    labels, best = labels | {label}, max(best, got / total)
        out.append((len(d), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best))
    return out


def test_scan_equals_every_template_at_every_place(spark):
    rng = random.Random(8)
    pool = "licensed under the apache license version 2 0 gnu general public mit cc by nc released terms of w1 w2 w3 w4 é".split()
    texts = [None, "", " \n", *NOTICES, *[" ".join(rng.choice(pool) for _ in range(60)) + " " + n + " tail" * (i % 3) for i, n in enumerate(NOTICES)]]
    texts += [t[1] for t in license_scan.TEMPLATES] + [" ".join(f"w{rng.randrange(50)}" for _ in range(300)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.labelled(docs).collect()}
    for i, want in enumerate(brute_scan(texts)):
        assert got[i][:-1] == want[:-1] and got[i][-1] == pytest.approx(want[-1]), (texts[i], got[i], want)


def test_scan_of_edge_rows(odd, empty):
    rows = license_scan.labelled(odd).collect()
    assert len(rows) == odd.count() and license_scan.labelled(empty).count() == 0
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["base_labels"] == "" and r["score"] == 0.0 for r in rows if r["n_words"] == 0)


def test_scan_spans_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "x " * 5 + "released under the mit license. " * 3)], "doc_id long, text string")
    (row,) = license_scan.scan(docs).collect()
    assert [(m["label"], m["first_word"], m["words"]) for m in row["matches"] if m["share"] == 1.0] == [("mit", 5, 5), ("mit", 10, 5), ("mit", 15, 5)]


def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows; equal turns of a conversation must say the same."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        whole[c] = (own.get(c - int(math.fmod(c, 20)), []) if h else [])[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    low = lambda cs: min(cs, key=lambda c: (c is not None, c or 0))
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        leaves = sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in under) for q in under)
        ends = sorted((c for c in cs if len(whole[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        out.append((low(cs), len(p), low(members[p[:-1]]) if p else None, len(cs), len(children), leaves, saved, digest))
    return out


def conversations(spark):
    rng = random.Random(12)
    rows = []
    for c in [*range(130), 200, 201, 340, 341, 347, 900, -3, -20]:
        kind, n = rng.randrange(4), rng.choice([1, 2, 3, 4, 5, 9])
        rows += [(c, t, rng.choice(["user", "system"]) if t else "user", "hello  there you" if t == 0 else f"w{kind if t < 4 else rng.randrange(3)} " * rng.randrange(1, 3)) for t in range(n)]
    rows += [(7, t, "user", f"long {t % 5}") for t in range(20, 90)] + [(340, t, "assistant", "again") for t in range(20, 70)]
    rows += [(None, None, None, None), (None, 1, "user", ""), (12, None, None, "null turn"), (13, 3, "same", "row"), (13, 3, "same", "row"), (950, 1, "", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string")
    return rows, df.repartition(3)


@pytest.mark.parametrize(("most", "chunk"), [(1 << 14, 1 << 12), (40, 7), (1, 1 << 12)])
def test_trie_equals_brute_force(spark, monkeypatch, most, chunk):
    monkeypatch.setattr(conversation_trie, "MAX_ROWS", most)
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    rows, df = conversations(spark)
    assert plain(conversation_trie.nodes(df).collect()) == plain(brute_trie(rows))


def test_trie_of_an_empty_table(spark):
    assert conversation_trie.nodes(conversations(spark)[1].limit(0)).count() == 0


def test_double_array_holds_what_was_added():
    rng = np.random.default_rng(6)
    shard = np.repeat(np.arange(1, 60), rng.integers(1, 30, 59))
    conv = np.arange(len(shard))
    size = rng.integers(1, 12, len(shard))
    shard, conv = np.repeat(shard, size), np.repeat(conv, size)
    first = np.concatenate(([True], conv[1:] != conv[:-1]))
    turn = np.where(first, 1, rng.integers(1, 5, len(conv)))
    trie, node, levels = conversation_trie.walk(shard, conv, turn)
    told, now = {}, ()
    for k in range(len(conv)):
        now = (shard[k],) if first[k] else (*now, turn[k])
        assert told.setdefault(int(node[k]), now) == now
    assert len(set(told.values())) == len(told) == sum(map(len, levels)) == (trie.check >= 0).sum() - 1
    assert (trie.step(np.array(list(told)), np.full(len(told), 99)) == -1).all()
