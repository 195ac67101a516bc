"""The pipeline against a brute-force version: plain Python on the whole table, with the learned rules as they are."""

import collections
import hashlib
import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_native import WORD, plain_verdict, stats, targets
from test_sets import brute
from tokenizers import Tokenizer

from loomtide.llm import quality_rules

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def without_repeats(texts):
    """Each text without the bytes of 200-byte strings that start elsewhere too."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    out = []
    for b in data:
        keep = np.ones(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                keep[k : k + 200] = False
        out.append(np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore"))
    return out


def copies(rows):
    """(id, text) as often as the mix takes it, of (id, text, source)."""
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    per = collections.Counter()
    for d, _, s in rows:
        per[s] += size[d]
    want = targets(per)
    coin = lambda seed, d: int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:12], 16) / 2**48
    out = []
    for s, n in per.items():
        own = [(d, t) for d, t, x in rows if x == s]
        rate = want[s] / n if n else 0.0
        whole, part = math.floor(rate), rate - math.floor(rate)
        off = [abs(whole * n + sum(size[d] for d, _ in own if coin(seed, d) < part) - want[s]) for seed in range(32)]
        seed = off.index(min(off))
        for d, t in own:
            out += [(d, t)] * (whole + (coin(seed, d) < part))
    return out


def test_the_pipeline_equals_brute_force(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    good = []
    for d, t, s in rows:
        n = stats(t)
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and plain_verdict(rules, t):
            good.append((d, t, s))
    top = brute([(d, t) for d, t, _ in good])
    one = [r for r in good if top[r[0]][1] == r[0]]
    cut = [(d, t, s) for (d, _, s), t in zip(one, without_repeats([t for _, t, _ in one]), strict=True)]
    t = Tokenizer.from_file(PATH)
    want = sorted((d, ids := t.encode(text, add_special_tokens=False).ids, len(ids))[:2] for d, text in copies(cut))
    got = c.run(spark, SF)
    assert sorted((r["doc_id"], list(r["ids"])) for r in got.collect()) == want
    assert got.where(F.col("n_tokens") != F.size("ids")).count() == 0
    assert len(rows) > len(good) > len(one) and sum(len(a[1]) for a in one) > sum(len(a[1]) for a in cut)  # each stage had something to do
    assert [n for n, _ in c.STAGES] == ["quality rules", "near duplicates", "passages", "mixing", "tokens"]
