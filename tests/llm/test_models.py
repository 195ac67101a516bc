"""The two classifiers: folds, edge rows and held-out accuracy."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomtide.llm import knn_quality, toxicity
from loomtide.llm.common import settled, utf8_blocks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("model", "mod", "held"), [(knn_quality, 5, 0), (toxicity, 4, 2)])
def test_edge_rows(odd, empty, labels, no_labels, model, mod, held):
    for docs, known in ((odd, labels), (odd, no_labels), (empty, labels), (empty, no_labels)):
        got = model.score(docs, model.fit(docs, known)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
            assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % mod == held)


def test_scores_do_not_depend_on_partitions(odd, labels):
    for model in (knn_quality, toxicity):
        m = model.fit(odd, labels)
        a, b = (sorted((str(r["doc_id"]), r["score"]) for r in model.score(d, m).collect()) for d in (odd, odd.repartition(7)))
        assert [x[0] for x in a] == [x[0] for x in b]
        if model is knn_quality:
            assert a == b
        assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)  # matrix products round by block


def area(scores, labels):
    """The share of pairs of a labelled and an unlabelled row that the scores put in order; ties count half."""
    a, b = scores[labels], scores[~labels]
    return np.mean([(x > b).mean() + (x == b).mean() / 2 for x in a])


@pytest.mark.parametrize(("model", "label", "least"), [(knn_quality, "quality", 0.95), (toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, model, label, least):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = model.score(some, model.fit(some, labels)).join(labels, "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    assert (got["predicted"] == got[label]).mean() > least
    assert area(got["score"].to_numpy(), got[label].to_numpy() > 0) > 0.97


def test_fit_equals_a_plain_logistic_regression(spark):
    """The scores of fit against gradient steps by plain NumPy on the same weighted loss, over dense features."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words, 6)) + (" stinkweed" if i % 3 == 0 and i % 4 else " pleasant" if i % 5 else ""), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    weights, bias = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    own = [(d, y, f) for d, t, y in rows for _, o, b in utf8_blocks(pa.array([t])) for f in toxicity.features(o, b)]
    learn = [x for x in own if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    y = np.array([x[1] for x in learn])
    places = np.unique(np.concatenate([x[2] for x in learn]))
    dense = np.array([np.isin(places, x[2]) for x in learn], float)
    n, m = y.sum(), (1 - y).sum()
    ratio = toxicity.ratios(dense[y == 1].sum(0), dense[y == 0].sum(0), n, m)
    x = dense * ratio / np.sqrt((dense.sum(0) * ratio**2).sum() / len(y))
    w = np.where(y, toxicity.TOXIC_SHARE / n, (1 - toxicity.TOXIC_SHARE) / m)
    # gradient steps in the space that the rows span
    gram, a, b = x @ x.T, np.zeros(len(y)), 0.0
    loss = lambda z, a: (w * np.logaddexp(0, np.where(y, -z, z))).sum() + toxicity.RIDGE / 2 * a @ gram @ a
    for _ in range(5_000):
        d = w * (1 / (1 + np.exp(-(gram @ a + b))) - y)
        a, b = a - 0.5 * (d + toxicity.RIDGE * a), b - 0.5 * d.sum()
    z = np.array([weights[f].sum(dtype=float) for _, _, f in learn]) + bias
    mine = loss(gram @ a + b, a)
    theirs = (w * np.logaddexp(0, np.where(y, -z, z))).sum()
    assert theirs < mine + 1e-3
    assert ((z > np.log(0.3 / 0.7)) == (gram @ a + b > np.log(0.3 / 0.7))).mean() > 0.9


def test_rates_are_of_whole_texts(spark):
    import pyarrow as pa

    text = "a b\n" * 50_000 + "zq"
    x = pa.array([text, None, "zq"])
    rows = [r for _, o, d in utf8_blocks(x) for r in knn_quality.term_rates(o, d)]
    assert len(rows) == 3 and rows[1].sum() == 0
    pair = (ord("z") << 8 | ord("q")) * 2654435761 % 2**32 >> 22
    assert rows[0][pair] > 0 and rows[2][pair] > 0


def test_features_are_distinct_and_inside_texts():
    import pyarrow as pa

    x = pa.array(["abcabcabc", "", "ab", "xyzw"])
    got = [f for _, o, d in utf8_blocks(x) for f in toxicity.features(o, d)]
    assert [len(g) for g in got] == [3 + 3 + 3, 0, 0, 1]
    assert all(len(set(g.tolist())) == len(g) for g in got)


def test_rows_of_features_are_small_and_whole(spark):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijklmnop "), n)) for n in (400_000, *[30_000] * 20, 0, 3)]
    toxic = [int(k % 3 == 0) for k in range(len(texts))]
    rows = list(toxicity._featured(iter([pa.RecordBatch.from_pydict({"toxic": pa.array(toxic, pa.int32()), "text": texts})])))
    assert max(sum(len(c[0].as_py()) for c in r.columns) for r in rows) < 600_000  # of a block of 1 MB of text they were several MB
    got, labels = [], []
    for r in rows:
        y, text, bucket = toxicity._told(r, 0)
        labels += y.tolist()
        got += [set(bucket[text == k].tolist()) for k in range(len(y))]
    assert labels == toxic
    assert got == [set(f.tolist()) for t in texts for _, o, d in utf8_blocks(pa.array([t])) for f in toxicity.features(o, d)]
    files = settled(spark.range(100).coalesce(1), "small_files", maxRecordsPerFile=16).inputFiles()
    assert len(files) == 7


def test_ratios_equal_plain_arithmetic(spark):
    """Counts, ratios and weighing by plain Python on the sample's own texts."""
    import math

    import pyarrow as pa

    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(words, 12)) + (" stinkweed" if toxic and i % 8 else " ") + (" pleasant" if not toxic and i % 3 else ""), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    grams = {}
    for d, t, _ in rows:
        (f,) = (f for _, o, b in utf8_blocks(pa.array([t])) for f in toxicity.features(o, b))
        grams[d] = set(f.tolist())
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    ids = [(d, y) for d, _, y in rows if not held[d]]
    n, m = sum(y for _, y in ids), sum(1 - y for _, y in ids)
    p, q = np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS)
    for d, y in ids:
        for g in grams[d]:
            (p if y else q)[g] += 1
    ratio = toxicity.ratios(p, q, n, m)
    for g in sorted(set().union(*grams.values()))[::7]:
        a, b = p[g] + n / (n + m), q[g] + m / (n + m)
        r = math.log(a / n) - math.log(b / m)
        z2 = r**2 / (1 / a + 1 / b)
        assert abs(ratio[g] - r * z2 / (z2 + 16)) < 1e-12
    weights, bias = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", F.lit(1).alias("quality"), "toxic"))
    there = np.array(sorted(set().union(*(grams[d] for d, _ in ids))))
    assert (weights[there][ratio[there] != 0] != 0).mean() > 0.99 and (np.delete(weights, there) == 0).all()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, (weights, bias)).collect()}
    for d, _, _ in rows:
        assert abs(got[d] - 1 / (1 + math.exp(-(bias + sum(float(weights[g]) for g in grams[d]))))) < 1e-6


def test_votes_equal_brute_force(spark):
    """Every score from the labelled texts' own similarities, one pair at a time; tied neighbours too."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = lambda: " ".join("".join(rng.choice(list("abcdeXYZ!\n"), rng.integers(1, 9))) for _ in range(rng.integers(3, 60)))
    rows = [(i, text(), int(rng.integers(0, 2))) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(300, "", 1), (301, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    model = knn_quality.fit(docs, spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in knn_quality.score(docs, model).collect()}
    fitted = [(d, t, q) for d, t, q in rows if zlib.crc32(str(d).encode()) % 5]

    def vector(t):
        (r,) = (r for _, o, b in utf8_blocks(pa.array([t], pa.string())) for r in knn_quality.term_rates(o, b))
        whole = [round(float(v) * knn_quality.COARSE) for v in np.sqrt(r) * model["idf"]]
        z = [sum(v * int(w) for v, w in zip(whole, column, strict=True) if v) for column in model["to"].T]
        size = sum(v * v for v in z) ** 0.5
        return [round(v / size * knn_quality.FINE) for v in z] if size else None

    known = [(vector(t), q) for _, t, q in sorted(fitted)]
    prior = np.mean([q for _, _, q in fitted])
    known = [(v, q) for v, q in known if v is not None]
    for d, t, _ in rows:
        v = vector(t)
        if v is None:
            assert abs(got[d] - prior) < 1e-6
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, q) for i, (w, q) in enumerate(known))[:15]
        votes = [(max(0, -c), q) for c, _, q in near]
        assert abs(got[d] - sum(c * q for c, q in votes) / sum(c for c, _ in votes)) < 1e-5
    assert all(got[200 + i] == got[i] for i in range(5))
