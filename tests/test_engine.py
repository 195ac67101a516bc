"""Randomness, selection, kernels, pipelines, structured samples, sources and streams."""

import itertools
import json
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtide.functions import linalg, tensor
from loomtide.operators import image_ops, kernels, rng, selection, structured
from loomtide.plans.pipeline import Pipeline, PipelineError, Transform, to_numpy
from loomtide.sources import datasets, images

RNG = np.random.default_rng(19)
PIXELS = [RNG.integers(0, 256, (12, 18, 3), dtype=np.uint8) for _ in range(6)]


@pytest.fixture(scope="module")
def pngs(spark):
    return spark.createDataFrame([(i, bytearray(kernels.encode_png(p)), i % 3) for i, p in enumerate(PIXELS)], "pos long, image binary, label long")


def test_known_draws():
    s = rng.Context(42, 3).stream(7, rng.op_key("RandomCrop", 0))
    assert [s.u64() for _ in range(3)] == [5533641612311874201, 14975349713323976143, 6276863558590808471]
    states = rng.row_states(rng.Context(42, 3), np.arange(20), rng.op_key("Flip"))
    assert rng.first_draws(states).tolist() == [rng.Context(42, 3).stream(i, rng.op_key("Flip")).u64() for i in range(20)]
    assert sorted(rng.fisher_yates(50, 9).tolist()) == list(range(50))


def test_skip_and_take_compose_in_order(spark):
    df = spark.range(12).withColumnRenamed("id", "pos").withColumn("v", F.col("pos"))
    for ops in itertools.product([("skip", 2), ("skip", 5), ("take", 3), ("take", 20)], repeat=2):
        want, out = list(range(12)), df
        for op, n in ops:
            want = want[n:] if op == "skip" else want[:n]
            out = getattr(selection, op)(out, n)
        assert [r["v"] for r in out.orderBy("pos").collect()] == want


def test_with_pos_ranks_across_blocks(spark):
    ids = [5, -3, 900, 7, 100_000, 6]
    got = selection.with_pos(spark.createDataFrame([(i,) for i in ids], "k long"), "k", block=4).collect()
    assert {r["k"]: r["pos"] for r in got} == {k: i for i, k in enumerate(sorted(ids))}


def test_with_pos_of_sparse_and_far_keys(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_BLOCKS", 40)
    keys = spark.range(5000).select(F.when(F.col("id") == 9, F.lit(1 << 60)).when(F.col("id") == 11, F.lit(-(1 << 60))).when(F.col("id") < 2500, F.col("id")).otherwise(F.xxhash64("id")).alias("k"))
    got = {r["k"]: r["pos"] for r in selection.with_pos(keys, "k", block=100).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 5000
    blocks = keys.groupBy(selection._block(F.col("k"), selection._bounds(keys, "k", 100)).alias("b")).count().collect()
    assert len(blocks) == 40 and max(r["count"] for r in blocks) < 400


def test_hash_shuffle_gives_dense_places(spark):
    rows = spark.range(2000).select(F.col("id").alias("pos"), (F.col("id") * 7 - 3000).alias("k"))
    got = {r["k"]: r["pos"] for r in selection.hash_shuffle(rows, "k", 5, block=100).collect()}
    assert sorted(got.values()) == list(range(2000)) and sum(abs(p - (k + 3000) // 7) for k, p in got.items()) > 800_000 // 2
    assert got == {r["k"]: r["pos"] for r in selection.hash_shuffle(rows.repartition(5), "k", 5).collect()}
    batches = selection.batch(selection.hash_shuffle(rows, "k", 5), 100).groupBy("batch_id").agg(F.count("*").alias("n"), (F.max("k") - F.min("k")).alias("wide")).collect()
    assert len(batches) == 20 and all(r["n"] == 100 and r["wide"] > 7000 for r in batches)


def test_packing(spark):
    docs = [[1, 2, 3], [], [4, 5], [6, 7, 8, 9]]
    df = spark.createDataFrame(list(enumerate(docs)), "pos long, ids array<int>")
    flat = [t for d in docs for t in [*d, 0]]
    got = {r["block"]: r["ids"] for r in selection.packed(df, 5, 0, drop_last=False, width=2).collect()}
    assert got == {k: flat[5 * k : 5 * k + 5] for k in range(3)}
    assert len(selection.packed(df, 5, 0, width=2).collect()) == 2


def test_png_round_trip_and_filters():
    for c in (1, 2, 3, 4):
        px = RNG.integers(0, 256, (7, 5, c), dtype=np.uint8)
        assert (kernels.decode_png(kernels.encode_png(px)) == kernels.rgb(px)).all()
    with pytest.raises(ValueError):
        kernels.decode_png(b"no image")


@pytest.mark.parametrize("kind", ["nearest", "box", "bilinear", "hamming", "bicubic", "lanczos3"])
def test_resampling(kind):
    px = PIXELS[0]
    assert (kernels.resize(px, 18, 12, kind) == px).all()
    assert (kernels.resize(np.full((9, 9, 3), 77, np.uint8), 5, 14, kind) == 77).all()
    up = kernels.resize(px, 36, 24, kind)
    assert up.shape == (24, 36, 3) and abs(float(up.mean()) - float(px.mean())) < 4


def test_geometry_identities():
    px = PIXELS[1]
    assert (kernels.rotate(px, 90, expand=True) == np.rot90(px)).all() and (kernels.affine(px) == px).all()
    square = px[:, :12]
    assert (kernels.perspective(square, [(0, 0), (12, 0), (12, 12), (0, 12)], [(0, 0), (12, 0), (12, 12), (0, 12)]) == square).all()
    assert (kernels.pad(px, (2, 1, 3, 4), mode="reflect") == np.pad(px, ((1, 4), (2, 3), (0, 0)), mode="reflect")).all()
    assert (kernels.pad(px, (2, 1, 3, 4), mode="symmetric") == np.pad(px, ((1, 4), (2, 3), (0, 0)), mode="symmetric")).all()
    assert (kernels.center_crop(px, 30, 20)[4:16, 6:24] == px).all()
    assert (kernels.elastic(px, np.zeros((12, 18)), np.zeros((12, 18))) == px).all()


def test_colour_identities():
    px = PIXELS[2]
    for f in (kernels.brightness, kernels.contrast, kernels.saturation, kernels.sharpness):
        assert (f(px, 1.0) == px).all()
    assert (kernels.posterize(px, 8) == px).all() and (kernels.invert(kernels.invert(px)) == px).all()
    assert (kernels.to_uint8(kernels.to_float(px)) == px).all()
    grey = np.repeat(px[..., :1], 3, axis=2)
    assert (kernels.hue(grey, 0.3) == grey).all()
    stretched = kernels.autocontrast(px)
    assert stretched.min() == 0 and stretched.max() == 255


def test_pipeline_checks_its_steps(pngs):
    p = Pipeline(pngs)
    bad = [
        lambda: p.resize(4), lambda: p.batch(2), lambda: p.decode_image().decode_image(), lambda: p.decode_image().batch(0), lambda: p.decode_image().normalize([0.5], [0.2]).hue(0.1),
        lambda: p.decode_image().hwc_to_chw().horizontal_flip(), lambda: p.decode_image().five_crop(4).take(1), lambda: p.decode_image().batch(2).crop(0, 0, 1, 1), lambda: p.decode_image().normalize([0.5], [0.2]).resize(4), lambda: p.decode_image().hue(0.9),
    ]
    for f in bad:
        with pytest.raises(PipelineError):
            f()


def test_pipeline_rows_equal_the_kernels(pngs):
    out = Pipeline(pngs).skip(1).take(4).decode_image().resize(9, 6).horizontal_flip().convert_image_dtype("float32").hwc_to_chw().batch(3)
    got = list(to_numpy(out))
    assert [len(b["labels"]) for b in got] == [3, 1] and got[0]["images"].shape == (3, 3, 6, 9)
    want = [kernels.to_float(kernels.resize(p, 9, 6)[:, ::-1]).transpose(2, 0, 1) for p in PIXELS[1:5]]
    assert np.array_equal(np.concatenate([b["images"] for b in got]), np.stack(want))
    assert "resize" in out.explain().lower() and "batch" in out.explain()


def test_draws_do_not_depend_on_partitions(pngs):
    t = Transform().random_crop(8, padding=2).random_horizontal_flip().color_jitter(0.4, 0.4, 0.1, 0.4).random_erasing().rand_augment().trivial_augment_wide()
    t = t.random_choice([Transform().invert(), Transform().random_rotation(30)], [0.3, 0.7]).random_order(Transform().solarize(90).posterize(3)).random_apply(0.5, Transform().gaussian_blur(0.7))
    t = t.random_affine(20, translate=(0.2, 0.2), scale=(0.8, 1.2), shear=(-10, 10)).random_perspective().elastic_transform(8.0, 1.0).random_photometric_distort().random_zoom_out().gaussian_noise(sigma=0.05).random_resized_crop(7)
    run = lambda df, epoch: sorted((r["pos"], r["source"], bytes(r["data"])) for r in Pipeline(df).seed(5).epoch(epoch).shuffle().decode_image().compose(t).execute().collect())
    one = run(pngs.coalesce(1), 1)
    assert one == run(pngs.repartition(4), 1) and one != run(pngs, 2)


def test_steps_at_once_equal_steps_one_by_one():
    from loomtide.operators import batched

    gen = np.random.default_rng(8)
    px = gen.integers(0, 256, (40, 9, 11, 3), dtype=np.uint8)
    px[:3] = px[:3, :1, :1]
    plain = {
        "HorizontalFlip": {}, "VerticalFlip": {}, "Rotate": {"angle": 270}, "Pad": {"sides": (1, 2, 3, 0), "mode": "reflect"}, "Brightness": {"f": 1.3}, "Contrast": {"f": 0.7}, "Saturation": {"f": 1.4}, "Hue": {"f": -0.2}, "Gamma": {"g": 0.8}, "Grayscale": {"channels": 3}, "Invert": {},
        "Posterize": {"bits": 3}, "Solarize": {"threshold": 99}, "GaussianBlur": {"sigma": 0.8, "kernel_size": 3}, "PermuteChannels": {"order": (2, 0, 1)}, "Rgb": {}, "Normalize": {"mean": (0.5, 0.4, 0.3), "std": (0.2, 0.3, 0.4)}, "ToFloat": {}, "CastFloat": {}, "HwcToChw": {}, "Resize": {"w": 6, "h": 14, "interpolation": "bicubic"}, "Autocontrast": {},
    }
    drawn = {
        "RandomCrop": {"w": 7, "h": 8, "padding": (2, 2, 2, 2), "mode": "edge"}, "RandomHorizontalFlip": {}, "RandomVerticalFlip": {"p": 0.3}, "RandomGrayscale": {"p": 0.4}, "RandomInvert": {}, "RandomPosterize": {"bits": 2}, "RandomSolarize": {"threshold": 77}, "ColorJitter": {"b": 0.4, "c": 0.3, "h": 0.1, "sat": 0.5},
        "RandomApply": {"p": 0.5, "steps": (("Invert", {}), ("Contrast", {"f": 0.5}))}, "RandomErasing": {"value": "random"},
        "RandomResizedCrop": {"w": 6, "h": 5, "scale": (0.3, 1.9)}, "RandomAutocontrast": {}, "JPEG": {"quality": (20, 23)},
    }
    assert set(plain) | {"ToUint8", "CastUint8", "ChwToHwc"} == set(batched.PLAIN) and set(drawn) == {*batched.RANDOM, "RandomApply"}
    context, rows = rng.Context(3, 1), np.arange(100, 140)
    whole = [("ColorJitter", drawn["ColorJitter"]), ("RandomCrop", drawn["RandomCrop"]), ("HwcToChw", {}), ("ChwToHwc", {}), ("ToFloat", {}), ("ToUint8", {}), ("CastFloat", {}), ("CastUint8", {})]
    for steps in [*([(n, a)] for n, a in (plain | drawn).items()), whole]:
        keyed = image_ops.keyed(steps)
        assert [x for x, _ in batched.segments(keyed)] == [True]
        got = batched.apply(keyed, px, context, rows)
        want = [image_ops.apply(keyed, [x], lambda key, r=r: context.stream(int(r), key))[0] for x, r in zip(px, rows, strict=True)]
        assert got.dtype == want[0].dtype and np.array_equal(got, np.stack(want)), steps
    parts = batched.segments(image_ops.keyed([("Invert", {}), ("ElasticTransform", {}), ("Invert", {}), ("Pad", {}), ("FiveCrop", {}), ("Invert", {})]))
    assert [(x, len(s)) for x, s in parts] == [(True, 1), (False, 1), (True, 2), (False, 2)]


def test_single_steps_between_others(pngs):
    t = Transform().random_horizontal_flip().random_rotation(30).color_jitter(0.4, 0.4, 0.1).random_resized_crop(6).random_perspective().posterize(4)
    got = {r["source"]: np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3) for r in Pipeline(pngs).seed(3).decode_image().compose(t).execute().collect()}
    keyed, context = image_ops.keyed(list(t.steps)), rng.Context(3)
    for i, px in enumerate(PIXELS):
        (want,) = image_ops.apply(keyed, [px], lambda key, i=i: context.stream(i, key))
        assert np.array_equal(got[i], want)


def test_rows_of_several_shapes(spark):
    gen = np.random.default_rng(4)
    images = [gen.integers(0, 256, (5 + i % 3, 6, 3), dtype=np.uint8) for i in range(12)]
    raw = spark.createDataFrame([(i, bytearray(x.tobytes()), i, x.shape[0], 6, 3) for i, x in enumerate(images)], "pos long, image binary, label long, h int, w int, c int").repartition(2)
    got = {r["pos"]: np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["c"]) for r in Pipeline(raw).decode_image().horizontal_flip().execute().collect()}
    assert all((got[i] == x[:, ::-1]).all() for i, x in enumerate(images)) and len(got) == 12


def test_views_keep_their_label(pngs):
    rows = Pipeline(pngs).decode_image().ten_crop(5, 4).batch(2).execute().orderBy("pos", "view").collect()
    assert len(rows) == 60 and [r["view"] for r in rows[:10]] == list(range(10)) and all(r["label"] == r["source"] % 3 for r in rows)


def test_every_random_step_runs():
    s = rng.Context(1).stream
    args = {
        "RandomCrop": {"w": 5, "h": 5}, "RandomResizedCrop": {"w": 5, "h": 5}, "RandomRotation": {"degrees": (-20, 20)}, "RandomAffine": {"degrees": (-9, 9)}, "RandomGaussianBlur": {"kernel_size": 3}, "RandomPosterize": {"bits": 3},
        "RandomSolarize": {"threshold": 9}, "RandomAdjustSharpness": {"f": 2.0}, "RandomResize": {"low": 4, "high": 9}, "RandomShortestSize": {"sizes": (4, 6)}, "ScaleJitter": {"w": 9, "h": 9}, "ElasticTransform": {"sigma": 1.0}, "JPEG": {"quality": (10, 90)},
    }
    for name in image_ops.RANDOM:
        for row in range(4):
            (px,) = image_ops.apply(image_ops.keyed([(name, args.get(name, {}))]), [PIXELS[0]], lambda key, row=row: s(row, key))
            assert px.dtype == np.uint8 and px.shape[2] == 3


def test_policies_have_their_pairs():
    for name in ("imagenet", "cifar10", "svhn"):
        pairs = image_ops.SUB_POLICIES[name]
        assert len(pairs) == 25
        for (n, p, m) in (op for pair in pairs for op in pair):
            assert (n in image_ops.POLICY or n == "Invert") and 0 <= p <= 1 and (m is None) == (n in image_ops._PLAIN)


def test_beta_draws():
    s = rng.Context(1).stream(0, 0)
    for alpha, spread in ((0.2, 1 / (4 * 1.4)), (1.0, 1 / 12), (4.0, 1 / 36)):
        x = np.array([image_ops.beta_draw(s, alpha) for _ in range(4000)])
        assert abs(x.mean() - 0.5) < 0.03 and abs(x.var() - spread) < 0.02


def test_cut_boxes_truncate_half_sides():
    from loomtide.operators import mix

    # half = 0.25: half sides of 2.5 are 2 pixels, on both sides of the pixel
    assert mix.cut_box(7, 7, 10, 10, 0.75) == (5, 5, 9, 9)
    assert mix.cut_box(1, 9, 10, 10, 0.75) == (0, 7, 3, 10)
    assert mix.cut_box(3, 3, 8, 16, 0.0) == (0, 0, 11, 7)


def test_beta_draws_of_tiny_shapes_are_ends():
    s = rng.Context(1).stream(0, 0)
    x = [image_ops.beta_draw(s, 1e-310) for _ in range(200)] + [image_ops.beta_draw(s, 1e-4) for _ in range(200)]
    assert all(v < 1e-6 or v > 1 - 1e-6 for v in x) and 0.3 < np.mean(x) < 0.7


def test_mixup_and_cutmix(pngs):
    base = Pipeline(pngs).seed(3).decode_image().batch(4)
    whole = Pipeline(pngs).seed(3).decode_image().convert_image_dtype("float32").batch(4)
    plain = {r["pos"]: np.frombuffer(r["data"], np.float32).reshape(12, 18, 3) for r in whole.execute().collect()}
    for r in whole.mixup(3, 0.8).collect():
        before = (r["pos"] - 1) if r["batch_pos"] else (3 if r["batch_id"] == 0 else 5)
        lam = np.float32(image_ops.beta_draw(rng.Context(3).stream(r["batch_id"], rng.op_key("MixUp")), 0.8))
        want = plain[before] * (np.float32(1) - lam) + plain[r["pos"]] * lam
        assert np.array_equal(np.frombuffer(r["data"], np.float32).reshape(12, 18, 3), want) and abs(sum(r["soft_label"]) - 1) < 1e-6
    a, b = (sorted((r["pos"], bytes(r["data"]), str(r["soft_label"])) for r in p.cutmix(3).collect()) for p in (base, Pipeline(pngs.repartition(5)).seed(3).decode_image().batch(4)))
    assert a == b and len(a) == 6
    for f in (lambda: Pipeline(pngs).decode_image().mixup(3), lambda: base.mixup(3)):
        with pytest.raises(PipelineError):
            f()
    # the first shuffle's seed counts where the pipeline has none, for batches too
    shuffled = Pipeline(pngs).shuffle(3).decode_image().convert_image_dtype("float32").batch(4)
    lam = np.float32(image_ops.beta_draw(rng.Context(3).stream(1, rng.op_key("MixUp")), 1.0))
    for r in shuffled.mixup(3).where("batch_id = 1").collect():
        assert min(abs(v - lam) for v in r["soft_label"]) < 1e-6 or max(r["soft_label"]) == 1


def test_soft_labels_are_mixed(pngs):
    from loomtide.operators.mix import mixed

    rows = Pipeline(pngs).decode_image().convert_image_dtype("float32").batch(3).execute()
    soft = rows.withColumn("label", F.array(F.lit(0.25).cast("float"), F.lit(0.75).cast("float")))
    for r in mixed(soft, "MixUp", None, 1.0).collect():
        assert np.allclose(r["soft_label"], [0.25, 0.75])
    for bad in (lambda: mixed(rows, "MixUp", None, 1.0), lambda: mixed(rows, "MixUp", 3, 0.0), lambda: mixed(soft, "MixUp", 3, 1.0).collect()):
        with pytest.raises(Exception):  # noqa: B017
            bad()


def test_keys_below_random_steps_count_siblings_of_a_kind():
    flip = ("RandomHorizontalFlip", {})
    steps = [("RandomApply", {"p": 1.0, "steps": (("Invert", {}), flip, flip)}), ("RandomApply", {"p": 1.0, "steps": (flip,)})]
    (_, args, first), (_, _, second) = image_ops.keyed(steps)
    assert (first, second) == (rng.op_key("RandomApply", 0), rng.op_key("RandomApply", 1))
    assert [k for n, _, k in image_ops.keyed(args["steps"], first) if n == flip[0]] == [rng.combine(first, rng.op_key(flip[0], k)) for k in (0, 1)]
    asked = []
    image_ops.apply(image_ops.keyed([("RandomChoice", {"choices": ((flip,), (flip, flip)), "p": (0.0, 2.0)})]), [PIXELS[0]], lambda key: asked.append(key) or rng.Context(1).stream(0, key))
    branch = rng.combine(rng.op_key("RandomChoice"), rng.op_key("RandomChoiceBranch", 1))
    assert asked == [rng.op_key("RandomChoice"), *[rng.combine(branch, rng.op_key(flip[0], k)) for k in (0, 1)]]


def test_choice_weights():
    assert image_ops.choice_bounds(4, (0.0, 1.0, 3.0, 0.0)) == [0.0, 0.25, 1.0, 1.0] and image_ops.choice_bounds(3, None) is None
    for bad in ((), (1.0,), (0.0, 0.0), (-1.0, 2.0), (float("nan"), 1.0), (float("inf"), 1.0)):
        with pytest.raises(ValueError):
            image_ops.choice_bounds(2, bad)
    with pytest.raises(ValueError):
        Transform().random_choice([Transform().invert()], [1.0, 2.0])


def test_perspective_corners_stay_in_their_boxes():
    class Top:
        def below(self, n):
            return n - 1

    class Low:
        def below(self, n):
            return 0

    # width 11, height 9, distortion 0.5: boxes of 2 by 2 pixels
    assert image_ops.moved_corners(Low(), 11, 9, 0.5) == [(0, 0), (8, 0), (8, 6), (0, 6)]
    assert image_ops.moved_corners(Top(), 11, 9, 0.5) == [(2, 2), (10, 2), (10, 8), (2, 8)]


def test_magnitudes_are_float32_steps_from_both_ends():
    m = image_ops.magnitudes(10, 8, 16, "mix")
    assert m["TranslateX"][9] == float(np.float32(16 / 3)) and m["Posterize"] == [4.0, 4.0, 3.0, 3.0, 2.0, 2.0, 1.0, 1.0, 0.0, 0.0]
    assert m["ShearX"][7] == float(np.float32(0.3) - np.float32(0.3) / np.float32(9) * np.float32(2))
    assert image_ops.magnitudes(10, 8, 16)["Posterize"][9] == 4.0 and image_ops.magnitudes(31, 8, 16, "wide")["TranslateY"][30] == 32.0


def test_augmix_weights_and_order():
    """One chain of one known operation: total = beta0 * image + weight * beta1 * operation."""
    s = rng.Context(5).stream(0, 1)
    beta, (weight,) = image_ops.dirichlet(s, 2, 1.0), image_ops.dirichlet(s, 1, 1.0)
    name = image_ops.MIX[:9][s.below(9)]
    m = 0.0 if name in image_ops._PLAIN else image_ops.magnitudes(10, 12, 18, "mix")[name][s.below(3)]
    m = -m if name in image_ops._SIGNED and s.coin(0.5) else m
    want = PIXELS[0].astype(np.float32) * beta[0] + weight * beta[1] * image_ops.mix_op(PIXELS[0], name, m, "bilinear", 0).astype(np.float32)
    got = image_ops._augmix(PIXELS[0], rng.Context(5).stream(0, 1), width=1, depth=1, all_ops=False)
    assert np.array_equal(got, np.clip(want, 0, 255).astype(np.uint8))
    for bad in ({"severity": 0}, {"severity": 11}, {"width": 0}, {"alpha": 0.0}, {"interpolation": "bicubic"}):
        with pytest.raises(PipelineError):
            Transform().augmix(**bad)


def test_grid_warp_and_mix_colours():
    px = PIXELS[3]
    same = (1, 0, 0, 0, 1, 0)
    assert (kernels.grid_warp(px, same, "nearest") == px).all() and np.abs(kernels.grid_warp(px, same).astype(int)[1:-1, 1:-1] - px[1:-1, 1:-1]).max() <= 1
    moved = kernels.grid_warp(px, (1, 0, 3, 0, 1, 0), "nearest", 9)
    assert (moved[:, :-3] == px[:, 3:]).all() and (moved[:, -3:] == 9).all()
    for name in ("Color", "Contrast", "Sharpness"):
        assert (kernels.mix_colour(px, name, 0.0) == px).all()
    grey = np.trunc(np.float32(0.2989) * px[..., 0].astype(np.float32) + np.float32(0.587) * px[..., 1].astype(np.float32) + np.float32(0.114) * px[..., 2].astype(np.float32))
    assert (kernels.mix_colour(px, "Color", -1.0) == grey[..., None]).all()


def test_draws_at_once_are_the_draws_one_by_one():
    one, many = rng.Context(9).stream(3, 4), rng.Context(9).stream(3, 4)
    assert [one.u64() for _ in range(40)] == many.u64s(40).tolist() and one.u64() == many.u64()
    assert [float(one.f32()) for _ in range(9)] == many.f32s(9).tolist()
    assert np.allclose([one.normal() for _ in range(9)], many.normals(9)) and one.state == many.state


def test_noise_is_float32_and_truncated():
    px = np.array([[[0, 100, 250]]], np.uint8)
    s, t = rng.Context(4).stream(1, 2), rng.Context(4).stream(1, 2)
    n = [np.float32(t.normal()) for _ in range(3)]
    want = [int(v) + int(np.trunc(np.float32(0.02 * 255) + x * np.float32(0.3 * 255))) for v, x in zip(px.ravel(), n, strict=True)]
    assert image_ops._gaussian_noise(px, s, 0.02, 0.3).ravel().tolist() == [min(255, max(0, v)) for v in want] and s.state == t.state
    assert image_ops._gaussian_noise(px, rng.Context(4).stream(1, 2), 0.02, 0.3, False).ravel().tolist() == [v % 256 for v in want]
    assert (image_ops._gaussian_noise(px, s, 0.0, 0.0) == px).all() and s.state == t.state
    f = kernels.to_float(px)
    got = image_ops._gaussian_noise(f, rng.Context(4).stream(1, 2), 0.1, 0.2, False)
    assert got.dtype == np.float32 and got.ravel().tolist() == [float(v + (np.float32(0.1) + x * np.float32(0.2))) for v, x in zip(f.ravel(), n, strict=True)]


def test_png_filters(monkeypatch):
    """Every filter, against the definition, a byte at a time."""
    import struct
    import zlib

    gen = np.random.default_rng(2)
    for h, w, c in ((1, 1, 1), (5, 1, 3), (9, 7, 3), (12, 33, 4)):
        px = gen.integers(0, 256, (h, w, c), dtype=np.uint8)
        kinds = gen.integers(0, 5, h) if h > 6 else gen.permutation(5)[:h]
        lines = []
        for y in range(h):
            line = bytearray([kinds[y]])
            for x in range(w):
                for k in range(c):
                    left, up, corner = (int(px[y + b, x + a, k]) if x + a >= 0 and y + b >= 0 else 0 for a, b in ((-1, 0), (0, -1), (-1, -1)))
                    p = left + up - corner
                    near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    line.append((int(px[y, x, k]) - (0, left, up, (left + up) // 2, near)[kinds[y]]) % 256)
            lines.append(bytes(line))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
        assert (kernels.decode_png(png) == kernels.rgb(px)).all()


def test_linear_algebra_errors_name_their_batch(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0, 3.0] + [1.0, 0.0, 5.0, 0.0], [1.0, 2.0, 3.0, 4.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="batch 1 at diagonal 1"):
        df.select(linalg.batch_triangular_solve(F.col("a"), F.col("b"), 2, 2)).collect()
    for f in (lambda: tensor.broadcast_shape((2, 3), (4,)), lambda: tensor.reshape(F.col("a"), (8,), (3, -1)), lambda: tensor.squeezed((2, 3), 0), lambda: tensor.index_add(F.col("a"), (8,), 0, [8], F.col("b")), lambda: tensor.convert(F.col("a"), "f8")):
        with pytest.raises((ValueError, IndexError)):
            f()
    with pytest.raises(NotImplementedError):
        tensor.argsort(F.col("a"))
    nan = F.transform("a", lambda x: F.lit(float("nan")))
    assert df.select(linalg.baddbmm(nan, F.col("a"), F.col("a"), 2, 2, 2, 2, 0.0).alias("r")).first()["r"][0] == 1.0
    assert df.select(linalg.addbmm(F.slice("a", 1, 4), nan, nan, 2, 2, 2, 2, 2.0, 0.0).alias("r")).first()["r"] == [2.0, 0.0, 4.0, 6.0]


def test_null_images_are_errors(spark):
    df = spark.createDataFrame([(0, None, 1)], "pos long, image binary, label long")
    with pytest.raises(Exception, match="null at row 0"):
        Pipeline(df).decode_image().execute().collect()


def sample():
    masks = np.zeros((2, 10, 12), np.uint8)
    masks[0, 2:6, 1:5] = 1
    return {"image": PIXELS[0][:10, :12], "boxes": np.array([[1, 2, 5, 6], [7, 5, 11, 9]], np.float32), "labels": np.array([4, 9]), "masks": masks, "keypoints": np.arange(8, dtype=np.float32).reshape(2, 2, 2)}


def test_structured_fields_move_together(spark):
    s = sample()
    f = structured.horizontal_flip(s)
    assert f["boxes"].tolist() == [[7, 2, 11, 6], [1, 5, 5, 9]] and f["keypoints"][0, 0].tolist() == [11, 1] and (f["masks"] == s["masks"][..., ::-1]).all()
    back = structured.horizontal_flip(f)
    assert all((back[k] == s[k]).all() for k in s)
    assert structured.resize(s, 24, 20)["boxes"].tolist() == (s["boxes"] * 2).tolist()
    cut = structured.sanitize(structured.crop(s, 0, 0, 6, 7))
    assert cut["labels"].tolist() == [4] and len(cut["masks"]) == 1
    rows = [(i, 10, 12, 3, bytearray(np.ascontiguousarray(s["image"]).tobytes()), s["boxes"].tolist(), s["labels"].tolist(), s["keypoints"].tolist(), [bytearray(m.tobytes()) for m in s["masks"]]) for i in range(6)]
    df = spark.createDataFrame(rows, structured.SCHEMA)
    none = s | {"boxes": s["boxes"][:0], "labels": s["labels"][:0], "keypoints": s["keypoints"][:0]}
    draws = rng.Context(1).stream(0, 0)
    assert structured.random_iou_crop(none, draws) is none and draws.state == rng.Context(1).stream(0, 0).state
    steps = [("RandomIoUCrop", {}), ("RandomHorizontalFlip", {}), ("Resize", {"w": 8, "h": 8}), ("Sanitize", {})]
    a, b = (sorted(map(str, structured.transformed(d, steps, 3).collect())) for d in (df.coalesce(1), df.repartition(3)))
    assert a == b and len(a) == 6
    with pytest.raises(ValueError):
        structured.transformed(df, [("ElasticTransform", {})])


def annotated(spark, n=6):
    s = sample()
    rows = [(i, 10, 12, 3, bytearray(np.ascontiguousarray(PIXELS[i % 6][:10, :12]).tobytes()), s["boxes"].tolist(), s["labels"].tolist(), s["keypoints"].tolist(), [bytearray(m.tobytes()) for m in s["masks"]]) for i in range(n)]
    return spark.createDataFrame(rows, structured.SCHEMA)


def test_structured_warps_agree():
    """A pixel's box, mask and keypoint go where the pixel goes."""
    h, w = 21, 17
    image = np.zeros((h, w, 3), np.uint8)
    image[9, 6] = 255
    mask = (image[..., 0] > 0).astype(np.uint8)[None]
    s = {"image": image, "boxes": np.array([[6, 9, 7, 10]], np.float32), "labels": np.array([1]), "masks": mask, "keypoints": np.array([[[6.5, 9.5]]], np.float32)}
    moves = [
        ("Affine", {"angle": 0.0, "translate": (3, -2), "scale": 1.0, "shear": (0.0, 0.0)}), ("ArbitraryRotate", {"angle": 90.0, "expand": True}), ("Rotate", {"angle": 180}),
        ("Perspective", {"start": [(0, 0), (w, 0), (w, h), (0, h)], "end": [(2, 1), (w + 2, 1), (w + 2, h + 1), (2, h + 1)], "interpolation": "nearest"}), ("CenterCrop", {"w": 11, "h": 13}), ("ResizedCrop", {"x": 2, "y": 3, "w": 10, "h": 12, "ow": 10, "oh": 12}),
    ]
    for name, args in moves:
        out = structured.apply([(name, args, 0)], s, None)
        (y,), (x,) = np.nonzero(out["image"][..., 0])
        assert out["image"][y, x, 0] == 255 and np.allclose(out["boxes"][0], [x, y, x + 1, y + 1], atol=1e-4), name
        assert np.argwhere(out["masks"][0]).tolist() == [[y, x]] and out["masks"].shape[1:] == out["image"].shape[:2], name
        assert np.allclose(out["keypoints"][0, 0], [x + 0.5, y + 0.5], atol=1e-4), name


def test_structured_pipeline(spark):
    from loomtide.plans.structured_pipeline import StructuredPipeline

    df = annotated(spark)
    inner = Transform().random_horizontal_flip().brightness(1.2)
    p = StructuredPipeline(df).seed(4).epoch(2).random_affine(20, translate=(0.1, 0.1)).random_apply(0.5, inner).random_choice([inner, Transform().random_crop(8)]).random_zoom_out().color_jitter(0.3)
    p = p.random_iou_crop().clamp_boxes().sanitize().compose(Transform().resize(8, 8))
    told = lambda q: {r["source"]: str(r.asDict() | {"pos": 0, "batch_id": 0, "batch_pos": 0}) for r in q.execute().collect()}
    one = told(p.batch(4))
    assert one == told(replace(p, df=df.repartition(4)).batch(4)) == told(p.shuffle().batch(2)) and len(one) == 6 and one != told(p.epoch(3).batch(4))
    rows = p.shuffle().batch(4, drop_last=True).execute().collect()
    drawn = rng.fisher_yates(6, rng.combine(rng.combine(rng.Context(4, 2).root, 0), rng.op_key("StructuredShuffle"))).tolist()
    assert sorted((r["pos"], r["source"]) for r in rows) == list(enumerate(drawn))[:4] and {r["batch_id"] for r in rows} == {0}
    for bad in (
        lambda: p.five_crop(4), lambda: p.auto_augment(), lambda: p.random_apply(0.5, Transform().random_order(Transform().elastic_transform())), lambda: p.random_choice([Transform().augmix()]), lambda: p.sanitize(0.5), lambda: p.batch(0), lambda: p.batch(2).invert(),
        lambda: StructuredPipeline(df).hwc_to_chw(),
    ):
        with pytest.raises(PipelineError):
            bad()
    # images follow the image pipeline's own draws
    flips = {r["pos"]: bytes(r["image"]) for r in StructuredPipeline(df).seed(9).random_horizontal_flip().execute().collect()}
    raw = df.select("pos", "image", F.lit(0).alias("label"), "h", "w", "c")
    assert flips == {r["pos"]: bytes(r["data"]) for r in Pipeline(raw).seed(9).decode_image().random_horizontal_flip().execute().collect()}


def test_concatenated_branches(pngs):
    t = Transform()
    rows = Pipeline(pngs).seed(2).decode_image().concat([t, t.horizontal_flip(), t.random_invert()], axis=0).execute().collect()
    for r in rows:
        px = PIXELS[r["pos"]]
        got = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3)
        last = kernels.invert(px) if rng.Context(2).stream(r["source"], rng.op_key("RandomInvert")).coin(0.5) else px
        assert (got == np.concatenate([px, px[:, ::-1], last])).all()
    p = Pipeline(pngs).decode_image()
    for bad in (lambda: p.concat([t]), lambda: p.concat([t, t], axis=3), lambda: p.concat([t, t.convert_image_dtype("float32")]), lambda: p.concat([t, t.five_crop(4)]), lambda: p.five_crop(4).concat([t, t])):
        with pytest.raises(PipelineError):
            bad()


def test_strict_tensors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    for bad in (tensor.add(a, b), tensor.gather(a, F.array(F.lit(-1))), tensor.var(b), tensor.maximum(tensor.zeros(0).cast("array<double>"))):
        with pytest.raises(Exception):  # noqa: B017
            df.select(bad).collect()
    nan = spark.createDataFrame([([1.0, float("nan"), 5.0],)], "a array<double>").select(tensor.argmax(a).alias("i"), tensor.maximum(a).alias("v")).first()
    assert nan["i"] == 1 and np.isnan(nan["v"])
    with pytest.raises(Exception, match="singular"):
        df.select(linalg.triangular_solve(F.array(*[F.lit(0.0)] * 4), a, 2)).collect()
    c = df.select(linalg.addmm(F.array(F.lit(float("nan"))), F.array(F.lit(2.0)), F.array(F.lit(3.0)), 1, 1, 1, 0.0).alias("r")).first()
    assert c["r"] == [6.0]


def test_image_folder_and_parquet(spark, tmp_path):
    for i, p in enumerate(PIXELS):
        d = tmp_path / "in" / f"class{i % 2}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{i}.PNG").write_bytes(kernels.encode_png(p))
        (d / "note.txt").write_text("no image")
    rows = images.scan_image_folder(spark, str(tmp_path / "in"))
    got = rows.orderBy("pos").collect()
    assert [r["label"] for r in got] == [0, 0, 0, 1, 1, 1] and datasets.classes(str(tmp_path / "in")) == ["class0", "class1"]
    assert (kernels.decode_png(bytes(got[1]["image"])) == PIXELS[2]).all()
    decoded = images.scan_decoded_folder(spark, str(tmp_path / "in")).collect()
    assert len(decoded) == 6 and any(bytes(r["image"]) == PIXELS[3].tobytes() for r in decoded)
    one = images.read_image_batch(rows, 3, 2)
    assert one["labels"].tolist() == [0, 1, 1] and (one["images"] == np.stack([PIXELS[4], PIXELS[1], PIXELS[3]])).all()
    told = images.read_image_batch(rows, 3, 4, as_numpy=False)
    assert told["shape"] == [2, 12, 18, 3] and told["images"] == np.stack([PIXELS[3], PIXELS[5]]).tobytes() and told["labels"] == [1, 1]
    for bad in ((0, 0), (3, -1), (3, 6)):
        with pytest.raises(ValueError):
            images.read_image_batch(rows, *bad)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.png").write_bytes(b"no image at all")
    with pytest.raises(Exception, match="x.png is not an image"):
        images.scan_decoded_folder(spark, str(tmp_path / "bad")).collect()
    datasets.convert({"train": rows, "test": rows.where("pos < 2")}, str(tmp_path / "out"), "tiny")
    back = datasets.load_dataset(spark, str(tmp_path / "out"))
    assert set(back) == {"train", "test"} and back["test"].count() == 2 and back["train"].columns == ["image", "label"]
    with pytest.raises(KeyError):
        datasets.load_dataset(spark, str(tmp_path / "out"), "none")
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, str(tmp_path / "out" / "train.parquet"), "train")
    scanned = images.scan_parquet(spark, str(tmp_path / "out" / "train.parquet"), "pos")
    assert Pipeline(scanned).decode_image().resize(4, 4).execute().count() == 6


def test_paths_sort_by_their_class(spark, tmp_path):
    for name in ("a/2.png", "a/b/1.png", "a-b/9.png", "ab/0.png", "B/5.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(kernels.encode_png(PIXELS[0]))
    got = images.scan_image_folder(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["path"] for r in got] == sorted(r["path"] for r in got) and [r["pos"] for r in got] == list(range(5))
    assert {r["class"]: r["label"] for r in got} == {"B": 0, "a": 1, "a-b": 2, "ab": 3}


def test_version_one_manifests(spark, tmp_path):
    m = datasets.checked({"version": 1, "splits": {"train": {"path": "t.parquet", "num_rows": 3}}})
    assert m["name"] == "legacy-dataset" and m["splits"]["train"] == {"uri": "t.parquet", "num_rows": 3}
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "dataset.json").write_text(json.dumps({"format_version": 1, "splits": {"train": {"path": "t.parquet"}}}))
    assert datasets.load_dataset(spark, str(tmp_path), "train").count() == 3
    for bad in ({"version": 1}, {"version": 1, "splits": {"a": {}}}, {"version": 1, "splits": {"a": {"path": "../x"}}}):
        with pytest.raises(datasets.ManifestError):
            datasets.checked(bad)


@pytest.mark.parametrize("change", [{"version": 3}, {"name": ""}, {"features": {"x": {"kind": "odd", "column": "x"}}}, {"splits": {"a": {"uri": "../x", "num_rows": 1}}}, {"splits": {"a": {"uri": "http://x", "num_rows": 1}}}, {"splits": {"a": {"uri": "x"}}}])
def test_bad_manifests(change):
    good = {"version": 2, "name": "n", "features": {"i": {"kind": "image", "column": "c"}}, "splits": {"a": {"uri": "a.parquet", "num_rows": 1}}}
    assert datasets.checked(json.loads(json.dumps(good)))
    with pytest.raises(datasets.ManifestError):
        datasets.checked(good | change)


def test_arrow_files_are_one_table(spark, tmp_path):
    paths = []
    for k, n in enumerate((3, 0, 2)):
        t = pa.table({"img": pa.array([bytes([k, i]) for i in range(n)], pa.binary()), "label": pa.array(range(n), pa.int64())})
        (tmp_path / f"{9 - k}").mkdir()
        paths.append(str(tmp_path / f"{9 - k}" / "data.arrow"))  # one name in several folders
        with pa.OSFile(paths[-1], "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
    got = images.scan_arrow(spark, paths, {"img": "binary", "label": "long"}).orderBy("pos").collect()
    assert [(r["pos"], bytes(r["img"])) for r in got] == [(0, b"\0\0"), (1, b"\0\1"), (2, b"\0\2"), (3, b"\2\0"), (4, b"\2\1")]
    other = pa.table({"img": pa.array([1]), "label": pa.array([1])})
    with pa.OSFile(str(tmp_path / "z.arrow"), "wb") as f, pa.ipc.new_stream(f, other.schema) as w:
        w.write_table(other)
    with pytest.raises(ValueError, match="mismatch"):
        images.scan_arrow(spark, [*paths, str(tmp_path / "z.arrow")], {"img": "binary", "label": "long"})
    with pytest.raises(ValueError):
        images.scan_arrow(spark, [], {})

    class Cached:
        cache_files = [{"filename": p} for p in paths]
        _indices = None

    kinds = {"img": "binary", "label": "long"}
    assert images.scan_cached_dataset(spark, Cached(), kinds).count() == 5
    Cached._indices = [1, 0]
    with pytest.raises(ValueError, match="index table"):
        images.scan_cached_dataset(spark, Cached(), kinds)


def test_streams_run_the_same_stages(spark):
    from loomtide.streaming import token_rates

    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().select(F.col("timestamp").alias("ts"), F.lit("a b c").alias("text"))
    q = token_rates(stream, "text", "ts").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(once=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
    assert spark.sql("select sum(tokens) = 3 * sum(rows) ok from rates").first()["ok"] in (True, None)


VOCABULARY = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "river": 4, "stone": 5, "bright": 6, "dull": 7, "naïve": 8, "x": 9, "y": 10, "山": 11}


@pytest.fixture(scope="module")
def word_level(spark):
    from loomtide.operators.text import WordLevel

    return WordLevel(spark.createDataFrame(list(VOCABULARY.items()), "token string, id int").cache())


def test_text_is_encoded_and_collated(spark, word_level):
    from loomtide.operators import text

    df = spark.createDataFrame([(0, "River NAI\u0308VE nope", "x y", 1), (1, "bright", "dull", 0), (2, "", "y\u3000x", 1)], "pos long, text string, text_pair string, label long")
    e = word_level.encode(df)
    assert {r["pos"]: r["input_ids"] for r in e.collect()} == {0: [2, 4, 8, 1, 3], 1: [2, 6, 3], 2: [2, 3]}
    two = {r["pos"]: (r["input_ids"], r["token_type_ids"]) for r in word_level.encode(df, pair=True, max_length=6).collect()}
    assert two[0] in (([2, 4, 3, 9, 10, 3], [0, 0, 0, 1, 1, 1]), ([2, 4, 8, 3, 9, 3], [0, 0, 0, 0, 1, 1])) and two[2] == ([2, 3, 10, 9, 3], [0, 0, 1, 1, 1])
    assert {r["pos"]: r["input_ids"] for r in word_level.encode(df, max_length=3, direction="left").collect()}[0] == [2, 1, 3]
    assert {r["pos"]: r["input_ids"] for r in word_level.encode(df, add_special_tokens=False).collect()} == {0: [4, 8, 1], 1: [6], 2: []}
    assert {r["pos"]: r["text"] for r in word_level.decode(e).collect()} == {0: "river naïve", 1: "bright", 2: ""}
    assert {r["pos"]: r["text"] for r in word_level.decode(e, skip_special_tokens=False).collect()}[0] == "[CLS] river naïve [UNK] [SEP]"
    assert word_level.token_to_id("stone", "none") == {"stone": 5} and word_level.id_to_token(11, 99) == {11: "山"}
    rows = {r["pos"]: r for r in text.collate(e.join(df.select("pos", "label"), "pos"), 2, 0).collect()}
    assert rows[1]["input_ids"] == [2, 6, 3, 0, 0] and rows[1]["attention_mask"] == [1, 1, 1, 0, 0] and rows[1]["position_ids"] == [0, 1, 2, 0, 0] and len(rows[2]["input_ids"]) == 2
    causal = {r["pos"]: r["labels"] for r in text.collate(e, 2, 0, labels="causal", side="left").collect()}
    assert causal[1] == [-100, -100, 2, 6, 3]
    with pytest.raises(ValueError):
        word_level.encode(df, max_length=1)
    with pytest.raises(Exception, match="null at row 7"):
        word_level.encode(spark.createDataFrame([(7, None)], "pos long, text string")).collect()
    with pytest.raises(Exception, match="longer than"):
        text.collate(e, 2, 0, pad_to=3).collect()
    with pytest.raises(Exception, match="no token has the id 77"):
        word_level.decode(spark.createDataFrame([(0, [2, 77])], "pos long, input_ids array<int>")).collect()


def test_large_vocabularies_are_shuffled(spark, word_level, monkeypatch):
    from loomtide.operators import text

    df = spark.createDataFrame([(0, "river stone nope"), (1, "山")], "pos long, text string")
    monkeypatch.setattr(text, "MAX_TOKENS", 0)
    assert {r["pos"]: r["input_ids"] for r in word_level.encode(df).collect()} == {0: [2, 4, 5, 1, 3], 1: [2, 11, 3]}


def test_text_pipeline(spark, word_level):
    from loomtide.plans.text_pipeline import TextError, TextPipeline

    words = list(VOCABULARY)[4:]
    df = spark.createDataFrame([(i, " ".join(words[: i + 1]), i) for i in range(8)], "pos long, text string, label long")
    p = TextPipeline(df, word_level).indices([3, 0, 3, 7, 5])
    assert [r["source"] for r in p.rows().orderBy("pos").collect()] == [3, 0, 3, 7, 5]
    order = rng.fisher_yates(5, rng.combine(11, 2)).tolist()
    assert [r["source"] for r in p.shuffle(11).epoch(2).rows().orderBy("pos").collect()] == [[3, 0, 3, 7, 5][k] for k in order]
    batches = list(p.batch(2).loader())
    assert [[r["source"] for r in b] for b in batches] == [[3, 0], [3, 7], [5]] and [[len(r["input_ids"]) for r in b] for b in batches] == [[6, 6], [10, 10], [8]] and [r["label"] for r in batches[1]] == [3, 7]
    assert [len(b) for b in p.batch(2, drop_last=True).loader()] == [2, 2]
    causal = list(p.encode(max_length=4).pad(side="left", multiple=4).labels("causal").batch(5).loader())
    assert [r["labels"] for r in causal[0]][1] == [-100, 2, 4, 3]
    with pytest.raises(TextError, match="no row at index 9"):
        list(p.indices([1, 9]).loader())
    gone = TextPipeline(df.union(spark.createDataFrame([(8, None, 8)], df.schema)), word_level).batch(2).loader()
    with pytest.raises(TextError, match="null at row 8"):
        list(gone)
    assert list(gone) == []
    # nine good batches, then one error with the source rows of its batch, whatever a job takes at once
    hundred = spark.createDataFrame([(i, None if i == 95 else "stone river", i) for i in range(100)], df.schema).repartition(5)
    for at_once in (1, 30, 4096):
        good, loader = [], TextPipeline(hundred, word_level).batch(10).loader(at_once=at_once)
        with pytest.raises(TextError, match="null at row 95") as e:
            for b in loader:
                good.append([r["source"] for r in b])
        assert good == [list(range(k, k + 10)) for k in range(0, 90, 10)] and e.value.sources == list(range(90, 100)) and list(loader) == []
    with pytest.raises(TextError, match="no row at index 300") as e:
        list(TextPipeline(hundred, word_level).indices([1, 2, 300]).batch(2).loader())
    assert e.value.sources == [-301]
    for k in (0, 1):
        assert [len(b) for b in TextPipeline(df.where(f"pos < {k}"), word_level).batch(3).loader()] == [1] * k
    early = p.batch(2).loader(at_once=2)
    assert len(next(early)) == 2
    early.close()
    for bad in (lambda: p.batch(0), lambda: p.labels("odd"), lambda: p.indices([-1])):
        with pytest.raises((ValueError, IndexError)):
            bad()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 37, 1000, 100_000])
def test_shuffles_on_spark_are_the_sequential_order(spark, monkeypatch, n):
    from loomtide.operators import permutation

    want = rng.fisher_yates(n, 77).tolist()
    one = {r["new_pos"]: r["pos"] for r in permutation.order(spark, n, 77).collect()}
    monkeypatch.setattr(permutation, "ONE_TASK", 0)
    many = {r["new_pos"]: r["pos"] for r in permutation.order(spark, n, 77).collect()}
    assert many == dict(enumerate(want)) and (one == many or n > 1 << 16)


def test_draws_made_again_shift_later_steps(spark, monkeypatch):
    """With numbers of 8 bits many draws are made again; the sequential rule is written out."""
    from loomtide.operators import permutation

    state, n = 5, 60
    numbers = (permutation._numbers(state, np.arange(500)) >> np.uint64(56)) << np.uint64(56)
    again = []
    k = 0
    for i in range(n - 1, 0, -1):
        while numbers[k] < np.uint64(1 << 62):
            again.append(k)
            k += 1
        k += 1
    monkeypatch.setattr(permutation, "_again", lambda *_: np.array(again))
    got = {r["i"]: r["j"] for r in permutation.drawn(spark, n, state).collect()}
    k, want = 0, {0: 0}
    for i in range(n - 1, 0, -1):
        while k in again:
            k += 1
        want[i] = int(permutation._numbers(state, np.array([k]))[0]) % (i + 1)
        k += 1
    assert len(again) > 5 and got == want


def test_shuffles_by_selection(spark):
    from loomtide.plans import queries

    rows = spark.range(3000).select(F.col("id").alias("pos"), F.col("id").alias("source"))
    places = lambda df: {r["source"]: r["pos"] for r in df.collect()}
    drawn = rng.fisher_yates(3000, rng.Sampler(7, 1).shuffle_seed(0, 0)).tolist()
    a = places(selection.shuffle(rows, 3000, 7, 1))
    assert a == {v: k for k, v in enumerate(drawn)}
    assert a == places(selection.shuffle(rows.repartition(7), 3000, 7, 1)) != places(selection.shuffle(rows, 3000, 7, 2))
    got = queries.queries()["select_shuffle"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["pos"] for r in got) == sorted(r["vec_id"] for r in got) == list(range(500))


def test_a_vocabulary_is_made_once_and_texts_are_cut_before_they_travel(spark):
    from loomtide.operators import text
    from loomtide.operators.text import WordLevel

    runs = spark.sparkContext.accumulator(0)

    def told(batches):
        runs.add(1)
        yield from batches

    rows = spark.createDataFrame(list(VOCABULARY.items()), "token string, id int").coalesce(1)
    t = WordLevel(rows.mapInArrow(told, "token string, id int"))
    long = " River " + "stone NAÏVE 山 " * 40 + "x　"
    df = spark.createDataFrame([(0, long, "y " * 50), (1, "", "x"), (2, " dull\tx\x1cy ", " ")], "pos long, text string, text_pair string")
    whole = {r["pos"]: r["input_ids"] for r in t.encode(df, add_special_tokens=False).collect()}
    assert whole == {0: [4, *[5, 8, 11] * 40, 9], 1: [], 2: [7, 1]}
    for n in (0, 1, 2, 5, 121, 122, 123):
        for end, cut in (("right", lambda x: x[:n]), ("left", lambda x: x[max(0, len(x) - n) :])):
            assert {r["pos"]: r["input_ids"] for r in t.encode(df, add_special_tokens=False, max_length=n, direction=end).collect()} == {k: cut(x) for k, x in whole.items()}
    second = {0: [10] * 50, 1: [9], 2: []}
    for n in (0, 1, 7, 60, 200):
        for r in t.encode(df, pair=True, add_special_tokens=False, max_length=n).collect():
            a, b = list(whole[r["pos"]]), list(second[r["pos"]])
            while len(a) + len(b) > n:
                (a if len(a) > len(b) else b).pop()
            assert r["input_ids"] == a + b and r["token_type_ids"] == [0] * len(a) + [1] * len(b)
    t.decode(t.encode(df)).collect()
    assert runs.value == 1
    sent = t._texts(df, ("text",), 3, "right").collect()
    assert max(len(r["text"].split()) for r in sent) <= 4 and len(sent) == 3
    assert text.AT_ONCE > 0


def test_words_are_counted_and_looked_up_in_runs(spark, word_level, monkeypatch):
    from loomtide.functions import tokens
    from loomtide.operators import text

    b = pa.RecordBatch.from_pydict({"x": ["a" * k for k in (3, 0, 50, 7, 7, 90, 1)]})
    monkeypatch.setattr(text, "AT_ONCE", 10)
    parts = list(text.runs(b, text.n_bytes(b.column(0))))
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pydict() == b.to_pydict()
    said = ["River river\x0bSTONE", "", "  ", "ΣΟΣ Σ naïve x", "\tx x\n", "İx"] * 3
    df = spark.createDataFrame(list(enumerate(said)), "pos long, text string")
    want = df.select(F.explode(tokens.pieces(F.col("text"))).alias("token")).groupBy("token").count()
    assert sorted(text.word_counts(df).collect()) == sorted(want.collect())
    with pytest.raises(Exception, match="text is null"):
        text.word_counts(spark.createDataFrame([(0, None)], df.schema)).collect()


def test_words_are_split_without_a_pattern_and_hidden_tokens_go_by_their_place(spark, word_level):
    # every white space of Unicode parts words, and what only looks like it does not
    spaces = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    said = [f"{c}River{c}{c}stone{c}" for c in spaces] + [f"river{c}stone" for c in "\x1c\x1f᠎​⁠﻿"] + ["", " ", "　", "river"]
    df = spark.createDataFrame(list(enumerate(said)), "pos long, text string").coalesce(1)
    ids = {r["pos"]: r["input_ids"] for r in word_level.encode(df, add_special_tokens=False).collect()}
    k = len(spaces)
    assert ids == {**{i: [4, 5] for i in range(k)}, **{i: [1] for i in range(k, k + 6)}, k + 6: [], k + 7: [], k + 8: [], k + 9: [4]}
    rows = spark.createDataFrame([(0, [2, 4, None, 1, 5, 3, 0]), (1, None), (2, []), (3, [2, 3]), (4, [5])], "pos long, input_ids array<int>").coalesce(1)
    assert {r["pos"]: r["text"] for r in word_level.decode(rows).collect()} == {0: "river stone", 1: "", 2: "", 3: "", 4: "stone"}
    whole = {r["pos"]: r["text"] for r in word_level.decode(rows, skip_special_tokens=False).collect()}
    assert whole == {0: "[CLS] river [UNK] stone [SEP] [PAD]", 1: "", 2: "", 3: "[CLS] [SEP]", 4: "stone"}


def test_a_task_tells_each_word_once(monkeypatch):
    from collections import Counter

    from loomtide.operators import text

    texts = [f"The the {'abcdefg'[k % 7]} {'XyZ'[k % 3]}\tÄ{k % 5} \n" for k in range(90)] + ["", "  "]
    batches = [pa.RecordBatch.from_pydict({"text": texts[k : k + 40]}) for k in range(0, len(texts), 40)]
    want = Counter(w.replace("T", "t").replace("X", "x").replace("Z", "z") for t in texts for w in t.split())
    monkeypatch.setattr(text, "AT_ONCE", 100)
    for most, once in ((1 << 20, True), (4, False), (12, False)):
        monkeypatch.setattr(text, "MAX_KEPT", most)
        got = [r for b in text.counted(iter(batches)) for r in b.to_pylist()]
        assert (len(got) == len(want)) == once or most == 12
        assert sum((Counter({r["token"]: r["n"]}) for r in got), Counter()) == want
    assert list(text.counted(iter([]))) == [] and not any(b.num_rows for b in text.counted(iter(batches[:0])))
