"""Stacked batches, files cut by bytes, and frames along any axis."""

import numpy as np
import pytest

from loomtide.operators import kernels, video
from loomtide.plans.pipeline import Pipeline, PipelineError, to_numpy
from loomtide.sources import datasets

RNG = np.random.default_rng(17)


def test_batches_are_stacked_where_they_are_made(spark, monkeypatch):
    from loomtide.plans import pipeline

    monkeypatch.setattr(pipeline, "TASK_ROWS", 8)
    images = [RNG.integers(0, 256, (6 + (i // 4) % 2, 5, 3), dtype=np.uint8) for i in range(21)]
    df = spark.createDataFrame([(i, bytearray(kernels.encode_png(x)), i) for i, x in enumerate(images)], "pos long, image binary, label long").repartition(5)
    p = Pipeline(df).shuffle(3).decode_image().resize(4, 4).batch(4)
    rows = p.stacked().collect()
    assert [r["batch_id"] for r in rows] == list(range(6)) and [r["n"] for r in rows] == [4] * 5 + [1]
    one_by_one = sorted(p.execute().collect(), key=lambda r: (r["batch_id"], r["batch_pos"]))
    assert b"".join(bytes(r["data"]) for r in rows) == b"".join(bytes(r["data"]) for r in one_by_one)
    assert [s for r in rows for s in r["sources"]] == [r["source"] for r in one_by_one]
    plan = p.stacked()._jdf.queryExecution().toString()
    assert "Sort [batch_id" in plan and plan.index("MapInArrow") < plan.index("Sort [batch_id")  # what is sorted is encoded
    views = list(to_numpy(Pipeline(df).take(3).decode_image().five_crop(2).batch(2)))
    assert [v["images"].shape for v in views] == [(10, 2, 2, 3), (5, 2, 2, 3)] and views[0]["labels"].tolist() == [0] * 5 + [1] * 5
    with pytest.raises(Exception, match="images of a batch differ"):
        Pipeline(df).decode_image().batch(8).stacked().collect()
    assert len(Pipeline(df).decode_image().batch(4).stacked().collect()) == 6  # each batch has one shape of its own
    with pytest.raises(PipelineError):
        Pipeline(df).decode_image().stacked()
    assert Pipeline(df).take(0).decode_image().batch(4).stacked().collect() == []


@pytest.mark.parametrize("placed", [True, False])
def test_files_are_cut_by_bytes(spark, tmp_path, placed):
    sizes = [100] * 50 + [5000] + [100] * 50
    df = spark.createDataFrame([(i, bytearray(RNG.bytes(n)), i % 3) for i, n in enumerate(sizes)], "pos long, image binary, label int").repartition(4)
    df = df if placed else df.drop("pos")
    datasets.convert({"train": df}, str(tmp_path / "d"), "n", most_bytes=10_000, max_rows=45)
    files = [spark.read.parquet(str(f)).collect() for f in sorted((tmp_path / "d" / "train.parquet").glob("part-*.parquet"))]
    assert sum(map(len, files)) == 101 and all(len(f) <= 45 and sum(len(r["image"]) for r in f) <= 10_000 for f in files)
    assert len(files) <= 5  # one large image makes the others no smaller
    if placed:
        assert sorted(r["pos"] for f in files for r in f) == list(range(101)) and all([r["pos"] for r in f] == sorted(r["pos"] for r in f) for f in files)


def test_frames_along_any_axis(spark):
    frames = np.arange(60, dtype=np.uint8).reshape(5, 3, 4, 1)
    for n in (1, 2, 3, 5, 8):
        at = video.places(5, n).tolist()
        for axis in range(4):
            x = np.moveaxis(frames, 0, axis)
            df = spark.createDataFrame([(bytearray(x.tobytes()), list(x.shape), "uint8", "k")], "data binary, shape array<int>, dtype string, other string")
            for dim in (axis, axis - 4):
                (r,) = video.subsample(df, n, dim).collect()
                assert np.array_equal(np.frombuffer(r["data"], np.uint8).reshape(r["shape"]), x.take(at, axis)) and r["other"] == "k"
    assert video.places(5, 3).tolist() == [0, 2, 4] and video.places(5, 1).tolist() == [0] and video.places(2, 5).tolist() == [0, 0, 0, 0, 1]
    with pytest.raises(Exception, match="axis 7"):
        video.subsample(df, 2, 7).collect()
    with pytest.raises(ValueError):
        video.subsample(df, 0)


def test_video_samples_keep_their_times(spark):
    kind = "data binary, shape array<int>, dtype string, layout string, timestamps array<double>, label long"
    row = lambda x, layout, t: (bytearray(x.tobytes()), list(x.shape), str(x.dtype), layout, t, 7)
    thwc = np.arange(180, dtype=np.uint8).reshape(5, 3, 4, 3)
    times = [0.2 * k for k in range(5)]
    df = spark.createDataFrame([row(thwc, "THWC", times), row(thwc.transpose(0, 3, 1, 2).copy(), "TCHW", times), row(thwc.astype(np.float32), "THWC", None)], kind)
    a, b, c = video.sample_videos(df, 3).collect()
    at = video.places(5, 3)
    assert np.array_equal(np.frombuffer(a["data"], np.uint8).reshape(a["shape"]), thwc[at]) and a["timestamps"] == b["timestamps"] == [times[i] for i in at]
    assert np.array_equal(np.frombuffer(b["data"], np.uint8).reshape(b["shape"]).transpose(0, 2, 3, 1), thwc[at]) and c["timestamps"] is None and c["label"] == 7
    for bad in (row(thwc, "THWC", times[:4]), row(thwc, "THWC", times[::-1]), row(thwc, "THWC", [*times[:4], float("nan")]), row(thwc, "CTHW", times), row(thwc.reshape(15, 4, 3), "THWC", None), row(thwc.astype(np.int64), "THWC", None)):
        with pytest.raises(Exception, match="timestamps must|a video needs"):
            video.sample_videos(spark.createDataFrame([bad], kind), 2).collect()


def test_windows_by_overlap_check_their_options(spark):
    from loomtide.operators import structured
    from loomtide.plans.structured_pipeline import StructuredPipeline

    p = StructuredPipeline(spark.range(1).selectExpr("id as pos"))
    for bad in ({"high": 1.5}, {"low": 0.0}, {"low": 0.9, "high": 0.5}, {"min_ratio": 0.0}, {"trials": 0}, {"max_attempts": 0}, {"options": ()}, {"options": (-0.1,)}, {"options": (float("nan"),)}):
        with pytest.raises(PipelineError):
            p.random_iou_crop(**bad)
    assert p.random_iou_crop(low=0.5).steps
    boxes = np.array([[1.1, 2.2, 5.3, 6.7], [0, 0, 9, 9]], np.float32)
    for (x0, y0, x1, y1), got in zip(boxes, structured._overlaps(boxes, 2, 1, 5, 4), strict=True):
        f = np.float32
        both = float(max(min(x1, f(7)) - max(x0, f(2)), f(0)) * max(min(y1, f(5)) - max(y0, f(1)), f(0)))
        assert got == both / (float((x1 - x0) * (y1 - y0)) + 20.0 - both)


@pytest.mark.parametrize("kind", ["mixup", "cutmix"])
def test_mixing_of_stacked_batches_equals_that_of_rows(spark, kind):
    images = [RNG.integers(0, 256, (6, 5, 3), dtype=np.uint8) for _ in range(11)]
    df = spark.createDataFrame([(i, bytearray(kernels.encode_png(x)), i % 3) for i, x in enumerate(images)], "pos long, image binary, label long").repartition(3)
    p = Pipeline(df).seed(4).epoch(1).shuffle().decode_image().convert_image_dtype("float32")
    for q in (p.batch(4), p.hwc_to_chw().batch(3)):
        rows = sorted(getattr(q, kind)(3, 0.7).collect(), key=lambda r: (r["batch_id"], r["batch_pos"]))
        whole = getattr(q, kind)(3, 0.7, stacked=True).collect()
        assert b"".join(bytes(r["data"]) for r in whole) == b"".join(bytes(r["data"]) for r in rows)
        assert [x for r in whole for x in r["soft_labels"]] == [r["soft_label"] for r in rows]
    with pytest.raises(Exception, match="out of range"):
        getattr(p.batch(4), kind)(2, stacked=True).collect()
