"""PNG and JPEG files against written-out scanlines and the JVM's codec."""

import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.operators import codecs, jpeg, kernels, png
from loomtide.plans.pipeline import Pipeline, PipelineError, Transform

RNG = np.random.default_rng(21)


def png_file(w, h, depth, colour, lines, palette=b"", interlaced=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)
    return png.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def packed(samples, depth):
    """Scanlines without filters of (h, w, c) samples of 1 to 16 bits."""
    h, w, c = samples.shape
    bits = ((samples.reshape(h, w * c, 1) >> np.arange(depth)[::-1]) & 1).reshape(h, -1).astype(np.uint8)
    return b"".join(b"\0" + np.packbits(row).tobytes() for row in bits)


@pytest.mark.parametrize(("depth", "colour"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (1, 3), (2, 3), (4, 3), (8, 3), (8, 4), (16, 4), (8, 6), (16, 6)])
@pytest.mark.parametrize("interlaced", [0, 1])
def test_png_kinds(depth, colour, interlaced):
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    palette = RNG.integers(0, 256, (1 << min(depth, 8), 3), dtype=np.uint8)
    files, wants = [], []
    for h, w in ((1, 1), (2, 3), (9, 13), (16, 5)):
        samples = RNG.integers(0, 1 << depth, (h, w, n))
        if interlaced:
            parts = [samples[y::dy, x::dx] for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))]
            lines = b"".join(packed(p, depth) for p in parts if p.size)
        else:
            lines = packed(samples, depth)
        files.append(png_file(w, h, depth, colour, lines, palette.tobytes() if colour == 3 else b"", interlaced))
        if colour == 3:
            wants.append(palette[samples[..., 0]])
        else:
            eight = np.array([[[(int(v) * 255 * 2 + (1 << depth) - 1) // (2 * ((1 << depth) - 1)) for v in px] for px in row] for row in samples])
            wants.append(eight[..., :3] if n > 2 else np.repeat(eight[..., :1], 3, 2))
    for got, want in zip(png.decode(files), wants, strict=True):
        assert got.dtype == np.uint8 and np.array_equal(got, want)


def test_damaged_files():
    good = png.encode(RNG.integers(0, 256, (4, 4, 3), dtype=np.uint8))
    for bad in (b"", b"GIF89a", good[:40], good[:-30], png_file(2, 2, 3, 0, b"\0\0\0\0"), png_file(2, 2, 8, 3, b"\0\0\0\0\0\0"), png_file(2, 2, 8, 0, b"\7\0\0\0\0\0"), png_file(2, 2, 8, 0, b"\0\0\0"), b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc9\x00\x0b" + bytes(9)):
        with pytest.raises(ValueError):
            codecs.decode([bad])


def test_worst_filters_are_quick():
    """Rows that look left in another way each, at 224 x 224: together with others."""
    lines = b"".join(bytes([4 if y % 2 else 1]) + RNG.integers(0, 256, 672, dtype=np.uint8).tobytes() for y in range(224))
    file = png_file(224, 224, 8, 2, lines)
    began = time.process_time()
    png.decode([file] * 32)
    assert (time.process_time() - began) / 32 < 0.03  # about 5 ms on an idle core


class Jvm:
    def __init__(self, spark):
        self.jvm = spark._jvm

    def encode(self, px, quality, progressive=False):
        h, w, c = px.shape
        image = self.jvm.java.awt.image.BufferedImage
        im = image(w, h, image.TYPE_BYTE_GRAY if c == 1 else image.TYPE_3BYTE_BGR)
        im.getRaster().setDataElements(0, 0, w, h, px.tobytes())
        writer = self.jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        param = writer.getDefaultWriteParam()
        param.setCompressionMode(2)  # explicit
        param.setCompressionQuality(quality / 100)
        if progressive:
            param.setProgressiveMode(1)  # the default scans
        out = self.jvm.java.io.ByteArrayOutputStream()
        stream = self.jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, self.jvm.javax.imageio.IIOImage(im, None, None), param)
        stream.flush()
        return bytes(out.toByteArray())

    def decode(self, data):
        im = self.jvm.javax.imageio.ImageIO.read(self.jvm.java.io.ByteArrayInputStream(data))
        h, w = im.getHeight(), im.getWidth()
        px = np.frombuffer(bytes(im.getRaster().getDataBuffer().getData()), np.uint8).reshape(h, w, -1)
        return px[..., ::-1] if px.shape[2] == 3 else np.repeat(px, 3, 2)


@pytest.fixture(scope="module")
def jvm(spark):
    return Jvm(spark)


def picture(h, w, c=3):
    y, x = np.mgrid[:h, :w]
    px = np.stack([128 + 90 * np.sin(x / 5) + y / 4, 100 + 80 * np.cos(y / 7), x / 2 + RNG.integers(0, 60, (h, w))], -1)
    return np.clip(px, 0, 255).astype(np.uint8)[..., :c]


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("c", [1, 3])
def test_jpeg_decoding_equals_the_jvm(jvm, progressive, c):
    for h, w in ((1, 1), (8, 8), (5, 3), (16, 31), (33, 40), (90, 130)):
        for quality in (1, 10, 50, 90, 100):
            px = picture(h, w, c)
            data = jvm.encode(px, quality, progressive)
            want = jvm.decode(data)
            assert codecs.size(data) == (h, w) and np.array_equal(codecs.decode([data])[0], want)
            # the augmentation is what encoding and decoding do
            assert np.array_equal(jpeg.compressed(px[None], quality)[0], want[..., :c])


def test_jpeg_restarts_and_samplings():
    """Files without a codec: all blocks flat, with restart markers, in every sampling."""
    code = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    dc = b"\xff\xc4" + struct.pack(">HB", 3 + len(code), 0) + code
    ac = b"\xff\xc4" + struct.pack(">HB", 3 + 17, 16) + bytes([1, *[0] * 15]) + b"\0"  # one code: no more coefficients

    def flat(levels, samplings, mcus, interval):
        """A file whose MCU k is flat at level[k % n] of 8 steps of 16 each, from 128."""
        head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([16] * 64)
        w, h = 8 * max(a for a, _ in samplings) * mcus, 8 * max(b for _, b in samplings)
        head += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(samplings), 8, h, w, len(samplings)) + b"".join(bytes([i, a << 4 | b, 0]) for i, (a, b) in enumerate(samplings, 1))
        head += dc + ac + (b"\xff\xdd" + struct.pack(">HH", 4, interval) if interval else b"")
        head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(samplings), len(samplings)) + b"".join(bytes([i, 0]) for i in range(1, 1 + len(samplings))) + b"\0\x3f\0"
        codes = {s: format(k, f"0{n}b") for s, (k, n) in enumerate([(0, 2), (2, 3), (3, 3), (4, 3), (5, 3), (6, 3), (14, 4)])}
        out, bits, last = head, "", [0] * len(samplings)
        for m in range(mcus):
            if interval and m and m % interval == 0:
                bits += "1" * (-len(bits) % 8)
                out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
                bits, last = "", [0] * len(samplings)
            for i, (a, b) in enumerate(samplings):
                for _ in range(a * b):
                    v = levels[m % len(levels)] if i == 0 else 0
                    d, last[i] = v - last[i], v
                    n = abs(d).bit_length()
                    bits += codes[n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
        bits += "1" * (-len(bits) % 8)
        return out + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + b"\xff\xd9"

    for samplings in ([(1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(4, 1), (1, 1), (2, 1)]):
        for interval in (0, 1, 3):
            px = jpeg.decode(flat([3, -9, 20, 20, 0], samplings, 7, interval))
            step = px.shape[1] // 7
            for m in range(7):
                assert (px[:, m * step : (m + 1) * step] == 128 + 2 * [3, -9, 20, 20, 0][m % 5]).all()
    with pytest.raises(ValueError, match="ends early"):
        jpeg.decode(flat([3, -9, 20], [(1, 1)], 400, 0)[:-90])


def test_jpeg_in_pipelines(spark, jvm):
    images = [picture(24, 24 + i % 2) for i in range(8)]
    files = [png.encode(px) if i % 2 else jvm.encode(px, 90, i % 4 == 2) for i, px in enumerate(images)]
    df = spark.createDataFrame([(i, bytearray(x), i) for i, x in enumerate(files)], "pos long, image binary, label long").repartition(3)
    rows = lambda p: {r["source"]: np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3) for r in p.execute().collect()}
    got = rows(Pipeline(df).decode_image())
    assert all(np.array_equal(got[i], images[i] if i % 2 else jvm.decode(files[i])) for i in range(8))
    low, high = rows(Pipeline(df).decode_image().jpeg(10)), rows(Pipeline(df).decode_image().jpeg([100, 100]))
    assert all(np.array_equal(low[i], jpeg.compressed(got[i][None], 10)[0]) and not np.array_equal(low[i], high[i]) for i in range(8))
    drawn = lambda epoch, parts: rows(Pipeline(df.repartition(parts)).seed(2).epoch(epoch).decode_image().compose(Transform().jpeg([10, 95])))
    a, b, c = drawn(0, 1), drawn(0, 3), drawn(1, 3)
    assert all(np.array_equal(a[i], b[i]) for i in range(8)) and any(not np.array_equal(a[i], c[i]) for i in range(8))
    for bad in (0, 101, [80], [80, 20], [0, 5], "80"):
        with pytest.raises(PipelineError):
            Pipeline(df).decode_image().jpeg(bad)
    with pytest.raises(PipelineError):
        Pipeline(df).decode_image().to_dtype("float32").jpeg(80)
    with pytest.raises(ValueError):
        jpeg.compressed(np.zeros((1, 4, 4, 2), np.uint8), 50)


def test_images_are_dealt_by_their_number(spark, tmp_path):
    """More rows go to more tasks, and what is shuffled are vectors, not images."""
    from loomtide.plans import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    shifted = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("again")
    rows.select("*", shifted).withColumn("vec_id", F.col("vec_id") + 1000 * F.col("again")).drop("again").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert rows.count() * 30 > 8192
    few, many = (queries.queries()["pipeline_imagenet"](spark, d) for d in ("/root/testdata/sf0.001", str(tmp_path)))
    assert few.rdd.getNumPartitions() == 16 < many.rdd.getNumPartitions()
    exchange = next(x for x in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in x)
    below = many._jdf.queryExecution().optimizedPlan().toString().split(exchange)[1]
    assert "image" not in below


def test_hue_goes_in_blocks(monkeypatch):
    """The same bytes whatever a block takes, for one turn and one each, and the plain rule by pixel."""
    px = np.random.default_rng(5).integers(0, 256, (3, 9, 11, 3), dtype=np.uint8)
    px[0, 0, :, 1:] = px[0, 0, :, :1]  # greys
    f = np.array([0.2, -0.4, 0.0], np.float32)
    whole = kernels.hue(px, f)
    monkeypatch.setattr(kernels, "HUE_PIXELS", 10)
    assert (kernels.hue(px, f) == whole).all() and all((kernels.hue(px[i], float(f[i])) == whole[i]).all() for i in range(3))
    for p, q in zip(px[0].reshape(-1, 3).astype(float).tolist(), whole[0].reshape(-1, 3).tolist(), strict=True):
        hi, lo = max(p), min(p)
        h8, s8 = 0, int(np.float32((hi - lo) * 255) / np.float32(hi or 1))
        if hi > lo:
            r, g, b = ((np.float32(hi) - np.float32(x)) / np.float32(hi - lo) for x in p)
            h = (b - g if p[0] == hi else np.float32(2) + r - b if p[1] == hi else np.float32(4) + g - r) / np.float32(6) + np.float32(1)
            h8 = min(255, int((h - np.floor(h)) * np.float32(255)))
        x = np.float32((h8 + int(np.float32(0.2) * 255)) & 255) * np.float32(6) / np.float32(255)
        s, t = np.float32(s8) / np.float32(255), float(x) - np.floor(x)
        near = lambda z: int(hi * float(z) + 0.5)
        v, a, b, c = int(hi), near(1 - s), near(1 - s * t), near(1 - s * (1 - t))
        assert q == list([(v, c, a), (b, v, a), (a, v, c), (a, b, v), (c, a, v), (v, a, b)][int(x) % 6])


def test_plain_files_are_one_array_and_events_are_dealt(spark, tmp_path, monkeypatch):
    from loomtide.plans import queries

    rng = np.random.default_rng(8)
    images = [rng.integers(0, 256, (h, w, c), dtype=np.uint8) for h, w, c in ((5, 7, 3), (5, 7, 3), (5, 7, 4), (9, 2, 3), (5, 7, 1), (5, 7, 3))]
    files = [png.encode(x) for x in images]
    rows = np.concatenate([np.arange(5, dtype=np.uint8).reshape(5, 1), images[0].reshape(5, 21)], axis=1)  # all kinds of filters
    files.append(png_file(7, 5, 8, 2, rows.tobytes()))
    want = [png._decoded([x])[0] for x in files]
    alone, seen = png._decoded, []
    monkeypatch.setattr(png, "_decoded", lambda some: seen.extend(some) or alone(some))
    got = png.decode(files)
    assert all(a.shape == b.shape and (a == b).all() for a, b in zip(got, want, strict=True)) and seen == [files[4]]
    bad = bytearray(rows.tobytes())
    bad[22] = 5
    for lines, said in ((bytes(bad), "filter that is not known"), (rows.tobytes()[:-1], "ends early")):
        with pytest.raises(ValueError, match=said):
            png.decode([files[0], png_file(7, 5, 8, 2, lines)])
    with pytest.raises(ValueError, match="damaged"):
        png.decode([files[0][:45] + b"\xff\xff" + files[0][47:]])
    spark.range(300_000).selectExpr("id as event_id", "'{}' as props", "id as user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert queries.queries()["pipeline_cifar_png"](spark, str(tmp_path)).rdd.getNumPartitions() == 19
