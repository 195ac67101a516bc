"""Colour, representation and geometry of small images as native expressions on flat array<int> (uint8, HWC) columns.

Integer rules are integer arithmetic; the factor rules are float32 and truncate, so results do not depend on the engine's
double arithmetic. Whole-image kernels for decoded binaries are in operators.kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import at, built, let


def _f(x: float | Column) -> Column:
    return F.lit(x).cast("float") if isinstance(x, int | float) else x.cast("float")


def from_unit(e: Column) -> Column:
    """uint8 pixels of values in [-1, 1]."""
    return F.transform(e, lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))


def rgb(px: Column, pixels: int, channels: int) -> Column:
    """Three channels: one or two repeat the luminance, four lose alpha."""
    if channels == 3:
        return px
    return built(3 * pixels, lambda k: at(px, (k / 3).cast("int") * channels + (k % 3 if channels == 4 else F.lit(0))))


def luma_of(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)


def luma(px: Column, pixels: int) -> Column:
    return built(pixels, lambda k: luma_of(at(px, 3 * k), at(px, 3 * k + 1), at(px, 3 * k + 2)))


def blend(v: Column, base: Column, factor: float) -> Column:
    """base + factor * (v - base) in float32, clamped, truncated."""
    x = _f(base) + _f(factor) * (_f(v) - _f(base))
    return F.least(F.greatest(x, _f(0.0)), _f(255.0)).cast("int")


def brightness(px: Column, factor: float) -> Column:
    return F.transform(px, lambda v: blend(v, F.lit(0), factor))


def contrast(px: Column, pixels: int, factor: float) -> Column:
    mean = F.floor(F.aggregate(luma(px, pixels), F.lit(0).cast("long"), lambda s, v: s + v).cast("double") / pixels + 0.5)
    return let(mean, lambda m: F.transform(px, lambda v: blend(v, m, factor)))


def saturation(px: Column, pixels: int, factor: float) -> Column:
    return let(luma(px, pixels), lambda y: F.transform(px, lambda v, k: blend(v, at(y, (k / 3).cast("int")), factor)))


def gamma(px: Column, g: float, gain: float = 1.0) -> Column:
    return F.transform(px, lambda v: F.least(F.greatest((256 - 1e-3) * gain * F.pow(v / F.lit(255.0), F.lit(float(g))), F.lit(0.0)), F.lit(255.0)).cast("int"))


def grayscale(px: Column, pixels: int, channels: int = 1) -> Column:
    y = luma(px, pixels)
    return y if channels == 1 else let(y, lambda z: built(pixels * channels, lambda k: at(z, (k / channels).cast("int"))))


def invert(px: Column) -> Column:
    return F.transform(px, lambda v: 255 - v)


def posterize(px: Column, bits: int) -> Column:
    mask = (0xFF << (8 - bits)) & 0xFF if bits else 0
    return F.transform(px, lambda v: v.bitwiseAND(F.lit(mask)))


def solarize(px: Column, threshold: int) -> Column:
    return F.transform(px, lambda v: F.when(v >= threshold, 255 - v).otherwise(v))


def channel(px: Column, c: int, channels: int = 3) -> Column:
    return F.filter(px, lambda v, k: k % channels == c)


def autocontrast(px: Column, channels: int = 3) -> Column:
    """(v - low) * 255 div (high - low) by channel; a flat channel stays."""
    ends = F.array(*[F.struct(F.array_min(channel(px, c, channels)).alias("lo"), F.array_max(channel(px, c, channels)).alias("hi")) for c in range(channels)])

    def one(v: Column, k: Column, e: Column) -> Column:
        lo, hi = at(e, k % channels)["lo"], at(e, k % channels)["hi"]
        return F.when(hi == lo, v).otherwise(F.floor((v - lo) * 255 / F.when(hi == lo, F.lit(1)).otherwise(hi - lo)).cast("int"))

    return let(ends, lambda e: F.transform(px, lambda v, k: one(v, k, e)))


def equalize(px: Column, channels: int = 3) -> Column:
    """Histogram equalisation by channel: step = (pixels below the largest value) div 255; 0 leaves the channel."""

    def table(ch: Column) -> Column:
        """What each of the 256 values becomes."""
        below = let(ch, lambda x: F.transform(F.sequence(F.lit(0), F.lit(256)), lambda v: F.size(F.filter(x, lambda y: y < v))))
        # all but the pixels of the largest value: the greatest count below a value that is not yet the whole
        step = lambda b: F.floor(F.array_max(F.filter(b, lambda n: n < at(b, 256))) / 255).cast("int")
        moved = lambda b, s: F.transform(b, lambda n, v: F.when(s == 0, v).otherwise(F.least(F.floor((F.floor(s / 2) + n) / F.when(s == 0, F.lit(1)).otherwise(s)), F.lit(255)).cast("int")))
        return let(below, lambda b: let(step(b), lambda s: moved(b, s)))

    return let(F.array(*[table(channel(px, c, channels)) for c in range(channels)]), lambda e: F.transform(px, lambda v, k: at(at(e, k % channels), v.cast("int"))))


def normalize(px: Column, mean: list[float], std: list[float]) -> Column:
    """uint8 to float32 as one affine step by channel: v * (1 / (255 std)) + (-mean / std)."""
    import numpy as np

    c = len(mean)
    scale = [float(np.float32(1) / (np.float32(255) * np.float32(s))) for s in std]
    bias = [float(-np.float32(m) / np.float32(s)) for m, s in zip(mean, std, strict=True)]
    a, b = (F.array(*[_f(v) for v in vs]) for vs in (scale, bias))
    return F.transform(px, lambda v, k: _f(v) * at(a, k % c) + at(b, k % c))


def to_float(px: Column) -> Column:
    return F.transform(px, lambda v: (_f(v) / _f(255.0)).cast("float"))


def to_uint8(x: Column) -> Column:
    """float32 to uint8: truncation of v * (256 - 1e-3), modulo 256; what is not finite gives 0."""
    return F.transform(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0)).otherwise(F.pmod((v * _f(256 - 1e-3)).cast("long"), F.lit(256)).cast("int")))


def hwc_to_chw(px: Column, pixels: int, channels: int = 3) -> Column:
    return built(pixels * channels, lambda k: at(px, (k % pixels) * channels + (k / pixels).cast("int")))


def chw_to_hwc(px: Column, pixels: int, channels: int = 3) -> Column:
    return built(pixels * channels, lambda k: at(px, (k % channels) * pixels + (k / channels).cast("int")))


def permute_channels(px: Column, order: list[int]) -> Column:
    c = len(order)
    idx = F.array(*[F.lit(o) for o in order])
    return F.transform(px, lambda v, k: at(px, k - k % c + at(idx, k % c)))


def linear_transform(x: Column, matrix: list[list[float]], mean: list[float]) -> Column:
    """(x - mean) by a square matrix; x is float, flat in CHW order."""
    n = len(mean)
    centred = F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda p, q: p - q)
    cols = [F.array(*[F.lit(float(matrix[i][j])) for i in range(n)]) for j in range(n)]
    return let(centred, lambda z: F.array(*[F.aggregate(F.zip_with(z, c, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p) for c in cols]))


def crop(px: Column, h: int, w: int, x: int, y: int, cw: int, ch: int, channels: int = 3) -> Column:
    """The window at (x, y); beyond the image it is 0."""

    def one(k: Column) -> Column:
        i, j, c = (k / (cw * channels)).cast("int") + y, (k / channels).cast("int") % cw + x, k % channels
        return F.when((i < h) & (j < w) & (i >= 0) & (j >= 0), at(px, (i * w + j) * channels + c)).otherwise(F.lit(0))

    return built(ch * cw * channels, one)


def center_offset(d: int) -> int:
    """Half of the difference, ties to even."""
    return d // 2 + (d % 4 == 3)


def center_crop(px: Column, h: int, w: int, cw: int, ch: int, channels: int = 3) -> Column:
    return crop(px, h, w, center_offset(w - cw), center_offset(h - ch), cw, ch, channels)


def five_crop(px: Column, h: int, w: int, cw: int, ch: int, channels: int = 3) -> Column:
    """The four corners and the centre, as an array to explode with its view number."""
    if cw > w or ch > h:
        raise ValueError("crop is larger than the image")
    spots = [(0, 0), (w - cw, 0), (0, h - ch), (w - cw, h - ch), (center_offset(w - cw), center_offset(h - ch))]
    return F.array(*[crop(px, h, w, x, y, cw, ch, channels) for x, y in spots])


def horizontal_flip(px: Column, h: int, w: int, channels: int = 3) -> Column:
    def one(k: Column) -> Column:
        row, col = (k / (w * channels)).cast("int"), (k / channels).cast("int") % w
        return at(px, (row * w + (w - 1 - col)) * channels + k % channels)

    return built(h * w * channels, one)


def vertical_flip(px: Column, h: int, w: int, channels: int = 3) -> Column:
    return built(h * w * channels, lambda k: at(px, (h - 1 - (k / (w * channels)).cast("int")) * (w * channels) + k % (w * channels)))


def ten_crop(px: Column, h: int, w: int, cw: int, ch: int, vertical: bool = False, channels: int = 3) -> Column:
    turned = vertical_flip(px, h, w, channels) if vertical else horizontal_flip(px, h, w, channels)
    return F.concat(five_crop(px, h, w, cw, ch, channels), let(turned, lambda p: five_crop(p, h, w, cw, ch, channels)))


def pad(px: Column, h: int, w: int, sides: tuple[int, int, int, int], mode: str = "constant", fill: int = 0, channels: int = 3) -> Column:
    """sides: left, top, right, bottom. Modes: constant, edge, reflect (without the edge), symmetric (with it)."""
    left, top, right, bottom = sides
    nw, nh = w + left + right, h + top + bottom

    def source(i: Column, n: int) -> Column:
        if mode == "reflect":
            m = F.pmod(i, F.lit(max(1, 2 * (n - 1))))
            return F.least(m, 2 * (n - 1) - m)
        if mode == "symmetric":
            m = F.pmod(i, F.lit(2 * n))
            return F.least(m, 2 * n - 1 - m)
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))

    def one(k: Column) -> Column:
        i, j, c = (k / (nw * channels)).cast("int") - top, (k / channels).cast("int") % nw - left, k % channels
        inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        value = at(px, (source(i, h) * w + source(j, w)) * channels + c)
        return F.when(inside, value).otherwise(F.lit(min(255, max(0, int(fill))))) if mode == "constant" else value

    return built(nh * nw * channels, one)


def soft_labels(label: Column, classes: int) -> Column:
    """One-hot; a label out of range is an error."""
    hot = built(classes, lambda k: (k == label).cast("double"))
    return F.when((label >= 0) & (label < classes), hot).otherwise(F.raise_error(F.lit("label is out of range")))


def mixed(prev: Column, cur: Column, lam: Column) -> Column:
    """prev * (1 - lam) + cur * lam, elementwise."""
    return F.zip_with(prev, cur, lambda p, c: p * (1 - lam) + c * lam)
