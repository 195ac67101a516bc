"""Image kernels on NumPy arrays, HWC, uint8 or float32. They run inside Arrow batches; Spark deals the rows.

uint8 rules are integer or float32 arithmetic with truncation, and resampling is the separable fixed-point one, so
results do not depend on batch or partition."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from . import png

Image = np.ndarray


def decode_png(data: bytes) -> Image:
    """RGB of one PNG file; ``png.decode`` takes many at once."""
    return png.decode([data])[0]


encode_png = png.encode


def rgb(px: Image) -> Image:
    c = px.shape[2]
    if c == 3:
        return px
    return px[:, :, :3].copy() if c == 4 else np.repeat(px[:, :, :1], 3, axis=2)


# resampling


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


def _sinc(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 1.0, np.sin(np.pi * x) / np.where(x == 0, 1.0, np.pi * x))


FILTERS = {
    "box": (0.5, lambda x: ((x > -0.5) & (x <= 0.5)).astype(float)),
    "bilinear": (1.0, lambda x: np.maximum(0.0, 1 - np.abs(x))),
    "hamming": (1.0, lambda x: np.where(np.abs(x) < 1, _sinc(x) * (0.54 + 0.46 * np.cos(np.pi * x)), 0.0)),
    "bicubic": (2.0, _cubic),
    "lanczos3": (3.0, lambda x: np.where(np.abs(x) < 3, _sinc(x) * _sinc(x / 3), 0.0)),
}
_PRECISION = 22


@lru_cache(512)
def taps(n: int, out: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(first source place, weights) by output place, the weights as rows of one length that sum to 1. Shrinking widens the
    filter's support."""
    support, f = FILTERS[kind]
    scale = n / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    low = np.maximum(0, (centre - support * wide + 0.5).astype(np.int64))
    high = np.minimum(n, (centre + support * wide + 0.5).astype(np.int64))
    at = np.arange(int((high - low).max()))
    v = f((low[:, None] + at - centre[:, None] + 0.5) / wide)
    v = np.where(at < (high - low)[:, None], v, 0.0)
    total = np.cumsum(v, axis=1)[:, -1:]
    return low, v / np.where(total == 0, 1.0, total)


#: Taps up to which a pass adds shifted copies; with more of them one matrix product is faster.
FEW_TAPS = 24


def _pass(px: Image, n: int, axis: int, kind: str) -> Image:
    """One direction; uint8 in fixed point with rounding, float32 as it is."""
    size = px.shape[axis]
    if size == n:
        return px
    low, w = taps(size, n, kind)
    if px.dtype == np.uint8:
        w = np.where(w < 0, np.ceil(w * (1 << _PRECISION) - 0.5), np.floor(w * (1 << _PRECISION) + 0.5))
    if w.shape[1] <= FEW_TAPS:
        w = (w.astype(np.int32) if px.dtype == np.uint8 else w).reshape(n, -1, *[1] * (px.ndim - 1 - axis))
        out = None
        for k in range(w.shape[1]):  # sums stay below 2**31: weights of all filters add up to less than 1.5 in parts above 0
            part = px.take(np.minimum(low + k, size - 1), axis) * w[:, k]
            out = part if out is None else np.add(out, part, out=out)
        if px.dtype != np.uint8:
            return out.astype(np.float32)
        return np.clip((out + (1 << (_PRECISION - 1))) >> _PRECISION, 0, 255).astype(np.uint8)
    matrix = np.zeros((n, size))
    at = low[:, None] + np.arange(w.shape[1])
    rows = np.nonzero(at < size)
    matrix[rows[0], at[rows]] = w[rows]
    out = np.moveaxis(np.tensordot(matrix, px.astype(np.float64), axes=(1, axis)), 0, axis)
    if px.dtype != np.uint8:
        return out.astype(np.float32)
    return np.clip(np.floor((out + (1 << (_PRECISION - 1))) / (1 << _PRECISION)), 0, 255).astype(np.uint8)  # whole numbers below 2**53: exact


def resize(px: Image, w: int, h: int, kind: str = "bilinear") -> Image:
    if kind == "nearest":
        at = lambda n, out: np.minimum((np.cumsum(np.full(out, n / out)) - n / out / 2).astype(np.int64), n - 1)
        return px[at(px.shape[0], h)][:, at(px.shape[1], w)]
    return np.ascontiguousarray(_pass(_pass(px, w, 1, kind), h, 0, kind))


def short_edge(w: int, h: int, size: int, most: int | None = None) -> tuple[int, int]:
    """Width and height with the short edge at ``size``; the long one is at most ``most``."""
    short, long = min(w, h), max(w, h)
    a, b = size, size * long // short
    if most is not None and b > most:
        a, b = most * a // b, most
    return (a, b) if w <= h else (b, a)


# crops, pads, turns


def crop(px: Image, x: int, y: int, w: int, h: int) -> Image:
    out = np.zeros((h, w, px.shape[2]), px.dtype)
    part = px[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
    out[max(-y, 0) : max(-y, 0) + part.shape[0], max(-x, 0) : max(-x, 0) + part.shape[1]] = part
    return out


def offset(d: int) -> int:
    return d // 2 + (d % 4 == 3)


def center_crop(px: Image, w: int, h: int) -> Image:
    ph, pw = max(0, h - px.shape[0]), max(0, w - px.shape[1])
    if ph or pw:
        px = pad(px, (pw // 2, ph // 2, pw - pw // 2, ph - ph // 2))
    return crop(px, offset(px.shape[1] - w), offset(px.shape[0] - h), w, h)


def pad(px: Image, sides: tuple[int, int, int, int], fill: float = 0, mode: str = "constant") -> Image:
    left, top, right, bottom = sides
    h, w = px.shape[:2]
    if mode == "constant":
        value = min(255, max(0, int(fill))) if px.dtype == np.uint8 else np.float32(fill)
        return np.pad(px, ((top, bottom), (left, right), (0, 0)), constant_values=value)

    def places(n: int, a: int, b: int) -> np.ndarray:
        i = np.arange(-a, n + b)
        if mode == "reflect":
            i = np.mod(i, max(1, 2 * (n - 1)))
            return np.minimum(i, 2 * (n - 1) - i)
        if mode == "symmetric":
            i = np.mod(i, 2 * n)
            return np.minimum(i, 2 * n - 1 - i)
        return np.clip(i, 0, n - 1)

    return px[places(h, top, bottom)][:, places(w, left, right)]


def five_crop(px: Image, w: int, h: int) -> list[Image]:
    ih, iw = px.shape[:2]
    if w > iw or h > ih:
        raise ValueError("crop is larger than the image")
    spots = [(0, 0), (iw - w, 0), (0, ih - h), (iw - w, ih - h), (offset(iw - w), offset(ih - h))]
    return [crop(px, x, y, w, h) for x, y in spots]


def ten_crop(px: Image, w: int, h: int, vertical: bool = False) -> list[Image]:
    return five_crop(px, w, h) + five_crop(px[::-1] if vertical else px[:, ::-1], w, h)


# warps: each gives, for every output pixel, where it comes from (pixel centres are whole numbers)


def _sample(px: Image, sx: np.ndarray, sy: np.ndarray, kind: str, fill) -> Image:
    h, w, c = px.shape
    inside = (sx >= -0.5) & (sx < w - 0.5) & (sy >= -0.5) & (sy < h - 0.5)
    sx, sy = np.where(inside, sx, 0.0), np.where(inside, sy, 0.0)
    at = lambda i, j: px[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)].astype(np.float64)
    if kind == "nearest":
        out = at(np.floor(sy + 0.5).astype(int), np.floor(sx + 0.5).astype(int))
    else:
        j, i = np.floor(sx).astype(int), np.floor(sy).astype(int)
        dx, dy = (sx - j)[..., None], (sy - i)[..., None]
        if kind == "bilinear":
            row = lambda q: at(q, j) + (at(q, j + 1) - at(q, j)) * dx
            top = row(i)
            out = top + (row(i + 1) - top) * dy
        elif kind == "bicubic":

            def curve(a, b, c2, d, t):
                return b + t * (-a + c2 + t * (2 * (a - b) + c2 - d + t * (-a + b - c2 + d)))

            row = lambda q: curve(at(q, j - 1), at(q, j), at(q, j + 1), at(q, j + 2), dx)
            out = curve(row(i - 1), row(i), row(i + 1), row(i + 2), dy)
        else:
            raise ValueError(f"unknown interpolation {kind}")
    value = np.broadcast_to(np.asarray(0 if fill is None else fill, np.float64), (c,))
    out = np.where(inside[..., None], out, value)
    return np.clip(np.trunc(out), 0, 255).astype(np.uint8) if px.dtype == np.uint8 else out.astype(np.float32)


def warp(px: Image, m: tuple[float, ...], size: tuple[int, int], kind: str, fill=None) -> Image:
    """By an inverse affine matrix (a, b, c, d, e, f) in pixel corners, or a homography of eight numbers."""
    w, h = size
    jj, ii = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    x, y = m[0] * jj + m[1] * ii + m[2], m[3] * jj + m[4] * ii + m[5]
    if len(m) == 8:
        q = m[6] * jj + m[7] * ii + 1
        bad = np.abs(q) < 1e-7
        q = np.where(bad, 1.0, q)
        x, y = np.where(bad, -1e9, x / q), np.where(bad, -1e9, y / q)
    return _sample(px, x - 0.5, y - 0.5, kind, fill)


def grid_warp(px: Image, m: tuple[float, ...], kind: str = "bilinear", fill: float = 0) -> Image:
    """By an inverse affine matrix about the image's middle, in float32: places are shares of the image, as grid samplers
    take them. Bilinear sums weigh the pixels inside; what is missing of the weight is ``fill``."""
    h, w = px.shape[:2]
    f = np.float32
    jj, ii = np.meshgrid(np.arange(w, dtype=f) - (f(w) - 1) * f(0.5), np.arange(h, dtype=f) - (f(h) - 1) * f(0.5))
    share = lambda k, half: jj * (f(m[k]) / half) + ii * (f(m[k + 1]) / half) + f(m[k + 2]) / half
    x = ((share(0, f(w) * f(0.5)) + 1) * f(w) - 1) * f(0.5)
    y = ((share(3, f(h) * f(0.5)) + 1) * f(h) - 1) * f(0.5)
    inside = lambda i, j: (j >= 0) & (i >= 0) & (j < w) & (i < h)
    at = lambda i, j: px[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)]
    if kind == "nearest":
        i, j = np.rint(y).astype(int), np.rint(x).astype(int)
        return np.where(inside(i, j)[..., None], at(i, j), np.uint8(fill))
    if kind != "bilinear":
        raise ValueError("only nearest and bilinear sampling")
    j, i = np.floor(x), np.floor(y)
    dx, dy = x - j, y - i
    i, j = i.astype(int), j.astype(int)
    total, mask = np.zeros(px.shape, f), np.zeros((h, w, 1), f)
    for ai, aj, weight in ((i, j, (1 - dx) * (1 - dy)), (i, j + 1, dx * (1 - dy)), (i + 1, j, (1 - dx) * dy), (i + 1, j + 1, dx * dy)):
        weight = np.where(inside(ai, aj), weight, f(0))[..., None]
        total, mask = total + at(ai, aj).astype(f) * weight, mask + weight
    return np.clip(np.rint(total * mask + (1 - mask) * f(fill)), 0, 255).astype(np.uint8)


def mix_colour(px: Image, name: str, m: float) -> Image:
    """Color, Contrast, Sharpness by 1 + m and AutoContrast, in float32 arithmetic and truncated."""
    f = np.float32
    p = px.astype(f)
    if name == "AutoContrast":
        lo, hi = px.min((0, 1)), px.max((0, 1))
        scale = f(255) / np.where(hi == lo, 1, hi - lo).astype(f)
        return np.clip(np.where(hi == lo, p, (p - lo.astype(f)) * scale), 0, 255).astype(np.uint8)
    grey = np.trunc(f(0.2989) * p[..., 0] + f(0.587) * p[..., 1] + f(0.114) * p[..., 2])
    if name == "Color":
        base = grey[..., None]
    elif name == "Contrast":
        base = f(grey.astype(np.int64).sum()) / f(grey.size)
    else:
        h, w = px.shape[:2]
        base = p.copy()
        if h > 2 and w > 2:
            soft = np.zeros((h - 2, w - 2, px.shape[2]), f)
            for i in range(3):
                for j in range(3):
                    soft = soft + p[i : i + h - 2, j : j + w - 2] * (f(5 / 13) if i == j == 1 else f(1 / 13))
            base[1:-1, 1:-1] = np.clip(np.rint(soft), 0, 255)
    return np.clip(f(1 + m) * p + f(-m) * base, 0, 255).astype(np.uint8)


def _trig(angle: float) -> tuple[float, float]:
    return round(math.cos(angle), 15), round(math.sin(angle), 15)


def rotation(w: int, h: int, angle: float, expand: bool = False, center=None) -> tuple[tuple[float, ...], tuple[int, int]]:
    """The inverse matrix of a turn counter-clockwise, and the new size."""
    cx, cy = center if center is not None else (w / 2, h / 2)
    cos, sin = _trig(-math.radians(angle))
    a, b, d, e = cos, sin, -sin, cos
    c, f = a * -cx + b * -cy + cx, d * -cx + e * -cy + cy
    size = (w, h)
    if expand:
        xs, ys = zip(*[(a * x + b * y + c, d * x + e * y + f) for x, y in ((0, 0), (w, 0), (w, h), (0, h))], strict=True)
        nw, nh = math.ceil(max(xs)) - math.floor(min(xs)), math.ceil(max(ys)) - math.floor(min(ys))
        ox, oy = -(nw - w) / 2, -(nh - h) / 2
        c, f, size = a * ox + b * oy + c, d * ox + e * oy + f, (nw, nh)
    return (a, b, c, d, e, f), size


def rotate(px: Image, angle: float, kind: str = "nearest", expand: bool = False, fill=None, center=None) -> Image:
    """Counter-clockwise by any angle."""
    h, w = px.shape[:2]
    angle %= 360.0
    if center is None and (angle in (0, 180) or angle in (90, 270) and (expand or h == w)):
        return np.ascontiguousarray(np.rot90(px, int(angle // 90)))
    m, size = rotation(w, h, angle, expand, center)
    return warp(px, m, size, kind, fill)


def affine_matrix(center, angle: float, translate, scale: float, shear) -> tuple[float, ...]:
    """The inverse of: shear, rotate and scale about the centre, then translate."""
    r, sx, sy = math.radians(angle), math.radians(shear[0]), math.radians(shear[1])
    cx, cy, (tx, ty) = *center, translate
    a = math.cos(r - sy) / math.cos(sy)
    b = -math.cos(r - sy) * math.tan(sx) / math.cos(sy) - math.sin(r)
    c = math.sin(r - sy) / math.cos(sy)
    d = -math.sin(r - sy) * math.tan(sx) / math.cos(sy) + math.cos(r)
    m = [d / scale, -b / scale, 0.0, -c / scale, a / scale, 0.0]
    m[2] = m[0] * (-cx - tx) + m[1] * (-cy - ty) + cx
    m[5] = m[3] * (-cx - tx) + m[4] * (-cy - ty) + cy
    return tuple(m)


def affine(px: Image, angle=0.0, translate=(0, 0), scale=1.0, shear=(0.0, 0.0), kind="nearest", fill=None, center=None) -> Image:
    h, w = px.shape[:2]
    return warp(px, affine_matrix(center or (w / 2, h / 2), angle, translate, scale, shear), (w, h), kind, fill)


def homography(start, end) -> tuple[float, ...]:
    """The eight coefficients that take ``end`` points to ``start`` points."""
    rows, rhs = [], []
    for (sx, sy), (ex, ey) in zip(start, end, strict=True):
        rows += [[ex, ey, 1, 0, 0, 0, -sx * ex, -sx * ey], [0, 0, 0, ex, ey, 1, -sy * ex, -sy * ey]]
        rhs += [sx, sy]
    return tuple(np.linalg.solve(np.array(rows, float), np.array(rhs, float)).astype(np.float32).astype(float).tolist())


def perspective(px: Image, start, end, kind="bilinear", fill=None) -> Image:
    return warp(px, homography(start, end), (px.shape[1], px.shape[0]), kind, fill)


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    d = np.arange(size, dtype=np.float64) - (size - 1) / 2
    k = np.exp(-(d**2) / (2 * sigma * sigma))
    return (k / k.sum()).astype(np.float32)


def gaussian_blur(px: Image, sigma: float, size: int | None = None) -> Image:
    size = size or 2 * math.ceil(3 * sigma) + 1
    r = size // 2
    if r >= min(px.shape[:2]):
        raise ValueError("the kernel is larger than the image")
    k = gaussian_kernel(size, sigma)
    x = pad(px.astype(np.float32), (r, r, r, r), mode="reflect")
    h, w = px.shape[:2]
    out = np.zeros(px.shape, np.float32)
    for i in range(size):
        for j in range(size):
            out += (k[i] * k[j]) * x[i : i + h, j : j + w]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if px.dtype == np.uint8 else out


def elastic(px: Image, dx: np.ndarray, dy: np.ndarray, kind="bilinear", fill=None) -> Image:
    h, w = px.shape[:2]
    jj, ii = np.meshgrid(np.arange(w), np.arange(h))
    return _sample(px, jj + dx, ii + dy, kind, fill)


# colour (uint8)


def luma(px: Image) -> np.ndarray:
    p = px.astype(np.int32)  # sums stay below 2**24 + 2**15
    return (19595 * p[..., 0] + 38470 * p[..., 1] + 7471 * p[..., 2] + 32768) >> 16


def blend(px: Image, base, factor: float) -> Image:
    b = np.asarray(base).astype(np.float32)
    return np.clip(b + np.float32(factor) * (px.astype(np.float32) - b), 0, 255).astype(np.uint8)


def brightness(px: Image, f: float) -> Image:
    return blend(px, 0, f)


def contrast(px: Image, f: float) -> Image:
    return blend(px, math.floor(luma(px).mean() + 0.5), f)


def saturation(px: Image, f: float) -> Image:
    return blend(px, luma(px)[..., None], f)


#: Pixels whose hue is turned at once: what is made of them stays in a processor's cache.
HUE_PIXELS = 1 << 13
# by the turned hue: the place in its sixth of the circle, and which byte of (v, a, b, c) each channel takes there
_HUES = np.arange(256, dtype=np.float32) * 6 / 255
_PLACE = _HUES.astype(np.float64) - np.floor(_HUES)
_SHIFT = 8 * np.array([(0, 2, 1, 1, 3, 0), (3, 0, 0, 2, 1, 1), (1, 1, 3, 0, 0, 2)], np.uint32)[:, np.floor(_HUES).astype(np.int8) % 6]


def _turned(px: np.ndarray, turn: np.ndarray | int, out: np.ndarray) -> None:
    """Of (n, 3) pixels, to ``out``."""
    r, g, b = np.ascontiguousarray(px.T).astype(np.float32)
    hi, lo = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = hi - lo
    safe = np.where(d == 0, np.float32(1), d)
    rc, gc, bc = (hi - r) / safe, (hi - g) / safe, (hi - b) / safe
    h = np.where(r == hi, bc - gc, np.where(g == hi, 2 + rc - bc, 4 + gc - rc)) / 6 + 1
    h -= np.floor(h)
    h[d == 0] = 0
    at = ((np.minimum((h * 255).astype(np.int16), 255) + turn) & 255).astype(np.intp)
    s = np.minimum((d * 255 / np.where(hi == 0, np.float32(1), hi)).astype(np.int16), 255).astype(np.float32) / 255
    t = _PLACE.take(at)
    parts = np.empty((len(px), 4), np.uint8)  # without saturation all four are hi
    parts[:, 0] = hi
    for k, z in enumerate((1 - s, 1 - s * t, 1 - s * (1 - t)), 1):
        parts[:, k] = hi * z.astype(np.float64) + 0.5
    whole = parts.view("<u4").reshape(-1)
    for k in range(3):
        out[:, k] = whole >> _SHIFT[k].take(at)


def hue(px: Image, f) -> Image:
    """A turn of the hue by f of the circle, through 8-bit HSV; f may be one for each of many images."""
    f = np.asarray(f, np.float64)
    flat = np.ascontiguousarray(px).reshape(-1, px.shape[-1])
    out = flat.copy()
    turn = np.trunc(f * 255).astype(np.int16).repeat(len(flat) // max(1, f.size)) if f.ndim else int(f * 255)
    for k in range(0, len(flat), HUE_PIXELS):
        some = slice(k, k + HUE_PIXELS)
        _turned(flat[some, :3], turn[some] if f.ndim else turn, out[some])
    return out.reshape(px.shape)


def gamma(px: Image, g: float, gain: float = 1.0) -> Image:
    table = np.clip((256 - 1e-3) * gain * (np.arange(256) / 255.0) ** g, 0, 255).astype(np.uint8)
    return table[px]


def grayscale(px: Image, channels: int = 1) -> Image:
    return np.repeat(luma(px)[..., None].astype(np.uint8), channels, axis=2)


def invert(px: Image) -> Image:
    return 255 - px


def posterize(px: Image, bits: int) -> Image:
    return px & np.uint8((0xFF << (8 - bits)) & 0xFF if bits else 0)


def solarize(px: Image, t: float) -> Image:
    return np.where(px >= t, 255 - px, px).astype(np.uint8)


def autocontrast(px: Image) -> Image:
    p = px.astype(np.int64)
    lo, hi = p.min((0, 1)), p.max((0, 1))
    return np.where(hi == lo, p, (p - lo) * 255 // np.where(hi == lo, 1, hi - lo)).astype(np.uint8)


def equalize(px: Image) -> Image:
    out = px.copy()
    for c in range(px.shape[2]):
        hist = np.bincount(px[..., c].ravel(), minlength=256)
        step = (hist.sum() - hist[np.flatnonzero(hist)[-1]]) // 255
        if step:
            below = np.concatenate(([0], np.cumsum(hist)[:-1]))
            out[..., c] = np.minimum((below + step // 2) // step, 255).astype(np.uint8)[px[..., c]]
    return out


def sharpness(px: Image, f: float) -> Image:
    h, w = px.shape[:2]
    if h < 3 or w < 3:
        return px
    p = px.astype(np.float32)
    s = sum(p[i : i + h - 2, j : j + w - 2] for i in range(3) for j in range(3)) + 4 * p[1:-1, 1:-1]
    soft = px.copy()
    soft[1:-1, 1:-1] = np.clip(np.floor(s / np.float32(13) + 0.5), 0, 255).astype(np.uint8)
    return blend(px, soft, f)


# representation


def normalize(px: Image, mean, std) -> Image:
    m, s = np.asarray(mean, np.float32), np.asarray(std, np.float32)
    if px.dtype == np.uint8:
        return px.astype(np.float32) * (np.float32(1) / (np.float32(255) * s)) + (-m / s)
    return (px - m) / s


def to_float(px: Image) -> Image:
    return px.astype(np.float32) / np.float32(255)


def to_uint8(px: Image) -> Image:
    v = np.where(np.isfinite(px), px, 0) * np.float32(256 - 1e-3)
    return (np.trunc(v).astype(np.int64) % 256).astype(np.uint8)


def erase(px: Image, x: int, y: int, w: int, h: int, value) -> Image:
    out = px.copy()
    v = np.asarray(value)
    out[y : y + h, x : x + w] = (np.trunc(v.astype(np.float64)).astype(np.int64) % 256).astype(np.uint8) if px.dtype == np.uint8 else v.astype(np.float32)
    return out


def gaussian_noise(px: Image, noise: np.ndarray, clip: bool = True) -> Image:
    """Float32 noise added; for uint8 it is in steps of the pixels, truncated to int16 before the sum."""
    if px.dtype == np.uint8:
        v = px.astype(np.int16) + np.trunc(noise).astype(np.int64).astype(np.int16)
        return (np.clip(v, 0, 255) if clip else v.astype(np.int64) % 256).astype(np.uint8)
    v = px + noise
    return np.clip(v, 0, 1) if clip else v


def linear_transform(px: Image, matrix: np.ndarray, mean: np.ndarray) -> Image:
    """(flat CHW - mean) by the matrix; float32 CHW arrays."""
    return ((px.reshape(-1) - mean.astype(np.float32)) @ matrix.astype(np.float32)).reshape(px.shape)
