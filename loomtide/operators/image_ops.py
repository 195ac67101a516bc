"""Image operations by name: how each resolves its draws and calls a kernel.

``apply(steps, image, key_of)`` runs resolved steps on one image; a random step draws from its own stream, so nothing
depends on which rows share a batch."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from . import jpeg
from . import kernels as K
from .rng import TINY, Stream, combine, op_key

Step = tuple[str, dict]


def _uniform(s: Stream, low: float, high: float) -> float:
    return low + (high - low) * s.f64()


def _uniform32(s: Stream, low: float, high: float) -> float:
    return float(np.float32(low) + (np.float32(high) - np.float32(low)) * s.f32())


# What a random step of places does: fixed steps, from its draws and the image's size. Images and annotated samples share it.


def _crop_steps(s: Stream, iw, ih, w, h, padding=(0, 0, 0, 0), pad_if_needed=False, fill=0, mode="constant") -> list[Step]:
    out = []
    sides = [tuple(padding)] if any(padding) else []
    pw, ph = (iw + padding[0] + padding[2], ih + padding[1] + padding[3]) if sides else (iw, ih)
    if pad_if_needed and pw < w:
        sides.append((w - pw, 0, w - pw, 0))
        pw += 2 * (w - pw)
    if pad_if_needed and ph < h:
        sides.append((0, h - ph, 0, h - ph))
        ph += 2 * (h - ph)
    out += [("Pad", {"sides": x, "fill": fill, "mode": mode}) for x in sides]
    if h > ph or w > pw:
        raise ValueError("crop is larger than the image")
    y = s.below(ph - h + 1)
    return [*out, ("Crop", {"x": s.below(pw - w + 1), "y": y, "w": w, "h": h})]


def _resized_crop_steps(s: Stream, iw, ih, w, h, scale=(0.08, 1.0), ratio=(0.75, 1.3333334), interpolation="bilinear") -> list[Step]:
    to = lambda x, y, cw, ch: [("ResizedCrop", {"x": x, "y": y, "w": cw, "h": ch, "ow": w, "oh": h, "interpolation": interpolation})]
    for _ in range(10):
        area = ih * iw * _uniform(s, *scale)
        r = math.exp(_uniform(s, math.log(ratio[0]), math.log(ratio[1])))
        cw, ch = round(math.sqrt(area * r)), round(math.sqrt(area / r))
        if 0 < cw <= iw and 0 < ch <= ih:
            x = s.below(iw - cw + 1)
            return to(x, s.below(ih - ch + 1), cw, ch)
    r = iw / ih
    cw, ch = (iw, round(iw / ratio[0])) if r < ratio[0] else (round(ih * ratio[1]), ih) if r > ratio[1] else (iw, ih)
    return to((iw - cw) // 2, (ih - ch) // 2, cw, ch)


def _shuffled(s: Stream, items: list) -> list:
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = s.below(i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def _color_jitter(px, s: Stream, b=0.0, c=0.0, h=0.0, sat=0.0):
    order = _shuffled(s, ["b", "c", "h"] + (["s"] if sat else []))
    factor = lambda v: _uniform32(s, max(0.0, 1 - v), 1 + v) if v else None
    f = {"b": factor(b), "c": factor(c), "h": _uniform32(s, -h, h) if h else None, "s": factor(sat)}
    run = {"b": K.brightness, "c": K.contrast, "h": K.hue, "s": K.saturation}
    for k in order:
        if f[k] is not None:
            px = run[k](px, f[k])
    return px


def _random_erasing(px, s: Stream, p=0.5, **args):
    return erased(px, s, **args) if s.coin(p) else px


def erased(px, s: Stream, scale=(0.02, 0.33), ratio=(0.3, 3.3333333), value=0):
    """The image with a random rectangle erased; the image itself after ten rectangles that do not fit."""
    h, w, c = px.shape
    for _ in range(10):
        area = h * w * _uniform(s, *scale)
        r = math.exp(_uniform(s, math.log(ratio[0]), math.log(ratio[1])))
        eh, ew = round(math.sqrt(area * r)), round(math.sqrt(area / r))
        if 0 < eh < h and 0 < ew < w:
            y, x = s.below(h - eh + 1), s.below(w - ew + 1)
            v = s.normals(eh * ew * c).astype(np.float32).reshape(eh, ew, c) if value == "random" else value
            return K.erase(px, x, y, ew, eh, v)
    return px


def _photometric(px, s: Stream, brightness=(0.875, 1.125), contrast=(0.5, 1.5), saturation=(0.5, 1.5), hue=(-0.05, 0.05), p=0.5):
    draw = lambda r: float(np.float32(r[0]) + (np.float32(r[1]) - np.float32(r[0])) * np.float32(s.f64())) if s.coin(p) else None
    b, c, sat, h = draw(brightness), draw(contrast), draw(saturation), draw(hue)
    first, swap = s.coin(0.5), s.coin(p)
    for on, f, v in ((True, K.brightness, b), (first, K.contrast, c), (True, K.saturation, sat), (True, K.hue, h), (not first, K.contrast, c)):
        if on and v is not None:
            px = f(px, v)
    return px[..., _shuffled(s, list(range(px.shape[2])))] if swap else px


def _affine_steps(s: Stream, w, h, degrees, translate=None, scale=None, shear=None, interpolation="nearest", fill=None, center=None) -> list[Step]:
    angle = _uniform(s, *degrees)
    move = (0, 0)
    if translate:
        move = (round(_uniform(s, -translate[0] * w, translate[0] * w)), round(_uniform(s, -translate[1] * h, translate[1] * h)))
    size = _uniform(s, *scale) if scale else 1.0
    sx = _uniform(s, shear[0], shear[1]) if shear else 0.0
    sy = _uniform(s, shear[2], shear[3]) if shear and len(shear) == 4 else 0.0
    return [("Affine", {"angle": angle, "translate": move, "scale": size, "shear": (sx, sy), "interpolation": interpolation, "fill": fill, "center": center})]


def _rotation_steps(s: Stream, w, h, degrees, interpolation="nearest", expand=False, fill=None, center=None) -> list[Step]:
    return [("ArbitraryRotate", {"angle": _uniform32(s, *degrees), "interpolation": interpolation, "expand": expand, "fill": fill, "center": center})]


def _perspective_steps(s: Stream, w, h, distortion=0.5, p=0.5, interpolation="bilinear", fill=None) -> list[Step]:
    if not s.coin(p) or w < 2 or h < 2 or distortion == 0:
        return []
    start = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    return [("Perspective", {"start": start, "end": moved_corners(s, w, h, distortion), "interpolation": interpolation, "fill": fill})]


def moved_corners(s: Stream, w: int, h: int, distortion: float) -> list[tuple[int, int]]:
    """The four corners, each somewhere in its own box of half the distortion: the near ones from 0 on, the far ones up to
    the last pixel."""
    hw, hh = int(np.float32(distortion) * np.float32(w // 2)), int(np.float32(distortion) * np.float32(h // 2))
    out = []
    for far_x, far_y in ((0, 0), (1, 0), (1, 1), (0, 1)):
        x = far_x * (w - 1 - hw) + s.below(hw + 1)
        out.append((x, far_y * (h - 1 - hh) + s.below(hh + 1)))
    return out


def _elastic(px, s: Stream, alpha=50.0, sigma=5.0, interpolation="bilinear", fill=None):
    h, w = px.shape[:2]
    draw = lambda: (s.f32s(h * w) * 2 - 1).reshape(h, w)
    fields = draw(), draw()
    size = int(8 * sigma + 1) | 1
    r = min(size // 2, min(h, w) - 1)
    k = K.gaussian_kernel(2 * r + 1, sigma)

    def smooth(f):
        f = K.pad(f[..., None], (r, r, r, r), mode="reflect")[..., 0]
        f = sum(k[j] * f[:, j : j + w] for j in range(2 * r + 1))
        return sum(k[i] * f[i : i + h] for i in range(2 * r + 1))

    dx, dy = (smooth(f) * alpha / 2 for f in fields)
    return K.elastic(px, dx, dy, interpolation, fill)


def _zoom_out_steps(s: Stream, w, h, fill=0, side=(1.0, 4.0), p=0.5) -> list[Step]:
    if not s.coin(p):
        return []
    r = _uniform(s, *side)
    nw, nh = int(w * r), int(h * r)
    left, top = int(s.f64() * (nw - w)), int(s.f64() * (nh - h))
    return [("Pad", {"sides": (left, top, nw - w - left, nh - h - top), "fill": fill})]


def _sized(w: float, h: float, interpolation: str) -> list[Step]:
    if int(w) < 1 or int(h) < 1:
        raise ValueError("the new size must be positive")
    return [("Resize", {"w": int(w), "h": int(h), "interpolation": interpolation})]


def _shortest_steps(s: Stream, w, h, sizes, max_size=None, interpolation="bilinear") -> list[Step]:
    r = sizes[s.below(len(sizes))] / min(h, w)
    if max_size is not None:
        r = min(r, max_size / max(h, w))
    return _sized(w * r, h * r, interpolation)


def _jitter_steps(s: Stream, iw, ih, w, h, scale=(0.1, 2.0), interpolation="bilinear") -> list[Step]:
    r = min(w / iw, h / ih) * _uniform(s, *scale)
    return _sized(iw * r, ih * r, interpolation)


def _random_resize_steps(s: Stream, w, h, low, high, interpolation="bilinear") -> list[Step]:
    nw, nh = K.short_edge(w, h, s.between(low, high))
    return _sized(nw, nh, interpolation)


#: Random steps of places: fixed steps from (stream, width, height).
RESOLVE: dict[str, Callable[..., list[Step]]] = {
    "RandomCrop": _crop_steps,
    "RandomResizedCrop": _resized_crop_steps,
    "RandomHorizontalFlip": lambda s, w, h, p=0.5: [("HorizontalFlip", {})] if s.coin(p) else [],
    "RandomVerticalFlip": lambda s, w, h, p=0.5: [("VerticalFlip", {})] if s.coin(p) else [],
    "RandomAffine": _affine_steps,
    "RandomRotation": _rotation_steps,
    "RandomPerspective": _perspective_steps,
    "RandomResize": _random_resize_steps,
    "RandomShortestSize": _shortest_steps,
    "ScaleJitter": _jitter_steps,
    "RandomZoomOut": _zoom_out_steps,
}


def _by_steps(name: str) -> Callable:
    def run(px, s: Stream, **args):
        for n, a in RESOLVE[name](s, px.shape[1], px.shape[0], **args):
            px = PLAIN[n](px, **a)
        return px

    return run


def _resize(px, w, h=None, interpolation="bilinear", max_size=None):
    if h is None:
        w, h = K.short_edge(px.shape[1], px.shape[0], w, max_size)
    return K.resize(px, w, h, interpolation)


# policies: an operation by name and magnitude

_SIGNED = frozenset("ShearX ShearY TranslateX TranslateY Rotate Brightness Color Contrast Sharpness".split())
_PLAIN = frozenset("Identity AutoContrast Equalize Invert".split())


def policy_op(px, name: str, m: float):
    h, w = px.shape[:2]
    if name == "ShearX":
        return K.warp(px, (1, m, 0, 0, 1, 0), (w, h), "nearest")
    if name == "ShearY":
        return K.warp(px, (1, 0, 0, m, 1, 0), (w, h), "nearest")
    if name == "TranslateX":
        return K.warp(px, (1, 0, -int(m), 0, 1, 0), (w, h), "nearest")
    if name == "TranslateY":
        return K.warp(px, (1, 0, 0, 0, 1, -int(m)), (w, h), "nearest")
    if name == "Rotate":
        return K.rotate(px, m)
    plain = {"AutoContrast": K.autocontrast, "Equalize": K.equalize, "Invert": K.invert, "Identity": lambda x: x}
    if name in plain:
        return plain[name](px)
    if name == "Posterize":
        return K.posterize(px, int(m))
    if name == "Solarize":
        return K.solarize(px, math.ceil(m))
    return {"Brightness": K.brightness, "Color": K.saturation, "Contrast": K.contrast, "Sharpness": K.sharpness}[name](px, 1 + m)


def line(start: float, end: float, bins: int) -> list[float]:
    """``bins`` even float32 steps; the upper half counts back from the end, as rounding favours both ends."""
    a, z = np.float32(start), np.float32(end)
    step = (z - a) / np.float32(max(1, bins - 1))
    k = np.arange(bins)
    return [float(v) for v in np.where(k < bins // 2, a + step * k.astype(np.float32), z - step * (bins - 1 - k).astype(np.float32))]


@lru_cache(maxsize=256)
def magnitudes(bins: int, h: int, w: int, kind: str = "") -> dict[str, list[float]]:
    """Each operation's magnitude by bin, from none to the most; kind: "" (learned policies), "wide" or "mix"."""
    if kind == "wide":
        most = {"ShearX": 0.99, "ShearY": 0.99, "TranslateX": 32.0, "TranslateY": 32.0, "Rotate": 135.0, "Brightness": 0.99}
    else:
        part = 1 / 3 if kind == "mix" else 150 / 331
        most = {"ShearX": 0.3, "ShearY": 0.3, "TranslateX": w / 3 if kind == "mix" else part * w, "TranslateY": h / 3 if kind == "mix" else part * h, "Rotate": 30.0, "Brightness": 0.9}
    out = {k: line(0.0, v, bins) for k, v in most.items()}
    out |= {k: out["Brightness"] for k in ("Color", "Contrast", "Sharpness")}
    steps = np.float32(max(1, bins - 1)) / np.float32(6 if kind == "wide" else 4)
    bits = 4 if kind == "mix" else 8
    return out | {"Posterize": [bits - float(np.rint(np.float32(k) / steps)) for k in range(bins)], "Solarize": line(255.0, 0.0, bins)}


#: The operations of both policies, in their fixed order.
POLICY = ("Identity", "ShearX", "ShearY", "TranslateX", "TranslateY", "Rotate", "Brightness", "Color", "Contrast", "Sharpness", "Posterize", "Solarize", "AutoContrast", "Equalize")


def _rand_augment(px, s: Stream, num_ops=2, magnitude=9, bins=31):
    for _ in range(num_ops):
        name = POLICY[s.below(len(POLICY))]
        m = 0.0 if name in _PLAIN else magnitudes(bins, *px.shape[:2])[name][magnitude]
        if name in _SIGNED and s.coin(0.5):
            m = -m
        px = policy_op(px, name, m)
    return px


def _trivial_augment(px, s: Stream, bins=31):
    name = POLICY[s.below(len(POLICY))]
    if name in _PLAIN:
        return policy_op(px, name, 0.0)
    m = magnitudes(bins, *px.shape[:2], "wide")[name][s.below(bins)]
    if name in _SIGNED and s.coin(0.5):
        m = -m
    return policy_op(px, name, m)


# The published sub-policies, two operations each with probability and magnitude bin.
SUB_POLICIES: dict[str, tuple] = {
    "imagenet": (
        (("Posterize", 0.4, 8), ("Rotate", 0.6, 9)),
        (("Solarize", 0.6, 5), ("AutoContrast", 0.6, None)),
        (("Equalize", 0.8, None), ("Equalize", 0.6, None)),
        (("Posterize", 0.6, 7), ("Posterize", 0.6, 6)),
        (("Equalize", 0.4, None), ("Solarize", 0.2, 4)),
        (("Equalize", 0.4, None), ("Rotate", 0.8, 8)),
        (("Solarize", 0.6, 3), ("Equalize", 0.6, None)),
        (("Posterize", 0.8, 5), ("Equalize", 1.0, None)),
        (("Rotate", 0.2, 3), ("Solarize", 0.6, 8)),
        (("Equalize", 0.6, None), ("Posterize", 0.4, 6)),
        (("Rotate", 0.8, 8), ("Color", 0.4, 0)),
        (("Rotate", 0.4, 9), ("Equalize", 0.6, None)),
        (("Equalize", 0.0, None), ("Equalize", 0.8, None)),
        (("Invert", 0.6, None), ("Equalize", 1.0, None)),
        (("Color", 0.6, 4), ("Contrast", 1.0, 8)),
        (("Rotate", 0.8, 8), ("Color", 1.0, 2)),
        (("Color", 0.8, 8), ("Solarize", 0.8, 7)),
        (("Sharpness", 0.4, 7), ("Invert", 0.6, None)),
        (("ShearX", 0.6, 5), ("Equalize", 1.0, None)),
        (("Color", 0.4, 0), ("Equalize", 0.6, None)),
        (("Equalize", 0.4, None), ("Solarize", 0.2, 4)),
        (("Solarize", 0.6, 5), ("AutoContrast", 0.6, None)),
        (("Invert", 0.6, None), ("Equalize", 1.0, None)),
        (("Color", 0.6, 4), ("Contrast", 1.0, 8)),
        (("Equalize", 0.8, None), ("Equalize", 0.6, None)),
    ),
    "cifar10": (
        (("Invert", 0.1, None), ("Contrast", 0.2, 6)),
        (("Rotate", 0.7, 2), ("TranslateX", 0.3, 9)),
        (("Sharpness", 0.8, 1), ("Sharpness", 0.9, 3)),
        (("ShearY", 0.5, 8), ("TranslateY", 0.7, 9)),
        (("AutoContrast", 0.5, None), ("Equalize", 0.9, None)),
        (("ShearY", 0.2, 7), ("Posterize", 0.3, 7)),
        (("Color", 0.4, 3), ("Brightness", 0.6, 7)),
        (("Sharpness", 0.3, 9), ("Brightness", 0.7, 9)),
        (("Equalize", 0.6, None), ("Equalize", 0.5, None)),
        (("Contrast", 0.6, 7), ("Sharpness", 0.6, 5)),
        (("Color", 0.7, 7), ("TranslateX", 0.5, 8)),
        (("Equalize", 0.3, None), ("AutoContrast", 0.4, None)),
        (("TranslateY", 0.4, 3), ("Sharpness", 0.2, 6)),
        (("Brightness", 0.9, 6), ("Color", 0.2, 8)),
        (("Solarize", 0.5, 2), ("Invert", 0.0, None)),
        (("Equalize", 0.2, None), ("AutoContrast", 0.6, None)),
        (("Equalize", 0.2, None), ("Equalize", 0.6, None)),
        (("Color", 0.9, 9), ("Equalize", 0.6, None)),
        (("AutoContrast", 0.8, None), ("Solarize", 0.2, 8)),
        (("Brightness", 0.1, 3), ("Color", 0.7, 0)),
        (("Solarize", 0.4, 5), ("AutoContrast", 0.9, None)),
        (("TranslateY", 0.9, 9), ("TranslateY", 0.7, 9)),
        (("AutoContrast", 0.9, None), ("Solarize", 0.8, 3)),
        (("Equalize", 0.8, None), ("Invert", 0.1, None)),
        (("TranslateY", 0.7, 9), ("AutoContrast", 0.9, None)),
    ),
    "svhn": (
        (("ShearX", 0.9, 4), ("Invert", 0.2, None)),
        (("ShearY", 0.9, 8), ("Invert", 0.7, None)),
        (("Equalize", 0.6, None), ("Solarize", 0.6, 6)),
        (("Invert", 0.9, None), ("Equalize", 0.6, None)),
        (("Equalize", 0.6, None), ("Rotate", 0.9, 3)),
        (("ShearX", 0.9, 4), ("AutoContrast", 0.8, None)),
        (("ShearY", 0.9, 8), ("Invert", 0.4, None)),
        (("ShearY", 0.9, 5), ("Solarize", 0.2, 6)),
        (("Invert", 0.9, None), ("AutoContrast", 0.8, None)),
        (("Equalize", 0.6, None), ("Rotate", 0.9, 3)),
        (("ShearX", 0.9, 4), ("Solarize", 0.3, 3)),
        (("ShearY", 0.8, 8), ("Invert", 0.7, None)),
        (("Equalize", 0.9, None), ("TranslateY", 0.6, 6)),
        (("Invert", 0.9, None), ("Equalize", 0.6, None)),
        (("Contrast", 0.3, 3), ("Rotate", 0.8, 4)),
        (("Invert", 0.8, None), ("TranslateY", 0.0, 2)),
        (("ShearY", 0.7, 6), ("Solarize", 0.4, 8)),
        (("Invert", 0.6, None), ("Rotate", 0.8, 4)),
        (("ShearY", 0.3, 7), ("TranslateX", 0.9, 3)),
        (("ShearX", 0.1, 6), ("Invert", 0.6, None)),
        (("Solarize", 0.7, 2), ("TranslateY", 0.6, 7)),
        (("ShearY", 0.8, 4), ("Invert", 0.8, None)),
        (("ShearX", 0.7, 9), ("TranslateY", 0.8, 3)),
        (("ShearY", 0.8, 5), ("AutoContrast", 0.7, None)),
        (("ShearX", 0.7, 2), ("Invert", 0.1, None)),
    ),
}


def _auto_augment(px, s: Stream, policy="imagenet"):
    pairs = SUB_POLICIES[policy]
    pair = pairs[s.below(len(pairs))]
    chance = [float(s.f32()) for _ in range(2)]
    minus = [s.coin(0.5) for _ in range(2)]
    for (name, p, bin_), c, less in zip(pair, chance, minus, strict=True):
        if c <= p:
            m = 0.0 if bin_ is None else magnitudes(10, *px.shape[:2])[name][bin_]
            px = policy_op(px, name, -m if less and name in _SIGNED else m)
    return px


def log_gamma_draw(s: Stream, shape: float) -> float:
    """The logarithm of a gamma variate, by squeezed cubes of normals; shapes under 1 are boosted."""
    if shape < 1:
        return log_gamma_draw(s, shape + 1) + math.log(max(s.f64(), TINY)) / shape
    d = shape - 1 / 3
    c = 1 / math.sqrt(9 * d)
    while True:
        x = s.normal()
        if (v := 1 + c * x) <= 0:
            continue
        v = v**3
        u = s.f64()
        if u == 0 or math.log(u) < 0.5 * x * x + d * (1 - v + math.log(v)):
            return math.log(d) + math.log(v)


def beta_draw(s: Stream, alpha: float) -> float:
    """A Beta(alpha, alpha) variate; where both logarithms are out of reach, all mass is at 0 and 1."""
    a, b = log_gamma_draw(s, alpha), log_gamma_draw(s, alpha)
    off = b - a
    if math.isnan(off):
        return 0.0 if s.coin(0.5) else 1.0
    return 1 / (1 + math.exp(off)) if off < 700 else 0.0


def dirichlet(s: Stream, n: int, alpha: float) -> np.ndarray:
    v = np.array([max(math.exp(log_gamma_draw(s, alpha)), TINY) for _ in range(n)])
    return (v / v.sum()).astype(np.float32)


#: The operations of AugMix, in their fixed order; the last four only with ``all_ops``.
MIX = ("ShearX", "ShearY", "TranslateX", "TranslateY", "Rotate", "Posterize", "Solarize", "AutoContrast", "Equalize", "Brightness", "Color", "Contrast", "Sharpness")


def mix_op(px, name: str, m: float, interpolation: str, fill: int):
    """An operation of AugMix: geometry on a grid of pixel centres with a masked fill, colours in float32."""
    h, w = px.shape[:2]
    if name in ("ShearX", "ShearY", "TranslateX", "TranslateY", "Rotate"):
        r = math.radians(m)
        matrix = {
            "ShearX": (1, m, m * h / 2, 0, 1, 0), "ShearY": (1, 0, 0, m, 1, m * w / 2), "TranslateX": (1, 0, -math.trunc(m), 0, 1, 0), "TranslateY": (1, 0, 0, 0, 1, -math.trunc(m)),
            "Rotate": (math.cos(r), -math.sin(r), 0, math.sin(r), math.cos(r), 0),
        }[name]
        return K.grid_warp(px, matrix, interpolation, fill)
    if name in ("Color", "Contrast", "Sharpness", "AutoContrast"):
        return K.mix_colour(px, name, m)
    return policy_op(px, name, m)


def _augmix(px, s: Stream, severity=3, width=3, depth=-1, alpha=1.0, all_ops=True, interpolation="bilinear", fill=0):
    """Chains of random operations, mixed by Dirichlet weights, and mixed with the image by a Beta weight."""
    names = MIX if all_ops else MIX[:9]
    beta = dirichlet(s, 2, alpha)
    weights = dirichlet(s, width, alpha) * beta[1]
    chains = []
    for _ in range(width):
        chain = []
        for _ in range(depth if depth > 0 else s.between(1, 4)):
            name = names[s.below(len(names))]
            m = 0.0 if name in _PLAIN else magnitudes(10, *px.shape[:2], "mix")[name][s.below(severity)]
            chain.append((name, -m if name in _SIGNED and s.coin(0.5) else m))
        chains.append(chain)
    total = px.astype(np.float32) * beta[0]
    for chain, weight in zip(chains, weights, strict=True):
        x = px
        for name, m in chain:
            x = mix_op(x, name, m, interpolation, fill)
        total = total + weight * x.astype(np.float32)
    return np.clip(total, 0, 255).astype(np.uint8)


def _gaussian_noise(px, s: Stream, mean=0.0, sigma=0.1, clip=True):
    """No draws at sigma 0."""
    unit = 255 if px.dtype == np.uint8 else 1
    draws = s.normals(px.size).astype(np.float32) if sigma else np.zeros(px.size, np.float32)
    return K.gaussian_noise(px, (np.float32(mean * unit) + draws * np.float32(sigma * unit)).reshape(px.shape), clip)


def _grey(px, s, p=0.1, channels=3):
    return K.grayscale(px, channels) if s.coin(p) else px


def _maybe(f: Callable) -> Callable:
    return lambda px, s, p=0.5, **a: f(px, **a) if s.coin(p) else px


PLAIN: dict[str, Callable] = {
    "Resize": _resize, "Crop": lambda px, x, y, w, h: K.crop(px, x, y, w, h), "CenterCrop": lambda px, w, h: K.center_crop(px, w, h),
    "Pad": lambda px, sides, fill=0, mode="constant": K.pad(px, sides, fill, mode), "ResizedCrop": lambda px, x, y, w, h, ow, oh, interpolation="bilinear": K.resize(K.crop(px, x, y, w, h), ow, oh, interpolation),
    "HorizontalFlip": lambda px: px[:, ::-1], "VerticalFlip": lambda px: px[::-1], "Rotate": lambda px, angle: np.rot90(px, angle // 90), "ArbitraryRotate": lambda px, angle, interpolation="nearest", expand=False, fill=None, center=None: K.rotate(px, angle, interpolation, expand, fill, center),
    "Affine": lambda px, angle, translate, scale, shear, interpolation="nearest", fill=None, center=None: K.affine(px, angle, translate, scale, shear, interpolation, fill, center), "Perspective": lambda px, start, end, interpolation="bilinear", fill=None: K.perspective(px, start, end, interpolation, fill),
    "GaussianBlur": lambda px, sigma, kernel_size=None: K.gaussian_blur(px, sigma, kernel_size), "Brightness": lambda px, f: K.brightness(px, f), "Contrast": lambda px, f: K.contrast(px, f), "Saturation": lambda px, f: K.saturation(px, f), "Hue": lambda px, f: K.hue(px, f),
    "Gamma": lambda px, g, gain=1.0: K.gamma(px, g, gain), "Grayscale": lambda px, channels=1: K.grayscale(px, channels), "Invert": K.invert, "Posterize": lambda px, bits: K.posterize(px, bits), "Solarize": lambda px, threshold: K.solarize(px, threshold),
    "Autocontrast": K.autocontrast, "Equalize": K.equalize, "Sharpness": lambda px, f: K.sharpness(px, f), "Erase": lambda px, x, y, w, h, value: K.erase(px, x, y, w, h, value), "Rgb": K.rgb, "PermuteChannels": lambda px, order: px[..., list(order)],
    "Normalize": lambda px, mean, std: K.normalize(px, mean, std), "ToFloat": K.to_float, "ToUint8": K.to_uint8, "CastFloat": lambda px: px.astype(np.float32), "CastUint8": lambda px: (np.trunc(px).astype(np.int64) % 256).astype(np.uint8),
    "HwcToChw": lambda px: px.transpose(2, 0, 1), "ChwToHwc": lambda px: px.transpose(1, 2, 0), "LinearTransform": lambda px, matrix, mean: K.linear_transform(px, np.asarray(matrix), np.asarray(mean)),
}

RANDOM: dict[str, Callable] = {name: _by_steps(name) for name in RESOLVE} | {
    "RandomGrayscale": _grey,
    "ColorJitter": _color_jitter,
    "RandomErasing": _random_erasing,
    "ElasticTransform": _elastic,
    "RandomGaussianBlur": lambda px, s, kernel_size, sigma=(0.1, 2.0): K.gaussian_blur(px, _uniform32(s, *sigma), kernel_size),
    "RandomInvert": _maybe(K.invert),
    "RandomPosterize": _maybe(lambda px, bits: K.posterize(px, bits)),
    "RandomSolarize": _maybe(lambda px, threshold: K.solarize(px, threshold)),
    "RandomAdjustSharpness": _maybe(lambda px, f: K.sharpness(px, f)),
    "RandomAutocontrast": _maybe(K.autocontrast),
    "RandomEqualize": _maybe(K.equalize),
    "RandomPhotometricDistort": _photometric,
    "RandomChannelPermutation": lambda px, s, p=1.0: px[..., _shuffled(s, list(range(px.shape[2])))] if s.coin(p) else px,
    "GaussianNoise": _gaussian_noise,
    "JPEG": lambda px, s, quality: jpeg.compressed(px[None], quality[0] + s.below(quality[1] - quality[0] + 1))[0],
    "RandAugment": _rand_augment,
    "TrivialAugmentWide": _trivial_augment,
    "AutoAugment": _auto_augment,
    "AugMix": _augmix,
}
CONTROL = frozenset(("RandomApply", "RandomChoice", "RandomOrder"))
VIEWS: dict[str, Callable] = {"FiveCrop": lambda px, w, h: K.five_crop(px, w, h), "TenCrop": lambda px, w, h, vertical_flip=False: K.ten_crop(px, w, h, vertical_flip)}


def keyed(steps: list[Step], parent: int | None = None, seen: dict[str, int] | None = None) -> list[tuple[str, dict, int]]:
    """Steps with their keys: each kind counts its own occurrences among its siblings, in declared order; below a random
    step the key is combined with the parent's."""
    seen = {} if seen is None else seen
    out = []
    for name, args in steps:
        if name == "ImageConcat":  # the branches' steps count on, in declared order
            args = args | {"branches": tuple(keyed(branch, parent, seen) for branch in args["branches"])}
        n = seen[name] = seen.get(name, -1) + 1
        out.append((name, args, op_key(name, n) if parent is None else combine(parent, op_key(name, n))))
    return out


def choice_bounds(count: int, p) -> list[float] | None:
    """The upper bounds of the choices' shares, from their weights; from the last positive weight on they are 1."""
    if count == 0:
        raise ValueError("random_choice needs a choice")
    if p is None:
        return None
    if len(p) != count or any(not math.isfinite(x) or x < 0 for x in p) or not (0 < sum(p) < math.inf):
        raise ValueError("random_choice needs a finite weight of 0 or more for each choice, and a positive sum")
    upper = np.cumsum(np.array(p, float) / sum(p)).tolist()
    last = max(k for k, x in enumerate(p) if x > 0)
    return upper[:last] + [1.0] * (count - last)


def apply(steps: list[tuple[str, dict, int]], images: list[np.ndarray], stream: Callable[[int], Stream]) -> list[np.ndarray]:
    """Runs keyed steps; ``stream(key)`` gives this row's draws for a key. Views make several images of one."""
    for name, args, key in steps:
        if name in PLAIN:
            images = [PLAIN[name](px, **args) for px in images]
        elif name in VIEWS:
            images = [v for px in images for v in VIEWS[name](px, **args)]
        elif name == "ImageConcat":
            images = [np.concatenate([_one(apply(branch, [px], stream)) for branch in args["branches"]], axis=args["axis"]) for px in images]
        elif name in RANDOM:
            images = [RANDOM[name](px, stream(key if k == 0 else combine(key, k)), **args) for k, px in enumerate(images)]
        else:
            images = apply(chosen(name, args, key, stream), images, stream)
    return images


def _one(images: list[np.ndarray]) -> np.ndarray:
    if len(images) != 1:
        raise ValueError("a branch gives one image")
    return images[0]


def chosen(name: str, args: dict, key: int, stream: Callable[[int], Stream]) -> list[tuple[str, dict, int]]:
    """The keyed steps that a random step of steps comes down to."""
    s = stream(key)
    if name == "RandomApply":
        return keyed(args["steps"], key) if s.coin(args["p"]) else []
    if name == "RandomOrder":
        return _shuffled(s, keyed(args["steps"], key))
    upper = choice_bounds(len(args["choices"]), args.get("p"))
    if upper is None:
        k = s.below(len(args["choices"]))
    else:
        k = min(bisect_right(upper, s.f64()), len(upper) - 1)
    return keyed(args["choices"][k], combine(key, op_key("RandomChoiceBranch", k)))
