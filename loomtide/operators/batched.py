"""Image steps on many images of one shape at once: (n, h, w, c) arrays, one NumPy call a step.

Draws are still each row's own (``Streams`` holds a state a row), so results are those of ``image_ops`` one by one. Steps
that are not here run one by one; ``segments`` says which ones."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from . import jpeg
from . import kernels as K
from .image_ops import VIEWS, erased
from .rng import STEP, Context, Stream, first_draws, row_states

Images = np.ndarray


class Streams:
    """The streams of many rows for one step."""

    def __init__(self, states: np.ndarray) -> None:
        self.states = states.astype(np.uint64)

    def __getitem__(self, rows: np.ndarray) -> Streams:
        return Streams(self.states[rows])

    def u64(self) -> np.ndarray:
        out = first_draws(self.states)
        self.states = self.states + np.uint64(STEP)
        return out

    def f64(self) -> np.ndarray:
        return (self.u64() >> np.uint64(11)).astype(np.float64) / (1 << 53)

    def f32(self) -> np.ndarray:
        return (self.u64() >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)

    def coin(self, p: float) -> np.ndarray:
        return self.f64() < p

    def below(self, n: int | np.ndarray) -> np.ndarray:
        """A draw under ``n``, one for all rows or one each."""
        n = np.broadcast_to(np.asarray(n, np.uint64), self.states.shape)
        least = (np.uint64(0) - n) % n  # of 2**64
        out = self.u64()
        while (low := np.flatnonzero(out < least)).size:
            again = self[low]
            out[low] = again.u64()
            self.states[low] = again.states
        return (out % n).astype(np.int64)

    def shuffled(self, k: int) -> np.ndarray:
        """A permutation of k things a row."""
        order = np.tile(np.arange(k), (len(self.states), 1))
        rows = np.arange(len(order))
        for i in range(k - 1, 0, -1):
            j = self.below(i + 1)
            one, other = order[rows, i].copy(), order[rows, j].copy()
            order[rows, i], order[rows, j] = other, one
        return order


def _each(f: np.ndarray | float) -> np.ndarray:
    f = np.asarray(f, np.float32)
    return f.reshape(-1, 1, 1, 1) if f.ndim else f


def blend(px: Images, base, f) -> Images:
    b, x = np.asarray(base).astype(np.float32), px.astype(np.float32)
    x -= b
    x *= _each(f)
    x += b
    return np.clip(x, 0, 255, out=x).astype(np.uint8)


def contrast(px: Images, f) -> Images:
    return blend(px, np.floor(K.luma(px).mean((1, 2)) + 0.5).reshape(-1, 1, 1, 1), f)


def resize(px: Images, w: int, h: int, kind: str = "bilinear") -> Images:
    if kind == "nearest":
        at = lambda n, out: np.minimum((np.cumsum(np.full(out, n / out)) - n / out / 2).astype(np.int64), n - 1)
        return px[:, at(px.shape[1], h)][:, :, at(px.shape[2], w)]
    return np.ascontiguousarray(K._pass(K._pass(px, w, 2, kind), h, 1, kind))


def pad(px: Images, sides, fill=0, mode="constant") -> Images:
    left, top, right, bottom = sides
    n, h, w, c = px.shape
    if mode == "constant":
        value = min(255, max(0, int(fill))) if px.dtype == np.uint8 else np.float32(fill)
        out = np.full((n, h + top + bottom, w + left + right, c), value, px.dtype)
        out[:, top : top + h, left : left + w] = px
        return out
    return K.pad(px.transpose(1, 2, 0, 3).reshape(h, w, n * c), sides, fill, mode).reshape(h + top + bottom, w + left + right, n, c).transpose(2, 0, 1, 3)


def cropped(px: Images, x: np.ndarray, y: np.ndarray, w: int, h: int) -> Images:
    """A window of one size, somewhere else in each image; a copy of whole rows each."""
    out = np.empty((len(px), h, w, px.shape[3]), px.dtype)
    for i, (a, b) in enumerate(zip(y.tolist(), x.tolist(), strict=True)):
        out[i] = px[i, a : a + h, b : b + w]
    return out


def normalized(px: Images, mean, std, planes: bool = False) -> Images:
    """Normalization, to planes (CHW) if wanted: bytes are turned before they become floats."""
    if planes:
        px = np.ascontiguousarray(px.transpose(0, 3, 1, 2))
    shape = (-1, 1, 1) if planes else (-1,)
    m, s = (np.asarray(v, np.float32).reshape(shape) for v in (mean, std))
    if px.dtype != np.uint8:
        return (px - m) / s
    out = np.multiply(px, np.float32(1) / (np.float32(255) * s), dtype=np.float32)
    out += -m / s
    return out


def blur(px: Images, sigma: float, size: int | None = None) -> Images:
    n, h, w, c = px.shape
    return K.gaussian_blur(px.transpose(1, 2, 0, 3).reshape(h, w, n * c), sigma, size).reshape(h, w, n, c).transpose(2, 0, 1, 3)


def _where(f: Callable) -> Callable:
    """A step that a coin turns on, for a kernel that keeps the shape."""

    def run(px: Images, s: Streams, p=0.5, **args) -> Images:
        at = s.coin(p)
        out = px.copy()
        out[at] = f(px[at], **args)
        return out

    return run


def _random_crop(px: Images, s: Streams, w, h, padding=(0, 0, 0, 0), pad_if_needed=False, fill=0, mode="constant") -> Images:
    if any(padding):
        px = pad(px, padding, fill, mode)
    if pad_if_needed:
        dw, dh = max(0, w - px.shape[2]), max(0, h - px.shape[1])
        if dw or dh:
            px = pad(px, (dw, dh, dw, dh), fill, mode)
    ih, iw = px.shape[1:3]
    if h > ih or w > iw:
        raise ValueError("crop is larger than the image")
    y = s.below(ih - h + 1)
    return cropped(px, s.below(iw - w + 1), y, w, h)


def _random_erasing(px: Images, s: Streams, p=0.5, **args) -> Images:
    """Rectangles differ, so the images that a coin takes are worked on one by one, in place of their copies."""
    out = px.copy()
    for i in np.flatnonzero(s.coin(p)).tolist():
        out[i] = erased(px[i], Stream(int(s.states[i])), **args)
    return out


def _random_resized_crop(px: Images, s: Streams, w, h, scale=(0.08, 1.0), ratio=(0.75, 1.3333334), interpolation="bilinear") -> Images:
    """Windows are drawn for all rows at once, ten times at most; rows that have none take the middle."""
    n, ih, iw = px.shape[:3]
    r = iw / ih
    cw, ch = (iw, round(iw / ratio[0])) if r < ratio[0] else (round(ih * ratio[1]), ih) if r > ratio[1] else (iw, ih)
    window = np.tile([(iw - cw) // 2, (ih - ch) // 2, cw, ch], (n, 1))
    left, low, high = np.arange(n), math.log(ratio[0]), math.log(ratio[1])
    for _ in range(10):
        if not len(left):
            break
        mine = s[left]
        area = ih * iw * (scale[0] + (scale[1] - scale[0]) * mine.f64())
        shape = np.array([math.exp(x) for x in (low + (high - low) * mine.f64()).tolist()])
        cw, ch = np.rint(np.sqrt(area * shape)).astype(np.int64), np.rint(np.sqrt(area / shape)).astype(np.int64)
        fits = (cw > 0) & (cw <= iw) & (ch > 0) & (ch <= ih)
        good = mine[np.flatnonzero(fits)]
        if len(good.states):
            x = good.below(iw - cw[fits] + 1)
            window[left[fits]] = np.stack([x, good.below(ih - ch[fits] + 1), cw[fits], ch[fits]], 1)
        s.states[left] = mine.states
        left = left[~fits]
    out = np.empty((n, h, w, px.shape[3]), px.dtype)
    for i, (x, y, cw, ch) in enumerate(window.tolist()):
        out[i] = K.resize(px[i, y : y + ch, x : x + cw], w, h, interpolation)
    return out


def _jpeg(px: Images, s: Streams, quality) -> Images:
    """Images of one quality go together."""
    q = quality[0] + s.below(quality[1] - quality[0] + 1)
    out = np.empty_like(px)
    for one in np.unique(q).tolist():
        out[q == one] = jpeg.compressed(px[q == one], one)
    return out


def autocontrast(px: Images) -> Images:
    p = px.astype(np.int32)
    lo, hi = p.min((1, 2), keepdims=True), p.max((1, 2), keepdims=True)
    return np.where(hi == lo, p, (p - lo) * 255 // np.where(hi == lo, 1, hi - lo)).astype(np.uint8)


def _color_jitter(px: Images, s: Streams, b=0.0, c=0.0, h=0.0, sat=0.0) -> Images:
    names = ["b", "c", "h"] + (["s"] if sat else [])
    order = s.shuffled(len(names))
    between = lambda low, high: np.float32(low) + (np.float32(high) - np.float32(low)) * s.f32()
    factor = lambda v: between(max(0.0, 1 - v), 1 + v) if v else None
    f = {"b": factor(b), "c": factor(c), "h": between(-h, h) if h else None, "s": factor(sat)}
    run = {"b": lambda x, v: blend(x, 0, v), "c": contrast, "h": K.hue, "s": lambda x, v: blend(x, K.luma(x)[..., None], v)}
    out = px.copy()
    code = order @ (len(names) ** np.arange(len(names)))
    for q in np.unique(code):
        at = np.flatnonzero(code == q)
        x = px[at]
        for k in order[at[0]]:
            if f[names[k]] is not None:
                x = run[names[k]](x, f[names[k]][at])
        out[at] = x
    return out


PLAIN: dict[str, Callable] = {
    "HorizontalFlip": lambda px: px[:, :, ::-1],
    "VerticalFlip": lambda px: px[:, ::-1],
    "Rotate": lambda px, angle: np.rot90(px, angle // 90, (1, 2)),
    "Pad": pad,
    "Brightness": lambda px, f: blend(px, 0, f),
    "Contrast": contrast,
    "Saturation": lambda px, f: blend(px, K.luma(px)[..., None], f),
    "Hue": K.hue,
    "Gamma": lambda px, g, gain=1.0: K.gamma(px, g, gain),
    "Grayscale": lambda px, channels=1: np.repeat(K.luma(px)[..., None].astype(np.uint8), channels, axis=3),
    "Invert": K.invert,
    "Posterize": lambda px, bits: K.posterize(px, bits),
    "Solarize": lambda px, threshold: K.solarize(px, threshold),
    "Autocontrast": autocontrast,
    "GaussianBlur": lambda px, sigma, kernel_size=None: blur(px, sigma, kernel_size),
    "PermuteChannels": lambda px, order: px[..., list(order)],
    "Rgb": lambda px: px if px.shape[3] == 3 else px[..., :3] if px.shape[3] == 4 else np.repeat(px[..., :1], 3, axis=3),
    "Normalize": normalized,
    "ToFloat": K.to_float,
    "ToUint8": K.to_uint8,
    "CastFloat": lambda px: px.astype(np.float32),
    "CastUint8": lambda px: (np.trunc(px).astype(np.int64) % 256).astype(np.uint8),
    "HwcToChw": lambda px: px.transpose(0, 3, 1, 2),
    "ChwToHwc": lambda px: px.transpose(0, 2, 3, 1),
}


def _plain_resize(px: Images, w, h=None, interpolation="bilinear", max_size=None) -> Images:
    if h is None:
        w, h = K.short_edge(px.shape[2], px.shape[1], w, max_size)
    return resize(px, w, h, interpolation)


PLAIN["Resize"] = _plain_resize
RANDOM: dict[str, Callable] = {
    "RandomCrop": _random_crop,
    "RandomHorizontalFlip": _where(PLAIN["HorizontalFlip"]),
    "RandomVerticalFlip": _where(PLAIN["VerticalFlip"]),
    "RandomGrayscale": lambda px, s, p=0.1, channels=3: _where(lambda x: PLAIN["Grayscale"](x, 3))(px, s, p),
    "RandomInvert": _where(K.invert),
    "RandomPosterize": _where(PLAIN["Posterize"]),
    "RandomSolarize": _where(PLAIN["Solarize"]),
    "RandomErasing": _random_erasing,
    "RandomAutocontrast": _where(autocontrast),
    "RandomResizedCrop": _random_resized_crop,
    "JPEG": _jpeg,
    "ColorJitter": _color_jitter,
}


def fits(name: str, args: dict, layout: str) -> bool:
    """Whether a step runs on many images at once; colours and places need HWC."""
    if name == "RandomApply":
        return layout == "HWC" and all(n in PLAIN and fits(n, a, layout) and n in _SHAPE_KEPT for n, a in args["steps"])
    if name == "RandomGrayscale" and args.get("channels", 3) != 3:
        return False
    if layout == "CHW":
        return name in ("ChwToHwc", "ToFloat", "ToUint8", "CastFloat", "CastUint8")
    return name in PLAIN or name in RANDOM


_SHAPE_KEPT = frozenset("HorizontalFlip VerticalFlip Brightness Contrast Saturation Hue Gamma Invert Posterize Solarize GaussianBlur".split())


def segments(steps: list[tuple[str, dict, int]]) -> list[tuple[bool, list]]:
    """Runs of steps that work on many images at once (true) and of others; after several views of an image none does."""
    out: list[tuple[bool, list]] = []
    layout, views = "HWC", False
    for name, args, key in steps:
        views = views or name in VIEWS
        together = not views and fits(name, args, layout)
        if not out or out[-1][0] != together:
            out.append((together, []))
        out[-1][1].append((name, args, key))
        layout = {"HwcToChw": "CHW", "ChwToHwc": "HWC"}.get(name, layout)
    return out


def apply(steps: list[tuple[str, dict, int]], px: Images, context: Context, rows: np.ndarray) -> Images:
    """Keyed steps on images of one shape; ``rows`` are their source rows."""
    for k, (name, args, key) in enumerate(steps):
        if name == "Normalize" and k + 1 < len(steps) and steps[k + 1][0] == "HwcToChw":
            px = normalized(px, **args, planes=True)
        elif name == "HwcToChw" and k and steps[k - 1][0] == "Normalize":
            continue
        elif name in PLAIN:
            px = PLAIN[name](px, **args)
        elif name == "RandomApply":
            at = Streams(row_states(context, rows, key)).coin(args["p"])
            out = px.copy()
            out[at] = apply([(n, a, 0) for n, a in args["steps"]], px[at], context, rows[at])
            px = out
        else:
            px = RANDOM[name](px, Streams(row_states(context, rows, key)), **args)
    return px
