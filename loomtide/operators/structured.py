"""Annotated samples: one geometry for an image, its boxes, masks and keypoints.

A sample is a dict: image (HWC), boxes (N, 4 float32 xyxy), labels (N), masks (N, H, W or H, W) and keypoints (N, K, 2).
``transformed`` applies steps to rows of a DataFrame with these as columns, in one Arrow stage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import image_ops
from . import kernels as K
from .rng import Context, Stream

SCHEMA = "pos long, h int, w int, c int, image binary, boxes array<array<float>>, labels array<long>, keypoints array<array<array<float>>>, masks array<binary>"


def _corners(boxes: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = boxes.T
    return np.stack([np.stack([x1, y1], -1), np.stack([x2, y1], -1), np.stack([x2, y2], -1), np.stack([x1, y2], -1)], 1)


def envelope(points: np.ndarray) -> np.ndarray:
    """Boxes around four mapped corners."""
    return np.concatenate([points.min(1), points.max(1)], axis=1)


def _mapped(s: dict, point, clip: tuple[int, int] | None, keypoint=None) -> dict:
    s = dict(s)
    if len(s["boxes"]):
        b = envelope(point(_corners(s["boxes"].astype(np.float64)))).astype(np.float32)
        s["boxes"] = np.clip(b, 0, np.array([*clip, *clip], np.float32)) if clip else b
        s["keypoints"] = (keypoint or point)(s["keypoints"].astype(np.float64)).astype(np.float32) if s["keypoints"].size else s["keypoints"]
    return s


def _with(s: dict, image: np.ndarray, masks) -> dict:
    return s | {"image": image, "masks": np.stack([masks(m) for m in s["masks"]]) if len(s["masks"]) else s["masks"].reshape(0, *image.shape[:2])}


def horizontal_flip(s: dict) -> dict:
    w = s["image"].shape[1]
    turn = lambda edge: lambda p: np.stack([edge - p[..., 0], p[..., 1]], -1)
    return _with(_mapped(s, turn(w), None, turn(w - 1)), s["image"][:, ::-1], lambda m: m[:, ::-1])


def vertical_flip(s: dict) -> dict:
    h = s["image"].shape[0]
    turn = lambda edge: lambda p: np.stack([p[..., 0], edge - p[..., 1]], -1)
    return _with(_mapped(s, turn(h), None, turn(h - 1)), s["image"][::-1], lambda m: m[::-1])


def resize(s: dict, w: int, h: int, interpolation: str = "bilinear") -> dict:
    ih, iw = s["image"].shape[:2]
    scale = np.array([w / iw, h / ih])
    rows, cols = np.arange(h) * ih // h, np.arange(w) * iw // w
    return _with(_mapped(s, lambda p: p * scale, None), K.resize(s["image"], w, h, interpolation), lambda m: m[rows][:, cols])


def crop(s: dict, x: int, y: int, w: int, h: int) -> dict:
    return _with(_mapped(s, lambda p: p - np.array([x, y]), (w, h), lambda p: p - np.array([x, y])), K.crop(s["image"], x, y, w, h), lambda m: K.crop(m[..., None], x, y, w, h)[..., 0])


def pad(s: dict, sides: tuple[int, int, int, int], fill: float = 0, mode: str = "constant") -> dict:
    return _with(_mapped(s, lambda p: p + np.array([sides[0], sides[1]]), None), K.pad(s["image"], sides, fill, mode), lambda m: K.pad(m[..., None], sides, 0, mode)[..., 0])


def sanitize(s: dict, min_size: float = 1.0, min_area: float = 1.0) -> dict:
    """Drops small boxes and those outside, with their labels, masks and keypoints."""
    h, w = s["image"].shape[:2]
    b = s["boxes"]
    bw, bh = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    ok = (bw >= min_size) & (bh >= min_size) & (bw * bh >= min_area) & (b[:, 0] >= 0) & (b[:, 1] >= 0) & (b[:, 2] <= w) & (b[:, 3] <= h)
    return s | {k: s[k][ok] for k in ("boxes", "labels", "keypoints", "masks") if len(s[k]) == len(ok)}


def iou(boxes: np.ndarray, one: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(boxes[:, :2], one[:2]), np.minimum(boxes[:, 2:], one[2:])
    both = np.prod(np.maximum(hi - lo, 0), axis=1)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    return both / np.maximum(area(boxes) + area(one) - both, 1e-12)


def iou_crop_options(low=0.3, high=1.0, min_ratio=0.5, max_ratio=2.0, options=(0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0), trials=40, max_attempts=100) -> dict:
    """The options of ``random_iou_crop``, checked: windows have a share of 0 to 1 of each side."""
    sizes = all(math.isfinite(x) for x in (low, high, min_ratio, max_ratio)) and 0 < low <= high <= 1 and 0 < min_ratio <= max_ratio
    if not sizes or trials < 1 or max_attempts < 1 or not len(options) or not all(math.isfinite(x) and x >= 0 for x in options):
        raise ValueError("random_iou_crop takes rising scales in (0, 1], rising positive ratios, options of 0 or more, and a trial and an attempt at least")
    return {"low": low, "high": high, "min_ratio": min_ratio, "max_ratio": max_ratio, "options": tuple(options), "trials": trials, "max_attempts": max_attempts}


def _overlaps(boxes: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """Of float32 boxes with a window: sides and areas in float32, the quotient in float64."""
    b, zero = boxes.astype(np.float32), np.float32(0)
    wide = np.maximum(np.minimum(b[:, 2], np.float32(x + w)) - np.maximum(b[:, 0], np.float32(x)), zero)
    high = np.maximum(np.minimum(b[:, 3], np.float32(y + h)) - np.maximum(b[:, 1], np.float32(y)), zero)
    both = (wide * high).astype(np.float64)
    own = (np.maximum(b[:, 2] - b[:, 0], zero) * np.maximum(b[:, 3] - b[:, 1], zero)).astype(np.float64)
    return both / (own + float(w * h) - both)


def random_iou_crop(s: dict, r: Stream, low=0.3, high=1.0, min_ratio=0.5, max_ratio=2.0, options=(0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0), trials=40, max_attempts=100) -> dict:
    """A random window that overlaps some box enough; boxes whose centre is outside become empty. Too many attempts: as is.
    A sample without boxes is left as it is, before any draw."""
    h, w = s["image"].shape[:2]
    if not len(s["boxes"]):
        return s
    for _ in range(max_attempts):
        least = options[r.below(len(options))]
        if least >= 1.0:
            return s
        for _ in range(trials):
            nw, nh = int(w * (low + (high - low) * r.f64())), int(h * (low + (high - low) * r.f64()))
            if not (nh and nw and min_ratio <= nw / nh <= max_ratio):
                continue
            x, y = int((w - nw) * r.f64()), int((h - nh) * r.f64())
            centre = (s["boxes"][:, :2] + s["boxes"][:, 2:]) / 2
            inside = (centre[:, 0] > x) & (centre[:, 0] < x + nw) & (centre[:, 1] > y) & (centre[:, 1] < y + nh)
            if inside.any() and _overlaps(s["boxes"][inside], x, y, nw, nh).max() >= least:
                out = crop(s, x, y, nw, nh)
                out["boxes"] = np.where(inside[:, None], out["boxes"], 0).astype(np.float32)
                return out
    return s


def center_crop(s: dict, w: int, h: int) -> dict:
    ih, iw = s["image"].shape[:2]
    pw, ph = max(0, w - iw), max(0, h - ih)
    if pw or ph:
        s = pad(s, (pw // 2, ph // 2, pw - pw // 2, ph - ph // 2))
    ih, iw = s["image"].shape[:2]
    return crop(s, K.offset(iw - w), K.offset(ih - h), w, h)


def resized_crop(s: dict, x: int, y: int, w: int, h: int, ow: int, oh: int, interpolation: str = "bilinear") -> dict:
    return resize(crop(s, x, y, w, h), ow, oh, interpolation)


def _warped(s: dict, image: np.ndarray, m) -> dict:
    """Boxes, masks and keypoints of an image warped by an inverse matrix (six numbers, or eight of a homography): boxes
    become the envelope of their corners inside the image, masks take the nearest pixel."""
    full = np.array([*m, *((0.0, 0.0, 1.0) if len(m) == 6 else (1.0,))]).reshape(3, 3)
    back = np.linalg.inv(full)

    def point(p: np.ndarray) -> np.ndarray:
        q = np.concatenate([p, np.ones((*p.shape[:-1], 1))], -1) @ back.T
        with np.errstate(divide="ignore", invalid="ignore"):
            out = q[..., :2] / q[..., 2:]
        if not np.isfinite(out).all():
            raise ValueError("a point maps to no finite place")
        return out

    h, w = image.shape[:2]
    return _with(_mapped(s, point, (w, h)), image, lambda mask: K.warp(mask[..., None], tuple(m), (w, h), "nearest")[..., 0])


def affine(s: dict, angle=0.0, translate=(0, 0), scale=1.0, shear=(0.0, 0.0), interpolation="nearest", fill=None, center=None) -> dict:
    h, w = s["image"].shape[:2]
    m = K.affine_matrix(center or (w / 2, h / 2), angle, translate, scale, shear)
    return _warped(s, K.affine(s["image"], angle, translate, scale, shear, interpolation, fill, center), m)


def arbitrary_rotate(s: dict, angle: float, interpolation="nearest", expand=False, fill=None, center=None) -> dict:
    h, w = s["image"].shape[:2]
    m, _ = K.rotation(w, h, angle % 360.0, expand, center)
    return _warped(s, K.rotate(s["image"], angle, interpolation, expand, fill, center), m)


def perspective(s: dict, start, end, interpolation="bilinear", fill=None) -> dict:
    return _warped(s, K.perspective(s["image"], start, end, interpolation, fill), K.homography(start, end))


def clamp_boxes(s: dict) -> dict:
    h, w = s["image"].shape[:2]
    return s | {"boxes": np.clip(s["boxes"], 0, np.array([w, h, w, h], np.float32))}


def _resize_step(s: dict, w: int, h: int | None = None, interpolation: str = "bilinear", max_size: int | None = None) -> dict:
    ih, iw = s["image"].shape[:2]
    w, h = K.short_edge(iw, ih, w, max_size) if h is None else (w, h)
    return resize(s, w, h, interpolation)


#: Steps of places on whole samples; other fixed steps touch the image only.
STEPS = {
    "HorizontalFlip": horizontal_flip, "VerticalFlip": vertical_flip, "Resize": _resize_step, "Crop": crop, "CenterCrop": center_crop, "Pad": pad, "ResizedCrop": resized_crop, "Affine": affine,
    "ArbitraryRotate": arbitrary_rotate, "Rotate": lambda s, angle: arbitrary_rotate(s, angle, "nearest", True), "Perspective": perspective, "Sanitize": sanitize, "ClampBoxes": clamp_boxes,
}
#: What cannot move boxes, masks and keypoints along.
REFUSED = frozenset("FiveCrop TenCrop ElasticTransform AutoAugment RandAugment TrivialAugmentWide AugMix ImageConcat HwcToChw ChwToHwc LinearTransform Normalize ToFloat CastFloat".split())
_CONTROL = {"RandomApply": lambda a: [a["steps"]], "RandomOrder": lambda a: [a["steps"]], "RandomChoice": lambda a: a["choices"]}


def checked(steps: list[tuple[str, dict]]) -> None:
    """Raises for a step that does not apply to annotated samples, nested ones too."""
    for name, args in steps:
        if name in _CONTROL:
            for inner in _CONTROL[name](args):
                checked(list(inner))
            if name == "RandomChoice":
                image_ops.choice_bounds(len(args["choices"]), args.get("p"))
        elif name in REFUSED or not (name in STEPS or name == "RandomIoUCrop" or name in image_ops.RANDOM or name in image_ops.PLAIN):
            raise ValueError(f"{name} does not apply to annotated samples")
        elif name == "Sanitize" and min(args.get("min_size", 1.0), args.get("min_area", 1.0)) < 1:
            raise ValueError("sanitize thresholds must be 1 or more")


def apply(steps: list[tuple[str, dict, int]], s: dict, stream: Callable[[int], Stream]) -> dict:
    """Keyed steps on one sample: a random step of places is resolved once, for the image and all that goes with it."""
    for name, args, key in steps:
        if name in STEPS:
            s = STEPS[name](s, **args)
        elif name == "RandomIoUCrop":
            s = random_iou_crop(s, stream(key), **args)
        elif name in image_ops.RESOLVE:
            h, w = s["image"].shape[:2]
            for n, a in image_ops.RESOLVE[name](stream(key), w, h, **args):
                s = STEPS[n](s, **a)
        elif name in image_ops.RANDOM:
            s = s | {"image": image_ops.RANDOM[name](s["image"], stream(key), **args)}
        elif name in image_ops.PLAIN:
            s = s | {"image": image_ops.PLAIN[name](s["image"], **args)}
        else:
            s = apply(image_ops.chosen(name, args, key, stream), s, stream)
    return s


def transformed(samples: DataFrame, steps: list[tuple[str, dict]], seed: int = 0, epoch: int = 0) -> DataFrame:
    """Rows of SCHEMA (and batch columns, if there are) through steps; each random step draws by the row's source (its pos
    where there is none) and occurrence. Unknown steps are errors at once."""
    checked(steps)
    plan = image_ops.keyed(steps)
    extra = [f for f in samples.schema if f.name in ("source", "batch_id", "batch_pos")]
    context = Context(seed, epoch)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                n = len(r["boxes"])
                s = {
                    "image": np.frombuffer(r["image"], np.uint8).reshape(r["h"], r["w"], r["c"]), "boxes": np.array(r["boxes"], np.float32).reshape(n, 4), "labels": np.array(r["labels"], np.int64),
                    "keypoints": np.array(r["keypoints"], np.float32).reshape(n, -1, 2), "masks": np.array([np.frombuffer(m, np.uint8).reshape(r["h"], r["w"]) for m in r["masks"]]).reshape(-1, r["h"], r["w"]),
                }
                row = r.get("source", r["pos"])
                s = apply(plan, s, lambda key, row=row: context.stream(row, key))
                h, w, c = s["image"].shape
                out.append({"pos": r["pos"], "h": h, "w": w, "c": c, "image": np.ascontiguousarray(s["image"]).tobytes(), "boxes": s["boxes"].tolist(), "labels": s["labels"].tolist(), "keypoints": s["keypoints"].tolist(), "masks": [np.ascontiguousarray(m, np.uint8).tobytes() for m in s["masks"]]} | {f.name: r[f.name] for f in extra})
            f32 = pa.float32()
            kinds = pa.schema([("pos", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("image", pa.binary()), ("boxes", pa.list_(pa.list_(f32))), ("labels", pa.list_(pa.int64())), ("keypoints", pa.list_(pa.list_(pa.list_(f32)))), ("masks", pa.list_(pa.binary())), *[(f.name, pa.int32() if f.name == "batch_pos" else pa.int64()) for f in extra]])
            yield from pa.Table.from_pylist(out, schema=kinds).to_batches()

    told = ", ".join([SCHEMA, *[f"{f.name} {'int' if f.name == 'batch_pos' else 'long'}" for f in extra]])
    return samples.select(*[k.split()[0] for k in SCHEMA.split(", ")], *[f.name for f in extra]).mapInArrow(made, told)
