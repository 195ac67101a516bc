"""Image pipelines: an immutable list of steps over a DataFrame (pos, image, label), run as one Arrow stage.

Steps are checked as they are added (decode before anything else, colour on uint8 HWC, batches last), index steps are
pushed to the source, and all image steps fuse into a single ``mapInArrow``, so an image crosses to Python once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batched, codecs, image_ops, selection
from ..operators.rng import Context

#: Bytes of pixels that a step works on at once: what they become stays in a processor's cache.
CHUNK = 1 << 20
#: Bytes of pixels that are decoded at once: scanlines of many files are unfiltered together.
DECODED = 1 << 23
OUT = "pos long, source long, view int, h int, w int, c int, dtype string, layout string, data binary, label long"
STACKED = "batch_id long, n int, h int, w int, c int, dtype string, layout string, data binary, labels array<long>, sources array<long>"
#: Rows of whole batches that a task decodes and stacks.
TASK_ROWS = 4096
_U8_ONLY = frozenset("Brightness Contrast Saturation Hue Gamma Grayscale Invert Posterize Solarize Autocontrast Equalize Sharpness RandomGrayscale ColorJitter RandomInvert RandomPosterize RandomSolarize RandomAdjustSharpness RandomAutocontrast RandomEqualize RandomPhotometricDistort RandAugment TrivialAugmentWide AutoAugment AugMix JPEG".split())


class PipelineError(ValueError):
    """A step that cannot stand where it is put."""


class Ops:
    """The transforms that pipelines and reusable transforms share."""

    def _add(self, name: str, **args):
        raise NotImplementedError

    def resize(self, w, h=None, interpolation="bilinear", max_size=None):
        return self._add("Resize", w=w, h=h, interpolation=interpolation, max_size=max_size)

    def crop(self, x, y, w, h):
        return self._add("Crop", x=x, y=y, w=w, h=h)

    def center_crop(self, w, h=None):
        return self._add("CenterCrop", w=w, h=h or w)

    def five_crop(self, w, h=None):
        return self._add("FiveCrop", w=w, h=h or w)

    def ten_crop(self, w, h=None, vertical_flip=False):
        return self._add("TenCrop", w=w, h=h or w, vertical_flip=vertical_flip)

    def pad(self, padding, fill=0, mode="constant"):
        return self._add("Pad", sides=(padding,) * 4, fill=fill, mode=mode)

    def pad_with_sides(self, left, top, right, bottom, fill=0, mode="constant"):
        return self._add("Pad", sides=(left, top, right, bottom), fill=fill, mode=mode)

    def resized_crop(self, x, y, w, h, ow, oh, interpolation="bilinear"):
        return self._add("ResizedCrop", x=x, y=y, w=w, h=h, ow=ow, oh=oh, interpolation=interpolation)

    def horizontal_flip(self):
        return self._add("HorizontalFlip")

    def vertical_flip(self):
        return self._add("VerticalFlip")

    def rotate(self, angle):
        if angle % 90:
            raise PipelineError("rotate takes quarter turns; use arbitrary_rotate")
        return self._add("Rotate", angle=angle % 360)

    def arbitrary_rotate(self, angle, interpolation="nearest", expand=False, fill=None, center=None):
        return self._add("ArbitraryRotate", angle=angle, interpolation=interpolation, expand=expand, fill=fill, center=center)

    def affine(self, angle, translate, scale, shear, interpolation="nearest", fill=None, center=None):
        return self._add("Affine", angle=angle, translate=translate, scale=scale, shear=shear, interpolation=interpolation, fill=fill, center=center)

    def perspective(self, start, end, interpolation="bilinear", fill=None):
        return self._add("Perspective", start=start, end=end, interpolation=interpolation, fill=fill)

    def gaussian_blur(self, sigma, kernel_size=None):
        return self._add("GaussianBlur", sigma=sigma, kernel_size=kernel_size)

    def brightness(self, factor):
        return self._add("Brightness", f=factor)

    def contrast(self, factor):
        return self._add("Contrast", f=factor)

    def saturation(self, factor):
        return self._add("Saturation", f=factor)

    def hue(self, factor):
        if not -0.5 <= factor <= 0.5:
            raise PipelineError("hue is between -0.5 and 0.5")
        return self._add("Hue", f=factor)

    def gamma(self, g, gain=1.0):
        return self._add("Gamma", g=g, gain=gain)

    def grayscale(self, channels=1):
        return self._add("Grayscale", channels=channels)

    def invert(self):
        return self._add("Invert")

    def posterize(self, bits):
        if not 0 <= bits <= 8:
            raise PipelineError("bits are between 0 and 8")
        return self._add("Posterize", bits=bits)

    def solarize(self, threshold):
        return self._add("Solarize", threshold=threshold)

    def autocontrast(self):
        return self._add("Autocontrast")

    def equalize(self):
        return self._add("Equalize")

    def sharpness(self, factor):
        return self._add("Sharpness", f=factor)

    def erase(self, x, y, w, h, value=0):
        return self._add("Erase", x=x, y=y, w=w, h=h, value=value)

    def rgb(self):
        return self._add("Rgb")

    def permute_channels(self, order):
        if sorted(order) != list(range(len(order))):
            raise PipelineError("the order must be a permutation")
        return self._add("PermuteChannels", order=tuple(order))

    def linear_transform(self, matrix, mean):
        return self._add("LinearTransform", matrix=matrix, mean=mean)

    def normalize(self, mean, std):
        if any(s == 0 for s in std):
            raise PipelineError("std must not be 0")
        return self._add("Normalize", mean=tuple(mean), std=tuple(std))

    def convert_image_dtype(self, dtype):
        return self._add("ToFloat" if dtype == "float32" else "ToUint8")

    def to_dtype(self, dtype, scale=False):
        return self.convert_image_dtype(dtype) if scale else self._add("CastFloat" if dtype == "float32" else "CastUint8")

    def hwc_to_chw(self):
        return self._add("HwcToChw")

    def chw_to_hwc(self):
        return self._add("ChwToHwc")

    def to_tensor(self):
        return self.convert_image_dtype("float32").hwc_to_chw()

    def pil_to_tensor(self):
        return self.hwc_to_chw()

    # random

    def random_crop(self, w, h=None, padding=0, pad_if_needed=False, fill=0, mode="constant"):
        sides = (padding,) * 4 if isinstance(padding, int) else tuple(padding)
        return self._add("RandomCrop", w=w, h=h or w, padding=sides, pad_if_needed=pad_if_needed, fill=fill, mode=mode)

    def random_resized_crop(self, w, h=None):
        return self._add("RandomResizedCrop", w=w, h=h or w)

    def random_resized_crop_with_options(self, w, h, scale=(0.08, 1.0), ratio=(0.75, 1.3333334), interpolation="bilinear"):
        return self._add("RandomResizedCrop", w=w, h=h, scale=scale, ratio=ratio, interpolation=interpolation)

    def random_horizontal_flip(self, p=0.5):
        return self._add("RandomHorizontalFlip", p=p)

    def random_vertical_flip(self, p=0.5):
        return self._add("RandomVerticalFlip", p=p)

    def random_rotation(self, degrees, **options):
        return self._add("RandomRotation", degrees=(-degrees, degrees) if isinstance(degrees, int | float) else tuple(degrees), **options)

    def random_affine(self, degrees, **options):
        return self._add("RandomAffine", degrees=(-degrees, degrees) if isinstance(degrees, int | float) else tuple(degrees), **options)

    def random_perspective(self, distortion=0.5, p=0.5, **options):
        return self._add("RandomPerspective", distortion=distortion, p=p, **options)

    def elastic_transform(self, alpha=50.0, sigma=5.0, **options):
        return self._add("ElasticTransform", alpha=alpha, sigma=sigma, **options)

    def random_gaussian_blur(self, kernel_size, sigma=(0.1, 2.0)):
        return self._add("RandomGaussianBlur", kernel_size=kernel_size, sigma=sigma)

    def color_jitter(self, brightness=0.0, contrast=0.0, hue=0.0, saturation=0.0):
        return self._add("ColorJitter", b=brightness, c=contrast, h=hue, sat=saturation)

    def random_grayscale(self, p=0.1, channels=3):
        return self._add("RandomGrayscale", p=p, channels=channels)

    def random_erasing(self, p=0.5):
        return self._add("RandomErasing", p=p)

    def random_erasing_with_options(self, p=0.5, scale=(0.02, 0.33), ratio=(0.3, 3.3333333), value=0):
        return self._add("RandomErasing", p=p, scale=scale, ratio=ratio, value=value)

    def random_invert(self, p=0.5):
        return self._add("RandomInvert", p=p)

    def random_posterize(self, bits, p=0.5):
        return self._add("RandomPosterize", bits=bits, p=p)

    def random_solarize(self, threshold, p=0.5):
        return self._add("RandomSolarize", threshold=threshold, p=p)

    def random_adjust_sharpness(self, factor, p=0.5):
        return self._add("RandomAdjustSharpness", f=factor, p=p)

    def random_autocontrast(self, p=0.5):
        return self._add("RandomAutocontrast", p=p)

    def random_equalize(self, p=0.5):
        return self._add("RandomEqualize", p=p)

    def random_photometric_distort(self, **options):
        return self._add("RandomPhotometricDistort", **options)

    def random_channel_permutation(self, p=1.0):
        return self._add("RandomChannelPermutation", p=p)

    def gaussian_noise(self, mean=0.0, sigma=0.1, clip=True):
        return self._add("GaussianNoise", mean=mean, sigma=sigma, clip=clip)

    def random_resize(self, low, high, interpolation="bilinear"):
        return self._add("RandomResize", low=low, high=high, interpolation=interpolation)

    def random_shortest_size(self, sizes, max_size=None, interpolation="bilinear"):
        return self._add("RandomShortestSize", sizes=tuple(sizes), max_size=max_size, interpolation=interpolation)

    def scale_jitter(self, w, h, scale=(0.1, 2.0), interpolation="bilinear"):
        return self._add("ScaleJitter", w=w, h=h, scale=scale, interpolation=interpolation)

    def random_zoom_out(self, fill=0, side=(1.0, 4.0), p=0.5):
        return self._add("RandomZoomOut", fill=fill, side=side, p=p)

    def rand_augment(self, num_ops=2, magnitude=9, bins=31):
        return self._add("RandAugment", num_ops=num_ops, magnitude=magnitude, bins=bins)

    def trivial_augment_wide(self, bins=31):
        return self._add("TrivialAugmentWide", bins=bins)

    def auto_augment(self, policy="imagenet"):
        if policy not in ("imagenet", "cifar10", "svhn"):
            raise PipelineError(f"unknown policy {policy}")
        return self._add("AutoAugment", policy=policy)

    def augmix(self, severity=3, width=3, depth=-1, alpha=1.0, all_ops=True, interpolation="bilinear", fill=0):
        if not 1 <= severity <= 10 or width < 1 or not (math.isfinite(alpha) and alpha > 0):
            raise PipelineError("augmix takes a severity of 1 to 10, a positive width and a positive alpha")
        if interpolation not in ("nearest", "bilinear"):
            raise PipelineError("augmix samples nearest or bilinear")
        return self._add("AugMix", severity=severity, width=width, depth=depth, alpha=alpha, all_ops=all_ops, interpolation=interpolation, fill=fill)

    def jpeg(self, quality):
        """What a baseline JPEG file of a quality keeps, chroma at half size; (low, high) draws a quality for each image."""
        q = (quality, quality) if isinstance(quality, int) else tuple(quality)
        if len(q) != 2 or not all(isinstance(x, int) and 1 <= x <= 100 for x in q) or q[0] > q[1]:
            raise PipelineError("jpeg takes a quality of 1 to 100, or a lowest and a highest one")
        return self._add("JPEG", quality=q)

    def compose(self, transform):
        out = self
        for name, args in transform.steps:
            out = out._add(name, **args)
        return out

    def random_apply(self, p, transform):
        return self._add("RandomApply", p=p, steps=tuple(transform.steps))

    def random_choice(self, choices, p=None):
        image_ops.choice_bounds(len(choices), p)
        return self._add("RandomChoice", choices=tuple(tuple(t.steps) for t in choices), p=p)

    def concat(self, branches, axis=1):
        """The images of several transforms of this image, one beside the other along an axis (0 to 2)."""
        if len(branches) < 2 or axis not in (0, 1, 2):
            raise PipelineError("concat takes two branches or more and an axis of 0, 1 or 2")
        return self._add("ImageConcat", branches=tuple(tuple(t.steps) for t in branches), axis=axis)

    def random_order(self, transform):
        return self._add("RandomOrder", steps=tuple(transform.steps))


@dataclass(frozen=True)
class Transform(Ops):
    """A reusable list of steps."""

    steps: tuple = ()

    def _add(self, name: str, **args) -> Transform:
        return replace(self, steps=(*self.steps, (name, args)))


@dataclass(frozen=True)
class State:
    decoded: bool = False
    batched: bool = False
    dtype: str = "uint8"
    layout: str = "HWC"
    views: int = 1


@dataclass(frozen=True)
class Pipeline(Ops):
    """``df`` has pos (dense from 0), image (PNG or JPEG bytes, or raw uint8 HWC with h, w and c columns) and label."""

    df: DataFrame
    steps: tuple = ()
    index: tuple = ()
    state: State = field(default_factory=State)
    seed_: int | None = None
    epoch_: int = 0
    batch_: tuple[int, bool] | None = None

    def _add(self, name: str, **args) -> Pipeline:
        s = self.state
        if s.batched:
            raise PipelineError(f"{name} comes after batch")
        if not s.decoded:
            raise PipelineError(f"{name} needs decoded images")
        if name in _U8_ONLY and (s.dtype != "uint8" or s.layout != "HWC"):
            raise PipelineError(f"{name} needs uint8 images in HWC order")
        if s.layout == "CHW" and name not in ("ChwToHwc", "LinearTransform", "ToFloat", "ToUint8", "CastFloat", "CastUint8"):
            raise PipelineError(f"{name} needs images in HWC order")
        if name == "Resize" and s.dtype == "float32" and any(n == "Normalize" for n, _ in self.steps):
            raise PipelineError("resize after normalize")
        if name in ("ToFloat", "CastFloat", "Normalize"):
            s = replace(s, dtype="float32")
        elif name in ("ToUint8", "CastUint8"):
            if s.dtype == "uint8":
                return self
            s = replace(s, dtype="uint8")
        elif name in ("HwcToChw", "ChwToHwc"):
            if self.steps and {self.steps[-1][0], name} == {"HwcToChw", "ChwToHwc"}:  # a turn and its inverse
                return replace(self, steps=self.steps[:-1], state=replace(s, layout="CHW" if name == "HwcToChw" else "HWC"))
            s = replace(s, layout="CHW" if name == "HwcToChw" else "HWC")
        elif name in image_ops.VIEWS:
            if s.views > 1:
                raise PipelineError("views of views")
            s = replace(s, views=5 if name == "FiveCrop" else 10)
        elif name == "LinearTransform" and s.dtype != "float32":
            raise PipelineError("linear_transform needs float32 images")
        elif name == "ImageConcat":
            ends = {self._branch(branch) for branch in args["branches"]}
            if len(ends) > 1 or s.views > 1:
                raise PipelineError("branches must end with one dtype, layout and view each")
            dtype, layout = ends.pop()
            s = replace(s, dtype=dtype, layout=layout)
        return replace(self, steps=(*self.steps, (name, args)), state=s)

    def _branch(self, steps: tuple) -> tuple[str, str]:
        """The dtype and layout that a branch's steps end with."""
        end = replace(self, steps=())
        for name, args in steps:
            end = end._add(name, **args)
        if end.state.views > 1:
            raise PipelineError("a branch gives one image")
        return end.state.dtype, end.state.layout

    def decode_image(self) -> Pipeline:
        if self.state.decoded:
            raise PipelineError("images are decoded already")
        return replace(self, state=replace(self.state, decoded=True))

    def _indexed(self, *op) -> Pipeline:
        if self.state.batched or self.state.views > 1:
            raise PipelineError(f"{op[0]} comes after batches or views")
        return replace(self, index=(*self.index, op))

    def skip(self, n: int) -> Pipeline:
        return self._indexed("skip", n)

    def take(self, n: int) -> Pipeline:
        return self._indexed("take", n)

    def shuffle(self, seed: int | None = None) -> Pipeline:
        return self._indexed("shuffle", 0 if seed is None else seed)

    def seed(self, seed: int) -> Pipeline:
        return replace(self, seed_=seed)

    def epoch(self, epoch: int) -> Pipeline:
        return replace(self, epoch_=epoch)

    def workers(self, n: int) -> Pipeline:
        """A hint that never changes results."""
        return self

    def prefetch_batches(self, n: int) -> Pipeline:
        """A hint that never changes results."""
        return self

    def batch(self, size: int, drop_last: bool = False) -> Pipeline:
        if not self.state.decoded:
            raise PipelineError("encoded images cannot be batched")
        if size <= 0:
            raise PipelineError("batch size must be positive")
        return replace(self, batch_=(size, drop_last), state=replace(self.state, batched=True))

    def _source(self) -> DataFrame:
        df = self.df.withColumn("source", F.col("pos"))
        seed = self._seed()
        n, k = None, 0
        for op, arg in self.index:
            if op == "skip":
                df = selection.skip(df, arg)
                n = None if n is None else max(0, n - arg)
            elif op == "take":
                df = selection.take(df, arg)
                n = None if n is None else min(n, arg)
            else:
                n = df.count() if n is None else n
                df = selection.shuffle(df, n, seed, self.epoch_, k, arg)
                k += 1
        return df

    def execute(self) -> DataFrame:
        """Rows (pos, source, view, h, w, c, dtype, layout, data, label), with batch_id and batch_pos after batch()."""
        return self._executed(False)

    def stacked(self) -> DataFrame:
        """A row for each batch, stacked where it was made: batch_id, n (images, with all views), h, w, c, dtype, layout, data, labels
        and sources. Encoded rows are dealt by ranges of batches, so partitions are in the order of batches and no pixels are shuffled
        or sorted. Images of a batch that differ in shape are an error."""
        if not self.batch_ or not self.state.decoded:
            raise PipelineError("stacked comes after batch")
        return self._executed(True)

    def _length(self) -> int:
        """How many rows the index steps leave."""
        n = self.df.count()
        for op, arg in self.index:
            n = max(0, n - arg) if op == "skip" else min(n, arg) if op == "take" else n
        return n

    def _executed(self, stack: bool) -> DataFrame:
        df = self._source()
        context = Context(self._seed(), self.epoch_)
        if self.batch_:
            # a batch counts source rows; its views stay together
            df = selection.batch(df, *self.batch_)
        if not self.state.decoded:
            return df
        if stack:
            each = max(1, TASK_ROWS // self.batch_[0])
            tasks = max(1, -(-self._length() // (each * self.batch_[0])))
            df = df.repartitionById(tasks, F.expr(f"cast(batch_id div {each} as int)")).sortWithinPartitions("batch_id", "batch_pos")
        raw = "h" in self.df.columns
        steps, layout = image_ops.keyed(list(self.steps)), self.state.layout
        extra = ["batch_id", "batch_pos"] if self.batch_ else []
        segments = batched.segments(steps)

        def decoded(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(places in the batch, images) of images of one shape, about CHUNK bytes at a time."""
            image = b.column("image")
            if image.null_count:
                row = int(np.flatnonzero(image.is_null().to_numpy(zero_copy_only=False))[0])
                raise ValueError(f"image is null at row {b.column('source')[row].as_py()}")
            if raw:
                shape = np.stack([b.column(k).to_numpy() for k in ("h", "w", "c")], axis=1)
            else:
                shape = np.array([(*codecs.size(memoryview(x.as_buffer()).cast("B")), 3) for x in image], np.int64).reshape(-1, 3)
            kinds, of = np.unique(shape, axis=0, return_inverse=True)
            for k, (h, w, c) in enumerate(kinds.tolist()):
                every = np.flatnonzero(of.reshape(-1) == k)
                size = h * w * c
                if raw:
                    for at in np.array_split(every, len(every) * size // CHUNK + 1):
                        data = np.frombuffer(b"".join(image[i].as_buffer() for i in at.tolist()), np.uint8)
                        yield at, data.reshape(len(at), h, w, c)
                    continue
                for some in np.array_split(every, len(every) * size // DECODED + 1):
                    if len(some):
                        px = np.stack(codecs.decode([image[i].as_py() for i in some.tolist()]))
                        for part in np.array_split(np.arange(len(some)), len(some) * size // CHUNK + 1):
                            yield some[part], px[part]

        def stepped(at: np.ndarray, px: np.ndarray, source: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(places, views, images) of one shape each after all steps. Steps that only work one by one do so between others
            that work on many images; what they give is stacked again by shape."""
            now = [(at, np.zeros(len(at), np.int32), px)]
            for together, some in segments:
                if together:
                    now = [(at, views, batched.apply(some, px, context, source[at])) for at, views, px in now]
                    continue
                rest: dict[tuple, list] = {}
                for at, _, px in now:
                    for i, one in zip(at.tolist(), px, strict=True):
                        images = image_ops.apply(some, [one], lambda key, row=int(source[i]): context.stream(row, key))
                        for v, x in enumerate(images):
                            rest.setdefault((x.shape, x.dtype), []).append((i, v, x))
                now = [(np.array([i for i, _, _ in same]), np.array([v for _, v, _ in same], np.int32), np.stack([x for _, _, x in same])) for same in rest.values()]
            yield from now

        def told(b: pa.RecordBatch, at: np.ndarray, views: np.ndarray, px: np.ndarray) -> list[pa.RecordBatch]:
            """Batches of images of one shape; ``at`` are their rows in ``b``. Offsets are of 32 bits: at most 1 GiB a batch."""
            n = len(px)
            h, w, c = px.shape[1:] if layout == "HWC" else (px.shape[2], px.shape[3], px.shape[1])
            data = np.ascontiguousarray(px)
            size = data.nbytes // n
            if data.nbytes > 1 << 30:
                return [x for part in np.array_split(np.arange(n), data.nbytes // (1 << 30) + 1) for x in told(b, at[part], views[part], px[part])]
            offsets = pa.py_buffer((np.arange(n + 1) * size).astype(np.int32))
            pixels = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])
            rows = pa.array(at)
            take = lambda k: b.column(k).take(rows)
            same = lambda v, kind: pa.array(np.full(n, v), kind) if kind != pa.string() else pa.array([v] * n, kind)
            cols = [take("pos"), take("source"), pa.array(views, pa.int32()), *[same(v, pa.int32()) for v in (h, w, c)], same(str(px.dtype), pa.string()), same(layout, pa.string()), pixels, take("label")]
            return [pa.RecordBatch.from_arrays([*cols, *[take(e) for e in extra]], [*[k.split()[0] for k in OUT.split(", ")], *extra])]

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                source = b.column("source").to_numpy()
                for at, px in decoded(b):
                    if not len(at):
                        continue
                    for rows, views, out in stepped(at, px, source):
                        yield from told(b, rows, views, out)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Stacked batches; a batch is whole when a row of a later one has come."""
            held: dict[int, list] = {}

            def done(k: int) -> pa.RecordBatch:
                rows = sorted(held.pop(k), key=lambda x: x[0])
                shapes = {x[1] for x in rows}
                if len(shapes) != 1:
                    raise ValueError(f"images of a batch differ: {sorted(shapes)}")
                h, w, c, dtype, kind = shapes.pop()
                values = [k, len(rows), h, w, c, dtype, kind, b"".join(x[2] for x in rows), [x[3] for x in rows], [x[4] for x in rows]]
                kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [x.split()[0] for x in STACKED.split(", ")])

            for b in batches:
                for out in made(iter([b])):
                    small = {n: out.column(n).to_pylist() for n in ("batch_id", "batch_pos", "view", "h", "w", "c", "dtype", "layout", "label", "source")}
                    for i, data in enumerate(out.column("data")):
                        at = {n: v[i] for n, v in small.items()}
                        held.setdefault(at["batch_id"], []).append(((at["batch_pos"], at["view"]), tuple(at[n] for n in ("h", "w", "c", "dtype", "layout")), data.as_buffer().to_pybytes(), at["label"], at["source"]))
                if b.num_rows:
                    last = b.column("batch_id")[-1].as_py()
                    for k in sorted(k for k in held if k < last):
                        yield done(k)
            for k in sorted(held):
                yield done(k)

        cols = ["pos", "source", "image", "label", *(["h", "w", "c"] if raw else []), *extra]
        schema = OUT + (", batch_id long, batch_pos int" if extra else "")
        if stack:
            schema = STACKED
        return df.select(*[F.col(k).cast("long") if k in ("label", "batch_id") else F.col(k) for k in cols]).mapInArrow(whole if stack else made, schema)

    def _mixed(self, kind: str, num_classes: int, alpha: float, stacked: bool) -> DataFrame:
        from ..operators.mix import mixed, mixed_batches

        if not self.state.batched or self.state.views > 1:
            raise PipelineError(f"{kind} comes after batch, and not after views")
        if kind == "MixUp" and self.state.dtype != "float32":
            raise PipelineError("mixup takes float32 images; convert them first")
        run, rows = (mixed_batches, self.stacked()) if stacked else (mixed, self.execute())
        return run(rows, kind, num_classes, alpha, self._seed(), self.epoch_)

    def _seed(self) -> int:
        """The pipeline's seed, or that of its first shuffle."""
        return self.seed_ if self.seed_ is not None else next((a for k, a in self.index if k == "shuffle"), 0)

    def mixup(self, num_classes: int, alpha: float = 1.0, stacked: bool = False) -> DataFrame:
        """Terminal: the float32 batches with every row mixed with the one before it, and soft labels; as rows, or ``stacked``."""
        return self._mixed("MixUp", num_classes, alpha, stacked)

    def cutmix(self, num_classes: int, alpha: float = 1.0, stacked: bool = False) -> DataFrame:
        """Terminal: the batches with a rectangle of the row before pasted in, and soft labels; as rows, or ``stacked``."""
        return self._mixed("CutMix", num_classes, alpha, stacked)

    def explain(self) -> str:
        lines = ["source"] + [f"  {k}({a})" for k, a in self.index]
        lines += ["decode" if self.state.decoded else "encoded"] + [f"  {n}({', '.join(f'{k}={v!r}' for k, v in a.items() if v is not None)})" for n, a in self.steps]
        if self.batch_:
            lines.append(f"batch(size={self.batch_[0]}, drop_last={self.batch_[1]})")
        return "\n".join(lines)


def to_numpy(pipeline: Pipeline) -> Iterator[dict[str, np.ndarray]]:
    """Batches in order, as dicts of images and labels. They are stacked on the executors; here one partition of them is unpacked at
    a time. Ragged batches are errors."""
    for r in pipeline.stacked().toLocalIterator():
        shape = (r["h"], r["w"], r["c"]) if r["layout"] == "HWC" else (r["c"], r["h"], r["w"])
        yield {"images": np.frombuffer(r["data"], r["dtype"]).reshape(r["n"], *shape), "labels": np.array(r["labels"])}
