"""PNG files of every kind: 1 to 16 bits a sample, grey, colour, palette and alpha, plain and interlaced.

``decode`` takes many files. Their scanlines are unfiltered together where shapes agree: a row that looks to its left is worked
through along diagonals (all pixels of a diagonal have what they need), each step for all rows of a diagonal of all files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

Image = np.ndarray
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Fixed values of the format: first column and row and the steps of the seven passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def size(data: bytes) -> tuple[int, int]:
    """Height and width, from the header alone."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or len(data) < 33:
        raise ValueError("not a PNG image, or one without a header")
    w, h = struct.unpack(">II", data[16:24])
    return h, w


class _File:
    def __init__(self, data: bytes) -> None:
        self.h, self.w = size(data)
        self.depth, self.colour, _, _, self.interlaced = struct.unpack(">BBBBB", data[24:29])
        if not self.h or not self.w or self.depth not in _DEPTHS.get(self.colour, ()) or self.interlaced > 1:
            raise ValueError("PNG header that is not of the format")
        k, packed, self.palette = 8, [], None
        while k + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[k : k + 8])
            body = data[k + 8 : k + 8 + n]
            if kind == b"PLTE":
                self.palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            k += 12 + n
        if self.colour == 3 and self.palette is None:
            raise ValueError("PNG without its palette")
        try:
            raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
        except zlib.error as e:
            raise ValueError(f"PNG data is damaged: {e}") from None
        bits = _SAMPLES[self.colour] * self.depth
        self.lines: list[tuple[np.ndarray, np.ndarray, int, tuple]] = []  # kinds, bytes, bytes a pixel, place
        at = 0
        for x, y, dx, dy in PASSES if self.interlaced else ((0, 0, 1, 1),):
            w, h = -(-(self.w - x) // dx), -(-(self.h - y) // dy)
            if w > 0 and h > 0:
                row = 1 + (w * bits + 7) // 8
                if at + h * row > len(raw):
                    raise ValueError("PNG data ends early")
                part = raw[at : at + h * row].reshape(h, row)
                if part[:, 0].max() > 4:
                    raise ValueError("PNG row with a filter that is not known")
                self.lines.append((part[:, 0], part[:, 1:], max(1, bits // 8), (x, y, dx, dy, w, h)))
                at += h * row

    def pixels(self, parts: list[np.ndarray]) -> Image:
        """RGB from the unfiltered bytes of each pass."""
        n, out = _SAMPLES[self.colour], None
        for (*_, (x, y, dx, dy, w, h)), raw in zip(self.lines, parts, strict=True):
            if self.depth == 16:
                wide = np.ascontiguousarray(raw).view(">u2").astype(np.int64)
                px = ((wide + 128) // 257).astype(np.uint8).reshape(h, w, n)
            elif self.depth == 8:
                px = raw.reshape(h, w, n)
            else:
                bits = np.unpackbits(np.ascontiguousarray(raw), axis=1)[:, : w * self.depth].reshape(h, w, self.depth)
                px = (bits @ (1 << np.arange(self.depth)[::-1]))[..., None].astype(np.uint8)
                if self.colour == 0:
                    px = px * np.uint8(255 // ((1 << self.depth) - 1))
            if not self.interlaced:
                out = px
            else:
                out = np.empty((self.h, self.w, n), np.uint8) if out is None else out
                out[y::dy, x::dx] = px
        if self.colour == 3:
            if int(out.max()) >= len(self.palette):
                raise ValueError("PNG pixel beyond its palette")
            return self.palette[out[:, :, 0]]
        return np.ascontiguousarray(out[:, :, :3]) if n > 2 else np.repeat(out[:, :, :1], 3, axis=2)


def _rows(kinds: np.ndarray, out: np.ndarray) -> None:
    """Rows that look left or up, but not both: sums along a row, then down the rows."""
    image, row = np.nonzero(kinds == 1)
    out[image, row] = np.cumsum(out[image, row], axis=1, dtype=np.uint8)
    up = kinds == 2
    for y in np.flatnonzero(up[:, 1:].any(0)).tolist():
        at = up[:, y + 1]
        out[at, y + 1] += out[at, y]


def _diagonals(kinds: np.ndarray, out: np.ndarray) -> None:
    """Rows of all kinds. What a diagonal needs is on the two before it, by row: left and up on the last one, the corner on
    the one before that; a row of zeros stands above."""
    n, h, w, c = out.shape
    flat = np.ascontiguousarray(out.transpose(1, 2, 0, 3)).reshape(h * w, n * c)
    masks = {k: np.repeat((kinds == k).T, c, axis=1) for k in (1, 2, 3, 4) if (kinds == k).any()}
    two, one, now = (np.zeros((h + 1, n * c), np.int16) for _ in range(3))
    for d in range(w + h - 1):
        low, high = max(0, d - w + 1), min(h - 1, d)
        at = slice(d + low * (w - 1), d + high * (w - 1) + 1, w - 1) if w > 1 else slice(d, d + 1)
        left, up, corner = one[low + 1 : high + 2], one[low : high + 1], two[low : high + 1]
        guess = np.zeros(left.shape, np.int16)
        if 4 in masks:
            a, b = up - corner, left - corner
            e = np.abs(a + b)
            np.abs(a, a)
            np.abs(b, b)
            guess = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, corner))
        for k, value in ((3, None), (2, up), (1, left)):
            if k in masks:
                guess = np.where(masks[k][low : high + 1], (left + up) >> 1 if value is None else value, guess)
        if 4 in masks and (kinds == 0).any():
            guess = np.where(masks[4][low : high + 1] | (kinds.T[low : high + 1] > 0).repeat(c, axis=1), guess, 0)
        new = now[low + 1 : high + 2]
        np.add(flat[at], guess, out=new)
        new &= 255
        flat[at] = new
        two, one, now = one, now, two
    out[:] = flat.reshape(h, w, n, c).transpose(2, 0, 1, 3)


def unfiltered(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(n, h, w, c) bytes of filtered scanlines, with the kind of filter of each row (n, h)."""
    out = raw.copy()
    hard = kinds.max(1) > 2
    for which, work in ((~hard, _rows), (hard, _diagonals)):
        if which.all():
            work(kinds, out)
        elif which.any():
            some = out[which]
            work(kinds[which], some)
            out[which] = some
    return out


def _plain(data: bytes) -> bytes | None:
    """The scanlines of a file of three or four samples of 8 bits, in one piece and not interlaced; of others, and of those that
    may be damaged, nothing."""
    if len(data) < 57 or data[24:26] not in (b"\x08\x02", b"\x08\x06") or data[28] or data[37:41] != b"IDAT":
        return None
    n = int.from_bytes(data[33:37], "big")
    if data[45 + n : 53 + n] != b"\0\0\0\0IEND":
        return None
    try:
        raw = zlib.decompress(data[41 : 41 + n])
    except zlib.error:
        return None
    h, w = size(data)
    return raw if h and w and len(raw) == h * (1 + w * _SAMPLES[data[25]]) else None


def decode(files: list[bytes]) -> list[Image]:
    """RGB of PNG files. Grey repeats, alpha is dropped, 16 bits are rounded to 8. Plain files with the same header are one
    array from the start."""
    out: list[Image | None] = [None] * len(files)
    same: dict[bytes, list[tuple[int, bytes]]] = {}
    for i, x in enumerate(files):
        if (lines := _plain(x)) is not None:
            same.setdefault(x[8:33], []).append((i, lines))
    for head, members in same.items():
        w, h = struct.unpack(">II", head[8:16])
        c = _SAMPLES[head[17]]
        raw = np.frombuffer(b"".join(x for _, x in members), np.uint8).reshape(len(members), h, 1 + w * c)
        kinds = raw[:, :, 0]
        if kinds.max() > 4:
            continue  # found below, with its error
        px = raw[:, :, 1:].reshape(len(members), h, w, c)
        px = np.ascontiguousarray((unfiltered(kinds, px) if kinds.any() else px)[..., :3])
        for (i, _), one in zip(members, px, strict=True):
            out[i] = one
    rest = [i for i, x in enumerate(out) if x is None]
    for i, x in zip(rest, _decoded([files[i] for i in rest]), strict=True):
        out[i] = x
    return out


def _decoded(files: list[bytes]) -> list[Image]:
    """Files of any kind."""
    parsed = [_File(x) for x in files]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, f in enumerate(parsed):
        for j, (_, raw, step, _) in enumerate(f.lines):
            groups.setdefault((*raw.shape, step), []).append((i, j))
    done: dict[tuple[int, int], np.ndarray] = {}
    for (h, row, step), members in groups.items():
        kinds = np.stack([parsed[i].lines[j][0] for i, j in members])
        raw = np.stack([parsed[i].lines[j][1] for i, j in members])
        if kinds.any():
            raw = unfiltered(kinds, raw.reshape(len(members), h, row // step, step)).reshape(len(members), h, row)
        done.update(zip(members, raw, strict=True))
    return [f.pixels([done[i, j] for j in range(len(f.lines))]) for i, f in enumerate(parsed)]


def encode(px: Image) -> bytes:
    """A plain PNG file of 1 to 4 channels of 8 bits."""
    h, w, c = px.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
