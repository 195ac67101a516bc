"""JPEG on arrays: what encoding at a quality does to pixels, and decoding of files (baseline and progressive, Huffman coded).

Arithmetic is that of the common integer codec, so results are equal to its own bit by bit: 16-bit fixed point colours,
13-bit cosine transforms with one rounding a pass, and triangle filters for chroma at half size. Entropy coding loses nothing, so
``compressed`` leaves it out and works on many images of one shape at once. ``decode`` looks up the code that would begin at every
bit of a scan at once, and only the steps from code to code are one after another."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

Image = np.ndarray

# Fixed values of the standard: quantisation at quality 50, by rows.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Zigzag place to place in the 8 by 8 block: along the diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
#: Largest axis of a JPEG image.
MOST = 65_500


def _fix(x: float, bits: int) -> int:
    return int(x * (1 << bits) + 0.5)


def quantiser(base: tuple, quality: int) -> np.ndarray:
    """A table scaled to a quality of 1 to 100, 8 bits each."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base, np.int64) * scale + 50) // 100, 1, 255).reshape(8, 8)


@lru_cache
def _cosines() -> tuple[np.ndarray, np.ndarray]:
    """The forward and the inverse 8-point transform as matrices of 13-bit integers: the sums that the codec's factored form
    comes to, from its rounded constants."""
    c = {k: _fix(v, 13) for k, v in dict(a=0.298631336, b=0.390180644, c=0.541196100, d=0.765366865, e=0.899976223, f=1.175875602, g=1.501321110, h=1.847759065, i=1.961570560, j=2.053119869, k=2.562915447, l=3.072711026).items()}
    one = np.eye(8, dtype=np.int64)
    # forward, from the sums and differences of mirrored inputs
    s, d = [one[k] + one[7 - k] for k in range(4)], [one[k] - one[7 - k] for k in range(4)]
    even = [(s[0] + s[3] + s[1] + s[2]) << 13, (s[0] + s[3] - s[1] - s[2]) << 13]
    z = (s[1] - s[2] + s[0] - s[3]) * c["c"]
    even += [z + (s[0] - s[3]) * c["d"], z - (s[1] - s[2]) * c["h"]]
    z5 = (d[3] + d[1] + d[2] + d[0]) * c["f"]
    z1, z2, z3, z4 = -(d[3] + d[0]) * c["e"], -(d[2] + d[1]) * c["k"], z5 - (d[3] + d[1]) * c["i"], z5 - (d[2] + d[0]) * c["b"]
    odd = [d[0] * c["g"] + z1 + z4, d[1] * c["l"] + z2 + z3, d[2] * c["j"] + z2 + z4, d[3] * c["a"] + z1 + z3]
    forward = np.stack([even[0], odd[0], even[2], odd[1], even[1], odd[2], even[3], odd[3]])
    # inverse: even and odd coefficients apart, then mirrored sums
    z = (one[2] + one[6]) * c["c"]
    t2, t3 = z - one[6] * c["h"], z + one[2] * c["d"]
    t0, t1 = (one[0] + one[4]) << 13, (one[0] - one[4]) << 13
    even = [t0 + t3, t1 + t2, t1 - t2, t0 - t3]
    z5 = (one[7] + one[3] + one[5] + one[1]) * c["f"]
    z1, z2, z3, z4 = -(one[7] + one[1]) * c["e"], -(one[5] + one[3]) * c["k"], z5 - (one[7] + one[3]) * c["i"], z5 - (one[5] + one[1]) * c["b"]
    odd = [one[1] * c["g"] + z1 + z4, one[3] * c["l"] + z2 + z3, one[5] * c["j"] + z2 + z4, one[7] * c["a"] + z1 + z3]
    inverse = np.stack([even[k] + odd[k] for k in range(4)] + [even[3 - k] - odd[3 - k] for k in range(4)])
    return forward.astype(np.float64), inverse.astype(np.float64)


def _rounded(x: np.ndarray, bits: int) -> np.ndarray:
    return np.floor((x + (1 << (bits - 1))) / (1 << bits))  # exact: whole numbers far below 2**53


def _forward(blocks: np.ndarray) -> np.ndarray:
    """Coefficients, times 8, of (..., 8, 8) samples around 0: rows, then columns."""
    m = _cosines()[0]
    return _rounded(m @ _rounded(blocks @ m.T, 11), 15)


def _inverse(coefficients: np.ndarray) -> np.ndarray:
    """uint8 samples of (..., 8, 8) coefficients: columns, then rows."""
    m = _cosines()[1]
    return np.clip(_rounded(_rounded(m @ coefficients, 11) @ m.T, 18) + 128, 0, 255).astype(np.uint8)


def _blocks(planes: np.ndarray) -> np.ndarray:
    n, h, w = planes.shape
    return planes.reshape(n, h // 8, 8, w // 8, 8).swapaxes(2, 3)


def _planes(blocks: np.ndarray) -> np.ndarray:
    n, rows, cols = blocks.shape[:3]
    return blocks.swapaxes(2, 3).reshape(n, rows * 8, cols * 8)


def _to(planes: np.ndarray, h: int, w: int) -> np.ndarray:
    """Planes with the last row and column repeated up to a size."""
    return np.pad(planes, ((0, 0), (0, h - planes.shape[1]), (0, w - planes.shape[2])), "edge")


def _luma_chroma(px: Image) -> list[np.ndarray]:
    r, g, b = (px[..., k].astype(np.int32) for k in range(3))
    f, half = (lambda x: _fix(x, 16)), 1 << 15
    low = (128 << 16) + half - 1
    return [
        (f(0.299) * r + f(0.587) * g + f(0.114) * b + half) >> 16,
        (-f(0.16874) * r - f(0.33126) * g + f(0.5) * b + low) >> 16,
        (f(0.5) * r - f(0.41869) * g - f(0.08131) * b + low) >> 16,
    ]


def _colours(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> Image:
    y, b, r = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    f, half = (lambda x: _fix(x, 16)), 1 << 15
    rgb = (y + ((f(1.402) * r + half) >> 16), y + ((-f(0.34414) * b - f(0.71414) * r + half) >> 16), y + ((f(1.772) * b + half) >> 16))
    return np.clip(np.stack(rgb, -1), 0, 255).astype(np.uint8)


def _halved(planes: np.ndarray) -> np.ndarray:
    """Means of 2 by 2 samples; what is between is rounded down and up in turn along a row."""
    four = planes[:, ::2, ::2] + planes[:, ::2, 1::2] + planes[:, 1::2, ::2] + planes[:, 1::2, 1::2]
    return (four + 1 + np.arange(four.shape[2]) % 2) >> 2


def _wider(x: np.ndarray, scale: int, low: int, high: int) -> np.ndarray:
    """Twice the columns: three parts of the nearer sample and one of the other; ``scale`` is the sum of an inner one's weights."""
    x = x.astype(np.int32)
    left, right = np.concatenate((x[..., :1], x[..., :-1]), -1), np.concatenate((x[..., 1:], x[..., -1:]), -1)
    out = np.stack(((3 * x + left + low) // scale, (3 * x + right + high) // scale), -1)
    return out.reshape(*x.shape[:-1], 2 * x.shape[-1])


def _upsampled(planes: np.ndarray, across: int, down: int) -> np.ndarray:
    """Planes at their full size. Half size across, or both ways, is filtered if more than two columns are there; all else repeats."""
    if across == 2 and down <= 2 and planes.shape[2] > 2:
        if down == 1:
            return _wider(planes, 4, 1, 2).astype(np.uint8)
        x = planes.astype(np.int32)
        up, below = np.concatenate((x[:, :1], x[:, :-1]), 1), np.concatenate((x[:, 1:], x[:, -1:]), 1)
        rows = np.stack((3 * x + up, 3 * x + below), 2).reshape(len(x), 2 * x.shape[1], x.shape[2])
        return _wider(rows, 16, 8, 7).astype(np.uint8)
    return planes.repeat(down, 1).repeat(across, 2)


def compressed(px: Image, quality: int) -> Image:
    """(n, h, w, c) uint8 images, c 1 or 3, as they come back from a baseline JPEG file of a quality, chroma at half size."""
    n, h, w, c = px.shape
    if px.dtype != np.uint8 or c not in (1, 3) or not 1 <= quality <= 100 or not (0 < h <= MOST and 0 < w <= MOST):
        raise ValueError("JPEG takes uint8 images of 1 or 3 channels, axes of 1 to 65,500 and a quality of 1 to 100")
    up8 = lambda k: -(-k // 8) * 8
    parts = [px[..., 0].astype(np.int32)] if c == 1 else _luma_chroma(px)
    out = []
    for k, plane in enumerate(parts):
        if k:
            # rows are halved first and then repeated, columns repeated first
            plane = _halved(_to(plane, h + h % 2, up8(-(-w // 2)) * 2))
        full = _to(plane, up8(plane.shape[1]), up8(plane.shape[2]))
        table = quantiser(CHROMA if k else LUMA, quality)
        f = _forward(_blocks(full) - 128.0)
        f = np.sign(f) * np.floor((np.abs(f) + 4 * table) / (8 * table)) * table
        back = _planes(_inverse(f))
        out.append(_upsampled(back[:, : -(-h // 2), : -(-w // 2)], 2, 2)[:, :h, :w] if k else back[:, :h, :w])
    return out[0][..., None] if c == 1 else _colours(*out)


# files


class _Part:
    """A component: sampling, tables, and coefficients by block in zigzag order."""

    def __init__(self, ident: int, across: int, down: int, table: int) -> None:
        self.ident, self.across, self.down, self.table = ident, across, down, table
        self.dc = self.ac = 0


def _codes(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code * 256 + symbol; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[k : k + count]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        k, code = k + count, code << 1
    return out


class _Bits:
    """A stretch of entropy-coded data without stuffing."""

    def __init__(self, data: bytes) -> None:
        b = np.frombuffer(data + b"\0" * 32, np.uint8).astype(np.int32)
        three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        self.next16 = ((three[:, None] >> np.arange(8, 0, -1)) & 0xFFFF).reshape(-1)
        self.size = 8 * len(data)
        self.lists: dict[tuple[int, bool], list[int]] = {}

    def steps(self, key: int, codes: np.ndarray, values: bool) -> list[int]:
        """For every bit: bits to the end of the code that begins there (and of the value that follows it) * 256 + symbol."""
        if (key, values) not in self.lists:
            found = codes[self.next16]
            self.lists[key, values] = (found + ((found & 15) << 8) if values else found).tolist()
        return self.lists[key, values]

    def values(self, ends: list[int], sizes: list[int]) -> np.ndarray:
        """The signed values whose bits stop at ``ends``."""
        end, size = np.array(ends, np.int64), np.array(sizes, np.int64)
        raw = self.next16[end - size] >> (16 - size)
        return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)


class _File:
    def __init__(self, data: bytes) -> None:
        self.data, self.quant, self.codes, self.interval, self.adobe = data, {}, {}, 0, None
        self.parts: list[_Part] = []
        self.read()

    def read(self) -> None:
        data, k = self.data, 2
        while k + 4 <= len(data):
            if data[k] != 0xFF:
                raise ValueError("JPEG without a marker where one must be")
            kind = data[k + 1]
            if kind == 0xFF:
                k += 1
                continue
            if kind == 0xD9:
                break
            if 0xD0 <= kind <= 0xD7 or kind == 1:
                k += 2
                continue
            size = data[k + 2] << 8 | data[k + 3]
            body, k = data[k + 4 : k + 2 + size], k + 2 + size
            if kind == 0xDB:
                self._tables(body)
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    self.codes[body[i]] = _codes(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                    i += 17 + n
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("JPEG files that are lossless, hierarchical or arithmetically coded are not decoded")
            elif kind == 0xDD:
                self.interval = body[0] << 8 | body[1]
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif kind == 0xDA:
                k = self._scan(body, k)
        if not self.parts:
            raise ValueError("JPEG without a frame")

    def _tables(self, body: bytes) -> None:
        i = 0
        while i < len(body):
            wide, slot = body[i] >> 4, body[i] & 15
            self.quant[slot] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
            i += 129 if wide else 65

    def _frame(self, body: bytes, progressive: bool) -> None:
        if body[0] != 8 or self.parts:
            raise ValueError("only JPEG files of 8 bits a sample and one frame are decoded")
        self.h, self.w, self.progressive = body[1] << 8 | body[2], body[3] << 8 | body[4], progressive
        self.parts = [_Part(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        if not self.h or not self.w or len(self.parts) not in (1, 3, 4) or any(not (1 <= p.across <= 4 and 1 <= p.down <= 4) for p in self.parts):
            raise ValueError("JPEG frame without a size or with parts that are not known")
        self.most = max(p.across for p in self.parts), max(p.down for p in self.parts)
        self.mcus = -(-self.w // (8 * self.most[0])), -(-self.h // (8 * self.most[1]))
        for p in self.parts:
            p.size = -(-self.w * p.across // self.most[0]), -(-self.h * p.down // self.most[1])  # samples
            p.stride = self.mcus[0] * p.across  # blocks a row, with those that only fill up
            p.coefficients = np.zeros((p.stride * self.mcus[1] * p.down, 64), np.int32)

    def _scan(self, body: bytes, k: int) -> int:
        """Reads the scan whose data begins at ``k``; where it ends."""
        if not self.parts:
            raise ValueError("JPEG scan before its frame")
        chosen = []
        for i in range(1, 1 + 2 * body[0], 2):
            (p,) = (p for p in self.parts if p.ident == body[i])
            p.dc, p.ac = body[i + 1] >> 4, 16 + (body[i + 1] & 15)
            chosen.append(p)
        first, last, high, low = *body[1 + 2 * body[0] :][:2], body[3 + 2 * body[0]] >> 4, body[3 + 2 * body[0]] & 15
        data, pieces, at, begin = self.data, [], k, k
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                at = len(data)
                break
            kind = data[at + 1]
            if 0xD0 <= kind <= 0xD7:
                pieces.append(data[begin:at])
                begin = at + 2
            elif kind:
                break
            at += 2
        pieces.append(data[begin:at])
        if len(chosen) == 1:  # its own blocks, row by row
            p = chosen[0]
            across, down = -(-p.size[0] // 8), -(-p.size[1] // 8)
            order = (np.arange(down)[:, None] * p.stride + np.arange(across)).reshape(-1)
            units, which = order[:, None], [p]
        else:
            x, y = np.arange(self.mcus[0]), np.arange(self.mcus[1])[:, None]
            cells, which = [], []
            for p in chosen:
                for v in range(p.down):
                    for u in range(p.across):
                        cells.append(((y * p.down + v) * p.stride + x * p.across + u).reshape(-1))
                        which.append(p)
            units = np.stack(cells, 1)
        each = self.interval or len(units)
        for i, piece in enumerate(pieces):
            mine = units[i * each : (i + 1) * each]
            if len(mine):
                bits = _Bits(piece.replace(b"\xff\x00", b"\xff"))
                try:
                    self._stretch(bits, mine, which, first, last, high, low)
                except (IndexError, KeyError):
                    raise ValueError("JPEG data that ends early or names no table") from None
        return at

    def _stretch(self, bits: _Bits, units: np.ndarray, which: list[_Part], first: int, last: int, high: int, low: int) -> None:
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        if high and not first:
            bit = bits.next16[: units.size].reshape(units.shape) >> 15
            for j, p in enumerate(which):
                p.coefficients[units[:, j], 0] |= bit[:, j] << low
        elif high:
            _refine(bits, bits.steps(which[0].ac, self.codes[which[0].ac], False), which[0].coefficients, units[:, 0], first, last, low)
        elif first:
            _first(bits, bits.steps(which[0].ac, self.codes[which[0].ac], False), which[0].coefficients, units[:, 0], first, last, low)
        else:
            self._sequential(bits, units, which, last, low)

    def _sequential(self, bits: _Bits, units: np.ndarray, which: list[_Part], last: int, low: int) -> None:
        """DC differences, and all others of a baseline file."""
        dc = [bits.steps(p.dc, self.codes[p.dc], True) for p in which]
        ac = [bits.steps(p.ac, self.codes[p.ac], True) for p in which] if last else [[]] * len(which)
        dc_ends, dc_sizes, ends, symbols, places = [], [], [], [], []
        pos = base = 0
        tables = list(zip(dc, ac, strict=True))
        for _ in range(len(units)):
            for d, a in tables:
                e = d[pos]
                pos += e >> 8
                dc_ends.append(pos)
                dc_sizes.append(e & 15)
                if last:
                    k = base + 1
                    stop = base + 64
                    while k < stop:
                        e = a[pos]
                        pos += e >> 8
                        e &= 255
                        if e & 15:
                            k += e >> 4
                            ends.append(pos)
                            symbols.append(e)
                            places.append(k)
                            k += 1
                        elif e == 0xF0:
                            k += 16
                        else:
                            break
                    base = stop
        if pos > bits.size:
            raise IndexError
        difference = bits.values(dc_ends, dc_sizes).reshape(units.shape)
        value = bits.values(ends, [s & 15 for s in symbols])
        unit, place = np.divmod(np.array(places, np.int64), 64)
        row, j = np.divmod(unit, len(which))
        for p in dict.fromkeys(which):
            mine = [k for k, q in enumerate(which) if q is p]
            p.coefficients[units[:, mine].reshape(-1), 0] = np.cumsum(difference[:, mine].reshape(-1)) << low
            if len(place):
                at = np.isin(j, mine)
                p.coefficients[units[row[at], j[at]], np.minimum(place[at], 63)] = value[at]

    def pixels(self) -> Image:
        planes = []
        for p in self.parts:
            full = np.zeros((len(p.coefficients), 64))
            if p.table not in self.quant:
                raise ValueError("JPEG without a quantisation table")
            full[:, ZIGZAG] = p.coefficients * self.quant[p.table]
            plane = _planes(_inverse(full.reshape(1, -1, p.stride, 8, 8)))[:, : p.size[1], : p.size[0]]
            across, down = self.most[0] / p.across, self.most[1] / p.down
            if across % 1 or down % 1:
                raise ValueError("JPEG sampling that is no whole number is not decoded")
            planes.append(_upsampled(plane, int(across), int(down))[0, : self.h, : self.w])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2)
        if len(planes) == 3:
            plain = self.adobe == 0 or self.adobe is None and [p.ident for p in self.parts] == [*b"RGB"]
            return np.stack(planes, -1) if plain else _colours(*planes)
        ink = _colours(*planes[:3]) if self.adobe == 2 else np.stack(planes[:3], -1)
        paper = ink if self.adobe is not None else 255 - ink  # such files hold what is left of the light
        key = planes[3] if self.adobe is not None else 255 - planes[3]
        return ((paper.astype(np.int32) * key[:, :, None] + 127) // 255).astype(np.uint8)


def _first(bits: _Bits, codes: list[int], out: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    """The first bits of a band of coefficients, where runs of blocks may end at once."""
    pos, skip, word = 0, 0, bits.next16
    ends, sizes, where, places = [], [], [], []
    for block in blocks.tolist():
        if skip:
            skip -= 1
            continue
        k = first
        while k <= last:
            e = codes[pos]
            pos += e >> 8
            run, size = (e & 255) >> 4, e & 15
            if size:
                k += run
                pos += size
                ends.append(pos)
                sizes.append(size)
                where.append(block)
                places.append(k)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) - 1 + (int(word[pos]) >> (16 - run) if run else 0)
                pos += run
                break
    if ends:
        out[where, np.minimum(places, 63)] = bits.values(ends, sizes) << low


def _refine(bits: _Bits, codes: list[int], out: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    """One more bit of a band: of each coefficient that is there, and new ones between."""
    bit = (bits.next16 >> 15).tolist()
    word = bits.next16
    pos, skip, one = 0, 0, 1 << low
    rows = out[blocks].tolist()
    for row in rows:
        k = first
        if not skip:
            while k <= last:
                e = codes[pos]
                pos += e >> 8
                run, new = (e & 255) >> 4, 0
                if e & 15:
                    new = one if bit[pos] else -one
                    pos += 1
                elif run < 15:
                    skip = (1 << run) + (int(word[pos]) >> (16 - run) if run else 0)
                    pos += run
                    break
                while k <= last:
                    v = row[k]
                    if v:
                        if bit[pos] and not abs(v) & one:
                            row[k] = v + one if v > 0 else v - one
                        pos += 1
                    elif run:
                        run -= 1
                    else:
                        row[k] = new
                        k += 1
                        break
                    k += 1
        if skip:
            for k in range(k, last + 1):
                v = row[k]
                if v:
                    if bit[pos] and not abs(v) & one:
                        row[k] = v + one if v > 0 else v - one
                    pos += 1
            skip -= 1
    out[blocks] = rows


def size(data: bytes) -> tuple[int, int]:
    """Height and width, from the headers alone."""
    k = 2
    while data[:2] == b"\xff\xd8" and k + 9 <= len(data) and data[k] == 0xFF:
        kind = data[k + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return data[k + 5] << 8 | data[k + 6], data[k + 7] << 8 | data[k + 8]
        k += 1 if kind == 0xFF else 2 if 0xD0 <= kind <= 0xD8 or kind == 1 else 2 + (data[k + 2] << 8 | data[k + 3])
    raise ValueError("not a JPEG image, or one without a frame")


def decode(data: bytes) -> Image:
    """RGB of a JPEG file of 8 bits a sample: grey, YCbCr, RGB, CMYK or YCCK; baseline, extended or progressive."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    return _File(data).pixels()
