"""Lossless WebP images: a decoder of the whole format, an encoder, and pixel columns.

The decoder reads prefix codes (simple, and with run-length coded lengths), groups of codes chosen by an entropy image,
back-references with the short-distance map, the colour cache, and inverts the predictor, cross-colour, subtract-green
and palette transforms. Where an image has one code group, no cache and only one symbol in each channel but green (grey
images after subtract-green), literals are decoded with array operations: the symbol at every bit position of a window is
looked up, and the chain of positions is followed eight symbols at a time.

The encoder for payloads stores bytes as grey pixels, 64 to a row, with subtract-green, prefix codes fit to the image
and back-references for repeated lines and runs. The encoder for images takes any transforms, a cache and code groups.

Edge cases of the query: a null or empty text is 64 zero bytes; payloads over 16,384 rows get wider rows, whose last row
is filled with zeros that reading back cuts off; payloads over MOST bytes, more than an image holds, are several files one
after another; equal texts give equal bytes; repeated rows keep their rows; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import materialize, table

ROW = 64
SIDE = 1 << 14
MOST = SIDE * SIDE
#: Order in which lengths of the code for code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Columns and rows back of the 120 short distances.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
WINDOW = 1 << 15


# ---- prefix codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for counted symbols, none above `most`; one symbol alone has length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    freq = counts[used].tolist()
    floor = 0
    while True:
        heap = [(max(f, floor), i) for i, f in enumerate(freq)]
        heapq.heapify(heap)
        up, k = [0] * (2 * len(freq) - 1), len(freq)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heap[0]
            up[a[1]] = up[b[1]] = k
            heapq.heapreplace(heap, (a[0] + b[0], k))
            k += 1
        depth = [0] * k
        for i in range(k - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(freq)]) <= most:
            out[used] = depth[: len(freq)]
            return out
        floor = max(2 * floor, sum(freq) >> most, 1)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes for lengths, bits reversed, as they are written from the lowest bit."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return codes
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    top = int(n[-1])
    # a code is the sum of the shares of all before it
    start = np.concatenate([[0], np.cumsum(1 << (top - n))[:-1]]) >> (top - n)
    codes[order] = _reversed(start, n)
    return codes


def _reversed(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return _REVERSE[value.astype(np.int64)] >> (16 - bits)


_REVERSE = np.zeros(1 << 16, np.int64)
for _k in range(16):
    _REVERSE |= ((np.arange(1 << 16) >> _k) & 1) << (15 - _k)
_BY_BITS = [_REVERSE[: 1 << _k] >> (16 - _k) for _k in range(16)]


class Code:
    """Decoding table of a prefix code: symbol << 4 | length by the next `bits` bits; one symbol alone takes none."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits, self.table = 0, np.array([(int(used[0]) if len(used) else 0) << 4])
        else:
            order = used[np.argsort(lengths[used], kind="stable")]
            n = lengths[order]
            self.bits = int(n[-1])
            spread = np.repeat((order << 4) | n, 1 << (self.bits - n))
            if len(spread) != 1 << self.bits:
                raise ValueError("prefix code is not complete")
            self.table = spread[_BY_BITS[self.bits]]
        self.list = None

    def read(self, r: Bits) -> int:
        if self.list is None:
            self.list = self.table.tolist()
        x = self.list[r.peek(self.bits)]
        r.at += x & 15
        return x >> 4


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("image data ends early")
        return x


# ---- decoder


def _read_code(r: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for k in range(4 + r.read(4)):
        own[LENGTH_ORDER[k]] = r.read(3)
    code = Code(own)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    at, last, out = 0, 8, []
    while at < size and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            out.append(s)
            at += 1
            last = s or last
        else:
            n = 3 + r.read(2) if s == 16 else 3 + r.read(3) if s == 17 else 11 + r.read(7)
            out.extend([last if s == 16 else 0] * n)
            at += n
    if at > size:
        raise ValueError("too many code lengths")
    lengths[:at] = out
    return Code(lengths)


def _number(r: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _image(r: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """An entropy-coded image as 0xAARRGGBB; outer: with code groups."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, prefix_bits, entropy, wide = 1, 0, None, 0
    if outer and r.read(1):
        prefix_bits = r.read(3) + 2
        wide = -(-width // (1 << prefix_bits))
        entropy = (_image(r, wide, -(-height // (1 << prefix_bits)), False) >> 8) & 0xFFFF
        groups = int(entropy.max()) + 1
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(r, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and not any(c.bits for c in codes[0][1:4]):
        return _green(r, width * height, width, codes[0])
    return _scalar(r, width, height, cache_bits, codes, entropy, prefix_bits, wide)


def _scalar(r, width, height, cache_bits, codes, entropy, prefix_bits, wide) -> np.ndarray:
    n, out, cache, k = width * height, [], [0] * (1 << cache_bits) if cache_bits else [], 0
    shift, group = 32 - cache_bits, codes[0]
    chosen = entropy.tolist() if entropy is not None else None
    cached = 0  # pixels already put into the cache
    while k < n:
        if chosen is not None:
            group = codes[chosen[(k // width >> prefix_bits) * wide + (k % width >> prefix_bits)]]
        s = group[0].read(r)
        if s < 256:
            red = group[1].read(r)
            blue = group[2].read(r)
            out.append((group[3].read(r) << 24) | (red << 16) | (s << 8) | blue)
            k += 1
        elif s < 280:
            length = _number(r, s - 256)
            back = _distance(_number(r, group[4].read(r)), width)
            if back > k or k + length > n:
                raise ValueError("back-reference out of the image")
            for _ in range(length):
                out.append(out[-back])
            k += length
        else:
            while cached < k:
                p = out[cached]
                cache[((0x1E35A7BD * p) & 0xFFFFFFFF) >> shift] = p
                cached += 1
            out.append(cache[s - 280])
            k += 1
    return np.array(out, np.uint32)


_STEPS = np.arange(8, dtype=np.uint32)


def _green(r: Bits, n: int, width: int, group: list[Code]) -> np.ndarray:
    """As _scalar, for images in which only green varies and no cache is kept."""
    out, k, at = np.empty(n, np.uint8), 0, r.at
    green, data = group[0], r.data
    if not green.bits and int(green.table[0]) >> 4 < 256:
        out[:] = int(green.table[0]) >> 4
        k = n
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    mask, table_ = np.uint32((1 << green.bits) - 1), green.table.astype(np.int32)
    limit = 8 * len(data)
    base = end = 0
    while k < n:
        if not base <= at < end - 8 * 40 or not end:
            base = at & ~7
            raw = padded[base >> 3 : (base >> 3) + WINDOW + 4].astype(np.uint32)
            m = len(raw) - 4
            if m <= 0:
                raise ValueError("image data ends early")
            words = raw[:m] | (raw[1 : m + 1] << 8) | (raw[2 : m + 2] << 16)
            entry = table_[((words[:, None] >> _STEPS) & mask).ravel()]
            end = base + 8 * m
            here = np.arange(8 * m, dtype=np.int32)
            step = np.minimum(here + (entry & 15), 8 * m - 1)
            stop = entry >= 256 << 4
            step[stop] = here[stop]
            step[-320:] = here[-320:] if end < limit + 8 else step[-320:]
            if end < limit:  # what may lie across the end belongs to the next window
                step[-64:] = here[-64:]
            two = step[step]
            four = two[two]
            eight = four[four]
            jump = memoryview(eight)
        p = at - base
        marks = []
        for _ in range((n - k + 7) >> 3):
            marks.append(p)
            q = jump[p]
            if q == p:
                break
            p = q
        first = np.array(marks, np.int64)
        chain = np.empty((len(first), 8), np.int64)
        chain[:, 0] = first
        chain[:, 1] = step[first]
        chain[:, 2] = two[first]
        chain[:, 3] = step[chain[:, 2]]
        chain[:, 4] = four[first]
        chain[:, 5] = step[chain[:, 4]]
        chain[:, 6] = two[chain[:, 4]]
        chain[:, 7] = step[chain[:, 6]]
        chain = chain.ravel()[: n - k]
        halted = step[chain] == chain
        got = int(np.argmax(halted)) if halted.any() else len(chain)
        if got:
            out[k : k + got] = entry[chain[:got]] >> 4
            k += got
            at = base + int(chain[got - 1]) + int(entry[chain[got - 1]] & 15)
        if k >= n:
            break
        r.at = at
        s = green.read(r)
        if s < 256:  # halted at the window's end
            out[k] = s
            k += 1
        else:
            length = _number(r, s - 256)
            back = _distance(_number(r, group[4].read(r)), width)
            if back > k or k + length > n:
                raise ValueError("back-reference out of the image")
            if back >= length:
                out[k : k + length] = out[k - back : k - back + length]
            else:
                out[k : k + length] = np.resize(out[k - back : k], length)
            k += length
        at = r.at
        if at > limit:
            raise ValueError("image data ends early")
    r.at = at
    rest = (int(group[3].table[0]) >> 4 << 24) | (int(group[1].table[0]) >> 4 << 16) | (int(group[2].table[0]) >> 4)
    return (out.astype(np.uint32) << np.uint32(8)) | np.uint32(rest)


def _channels(px: np.ndarray) -> list[np.ndarray]:
    return [((px >> np.uint32(s)) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)]


def _join(a, r, g, b) -> np.ndarray:
    a, r, g, b = (np.asarray(c, np.int32).astype(np.uint32) & np.uint32(255) for c in (a, r, g, b))
    return (a << np.uint32(24)) | (r << np.uint32(16)) | (g << np.uint32(8)) | b


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ 128) - 128


def _cross(px: np.ndarray, width: int, height: int, bits: int, blocks: np.ndarray, sign: int) -> np.ndarray:
    """Cross-colour transform, forward (-1) or back (1)."""
    wide = -(-width // (1 << bits))
    y, x = np.divmod(np.arange(width * height), width)
    element = blocks[(y >> bits) * wide + (x >> bits)]
    _, red_blue, green_blue, green_red = (_signed(c) for c in _channels(element))
    a, r, g, b = _channels(px)
    new = (r + sign * ((green_red * _signed(g)) >> 5)) & 255
    true_red = new if sign > 0 else r
    b = b + sign * (((green_blue * _signed(g)) >> 5) + ((red_blue * _signed(true_red)) >> 5))
    return _join(a, new, g, b)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _add(a: int, b: int) -> int:
    return (((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00) | (((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF)


def _sub(a: int, b: int) -> int:
    return ((0x100 * 0x00010001 + ((a >> 8) & 0x00FF00FF) - ((b >> 8) & 0x00FF00FF)) & 0x00FF00FF) << 8 | ((0x100 * 0x00010001 + (a & 0x00FF00FF) - (b & 0x00FF00FF)) & 0x00FF00FF)


def _parts(a: int) -> tuple[int, int, int, int]:
    return a >> 24, (a >> 16) & 255, (a >> 8) & 255, a & 255


def _whole(p) -> int:
    a, r, g, b = (min(255, max(0, x)) for x in p)
    return (a << 24) | (r << 16) | (g << 8) | b


def _select(left: int, top: int, corner: int) -> int:
    l, t, c = _parts(left), _parts(top), _parts(corner)
    to_left = sum(abs(y - z) for y, z in zip(t, c))
    to_top = sum(abs(x - z) for x, z in zip(l, c))
    return left if to_left < to_top else top


def _predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode < 10:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _whole(x + y - z for x, y, z in zip(_parts(left), _parts(top), _parts(corner)))
    mid = _parts(_average(left, top))
    return _whole(m + int((m - z) / 2) for m, z in zip(mid, _parts(corner)))


def _predictor(px: np.ndarray, width: int, height: int, bits: int, blocks: np.ndarray, back: bool) -> np.ndarray:
    """Predictor transform: residuals to pixels (back) or pixels to residuals."""
    wide = -(-width // (1 << bits))
    modes = ((blocks >> np.uint32(8)) & np.uint32(15)).tolist()
    src = px.tolist()
    out = [0] * len(src)
    seen = out if back else src
    apply = _add if back else _sub
    for k in range(len(src)):
        y, x = divmod(k, width)
        if not y:
            guess = seen[k - 1] if x else 0xFF000000
        elif not x:
            guess = seen[k - width]
        else:
            guess = _predict(modes[(y >> bits) * wide + (x >> bits)], seen[k - 1], seen[k - width], seen[k - width + 1], seen[k - width - 1])
        out[k] = apply(src[k], guess)
    return np.array(out, np.uint32)


def _green_back(px: np.ndarray) -> np.ndarray:
    g = (px >> np.uint32(8)) & np.uint32(255)
    pair = px & np.uint32(0x00FF00FF)
    return (px & np.uint32(0xFF00FF00)) | ((pair + (g | (g << np.uint32(16)))) & np.uint32(0x00FF00FF))


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _palette_back(px: np.ndarray, packed: int, width: int, height: int, bits: int, colours: np.ndarray) -> np.ndarray:
    index = ((px >> np.uint32(8)) & np.uint32(255)).astype(np.int64).reshape(height, packed)
    if bits:
        each = 8 >> bits
        index = ((index[:, :, None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index].ravel()


def _running(colours: np.ndarray) -> np.ndarray:
    return _join(*(np.cumsum(c) & 255 for c in _channels(colours)))


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels (0xAARRGGBB, row by row) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    size = struct.unpack_from("<I", data, at + 4)[0]
    r = Bits(data[at + 8 : at + 8 + size])
    if r.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height, _, version = r.read(14) + 1, r.read(14) + 1, r.read(1), r.read(3)
    if version:
        raise ValueError("unknown version")
    undo, wide = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            undo.append((kind, wide, bits, _image(r, -(-wide // (1 << bits)), -(-height // (1 << bits)), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, wide, 0, None))
        else:
            n = r.read(8) + 1
            colours = _running(_image(r, n, 1, False))
            bits = _pack_bits(n)
            undo.append((kind, wide, bits, colours))
            wide = -(-wide // (1 << bits))
    px = _image(r, wide, height, True)
    for kind, w, bits, own in reversed(undo):
        if kind == PREDICTOR:
            px = _predictor(px, w, height, bits, own, True)
        elif kind == CROSS_COLOUR:
            px = _cross(px, w, height, bits, own, 1)
        elif kind == SUBTRACT_GREEN:
            px = _green_back(px)
        else:
            px = _palette_back(px, -(-w // (1 << bits)), w, height, bits, own)
    return width, height, px


# ---- encoder


def _symbol(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and their value of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, top - 1, v & ((1 << (top - 1)) - 1)


class Writer:
    """(value, bits) pairs, packed from the lowest bit at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.values.append(value)
        self.sizes.append(bits)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.parts.append((values, sizes))

    def _close(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self._close()
        out, carry = [], np.zeros(0, np.uint8)
        for values, sizes in self.parts:
            for lo in range(0, len(values), 1 << 16):
                v, n = values[lo : lo + (1 << 16)], sizes[lo : lo + (1 << 16)]
                end = np.cumsum(n)
                total = int(end[-1]) if len(end) else 0
                place = np.arange(total) - np.repeat(end - n, n)
                bits = ((np.repeat(v, n) >> place) & 1).astype(np.uint8)
                bits = np.concatenate([carry, bits])
                whole = len(bits) & ~7
                out.append(np.packbits(bits[:whole], bitorder="little").tobytes())
                carry = bits[whole:]
        if len(carry):
            out.append(np.packbits(carry, bitorder="little").tobytes())
        return b"".join(out)


#: Lengths of the code for code lengths that the encoder always uses: 13 of 4 bits, 6 of 5, which is complete.
_OWN = np.array([4] * 11 + [5, 5, 5, 5, 5, 4, 4, 5], np.int64)
_OWN_CODES = canonical(_OWN)


def _write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        w.put(1, 1)
        w.put(len(used) == 2, 1)
        w.put(first > 1, 1)
        w.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.put(int(used[1]), 8)
        return
    w.put(0, 1)
    w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(int(_OWN[k]), 3)
    w.put(0, 1)
    cut = np.flatnonzero(np.diff(lengths)) + 1
    starts = [0, *cut.tolist(), len(lengths)]
    size, code = _OWN.tolist(), _OWN_CODES.tolist()
    for a, b in zip(starts, starts[1:]):
        v, n = int(lengths[a]), b - a
        if v:
            w.put(code[v], size[v])
            n -= 1
            while n >= 3:
                k = min(n, 6)
                w.put(code[16], size[16])
                w.put(k - 3, 2)
                n -= k
        else:
            while n >= 3:
                k = min(n, 138)
                s, low, bits = (18, 11, 7) if k >= 11 else (17, 3, 3)
                w.put(code[s], size[s])
                w.put(k - low, bits)
                n -= k
        for _ in range(n):
            w.put(code[v], size[v])


def _file(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _head(w: Writer, width: int, height: int, alpha: int) -> None:
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        w.put(value, bits)


def _copies(payload: bytes) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that stood before, and of the run of zeros at the end."""
    out: list[tuple[int, int, int]] = []
    end = len(payload.rstrip(b"\0"))
    if payload.count(b"\n", 0, end) > 1:
        seen: dict[bytes, int] = {}
        at = 0
        for line in payload[:end].split(b"\n"):
            n = min(len(line) + 1, end - at)
            if n >= 24:
                back = at - seen.get(line, at)
                if 0 < back < 1 << 20:
                    if out and sum(out[-1][:2]) == at and out[-1][2] == back:
                        out[-1] = (out[-1][0], out[-1][1] + n, back)
                    else:
                        out.append((at, n, back))
                seen[line] = at
            at += n
    zeros = len(payload) - end
    if zeros > 4 and end:
        out.append((end + 1, zeros - 1, 1))
    elif zeros > 5:
        out.append((1, zeros - 1, 1))
    return [(a + k, min(4096, n - k), d) for a, n, d in out for k in range(0, n, 4096)]


def encode_bytes(payload: bytes) -> bytes:
    """Bytes as grey pixels of a lossless WebP file."""
    n = len(payload)
    rows = -(-n // ROW)
    width = ROW * -(-rows // SIDE)
    height = -(-n // width)
    payload = payload + b"\0" * (width * height - n)
    data = np.frombuffer(payload, np.uint8)
    copies = _copies(payload)
    w = Writer()
    _head(w, width, height, 0)
    w.put(1, 1)
    w.put(SUBTRACT_GREEN, 2)
    w.put(0, 3)  # no more transforms, no cache, one code group
    symbols, extra = [], []
    at, far = 0, np.zeros(40, np.int64)
    for a, length, back in copies:
        symbols.append(data[at:a])
        near = {1: 2, width: 1}.get(back)
        one, two = _symbol(length), _symbol(near or back + 120)
        far[two[0]] += 1
        extra.append((one, two))
        at = a + length
    symbols.append(data[at:])
    counts = sum((np.bincount(s, minlength=280) for s in symbols), np.zeros(280, np.int64))
    for one, _ in extra:
        counts[256 + one[0]] += 1
    green, dist = code_lengths(counts, 12), code_lengths(far, 12)
    codes, far_codes = canonical(green), canonical(dist)
    if (green > 0).sum() == 1:
        sizes = np.zeros(280, np.int64)
    else:
        sizes = green
    far_sizes = dist if (dist > 0).sum() > 1 else np.zeros(40, np.int64)
    _write_code(w, green)
    zero = np.zeros(256, np.int64)
    zero[0] = 1
    _write_code(w, zero)
    _write_code(w, zero)
    zero = np.zeros(256, np.int64)
    zero[255] = 1
    _write_code(w, zero)
    _write_code(w, dist)
    for k, s in enumerate(symbols):
        if len(s):
            w.extend(codes[s], sizes[s])
        if k < len(extra):
            (s1, b1, v1), (s2, b2, v2) = extra[k]
            w.put(int(codes[256 + s1]), int(sizes[256 + s1]))
            w.put(v1, b1)
            w.put(int(far_codes[s2]), int(far_sizes[s2]))
            w.put(v2, b2)
    return _file(w.bytes())


def _write_image(w: Writer, px: np.ndarray, width: int, outer: bool, cache_bits: int = 0, group_bits: int = 0, groups: int = 1, copies: bool = True) -> None:
    """An image in general: literals, cache hits and simple back-references, in any number of code groups."""
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height = len(px) // width
    chosen, wide = None, 0
    if outer:
        w.put(groups > 1, 1)
        if groups > 1:
            w.put(group_bits - 2, 3)
            wide = -(-width // (1 << group_bits))
            tall = -(-height // (1 << group_bits))
            chosen = [(k * 7 + 3) % groups for k in range(wide * tall)]
            chosen[0] = groups - 1
            _write_image(w, (np.array(chosen, np.uint32) << np.uint32(8)), wide, False)
    src, cache, steps, k = px.tolist(), {}, [], 0
    last: dict[int, int] = {}
    while k < len(src):
        p, n = src[k], 0
        back = k - last[p] if copies and p in last else 0
        if back:
            while k + n < len(src) and n < 4096 and src[k + n] == src[k + n - back]:
                n += 1
        slot = ((0x1E35A7BD * p) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if n >= 3 and back < 1 << 20:
            near = next((i + 1 for i, (x, y) in enumerate(NEAR) if max(1, x + y * width) == back), back + 120)
            steps.append((k, 256 + _symbol(n)[0], _symbol(n), _symbol(near), p))
        elif cache_bits and cache.get(slot) == p:
            n = 1
            steps.append((k, 280 + slot, None, None, p))
        else:
            n = 1
            steps.append((k, (p >> 8) & 255, None, None, p))
        for i in range(k, k + n):
            last[src[i]] = i
            if cache_bits:
                cache[((0x1E35A7BD * src[i]) & 0xFFFFFFFF) >> (32 - cache_bits)] = src[i]
        k += n
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]

    def of(k: int) -> int:
        return chosen[(k // width >> group_bits) * wide + (k % width >> group_bits)] if chosen else 0

    for k, s, _, far, p in steps:
        c = counts[of(k)]
        c[0][s] += 1
        if s < 256:
            c[1][(p >> 16) & 255] += 1
            c[2][p & 255] += 1
            c[3][p >> 24] += 1
        elif far:
            c[4][far[0]] += 1
    coded = []
    for c in counts:
        own = []
        for x in c:
            lengths = code_lengths(x, 15)
            _write_code(w, lengths)
            own.append((canonical(lengths), lengths if (lengths > 0).sum() > 1 else np.zeros(len(lengths), np.int64)))
        coded.append(own)
    for k, s, one, far, p in steps:
        c = coded[of(k)]
        w.put(int(c[0][0][s]), int(c[0][1][s]))
        if s < 256:
            for i, v in ((1, (p >> 16) & 255), (2, p & 255), (3, p >> 24)):
                w.put(int(c[i][0][v]), int(c[i][1][v]))
        elif far:
            w.put(one[2], one[1])
            w.put(int(c[4][0][far[0]]), int(c[4][1][far[0]]))
            w.put(far[2], far[1])


def encode(px: np.ndarray, width: int, transforms: tuple[int, ...] = (), cache_bits: int = 0, groups: int = 1, bits: int = 2, modes=None) -> bytes:
    """Pixels (0xAARRGGBB) as a lossless WebP file with these transforms in this order."""
    px, height, wide = np.asarray(px, np.uint32), len(px) // width, width
    w = Writer()
    _head(w, width, height, int(bool((px >> np.uint32(24) != 255).any())))
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = -(-wide // (1 << bits)) * -(-height // (1 << bits))
            rng = np.arange(n)
            blocks = _join(255, 0, rng % 14 if modes is None else np.full(n, modes), 0) if kind == PREDICTOR else _join(255, rng * 37 % 256, rng * 11 % 256, rng * 5 % 256)
            w.put(bits - 2, 3)
            _write_image(w, blocks, -(-wide // (1 << bits)), False)
            px = _predictor(px, wide, height, bits, blocks, False) if kind == PREDICTOR else _cross(px, wide, height, bits, blocks, -1)
        elif kind == SUBTRACT_GREEN:
            a, r, g, b = _channels(px)
            px = _join(a, r - g, g, b - g)
        else:
            colours, index = np.unique(px, return_inverse=True)
            w.put(len(colours) - 1, 8)
            delta = _join(*(np.diff(c, prepend=0) for c in _channels(colours)))
            _write_image(w, delta, len(colours), False)
            pack = _pack_bits(len(colours))
            each = 8 >> pack
            packed = -(-wide // (1 << pack))
            full = np.zeros((height, packed << pack), np.int64)
            full[:, :wide] = index.reshape(height, wide)
            full = (full.reshape(height, packed, 1 << pack) << (np.arange(1 << pack) * each)).sum(axis=2)
            px, wide = _join(255, 0, full.ravel(), 0), packed
    w.put(0, 1)
    _write_image(w, px, wide, True, cache_bits, 2, groups)
    return _file(w.bytes())


# ---- columns


def _features(width: int, height: int, grey: np.ndarray) -> str:
    """Size, mean, deviation, entropy in bits, and an 8 by 8 mean hash of a grey image."""
    counts = np.bincount(grey, minlength=256)
    p = counts[counts > 0] / len(grey)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(grey))
    spread = float(((counts * values * values).sum() / len(grey) - mean * mean))
    flat = np.add.reduceat(grey.astype(np.int64), np.arange(64) * (len(grey) // 64))
    mark = "".join("1" if x else "0" for x in (flat > flat.mean()).tolist())
    return f"{width}x{height};mean={mean:.4f};var={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};hash={int(mark, 2):x}"


def encode_payload(payload: bytes) -> bytes:
    """A payload of any size as one file, or as several."""
    return b"".join(encode_bytes(payload[lo : lo + MOST]) for lo in range(0, len(payload), MOST))


def decode_payload(media: bytes, size: int) -> tuple[int, int, np.ndarray]:
    """Width, height and grey values of a payload of so many bytes; width of the first file, height of all together."""
    parts, at, width, height = [], 0, 0, 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        w, h, px = decode(media[at:end])
        width, height, at = width or w, height + h, end
        parts.append((px & np.uint32(255)).astype(np.uint8)[: min(MOST, size - MOST * len(parts))])
    return width, height, np.concatenate(parts) if len(parts) > 1 else parts[0]


def to_images(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): texts as lossless WebP files."""

    def run(batches):
        for batch in batches:
            out, known = [], {}
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                if (got := known.get(raw)) is None:
                    padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
                    got = (len(raw), len(padded), encode_payload(padded))
                    if len(raw) < 4096:
                        known[raw] = got
                out.append(got)
                if len(out) == 512:
                    yield _media(batch.column(0).slice(0, 512), out)
                    batch, out, known = batch.slice(512), [], {}
            if out:
                yield _media(batch.column(0), out)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, media binary")


def _media(ids: pa.Array, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_bytes", "payload_bytes", "media"])


def pixel_arrays(images: DataFrame, column: str = "media") -> DataFrame:
    """images with width, height and pixels (four bytes B, G, R, A each) of the files in a binary column; nulls stay."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)

    def run(batches):
        for batch in batches:
            got = [None if b is None else decode(b) for b in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            columns = [pa.array([g and g[i] for g in got], pa.int32()) for i in (0, 1)]
            columns.append(pa.array([None if g is None else g[2].astype("<u4").tobytes() for g in got], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "pixels"])

    return images.mapInArrow(run, f"{schema}, width int, height int, pixels binary")


def read_back(images: DataFrame) -> DataFrame:
    """What the stored images hold: digests of the payload, of its end and of the file, and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            out = []
            for size, media in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                width, height, grey = decode_payload(media, size)
                payload = grey.tobytes()
                out.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), _features(width, height, grey)))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], names)

    schema = f"doc_id {images.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return images.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(run, schema)


def op1_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(materialize(to_images(table(spark, sf_dir, "documents")), "images"))
