"""Media columns: lossless WebP.

``decode`` reads any lossless WebP image (a RIFF file with a VP8L chunk): prefix codes, simple and coded, meta prefix codes,
back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Runs of literal pixels
are decoded in numpy: for every bit position of a window the pixel that would begin there is looked up and its length found, and a
short loop then follows the chain of actual pixels; other symbols are read one by one.

``encode`` writes images with prefix codes over whole pixels, with any of the transforms, the colour cache and back-references on
demand. A payload column is stored as grey samples: subtract-green leaves only the green channel to be coded.

Defined results: null text counts as empty. Payloads longer than one image can hold are stored as several files in a row. Very long
payloads are coded in windows. Repeated rows and equal texts give equal bytes. An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

ROW = 192
MOST_ROWS = 16383
WINDOW = 1 << 18  # bits

# Fixed values of the format: the order of code length codes, the block's transform numbers, and the near distances as (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """A reader of bits, least significant first."""

    def __init__(self, data: bytes):
        self.data = data
        self.at = 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends too early")
        return out

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code: tables from the next 15 bits, or fewer, to symbol and length."""

    def __init__(self, lengths: np.ndarray):
        (used,) = lengths.nonzero()
        if len(used) == 1:  # one symbol takes no bits
            self.bits, self.symbol, self.length = 0, used.astype(np.int32), np.zeros(1, dtype=np.int32)
            return
        self.bits = int(lengths.max()) if len(used) else 0
        if not len(used):
            self.symbol, self.length = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)
            return
        order = used[np.lexsort((used, lengths[used]))]
        sizes = lengths[order].astype(np.int64)
        width = np.int64(1) << (self.bits - sizes)
        if int(width.sum()) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        forward_symbol, forward_length = np.repeat(order, width), np.repeat(sizes, width)
        back = _all_reversed(self.bits)
        self.symbol, self.length = forward_symbol[back].astype(np.int32), forward_length[back].astype(np.int32)

    def read(self, bits: Bits) -> int:
        w = bits.peek(self.bits)
        bits.at += int(self.length[w])
        if bits.at > bits.end:
            raise ValueError("the image ends too early")
        return int(self.symbol[w])


def _reversed_bits(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(n):
        out = (out << 1) | (x & 1)
        x = x >> 1
    return out


@lru_cache(32)
def _all_reversed(n: int) -> np.ndarray:
    return _reversed_bits(np.arange(1 << n), n)


@lru_cache(512)
def _simple_code(symbols: tuple[int, ...]) -> Code:
    lengths = np.zeros(max(symbols) + 1, dtype=np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return _simple_code((first, bits.read(8)) if two else (first,))
    lengths = np.zeros(size, dtype=np.int64)
    of_lengths = np.zeros(19, dtype=np.int64)
    for k in LENGTH_ORDER[: bits.read(4) + 4]:
        of_lengths[k] = bits.read(3)
    code = Code(of_lengths)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise ValueError("too many code lengths")
    at, last = 0, 8
    while at < size and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = last if s == 16 else 0
        at += n
    return Code(lengths)


def _extra(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


class _Literals:
    """For each bit position of a window, the literal pixel that begins there and where the next one would."""

    def __init__(self, data: np.ndarray, codes: list[Code]):
        self.data, self.codes = data, codes
        self.first = self.last = 0

    def load(self, at: int) -> None:
        bits = 8 * len(self.data)
        self.first, self.last = at, min(at + WINDOW, bits)
        byte = at >> 3
        n = self.last - at
        raw = np.zeros((n >> 3) + 24, dtype=np.uint32)
        part = self.data[byte : byte + len(raw)]
        raw[: len(part)] = part
        word = raw[:-3] | (raw[1:-2] << np.uint32(8)) | (raw[2:-1] << np.uint32(16))
        view = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()[at & 7 :]
        green = self.codes[0]
        w = view[:n] & np.uint32((1 << green.bits) - 1)
        symbol = green.symbol[w]
        nxt = np.arange(n, dtype=np.int32) + green.length[w]
        parts = [symbol]
        for code in self.codes[1:4]:
            if code.bits:
                w = view[nxt] & np.uint32((1 << code.bits) - 1)
                parts.append(code.symbol[w])
                nxt = nxt + code.length[w]
            else:
                parts.append(None)
        nxt[(symbol > 255) | (nxt > n) if self.last == bits else symbol > 255] = -1
        self.parts, self.next = parts, nxt
        one = np.append(np.where((nxt < 0) | (nxt >= n), np.int32(n), nxt), np.int32(n))  # n stands for the end
        two = one[one]
        four = two[two]
        self.jumps, self.eight = (one, two, four), memoryview(four[four])

    def run(self, at: int, most: int) -> tuple[int, np.ndarray]:
        """(position behind, pixels) of the literal pixels from at on, at most so many and none that begin outside the window.

        The chain is followed in steps of eight pixels; those between are looked up together."""
        if not self.first <= at < self.last:
            self.load(at)
        jump, size = self.eight, self.last - self.first
        p, chain = at - self.first, []
        keep = chain.append
        for _ in range(-(-most // 8)):
            if p >= size:
                break
            keep(p)
            p = jump[p]
        one, two, four = self.jumps
        where = np.asarray(chain, dtype=np.int32)
        for hop in (four, two, one):
            where = np.stack([where, hop[where]], 1).ravel()
        where = where[:most]
        where = where[: np.searchsorted(where, size)]
        if len(where) and self.next[where[-1]] < 0:  # no literal begins there
            p, where = int(where[-1]), where[:-1]
        elif len(where):
            p = int(self.next[where[-1]])
        else:
            p = at - self.first
        green, *rest = self.parts
        red, blue, alpha = (np.uint32(self.codes[k].symbol[0]) if x is None else x[where].astype(np.uint32) for k, x in enumerate(rest, 1))
        return self.first + p, (alpha << np.uint32(24)) | (red << np.uint32(16)) | (green[where].astype(np.uint32) << np.uint32(8)) | blue


class _Pixels:
    """The coded pixels of one image, with its own codes."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        cache_bits = bits.read(4) if bits.read(1) else 0
        if cache_bits > 11:
            raise ValueError("the colour cache is too large")
        self.groups_at, groups = None, 1
        if main and bits.read(1):
            self.shift = bits.read(3) + 2
            small = _Pixels(bits, (width + (1 << self.shift) - 1) >> self.shift, (height + (1 << self.shift) - 1) >> self.shift, False)
            self.groups_at = (small.out >> np.uint32(8)) & np.uint32(0xFFFF)
            self.across = (width + (1 << self.shift) - 1) >> self.shift
            groups = int(self.groups_at.max()) + 1
        sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        self.groups = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
        self.width, self.total = width, width * height
        self.out = np.zeros(self.total, dtype=np.uint32)
        self.cache = np.zeros(1 << cache_bits, dtype=np.uint32) if cache_bits else None
        self.cache_bits, self.cached = cache_bits, 0
        self._read(bits)

    def _fill_cache(self, upto: int) -> None:
        if self.cache is not None and self.cached < upto:
            new = self.out[self.cached : upto]
            self.cache[(new * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - self.cache_bits)] = new  # of equal places the last wins
            self.cached = upto

    def _group(self, at: int) -> int:
        y, x = divmod(at, self.width)
        return int(self.groups_at[(y >> self.shift) * self.across + (x >> self.shift)])

    def _until(self, at: int) -> int:
        """Where the group of codes may change."""
        if self.groups_at is None:
            return self.total
        y, x = divmod(at, self.width)
        return y * self.width + min(self.width, ((x >> self.shift) + 1) << self.shift)

    def _read(self, bits: Bits) -> None:
        data = np.frombuffer(bits.data, dtype=np.uint8)
        literals = [_Literals(data, g) for g in self.groups]
        at, out = 0, self.out
        plain = [all(c.bits == 0 for c in g[:4]) for g in self.groups]
        while at < self.total:
            g = 0 if self.groups_at is None else self._group(at)
            codes = self.groups[g]
            if plain[g] and codes[0].symbol[0] < 256:  # one colour, no bits
                upto = self._until(at)
                out[at:upto] = sum(int(codes[k].symbol[0]) << s for k, s in ((0, 8), (1, 16), (2, 0), (3, 24)))
                at = upto
                continue
            if not plain[g] and bits.at < bits.end:
                bits.at, run = literals[g].run(bits.at, self._until(at) - at)
                out[at : at + len(run)] = run
                at += len(run)
                if len(run):
                    continue
            symbol = codes[0].read(bits)
            if symbol < 256:
                red, blue, alpha = (codes[k].read(bits) for k in (1, 2, 3))
                out[at] = (alpha << 24) | (red << 16) | (symbol << 8) | blue
                at += 1
            elif symbol < 280:
                n = _extra(symbol - 256, bits)
                d = _extra(codes[4].read(bits), bits)
                if d > 120:
                    d -= 120
                else:
                    x, y = NEAR[d - 1]
                    d = max(1, x + y * self.width)
                if d > at or at + n > self.total:
                    raise ValueError("a back-reference leaves the image")
                out[at : at + n] = np.resize(out[at - d : min(at, at - d + n)], n)
                at += n
            else:
                self._fill_cache(at)
                if symbol - 280 >= len(self.cache):
                    raise ValueError("no such place in the colour cache")
                out[at] = self.cache[symbol - 280]
                at += 1
        self._fill_cache(self.total)


def _planes(argb: np.ndarray) -> list[np.ndarray]:
    return [(argb >> np.uint32(s)) & np.uint32(0xFF) for s in (24, 16, 8, 0)]


def _joined(planes: list[np.ndarray]) -> np.ndarray:
    a, r, g, b = ((p.astype(np.uint32) & np.uint32(0xFF)) for p in planes)
    return (a << np.uint32(24)) | (r << np.uint32(16)) | (g << np.uint32(8)) | b


def _add(x: int, y: int) -> int:
    """Channel by channel, modulo 256."""
    return (((x & 0xFF00FF00) + (y & 0xFF00FF00)) & 0xFF00FF00) | (((x & 0x00FF00FF) + (y & 0x00FF00FF)) & 0x00FF00FF)


def _channels(x: int) -> tuple[int, int, int, int]:
    return x >> 24, (x >> 16) & 255, (x >> 8) & 255, x & 255


def _mean(x: int, y: int) -> int:
    return (((x ^ y) & 0xFEFEFEFE) >> 1) + (x & y)


def _each(f, *xs: int) -> int:
    a, r, g, b = (max(0, min(255, f(*c))) for c in zip(*map(_channels, xs), strict=True))
    return (a << 24) | (r << 16) | (g << 8) | b


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs(t - c) for t, c in zip(_channels(top), _channels(corner), strict=True))
    to_top = sum(abs(x - c) for x, c in zip(_channels(left), _channels(corner), strict=True))
    return left if to_left < to_top else top


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction from the neighbours: left, above, above right and above left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(corner, top)
    if mode == 9:
        return _mean(top, right)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _each(lambda x, y, z: x + y - z, left, top, corner)
    if mode == 13:
        return _each(lambda m, z: m + int((m - z) / 2), _mean(left, top), corner)
    return 0xFF000000


def _modes(blocks: np.ndarray, shift: int, width: int, y: int) -> np.ndarray:
    across = (width + (1 << shift) - 1) >> shift
    return ((blocks[(y >> shift) * across : ((y >> shift) + 1) * across] >> np.uint32(8)) & np.uint32(15)).repeat(1 << shift)[:width]


def predict_image(argb: np.ndarray, width: int, height: int, blocks: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Residuals from pixels, or pixels from residuals. Rows that use only black, top or the corners are taken as a whole."""
    out = argb.reshape(height, width).copy()
    source = argb.reshape(height, width)
    pixels = out if inverse else source
    for y in range(height):
        modes = np.ones(width, dtype=np.uint32) if y == 0 else _modes(blocks, shift, width, y)
        if y:
            above = np.append(pixels[y - 1], pixels[y][0])
        whole = np.isin(modes[1:], (0, 2, 4, 8)).all() if y else False
        if not inverse or whole:
            if whole:
                tops = {0: np.full(width, 0xFF000000, np.uint32), 2: above[:-1], 4: np.append(np.uint32(0), above[:-2]), 8: _mean_rows(np.append(np.uint32(0), above[:-2]), above[:-1])}
                guess = np.choose(np.searchsorted((0, 2, 4, 8), np.where(np.isin(modes, (0, 2, 4, 8)), modes, 0)), list(tops.values()))
                guess[0] = above[0]
            else:
                row = pixels[y].tolist()
                up = above.tolist() if y else None
                guess = np.asarray([_guess(x, y, modes, row, up) for x in range(width)], dtype=np.uint32)
            sign = 1 if inverse else -1
            out[y] = _joined([(p.astype(np.int64) + sign * q.astype(np.int64)).astype(np.uint32) for p, q in zip(_planes(source[y]), _planes(guess), strict=True)])
        elif y == 0 or (modes == 1).all():  # sums along the row
            first = 0xFF000000 if y == 0 else int(above[0])
            planes = [np.cumsum(p.astype(np.uint64)) + np.uint64(c) for p, c in zip(_planes(source[y]), _channels(first), strict=True)]
            out[y] = _joined(planes)
        else:
            row, up = source[y].tolist(), above.tolist()
            for x in range(width):
                if x == 0:
                    row[0] = _add(row[0], up[0])
                    up[-1] = row[0]
                else:
                    row[x] = _add(row[x], _guess(x, y, modes, row, up))
            out[y] = row
    return out.ravel()


def _mean_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (((x ^ y) & np.uint32(0xFEFEFEFE)) >> np.uint32(1)) + (x & y)


def _guess(x: int, y: int, modes: np.ndarray, row: list[int], up: list[int] | None) -> int:
    if y == 0:
        return 0xFF000000 if x == 0 else row[x - 1]
    if x == 0:
        return up[0]
    return predicted(int(modes[x]), row[x - 1], up[x], up[x + 1], up[x - 1])


def cross_colour(argb: np.ndarray, width: int, height: int, blocks: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    across = (width + (1 << shift) - 1) >> shift
    y, x = np.divmod(np.arange(width * height), width)
    element = blocks[(y >> shift) * across + (x >> shift)]
    signed = lambda v: (v & np.uint32(0xFF)).astype(np.uint8).view(np.int8).astype(np.int64)
    red_to_blue, green_to_blue, green_to_red = (signed(element >> np.uint32(s)) for s in (16, 8, 0))
    a, r, g, b = _planes(argb)
    sign = 1 if inverse else -1
    new_r = (r.astype(np.int64) + sign * ((green_to_red * signed(g)) >> 5)) & 255
    red = new_r if inverse else r.astype(np.int64)
    new_b = (b.astype(np.int64) + sign * ((green_to_blue * signed(g)) >> 5) + sign * ((red_to_blue * signed(red.astype(np.uint32))) >> 5)) & 255
    return _joined([a, new_r.astype(np.uint32), g, new_b.astype(np.uint32)])


def subtract_green(argb: np.ndarray, inverse: bool) -> np.ndarray:
    green = (argb >> np.uint32(8)) & np.uint32(0xFF)
    both = (green << np.uint32(16)) | green
    low = argb & np.uint32(0x00FF00FF)
    low = low + both if inverse else (low | np.uint32(0xFF00FF00)) - both
    return (argb & np.uint32(0xFF00FF00)) | (low & np.uint32(0x00FF00FF))


def unpack_palette(argb: np.ndarray, width: int, height: int, colours: np.ndarray, pack: int) -> np.ndarray:
    """Pixels from indices, 1 << pack of which stand in each green value."""
    index = ((argb >> np.uint32(8)) & np.uint32(0xFF)).reshape(height, -1)
    if pack:
        bits = 8 >> pack
        index = ((index[:, :, None] >> (np.arange(1 << pack, dtype=np.uint32) * np.uint32(bits))) & np.uint32((1 << bits) - 1)).reshape(height, -1)[:, :width]
    known = np.zeros(256, dtype=np.uint32)
    known[: len(colours)] = colours
    return known[index].ravel()


def _pack_of(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(file: bytes) -> np.ndarray:
    """height x width pixels as 32-bit ARGB."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, end = 12, min(len(file), 8 + int.from_bytes(file[4:8], "little"))
    while at + 8 <= end:
        name, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return _decode_stream(file[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def _decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            n = [(v + (1 << shift) - 1) >> shift for v in (across, height)]
            undo.append((kind, across, _Pixels(bits, *n, False).out, shift))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, across, None, 0))
        else:
            count = bits.read(8) + 1
            steps = _Pixels(bits, count, 1, False).out
            colours = _joined([np.cumsum(p.astype(np.uint64)) for p in _planes(steps)])
            undo.append((kind, across, colours, _pack_of(count)))
            across = (across + (1 << _pack_of(count)) - 1) >> _pack_of(count)
    argb = _Pixels(bits, across, height, True).out
    for kind, at_width, extra, n in reversed(undo):
        if kind == PREDICTOR:
            argb = predict_image(argb, at_width, height, extra, n, True)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, at_width, height, extra, n, True)
        elif kind == SUBTRACT_GREEN:
            argb = subtract_green(argb, True)
        else:
            argb = unpack_palette(argb, at_width, height, extra, n)
    return argb.reshape(height, width)


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for the counts, none over most; a lone symbol gets 1."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    (used,) = counts.nonzero()
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, i, None) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(weights) - 1)
        for n in range(len(weights), len(parent)):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = n
            heapq.heappush(heap, (a[0] + b[0], n, None))
        depth = [0] * len(parent)
        for n in range(len(parent) - 2, -1, -1):
            depth[n] = depth[parent[n]] + 1
        if max(depth) <= most:
            lengths[used] = depth[: len(weights)]
            return lengths
        weights = [(w + 1) // 2 for w in weights]


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical words, bits reversed as they are written."""
    words = np.zeros(len(lengths), dtype=np.int64)
    (used,) = lengths.nonzero()
    if len(used) < 2:
        return words
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order]
    top = int(sizes.max())
    starts = np.concatenate(([0], np.cumsum(np.int64(1) << (top - sizes))[:-1])) >> (top - sizes)
    words[order] = _all_reversed(top)[starts << (top - sizes)]
    return words


@dataclass
class Writer:
    """(value, bits) pairs, put together at the end."""

    values: list[np.ndarray] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    loose: list[tuple[int, int]] = field(default_factory=list)

    def put(self, value: int, n: int) -> None:
        self.loose.append((value, n))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._settle()
        self.values.append(values)
        self.sizes.append(sizes)

    def _settle(self) -> None:
        if self.loose:
            v, n = np.asarray(self.loose, dtype=np.int64).T
            self.values.append(v)
            self.sizes.append(n)
            self.loose = []

    def bytes(self) -> bytes:
        self._settle()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        size = (int(ends[-1]) + 7) >> 3
        shifted, byte = values << (starts & 7), starts >> 3
        total = np.bincount(byte, shifted & 255, size + 3)
        total[1:] += np.bincount(byte, (shifted >> 8) & 255, size + 2)
        if int(sizes.max()) > 9:
            total[2:] += np.bincount(byte, (shifted >> 16) & 255, size + 1)
        return total[:size].astype(np.uint8).tobytes()


def _put_code(out: Writer, lengths: np.ndarray) -> np.ndarray:
    """Write a code; gives the bits of each symbol as they are used, 0 for a lone one."""
    (used,) = lengths.nonzero()
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(int(symbols[0] > 1), 1)
        out.put(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return lengths if len(symbols) == 2 else np.zeros_like(lengths)
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    gaps = np.diff(used, prepend=-1) - 1
    for gap, size in zip(gaps.tolist(), lengths[used].tolist(), strict=True):
        while gap:
            n = min(gap, 138)
            runs += [(0, 0, 0)] * n if n < 3 else [(17, n - 3, 3)] if n < 11 else [(18, n - 11, 7)]
            gap -= n
        runs.append((size, 0, 0))
    counts = np.bincount([r[0] for r in runs], minlength=19)
    if (counts > 0).sum() == 1:  # the code of lengths needs two symbols at least here
        counts[0 if not counts[0] else 1] += 1
    of_lengths = code_lengths(counts, 7)
    words = code_words(of_lengths)
    out.put(0, 1)
    last = max(i for i, k in enumerate(LENGTH_ORDER) if of_lengths[k])
    out.put(max(4, last + 1) - 4, 4)
    for k in LENGTH_ORDER[: max(4, last + 1)]:
        out.put(int(of_lengths[k]), 3)
    short = used[-1] + 1 < len(lengths)
    out.put(int(short), 1)
    if short:
        n = len(runs) - 2
        half = max(0, -(-max(1, n.bit_length()) // 2) - 1) if n >= 0 else 0
        out.put(half, 3)
        out.put(max(0, n), 2 + 2 * half)
        if n < 0:
            raise ValueError("too few code lengths")
    for s, v, n in runs:
        out.put(int(words[s]), int(of_lengths[s]))
        if n:
            out.put(v, n)
    return lengths


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    return 2 * n + 2 + (((value - 1) >> n) & 1), (value - 1) & ((1 << n) - 1), n


def _put_pixels(out: Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, copies: tuple[tuple[int, int, int], ...] = ()) -> None:
    """Pixels as literals; copies: (position, length, distance) of back-references; with a cache, pixels found in it by place."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    if not cache_bits and not copies:
        planes = [(argb >> np.uint32(s)) & np.uint32(0xFF) for s in (8, 16, 0, 24)]
        sizes = (280, 256, 256, 256)
        bits = []
        for plane, n in zip(planes, sizes, strict=True):
            bits.append(_put_code(out, code_lengths(np.bincount(plane, minlength=n))))
        _put_code(out, np.zeros(40, dtype=np.int64))
        live = [(p, b) for p, b in zip(planes, bits, strict=True) if b.any()]
        if live:
            out.put_all(*(np.stack([t(b)[p] for p, b in live], 1).ravel() for t in (code_words, lambda b: b)))
        return
    cache = np.zeros(1 << cache_bits, dtype=np.uint32)
    place = (argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits) if cache_bits else None
    begin = {p: (n, d) for p, n, d in copies}
    symbols: list[tuple[int, ...]] = []
    at = 0
    while at < len(argb):
        v = int(argb[at])
        n = 1
        if at in begin:
            n, d = begin[at]
            symbols.append((256 + _prefix(n)[0], *_prefix(n)[1:], *_prefix(d + 120)))
        elif cache_bits and cache[place[at]] == argb[at]:
            symbols.append((280 + int(place[at]),))
        else:
            symbols.append(((v >> 8) & 255, (v >> 16) & 255, v & 255, v >> 24))
        if cache_bits:
            cache[place[at : at + n]] = argb[at : at + n]
        at += n
    counts = [np.zeros(n, dtype=np.int64) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for s in symbols:
        counts[0][s[0]] += 1
        if len(s) == 4:
            for k in (1, 2, 3):
                counts[k][s[k]] += 1
        elif len(s) == 6:
            counts[4][s[3]] += 1
    bits = [_put_code(out, code_lengths(c)) for c in counts]
    words = [code_words(b) for b in bits]
    for s in symbols:
        out.put(int(words[0][s[0]]), int(bits[0][s[0]]))
        if len(s) == 4:
            for k in (1, 2, 3):
                out.put(int(words[k][s[k]]), int(bits[k][s[k]]))
        elif len(s) == 6:
            out.put(s[1], s[2])
            out.put(int(words[4][s[3]]), int(bits[4][s[3]]))
            out.put(s[4], s[5])


@dataclass(frozen=True)
class Plan:
    """What an image is written with. predictor and cross: the block images as (shift, blocks); palette: colours in order."""

    predictor: tuple[int, np.ndarray] | None = None
    cross: tuple[int, np.ndarray] | None = None
    green: bool = False
    palette: np.ndarray | None = None
    cache_bits: int = 0
    copies: tuple[tuple[int, int, int], ...] = ()


def encode(pixels: np.ndarray, plan: Plan = Plan()) -> bytes:
    """A lossless WebP file from height x width pixels as 32-bit ARGB."""
    height, width = pixels.shape
    argb, across, out = pixels.astype(np.uint32).ravel(), width, Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(bool((argb < np.uint32(0xFF000000)).any())), 1)
    out.put(0, 3)
    if plan.palette is not None:
        pack = _pack_of(len(plan.palette))
        out.put(1 | (PALETTE << 1), 3)
        out.put(len(plan.palette) - 1, 8)
        planes = [np.diff(p.astype(np.int64), prepend=0).astype(np.uint32) for p in _planes(plan.palette.astype(np.uint32))]
        _put_pixels(out, _joined(planes), False)
        order = np.argsort(plan.palette, kind="stable")
        index = order[np.searchsorted(plan.palette[order], argb)].reshape(height, width)
        across = (width + (1 << pack) - 1) >> pack
        index = np.pad(index, ((0, 0), (0, (across << pack) - width))).reshape(height, across, 1 << pack)
        argb = ((index << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2).astype(np.uint32) << np.uint32(8)).ravel() | np.uint32(0xFF000000)
    if plan.green:
        out.put(1 | (SUBTRACT_GREEN << 1), 3)
        argb = subtract_green(argb, False)
    for kind, given, change in ((PREDICTOR, plan.predictor, predict_image), (CROSS_COLOUR, plan.cross, cross_colour)):
        if given is not None:
            shift, blocks = given
            out.put(1 | (kind << 1), 3)
            out.put(shift - 2, 3)
            _put_pixels(out, blocks.astype(np.uint32), False)
            argb = change(argb, across, height, blocks.astype(np.uint32), shift, False)
    out.put(0, 1)
    _put_pixels(out, argb, True, plan.cache_bits, plan.copies)
    data = out.bytes()
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + padded


GREY = Plan(green=True)


def store(payload: bytes) -> bytes:
    """A payload of whole rows of 192 bytes as grey pixels; one file for each 16383 rows."""
    files = []
    for at in range(0, len(payload), ROW * MOST_ROWS):
        grey = np.frombuffer(payload[at : at + ROW * MOST_ROWS], dtype=np.uint8).astype(np.uint32)
        files.append(encode((grey * np.uint32(0x010101) | np.uint32(0xFF000000)).reshape(-1, ROW), GREY))
    return b"".join(files)


def load(media: bytes) -> np.ndarray:
    """The samples of what store wrote, rows x 192."""
    images, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        images.append((decode(media[at:end]) & np.uint32(0xFF)).astype(np.uint8))
        at = end
    return np.concatenate(images)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "), len(raw)


def features(samples: np.ndarray) -> str:
    """Rows, the rounded mean and deviation, and a hash of 64 bits: which of 64 bands of columns lie above the mean."""
    bands = samples.reshape(len(samples), 64, -1).mean(axis=(0, 2))
    code = int("".join("1" if b > bands.mean() else "0" for b in bands), 2)
    return f"{len(samples)}:{samples.mean():.3f}:{samples.std():.3f}:{code:016x}"


def media_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """The stored media of each text with its features, computed from the bytes as read back."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)])
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    if with_media:
        schema = schema.add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                found = []
                for text in part.column("text").to_pylist():
                    payload, n = payload_of(text)
                    media = store(payload)
                    samples = load(media)
                    back = samples.tobytes()
                    found.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), *[media] * with_media))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=False)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def decoded(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each image of each file: id, image (from 0), height, width, pixels (rows of 32-bit ARGB, little-endian) and error.

    Media of several images in turn, as store writes them, give them all. What can't be read gives one row with the reason in error
    and nulls for the pixels, after those of the images before it; so does a null or empty file.
    """
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)])
    for name, kind in (("image", "integer"), ("height", "integer"), ("width", "integer"), ("pixels", "binary"), ("error", "string")):
        schema = schema.add(name, kind)

    def images(media: bytes) -> Iterator[tuple]:
        at = number = 0
        while at < len(media) or not number:
            end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
            try:
                pixels = decode(media[at:end])
            except (ValueError, IndexError) as e:
                yield number, None, None, None, str(e)
                return
            yield number, *pixels.shape, pixels.astype("<u4").tobytes(), None
            at, number = end, number + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for i, media in enumerate(batch.column("media")):
                for found in images(media.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *[pa.array([v], k) for v, k in zip(found, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def op3_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_rows(table(spark, sf_dir, "documents"), with_media=False)
