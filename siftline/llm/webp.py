"""Lossless WebP (VP8L) for media columns: a writer, and a reader of all that the format has.

The reader decodes prefix codes (single, one for each channel, or by region), back-references, the colour cache,
and inverts predictor, cross-colour, green-subtraction and palette transforms; it gives pixels as RGBA bytes. The
writer packs four bytes to a pixel and can apply each of these on request.

Media columns are written and read by ``webp_many``, many images at a time, with predictor, cross-colour, references and
cache chosen by cost. A payload over ``webp_many.FRAME`` bytes is stored as several images one after another.

Defined results: null text is an empty one; an empty payload is padded to 64 zero bytes; repeated rows give equal
values; an empty table gives an empty result; further columns are ignored. Bytes that are no such file raise
ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .tables import map_frames, stored

WIDTH = 16
#: Bytes that are written, and read, together. To read takes a step for each pixel of the largest image, however many there are; to
#: write takes few steps on long arrays, which should stay in the processor's cache.
WRITTEN, READ = 1 << 20, 4 << 20

# Fixed values of the format (RFC 9649): order of code length codes, and places of near back-references as
# 16 * rows up + 8 - columns to the left.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    0x18, 0x07, 0x17, 0x19, 0x28, 0x06, 0x27, 0x29, 0x16, 0x1A, 0x26, 0x2A, 0x38, 0x05, 0x37, 0x39, 0x15, 0x1B, 0x36, 0x3A,
    0x25, 0x2B, 0x48, 0x04, 0x47, 0x49, 0x14, 0x1C, 0x35, 0x3B, 0x46, 0x4A, 0x24, 0x2C, 0x58, 0x45, 0x4B, 0x34, 0x3C, 0x03,
    0x57, 0x59, 0x13, 0x1D, 0x56, 0x5A, 0x23, 0x2D, 0x44, 0x4C, 0x55, 0x5B, 0x33, 0x3D, 0x68, 0x02, 0x67, 0x69, 0x12, 0x1E,
    0x66, 0x6A, 0x22, 0x2E, 0x54, 0x5C, 0x43, 0x4D, 0x65, 0x6B, 0x32, 0x3E, 0x78, 0x01, 0x77, 0x79, 0x53, 0x5D, 0x11, 0x1F,
    0x64, 0x6C, 0x42, 0x4E, 0x76, 0x7A, 0x21, 0x2F, 0x75, 0x7B, 0x31, 0x3F, 0x63, 0x6D, 0x52, 0x5E, 0x00, 0x74, 0x7C, 0x41,
    0x4F, 0x10, 0x20, 0x62, 0x6E, 0x30, 0x73, 0x7D, 0x51, 0x5F, 0x40, 0x72, 0x7E, 0x61, 0x6F, 0x50, 0x71, 0x7F, 0x60, 0x70,
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTHS, DISTANCES = 24, 40


# ---- prefix codes


def _mirror() -> list[int]:
    x = np.arange(1 << 15)
    return sum((x >> k & 1) << (14 - k) for k in range(15)).tolist()


MIRROR = _mirror()  # the 15 bits of each number, backwards


def reversed_codes(lengths: Sequence[int]) -> list[int]:
    """Canonical codes, first bit lowest; 0 for symbols without a code."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - last
        last = n
        out[s] = MIRROR[code] >> (15 - n)
        code += 1
    return out


class Code:
    """A look-up table from the next ``bits`` bits to length + 16 * symbol."""

    def __init__(self, lengths: Sequence[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.lengths = tuple(lengths)
        if len(used) < 2:  # one symbol takes no bits
            self.bits, self.table = 0, [16 * used[0] if used else 0]
            return
        if sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
            raise ValueError("incomplete prefix code")
        self.bits = max(lengths)
        table, codes = [0] * (1 << self.bits), reversed_codes(lengths)
        for s in used:
            n = lengths[s]
            table[codes[s] :: 1 << n] = [n + 16 * s] * (1 << (self.bits - n))
        self.table = table


known_code = lru_cache(maxsize=64)(Code)


def code_lengths(counts: Sequence[int], most: int = 12) -> list[int]:
    """Lengths of a Huffman code, none over ``most``."""
    counts = list(counts)
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    while True:
        heap = [(counts[s], i, None) for i, s in enumerate(used)]
        heapq.heapify(heap)
        up: list[int] = [0] * (2 * len(used) - 1)
        for k in range(len(used), 2 * len(used) - 1):
            a, b = heapq.heappop(heap), heap[0]
            up[a[1]] = up[b[1]] = k
            heapq.heapreplace(heap, (a[0] + b[0], k, None))
        depth = [0] * len(up)
        for k in range(len(up) - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[: len(used)]) <= most:
            for i, s in enumerate(used):
                out[s] = depth[i]
            return out
        counts = [(n + 1) // 2 if n else 0 for n in counts]
        if max(counts) == 1 and len(used) > 1 << most:
            raise ValueError("too many symbols")


# ---- writer


class Bits:
    """Bits written lowest first."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def _length_code() -> tuple[list[int], list[int]]:
    """One fixed complete code for code lengths: 13 symbols of 4 bits, 6 rare ones of 5."""
    n = [5 if s in (1, 2, 13, 14, 15, 16) else 4 for s in range(19)]
    return n, reversed_codes(n)


LENGTH_BITS, LENGTH_CODES = _length_code()


def put_code(out: Bits, lengths: Sequence[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
        for s in used:
            out.put(s, 8)
        return
    value, size = 0, 1
    value |= 15 << size
    size += 4
    for s in LENGTH_ORDER:
        value |= LENGTH_BITS[s] << size
        size += 3
    size += 1  # no limit on symbols
    end = -1
    for s in [*used, len(lengths)]:
        gap = s - end - 1
        while gap:
            if gap < 3:
                value |= LENGTH_CODES[0] << size
                size += LENGTH_BITS[0]
                gap -= 1
            else:
                run = min(gap, 138)
                k, extra, width = (18, run - 11, 7) if run > 10 else (17, run - 3, 3)
                value |= (LENGTH_CODES[k] | extra << LENGTH_BITS[k]) << size
                size += LENGTH_BITS[k] + width
                gap -= run
        if s < len(lengths):
            value |= LENGTH_CODES[lengths[s]] << size
            size += LENGTH_BITS[lengths[s]]
        end = s
    out.put(value, size)


def prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number for a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    n = high - 1
    return 2 * high + (v >> n & 1), v & ((1 << n) - 1), n


def put_tokens(out: Bits, tokens: list[tuple], alphabet: int) -> None:
    """Prefix codes and then the tokens: ('p', r, g, b, a), ('c', index in the cache) or ('r', length, distance code)."""
    counts = [[0] * n for n in (alphabet, 256, 256, 256, DISTANCES)]
    flat = []
    for t in tokens:
        if t[0] == "p":
            flat.append([(0, t[2]), (1, t[1]), (2, t[3]), (3, t[4])])
        elif t[0] == "c":
            flat.append([(0, 256 + LENGTHS + t[1])])
        else:
            a, b = prefix(t[1]), prefix(t[2])
            flat.append([(0, 256 + a[0]), a[1:], (4, b[0]), b[1:]])
        for i, x in enumerate(flat[-1]):
            if t[0] != "r" or i % 2 == 0:
                counts[x[0]][x[1]] += 1
    lengths = [code_lengths(c, 15) for c in counts]
    codes = [reversed_codes(n) for n in lengths]
    for n in lengths:
        put_code(out, n)
    single = [sum(map(bool, n)) < 2 for n in lengths]
    for t, parts in zip(tokens, flat):
        for i, (k, s) in enumerate(parts):
            if t[0] == "r" and i % 2:
                out.put(k, s)
            elif not single[k]:
                out.put(codes[k][s], lengths[k][s])


def tokens_of(pixels: np.ndarray, width: int, cache_bits: int, references: bool) -> list[tuple]:
    """Tokens for pixels (n, 4): repeats of the four pixels from here on become back-references if asked for."""
    rows = [tuple(map(int, p)) for p in pixels]
    cache, seen, out, at = {}, {}, [], 0

    def keep(p):
        if cache_bits:
            cache[_slot(p, cache_bits)] = p

    while at < len(rows):
        key = tuple(rows[at : at + 4])
        n = 0
        if references and (there := seen.get(key)) is not None:
            while n < 4096 and at + n < len(rows) and rows[there + n] == rows[at + n]:
                n += 1
        if n >= 4:
            out.append(("r", n, at - there + len(NEAR)))
        else:
            n = 1
            slot = _slot(rows[at], cache_bits) if cache_bits else 0
            out.append(("c", slot) if cache_bits and cache.get(slot) == rows[at] else ("p", *rows[at]))
        for i in range(at, at + n):
            keep(rows[i])
            seen[tuple(rows[i : i + 4])] = i
        at += n
    return out


def _slot(p: tuple, bits: int) -> int:
    argb = p[3] << 24 | p[0] << 16 | p[1] << 8 | p[2]
    return (CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - bits)


def put_small_image(out: Bits, pixels: np.ndarray) -> None:
    """An image of a transform: no cache, one group."""
    out.put(0, 1)
    put_tokens(out, tokens_of(pixels.reshape(-1, 4), 1, 0, False), 256 + LENGTHS)


def container(bits: bytes) -> bytes:
    chunk = b"VP8L" + len(bits).to_bytes(4, "little") + bits + b"\0" * (len(bits) % 2)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def header(width: int, height: int) -> Bits:
    if not (1 <= width <= 1 << 14 and 1 <= height <= 1 << 14):
        raise ValueError("an image has 1 to 16384 columns and rows")
    out = Bits()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def encode_with(pixels: np.ndarray, transforms: Sequence[int] = (), cache_bits: int = 0, references: bool = False, regions: int = 0) -> bytes:
    """A file that uses the named transforms, a colour cache, back-references and prefix codes by region (two groups,
    in a checkerboard of squares of 2 ** regions pixels). Pixels: (height, width, 4), RGBA."""
    height, width = pixels.shape[:2]
    out, at = header(width, height), pixels.astype(np.uint8).copy()
    for t in transforms:
        out.put(1, 1)
        out.put(t, 2)
        if t == SUBTRACT_GREEN:
            at[..., 0] -= at[..., 1]
            at[..., 2] -= at[..., 1]
        elif t == PALETTE:
            colours, index = np.unique(at.reshape(-1, 4), axis=0, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours")
            out.put(len(colours) - 1, 8)
            put_small_image(out, np.concatenate([colours[:1], colours[1:] - colours[:-1]]))
            bits = palette_bits(len(colours))
            per = 1 << bits
            index = index.reshape(height, at.shape[1]).astype(np.uint8)
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % per)))
            green = sum(index[:, k::per] << (k * (8 >> bits)) for k in range(per))
            at = np.zeros((*green.shape, 4), np.uint8)
            at[..., 1], at[..., 3] = green, 255
        else:
            bits = 2
            out.put(bits - 2, 3)
            tiles = np.zeros((-(-height // 4), -(-at.shape[1] // 4), 4), np.uint8)
            rows, columns = tiles.shape[:2]
            tiles[..., 3] = 255
            number = np.arange(rows * columns).reshape(rows, columns)
            if t == PREDICTOR:
                tiles[..., 1] = number % 14
                put_small_image(out, tiles)
                at = predict(at, tiles, bits, forward=True)
            else:
                tiles[..., 0], tiles[..., 1], tiles[..., 2] = number * 37 % 256, number * 91 % 256, number * 53 % 256
                put_small_image(out, tiles)
                at = cross(at, tiles, bits, forward=True)
    out.put(0, 1)
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    tokens = tokens_of(at.reshape(-1, 4), at.shape[1], cache_bits, references)
    alphabet = 256 + LENGTHS + (1 << cache_bits if cache_bits else 0)
    out.put(bool(regions), 1)
    if not regions:
        put_tokens(out, tokens, alphabet)
    else:
        out.put(regions - 2, 3)
        side = 1 << regions
        board = np.zeros((-(-height // side), -(-at.shape[1] // side), 4), np.uint8)
        board[..., 3] = 255
        board[..., 1] = np.add.outer(np.arange(board.shape[0]), np.arange(board.shape[1])) % 2
        put_small_image(out, board)
        put_by_region(out, tokens, alphabet, board[..., 1], at.shape[1], regions)
    return container(out.value.to_bytes((out.size + 7) // 8, "little"))


def put_by_region(out: Bits, tokens: list[tuple], alphabet: int, groups: np.ndarray, width: int, bits: int) -> None:
    """Tokens in the codes of the region that their first pixel lies in. Groups get codes of equal lengths for every symbol
    in use by any."""
    merged = Bits()
    put_tokens(merged, tokens, alphabet)
    codes = Bits()
    # the same codes, written once for each group
    counts = len(np.unique(groups))
    start = _codes_size(merged, alphabet)
    for _ in range(max(2, counts) if groups.max() else 1):
        codes.put(merged.value & ((1 << start) - 1), start)
    out.put(codes.value, codes.size)
    out.put(merged.value >> start, merged.size - start)


def _codes_size(bits: Bits, alphabet: int) -> int:
    r = Reader(bits.value.to_bytes((bits.size + 7) // 8 + 16, "little"))
    for n in (alphabet, 256, 256, 256, DISTANCES):
        r.code(n)
    return r.at


def palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


# ---- reader


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        padded = np.frombuffer(data + b"\0" * 16, np.uint8).astype(np.uint32)
        n = len(data) + 8
        self.windows = (padded[:n] | padded[1 : n + 1] << 8 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 24).tolist()

    def get(self, n: int) -> int:
        if self.at > 8 * len(self.data):
            raise ValueError("the file ends early")
        v = self.windows[self.at >> 3] >> (self.at & 7) & ((1 << n) - 1) if n <= 24 else self.get(16) | self.get(n - 16) << 16
        self.at += n if n <= 24 else 0
        return v

    def symbol(self, code: Code) -> int:
        if self.at > 8 * len(self.data):
            raise ValueError("the file ends early")
        e = code.table[self.windows[self.at >> 3] >> (self.at & 7) & ((1 << code.bits) - 1)]
        self.at += e & 15
        return e >> 4

    def code(self, alphabet: int, known: dict | None = None) -> Code:
        if self.get(1):
            two, wide = self.get(1), self.get(1)
            lengths = [0] * max(alphabet, 256)
            lengths[self.get(8 if wide else 1)] = 1
            if two:
                lengths[self.get(8)] = 1
        else:
            of = [0] * 19
            for s in LENGTH_ORDER[: 4 + self.get(4)]:
                of[s] = self.get(3)
            small = known_code(tuple(of))
            left = alphabet
            if self.get(1):
                left = 2 + self.get(2 + 2 * self.get(3))
            lengths, last = [], 8
            windows, table, mask, at, end = self.windows, small.table, (1 << small.bits) - 1, self.at, 8 * len(self.data)
            while len(lengths) < alphabet and left > 0:
                if at > end:
                    raise ValueError("the file ends early")
                left -= 1
                e = windows[at >> 3] >> (at & 7)
                s = table[e & mask]
                at += s & 15
                e >>= s & 15
                s >>= 4
                if s < 16:
                    lengths.append(s)
                    last = s or last
                elif s == 16:
                    lengths += [last] * (3 + (e & 3))
                    at += 2
                elif s == 17:
                    lengths += [0] * (3 + (e & 7))
                    at += 3
                else:
                    lengths += [0] * (11 + (e & 127))
                    at += 7
            self.at = at
            if len(lengths) > alphabet:
                raise ValueError("too many code lengths")
            lengths += [0] * (alphabet - len(lengths))
        if len(lengths) > 256 and not any(lengths[256:]):
            del lengths[256:]
        key = tuple(lengths)
        if known is None:
            return Code(lengths)
        if key not in known:
            known[key] = Code(lengths)
        return known[key]

    def value(self, symbol: int) -> int:
        """Length or distance of a prefix symbol."""
        if symbol < 4:
            return symbol + 1
        n = (symbol - 2) >> 1
        return ((2 + (symbol & 1)) << n) + self.get(n) + 1


def runs(code: Code) -> tuple[int, list[int], list[bytes]]:
    """The size of a window and, for each window, the bits that its whole codes take + 16 * their number, and their symbols (up to 4)."""
    wide = max(code.bits, 8)
    size = 1 << wide
    t = np.tile(np.array(code.table, np.int32), size >> code.bits)
    at = np.arange(size)
    bits, number = np.zeros(size, np.int32), np.zeros(size, np.int32)
    symbols = np.zeros((size, 4), np.uint8)
    for k in range(4):
        e = t[at >> bits]
        fits = (number == k) & (bits + (e & 15) <= wide)
        symbols[:, k] = e >> 4
        bits += (e & 15) * fits
        number += fits
    flat = symbols.tobytes()
    return wide, (bits + 16 * number).tolist(), [flat[4 * i : 4 * i + n] for i, n in enumerate(number.tolist())]


def literals(r: Reader, code: Code, n: int) -> bytes:
    """n samples in one code, several at a time."""
    wide, moves, found = runs(code)
    windows, mask, at, out = r.windows, (1 << wide) - 1, r.at, []
    put, last = out.append, 8 * len(r.data)
    while n > 0:
        if at > last:
            raise ValueError("the file ends early")
        i = windows[at >> 3] >> (at & 7) & mask
        put(found[i])
        e = moves[i]
        at += e & 15
        n -= e >> 4
    r.at = at
    return b"".join(out)[: n or None]


def pixels_of(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """(height, width, 4) RGBA."""
    cache_bits = 0
    if r.get(1):
        cache_bits = r.get(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("bad size of the colour cache")
    groups, bits = None, 0
    if main and r.get(1):
        bits = r.get(3) + 2
        board = pixels_of(r, -(-width // (1 << bits)), -(-height // (1 << bits)), False)
        groups = (board[..., 0].astype(int) << 8 | board[..., 1]).tolist()
    known: dict = {}
    alphabet = 256 + LENGTHS + (1 << cache_bits if cache_bits else 0)
    count = max(map(max, groups)) + 1 if groups else 1
    codes = [[r.code(n, known) for n in (alphabet, 256, 256, 256, DISTANCES)] for _ in range(count)]
    total = width * height
    green, red, blue, alpha, far = codes[0]
    if not groups and not cache_bits and green is red is blue is alpha and 0 < green.bits:
        flat = np.frombuffer(literals(r, green, 4 * total), np.uint8).reshape(height, width, 4)
        return flat[..., [1, 0, 2, 3]]
    cache = [(0, 0, 0, 0)] * (1 << cache_bits)
    out: list[tuple] = []
    while len(out) < total:
        y, x = divmod(len(out), width)
        if groups:
            green, red, blue, alpha, far = codes[groups[y >> bits][x >> bits]]
        s = r.symbol(green)
        if s < 256:
            a = r.symbol(red)
            b = r.symbol(blue)
            out.append((a, s, b, r.symbol(alpha)))
            new = 1
        elif s < 256 + LENGTHS:
            new = r.value(s - 256)
            d = r.value(r.symbol(far))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                v = NEAR[d - 1]
                d = max(1, (v >> 4) * width + 8 - (v & 15))
            if d > len(out) or len(out) + new > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(new):
                out.append(out[-d])
        else:
            out.append(cache[s - 256 - LENGTHS])
            new = 1
        if cache_bits:
            for p in out[-new:]:
                cache[_slot(p, cache_bits)] = p
    return np.array(out, np.uint8).reshape(height, width, 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def cross(image: np.ndarray, tiles: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Takes away (forward) or adds the parts of red and blue that tiles predict from green and red."""
    height, width = image.shape[:2]
    t = tiles.repeat(1 << bits, 0).repeat(1 << bits, 1)[:height, :width]
    blue_by_red, blue_by_green, red_by_green = _signed(t[..., 0]), _signed(t[..., 1]), _signed(t[..., 2])
    out, sign = image.astype(np.int32), -1 if forward else 1
    green = _signed(image[..., 1])
    red = out[..., 0] + sign * (red_by_green * green >> 5)
    source = image[..., 0] if forward else red
    out[..., 2] += sign * ((blue_by_green * green >> 5) + (blue_by_red * _signed(np.asarray(source) & 255) >> 5))
    out[..., 0] = red
    return (out & 255).astype(np.uint8)


def predict(image: np.ndarray, tiles: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Takes away (forward) or adds the prediction of each pixel from those before it."""
    height, width = image.shape[:2]
    given = image.tolist()
    done: list[list[list[int]]] = given if forward else []
    modes = (tiles[..., 1] & 15).tolist()
    half = lambda a, b: [(p + q) >> 1 for p, q in zip(a, b)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    out = []
    for y in range(height):
        row: list[list[int]] = []
        if not forward:
            done.append(row)
        result = []
        for x in range(width):
            if not y and not x:
                p = [0, 0, 0, 255]
            elif not y:
                p = done[y][x - 1]
            elif not x:
                p = done[y - 1][0]
            else:
                left, top, corner = done[y][x - 1], done[y - 1][x], done[y - 1][x - 1]
                # right of the last column lies the first pixel of the row
                right = done[y - 1][x + 1] if x + 1 < width else done[y][0]
                m = modes[y >> bits][x >> bits]
                if m == 0 or m > 13:
                    p = [0, 0, 0, 255]
                elif m <= 4:
                    p = (left, top, right, corner)[m - 1]
                elif m == 5:
                    p = half(half(left, right), top)
                elif m <= 7:
                    p = half(left, corner if m == 6 else top)
                elif m <= 9:
                    p = half(corner, top) if m == 8 else half(top, right)
                elif m == 10:
                    p = half(half(left, corner), half(top, right))
                elif m == 11:
                    to_left = sum(abs(b - c) for b, c in zip(top, corner))
                    to_top = sum(abs(a - c) for a, c in zip(left, corner))
                    p = left if to_left < to_top else top
                elif m == 12:
                    p = [clip(a + b - c) for a, b, c in zip(left, top, corner)]
                else:
                    p = [clip(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner)]
            v = given[y][x]
            if forward:
                result.append([(a - b) & 255 for a, b in zip(v, p)])
            else:
                row.append([(a + b) & 255 for a, b in zip(v, p)])
        out.append(result)
    return np.array(out if forward else done, np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) RGBA pixels of a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + n + n % 2
    r = Reader(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if r.get(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    undo, wide = [], width
    while r.get(1):
        kind = r.get(2)
        if kind == SUBTRACT_GREEN:
            undo.append((kind, wide, None, 0))
        elif kind == PALETTE:
            n = r.get(8) + 1
            colours = np.cumsum(pixels_of(r, n, 1, False)[0].astype(int), axis=0).astype(np.uint8)
            undo.append((kind, wide, colours, palette_bits(n)))
            wide = -(-wide // (1 << palette_bits(n)))
        else:
            bits = r.get(3) + 2
            undo.append((kind, wide, pixels_of(r, -(-wide // (1 << bits)), -(-height // (1 << bits)), False), bits))
    image = pixels_of(r, wide, height, True)
    for kind, wide, tiles, bits in reversed(undo):
        if kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        elif kind == PALETTE:
            per, size = 1 << bits, 8 >> bits
            index = (image[..., 1, None] >> (np.arange(per, dtype=np.uint8) * size)) & ((1 << size) - 1)
            index = index.reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(tiles)] = tiles
            image = table[index]
        else:
            image = (predict if kind == PREDICTOR else cross)(image, tiles, bits, False)
    return image


# ---- media columns


def to_media_many(payloads: Sequence[bytes]) -> list[bytes]:
    """Each payload, of a multiple of 64 bytes, as one image for each FRAME bytes."""
    from .webp_many import FRAME, encode_many  # which builds on this module

    frames = [p[i : i + FRAME] for p in payloads for i in range(0, len(p), FRAME)]
    files = (f for part in _parts(frames, WRITTEN) for f in encode_many(part))
    return [b"".join(next(files) for _ in range(0, len(p), FRAME)) for p in payloads]


def to_media(payload: bytes) -> bytes:
    return to_media_many([payload])[0]


def _parts(items: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of at most 4,096 items and, where they are several, ``most`` bytes."""
    begin, size = 0, 0
    for i, x in enumerate(items):
        if i > begin and (i - begin == 1 << 12 or size + len(x) > most):
            yield items[begin:i]
            begin, size = i, 0
        size += len(x)
    if items[begin:]:
        yield items[begin:]


def files_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = int.from_bytes(media[at + 4 : at + 8], "little") + 8
        out.append(media[at : at + n])
        at += n
    return out


def payloads_of(media: Sequence[bytes]) -> list[bytes]:
    """What ``to_media_many`` stored."""
    from .webp_many import decode_many

    files = [files_of(m) for m in media]
    found = (x for part in _parts([f for own in files for f in own], READ) for x in decode_many(part))
    return [b"".join(next(found) for _ in own) for own in files]


def images(media: bytes) -> Iterator[np.ndarray]:
    for file in files_of(media):
        yield decode(file)


def feature(payload: bytes) -> str:
    """Shares of sixteen ranges of samples (in 1/255 of the greatest) and the mean sample, in hex."""
    x = np.frombuffer(payload, np.uint8)
    h = np.bincount(x >> 4, minlength=16)
    return (h * 255 // h.max()).astype(np.uint8).tobytes().hex() + format(int(x.sum(dtype=np.int64)) // len(x), "02x")


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
        media = to_media_many([x + b"\0" * (-len(x) % 64 or (0 if x else 64)) for x in data])
        yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(x) for x in data], "media": media})


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together until they have READ bytes of media."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += sum(map(len, b["media"]))
        if size >= READ:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _gathered(batches):
        out = []
        for doc, n, media, payload in zip(b["doc_id"], b["n_bytes"], b["media"], payloads_of(b["media"])):
            out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_columns(docs: DataFrame) -> DataFrame:
    """Texts written as media, stored, read back, and features of what was read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    media = stored(map_frames(docs.select("doc_id", "text"), _stored, f"doc_id {kind}, n_bytes long, media binary"), "media")
    return map_frames(media, _read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
