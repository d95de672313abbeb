"""Lossless WebP for many small images at a time: the steps of ``webp`` on numpy arrays over all images of a batch.

Writer: an image of at most 16 colours, each four times on average, gets a palette (``webp.encode_with``). All others get, in this order, green subtracted if that lowers
the entropy of red and blue; a predictor for each tile of 8 x 8 pixels, the cheapest of the fourteen; cross-colour factors for each
tile, the cheapest of FACTORS; back-references to the last place of the same four pixels; a colour cache where it is hit; and five
prefix codes, or five more from some region on where that saves bits. What is cheapest is told from the image alone, so equal images give equal files whatever else is in the batch.

Reader: one pixel of every image at each step. Files of another layout than the writer's are left to ``webp.decode``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from . import webp
from .webp import CROSS_COLOUR, DISTANCES, LENGTHS, NEAR, PALETTE, PREDICTOR, SUBTRACT_GREEN, WIDTH

#: Bytes of an image at most: 2,048 pixels; images of a batch at most: sort keys below have 11 bits for a pixel and 12 for an image.
FRAME, BATCH = 1 << 13, 1 << 12
SIDE, REGION, CACHE_BITS, MOST = 3, 4, 6, 10
TOGETHER = 1 << 16  # pixels that are transformed together
FACTORS = (0, -32, -16, 16, 32)
HITS = 4  # of the colour cache, from which on it pays
GREENS = 256 + LENGTHS
MIRROR = np.array(webp.MIRROR)
BLACK = np.array([0, 0, 0, 255], np.uint8)
LOG = np.array([0] + [round(4 * math.log2(i)) for i in range(1, 9 * FRAME)])


class Foreign(Exception):
    """A file that the writer here does not make."""


# ---- prefix codes of many rows


def firsts(rows: np.ndarray) -> np.ndarray:
    """For each entry of sorted ``rows`` the place of the first one that is equal."""
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return np.repeat(at, np.diff(np.append(at, len(rows))))


def in_use(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(table.reshape(-1) > 0), table.shape[1])


def depths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for each row; each has two counts at least. Two queues, all rows in step."""
    m = (counts > 0).sum(1)
    by_size = np.argsort(-m, kind="stable")
    counts, m = counts[by_size], m[by_size]
    rows, most = len(m), int(m[0])
    row, symbol = in_use(counts)
    order = np.argsort(row << 32 | counts[row, symbol], kind="stable")
    symbol = symbol[order]
    rank = np.arange(len(row)) - firsts(row)
    leaves = np.full((rows, most + 1), 1 << 40)
    leaves[row, rank] = counts[row, symbol]
    nodes, up = np.full((rows, most), 1 << 40), np.zeros((rows, 2 * most), np.int64)
    flat_leaves, flat_nodes, flat_up = leaves.ravel(), nodes.ravel(), up.ravel()
    each, a, b = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    over = np.searchsorted(-m, -np.arange(most + 2), "left")  # rows of more than k symbols
    for k in range(most - 1):
        n = over[k + 1]
        r, i, j, total = each[:n], a[:n], b[:n], 0
        for _ in range(2):
            x, y = flat_leaves.take(r * (most + 1) + i), flat_nodes.take(r * most + j)
            leaf = x <= y
            total = total + np.minimum(x, y)
            flat_up[r * (2 * most) + np.where(leaf, i, most + j)] = k
            i += leaf
            j += ~leaf
        nodes[:n, k] = total
    deep = np.zeros((rows, most), np.int64)
    for k in range(most - 3, -1, -1):
        n = over[k + 2]
        deep[:n, k] = deep[each[:n], up[:n, most + k]] + 1
    out = np.zeros(counts.shape, np.int64)
    out[by_size[row], symbol] = deep[row, up[row, rank]] + 1
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths for each row of counts, none over MOST."""
    m = (counts > 0).sum(1)
    out = ((counts > 0) & (m == 1)[:, None]).astype(np.int64)
    todo = np.flatnonzero(m > 1)
    counts = counts[todo]
    while len(todo):
        found = depths(counts)
        good = found.max(1) <= MOST
        out[todo[good]] = found[good]
        todo, counts = todo[~good], (counts[~good] + 1) // 2
    return out


def in_code_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, symbol and length of all codes, by row, length and symbol."""
    row, symbol = in_use(lengths)
    n = lengths[row, symbol].astype(np.int64)
    order = np.argsort(row << 4 | n, kind="stable")
    return row, symbol[order], n[order]


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    row, symbol, n = in_code_order(lengths)
    start = np.cumsum(1 << (15 - n)) - (1 << (15 - n))
    out = np.zeros(lengths.shape, np.int64)
    out[row, symbol] = MIRROR[start - start[firsts(row)]]
    return out


# ---- writer


def _head() -> int:
    """What ``webp.put_code`` writes before the lengths of a code: the fixed code of code lengths, no limit on symbols; 63 bits."""
    return 15 << 1 | sum(webp.LENGTH_BITS[s] << (5 + 3 * i) for i, s in enumerate(webp.LENGTH_ORDER))


HEAD, HEAD_BITS = _head(), 63
LENGTH_BITS, LENGTH_CODES = np.array(webp.LENGTH_BITS), np.array(webp.LENGTH_CODES)


class Parts:
    """Pieces of bits for each image, in the order in which they are added."""

    def __init__(self, images: int):
        self.images, self.owner, self.value, self.size = images, [], [], []

    def put(self, owner: np.ndarray, value: np.ndarray | int, size: np.ndarray | int) -> None:
        """At most 57 bits each, by image."""
        self.owner.append(owner)
        self.value.append(np.broadcast_to(np.asarray(value, np.int64), owner.shape))
        self.size.append(np.broadcast_to(np.asarray(size, np.int64), owner.shape))

    def files(self) -> list[bytes]:
        owner = np.concatenate(self.owner)
        order = np.argsort(owner, kind="stable")
        owner, value, size = owner[order], np.concatenate(self.value)[order].astype(np.uint64), np.concatenate(self.size)[order]
        ends = np.cumsum(size)
        begin = ends - size
        total = np.bincount(owner, size, self.images).astype(np.int64)
        words = total // 64 + 2
        base = np.cumsum(words) - words
        at = begin - begin[firsts(owner)] + base[owner] * 64
        out = np.zeros(int(words.sum()), np.uint64)
        place, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out[place[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = np.flatnonzero((at & 63) + size > 64)
        out[place[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        data = out.tobytes()
        return [webp.container(data[8 * b : 8 * b + (n + 7) // 8]) for b, n in zip(base.tolist(), total.tolist())]


def put_codes(out: Parts, owners: np.ndarray, lengths: np.ndarray, alphabets: np.ndarray) -> None:
    """Five rows of lengths for each group of codes; ``owners`` are the groups' images."""
    used = lengths > 0
    m, last = used.sum(1), lengths.shape[1] - 1 - used[:, ::-1].argmax(1)
    simple = (m == 0) | (m <= 2) & (last < 256)
    i = np.flatnonzero(simple)
    low, two = np.where(m[i] > 0, used[i].argmax(1), 0), m[i] == 2
    row, value, size = [i], [5 | two << 1 | low << 3 | np.where(two, last[i], 0) << 11], [11 + 8 * two]
    i = np.flatnonzero(~simple)
    for part, n in ((HEAD & 0xFFFFFFFF, 32), (HEAD >> 32, HEAD_BITS - 32)):
        row.append(i)
        value.append(np.full(len(i), part))
        size.append(np.full(len(i), n))
    # lengths in use and the end of each row, and the zeros before each
    r, s = in_use(used & ~simple[:, None])
    of, at, n = np.concatenate([r, i]), np.concatenate([s, alphabets[i]]), np.concatenate([lengths[r, s], np.full(len(i), -1)])
    order = np.argsort(of << 16 | at, kind="stable")
    of, at, n = of[order], at[order], n[order]
    if len(of):
        before = np.concatenate([[-1], at[:-1]])
        before[np.concatenate([[True], of[1:] != of[:-1]])] = -1
        gap = at - before - 1
        full, rest = gap // 138, gap % 138
        zeros = full + np.where(rest >= 3, 1, rest)
        number = zeros + (n >= 0)
        e = np.repeat(np.arange(len(of)), number)
        j = np.arange(len(e)) - np.repeat(np.cumsum(number) - number, number)
        run = np.where(j < full[e], 138, rest[e])
        long, short = run > 10, (run >= 3) & (run <= 10)
        k = np.where(j >= zeros[e], n[e], np.where(long, 18, np.where(short, 17, 0)))
        zero = j < zeros[e]
        extra, wide = np.where(zero & long, run - 11, np.where(zero & short, run - 3, 0)), np.where(zero & long, 7, np.where(zero & short, 3, 0))
        row.append(of[e])
        value.append(LENGTH_CODES[k] | extra << LENGTH_BITS[k])
        size.append(LENGTH_BITS[k] + wide)
    row = np.concatenate(row)
    order = np.argsort(row, kind="stable")
    out.put(owners[row[order] // 5], np.concatenate(value)[order], np.concatenate(size)[order])


def _prefixes() -> np.ndarray:
    return np.array([(0, 0, 0)] + [webp.prefix(v) for v in range(1, FRAME)])


PREFIX = _prefixes()  # symbol, extra bits, their number
NEAR_DISTANCE = np.array([max(1, (v >> 4) * WIDTH + 8 - (v & 15)) for v in NEAR])


def _distance_codes() -> np.ndarray:
    out = np.arange(FRAME // 4) + len(NEAR)
    for code in range(len(NEAR), 0, -1):
        if NEAR_DISTANCE[code - 1] < len(out):
            out[NEAR_DISTANCE[code - 1]] = code
    return out


DISTANCE_CODE = _distance_codes()


def put_image(out: Parts, owners: np.ndarray, group: np.ndarray, pixels: np.ndarray, cached: np.ndarray | None = None,
              slots: np.ndarray | None = None, length: np.ndarray | None = None, distance: np.ndarray | None = None) -> None:
    """Codes and tokens. ``owners`` are the images of the groups of codes. A token has its group, its pixel (RGBA), its slot (-1: not
    from the cache), its length (0: no reference) and distance; ``cached`` tells which groups have a cache."""
    n = len(owners)
    greens = np.full(n, GREENS) if cached is None else np.where(cached, GREENS + (1 << CACHE_BITS), GREENS)
    width = int(greens.max())
    green, literal = pixels[:, 1].astype(np.int64), np.ones(len(group), bool)
    refs = np.zeros(0, np.int64)
    if cached is not None:
        refs = np.flatnonzero(length)
        literal = (length == 0) & (slots < 0)
        green = np.where(length > 0, 256 + PREFIX[length, 0], np.where(slots >= 0, GREENS + slots, green))
    lit = np.flatnonzero(literal)
    far = PREFIX[DISTANCE_CODE[distance[refs]]] if len(refs) else np.zeros((0, 3), np.int64)
    row = group * (5 * width)
    places = [row + green] + [row[lit] + k * width + pixels[lit, c] for k, c in ((1, 0), (2, 2), (3, 3))] + [row[refs] + 4 * width + far[:, 0]]
    counts = np.bincount(np.concatenate(places), minlength=n * 5 * width).reshape(-1, width)
    lengths = code_lengths(counts)
    put_codes(out, owners, lengths, np.stack([greens, *[np.full(n, 256)] * 3, np.full(n, DISTANCES)], 1).ravel())
    codes = reversed_codes(lengths).ravel()
    bits = np.where(((counts > 0).sum(1) < 2)[:, None], 0, lengths).ravel()
    value, size = codes[places[0]], bits[places[0]]
    if len(refs):
        run = PREFIX[length[refs]]
        for v, s in ((run[:, 1], run[:, 2]), (codes[places[4]], bits[places[4]]), (far[:, 1], far[:, 2])):
            value[refs] |= v << size[refs]
            size[refs] += s
    v, s = value[lit], size[lit]
    for p in places[1:4]:
        v |= codes[p] << s
        s += bits[p]
    value[lit], size[lit] = v, s
    out.put(owners[group], value, size)


def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def prediction(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray, axis: int = 0) -> np.ndarray:
    """Of arrays of bytes, the channels along an axis (first or last)."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode in (11, 12):
        a, b, c = left.astype(np.int16), top.astype(np.int16), corner.astype(np.int16)
        if mode == 12:
            return np.clip(a + b - c, 0, 255).astype(np.uint8)
        nearer = np.abs(b - c).sum(axis, dtype=np.int16, keepdims=True) < np.abs(a - c).sum(axis, dtype=np.int16, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 13:
        a = half(left, top).astype(np.int16)
        d = a - corner
        return np.clip(a + ((d + (d < 0)) >> 1), 0, 255).astype(np.uint8)
    return np.broadcast_to(BLACK if axis else BLACK[:, None], top.shape)


class Layout:
    """Where the rows and tiles of images of WIDTH columns, one below the other, begin."""

    def __init__(self, heights: np.ndarray):
        self.n, self.heights, self.pixels = len(heights), heights, heights * WIDTH
        self.begin = np.cumsum(self.pixels) - self.pixels
        self.image = np.repeat(np.arange(self.n), self.pixels)
        self.tile_rows = -(-heights >> SIDE)
        self.tile_begin = np.cumsum(self.tile_rows) - self.tile_rows
        row = np.arange(int(heights.sum())) - np.repeat(self.begin // WIDTH, heights)
        self.tile_starts = np.flatnonzero(row % (1 << SIDE) == 0)
        self.across = WIDTH >> SIDE
        tile_row = np.repeat(self.tile_begin, heights) + (row >> SIDE)
        self.tile = (tile_row[:, None] * self.across + np.repeat(np.arange(self.across), 1 << SIDE)).ravel()
        self.tile_image = np.repeat(np.arange(self.n), self.tile_rows * self.across)

    def by_tile(self, cost: np.ndarray) -> np.ndarray:
        for _ in range(SIDE):
            cost = np.add(cost[::2], cost[1::2], dtype=np.uint16)
        cost = cost.reshape(-1, self.across)
        return np.stack([np.add.reduceat(cost[:, k], self.tile_starts, dtype=np.int32) for k in range(self.across)], 1).ravel()


class Prices:
    """Prices of bytes in quarters of a bit, by what their image has, with some weight on small values."""

    def __init__(self, layout: Layout, planes: np.ndarray):
        at = layout.image << 8
        counts = sum(np.bincount(at + x, minlength=layout.n << 8) for x in planes).reshape(-1, 256)
        weights = 4 * counts + 1
        n = layout.pixels * len(planes)
        weights[:, 0] += n // 2
        weights[:, [1, 2, 254, 255]] += (n // 8)[:, None]
        table = (LOG[weights.sum(1)][:, None] - LOG[weights]).astype(np.uint8)  # 54 at most
        begin = layout.begin.tolist()
        ends = (layout.begin + layout.pixels).tolist()
        self.cuts = list(zip(begin, ends, map(bytes, table)))
        # alpha without a predictor is one more than it was
        self.shifted = list(zip(begin, ends, map(bytes, np.roll(table, 1, axis=1))))

    def of(self, plane: np.ndarray, alpha: bool = False) -> np.ndarray:
        data = plane.tobytes()
        return np.frombuffer(b"".join([data[a:b].translate(t) for a, b, t in (self.shifted if alpha else self.cuts)]), np.uint8)


def entropy(layout: Layout, channel: np.ndarray) -> np.ndarray:
    counts = np.bincount(layout.image << 8 | channel, minlength=layout.n << 8).reshape(-1, 256)
    return layout.pixels * LOG[layout.pixels] - (counts * LOG[counts]).sum(1)


def predicted(layout: Layout, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the predictors leave, and the predictor of each tile. Pixels are four planes here."""
    n = at.shape[1]
    border = np.concatenate([np.repeat(BLACK[:, None], WIDTH + 1, 1), at], 1)
    left, top, right, corner = (border[:, WIDTH + 1 - d : WIDTH + 1 - d + n] for d in (1, WIDTH, WIDTH - 1, WIDTH + 1))
    edge = np.arange(n) % WIDTH == 0
    row = (layout.begin[:, None] + np.arange(WIDTH)).ravel()
    edge[row] = True
    edge = np.flatnonzero(edge)
    fixed = top.copy()
    fixed[:, row] = left[:, row]
    fixed[:, layout.begin] = BLACK[:, None]
    prices = Prices(layout, at)
    best, mode, rest = None, np.zeros(int(layout.tile_rows.sum()) * layout.across, np.int64), None
    for k in range(14):
        left_over = at - prediction(k, left, top, right, corner)
        cost = prices.of(left_over[0]) + prices.of(left_over[1]) + prices.of(left_over[2]) + prices.of(left_over[3], True)
        cost[edge] = 0
        cost = layout.by_tile(cost)
        if best is None:
            best, rest = cost, left_over
            continue
        better = cost < best
        if better.any():
            best, mode = np.where(better, cost, best), np.where(better, k, mode)
            i = np.flatnonzero(better[layout.tile])
            rest[:, i] = left_over[:, i]
    rest[:, edge] = at[:, edge] - fixed[:, edge]
    return rest, mode


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).astype(np.uint8).view(np.int8).astype(np.int16)


def crossed(layout: Layout, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What cross-colour leaves of four planes, and the factors of each tile: blue by red, blue by green, red by green."""
    out = at.copy()
    red, green = signed(at[0]), signed(at[1])
    prices = Prices(layout, at[[0, 2]])
    factors = np.zeros((int(layout.tile_rows.sum()) * layout.across, 3), np.int64)
    for slot, source, channel in ((2, green, 0), (1, green, 2), (0, red, 2)):
        best, given = None, out[channel].copy()
        for f in FACTORS:
            left_over = given - (f * source >> 5).astype(np.uint8) if f else given
            cost = layout.by_tile(prices.of(left_over))
            if best is None:
                best = cost
                continue
            better = cost < best
            if better.any():
                best, factors[:, slot] = np.where(better, cost, best), np.where(better, f, factors[:, slot])
                i = np.flatnonzero(better[layout.tile])
                out[channel, i] = left_over[i]
    return out, factors


def argb(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.int64)
    return p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]


def slots_of(colour: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    return (webp.CACHE_FACTOR * colour & 0xFFFFFFFF) >> (32 - bits)


def references(layout: Layout, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: none) and distance of the back-reference that begins at each pixel, -1 within one."""
    n = len(colour)
    length, distance = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    local = np.arange(n) - layout.begin[layout.image]
    i = np.flatnonzero(local + 4 <= layout.pixels[layout.image])
    c = colour.astype(np.uint64)
    mixed = np.zeros(len(i), np.uint64)
    for k in range(4):
        mixed = (mixed ^ c[i + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    key = np.sort(layout.image[i].astype(np.uint64) << np.uint64(52) | mixed >> np.uint64(23) << np.uint64(11) | local[i].astype(np.uint64))
    same = np.flatnonzero(key[1:] >> np.uint64(11) == key[:-1] >> np.uint64(11))
    at, begin = (key & np.uint64(2047)).astype(np.int64), layout.begin[(key >> np.uint64(52)).astype(np.int64)]
    here, there = begin[same + 1] + at[same + 1], begin[same] + at[same]
    equal = np.ones(len(here), bool)
    for k in range(4):
        equal &= colour[here + k] == colour[there + k]
    distance[here[equal]] = (here - there)[equal]
    before = np.concatenate([[0], distance[:-1]])
    start = np.flatnonzero((distance > 0) & (distance != before))
    end = np.flatnonzero((before > 0) & (distance != before)) + 3
    d = distance[start]
    begin = np.maximum(start, np.concatenate([[0], end[:-1]]))
    good = end - begin >= 3
    begin, end, d = begin[good], end[good], d[good]
    inside = np.zeros(n + 1, np.int64)
    inside[begin] += 1
    inside[end] -= 1
    length[np.cumsum(inside)[:n] > 0] = -1
    length[begin] = end - begin
    distance[:] = 0
    distance[begin] = d
    return length, distance[:n]


def cache_hits(layout: Layout, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each pixel, and whether the last pixel of that slot was equal."""
    slot = slots_of(colour, CACHE_BITS)
    local = np.arange(len(colour)) - layout.begin[layout.image]
    key = np.sort(layout.image << 17 | slot << 11 | local)
    at = layout.begin[key >> 17] + (key & 2047)
    hit = np.zeros(len(colour), bool)
    hit[at[1:]] = (key[1:] >> 11 == key[:-1] >> 11) & (colour[at[1:]] == colour[at[:-1]])
    return slot, hit


def encode_many(payloads: Sequence[bytes]) -> list[bytes]:
    """A file for each payload of 64 to FRAME bytes, a multiple of 64; at most BATCH of them."""
    out: list[bytes] = [b""] * len(payloads)
    if not out:
        return out
    layout = Layout(np.array([len(p) // (4 * WIDTH) for p in payloads], np.int64))
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 4)
    key = np.sort(layout.image << 32 | argb(pixels))
    colours = np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] >> 32, minlength=layout.n)
    few = (colours <= 16) & (4 * colours <= layout.pixels)
    for i in np.flatnonzero(few).tolist():
        out[i] = webp.encode_with(np.frombuffer(payloads[i], np.uint8).reshape(-1, WIDTH, 4), (PALETTE,), 0, True)
    others = np.flatnonzero(~few)
    if not len(others):
        return out
    if len(others) < len(few):
        pixels = pixels[~few[layout.image]]
        layout = Layout(layout.heights[others])
    for i, file in zip(others.tolist(), written(layout, pixels)):
        out[i] = file
    return out


def cuts(layout: Layout, planes: np.ndarray) -> np.ndarray:
    """Where an image's second group of codes begins, in regions of 2 ** REGION rows; 0 where it saves less than it takes to write."""
    regions = -(-layout.heights >> REGION)
    first = np.cumsum(regions) - regions
    row = (np.arange(len(layout.image)) - layout.begin[layout.image]) // WIDTH
    at = (first[layout.image] + (row >> REGION)) << 8
    counts = sum(np.bincount(at + x, minlength=int(regions.sum()) << 8) for x in planes).reshape(-1, 256)
    total = np.add.reduceat(counts, first)
    image = np.repeat(np.arange(layout.n), regions)
    before = np.cumsum(counts, axis=0) - counts
    before -= before[first][image]

    def cost(counts: np.ndarray) -> np.ndarray:
        n = counts.sum(1)
        return n * LOG[n] - (counts * LOG[counts]).sum(1)

    # lengths of a code take some seven bits for each symbol and HEAD_BITS, in each of four channels
    saved = cost(total)[image] - cost(before) - cost(total[image] - before) - 16 * (HEAD_BITS + 7 * (total > 0).sum(1))[image]
    saved[first] = 0
    best = np.maximum.reduceat(saved, first)
    place = np.arange(len(image)) - first[image]
    place = np.where((saved == best[image]) & (best[image] > 0), place, len(image))
    return np.where(best > 0, np.minimum.reduceat(place, first), 0)


def transformed(layout: Layout, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which images have green subtracted, their pixels after all transforms, predictors and factors of the tiles, and the
    regions from which on they have a second group of codes."""
    red, green, blue = at[0], at[1], at[2]
    less = entropy(layout, red - green) + entropy(layout, blue - green) < entropy(layout, red) + entropy(layout, blue)
    i = np.flatnonzero(less[layout.image])
    at[0, i] -= at[1, i]
    at[2, i] -= at[1, i]
    at, modes = predicted(layout, at)
    at, factors = crossed(layout, at)
    return less, np.ascontiguousarray(at.T), modes, factors, cuts(layout, at)


def put_tiles(out: Parts, layout: Layout, tiles: np.ndarray) -> None:
    """The image of a transform. Where all tiles are equal, it is five codes of a single symbol."""
    number = layout.tile_rows * layout.across
    begin = np.cumsum(number) - number
    mixed = np.bitwise_or.reduceat((tiles != tiles[begin][layout.tile_image]).any(1), begin)
    i = np.flatnonzero(~mixed)
    red, green, blue, alpha = tiles[begin[i]].T.astype(np.int64)
    out.put(i, sum((5 | x << 3) << (11 * k) for k, x in enumerate((green, red, blue, alpha, 0))), 55)
    i = np.flatnonzero(mixed)
    if len(i):
        place = np.flatnonzero(mixed[layout.tile_image])
        put_image(out, i, np.searchsorted(i, layout.tile_image[place]), tiles[place])


def written(layout: Layout, pixels: np.ndarray) -> list[bytes]:
    """Files of images other than those with a palette."""
    out, each = Parts(layout.n), np.arange(layout.n)
    out.put(each, 0x2F | (WIDTH - 1) << 8 | (layout.heights - 1) << 22 | 1 << 36, 40)
    parts, begin = [], 0
    while begin < layout.n:
        end = max(begin + 1, int(np.searchsorted(layout.begin, layout.begin[begin] + TOGETHER)))
        first = layout.begin[begin]
        part = Layout(layout.heights[begin:end])
        parts.append(transformed(part, np.ascontiguousarray(pixels[first : first + len(part.image)].T)))
        begin = end
    less, at, modes, factors, cut = (np.concatenate(x) for x in zip(*parts))
    out.put(each[less], 1 | SUBTRACT_GREEN << 1, 3)
    for kind in (PREDICTOR, CROSS_COLOUR):
        out.put(each, 1 | kind << 1 | (SIDE - 2) << 3, 7)  # and no cache
        tiles = np.tile(BLACK, (len(modes), 1))
        if kind == PREDICTOR:
            tiles[:, 1] = modes
        else:
            tiles[:, :3] = factors & 255
        put_tiles(out, layout, tiles)
    colour = argb(at)
    length, distance = references(layout, colour)
    slot, hit = cache_hits(layout, colour)
    token = np.flatnonzero(length >= 0)
    image = layout.image[token]
    hit = hit[token] & (length[token] == 0)
    cached = np.bincount(image, hit, layout.n) >= HITS
    # no more transforms; the cache; one group, or two and which region has which
    out.put(each, np.where(cached, 1 << 1 | CACHE_BITS << 2, 0) | np.where(cached, 1 << 6, 1 << 2) * (cut > 0), np.where(cached, 7, 3))
    split = np.flatnonzero(cut)
    if len(split):
        out.put(split, REGION - 2, 4)  # and no cache
        regions = -(-layout.heights[split] >> REGION)
        of = np.repeat(np.arange(len(split)), regions)
        board = np.tile(BLACK, (len(of), 1))
        board[:, 1] = np.arange(len(of)) - firsts(of) >= cut[split][of]
        put_image(out, split, of, board)
    groups = 1 + (cut > 0)
    owners = np.repeat(each, groups)
    row = (token - layout.begin[image]) // WIDTH
    group = (np.cumsum(groups) - groups)[image] + ((cut[image] > 0) & (row >> REGION >= cut[image]))
    put_image(out, owners, group, at[token], cached[owners], np.where(hit & cached[image], slot[token], -1), length[token], distance[token])
    return out.files()


# ---- reader


class Window:
    """57 bits or more from any place on, of all files."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + b"\0" * 16, np.uint8)
        self.words = np.ndarray((len(data) + 8,), "<i8", padded, strides=(1,)).copy()

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.words.take(place >> 3, mode="clip") >> (place & 7)


def _length_table() -> np.ndarray:
    out = np.zeros(32, np.int64)
    for s, (n, c) in enumerate(zip(webp.LENGTH_BITS, webp.LENGTH_CODES)):
        out[c :: 1 << n] = n + 16 * s
    return out


LENGTH_TABLE = _length_table()
RUN, RUN_BITS = np.array([1] * 16 + [3, 3, 11]), np.array([0] * 16 + [2, 3, 7])
EXTRA = np.array([0, 0, 0, 0] + [(s - 2) >> 1 for s in range(4, DISTANCES)])
LEAST = np.array([1, 2, 3, 4] + [((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(4, DISTANCES)])


def read_codes(window: Window, place: np.ndarray, alphabets: Sequence[np.ndarray]) -> np.ndarray:
    """Lengths (images, 5, symbols); ``place`` moves on."""
    n, wide = len(place), max(256, int(max(a.max() for a in alphabets)))
    stride = wide + 140
    out = np.zeros((n, 5, stride), np.uint8)
    flat = out.reshape(-1)
    for kind, alphabet in enumerate(alphabets):
        w = window.at(place)
        i, j = np.flatnonzero(w & 1), np.flatnonzero(w & 1 == 0)
        if not (w[i] >> 2 & 1).all():
            raise Foreign
        two = w[i] >> 1 & 1
        out[i, kind, w[i] >> 3 & 255] = 1
        k = np.flatnonzero(two)
        out[i[k], kind, w[i[k]] >> 11 & 255] = 1
        place[i] += 11 + 8 * two
        if not len(j):
            continue
        if ((w[j] & 0xFFFFFFFF) != HEAD & 0xFFFFFFFF).any() or ((window.at(place[j] + 32) & 0x7FFFFFFF) != HEAD >> 32).any():
            raise Foreign
        p, row, end = place[j] + HEAD_BITS, (j * 5 + kind) * stride, alphabet[j]
        end = row + end
        while len(j):
            w = window.at(p)
            e = LENGTH_TABLE[w & 31]
            s, size = e >> 4, e & 15
            if (s == 16).any():
                raise Foreign
            extra = RUN_BITS[s]
            flat[row] = np.where(s < 16, s, 0)
            row = row + RUN[s] + (w >> size & ((1 << extra) - 1))
            p += size + extra
            if (row >= end).any():
                if (row > end).any():
                    raise ValueError("too many code lengths")
                place[j[row == end]] = p[row == end]
                more = row < end
                j, p, row, end = j[more], p[more], row[more], end[more]
    return out[:, :, :wide]


def tables(lengths: np.ndarray) -> tuple[int, np.ndarray]:
    """The bits of a look-up and, for each row, its length + 16 * symbol by the first bits as a number, first bit highest."""
    row, symbol, n = in_code_order(lengths)
    bits = int(n.max())
    if bits > 14:
        raise Foreign
    number = np.bincount(row, minlength=len(lengths))
    alone = number[row] == 1
    share = np.where(alone, 1 << bits, 1 << (bits - n))
    if (np.bincount(row, share, len(lengths)) != 1 << bits).any():
        raise ValueError("incomplete prefix code")
    return bits, np.repeat((symbol << 4 | np.where(alone, 0, n)).astype(np.uint16), share)


def read_pixels(window: Window, place: np.ndarray, totals: np.ndarray, cache_bits: np.ndarray, refers: bool,
                groups: np.ndarray | None = None, regions: np.ndarray | None = None, board: np.ndarray | None = None) -> np.ndarray:
    """Codes and tokens of images; the pixels as numbers, one image after another. ``place`` moves on. ``groups`` are the numbers of
    groups of codes, ``regions`` where an image's regions begin in ``board``, which has their groups."""
    n = len(totals)
    sizes = np.where(cache_bits > 0, 1 << cache_bits, 0)
    if groups is None:
        groups = np.ones(n, np.int64)
    group_at = np.cumsum(groups) - groups
    codes = np.zeros((int(groups.sum()), 5, GREENS + int(sizes.max())), np.uint8)
    for g in range(int(groups.max())):
        i = np.flatnonzero(groups > g)
        p, m = place[i], len(i)
        found = read_codes(window, p, [GREENS + sizes[i], *[np.full(m, 256)] * 3, np.full(m, DISTANCES)])
        codes[group_at[i] + g, :, : found.shape[2]] = found
        place[i] = p
    bits, table = tables(codes.reshape(5 * len(codes), -1))
    mirror, mask = MIRROR[: 1 << bits] >> (15 - bits), (1 << bits) - 1
    end = np.cumsum(totals)
    out = np.zeros(int(totals.sum()), np.int64)
    first = end - totals
    stride = int(sizes.max())
    caches, cache_at, shift = np.zeros(n * stride, np.int64), np.arange(n) * stride, 32 - np.maximum(cache_bits, 1)
    image, q, p = np.arange(n), first.copy(), place.copy()
    bases = [(group_at * 5 + k) << bits for k in range(5)]
    words = window.words
    split = np.flatnonzero(groups > 1)
    while len(image):
        # one token of each image
        if len(split):
            i = image[split]
            group = group_at[i] + board[regions[i] + ((q[split] - first[split]) // WIDTH >> REGION)]
            for k in range(5):
                bases[k][split] = (group * 5 + k) << bits
        w = words.take(p >> 3, mode="clip") >> (p & 7)
        green = table.take(bases[0] + mirror.take(w & mask)).astype(np.int64)
        symbol, moved = green >> 4, green & 15
        v, pixel = w >> moved, symbol << 8
        for k, up in ((1, 16), (2, 0), (3, 24)):
            e = table.take(bases[k] + mirror.take(v & mask)).astype(np.int64)
            size = e & 15
            v >>= size
            moved += size
            e >>= 4
            e <<= up
            pixel |= e
        special = (symbol > 255).nonzero()[0]
        if len(special):
            s, size = symbol[special], green[special] & 15
            moved[special] = size
            hit = s >= GREENS
            i = special[hit]
            pixel[i] = caches[cache_at[i] + s[hit] - GREENS] if stride else 0
            if len(i) < len(special):
                if not refers:
                    raise Foreign
                i = special[~hit]
                s, size = s[~hit] - 256, size[~hit]
                v = w[i] >> size
                extra = EXTRA[s]
                length = LEAST[s] + (v & ((1 << extra) - 1))
                v >>= extra
                e = table.take(bases[4][i] + mirror.take(v & mask)).astype(np.int64)
                v, far = v >> (e & 15), e >> 4
                if (far >= DISTANCES).any():
                    raise ValueError("bad distance")
                d = LEAST[far] + (v & ((1 << EXTRA[far]) - 1))
                d = np.where(d > len(NEAR), d - len(NEAR), NEAR_DISTANCE[np.minimum(d, len(NEAR)) - 1])
                at = q[i]
                if (at - d < first[i]).any() or (at + length > end[i]).any():
                    raise ValueError("a back-reference leaves the image")
                moved[i] += extra + (e & 15) + EXTRA[far]
                each = np.repeat(np.arange(len(i)), length)
                inner = np.arange(len(each)) - np.repeat(np.cumsum(length) - length, length)
                copied = out[(at - d)[each] + inner % d[each]]
                out[at[each] + inner] = copied
                if stride:  # of several in a slot the last stays
                    caches[cache_at[i][each] + slots_of(copied, 32 - shift[i][each])] = copied
                pixel[i] = copied[np.cumsum(length) - 1]
                q[i] += length - 1
        out[q] = pixel
        if stride:
            caches[cache_at + ((webp.CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift)] = pixel
        q += 1
        p += moved
        done = q == end
        if done.any():
            place[image[done]] = p[done]
            more = (~done).nonzero()[0]
            image, p, q, end, first, cache_at, shift, *bases = (x[more] for x in (image, p, q, end, first, cache_at, shift, *bases))
            split = np.flatnonzero(groups[image] > 1) if len(split) else split
    return out


def as_bytes(colour: np.ndarray) -> np.ndarray:
    return np.stack([colour >> 16, colour >> 8, colour, colour >> 24], 1).astype(np.uint8)


def unpredicted(layout: Layout, at: np.ndarray, modes: np.ndarray) -> None:
    """Adds the predictions to ``at``, one row of all images at a time; pixel by pixel only where the predictor looks left."""
    order = np.argsort(-layout.heights, kind="stable")
    begin, first_tile = layout.begin[order], layout.tile_begin[order] * layout.across
    row = begin[:, None] + np.arange(WIDTH)
    top = at[row]
    top[:, 0] += BLACK
    at[row] = np.cumsum(top, axis=1, dtype=np.uint8)
    going = np.searchsorted(-layout.heights[order], -np.arange(int(layout.heights.max())), "left")
    side = 1 << SIDE
    # what needs no other pixel
    plain = (modes == 0)[layout.tile]
    plain[::WIDTH] = False
    plain[row.ravel()] = False
    at[:, 3] -= plain
    for y, m in enumerate(going.tolist()):
        if not y:
            continue
        base = begin[:m] + WIDTH * y
        at[base] += at[base - WIDTH]
        for x in range(0, WIDTH, side):
            mode = modes[first_tile[:m] + (y >> SIDE) * layout.across + (x >> SIDE)]
            if not mode.any():
                continue
            for k in np.flatnonzero(np.bincount(mode)).tolist():
                if not k:
                    continue
                of = base[mode == k]
                start = max(x, 1)
                if k in (2, 3, 4, 8, 9) or k > 13:
                    steps = [of[:, None] + np.arange(start, x + side)]
                else:
                    steps = [of + i for i in range(start, x + side)]
                for i in steps:
                    at[i] += prediction(k, at[i - 1], at[i - WIDTH], at[i - WIDTH + 1], at[i - WIDTH - 1], -1)


def decode_many(files: Sequence[bytes]) -> list[bytes]:
    """The RGBA bytes of each file; at most BATCH of them at a time."""
    out: list[bytes] = [b""] * len(files)
    data = b"".join(files)
    sizes = np.array([len(f) for f in files], np.int64)
    start = np.cumsum(sizes) - sizes
    window, place = Window(data), (start + 20) * 8
    known = np.array([f[:4] == b"RIFF" and f[8:16] == b"WEBPVP8L" for f in files], bool)
    w = window.at(place)
    known &= (w & ((1 << 22) - 1) == (0x2F | (WIDTH - 1) << 8)) & (w >> 37 & 7 == 0)
    heights = (w >> 22 & ((1 << 14) - 1)) + 1
    known &= heights <= FRAME // (4 * WIDTH)
    place += 40
    green = window.at(place) & 7 == (1 | SUBTRACT_GREEN << 1)
    place += 3 * green
    known &= window.at(place) & 127 == (1 | PREDICTOR << 1 | (SIDE - 2) << 3)
    i = np.flatnonzero(known)
    if len(i):
        ends = (start + 20 + np.array([int.from_bytes(f[16:20], "little") if len(f) >= 20 else 0 for f in files])) * 8
        try:
            for k, x in zip(i.tolist(), _read(window, place[i], heights[i], green[i], np.minimum(ends, (start + sizes) * 8)[i])):
                out[k] = x
        except Foreign:
            known[:] = False
    for k in np.flatnonzero(~known).tolist():
        out[k] = webp.decode(files[k]).tobytes()
    return out


def _read(window: Window, place: np.ndarray, heights: np.ndarray, green: np.ndarray, ends: np.ndarray) -> list[bytes]:
    layout = Layout(heights)
    none = np.zeros(layout.n, np.int64)
    tiles = []
    for kind in (PREDICTOR, CROSS_COLOUR):
        if (window.at(place) & 127 != (1 | kind << 1 | (SIDE - 2) << 3)).any():
            raise Foreign
        place += 7
        tiles.append(as_bytes(read_pixels(window, place, layout.tile_rows * layout.across, none, False)))
    w = window.at(place)
    if (w & 1).any():
        raise Foreign
    bits = np.where(w >> 1 & 1, w >> 2 & 15, 0)
    if ((bits == 0) & (w >> 1 & 1 > 0) | (bits > 11)).any():
        raise ValueError("bad size of the colour cache")
    place += np.where(bits > 0, 6, 2)
    split = np.flatnonzero(window.at(place) & 1)
    place += 1
    groups, regions, board = np.ones(layout.n, np.int64), none, none
    if len(split):
        if (window.at(place[split]) & 15 != REGION - 2).any():
            raise Foreign
        p, number = place[split] + 4, -(-heights[split] >> REGION)
        board = read_pixels(window, p, number, none[: len(split)], False) >> 8 & 0xFFFF
        place[split] = p
        regions = none.copy()
        regions[split] = np.cumsum(number) - number
        groups[split] = np.maximum.reduceat(board, regions[split]) + 1
        if groups.max() > 2:
            raise Foreign
    at = as_bytes(read_pixels(window, place, layout.pixels, bits, True, groups, regions, board))
    if (place > ends).any():
        raise ValueError("the file ends early")
    factors = tiles[1].view(np.int8).astype(np.int16)[layout.tile]
    source = signed(at[:, 1])
    at[:, 0] += (factors[:, 2] * source >> 5).astype(np.uint8)
    at[:, 2] += (factors[:, 1] * source >> 5).astype(np.uint8) + (factors[:, 0] * signed(at[:, 0]) >> 5).astype(np.uint8)
    unpredicted(layout, at, tiles[0][:, 1].astype(np.int64))
    i = np.flatnonzero(green[layout.image])
    at[i, 0] += at[i, 1]
    at[i, 2] += at[i, 1]
    data = at.tobytes()
    return [data[4 * b : 4 * (b + n)] for b, n in zip(layout.begin.tolist(), layout.pixels.tolist())]
