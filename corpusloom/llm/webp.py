"""Media columns: lossless WebP images written and read with numpy and short loops.

A payload is stored as the green samples of an image. The reader decodes prefix codes, back-references
and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms in any order and with
any block sizes; the writer can produce all of these and picks by the pixels: a palette where few values occur, the
colour cache where it would often hit, copies wherever pixels repeat. For a payload, predictor modes and cache sizes whose
entropy is estimated lower are tried, and the smallest file stays; red and blue are constant, so that subtract-green and
cross-colour can only add to them.

Results for odd input: null and empty texts are 64 zero bytes; equal texts give equal files; texts too long for the
narrowest image get a wider one, whose last row is filled with zeros that reading drops; the reader looks up a stretch of
the stream at a time, so that a long text takes some dozens of bytes a byte; texts over 256 MB, which no image holds, are an
error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: offsets (columns left, rows up) of the 120 near distances.
NEAR = """
0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0
1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2
4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3
0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5
8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7
"""
# Fixed values of the format: the order of the code length code, the cache's multiplier, the alphabets' sizes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: Extra bits and least count of the length symbols that repeat: the last length, or zeros.
EXTRA = {16: (2, 3), 17: (3, 3), 18: (7, 11)}
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
MAX_SIDE = 1 << 14
MAX_COPY = 4096
#: To the powers of 1, 2, 4, 8, ..., as 64 bits hold them.
KEY_POWERS = np.array([pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(8)], np.uint64).view(np.int64)
#: Pixels that a copy has at least, in general and in a payload of one sample a pixel.
LEAST_COPY, LEAST_RUN = 3, 12
#: Samples from which entropies are estimated, sizes of the cache that are, and bits a sample that must seem saved for a try.
ESTIMATED, CACHES, LEAST_SAVED = 512, (1, 2, 4, 6, 8), 0.1
#: Pixels from which an image of one code group is read with all bits looked up at once.
AHEAD = 128
#: Bytes of a stream whose bits are looked up at once.
STRETCH = 1 << 16


#: What a task has worked out so far; plain dicts, which travel to the tasks by value with the functions.
NEAR_DISTANCES: dict[int, tuple[int, ...]] = {}
NEAR_CODES: dict[int, dict[int, int]] = {}
REVERSALS: dict[int, np.ndarray] = {}


def near_distances(width: int) -> tuple[int, ...]:
    if width not in NEAR_DISTANCES:
        NEAR_DISTANCES[width] = tuple(max(1, int(x) + int(y) * width) for x, y in (p.split(",") for p in NEAR.split()))
    return NEAR_DISTANCES[width]


def near_codes(width: int) -> dict[int, int]:
    """The lowest code of each near distance."""
    if width not in NEAR_CODES:
        NEAR_CODES[width] = {d: k + 1 for k, d in reversed(list(enumerate(near_distances(width))))}
    return NEAR_CODES[width]


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code for these counts, none above the limit; a lone symbol has length 1."""
    out = np.zeros(len(counts), np.int64)
    symbols = counts.nonzero()[0].tolist()
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    weights = counts[symbols].tolist()
    while True:
        heap = list(zip(weights, range(len(symbols))))
        heapq.heapify(heap)
        parent = [0] * (2 * len(symbols) - 1)
        new = len(symbols)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * new
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= limit:
            out[symbols] = depth[: len(symbols)]
            return out
        weights = [(w + 1) // 2 for w in weights]


def reversal(bits: int) -> np.ndarray:
    """Each number below 2^bits with its bits in reverse."""
    if bits not in REVERSALS:
        out = np.zeros(1, np.int64)
        for _ in range(bits):
            out = np.concatenate([out * 2, out * 2 + 1])
        REVERSALS[bits] = out
    return REVERSALS[bits]


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    most = int(lengths.max(initial=0))
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    span = 1 << (most - lengths[order])
    first = np.cumsum(span) - span  # in units of the longest code
    out[order] = reversal(most)[first] if most else 0
    return out


class Table:
    """Decodes one symbol: entry (symbol << 4 | length) at the next `bits` bits."""

    __slots__ = ("bits", "entries", "mask")

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            self.bits, self.mask, self.entries = 0, 0, [int(used[0]) << 4]
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        most = int(lengths[order[-1]]) if len(order) else 0
        filled = np.repeat((order << 4) | lengths[order], 1 << (most - lengths[order]))
        if len(filled) != 1 << most:
            raise ValueError("incomplete prefix code")
        entries = np.empty(len(filled), np.int64)
        entries[reversal(most)] = filled
        self.bits, self.mask, self.entries = most, (1 << most) - 1, memoryview(entries)


# ---------------------------------------------------------------- bits


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)

    def symbol(self, table: Table) -> int:
        at = self.at
        e = table.entries[(int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & table.mask]
        self.at = at + (e & 15)
        return e >> 4


class Writer:
    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.small: list[tuple[int, int]] = []

    def write(self, value: int, n: int) -> None:
        self.small.append((value, n))

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.small:
            pairs = np.array(self.small, np.int64)
            self.values.append(pairs[:, 0])
            self.sizes.append(pairs[:, 1])
            self.small = []
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self.extend(np.empty(0, np.int64), np.empty(0, np.int64))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        start = ends - sizes
        # Lanes of 16 bits: what begins in a lane has no bit in common and takes at most 16 + 28 bits, so that its sum in doubles is exact.
        lanes = np.bincount(start >> 4, (values & (1 << sizes) - 1) << (start & 15), (total >> 4) + 3).astype(np.int64)
        out = lanes & 0xFFFF
        out[1:] += lanes[:-1] >> 16 & 0xFFFF
        out[2:] += lanes[:-2] >> 32
        return out.astype("<u2").tobytes()[: total + 7 >> 3]


# ---------------------------------------------------------------- reading


def read_lengths(r: Reader, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int64)
    if r.read(1):
        two = r.read(1)
        lengths[r.read(8 if r.read(1) else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return lengths
    inner = np.zeros(19, np.int64)
    for k in range(4 + r.read(4)):
        inner[LENGTH_ORDER[k]] = r.read(3)
    table = Table(inner)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    out: list[int] = []
    last = 8
    data, at, entries, mask = r.data, r.at, table.entries, table.mask
    while len(out) < size and left:
        left -= 1
        w = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        e = entries[w & mask]
        at += e & 15
        s = e >> 4
        if s < 16:
            out.append(s)
            if s:
                last = s
        else:
            bits, least = EXTRA[s]
            out += [last if s == 16 else 0] * (least + ((w >> (e & 15)) & ((1 << bits) - 1)))
            at += bits
    r.at = at
    lengths[: len(out)] = out[:size]
    return lengths


def spread(symbol: int, r: Reader) -> int:
    """The value of a length or distance symbol and its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def literals_ahead(data: bytes, at: int, group: list[Table]) -> tuple:
    """Of the literal pixels in a stream: (the pixels at given bits, the bits where eight pixels begin from the first's, and for each bit the bit after the
    one or eight pixels that begin there, or 0 if there are none). No pixel may begin at bit 0.

    All bits of a stretch of the stream are looked up at once, whether a pixel begins there or not; walking from bit to bit is
    then short.
    """
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    bits = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel().astype(np.int64)
    end = len(bits) - 64
    place = np.arange(max(end, 0))
    fixed, varied = 0, []  # fields of one value, and those of several with their shifts
    literal, first = True, True
    for shift, table in zip((8, 16, 0, 24), group):
        if not table.mask:
            fixed |= (table.entries[0] >> 4 & 255) << shift
            literal = table.entries[0] < 256 << 4 if shift == 8 else literal
            continue
        e = np.asarray(table.entries).take((bits[: len(place)] if first else bits.take(place)) & table.mask)
        if shift == 8:
            literal = e < 256 << 4
        varied.append((e, shift))
        place, first = place + (e & 15), False
    after = np.zeros(end + 128, np.int64)
    after[at:end] = (place * literal)[at:]
    after2 = after.take(after)
    after4 = after2.take(after2)

    def steps(places: list[int]) -> np.ndarray:
        p = np.empty((len(places), 8), np.int64)
        p[:, 0] = places
        p[:, 4] = after4.take(p[:, 0])
        p[:, 2::4] = after2.take(p[:, ::4])
        p[:, 1::2] = after.take(p[:, ::2])
        return p.ravel()

    def pixel(p: np.ndarray) -> np.ndarray:
        out = np.full(len(p), fixed)
        for e, shift in varied:
            out |= e.take(p) >> 4 << shift
        return out

    return pixel, steps, memoryview(after), memoryview(after4.take(after4))


def read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an entropy-coded image."""
    cache_bits = r.read(4) if r.read(1) else 0
    block_bits, groups_at = 0, None
    n_groups = 1
    if main and r.read(1):
        block_bits = r.read(3) + 2
        across = (width + (1 << block_bits) - 1) >> block_bits
        down = (height + (1 << block_bits) - 1) >> block_bits
        groups_at = ((read_pixels(r, across, down, False) >> 8) & 0xFFFF).tolist()
        n_groups = max(groups_at) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES)
    groups = [[Table(read_lengths(r, size)) for size in sizes] for _ in range(n_groups)]
    total = width * height
    out: list[int] = []
    near = near_distances(width)
    cache = [0] * cache_size
    shift = 32 - cache_bits
    cached = 0  # pixels that the cache has seen
    data, at = r.data, r.at
    quick = n_groups == 1 and total >= AHEAD
    green, red, blue, alpha, distance = groups[0]
    room = total
    read, done = np.empty(total if quick and not cache_bits else 0, np.int64), 0
    while quick and not cache_bits and room:
        # Without a cache the literals' pixels are needed by copies alone, so those of a stretch are looked up at its end.
        base, before = at - 1 & ~7, room  # so no pixel begins at bit 0 of a stretch, which says that none begins
        pixel, steps, after, after8 = literals_ahead(data[base >> 3 : (base >> 3) + STRETCH], at - base, groups[0])
        at -= base
        eights, places, runs = [], [], []  # runs: eights and places before a copy, its length and distance
        while room and at + 64 < len(after):
            to = after8[at]
            while to and room >= 8:
                eights.append(at)
                at = to
                to = after8[at]
                room -= 8
            to = after[at]
            while to and room:
                places.append(at)
                at = to
                to = after[at]
                room -= 1
            if not room:
                break
            e = green.entries[(int.from_bytes(data[base + at >> 3 : (base + at >> 3) + 4], "little") >> (at & 7)) & green.mask]
            if e >> 4 < 256:
                break
            r.at = base + at + (e & 15)
            length = spread((e >> 4) - 256, r)
            code = spread(r.symbol(distance), r)
            at = r.at - base
            length = min(length, room)
            runs.append((len(eights), len(places), length, code - 120 if code > 120 else near[code - 1]))
            room -= length
        eight_pixels = pixel(steps(eights)) if eights else read[:0]
        place_pixels = pixel(np.array(places, np.int64)) if places else read[:0]
        was, had = 0, 0
        for n_eights, n_places, length, back in [*runs, (len(eights), len(places), 0, 1)]:
            for some in (eight_pixels[8 * was : 8 * n_eights], place_pixels[had:n_places]):
                read[done : done + len(some)] = some
                done += len(some)
            was, had = n_eights, n_places
            start = done - back
            if length and start < 0:
                raise ValueError("copy from before the image")
            if length:
                read[done : done + length] = read[start : start + length] if back >= length else np.resize(read[start:done], length)
            done += length
        at += base
        if room == before:
            break
    out += read[:done].tolist() if done < total else ()
    base = until = 0
    while done < total and len(out) < total:
        if groups_at is not None:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, distance = groups[groups_at[(y >> block_bits) * across + (x >> block_bits)]]
        if quick and cache_bits:
            if at >= until:
                base = at - 1 & ~7
                pixel, steps, after, after8 = literals_ahead(data[base >> 3 : (base >> 3) + STRETCH], at - base, groups[0])
                until = base + len(after) - 128
                until = until if (base >> 3) + STRETCH < len(data) else len(data) * 8
            at -= base
            room = total - len(out)
            eights = []
            to = after8[at] if at < len(after) else 0
            while to and room >= 8:
                eights.append(at)
                at = to
                to = after8[at]
                room -= 8
            if eights:
                out += pixel(steps(eights)).tolist()
            places = []
            to = after[at] if at < len(after) else 0
            while to and room:
                places.append(at)
                at = to
                to = after[at]
                room -= 1
            if places:
                out += pixel(np.array(places, np.int64)).tolist()
            at += base
            if not room:
                break
        w = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        e = green.entries[w & green.mask]
        g = e >> 4
        if g < 256:
            n = e & 15
            w >>= n
            e = red.entries[w & red.mask]
            n += e & 15
            w >>= e & 15
            argb = (e >> 4) << 16 | g << 8
            e = blue.entries[w & blue.mask]
            n += e & 15
            w >>= e & 15
            argb |= e >> 4
            e = alpha.entries[w & alpha.mask]
            at += n + (e & 15)
            out.append((e >> 4) << 24 | argb)
        elif g < 256 + LENGTH_CODES:
            r.at = at + (e & 15)
            length = spread(g - 256, r)
            code = spread(r.symbol(distance), r)
            at = r.at
            back = code - 120 if code > 120 else near[code - 1]
            start = len(out) - back
            if start < 0:
                raise ValueError("copy from before the image")
            if back >= length:
                out += out[start : start + length]
            else:
                run = out[start:]
                out += (run * (length // back + 1))[:length]
            del out[total:]
        else:
            at += e & 15
            for p in out[cached:]:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p
            cached = len(out)
            out.append(cache[g - 256 - LENGTH_CODES])
    r.at = at
    if at > (len(data) - 16) * 8:
        raise ValueError("image data ends early")
    return np.array(out, np.int64) if done < total else read


def channels(argb: np.ndarray) -> np.ndarray:
    """blue, green, red, alpha of each pixel, as the last axis."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4")[..., 0].astype(np.int64)


def average(a: int, b: int) -> int:
    """Channel by channel, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def added(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def clamped(f, *pixels: int) -> int:
    out = 0
    for s in (0, 8, 16, 24):
        out |= min(255, max(0, f(*[(p >> s) & 255 for p in pixels]))) << s
    return out


def selected(left: int, top: int, corner: int) -> int:
    """Left or top, whichever is nearer to left + top - corner."""
    to_left = to_top = 0
    for s in (0, 8, 16, 24):
        a, b, c = (left >> s) & 255, (top >> s) & 255, (corner >> s) & 255
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def half_step(a: int, c: int) -> int:
    d = a - c
    return a + (d // 2 if d >= 0 else -(-d // 2))


#: By mode: left, top, top right, top left -> prediction.
PREDICTORS = (
    lambda l, t, tr, tl: OPAQUE,
    lambda l, t, tr, tl: l,
    lambda l, t, tr, tl: t,
    lambda l, t, tr, tl: tr,
    lambda l, t, tr, tl: tl,
    lambda l, t, tr, tl: average(average(l, tr), t),
    lambda l, t, tr, tl: average(l, tl),
    lambda l, t, tr, tl: average(l, t),
    lambda l, t, tr, tl: average(tl, t),
    lambda l, t, tr, tl: average(t, tr),
    lambda l, t, tr, tl: average(average(l, tl), average(t, tr)),
    lambda l, t, tr, tl: selected(l, t, tl),
    lambda l, t, tr, tl: clamped(lambda a, b, c: a + b - c, l, t, tl),
    lambda l, t, tr, tl: clamped(half_step, average(l, t), tl),
)


def predictions(width: int, height: int, modes: list[int], bits: int, pixel) -> Iterator[int]:
    """The prediction of each pixel in turn; pixel(i) gives those before it."""
    across = (width + (1 << bits) - 1) >> bits
    for i in range(width * height):
        y, x = divmod(i, width)
        if i == 0:
            yield OPAQUE
        elif y == 0:
            yield pixel(i - 1)
        elif x == 0:
            yield pixel(i - width)
        else:
            # Right of the last column stands the row's own first pixel.
            yield PREDICTORS[modes[(y >> bits) * across + (x >> bits)] % 14](pixel(i - 1), pixel(i - width), pixel(i - width + 1), pixel(i - width - 1))


def unpredict(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    kinds = set(modes.tolist())
    if kinds == {2}:  # top only: running sums down the columns
        parts = channels(argb).reshape(height, width, 4).astype(np.int64)
        parts[0, 0] += channels(np.array([OPAQUE]))[0]
        parts[0] = np.cumsum(parts[0], axis=0)
        return joined((np.cumsum(parts, axis=0) & 255).reshape(-1, 4))
    rest, out = argb.tolist(), []
    for r, p in zip(rest, predictions(width, height, modes.tolist(), bits, out.__getitem__)):
        out.append(added(r, p))
    return np.array(out, np.int64)


def predict(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    pixels = argb.tolist()
    guess = np.array(list(predictions(width, height, modes.tolist(), bits, pixels.__getitem__)), np.int64)
    return joined(channels(argb).astype(np.int64) - channels(guess) & 255)


def cross_colour(argb: np.ndarray, width: int, height: int, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what red and blue owe to green and blue to red, block by block."""
    across = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(width * height), width)
    e = channels(elements).view(np.int8)[(y >> bits) * across + (x >> bits)].astype(np.int64)
    parts = channels(argb).astype(np.int64)
    green = parts[:, 1].astype(np.uint8).view(np.int8).astype(np.int64)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    red = (parts[:, 2] + sign * (e[:, 0] * green >> 5)) & 255
    true_red = red if sign > 0 else parts[:, 2]
    parts[:, 0] = (parts[:, 0] + sign * ((e[:, 1] * green >> 5) + (e[:, 2] * signed(true_red) >> 5))) & 255
    parts[:, 2] = red
    return joined(parts)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, argb) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
        if at >= len(data):
            raise ValueError("no lossless image")
    size = struct.unpack_from("<I", data, at + 4)[0]
    r = Reader(data[at + 8 : at + 8 + size])
    if r.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height, _, version = r.read(14) + 1, r.read(14) + 1, r.read(1), r.read(3)
    if version:
        raise ValueError("unknown version")
    transforms = []
    inner = width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            block = (1 << bits) - 1
            image = read_pixels(r, inner + block >> bits, height + block >> bits, False)
            transforms.append((kind, inner, bits, (image >> 8) & 255 if kind == PREDICTOR else image))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, inner, 0, None))
        else:
            colours = r.read(8) + 1
            steps = channels(read_pixels(r, colours, 1, False)).astype(np.int64)
            transforms.append((kind, inner, bundle_bits(colours), joined(np.cumsum(steps, axis=0) & 255)))
            bits = bundle_bits(colours)
            inner = inner + (1 << bits) - 1 >> bits
    argb = read_pixels(r, inner, height, True)
    for kind, across, bits, image in reversed(transforms):
        if kind == PREDICTOR:
            argb = unpredict(argb, across, height, image, bits)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, across, height, image, bits, 1)
        elif kind == SUBTRACT_GREEN:
            parts = channels(argb).copy()
            parts[:, 0] += parts[:, 1]
            parts[:, 2] += parts[:, 1]
            argb = joined(parts)
        else:
            green = ((argb >> 8) & 255).reshape(height, -1)
            each = 8 >> bits
            index = (green[:, :, None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)
            index = index.reshape(height, -1)[:, :across].ravel()
            argb = np.append(image, 0)[np.minimum(index, len(image))]
    return width, height, argb


# ---------------------------------------------------------------- writing


def write_lengths(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        w.write(1, 1)
        w.write(int(len(used) == 2), 1)
        w.write(int(first > 1), 1)
        w.write(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.write(int(used[1]), 8)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    starts = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]]))
    last = 8
    for v, n in zip(lengths[starts].tolist(), np.diff(np.append(starts, len(lengths))).tolist()):
        if v == 0:
            while n > 2:
                k = min(n, 138)
                runs.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                n -= k
        else:
            if v != last:
                runs.append((v, 0, 0))
                n -= 1
            while n > 2:
                k = min(n, 6)
                runs.append((16, k - 3, 2))
                n -= k
            last = v
        if n:
            runs += [(v, 0, 0)] * n
    table = np.array(runs, np.int64)
    inner = code_lengths(np.bincount(table[:, 0], minlength=19), 7)
    order = [int(inner[k]) for k in LENGTH_ORDER]
    n = max(4, max(k for k, v in enumerate(order) if v) + 1)
    w.write(0, 1)
    w.write(n - 4, 4)
    for v in order[:n]:
        w.write(v, 3)
    w.write(0, 1)
    values, bits = np.zeros((len(table), 2), np.int64), np.zeros((len(table), 2), np.int64)
    values[:, 0], values[:, 1], bits[:, 1] = codes(inner)[table[:, 0]], table[:, 1], table[:, 2]
    bits[:, 0] = 0 if np.count_nonzero(inner) == 1 else inner[table[:, 0]]
    w.extend(values.ravel(), bits.ravel())


def split_value(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths or distance codes from 1."""
    if not len(value):
        return value, value, value
    v = value - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + ((v >> np.maximum(extra, 0)) & 1))
    return symbol, np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def copies(argb: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies: from the last place with the same `least` pixels, as far as they go."""
    n = len(argb)
    if n < 2 * least:
        return []
    # Keys of 1, 2, 4, ... pixels from two of half as many; the bits of `least` say which of them make its own.
    power, part, key, size = KEY_POWERS[0], argb, None, 0
    for bit in range(least.bit_length()):
        if least >> bit & 1:
            key, size = (part, 1 << bit) if key is None else (key[: n - size - (1 << bit) + 1] * power + part[size:], size + (1 << bit))
        if 2 << bit <= least:
            half = 1 << bit
            part = part[:-half] * power + part[half:]
            power = KEY_POWERS[bit + 1]
    key = (key ^ key >> 29) * KEY_POWERS[0]  # all pixels count in the high bits
    # Places ride in the keys' low bits, so that plain numbers are sorted and equal keys stay in the order of places.
    mask = (1 << n.bit_length()) - 1
    order = np.sort(key & ~mask | np.arange(len(key))) & mask
    sorted_key = key[order]
    same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    if not len(same):
        return []
    before = np.full(n, -1)
    before[order[same + 1]] = order[same]
    starts = np.flatnonzero(before >= 0)
    out: list[tuple[int, int, int]] = []
    k = 0
    while k < len(starts):
        i = int(starts[k])
        j = int(before[i])
        length, most, step = 0, min(n - i, MAX_COPY), 64
        while length < most:
            step = min(step, most - length)
            differ = argb[i + length : i + length + step] != argb[j + length : j + length + step]
            first = int(differ.argmax())
            if differ[first]:
                length += first
                break
            length += step
            step *= 4
        if length >= least:
            out.append((i, length, i - j))
            k = int(starts.searchsorted(i + length))
        else:
            k += 1
    return out


def cache_hits(argb: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each pixel, whether the cache then holds it)."""
    slot = (argb * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - bits)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(argb), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    return slot, hit


def write_pixels(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, least: int = LEAST_COPY) -> None:
    n = len(argb)
    found = copies(argb, least)
    literal = np.ones(n, bool)
    for i, length, _ in found:
        literal[i : i + length] = False
    at = np.flatnonzero(literal)
    slots = np.zeros(0, np.int64)
    if cache_bits:
        slot, hit = cache_hits(argb, cache_bits)
        literal &= ~hit
        cached = np.setdiff1d(at, np.flatnonzero(literal))
        at, slots = np.flatnonzero(literal), slot[cached]
    else:
        cached = np.zeros(0, np.int64)
    place = np.array([c[0] for c in found], np.int64)
    length = split_value(np.array([c[1] for c in found], np.int64))
    near = near_codes(width) if found else {}
    distance = split_value(np.array([near.get(c[2], c[2] + 120) for c in found], np.int64))
    parts = channels(argb[at]).astype(np.int64)
    greens = np.concatenate([parts[:, 1], length[0] + 256, slots + 256 + LENGTH_CODES])
    tables = []
    for symbols, size in ((greens, 256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0)), (parts[:, 2], 256), (parts[:, 0], 256), (parts[:, 3], 256), (distance[0], DISTANCE_CODES)):
        tables.append(code_lengths(np.bincount(symbols, minlength=size), 15))
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    for lengths in tables:
        write_lengths(w, lengths)
    # A code of one symbol takes no bits.
    lone = [np.count_nonzero(t) < 2 for t in tables]
    sizes = [np.zeros_like(t) if one else t for t, one in zip(tables, lone)]
    words = [t if one else codes(t) for t, one in zip(tables, lone)]
    # The fields of a literal that take bits, in their order, pixel by pixel.
    fields = [(column, code) for code, column in enumerate((1, 2, 0, 3)) if not lone[code]] or [(1, 0)]
    values = np.stack([words[code][parts[:, column]] for column, code in fields], axis=1).ravel()
    bits = np.stack([sizes[code][parts[:, column]] for column, code in fields], axis=1).ravel()
    if len(found) or len(cached):
        # Copies and cache indices stand before the first literal after them.
        more_at = np.concatenate([place, cached])
        order = np.argsort(more_at)
        where = np.repeat(np.searchsorted(at, more_at[order]) * len(fields), 4)
        none = np.zeros(len(cached), np.int64)
        more = lambda copy, index: np.concatenate([np.stack(copy, axis=1), np.stack([index, none, none, none], axis=1)])[order].ravel()
        symbol, index = length[0] + 256, slots + 256 + LENGTH_CODES
        values = np.insert(values, where, more([words[0][symbol], length[1], words[4][distance[0]], distance[1]], words[0][index]))
        bits = np.insert(bits, where, more([sizes[0][symbol], length[2], sizes[4][distance[0]], distance[2]], sizes[0][index]))
    w.extend(values, bits)


def encode(argb: np.ndarray, width: int, height: int, transforms: tuple = (), cache_bits: int | None = None, least: int = LEAST_COPY) -> bytes:
    """A lossless WebP file. transforms: (kind, block bits, block image) for predictor modes and cross-colour
    elements, (SUBTRACT_GREEN,) and (PALETTE,), applied in this order; cache_bits None: as the pixels suggest;
    least: pixels that a copy has at least."""
    w = Writer()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    argb = argb.astype(np.int64)
    for kind, *more in transforms:
        w.write(1, 1)
        w.write(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits, image = more
            w.write(bits - 2, 3)
            across = width + (1 << bits) - 1 >> bits
            write_pixels(w, OPAQUE | image << 8 if kind == PREDICTOR else image, across, False)
            argb = predict(argb, width, height, image, bits) if kind == PREDICTOR else cross_colour(argb, width, height, image, bits, -1)
        elif kind == SUBTRACT_GREEN:
            parts = channels(argb).copy()
            parts[:, 0] -= parts[:, 1]
            parts[:, 2] -= parts[:, 1]
            argb = joined(parts)
        else:
            palette, index = np.unique(argb, return_inverse=True)
            w.write(len(palette) - 1, 8)
            steps = channels(palette).astype(np.int64)
            steps[1:] -= steps[:-1].copy()
            write_pixels(w, joined(steps & 255), len(palette), False)
            bits = bundle_bits(len(palette))
            rows = index.reshape(height, width)
            inner = width + (1 << bits) - 1 >> bits
            rows = np.pad(rows, ((0, 0), (0, (inner << bits) - width))).reshape(height, inner, 1 << bits)
            argb = (OPAQUE | (rows << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2) << 8).ravel()
            width = inner
    w.write(0, 1)
    if cache_bits is None:
        cache_bits = 6 if cache_hits(argb, 6)[1].mean() > 0.15 else 0
    write_pixels(w, argb, width, True, cache_bits, least)
    body = w.bytes()
    pad = bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBP" + b"VP8L" + struct.pack("<I", len(body)) + body + pad


# ---------------------------------------------------------------- payloads


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these bytes filled with zeros to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -len(raw) // 64 * -64) - len(raw))


XLOG2X = np.array([k * math.log2(max(k, 1)) for k in range(ESTIMATED + 1)])
#: The cache slot of each sample, for each size of CACHES.
SLOTS = np.array([[(OPAQUE | v << 8) * CACHE_FACTOR % (1 << 32) >> 32 - bits for v in range(256)] for bits in CACHES], np.uint8)


def estimated(symbols: np.ndarray, size: int) -> np.ndarray:
    """Bits that entropy codes of their own take for each row of symbols below size; at most ESTIMATED a row."""
    rows = len(symbols)
    counts = np.bincount((symbols + size * np.arange(rows)[:, None]).ravel(), minlength=rows * size).reshape(rows, size)
    return XLOG2X[symbols.shape[1]] - XLOG2X[counts].sum(axis=1)


def hopeful(samples: np.ndarray, width: int) -> list[tuple[tuple, int]]:
    """(transforms, cache bits) that seem to save bits against neither, in a stretch of whole rows of the samples."""
    out: list[tuple[tuple, int]] = []
    first = max(0, (len(samples) - ESTIMATED) // 2)
    x = samples[first : first + ESTIMATED]
    slot = SLOTS[:, x]
    order = np.argsort(slot, axis=1, kind="stable")
    of, value = np.take_along_axis(slot, order, 1), x[order]
    hit = np.zeros(of.shape, bool)
    hit[:, 1:] = (of[:, 1:] == of[:, :-1]) & (value[:, 1:] == value[:, :-1])
    # Cache indices stand behind the literals in one code.
    bits = estimated(np.concatenate([x[None].astype(np.int64), np.where(hit, 256 + of.astype(np.int64), value)]), 512)
    out += [((), c) for c, b in zip(CACHES, bits[1:].tolist()) if b < bits[0] - LEAST_SAVED * len(x)]
    at = max(width + 1, first)
    wide = samples[at - width - 1 : at + ESTIMATED // 2].astype(np.int16)
    if len(wide) > 2 * width:
        x, l, t, tr, tl = wide[width + 1 :], wide[width:-1], wide[1:-width], wide[2 : len(wide) - width + 1], wide[: -width - 1]
        lt = l + t >> 1
        guesses = np.stack([
            x * 0, l, t, tr, tl, ((l + tr >> 1) + t) >> 1, l + tl >> 1, lt, tl + t >> 1, t + tr >> 1, (l + tl >> 1) + (t + tr >> 1) >> 1,
            np.where(np.abs(t - tl) < np.abs(l - tl), l, t), np.minimum(np.maximum(l + t - tl, 0), 255), np.minimum(np.maximum(lt + ((lt - tl) + (lt < tl) >> 1), 0), 255),
        ])
        bits = estimated(x - guesses & 255, 256)
        best = int(bits.argmin())
        if bits[best] < bits[0] - LEAST_SAVED * len(x):
            blocks = (width + 511 >> 9) * (-(-len(samples) // width) + 511 >> 9)
            out.append((((PREDICTOR, 9, np.full(blocks, best)),), 0))
    return out


def store(payload: bytes) -> bytes:
    """A lossless image whose green samples are the payload's bytes; with 16 values or fewer, several share a pixel.
    The smallest of the files with what the samples suggest."""
    if len(payload) > MAX_SIDE * MAX_SIDE:
        raise ValueError(f"an image holds {MAX_SIDE * MAX_SIDE} samples")
    samples = np.frombuffer(payload, np.uint8)
    width = 64
    while len(samples) > width * MAX_SIDE:
        width *= 2
    height = -(-len(samples) // width)
    pixels = np.zeros(width * height, np.int64)
    pixels[: len(samples)] = samples
    argb = OPAQUE | pixels << 8
    if np.count_nonzero(np.bincount(samples)) <= 16:
        return min((encode(argb, width, height, ((PALETTE,),), bits) for bits in (0, None)), key=len)
    tried = [((), 0), *hopeful(samples, width)]
    return min((encode(argb, width, height, transforms, bits, LEAST_RUN) for transforms, bits in tried), key=len)


def load(media: bytes, size: int) -> tuple[bytes, str]:
    """(payload, feature): width and height, distinct samples, mean and deviation."""
    width, height, argb = decode(media)
    samples = (argb >> 8 & 255)[:size].astype(np.uint8)
    distinct = np.count_nonzero(np.bincount(samples))
    return samples.tobytes(), f"{width}x{height} distinct={distinct} mean={samples.mean():.4f} deviation={samples.std():.4f}"


def media_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text as a lossless image, reads it back and describes what was read; with_media keeps the file as `media`."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * with_media]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for t in batch.column(1):
                    n, payload = payload_of(t.as_py())
                    media = store(payload)
                    back, feature = load(media, len(payload))
                    rows.append((n, len(payload), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, *[media] * with_media))
                columns = list(zip(*rows)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(batches, schema)
