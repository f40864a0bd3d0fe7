"""Progressive JPEG: files into coefficient arrays, scan by scan, and on to RGB tensors.

Decoding accumulates spectral-selection scans (first sight of a band of
coefficients, to a low precision) and successive-approximation scans (one more
bit of each) into the coefficients of all components. Then the inverse
transform is one matrix product, in numbers that double precision holds
exactly; chroma is repeated to full resolution; colours are converted.

An entropy-coded scan is serial, but each restart interval stands alone. So the
intervals of all files of a batch that share a scan's parameters and tables
advance side by side, a lane each: every step peeks 16 bits in each lane, looks
up symbols and places coefficients with numpy. A file without restart markers
is one lane a scan. Refinement scans take all correction bits up to the next
new coefficient in one step.

The encoder writes 4:2:0 images with restart markers in eleven scans, from
coefficient arrays; it packs the bits of all files of a batch at once.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Data units in a restart interval that the encoder writes.
INTERVAL = 8
_STEP = np.arange(64)


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = zigzag()
SCALE = 1 << 14  # _samples shifts by as many bits


def _transform() -> np.ndarray:
    """The inverse transform of 64 coefficients in zigzag order to 64 samples, times SCALE, in whole numbers."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * SCALE)


TRANSFORM = _transform()


def code_of(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body (counts and symbols) and the canonical codes (code, length) for code lengths by symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return counts + bytes(symbols), codes


def _ac_lengths() -> dict[int, int]:
    """Short codes for coefficients of 7, 6 and 8 bits without a run and for the end of a block, 12 bits for all else."""
    lengths = {16 * r + s: 12 for r in range(16) for s in range(1, 11)} | {16 * r: 12 for r in range(16)}
    return lengths | {7: 1, 6: 3, 8: 4, 0: 4, 5: 5}


AC_BODY, AC_CODES = code_of(_ac_lengths())
DC_BODY, DC_CODES = code_of({s: 4 for s in range(12)})


def _table(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol, for the encoder."""
    code, length = np.zeros(256, np.int32), np.zeros(256, np.int32)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


AC_TABLE, DC_TABLE = _table(AC_CODES), _table(DC_CODES)


def lookup(body: bytes) -> np.ndarray:
    """By the next 16 bits: symbol times 32 plus the code's length; -1 where no code begins so."""
    out = np.full(1 << 16, -1, np.int32)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = body[at] * 32 + n
            code, at = code + 1, at + 1
        code <<= 1
    return out


_BITS = np.array([v.bit_length() for v in range(4096)], np.int32)


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits that magnitudes below 4096 take."""
    return _BITS[values]


# --- encoder ---------------------------------------------------------------


def _pack(code: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of all lanes as bytes: each lane is filled up with ones, stuffed, and followed by a restart marker unless it is its file's last.

    ``last`` holds, for every lane, the number of its marker or -1. Returns the
    bytes and where each lane begins in them (one entry more for the end).
    """
    used = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    edge = np.searchsorted(lane, np.arange(lanes + 1))
    total = np.diff(used[edge])
    size = (total + 7) // 8
    begin = np.concatenate([[0], np.cumsum(size)])
    bit = used[:-1] + np.repeat(8 * begin[:-1] - used[edge[:-1]], np.diff(edge))
    # An entry covers four bytes at most (7 + 24 bits).
    window = code.astype(np.uint32) << (32 - length - (bit & 7)).astype(np.uint32)
    first = bit >> 3
    raw = np.zeros(begin[-1] + 4, np.uint8)
    fresh = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else first
    longest = int(length.max(initial=0)) + 7
    for k in range(-(-longest // 8)):
        part = (window >> np.uint32(24 - 8 * k)).astype(np.uint8)
        if len(fresh):
            raw[first[fresh] + k] |= np.bitwise_or.reduceat(part, fresh)
    raw = raw[: begin[-1]]
    spare = 8 * size - total
    ends = begin[1:][size > 0] - 1
    raw[ends] |= ((1 << spare[size > 0]) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(raw == 255)
    marked = last >= 0
    markers = np.concatenate([[0], np.cumsum(marked)])
    out_begin = begin + np.searchsorted(stuffed, begin) + 2 * markers
    out = np.zeros(out_begin[-1], np.uint8)
    # Bytes move by two for each marker and by one for each stuffed byte before them.
    move = np.repeat(2 * markers[:-1], size)
    steps = np.zeros(len(raw) + 1, np.int64)
    steps[stuffed + 1] = 1
    out[np.arange(len(raw)) + move + np.cumsum(steps[:-1])] = raw
    at = out_begin[1:][marked] - 2
    out[at], out[at + 1] = 255, 0xD0 + last[marked]
    return out.tobytes(), out_begin


def _lanes(units: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For files with so many units each: the lane of every unit, each lane's marker number (-1: the file's last), lanes a file."""
    count = -(-units // per)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    inside = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    lane = np.repeat(first, units) + inside // per
    number = np.arange(count.sum()) - np.repeat(first, count)
    return lane, np.where(number == np.repeat(count, count) - 1, -1, number % 8), count


def _spread(code: np.ndarray, length: np.ndarray, full: np.ndarray, width: int, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of full blocks, ``width`` each, among single ends of the other blocks, in the order of the blocks."""
    if full.all():
        return code, length, np.repeat(lane, width)
    count = np.where(full, width, 1)
    inside = np.repeat(full, count)
    codes, lengths = np.full(len(inside), AC_TABLE[0][0]), np.full(len(inside), AC_TABLE[1][0])
    codes[inside], lengths[inside] = code, length
    return codes, lengths, np.repeat(lane, count)


def _ac_first(values: np.ndarray, lane: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and lanes of a band's first scan; values are already shifted."""
    band = values[:, lo : hi + 1]
    width = hi - lo + 1
    full = band.all(axis=1)
    if (full | ~band.any(axis=1)).all():  # no runs: whole blocks, and ends of empty ones
        v = band[full].ravel()
        size = bits_of(np.abs(v))
        return _spread((AC_TABLE[0][size] << size) | (v + ((1 << size) - 1) * (v < 0)), AC_TABLE[1][size] + size, full, width, lane)
    row, col = np.nonzero(band)
    v = band[row, col]
    same = np.diff(row, prepend=-1) == 0
    run = np.where(same, col - np.concatenate([[0], col[:-1]]) - 1, col)
    size = bits_of(np.abs(v))
    symbol = (run & 15) * 16 + size
    code = (AC_TABLE[0][symbol] << size) | np.where(v < 0, v + (1 << size) - 1, v)
    length = AC_TABLE[1][symbol] + size
    order = row * (2 * width + 2) + 2 * col + 1
    final = np.full(len(values), -1)
    final[row] = col  # the last one written is the largest
    open_ = np.flatnonzero(final < width - 1)
    skips = np.repeat(np.arange(len(row)), run >> 4)
    if len(open_) or len(skips):
        order = np.concatenate([order, order[skips] - 1, open_ * (2 * width + 2) + 2 * width + 1])
        code = np.concatenate([code, np.full(len(skips), AC_TABLE[0][0xF0]), np.full(len(open_), AC_TABLE[0][0])])
        length = np.concatenate([length, np.full(len(skips), AC_TABLE[1][0xF0]), np.full(len(open_), AC_TABLE[1][0])])
        row = np.concatenate([row, row[skips], open_])
        turn = np.argsort(order, kind="stable")
        code, length, row = code[turn], length[turn], row[turn]
    return code, length, lane[row]


def _ac_refine(values: np.ndarray, lane: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and lanes of the scan that adds bit ``low`` to a band."""
    band = values[:, lo : hi + 1]
    size = np.abs(band) >> low
    old, new = size > 1, size == 1
    n, width = band.shape
    simple = ~new.any(axis=1)
    # Blocks without a new coefficient: the end of the block, then the bits of the old ones.
    full = old.all(axis=1)
    if (full | ~size.any(axis=1)).all():
        code, length = np.empty((int(full.sum()), width + 1), np.int32), np.ones((int(full.sum()), width + 1), np.int32)
        code[:, 0], length[:, 0], code[:, 1:] = AC_TABLE[0][0], AC_TABLE[1][0], size[full] & 1
        return _spread(code.ravel(), length.ravel(), full, width + 1, lane)
    row, col = np.nonzero(old & simple[:, None])
    needed = np.flatnonzero(simple & ((size == 0).any(axis=1) | old.any(axis=1)))
    code = np.concatenate([np.full(len(needed), AC_TABLE[0][0]), size[row, col] & 1])
    length = np.concatenate([np.full(len(needed), AC_TABLE[1][0]), np.ones(len(row), np.int64)])
    order = np.concatenate([needed * 4096, row * 4096 + 1 + col])
    owner = np.concatenate([needed, row])
    extra: list[tuple[int, int, int, int]] = []
    for b in np.flatnonzero(~simple).tolist():
        run, held, at = 0, [], 0

        def put(c: int, k: int, b: int = b) -> None:
            nonlocal at
            extra.append((b * 4096 + at, c, k, b))
            at += 1

        final = int(np.flatnonzero(new[b])[-1])
        for j in range(width):
            if old[b, j]:
                held.append(int(size[b, j] & 1))
            elif new[b, j]:
                put((AC_CODES[run * 16 + 1][0] << 1) | int(band[b, j] > 0), AC_CODES[run * 16 + 1][1] + 1)
                for bit in held:
                    put(bit, 1)
                run, held = 0, []
            else:
                run += 1
                if run == 16 and j < final:
                    put(*AC_CODES[0xF0])
                    for bit in held:
                        put(bit, 1)
                    run, held = 0, []
        if run or held:
            put(*AC_CODES[0])
            for bit in held:
                put(bit, 1)
    if extra:
        more = np.array(extra, dtype=np.int64)
        order, code, length, owner = (np.concatenate([a, more[:, k]]) for k, a in enumerate((order, code, length, owner)))
    turn = np.argsort(order, kind="stable")
    return code[turn], length[turn], lane[owner[turn]]


def mcu_order(high: int, wide: int) -> np.ndarray:
    """Blocks of a 4:2:0 image - all of Y, then Cb, then Cr, each row by row - in the order of an interleaved scan."""
    r, c = np.divmod(np.arange(high * wide), wide)
    y = (2 * r) * (2 * wide) + 2 * c
    luma = 4 * high * wide
    return np.stack([y, y + 1, y + 2 * wide, y + 2 * wide + 1, luma + np.arange(high * wide), luma + high * wide + np.arange(high * wide)], axis=1).ravel()


#: Scans that the encoder writes: components, first and last coefficient, high and low bit.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), *[((c,), 1, 5, 0, 1) for c in range(3)], *[((c,), 6, 63, 0, 1) for c in range(3)], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in range(3)]]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + DC_BODY + b"\x10" + AC_BODY) + _segment(0xDD, struct.pack(">H", INTERVAL))
_HEADS = [_segment(0xDA, bytes([len(cs)]) + b"".join(bytes([c + 1, 0]) for c in cs) + bytes([lo, hi, high * 16 + low])) for cs, lo, hi, high, low in SCRIPT]


def encode(grids: list[tuple[int, int]], coefficients: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Files of 4:2:0 images of (rows, columns) of 16 x 16 samples each; coefficients: blocks of all files in turn, each file's Y, Cb and Cr, zigzag."""
    area = np.array([r * c for r, c in grids], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(6 * area)])
    orders = {g: mcu_order(*g) for g in set(grids)}
    inter = np.concatenate([orders[g] + b for g, b in zip(grids, base[:-1], strict=True)])
    offset, blocks = (0, 4, 5), (4, 1, 1)
    rows = [np.concatenate([np.arange(b + offset[c] * a, b + (offset[c] + blocks[c]) * a) for a, b in zip(area.tolist(), base[:-1].tolist(), strict=True)]) for c in range(3)]
    sign, size = np.sign(coefficients), np.abs(coefficients)
    first = (sign * (size >> 1))[:, 1:]
    scans: list[list[bytes]] = []
    for cs, lo, hi, high, _low in SCRIPT:
        if len(cs) > 1:
            unit, last, count = _lanes(area, INTERVAL)
            lane = np.repeat(unit, 6)
            dc = coefficients[inter, 0].astype(np.int64)
            if high:
                code, length = dc & 1, np.ones(len(dc), np.int64)
            else:
                half = dc >> 1
                by = half.reshape(-1, 6)
                y = by[:, :4].ravel()
                fresh = np.concatenate([[True], unit[1:] != unit[:-1]])
                before_y = np.where(np.repeat(fresh, 4) & (np.arange(len(y)) % 4 == 0), 0, np.concatenate([[0], y[:-1]]))
                before_c = np.where(fresh[:, None], 0, np.concatenate([[[0, 0]], by[:-1, 4:]]))
                diff = np.hstack([(y - before_y).reshape(-1, 4), by[:, 4:] - before_c]).ravel()
                bits = bits_of(np.abs(diff))
                code = (DC_TABLE[0][bits] << bits) | np.where(diff < 0, diff + (1 << bits) - 1, diff)
                length = DC_TABLE[1][bits] + bits
        else:
            lane, last, count = _lanes(area * blocks[cs[0]], INTERVAL)
            if high:
                code, length, lane = _ac_refine(coefficients[rows[cs[0]]], lane, lo, hi, 0)
            else:
                code, length, lane = _ac_first(first[rows[cs[0]]], lane, lo - 1, hi - 1)
        data, at = _pack(code, length, lane, len(last), last)
        ends = at[np.concatenate([[0], np.cumsum(count)])].tolist()
        scans.append([data[a:b] for a, b in zip(ends, ends[1:], strict=False)])
    out = []
    for i, (r, c) in enumerate(grids):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * r, 16 * c, 3) + b"\1\x22\0\2\x11\0\3\x11\0")
        parts = [b"\xff\xd8", _segment(0xFE, comments[i]), _TABLES, frame]
        for head, scan in zip(_HEADS, scans, strict=True):
            parts += [head, scan[i]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# --- decoder ---------------------------------------------------------------


@dataclass
class Part:
    """A component of an image: sampling, table, blocks in the coefficient array and the grid they form."""

    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks across, whole MCUs
    high: int = 0
    across: int = 0  # blocks that a scan of this component alone holds
    down: int = 0
    base: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[Part] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)  # (key, entropy-coded bytes)
    blocks: int = 0


_SCAN_END = re.compile(rb"\xff(?=[^\x00\xd0-\xd7\xff])", re.S)


def parse(data: bytes) -> Image:
    """Segments of a file; scans keep their entropy-coded bytes."""
    image, codes, interval, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(data):
        if data[at] != 255:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                image.tables[k] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.float64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                codes[body[0]] = body[1:size]
                body = body[size:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xC2:
            _, image.height, image.width, count = struct.unpack(">BHHB", body[:6])
            image.parts = [Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            most_h, most_v = max(p.h for p in image.parts), max(p.v for p in image.parts)
            mcus = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            for p in image.parts:
                p.wide, p.high, p.base = mcus[0] * p.h, mcus[1] * p.v, image.blocks
                p.across, p.down = -(-(-(-image.width * p.h // most_h)) // 8), -(-(-(-image.height * p.v // most_v)) // 8)
                image.blocks += p.wide * p.high
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive JPEG file")
        elif marker == 0xDA:
            count = body[0]
            names = [p.name for p in image.parts]
            chosen = tuple((names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(count))
            lo, hi, bits = body[1 + 2 * count : 4 + 2 * count]
            end = _SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            used = tuple(codes.get(k >> 4 if lo == 0 else 16 + (k & 15), b"") for _, k in chosen) if not (lo == 0 and bits >> 4) else ()
            shape = tuple((image.parts[c].h, image.parts[c].v) for c, _ in chosen) if count > 1 else ()
            image.scans.append(((tuple(c for c, _ in chosen), shape, lo, hi, bits >> 4, bits & 15, interval, used), data[at:stop]))
            at = stop
    return image


def _units(image: Image, chosen: tuple) -> np.ndarray:
    """Blocks of a scan in its order."""
    if len(chosen) == 1:
        p = image.parts[chosen[0]]
        if p.across == p.wide:
            return p.base + np.arange(p.wide * p.down)
        return (p.base + np.arange(p.down)[:, None] * p.wide + np.arange(p.across)).ravel()
    first = image.parts[chosen[0]]
    wide, high = first.wide // first.h, first.high // first.v
    r, c = np.divmod(np.arange(wide * high), wide)
    columns = [p.base + (r * p.v + y) * p.wide + c * p.h + x for p in (image.parts[k] for k in chosen) for y in range(p.v) for x in range(p.h)]
    return np.stack(columns, axis=1).ravel()


class Lanes:
    """Restart intervals of several scans side by side: bytes without stuffing, and each lane's bits and blocks."""

    def __init__(self, scans: list[tuple[bytes, np.ndarray]], per: int):
        raw = np.frombuffer(b"".join(s + b"\xff\xd0" for s, _ in scans), np.uint8)  # a marker of our own after each scan
        escape = np.flatnonzero(raw == 255)
        following = raw[np.minimum(escape + 1, len(raw) - 1)]
        marker = escape[(following >= 0xD0) & (following <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[escape[following == 0] + 1] = False
        keep[marker], keep[marker + 1] = False, False
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.raw = np.concatenate([raw[keep], np.full(8, 255, np.uint8)])
        wide = self.raw.astype(np.int64)
        self.words = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        begin = np.concatenate([[0], kept[marker[:-1] + 2]])
        self.units = np.concatenate([u for _, u in scans])
        counts = np.array([len(u) for _, u in scans])
        lanes = np.maximum(1, -(-counts // per)) if per else np.ones(len(scans), np.int64)
        if lanes.sum() != len(begin):
            raise ValueError("restart markers don't match the restart interval")
        inside = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(np.cumsum(counts) - counts, lanes)
        self.at = start + inside * per
        self.end = np.minimum(self.at + per, start + np.repeat(counts, lanes)) if per else start + counts
        self.bit = begin.astype(np.int64) * 8

    def peek(self, bit: np.ndarray) -> np.ndarray:
        """The next 25 bits or more, at the top of 32."""
        return (self.words[np.minimum(bit >> 3, len(self.words) - 1)] << (bit & 7)) & 0xFFFFFFFF


def _dc(lanes: Lanes, out: np.ndarray, pattern: np.ndarray, tables: list[np.ndarray], high: int, low: int) -> None:
    """A scan of first coefficients; pattern: the component of each block of an MCU."""
    if high:
        for step in range(int((lanes.end - lanes.at).max(initial=0))):
            live = lanes.at + step < lanes.end
            bit = lanes.bit[live] + step
            block = lanes.units[lanes.at[live] + step]
            out[block, 0] |= ((lanes.raw[bit >> 3].astype(np.int64) >> (7 - (bit & 7))) & 1).astype(out.dtype) << low
        return
    before = np.zeros((len(lanes.at), len(tables)), np.int64)
    bits = lanes.bit.copy()
    for step in range(int((lanes.end - lanes.at).max(initial=0))):
        live = np.flatnonzero(lanes.at + step < lanes.end)
        part = pattern[step % len(pattern)]
        word = lanes.peek(bits[live])
        entry = tables[part][word >> 16]
        if (entry < 0).any():
            raise ValueError("a code that no table holds")
        used, size = entry & 31, entry >> 5
        value = ((word << used) & 0xFFFFFFFF) >> (32 - size)
        value = np.where(size == 0, 0, np.where(value < (1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value))
        bits[live] += used + size
        before[live, part] += value
        out[lanes.units[lanes.at[live] + step], 0] = before[live, part] << low


def _ac(lanes: Lanes, out: np.ndarray, table: np.ndarray, lo: int, hi: int, low: int) -> None:
    """The first scan of a band."""
    flat = out.reshape(-1)
    live = np.flatnonzero(lanes.at < lanes.end)
    at, end, bit = lanes.at[live], lanes.end[live], lanes.bit[live]
    k = np.full(len(at), lo)
    while len(at):
        word = lanes.peek(bit)
        entry = table[word >> 16]
        if (entry < 0).any():
            raise ValueError("a code that no table holds")
        used, symbol = entry & 31, entry >> 5
        run, size = symbol >> 4, symbol & 15
        extra = np.where(size > 0, size, np.where(run < 15, run, 0))
        value = ((word << used) & 0xFFFFFFFF) >> (32 - extra)
        bit = bit + used + extra
        coded = size > 0
        k = k + np.where(coded | (run == 15), run, 0)
        signed = np.where(value < (1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value) * (1 << low)
        place = lanes.units[at] * 64 + np.minimum(k, 63)
        if coded.all():
            flat[place] = signed
        else:
            flat[place[coded]] = signed[coded]
        k = k + 1
        ended = ~coded & (run < 15)
        over = ended | (k > hi)
        if over.any():
            at = at + np.where(ended, (1 << np.where(ended, run, 0)) + np.where(ended, value, 0), over)
            k = np.where(over, lo, k)
            keep = at < end
            if not keep.all():
                at, end, bit, k = at[keep], end[keep], bit[keep], k[keep]


def _refine(lanes: Lanes, out: np.ndarray, table: np.ndarray, lo: int, hi: int, low: int) -> None:
    """A scan that adds a bit to a band."""
    live = np.flatnonzero(lanes.at < lanes.end)
    at, end, bit = lanes.at[live], lanes.end[live], lanes.bit[live]
    k, skip = np.full(len(at), lo), np.zeros(len(at), np.int64)  # skip: blocks still to come of a run of ended blocks
    while len(at):
        block = lanes.units[at]
        fresh = skip == 0  # others take only correction bits
        word = lanes.peek(bit)
        entry = np.where(fresh, table[word >> 16], 0)
        if (entry < 0).any():
            raise ValueError("a code that no table holds")
        used, symbol = entry & 31, entry >> 5
        run, size = symbol >> 4, symbol & 15
        ending = fresh & (size == 0) & (run < 15)
        extra = np.where(size > 0, 1, np.where(ending, run, 0))
        value = ((word << used) & 0xFFFFFFFF) >> (32 - np.maximum(extra, 1))
        value = np.where(extra > 0, value, 0)
        bit = bit + used + extra
        skip = np.where(ending, (1 << np.where(ending, run, 0)) + value, skip)
        band = out[block]
        inside = (_STEP >= k[:, None]) & (_STEP <= hi)
        old = band != 0
        stop = np.full(len(at), hi + 1)
        seek = np.flatnonzero(skip == 0)  # these look for their run's end
        if len(seek):
            zeros = np.cumsum(inside[seek] & ~old[seek], axis=1) == (run[seek] + 1)[:, None]
            stop[seek] = np.where(zeros.any(axis=1), zeros.argmax(axis=1), hi + 1)
        row, col = np.nonzero(inside & old & (_STEP < stop[:, None]))
        count = np.bincount(row, minlength=len(at))
        ahead = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = bit[row] + ahead
        grow = ((lanes.raw[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)
        row, col = row[grow], col[grow]
        was = band[row, col]
        out[block[row], col] = was + np.where(was > 0, 1 << low, -(1 << low)).astype(out.dtype)
        bit = bit + count
        new = (size > 0) & fresh & (stop <= hi)
        out[block[new], stop[new]] = np.where(value[new] > 0, 1 << low, -(1 << low))
        k = stop + 1
        over = (skip > 0) | (k > hi)
        skip = np.maximum(skip - 1, 0) * (skip > 0)
        at = at + over
        k = np.where(over, lo, k)
        keep = at < end
        if not keep.all():
            at, end, bit, k, skip = at[keep], end[keep], bit[keep], k[keep], skip[keep]


_LOOKUPS: dict[bytes, np.ndarray] = {}


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Parsed files, the coefficients of all their blocks (zigzag), and where each file's blocks begin."""
    images = [parse(f) for f in files]
    base = np.concatenate([[0], np.cumsum([i.blocks for i in images])])
    out = np.zeros((base[-1], 64), np.int32)
    units: dict[tuple, np.ndarray] = {}
    for turn in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list[tuple[bytes, np.ndarray]]] = {}
        for i, image in enumerate(images):
            if turn < len(image.scans):
                key, data = image.scans[turn]
                same = (key[0], image.width, image.height, tuple((p.h, p.v) for p in image.parts))
                if same not in units:
                    units[same] = _units(image, key[0])
                groups.setdefault(key, []).append((data, units[same] + base[i]))
        for (chosen, shape, lo, hi, high, low, interval, used), scans in groups.items():
            for body in used:
                if body not in _LOOKUPS:
                    _LOOKUPS[body] = lookup(body)
            tables = [_LOOKUPS[body] for body in used]
            if lo == 0:
                pattern = np.repeat(np.arange(len(shape)), [h * v for h, v in shape]) if shape else np.zeros(1, np.int64)
                _dc(Lanes(scans, interval * len(pattern)), out, pattern, tables or [None] * len(chosen), high, low)
            elif high:
                _refine(Lanes(scans, interval), out, tables[0], lo, hi, low)
            else:
                _ac(Lanes(scans, interval), out, tables[0], lo, hi, low)
    return images, out, base


def _samples(blocks: np.ndarray) -> np.ndarray:
    """Samples of 0 to 255 of dequantised blocks; the sums are whole numbers, so their order doesn't matter."""
    return np.clip(((blocks @ TRANSFORM).astype(np.int64) + (128 * SCALE + SCALE // 2)) >> 14, 0, 255).astype(np.int32)


def tensors(images: list[Image], blocks: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB of each file: height x width x 3, 8 bits."""
    out = []
    plain: np.ndarray | None = None
    if all((t == 1).all() for i in images for t in i.tables.values()) and len(blocks):
        plain = _samples(blocks.astype(np.float64))
    for i, image in enumerate(images):
        most_h, most_v = max(p.h for p in image.parts), max(p.v for p in image.parts)
        planes = []
        for p in image.parts:
            a = base[i] + p.base
            b = a + p.wide * p.high
            samples = plain[a:b] if plain is not None else _samples(blocks[a:b] * image.tables[p.table])
            plane = samples.reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.high, 8 * p.wide)
            if (p.h, p.v) != (most_h, most_v):
                plane = plane.repeat(most_v // p.v, axis=0).repeat(most_h // p.h, axis=1)
            planes.append(plane[: image.height, : image.width])
        if len(planes) == 1:
            rgb = np.stack([planes[0]] * 3, axis=2)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.empty((image.height, image.width, 3), np.int32)  # colour factors times 2^16
            rgb[:, :, 0] = y + ((91_881 * cr + 32_768) >> 16)
            rgb[:, :, 1] = y - ((22_554 * cb + 46_802 * cr + 32_768) >> 16)
            rgb[:, :, 2] = y + ((116_130 * cb + 32_768) >> 16)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out
