"""Progressive JPEG in numpy: many images at once, each restart segment a lane of one vector computation.

`encode` writes coefficient blocks as a progressive file with spectral selection and successive approximation;
`decode` accumulates the scans of any progressive Huffman-coded file into coefficient arrays; `rgb` transforms these
back, upsamples chroma and converts to RGB.  Coefficients survive without loss; all arithmetic is on whole numbers.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Sampling of the files that `encode` writes: (identifier, horizontal, vertical); blocks in each of their units.
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
PER_UNIT = 6
#: (components, first and last coefficient, bits left before and after): the scans that `encode` writes.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), low, high, 0, 1) for low, high in ((1, 5), (6, 63)) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 63, 1, 0) for c in range(3)),
)


def _zigzag() -> np.ndarray:
    """The raster index of each coefficient in zigzag order."""
    cells = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * x + y for x, y in cells])


ZIGZAG = _zigzag()


def _basis(bits: int = 10) -> np.ndarray:
    """Row k: what coefficient k (in zigzag order) adds to the 64 samples, times 2**bits, as whole numbers."""
    u, x = np.mgrid[0:8, 0:8]
    a = np.where(u == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", a, a).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << bits))


BASIS = _basis()


def _codes(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Canonical Huffman codes for symbol -> length: the table's bytes in a file, codes and lengths by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes, size = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], size[s] = code, last
        code += 1
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return counts + bytes(order), codes, size


#: Four bits for each size of a difference; for other coefficients four bits for a value after no zeros and for the end
#: of a block, and nine for all else.
DC_TABLE = _codes(dict.fromkeys(range(12), 4))
AC_TABLE = _codes({r << 4 | s: 4 if (r == 0 and s < 8) else 9 for r in range(16) for s in range(11)})


# --- writing -----------------------------------------------------------------------------------------------------


class _Writer:
    """Bits of many lanes."""

    def __init__(self, lanes: int, room: int):
        self.acc, self.n = np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
        self.out, self.at = np.zeros((lanes, room // 4 + 2), np.uint32), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray, code: np.ndarray, size: np.ndarray) -> None:
        """Appends codes of at most 32 bits to the lanes (indices, or a slice for all)."""
        acc = self.acc[lanes] << size.astype(np.uint64) | code.astype(np.uint64)
        n = self.n[lanes] + size
        full = np.flatnonzero(n >= 32)
        if len(full):
            at = full if isinstance(lanes, slice) else lanes[full]
            n[full] -= 32
            self.out[at, self.at[at]] = (acc[full] >> n[full].astype(np.uint64)).astype(np.uint32)
            self.at[at] += 1
        self.acc[lanes], self.n[lanes] = acc, n

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """All lanes' bytes end to end, padded with ones and with a zero after each 255, and their lengths."""
        size = self.at * 4 + (self.n + 7) // 8
        pad = (-self.n) % 8
        acc, n = self.acc << pad.astype(np.uint64) | ((1 << pad) - 1).astype(np.uint64), self.n + pad
        rest = np.where(n > 0, acc << (32 - n).astype(np.uint64), 0).astype(np.uint32)
        self.out[np.arange(len(rest)), self.at] = rest
        raw = self.out.astype(">u4").view(np.uint8)
        flat = raw[np.arange(raw.shape[1]) < size[:, None]]
        stuffed = np.repeat(flat, 1 + (flat == 255))
        ends = np.concatenate([[0], np.cumsum(1 + (flat == 255))])
        stuffed[ends[1:][flat == 255] - 1] = 0
        return stuffed, np.diff(ends[np.concatenate([[0], np.cumsum(size)])])


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(v.astype(np.float32))[1].astype(np.int64)


def _put_value(w: _Writer, lanes, table, symbol: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
    """The symbol's code and the value's bits (negative: one less, low bits only)."""
    code, n = table[1][symbol], table[2][symbol]
    w.put(lanes, code << size | (np.where(v < 0, v - 1, v) & ((1 << size) - 1)), n + size)


def _write_first(blocks: np.ndarray, low: int, high: int, left: int) -> _Writer:
    """First pass over coefficients low to high of each block (a lane)."""
    w = _Writer(len(blocks), 4 * (high - low + 2))
    run = np.zeros(len(blocks), np.int64)
    band = blocks[:, low : high + 1].T.astype(np.int64)
    for c in np.sign(band) * (np.abs(band) >> left):
        some = np.flatnonzero(c)
        if len(some):
            while len(far := some[run[some] > 15]):
                w.put(far, np.full(len(far), AC_TABLE[1][0xF0]), np.full(len(far), AC_TABLE[2][0xF0]))
                run[far] -= 16
            v = c[some]
            size = _size(np.abs(v))
            _put_value(w, slice(None) if len(some) == len(c) else some, AC_TABLE, run[some] << 4 | size, v, size)
        run += 1
        run[some] = 0
    end = np.flatnonzero(run)
    w.put(end, np.full(len(end), AC_TABLE[1][0]), np.full(len(end), AC_TABLE[2][0]))
    return w


def _write_refined(blocks: np.ndarray, low: int, high: int, left: int) -> _Writer:
    """The next bit of coefficients low to high of each block (a lane)."""
    lanes = len(blocks)
    w = _Writer(lanes, 3 * (high - low + 2) + 16)
    run, bits, n = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
    band = blocks[:, low : high + 1].T.astype(np.int64)
    value = np.abs(band) >> left
    new = value == 1
    last_new = np.where(new.any(0), len(value) - 1 - new[::-1].argmax(0), -1)

    def flush(at: np.ndarray) -> None:
        for some, size, b in ((at[n[at] > 32], 32, None), (at, None, None)):
            if len(some):
                own = n[some] if size is None else n[some] - 32
                w.put(some, (bits[some] >> (n[some] - own).astype(np.uint64)) & ((np.uint64(1) << own.astype(np.uint64)) - np.uint64(1)), own)
                n[some] -= own
        bits[at], n[at] = 0, 0

    for k, v in enumerate(value):
        zero = v == 0
        run += zero
        far = np.flatnonzero(~zero & (run > 15) & (k <= last_new))
        while len(far):
            w.put(far, np.full(len(far), AC_TABLE[1][0xF0]), np.full(len(far), AC_TABLE[2][0xF0]))
            flush(far)
            run[far] -= 16
            far = far[run[far] > 15]
        old = v > 1
        bits[old] = bits[old] << np.uint64(1) | (v[old] & 1).astype(np.uint64)
        n += old
        at = np.flatnonzero(v == 1)
        if len(at):
            symbol = run[at] << 4 | 1
            w.put(at, AC_TABLE[1][symbol] << 1 | (band[k][at] > 0), AC_TABLE[2][symbol] + 1)
            flush(at)
            run[at] = 0
    end = np.flatnonzero((run > 0) | (n > 0))
    w.put(end, np.full(len(end), AC_TABLE[1][0]), np.full(len(end), AC_TABLE[2][0]))
    flush(end)
    return w


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def grid(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units a row and rows for each number of units: about square."""
    wide = np.ceil(np.sqrt(units)).astype(np.int64)
    return wide, -(-units // wide)


def encode(units: np.ndarray, wide: np.ndarray, high: np.ndarray, notes: list[bytes]) -> list[bytes]:
    """Files from coefficient blocks.

    units: all images' units of PER_UNIT blocks (four of luma, two of chroma) of 64 coefficients in zigzag order, row by
    row, as -128 to 127.  wide, high: units in each image's row and column.  notes: a comment for each.
    """
    count = wide * high
    ends = np.concatenate([[0], np.cumsum(count)])
    image = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(image)) - ends[image]
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
    tables = _segment(0xC4, b"\x00" + DC_TABLE[0]) + _segment(0xC4, b"\x10" + AC_TABLE[0]) + _segment(0xDD, b"\0\1")
    parts = [[head, _segment(0xFE, note), _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes(v for i, a, b in COMPONENTS for v in (i, a << 4 | b, 0))), tables] for note, w, h in zip(notes, wide.tolist(), high.tolist(), strict=True)]
    # lanes of a component's own scan: its blocks row by row
    y, x = place // wide[image], place % wide[image]
    luma = np.stack([(2 * y + r) * 2 * wide[image] + 2 * x + c for r in (0, 1) for c in (0, 1)], 1) + 4 * ends[image][:, None]
    own = [np.empty((4 * len(units), 64), units.dtype), units[:, 4], units[:, 5]]
    own[0][luma.ravel()] = units[:, :4].reshape(-1, 64)
    for comps, low, high_, before, left in SCRIPT:
        sos = _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([COMPONENTS[c][0], 0]) for c in comps) + bytes([low, high_, before << 4 | left]))
        if low == 0:
            w, factor = _Writer(len(units), 32), 1
            dc = units[:, :, 0].astype(np.int64) >> left
            last = np.zeros((3, len(units)), np.int64)
            for k in range(PER_UNIT):
                v = dc[:, k]
                if before:
                    w.put(slice(None), v & 1, np.ones(len(v), np.int64))
                else:
                    c = max(0, k - 3)
                    d = v - last[c]
                    last[c] = v
                    size = _size(np.abs(d))
                    _put_value(w, slice(None), DC_TABLE, size, d, size)
        else:
            factor = 4 if comps[0] == 0 else 1
            w = (_write_refined if before else _write_first)(own[comps[0]], low, high_, left)
        data, size = w.lanes()
        # a restart marker after each lane but an image's last
        at = np.concatenate([[0], np.cumsum(size + 2)])
        full = np.empty(at[-1], np.uint8)
        lane = np.repeat(np.arange(len(size)), size)
        full[np.arange(len(data)) + 2 * lane] = data
        full[at[1:] - 2] = 255
        full[at[1:] - 1] = 0xD0 + (np.arange(len(size)) - factor * np.repeat(ends[:-1], factor * count)) % 8
        raw, bounds = full.tobytes(), at[factor * ends].tolist()
        for p, a, z in zip(parts, bounds[:-1], bounds[1:], strict=True):
            p += [sos, raw[a : z - 2]]
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


# --- reading -----------------------------------------------------------------------------------------------------


@dataclass
class Scan:
    comps: tuple[tuple[int, int, int], ...]  # index, DC table, AC table
    low: int
    high: int
    before: int
    left: int
    restart: int
    tables: tuple
    starts: np.ndarray  # of the entropy-coded segments between restart markers

    def kind(self) -> tuple:
        return self.comps, self.low, self.high, self.before, self.left, self.restart, self.tables


@dataclass
class Image:
    width: int = 0
    height: int = 0
    note: bytes = b""
    comps: list[tuple[int, int, int, int]] = field(default_factory=list)  # identifier, horizontal, vertical, quantiser
    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    coefficients: list[np.ndarray] = field(default_factory=list)  # rows, columns, 64 (zigzag), for each component

    def most(self) -> tuple[int, int]:
        return max(c[1] for c in self.comps), max(c[2] for c in self.comps)


def parse(data: bytes, base: int, marks: np.ndarray, stops: np.ndarray) -> Image:
    """Headers and the places of entropy-coded segments.

    marks: places of all markers in the buffer in which data begins at base; stops: of those that end a scan.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at, tables, restart = Image(), 2, {}, 0
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("no marker where one should be")
        m = data[at + 1]
        if m == 0xD9:
            break
        if m == 0xFF:
            at += 1
            continue
        n = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if m == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                out.quant[body[i] & 15] = struct.unpack(">64H", body[i + 1 : i + 129]) if wide else tuple(body[i + 1 : i + 65])
                i += 129 if wide else 65
        elif m == 0xC4:
            i = 0
            while i < len(body):
                size = 17 + sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + size]
                i += size
        elif m == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= m <= 0xCF and m != 0xCC:
            raise ValueError("only progressive Huffman-coded files can be read")
        elif m == 0xDD:
            restart = body[0] << 8 | body[1]
        elif m == 0xFE:
            out.note = body
        elif m == 0xDA:
            ids = [c[0] for c in out.comps]
            comps = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            low, high, approx = body[-3:]
            k = int(np.searchsorted(stops, base + at))
            stop = int(stops[k]) if k < len(stops) and stops[k] < base + len(data) - 1 else base + len(data)
            inner = marks[np.searchsorted(marks, base + at) : np.searchsorted(marks, stop)]
            out.scans.append(Scan(comps, low, high, approx >> 4, approx & 15, restart, tuple(sorted(tables.items())), np.concatenate([[base + at], inner + 2])))
            at = stop - base
    return out


def _lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits (length 0: no such code)."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for size in range(1, 17):
        for s in table[at : at + table[size - 1]]:
            out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | s
            code += 1
        at += table[size - 1]
        code <<= 1
    return out


class _Reader:
    def __init__(self, words: np.ndarray, start: np.ndarray):
        self.words, self.pos, self.end = words, start * 8, len(words) - 1

    def _window(self, pos: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(pos >> 3, self.end)] << (pos & 7).astype(np.uint32)

    def symbol(self, lanes, table: np.ndarray) -> np.ndarray:
        pos = self.pos[lanes]
        got = table[self._window(pos) >> np.uint32(16)]
        self.pos[lanes] = pos + np.maximum(got >> 8, 1)
        return got & 255

    def bits(self, lanes, n: np.ndarray) -> np.ndarray:
        """The next n (0 to 16) bits."""
        pos = self.pos[lanes]
        self.pos[lanes] = pos + n
        return (self._window(pos).astype(np.uint64) >> (32 - n).astype(np.uint64)).astype(np.int64)

    def bit(self, lanes) -> np.ndarray:
        pos = self.pos[lanes]
        self.pos[lanes] = pos + 1
        return (self._window(pos) >> np.uint32(31)).astype(np.int64)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < 1 << np.maximum(n - 1, 0)), v - (1 << n) + 1, v)


def _read_first(r: _Reader, lanes: np.ndarray, out: np.ndarray, at: np.ndarray, s: Scan, table: np.ndarray, eob: np.ndarray) -> None:
    """One block of each lane; out[at[i]] are its coefficients."""
    waiting = eob[lanes] > 0
    eob[lanes[waiting]] -= 1
    lanes, at = lanes[~waiting], at[~waiting]
    k = np.full(len(lanes), s.low)
    while len(lanes):
        sym = r.symbol(lanes, table)
        run, n = sym >> 4, sym & 15
        end = (n == 0) & (run < 15)
        v = _extend(r.bits(lanes, np.where(end, run, n).astype(np.int64)), n) if not end.any() else None
        if v is None:
            raw = r.bits(lanes, np.where(end, run, n).astype(np.int64))
            eob[lanes[end]] = (1 << run[end]) - 1 + raw[end]
            v = _extend(raw, n)
        k = k + run
        put = (n > 0) & (k <= s.high)
        if put.all():
            out[at, k] = v << s.left
        else:
            out[at[put], k[put]] = v[put] << s.left
        k = k + 1
        on = ~end & (k <= s.high)
        if not on.all():
            lanes, at, k = lanes[on], at[on], k[on]


def _read_refined(r: _Reader, lanes: np.ndarray, out: np.ndarray, at: np.ndarray, s: Scan, table: np.ndarray, eob: np.ndarray) -> None:
    pending = np.zeros(len(lanes), bool)
    run, val = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    rest = eob[lanes]
    one = 1 << s.left
    block = out[at]
    for k in range(s.low, s.high + 1):
        need = np.flatnonzero(~pending & (rest == 0))
        if len(need):
            sym = r.symbol(lanes[need], table)
            zeros, n = sym >> 4, sym & 15
            end = (n == 0) & (zeros < 15)
            rest[need[end]] = (1 << zeros[end]) + r.bits(lanes[need[end]], zeros[end].astype(np.int64))
            new = need[n > 0]
            val[need] = 0
            val[new] = np.where(r.bit(lanes[new]) > 0, one, -one)
            go = need[~end]
            pending[go], run[go] = True, zeros[~end]
        c = block[:, k]
        old = c != 0
        some = np.flatnonzero(old)
        if len(some):
            got = r.bit(slice(None) if len(some) == len(r.pos) else lanes[some])
            v = c[some]
            block[some, k] = v + np.where((got > 0) & ((np.abs(v) & one) == 0), np.sign(v) * one, 0)
        zero = np.flatnonzero(pending & ~old)
        if len(zero):
            stop = zero[run[zero] == 0]
            block[stop, k] = val[stop]
            pending[stop] = False
            run[zero] -= 1
    out[at] = block
    eob[lanes] = np.maximum(rest - 1, 0)


def decode(files: list[bytes]) -> list[Image]:
    """All files' coefficients.  Files whose headers agree (but for the size) are read side by side."""
    raw = np.frombuffer(b"".join(files) + b"\0" * 8, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & (raw[1:] != 255))
    stops = marks[(raw[marks + 1] & 0xF8) != 0xD0]
    stuffing = np.zeros(len(raw), bool)
    stuffing[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    plain = raw[~stuffing]
    new_place = np.arange(len(raw) + 1) - np.concatenate([[0], np.cumsum(stuffing)])
    wide = np.concatenate([plain, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = wide[:-4] << 24 | wide[1:-3] << 16 | wide[2:-2] << 8 | wide[3:-1]
    images, base = [], 0
    for f in files:
        images.append(parse(f, base, marks, stops))
        base += len(f)
    alike: dict[tuple, list[int]] = {}
    for i, im in enumerate(images):
        alike.setdefault((tuple(im.comps), tuple(s.kind() for s in im.scans)), []).append(i)
    for (comps, kinds), members in alike.items():
        if not comps:
            continue
        most = max(c[1] for c in comps), max(c[2] for c in comps)
        ims = [images[i] for i in members]
        units = [(-(-im.width // (8 * most[0])), -(-im.height // (8 * most[1]))) for im in ims]
        stores = []
        for _, h, v, _ in comps:  # whole units of each component, image after image
            shape = [(y * v, x * h) for x, y in units]
            ends = np.concatenate([[0], np.cumsum([a * b for a, b in shape])])
            stores.append((np.zeros((ends[-1], 64), np.int32), shape, ends))
        for k in range(len(kinds)):
            _read_scan(words, new_place, [im.scans[k] for im in ims], ims, comps, most, units, stores)
        for j, im in enumerate(ims):
            im.coefficients = [store[ends[j] : ends[j + 1]].reshape(*shape[j], 64) for store, shape, ends in stores]
    return images


def _places(size: tuple[int, int], units: tuple[int, int], scanned: tuple[int, ...], comps, most) -> np.ndarray:
    """Block indices (in each component's own rows of whole units) of every unit of a scan, a row each."""
    x, y = units
    if len(scanned) == 1:
        _, h, v, _ = comps[scanned[0]]
        cols, rows = -(-(-(-size[0] * h // most[0])) // 8), -(-(-(-size[1] * v // most[1])) // 8)
        return (np.arange(rows)[:, None] * (x * h) + np.arange(cols)).reshape(-1, 1)
    uy, ux = np.divmod(np.arange(x * y), x)
    return np.stack([(uy * comps[c][2] + b) * (x * comps[c][1]) + ux * comps[c][1] + a for c in scanned for b in range(comps[c][2]) for a in range(comps[c][1])], 1)


def _read_scan(words, new_place, scans: list[Scan], ims: list[Image], comps, most, units, stores) -> None:
    s = scans[0]
    tables = dict(s.tables)
    lookups = {key: _lookup(tables[key]) for c, dc, ac in s.comps for key in ((dc,) if s.low == 0 and not s.before else (16 | ac,) if s.low else ())}
    # the scan's units of each image, one after the other: places of their blocks in the stores
    which = [c for c, _, _ in s.comps for _ in range(comps[c][1] * comps[c][2])] if len(s.comps) > 1 else [s.comps[0][0]]
    local: dict[tuple[int, int], np.ndarray] = {}
    plans = []
    for j, im in enumerate(ims):
        size = im.width, im.height
        if size not in local:
            local[size] = _places(size, units[j], tuple(c for c, _, _ in s.comps), comps, most)
        plans.append(local[size] + np.array([stores[c][2][j] for c in which]))
    plan, count = np.concatenate(plans), np.array([len(p) for p in plans])
    step = s.restart or int(count.max())
    lanes_in = -(-count // step)
    within = np.arange(lanes_in.sum()) - np.repeat(np.cumsum(lanes_in) - lanes_in, lanes_in)
    first = np.repeat(np.cumsum(count) - count, lanes_in) + within * step
    size = np.minimum(step, np.repeat(count, lanes_in) - within * step)
    if any(len(sc.starts) < n for sc, n in zip(scans, lanes_in, strict=True)):
        raise ValueError("restart segments are missing")
    start = new_place[np.concatenate([sc.starts[:n] for sc, n in zip(scans, lanes_in.tolist(), strict=True)])]
    r = _Reader(words, start)
    table = {c: (dc, ac) for c, dc, ac in s.comps}
    eob = np.zeros(len(first), np.int64)
    last = {c: np.zeros(len(first), np.int64) for c in table}
    for step in range(int(size.max(initial=0))):
        lanes = np.flatnonzero(size > step)
        for k, c in enumerate(which):
            out, at = stores[c][0], plan[first[lanes] + step, k]
            if s.low:
                (_read_refined if s.before else _read_first)(r, lanes, out, at, s, lookups[16 | table[c][1]], eob)
            elif s.before:
                out[at, 0] |= r.bit(lanes) << s.left
            else:
                n = r.symbol(lanes, lookups[table[c][0]]).astype(np.int64)
                last[c][lanes] += _extend(r.bits(lanes, n), n)
                out[at, 0] = last[c][lanes] << s.left


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples of blocks (n, 64) in zigzag order, as (n, 8, 8).  Sums are exact, in whatever order."""
    scaled = blocks * quant
    kind = np.float32 if np.abs(scaled).sum(1).max(initial=0) * 256 < 1 << 24 else np.float64
    full = scaled.astype(kind) @ BASIS.astype(kind)
    return (np.clip((full.astype(np.int64) + (1 << 9) >> 10) + 128, 0, 255)).astype(np.uint8).reshape(-1, 8, 8)


def rgb(im: Image) -> np.ndarray:
    """The image as (height, width, 3) bytes; one component is grey, and chroma samples are repeated."""
    planes, (h_most, v_most) = [], im.most()
    for (_, h, v, q), c in zip(im.comps, im.coefficients, strict=True):
        rows, cols = c.shape[:2]
        s = samples(c.reshape(-1, 64), np.array(im.quant[q])).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
        planes.append(s.repeat(v_most // v, 0).repeat(h_most // h, 1)[: im.height, : im.width])
    return to_rgb(*planes) if len(planes) == 3 else np.repeat(planes[0][:, :, None], 3, 2)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Luma and chroma to RGB along a new last axis, in 16-bit fixed point."""
    y, cb, cr = y.astype(np.int32) << 16, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    out = np.stack([y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half], -1) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)
