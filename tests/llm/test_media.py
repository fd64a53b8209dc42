from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import jpeg, media


def units(payloads):
    ends = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    return media.store(np.frombuffer(b"".join(payloads), np.uint8), ends)


def padded(p):
    return p + b"\0" * ((-len(p)) % 64 or (0 if p else 64))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=900), st.integers(126, 131).map(lambda b: bytes([b]) * 500), st.lists(st.sampled_from([127, 128, 129, 200]), max_size=400).map(bytes)), min_size=1, max_size=6))
def test_payloads_survive(payloads):
    for p, s in zip(payloads, units(payloads), strict=True):
        assert s.payload == padded(p)
        (im,) = jpeg.decode([s.media])
        assert (jpeg.rgb(im) == s.tensor).all() and s.tensor.shape == (im.height, im.width, 3)


def test_equal_payloads_give_equal_files_whatever_is_beside_them():
    a, b = b"some text" * 50, bytes(range(256)) * 9
    first, second = units([a, b]), units([b, a, a])
    assert first[0] == first[0] and [first[0].media, first[1].media] == [second[1].media, second[0].media]
    assert first[0].feature == second[2].feature


def reference_bits(file):
    """The entropy-coded bits of each scan, the tables and the frame's header, read the plain way."""
    at, tables, scans, restart, frame = 2, {}, [], 0, b""
    while file[at + 1] != 0xD9:
        m, n = file[at + 1], struct.unpack(">H", file[at + 2 : at + 4])[0]
        body, at = file[at + 4 : at + 2 + n], at + 2 + n
        if m == 0xC2:
            frame = body
        if m == 0xC4:
            tables[body[0]] = body[1:]
        if m == 0xDD:
            restart = struct.unpack(">H", body)[0]
        if m == 0xDA:
            lanes, cur = [], bytearray()
            while True:
                if file[at] == 255 and file[at + 1] == 0:
                    cur.append(255)
                    at += 2
                elif file[at] == 255 and 0xD0 <= file[at + 1] <= 0xD7:
                    lanes.append(bytes(cur))
                    cur, at = bytearray(), at + 2
                elif file[at] == 255:
                    break
                else:
                    cur.append(file[at])
                    at += 1
            scans.append((body, [*lanes, bytes(cur)]))
    return tables, scans, restart, frame


class Bits:
    """Bits of one segment, one after the other."""

    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        assert self.at <= len(self.bits)
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self, codes):
        n = next(n for n in range(1, 17) if self.bits[self.at : self.at + n] in codes)
        self.at += n
        return codes[self.bits[self.at - n : self.at]]

    def value(self, n):
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def code_words(table):
    out, code, k = {}, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[f"{code:0{n}b}"] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def first_pass(bits, block, codes, low, high, left):
    k = low
    while k <= high:
        zeros, size = divmod(bits.symbol(codes), 16)
        if not size and zeros < 15:
            assert not zeros  # a segment is one block, so no run of ended blocks is longer
            return
        k += zeros
        if size:
            block[k] = bits.value(size) * 2**left
        k += 1


def refining_pass(bits, block, codes, low, high, left):
    def correct(k):
        if bits.take(1):
            block[k] += 2**left if block[k] > 0 else -(2**left)

    k = low
    while k <= high:
        zeros, size = divmod(bits.symbol(codes), 16)
        if not size and zeros < 15:
            assert not zeros
            break
        assert size <= 1
        new = (2**left if bits.take(1) else -(2**left)) if size else 0
        while k <= high and (block[k] or zeros):
            if block[k]:
                correct(k)
            else:
                zeros -= 1
            k += 1
        if k <= high:
            block[k] = new
        k += 1
    for rest in range(k, high + 1):
        if block[rest]:
            correct(rest)


def plain_units(file):
    """All coefficients of a file, units by rows, a bit at a time."""
    tables, scans, restart, frame = reference_bits(file)
    assert restart == 1 and len(scans) == len(jpeg.SCRIPT)
    rows, cols = (x // 16 for x in struct.unpack(">HH", frame[1:5]))
    parts = [[[0] * 64 for _ in range(rows * cols * n)] for n in (4, 1, 1)]
    places = [[(0, (2 * r + i) * 2 * cols + 2 * c + j) for i in (0, 1) for j in (0, 1)] + [(1, r * cols + c), (2, r * cols + c)] for r in range(rows) for c in range(cols)]
    for head, lanes in scans:
        low, high, bits_ = head[-3:]
        before, left = divmod(bits_, 16)
        inside = [(head[1 + 2 * k] - 1, head[2 + 2 * k]) for k in range(head[0])]
        todo = places if len(inside) == 3 else [[(inside[0][0], k)] for k in range(len(parts[inside[0][0]]))]
        assert len(lanes) == len(todo)
        for data, blocks in zip(lanes, todo, strict=True):
            bits, last = Bits(data), [0, 0, 0]
            for comp, at in blocks:
                block, which = parts[comp][at], dict(inside)[comp]
                if low == 0 and before:
                    block[0] += bits.take(1) * 2**left
                elif low == 0:
                    last[comp] += bits.value(bits.symbol(code_words(tables[which >> 4])))
                    block[0] = last[comp] * 2**left
                else:
                    (refining_pass if before else first_pass)(bits, block, code_words(tables[16 | which & 15]), low, high, left)
            assert len(bits.bits) - bits.at < 8 and "0" not in bits.bits[bits.at :]
    return np.array([[parts[c][k] for c, k in unit] for unit in places])


def test_all_scans_by_a_plain_decoder():
    payload = padded(("Progressive scans, é " * 60).encode())
    got = plain_units(units([payload])[0].media).reshape(-1, 64)
    n = len(payload) // 64
    assert (got[:n].ravel() + 128).astype(np.uint8).tobytes() == payload and not got[n:].any()


def test_sparse_coefficients_by_a_plain_decoder():
    """Long runs of zeros before and between values that the first pass, the second or neither sees."""
    rng = np.random.default_rng(8)
    blocks = rng.choice([0, 0, 0, 0, 0, 0, 1, -1, 2, -3, 300, -511], (6, jpeg.PER_UNIT, 64)).astype(np.int16)
    blocks[0] = 0
    blocks[1, :, :60] = 0
    blocks[2, :, 20:] = 0
    blocks[3, :, 1:63], blocks[3, :, 63] = 0, -1
    wide, high = jpeg.grid(np.array([6]))
    (file,) = jpeg.encode(np.concatenate([blocks, np.zeros((int(wide[0] * high[0]) - 6, jpeg.PER_UNIT, 64), np.int16)]), wide, high, [b"6"])
    assert (plain_units(file)[:6] == blocks).all()
    (im,) = jpeg.decode([file])
    assert (media.from_image(im).reshape(-1, jpeg.PER_UNIT, 64)[:6] == blocks).all()


def test_headers_are_read_and_other_files_refused():
    s = units([b"x" * 60])[0]
    (im,) = jpeg.decode([s.media])
    assert len(im.scans) == len(jpeg.SCRIPT) and im.comps[0][1:3] == (2, 2)
    with pytest.raises(ValueError):
        jpeg.decode([b"GIF89a not a JPEG file"])


def test_inverse_transform_matches_the_cosine_sum():
    rng = np.random.default_rng(0)
    block = rng.integers(-20, 20, (3, 64))
    want = np.zeros((3, 8, 8))
    for k, cell in enumerate(jpeg.ZIGZAG):
        u, v = divmod(int(cell), 8)
        cu, cv = (np.sqrt(0.5) if w == 0 else 1 for w in (u, v))
        y, x = np.mgrid[0:8, 0:8]
        want += block[:, k, None, None] * cu * cv / 4 * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16)
    got = jpeg.samples(block, np.ones(64, np.int64)).astype(float)
    assert np.abs(got - np.clip(want + 128, 0, 255)).max() <= 1
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_column_over_odd_rows(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (1, "abc"), (None, "é" * 5000), (4, "x" * 64), (5, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, feature string, n_bytes int")
    got = media.media_column(df, with_media=True).collect()
    assert len(got) == len(rows)
    by = {r.n_bytes: r for r in got}
    for _, t in rows:
        b = (t or "").encode()
        r, p = by[len(b)], padded(b)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert f"{zlib.crc32(r.tensor):08x}" == r.feature.rpartition(":")[2]
    assert media.media_column(df.limit(0)).count() == 0
