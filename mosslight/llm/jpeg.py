"""Baseline JPEG: marker parsing, Huffman decoding in numpy, and a lossless byte container.

``decode`` takes a list of baseline files. Restart intervals are independent of each other,
so all intervals of all files with the same tables and layout are decoded in lockstep: one
numpy step reads the next Huffman code of every interval.

``encode`` stores bytes losslessly as the quantised coefficients of a grey image, 64 to a
block. A coefficient of size category 8 has exactly 256 values, told apart by 8 extra bits;
those bits are the byte. Its one-symbol code takes one bit more. Every block is a restart
interval, so a damaged block harms no other. A comment segment tells how many bytes count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass
class Component:
    h: int
    v: int
    quant: int
    dc: bytes = b""
    ac: bytes = b""


@dataclass
class Picture:
    """What the markers say, the entropy-coded bytes, and after ``decode`` the coefficients.

    ``blocks``: for each component an array (rows, columns, 64) of quantised coefficients in zigzag order.
    """

    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    components: dict[int, Component] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    scan: bytes = b""
    blocks: list[np.ndarray] = field(default_factory=list)

    @property
    def mcus(self) -> tuple[int, int]:
        if len(self.order) == 1:
            return -(-self.height // 8), -(-self.width // 8)
        v, h = max(c.v for c in self.components.values()), max(c.h for c in self.components.values())
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def layout(self) -> tuple:
        single = len(self.order) == 1
        return tuple((1, 1) if single else (self.components[i].v, self.components[i].h) for i in self.order)

    def luminance(self) -> np.ndarray:
        """The DC-only thumbnail: a pixel for each luminance block, 8 bits."""
        first = self.components[self.order[0]]
        dc = self.blocks[0][:, :, 0].astype(np.float64) * int(self.quants[first.quant][0]) / 8 + 128
        return np.clip(np.rint(dc), 0, 255).astype(np.uint8)


def parse(data: bytes) -> Picture:
    """Markers up to the scan; raises ValueError for what isn't a whole baseline file of one scan."""
    try:
        found = _markers(data)
    except (IndexError, KeyError, TypeError) as e:
        raise ValueError("the file is cut short or a table is missing") from e
    if not found.components or any(c.h == 0 or c.v == 0 or c.quant not in found.quants for c in found.components.values()):
        raise ValueError("the frame or a table is missing")
    if len(found.order) != len(found.components):
        raise ValueError("not a baseline file of one scan")
    if not found.width or not found.height:
        raise ValueError("the picture has no size")
    return found


def _markers(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    p, at, tables = Picture(), 2, {}
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        while data[at + 1] == 0xFF:
            at += 1
        kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xC0:
            p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            p.components = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif kind == 0xC4:
            while body:
                n_codes = sum(body[1:17])
                tables[body[0]], body = bytes(body[1 : 17 + n_codes]), body[17 + n_codes :]
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                p.quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1)
                body = body[65 + 64 * wide :]
        elif kind == 0xDD:
            p.restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            p.comment = bytes(body)
        elif kind == 0xDA:
            for i in range(body[0]):
                c = p.components[body[1 + 2 * i]]
                c.dc, c.ac = tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]
                p.order.append(body[1 + 2 * i])
            end = _END.search(data, at)
            p.scan = data[at : end.start() if end else len(data)]
            return p


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length * 256 + symbol, or 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, dtype=np.uint16), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """All intervals' bytes in a row; ``at`` is each interval's next bit."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
        n = len(data) + 4
        self.words = padded[:n] << np.uint32(24) | padded[1 : n + 1] << np.uint32(16) | padded[2 : n + 2] << np.uint32(8) | padded[3 : n + 3]
        self.at, self.last = starts.astype(np.int64) * 8, 8 * len(data) + 24

    def symbol(self, who: np.ndarray | slice, table: np.ndarray) -> np.ndarray:
        at = self.at[who]
        if at.size and at.max() > self.last:
            raise ValueError("the scan is too short")
        found = table[self.words[at >> 3] << (at & 7).astype(np.uint32) >> np.uint32(16)]
        if not found.all():
            raise ValueError("no Huffman code fits")
        self.at[who] = at + (found >> np.uint16(8))
        return (found & np.uint16(0xFF)).astype(np.int64)

    def extra(self, who: np.ndarray | slice, size: np.ndarray) -> np.ndarray:
        at = self.at[who]
        bits = (self.words[at >> 3] << (at & 7).astype(np.uint32)).astype(np.int64) >> (32 - size)
        self.at[who] = at + size
        return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _block(bits: _Bits, n: int, who: np.ndarray | slice, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """The next block of the intervals ``who``, n of them: DC difference and AC coefficients."""
    out = np.zeros((n, BLOCK), dtype=np.int16)
    every = np.arange(n)
    out[:, 0] = bits.extra(who, bits.symbol(who, dc))
    k, act = np.ones(n, dtype=np.int64), every
    while len(act):
        sel = who if len(act) == n else (act if isinstance(who, slice) else who[act])
        sym = bits.symbol(sel, ac)
        size = sym & 15
        value = bits.extra(sel, size)
        k[act] += sym >> 4
        if (size > 0).all():
            if k[act].max() >= BLOCK:
                raise ValueError("a run leaves the block")
            out[act, k[act]] = value
            k[act] += 1
        else:
            k[act[sym == 0]] = BLOCK
            k[act[sym == 0xF0]] += 1
            put = act[size > 0]
            if len(put) and k[put].max() >= BLOCK:
                raise ValueError("a run leaves the block")
            out[put, k[put]] = value[size > 0]
            k[put] += 1
        act = act[k[act] < BLOCK]
    return out


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without stuffing and markers; where intervals start; how many each scan has."""
    data = np.frombuffer(b"".join(s + b"\xff\xd9" for s in scans), dtype=np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]
    keep = np.ones(len(data), dtype=bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    ends = np.cumsum([len(s) + 2 for s in scans])
    first = np.r_[0, ends[:-1]]
    starts = np.sort(np.r_[first, marks[data[marks + 1] != 0xD9] + 2])
    return data[keep], place[starts], np.searchsorted(starts, ends) - np.searchsorted(starts, first)


def decode(files: list[bytes]) -> list[Picture]:
    pictures = [parse(f) for f in files]
    groups: dict[tuple, list[Picture]] = {}
    for p in pictures:
        tables = tuple((p.components[i].dc, p.components[i].ac) for i in p.order)
        groups.setdefault((tables, p.layout(), p.restart or p.mcus), []).append(p)
    for (tables, layout, _), group in groups.items():
        _decode_group(group, tables, layout)
    return pictures


def _decode_group(group: list[Picture], tables: tuple, layout: tuple) -> None:
    luts = {t: lookup(t) for pair in tables for t in pair}
    data, starts, counts = _intervals([p.scan for p in group])
    totals = np.array([p.mcus[0] * p.mcus[1] for p in group])
    step = group[0].restart or int(totals[0])
    if not (counts == -(-totals // step)).all():
        raise ValueError("restart intervals are missing")
    bits, n = _Bits(data, starts), len(starts)
    begun = np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(step, np.repeat(totals, counts) - (np.arange(n) - begun) * step)
    coefs = [np.zeros((n, step, v * h, BLOCK), dtype=np.int16) for v, h in layout]
    for m in range(step):
        who = slice(None) if (size > m).all() else np.flatnonzero(size > m)
        some = n if isinstance(who, slice) else len(who)
        for c, (dc, ac) in zip(coefs, tables, strict=True):
            for b in range(c.shape[2]):
                c[who, m, b] = _block(bits, some, who, luts[dc], luts[ac])
    at = 0
    for c in coefs:
        if c.shape[1] * c.shape[2] > 1:
            flat = c.reshape(n, -1, BLOCK)
            flat[:, :, 0] = np.cumsum(flat[:, :, 0], axis=1, dtype=np.int64)
    for p, count, total in zip(group, counts.tolist(), totals.tolist(), strict=True):
        rows, cols = p.mcus
        for c, (v, h) in zip(coefs, layout, strict=True):
            own = c[at : at + count].reshape(-1, v, h, BLOCK)[:total]
            p.blocks.append(own.reshape(rows, cols, v, h, BLOCK).transpose(0, 2, 1, 3, 4).reshape(rows * v, cols * h, BLOCK))
        at += count


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


#: A code of one bit for the one symbol: size category 8 after no zeros.
_ONE_SYMBOL = bytes([1, *[0] * 15, 8])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A grey baseline file for each payload, whose length is a positive multiple of 64."""
    shapes = []
    for p in payloads:
        n = len(p) // BLOCK
        cols = min(8191, int(np.ceil(np.sqrt(n))))
        shapes.append((-(-n // cols), cols))
    whole = b"".join(p + bytes(BLOCK * r * c - len(p)) for p, (r, c) in zip(payloads, shapes, strict=True))
    x = np.frombuffer(whole, dtype=np.uint8).reshape(-1, 8, 8)
    out = np.empty((len(x), 74), dtype=np.uint8)
    codes = out[:, :72].reshape(-1, 8, 9)
    codes[:, :, 0] = x[:, :, 0] >> 1
    for k in range(1, 8):
        codes[:, :, k] = (x[:, :, k - 1] & ((1 << k) - 1)) << (8 - k) | x[:, :, k] >> (k + 1)
    codes[:, :, 8] = x[:, :, 7]
    out[:, :72] = codes.reshape(-1, 72)
    counts = np.array([r * c for r, c in shapes])
    begun = np.cumsum(counts) - counts
    out[:, 72] = 0xFF
    out[:, 73] = 0xD0 + (np.arange(len(x)) - np.repeat(begun, counts)) % 8
    stuffed = np.flatnonzero((out[:, :72] == 0xFF).ravel())
    at = stuffed // 72 * 74 + stuffed % 72
    flat = np.insert(out.ravel(), at + 1, 0).tobytes()
    cuts = (begun * 74 + np.searchsorted(at, begun * 74)).tolist() + [len(flat)]
    files = []
    for i, (p, (rows, cols)) in enumerate(zip(payloads, shapes, strict=True)):
        head = b"".join(
            [
                b"\xff\xd8",
                _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
                _segment(0xFE, b"payload=%d" % len(p)),
                _segment(0xDB, b"\0" + b"\1" * 64),
                _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * cols).to_bytes(2, "big") + b"\1\1\x11\0"),
                _segment(0xC4, b"\x00" + _ONE_SYMBOL + b"\x10" + _ONE_SYMBOL),
                _segment(0xDD, b"\0\1"),
                _segment(0xDA, b"\1\1\0\0\x3f\0"),
            ]
        )
        files.append(head + flat[cuts[i] : cuts[i + 1] - 2] + b"\xff\xd9")
    return files


def payload(picture: Picture) -> bytes | None:
    """The bytes that ``encode`` stored in a picture; None if it comes from elsewhere."""
    mark = re.fullmatch(rb"payload=(\d+)", picture.comment)
    values = picture.blocks[0].reshape(-1)
    if not mark or int(mark[1]) > len(values):
        return None
    values = values[: int(mark[1])]
    if (values == 0).any() or (np.abs(values) > 255).any():
        return None
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()
