"""Media columns as progressive JPEG.

The decoder follows ITU-T T.81: spectral-selection and successive-approximation scans are accumulated into one array of
quantised coefficients a component; these are inverse-transformed in numpy, chroma is upsampled, and full-resolution RGB
tensors come out. The transform loses bits, the coefficients don't: a payload is stored in the format's own unit, one
byte in each quantised coefficient, and read back from the accumulated arrays.

The writer maps a byte to a coefficient of 128 to 255 in size (both signs), so that all coefficients code alike: the
first scans hold the upper bits (direct current, then two bands), the refining scans the lowest. Runs of that regular
kind are decoded by array operations; anything else that the format allows goes symbol by symbol.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm.common import set_aside, slices, with_column

UNIT = 64
#: The largest side of an image in units of 16 pixels.
MOST_UNITS = 4095
NOTE = b"codexa payload "
BAND_UNITS = 2048


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()


def _inverse() -> np.ndarray:
    """64 coefficients in scan order times this: 64 samples of a block, row by row."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.kron(basis, basis)[ZIGZAG].astype(np.float32)


INVERSE = _inverse()


@dataclass
class Component:
    number: int
    across: int  # sampling factors
    down: int
    table: int
    wide: int = 0  # blocks of the padded plane
    high: int = 0
    own_wide: int = 0  # blocks that a scan of this component alone has
    own_high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    parts: list[Component]
    quant: dict[int, np.ndarray]
    notes: list[bytes]


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _scan(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c, d << 4 | a]) for c, d, a in parts) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _pack(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits of all values one after another, values[i] in sizes[i] bits."""
    ends = np.cumsum(sizes)
    place = np.repeat(ends, sizes) - 1 - np.arange(ends[-1] if len(ends) else 0)
    return (np.repeat(values, sizes) >> place & 1).astype(np.uint8)


def _bytes(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


#: Direct current: sizes 0 to 8 in four bits each. Bands: run 0 size 7 in one bit, ends of block runs in five.
_DC = bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])
_AC = bytes([0x10, 1, 0, 0, 0, 15, *[0] * 11, 0x07, *range(0, 0xF0, 0x10)])


def encode_payload(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A progressive 4:2:0 JPEG whose quantised coefficients hold the payload (a positive multiple of UNIT bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-len(payload) // (6 * UNIT))
    wide = max(isqrt(units), -(-units // MOST_UNITS))
    high = -(-units // wide)
    if wide > MOST_UNITS:
        raise ValueError("the payload doesn't fit into one image")
    n = wide * high
    data = np.zeros(6 * n * UNIT, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, UNIT)
    planes = [data[: 4 * n], data[4 * n : 5 * n], data[5 * n :]]
    order = _interleaved(wide, high, 2, 2)
    note = NOTE + f"{len(payload)} {len(payload) if n_bytes is None else n_bytes}".encode()
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, note), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, frame), _segment(0xC4, _DC + _AC)]
    dc = [p[:, 0].astype(np.int32) for p in planes]
    dc = [np.where(d >= 128, d, d - 255) for d in dc]
    dc[0] = dc[0][order]
    steps = [np.diff(d >> 1, prepend=0) for d in dc]
    seq = np.concatenate([steps[0].reshape(-1, 4), steps[1][:, None], steps[2][:, None]], axis=1).ravel()
    size = np.ceil(np.log2(np.abs(seq) + 1)).astype(np.int64)
    low = np.where(seq < 0, seq + (1 << size) - 1, seq)
    every = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    out.append(_scan(every, 0, 0, 0, 1, _bytes(_pack(size << size | low, size + 4))))
    for k, p in enumerate(planes):
        upper = p >> 1  # sign, then six bits, inverted for negatives: the byte's upper bits
        for a, b in ((1, 5), (6, 63)) if k == 0 else ((1, 63),):
            out.append(_scan([every[k]], a, b, 0, 1, np.ascontiguousarray(upper[:, a : b + 1]).tobytes()))
    lowest = [d & 1 for d in dc]
    seq = np.concatenate([lowest[0].reshape(-1, 4), lowest[1][:, None], lowest[2][:, None]], axis=1).ravel()
    out.append(_scan(every, 0, 0, 1, 0, _bytes(seq.astype(np.uint8))))
    for k, p in enumerate(planes):
        bits = ((p[:, 1:] & 1) ^ (p[:, 1:] < 128)).astype(np.uint8)  # of the size: a negative's byte is its complement
        runs = []
        for at in range(0, len(bits), 32767):
            part = bits[at : at + 32767]
            r = len(part).bit_length() - 1
            runs += [_pack(np.array([(0b10000 | r) << r | len(part) - (1 << r)]), np.array([5 + r])), part.ravel()]
        out.append(_scan([every[k]], 1, 63, 1, 0, _bytes(np.concatenate(runs))))
    return b"".join([*out, b"\xff\xd9"])


def _interleaved(wide: int, high: int, across: int, down: int) -> np.ndarray:
    """Blocks of a plane, wide * across to a row, in the order of interleaved units."""
    grid = np.arange(wide * across * high * down).reshape(high, down, wide, across)
    return grid.transpose(0, 2, 1, 3).ravel()


class _Codes:
    """A Huffman table: symbol and length for each 16-bit prefix."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.symbol, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = at = 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                i = code << 16 - size
                self.symbol[i : i + (1 << 16 - size)], self.length[i : i + (1 << 16 - size)] = symbols[at], size
                code, at = code + 1, at + 1
            code <<= 1
        self.plain = counts[0] == 1 and symbols[0] >> 4 == 0 and symbols[0] & 15 == 7
        self.lists: tuple[list[int], list[int]] | None = None

    def lookup(self) -> tuple[list[int], list[int]]:
        if self.lists is None:
            self.lists = self.symbol.tolist(), self.length.tolist()
        return self.lists


_tables: dict[bytes, _Codes] = {}


def _codes(counts: bytes, symbols: bytes) -> _Codes:
    key = counts + symbols
    if key not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[key] = _Codes(counts, symbols)
    return _tables[key]


class _Bits:
    """Bits of an entropy-coded stretch without stuffing; ones follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + b"\xff" * 8, 0

    def peek16(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3], "big") >> 8 - (self.at & 7) & 0xFFFF

    def take(self, n: int) -> int:
        i, end = self.at >> 3, self.at + n
        v = int.from_bytes(self.data[i : (end + 7) >> 3], "big") >> (-end & 7) & (1 << n) - 1
        self.at = end
        return v

    def many(self, n: int) -> np.ndarray:
        i = self.at >> 3
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, ((self.at + n + 7) >> 3) - i, i))[self.at & 7 :][:n]
        self.at += n
        return bits

    def symbol(self, codes: _Codes) -> int:
        symbols, lengths = codes.lookup()
        p = self.peek16()
        if not lengths[p]:
            raise ValueError("no such Huffman code")
        self.at += lengths[p]
        return symbols[p]

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> size - 1 else v - (1 << size) + 1


#: What ends a scan, and what parts its stretches.
_MARKER, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]"), re.compile(rb"\xff(?:[^\x00]|\Z)")


def decode(data: bytes) -> Image:
    """The image with the coefficients that all scans add up to; ValueError where the data isn't progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, quant, huff, notes, restart = 2, None, {}, {}, [], 0
    while True:
        if data[at : at + 1] != b"\xff":
            raise ValueError(f"no marker at byte {at}")
        while data[at + 1 : at + 2] == b"\xff":
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            notes.append(body)
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            image = _frame(body, quant, notes)
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before its frame")
            if (end := _MARKER.search(data, at)) is None:
                raise ValueError("a scan without end")
            _read_scan(image, body, data[at : end.start()], huff, restart)
            at = end.start()
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"frame type {marker:#x} isn't progressive Huffman JPEG")
    if image is None:
        raise ValueError("no frame")
    return image


def _frame(body: bytes, quant: dict[int, np.ndarray], notes: list[bytes]) -> Image:
    _, height, width, n = struct.unpack(">BHHB", body[:6])
    parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
    across, down = max(p.across for p in parts), max(p.down for p in parts)
    for p in parts:
        p.wide, p.high = -(-width // (8 * across)) * p.across, -(-height // (8 * down)) * p.down
        p.own_wide, p.own_high = -(-width * p.across // (8 * across)), -(-height * p.down // (8 * down))
        p.blocks = np.zeros((p.wide * p.high, 64), np.int32)
    return Image(width, height, parts, quant, notes)


def _read_scan(image: Image, head: bytes, data: bytes, huff: dict[int, _Codes], restart: int) -> None:
    n = head[0]
    chosen = [(next(p for p in image.parts if p.number == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    first, last, high, low = *head[1 + 2 * n : 3 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    stretches = [s.replace(b"\xff\0", b"\xff") for s in _RESTART.split(data)]
    if n == 1:
        p = chosen[0][0]
        orders = [(np.arange(p.own_high)[:, None] * p.wide + np.arange(p.own_wide)).ravel()]
        per_unit = [1]
    else:
        orders = [_interleaved(p.wide // p.across, p.high // p.down, p.across, p.down) for p, _ in chosen]
        per_unit = [p.across * p.down for p, _ in chosen]
    units = len(orders[0]) // per_unit[0]
    step = restart or units
    for k, s in enumerate(stretches):
        own = [o[k * step * m : (k + 1) * step * m] for o, m in zip(orders, per_unit, strict=True)]
        if first:
            (p, tables) = chosen[0]
            (_refine_band if high else _first_band)(p.blocks, own[0], first, last, low, s, huff[0x10 | tables & 15])
        elif high:
            _refine_dc([p for p, _ in chosen], own, per_unit, low, s)
        else:
            _first_dc([(p, huff[t >> 4]) for p, t in chosen], own, per_unit, low, s)


def _first_dc(chosen: list, own: list[np.ndarray], per_unit: list[int], low: int, data: bytes) -> None:
    bits, units = _Bits(data), len(own[0]) // per_unit[0]
    before, out = [0] * len(chosen), [[] for _ in chosen]
    raw, at = bits.data, 0
    plan = [(k, *codes.lookup()) for k, ((_, codes), m) in enumerate(zip(chosen, per_unit, strict=True)) for _ in range(m)]
    for _ in range(units):
        for k, symbols, lengths in plan:
            word = int.from_bytes(raw[at >> 3 : (at >> 3) + 5], "big")
            p = word >> 24 - (at & 7) & 0xFFFF
            n, size = lengths[p], symbols[p]
            if not n:
                raise ValueError("no such Huffman code")
            if size:
                if n + size > 32 - (at & 7):
                    bits.at = at + n
                    v = bits.take(size)
                else:
                    v = word >> 40 - (at & 7) - n - size & (1 << size) - 1
                before[k] += v if v >> size - 1 else v - (1 << size) + 1
            at += n + size
            out[k].append(before[k])
    for (p, _), o, d in zip(chosen, own, out, strict=True):
        p.blocks[o, 0] = np.array(d, np.int32) << low


def _refine_dc(parts: list[Component], own: list[np.ndarray], per_unit: list[int], low: int, data: bytes) -> None:
    bits = _Bits(data).many(sum(map(len, own))).reshape(-1, sum(per_unit))
    at = 0
    for p, o, m in zip(parts, own, per_unit, strict=True):
        p.blocks[o, 0] |= bits[:, at : at + m].ravel().astype(np.int32) << low
        at += m


def _first_band(blocks: np.ndarray, own: np.ndarray, first: int, last: int, low: int, data: bytes, codes: _Codes) -> None:
    width = last - first + 1
    raw = np.frombuffer(data, np.uint8)
    if codes.plain and len(raw) == len(own) * width and not (raw & 0x80).any():  # one byte a coefficient: code 0, seven bits
        v = raw.astype(np.int32)
        blocks[own, first : last + 1] = (np.where(v >= 64, v, v - 127) << low).reshape(-1, width)
        return
    bits, run = _Bits(data), 0
    for b in own.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(codes)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                if k > last:
                    raise ValueError("a run past its band")
                blocks[b, k] = bits.value(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _refine_band(blocks: np.ndarray, own: np.ndarray, first: int, last: int, low: int, data: bytes, codes: _Codes) -> None:
    bits, one, i = _Bits(data), 1 << low, 0
    while i < len(own):
        b, k = own[i], first
        while k <= last:
            s = bits.symbol(codes)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                rest = own[i : i + run]
                part = blocks[rest, first : last + 1]
                known = part != 0
                known[0, : k - first] = False
                more = np.zeros(part.shape, np.int32)
                more[known] = bits.many(int(known.sum()))
                blocks[rest, first : last + 1] = part + more * np.sign(part) * one
                i += run - 1
                break
            new = 0
            if size:
                new = one if bits.take(1) else -one
            while k <= last:
                if blocks[b, k]:
                    if bits.take(1):
                        blocks[b, k] += one if blocks[b, k] > 0 else -one
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        blocks[b, k] = new
                    k += 1
                    break
                k += 1
        i += 1


def payload_of(image: Image) -> tuple[bytes, int]:
    """The stored payload and the bytes of it that were not added."""
    note = next(n for n in image.notes if n.startswith(NOTE))
    size, n_bytes = map(int, note[len(NOTE) :].split())
    v = np.concatenate([p.blocks for p in image.parts])
    return np.where(v >= 0, v, v + 255).astype(np.uint8).tobytes()[:size], n_bytes


def rgb_bands(image: Image) -> Iterator[np.ndarray]:
    """Full-resolution RGB (rows, width, 3) of the image, from top to bottom in bands of bounded size."""
    across, down = max(p.across for p in image.parts), max(p.down for p in image.parts)
    units = -(-image.height // (8 * down))
    each = max(1, BAND_UNITS * across // max(1, image.parts[0].wide))
    for top in range(0, units, each):
        planes = []
        for p in image.parts:
            high = p.down * min(each, units - top)
            part = p.blocks[p.wide * p.down * top :][: p.wide * high]
            samples = (part * image.quant[p.table]).astype(np.float32) @ INVERSE + np.float32(128)
            plane = samples.reshape(high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * p.wide)
            plane = np.clip(np.rint(plane), 0, 255)
            if p.down != down or p.across != across:
                plane = plane.repeat(down // p.down, 0).repeat(across // p.across, 1)
            planes.append(plane)
        if len(planes) == 1:
            planes = [planes[0]] * 3
        else:
            y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
            planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
        rgb = np.stack(planes, -1)
        np.rint(rgb, out=rgb)
        np.clip(rgb, 0, 255, out=rgb)
        yield rgb.astype(np.uint8)[: image.height - 8 * down * top, : image.width]


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % UNIT if data else UNIT), len(data)


def store(rows: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """rows with the text's bytes, zero-padded to a positive multiple of 64, as a JPEG in column `media`, which replaces one of that name.

    A null text counts as empty. Other columns stay; equal texts have equal media; no rows give no rows.
    """
    keep, back = set_aside(rows.drop(media), text)
    schema = T.StructType([*keep.schema.fields, T.StructField(media, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 2 << 20):
            yield with_column(b, media, pa.array([encode_payload(*padded(t)) for t in b.column(text).to_pylist()], pa.binary()), schema)

    return back(keep.mapInArrow(run, schema), media)


LOADED = "payload binary, n_bytes long, rgb_sha256 string, height int, width int, feature string, rgb binary"


def load(rows: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """rows with what their media hold: payload, n_bytes (without padding), rgb_sha256 (as digest_of_bands() has it), height, width, feature, and rgb (height * width * 3 bytes; null unless tensors).

    Each medium is decoded once, and its tensor is digested in bands of bounded size. The feature is the image's size, the mean of each colour and an 8 x 8 average hash of its brightness. A null medium
    gives nulls. Columns of the result's names are replaced, others stay.
    """
    names = [x.split()[0] for x in LOADED.split(", ")]
    keep, back = set_aside(rows.drop(*[c for c in names if c in rows.columns]), media)
    added = T._parse_datatype_string(LOADED)
    schema = T.StructType([*keep.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media, 2 << 20):
            got = [(None,) * 7 if m is None else _loaded(m, tensors) for m in b.column(media).to_pylist()]
            for i, name in enumerate(names):
                upto = T.StructType(schema.fields[: b.num_columns + 1])
                b = with_column(b, name, pa.array([g[i] for g in got], _ARROW[i]), upto)
            yield b

    return back(keep.mapInArrow(run, schema), *names)


BANDS = "band int, top int, height int, width int, rgb binary"


def tensors(rows: DataFrame, media: str = "media") -> DataFrame:
    """The RGB tensor of each medium in bands of bounded size, a row a band: rows' other columns, band (from 0), top (its first line), height, width and rgb (height * width * 3 bytes).

    A null medium has no band. Columns of the result's names are replaced, the medium itself is left out.
    """
    names = [x.split()[0] for x in BANDS.split(", ")]
    keep, back = set_aside(rows.drop(*[c for c in names if c in rows.columns]), media)
    others = [f for f in keep.schema.fields if f.name != media]
    schema = T.StructType([*others, *T._parse_datatype_string(BANDS).fields])
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media, 2 << 20):
            for i, m in enumerate(b.column(media).to_pylist()):
                top = 0
                for n, band in enumerate(() if m is None else rgb_bands(decode(m))):
                    row = [b.column(f.name).slice(i, 1) for f in others]
                    row += [pa.array([v], t) for v, t in zip((n, top, *band.shape[:2], band.tobytes()), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(row, names=schema.names)
                    top += len(band)

    return back(keep.mapInArrow(run, schema), *names)


def digest_of_bands(bands: DataFrame, key: str) -> DataFrame:
    """(key, rgb_sha256): the SHA-256 of the hexadecimal SHA-256 of all bands of a tensor, joined in their order."""
    each = bands.select(key, "band", F.sha2("rgb", 256).alias("sha"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("band", "sha"))), lambda b: b["sha"])  # 64 characters a band
    return each.groupBy(key).agg(F.sha2(F.array_join(ordered, ""), 256).alias("rgb_sha256"))


_ARROW = (pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())


def _loaded(media: bytes, tensors: bool) -> tuple:
    image = decode(media)
    payload, n_bytes = payload_of(image)
    sums, grid, held, whole, at = np.zeros(3, np.int64), np.zeros((8, 8), np.int64), np.zeros((8, 8), np.int64), [], 0
    digests = hashlib.sha256()
    columns = np.arange(image.width) * 8 // image.width
    for band in rgb_bands(image):
        sums += band.reshape(-1, 3).sum(0, dtype=np.int64)
        bright = band.sum(2, dtype=np.int64)
        lines = (at + np.arange(len(band))) * 8 // image.height
        by_column = np.add.reduceat(bright, np.searchsorted(columns, np.arange(8)), axis=1)
        np.add.at(grid, lines, by_column)
        np.add.at(held, lines, np.bincount(columns, minlength=8))
        at += len(band)
        data = band.tobytes()
        digests.update(hashlib.sha256(data).hexdigest().encode())
        if tensors:
            whole.append(data)
    means = sums * 100 // (image.width * image.height)
    level = grid / np.maximum(held, 1)
    code = np.packbits((level > level.mean()).ravel()).tobytes().hex()
    feature = f"{image.height}x{image.width} " + " ".join(f"{m // 100}.{m % 100:02d}" for m in means.tolist()) + f" {code}"
    return payload, n_bytes, digests.hexdigest(), image.height, image.width, feature, b"".join(whole) if tensors else None
