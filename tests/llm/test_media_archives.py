from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexa.llm import arc_convert as A
from codexa.llm import common, queries
from codexa.llm import jpeg as J
from tests.llm.conftest import SF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_payload_round_trip(data):
    payload = data + b"\0" * (-len(data) % 64 if data else 64)
    image = J.decode(J.encode_payload(payload, len(data)))
    assert J.payload_of(image) == (payload, len(data))


def test_large_payload_has_several_block_runs():
    payload = np.random.default_rng(0).integers(0, 256, 64 * 6 * 35_000, dtype=np.uint8).tobytes()
    assert J.payload_of(J.decode(J.encode_payload(payload)))[0] == payload


def test_transform_of_known_blocks():
    block = np.zeros(64)
    block[0] = 80
    assert np.allclose(block @ J.INVERSE, 10)  # direct current is an eighth
    x, y = np.meshgrid(np.arange(8), np.arange(8))
    block = np.zeros(64)
    block[1] = 8  # the first horizontal frequency
    assert np.allclose((block @ J.INVERSE).reshape(8, 8), np.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16), atol=1e-5)
    assert sorted(J.ZIGZAG) == list(range(64)) and J.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


class Writer:
    """A plain, slow writer of arbitrary progressive scans, to hold the reader against."""

    def __init__(self):
        self.bits = []

    def put(self, value, size):
        self.bits += [value >> k & 1 for k in range(size - 1, -1, -1)]

    def number(self, v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    def data(self):
        return J._bytes(np.array(self.bits, np.uint8))


def code(symbol):
    return symbol  # all 255 symbols below 255 get eight bits


TABLE = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))


def first_band(blocks, a, b, low):
    w, run = Writer(), 0

    def flush():
        nonlocal run
        while run:
            r = min(14, run.bit_length() - 1)
            w.put(code(r << 4), 8)
            w.put(min(run, (2 << r) - 1) - (1 << r), r)
            run -= min(run, (2 << r) - 1)

    for block in blocks:
        zeros = 0
        for k in range(a, b + 1):
            v = int(np.sign(block[k])) * (abs(int(block[k])) >> low)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.put(code(0xF0), 8)
                zeros -= 16
            size, bits = w.number(v)
            w.put(code(zeros << 4 | size), 8)
            w.put(bits, size)
            zeros = 0
        run += zeros > 0
    flush()
    return w.data()


def refine_band(blocks, a, b, low):
    """Without runs of blocks: each ends on its own."""
    w = Writer()
    for block in blocks:
        size = [abs(int(x)) >> low for x in block]
        last = max([k for k in range(a, b + 1) if size[k] == 1], default=a - 1)
        zeros, pending = 0, []
        for k in range(a, b + 1):
            if k > last:
                break
            if size[k] > 1:
                pending.append(size[k] & 1)
            elif size[k] == 1:
                w.put(code(zeros << 4 | 1), 8)
                w.put(int(block[k] > 0), 1)
                for x in pending:
                    w.put(x, 1)
                zeros, pending = 0, []
            else:
                if zeros == 15:
                    w.put(code(0xF0), 8)
                    for x in pending:
                        w.put(x, 1)
                    zeros, pending = 0, []
                else:
                    zeros += 1
        if last < b:
            w.put(code(0), 8)
            for x in pending:
                w.put(x, 1)
            for k in range(last + 1, b + 1):
                if size[k] > 1:
                    w.put(size[k] & 1, 1)
    return w.data()


@pytest.mark.parametrize("density", [0.02, 0.2, 0.9])
def test_arbitrary_scans_accumulate(density):
    """A grey image of 3 x 2 blocks with several spectral bands and three successive refinements, zero runs and block runs."""
    rng = np.random.default_rng(int(density * 100))
    blocks = rng.integers(-300, 301, (6, 64)) * (rng.random((6, 64)) < density)
    blocks[2] = 0
    head = b"\xff\xd8" + J._segment(0xDB, b"\0" + b"\1" * 64) + J._segment(0xC2, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0])) + J._segment(0xC4, b"\0" + TABLE + b"\x10" + TABLE)
    w, before = Writer(), 0
    for v in blocks[:, 0] >> 1:
        size, bits = w.number(int(v) - before)
        w.put(code(size), 8)
        w.put(bits, size)
        before = int(v)
    out = [head, J._scan([(1, 0, 0)], 0, 0, 0, 1, w.data())]
    for a, b in ((1, 5), (6, 63)):
        out.append(J._scan([(1, 0, 0)], a, b, 0, 2, first_band(blocks, a, b, 2)))
        out.append(J._scan([(1, 0, 0)], a, b, 2, 1, refine_band(blocks, a, b, 1)))
    w = Writer()
    for v in blocks[:, 0]:
        w.put(int(v) & 1, 1)
    out.append(J._scan([(1, 0, 0)], 0, 0, 1, 0, w.data()))
    out += [J._scan([(1, 0, 0)], a, b, 1, 0, refine_band(blocks, a, b, 0)) for a, b in ((1, 5), (6, 63))]
    image = J.decode(b"".join([*out, b"\xff\xd9"]))
    assert (image.parts[0].blocks == blocks).all()
    rgb = np.concatenate([*J.rgb_bands(image)])
    assert rgb.shape == (16, 24, 3) and (rgb[..., 0] == rgb[..., 1]).all()


def test_chroma_is_upsampled(monkeypatch):
    payload = np.random.default_rng(1).integers(0, 256, 64 * 6 * 6, dtype=np.uint8).tobytes()
    image = J.decode(J.encode_payload(payload))
    whole = np.concatenate([*J.rgb_bands(image)])
    assert whole.shape == (image.height, image.width, 3)
    monkeypatch.setattr(J, "BAND_UNITS", 1)
    assert (np.concatenate([*J.rgb_bands(image)]) == whole).all()
    y, cb, cr = ((p.blocks @ np.eye(64)).astype(np.float32) @ J.INVERSE + 128 for p in image.parts)
    y, cb, cr = (np.clip(np.rint(v[0]), 0, 255) for v in (y, cb, cr))
    want = np.clip(np.rint([y[0] + 1.402 * (cr[0] - 128), y[0] - 0.344136 * (cb[0] - 128) - 0.714136 * (cr[0] - 128), y[0] + 1.772 * (cb[0] - 128)]), 0, 255)
    assert (whole[0, 0] == want).all()


def test_not_progressive():
    for bad in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8" + J._segment(0xC0, b"12345678"), J.encode_payload(b"\0" * 64)[:-40]):
        with pytest.raises((ValueError, IndexError)):
            J.decode(bad)


def test_media_tables(odd, odd_rows, empty, clashing):
    for df in (odd, clashing):
        rows = J.load(J.store(df), tensors=True).collect()
        assert len(rows) == 15
        seen = {}
        for r in rows:
            data = (r.text or "").encode()
            assert bytes(r.payload) == data + b"\0" * (-len(data) % 64 if data else 64) and r.n_bytes == len(data)
            assert len(r.rgb) == r.height * r.width * 3 and seen.setdefault(r.text or "", (bytes(r.media), r.feature)) == (bytes(r.media), r.feature)
    assert J.load(J.store(empty)).count() == 0
    assert {r.words for r in rows} == {"mine"}


def slow_feature(rgb):
    """The feature of a whole tensor, a sample at a time."""
    height, width, _ = rgb.shape
    means = [int(sum(int(v) for v in rgb[..., c].ravel())) * 100 // (height * width) for c in range(3)]
    cells = [[[] for _ in range(8)] for _ in range(8)]
    for y in range(height):
        for x in range(width):
            cells[y * 8 // height][x * 8 // width].append(sum(int(v) for v in rgb[y, x]))
    level = [sum(c) / max(len(c), 1) for row in cells for c in row]
    bits = "".join("1" if v > sum(level) / 64 else "0" for v in level)
    return f"{height}x{width} " + " ".join(f"{m // 100}.{m % 100:02d}" for m in means) + f" {int(bits, 2):016x}"


def slow_rgb(image):
    """The tensor by the transform's own sum, a block and a sample at a time."""
    planes = []
    for p in image.parts:
        plane = np.zeros((8 * p.high, 8 * p.wide))
        for i, block in enumerate(p.blocks):
            square = np.zeros(64)
            square[J.ZIGZAG] = block * image.quant[p.table]
            for y in range(8):
                for x in range(8):
                    total = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * square[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
                    plane[8 * (i // p.wide) + y, 8 * (i % p.wide) + x] = total / 4 + 128
        planes.append(np.clip(np.rint(plane), 0, 255))
    out = np.zeros((image.height, image.width, 3))
    for y in range(image.height):
        for x in range(image.width):
            at = [planes[k][y * p.down // image.parts[0].down, x * p.across // image.parts[0].across] for k, p in enumerate(image.parts)]
            luma, blue, red = at if len(at) == 3 else (at[0], 128, 128)
            out[y, x] = luma + 1.402 * (red - 128), luma - 0.344136 * (blue - 128) - 0.714136 * (red - 128), luma + 1.772 * (blue - 128)
    return np.clip(np.rint(out), 0, 255)


def test_tensor_and_feature_against_a_slow_decoder():
    for text in ("", "the quick brown fox " * 30, "é" * 1000):
        media = J.encode_payload(*J.padded(text))
        *_, height, width, feature, rgb = J._loaded(media, True)
        got = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)
        assert np.abs(got - slow_rgb(J.decode(media))).max() <= 2  # a sample's rounding, carried through the colours
        assert feature == slow_feature(got)


def test_stored_tensors_are_those_of_the_media(spark, empty, clashing):
    long = clashing.where("doc_id = 9").withColumn("text", F.repeat(F.lit("seven letters "), 120_000))
    media = J.store(clashing.unionByName(long)).select("*", F.monotonically_increasing_id().alias("row")).cache()
    whole = {r.row: (r.height, r.width, bytes(r.rgb)) for r in J.load(media).collect()}
    bands = J.tensors(media)
    parts = {}
    for r in sorted(bands.collect(), key=lambda r: (r.row, r.band)):
        before = parts.setdefault(r.row, [0, r.width, b"", []])
        assert r.top == before[0] and len(r.rgb) == r.height * r.width * 3 and r.words == "mine"
        parts[r.row] = [before[0] + r.height, r.width, before[2] + bytes(r.rgb), [*before[3], hashlib.sha256(r.rgb).hexdigest()]]
    assert {k: tuple(v[:3]) for k, v in parts.items()} == whole and max(len(v[3]) for v in parts.values()) > 1
    assert {r.row: r.rgb_sha256 for r in J.digest_of_bands(bands, "row").collect()} == {k: hashlib.sha256("".join(v[3]).encode()).hexdigest() for k, v in parts.items()}
    media.unpersist()
    assert J.tensors(J.store(empty)).count() == 0 and J.tensors(spark.createDataFrame([(1, None)], "row int, media binary")).count() == 0


def test_op5_keeps_the_media_alone_and_digests_their_tensors(spark, tmp_path, clashing, monkeypatch):
    media = J.store(clashing).select("*", F.monotonically_increasing_id().alias("row")).cache()
    digests = {r.row: r.rgb_sha256 for r in J.digest_of_bands(J.tensors(media), "row").collect()}
    assert {r.row: r.rgb_sha256 for r in J.load(media, tensors=False).collect()} == digests and len(digests) == 15
    media.unpersist()
    assert J.load(spark.createDataFrame([(None,)], "media binary")).first().rgb_sha256 is None
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = queries.op5_jpeg(spark, SF).collect()
    kept = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert all(r.rgb_sha256 for r in rows) and kept < 1.5 * Path(f"{SF}/documents.parquet").stat().st_size


@pytest.mark.parametrize("version", [1, 2])
def test_archive_files(version):
    rows = [(1, "http://a b/ü", "é<p>\n\n".encode()), (None, None, b""), (3, "x", b"y" * 500), (-4, "", b"\r\n\r\nz")]
    data = A.write_arc("n.arc", rows, version)
    got = [*A.read_arc(data)]
    assert [f["URL"] for f, *_ in got] == ["http://a%20b/ü", "-", "x", "-"] and [A._http(b)[1] for _, b, *_ in got] == [r[2] for r in rows]
    assert all(len(f) == len(A.FIELDS[version]) for f, *_ in got) and len({place for *_, place in got}) == 4
    for bad in (data[:-20], data.replace(b"text/html", b"text/html x", 1), b"http://x 0.0.0.0 2024 text/html 1\nx\n"):
        with pytest.raises(ValueError):
            [*A.read_arc(bad)]


def test_warc_records():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    one = {"record_id": "urn:uuid:1", "number": 1, "url": "u", "warc_date": "2024-01-01T00:00:00Z", "mime": "text/html", "http_headers": http, "payload": b"abc", "payload_digest": "d"}
    data = A.warc_record("response", one) + A.warc_record("revisit", one | {"record_id": "urn:uuid:2", "number": None}, one)
    (f, block), (g, again) = A.read_warc(data)
    assert block == http + b"abc" and again == http and f["WARC-Type"] == "response" and g["WARC-Refers-To"] == "<urn:uuid:1>" and g["WARC-Refers-To-Target-URI"] == "u"
    assert f["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    assert [*A.read_warc(gzip.compress(data))] == [(f, block), (g, again)]
    for bad in (data[:-3], data.replace(b"Content-Length: ", b"Content-Size: "), b"WARC/1.1\r\n", b"x"):
        with pytest.raises(ValueError):
            [*A.read_warc(bad)]


BODY = b"<p>the same text in two places, long enough for a second record to refer to the first of them and not to keep it</p>\n"


def by_hand(version, url, dates=("19961104142103", "199611041422")):
    """An archive as other software writes it: heads without lengths, bare line feeds, a name lookup."""
    head = b"HTTP/1.0 200 Document follows\r\nserver: NCSA/1.4\r\n\r\n"
    line = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = f"{version} 0 Archive\n{line}\n".encode()
    middle = "" if version == 1 else "200 - - 0 h.arc "
    rows = [("http://a/1", dates[0], "text/html", head + BODY), ("dns:a", dates[0], "text/dns", b"19961104\na. 3600 IN A 1.2.3.4\n"), (url, dates[1], "text/html", head.replace(b"\r", b"") + BODY), ("http://a/1", dates[0], "text/html", head + b"short")]
    parts = [f"filedesc://hand{version}.arc 0.0.0.0 19960923142103 text/plain {'' if version == 1 else '200 - - 0 h.arc '}{len(block)}\n".encode() + block]
    return b"\n".join([*parts, *(f"{u} 1.2.3.4 {d} {kind} {middle}{len(x)}\n".encode() + x for u, d, kind, x in rows)]) + b"\n"


@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_others(spark, version):
    data = by_hand(version, "http://b/2")
    archives = spark.createDataFrame([(data,), (None,), (b"",)], "arc binary")
    warc = A.to_warc(archives).collect()
    got = {(r.url, r.record_type): r for r in A.warc_records(spark.createDataFrame([(bytes(r.warc),) for r in warc] + [(None,)], "warc binary")).collect()}
    first, again, name = got["http://a/1", "response"], got["http://b/2", "revisit"], got["dns:a", "resource"]
    assert len(got) == 3 and sum(len([*A.read_warc(bytes(r.warc))]) for r in warc) == 4
    fields = {f["WARC-Record-ID"]: f for r in warc for f, _ in A.read_warc(bytes(r.warc))}
    assert len(fields) == 4 and all(k.startswith("<urn:uuid:") for k in fields)
    assert again.refers_to in {r.strip("<>") for r, f in fields.items() if f["WARC-Target-URI"] == "http://a/1"} and again.payload_bytes == len(BODY)
    assert fields[f"<{again.record_id}>"]["WARC-Date"] == "1996-11-04T14:22:00Z" and again.payload_digest == hashlib.sha256(BODY).hexdigest()
    assert fields[f"<{name.record_id}>"]["Content-Type"] == "text/dns" and bytes(name.payload).endswith(b"1.2.3.4\n") and first.number is None
    packed = A.arc_records(spark.createDataFrame([(gzip.compress(data),)], "arc binary")).collect()
    assert [r.record_id for r in packed] == [r.record_id for r in A.arc_records(archives).collect()]
    for bad in (data.replace(b"19961104142103", b"unknown-------", 1), data[:200]):
        with pytest.raises(ValueError):
            [*A.read_arc(bad)]


def test_conversion_tables(spark):
    big = "b" * 150
    rows = [(5, "u", big), (3, "u", big), (3, "v", big), (None, "u", big), (7, None, "small"), (8, "w", "small"), (9, "x", None), (10, "y", "é" * 50), (11, "z", "é" * 50), (12, "q", "c" * 99), (13, "q", "c" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = A.convert(pages, "page_id", "url", "html").collect()
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        ids = [j for j, _, s in rows if j is not None and (s or "").encode() == data]
        again = len(data) >= 100 and i != min(ids)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    assert sorted(map(str, ((r.number, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_number) for r in got))) == sorted(map(str, want))
    assert all(bytes(r.payload) == b"b" * 150 for r in got if r.record_type == "response" and r.number == 3)
    assert len({r.record_id for r in got}) == len(rows) and {r.refers_to for r in got if r.refers_to} <= {r.record_id for r in got if r.record_type == "response"}
    assert A.convert(pages.limit(0), "page_id", "url", "html").count() == 0
    wide = pages.selectExpr("*", "'x' AS record_id", "'y' AS payload", "'z' AS warc")
    assert A.convert(wide, "page_id", "url", "html").count() == len(rows)
