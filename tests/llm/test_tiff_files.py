"""TIFF files against a second reader that is written from the format's description, published examples, and damaged bytes."""

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import tiff_media


def plain_packbits(data):
    out, i = [], 0
    while i < len(data):
        n = struct.unpack_from("b", data, i)[0]
        i += 1
        if n >= 0:
            out += data[i : i + n + 1]
            i += n + 1
        elif n != -128:
            out += [data[i]] * (1 - n)
            i += 1
    return bytes(out)


def plain_lzw(data):
    bits = "".join(f"{b:08b}" for b in data)
    table, out, at, width, old = {}, [], 0, 9, None
    while True:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, old = {i: bytes([i]) for i in range(256)}, 9, None
            continue
        if old is None:
            out.append(table[code])
        else:
            new = table[old] + (table[code][:1] if code in table else table[old][:1])
            table[258 + len(table) - 256] = new
            out.append(table[code])
        old = code
        last = 257 + len(table) - 256  # the code given last
        width = 12 if last >= 2046 else 11 if last >= 1022 else 10 if last >= 510 else 9


def plain_pages(data):
    """Pages of 8-bit files with one sample: bytes row by row."""
    assert data[:4] == b"II*\0"
    at = struct.unpack_from("<I", data, 4)[0]
    while at:
        tags, n = {}, struct.unpack_from("<H", data, at)[0]
        for i in range(n):
            tag, kind, count, value = struct.unpack_from("<HHII", data, at + 2 + 12 * i)
            size = {3: 2, 4: 4}[kind]
            place = value if size * count > 4 else at + 2 + 12 * i + 8
            tags[tag] = [int.from_bytes(data[place + size * k : place + size * (k + 1)], "little") for k in range(count)]
        width, height = tags[256][0], tags[257][0]
        assert tags[258] == [8] and tags[277] == [1]
        bw, bh = (tags[322][0], tags[323][0]) if 324 in tags else (width, tags[278][0])
        image = [[None] * width for _ in range(height)]
        across = -(-width // bw)
        for k, (start, size) in enumerate(zip(tags.get(324, tags.get(273)), tags.get(325, tags.get(279)))):
            raw = data[start : start + size]
            raw = {1: bytes, 5: plain_lzw, 8: zlib.decompress, 32773: plain_packbits}[tags[259][0]](raw)
            y0, x0 = k // across * bh, k % across * bw
            for j in range(len(raw) // bw):
                row, last = raw[j * bw : (j + 1) * bw], 0
                for x, value in enumerate(row):
                    last = (last + value) % 256 if tags[317] == [2] else value
                    if y0 + j < height and x0 + x < width:
                        image[y0 + j][x0 + x] = last
        yield bytes(v for row in image for v in row)
        at = struct.unpack_from("<I", data, at + 2 + 12 * n)[0]


def test_published_examples():
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff_media.unpack_bits(packed, len(plain)) == plain_packbits(packed) == plain
    assert plain_packbits(tiff_media.pack_bits(plain)) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # of 7 7 7 8 8 7 7 6 6
    joined = "".join(f"{c:09b}" for c in codes)
    stored = int(joined.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff_media.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stored
    assert tiff_media.lzw_decode(stored, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("size", [0, 1, 5, 300, 5_000, 20_000])
@pytest.mark.parametrize("letters", [2, 60, 256])
def test_codings_by_a_second_decoder(size, letters):
    rng = np.random.default_rng(size)
    data = np.repeat(rng.integers(0, letters, size), rng.integers(1, 5, size)).astype(np.uint8).tobytes()[:size]
    assert plain_lzw(tiff_media.lzw_encode(data)) == data == tiff_media.lzw_decode(tiff_media.lzw_encode(data), size)
    assert plain_packbits(tiff_media.pack_bits(data)) == data


def texts():
    rng = random.Random(3)
    out = ["", "x", "a" * 64, "é" * 40]
    for rows in range(1, 3 * len(tiff_media.LAYOUTS)):
        out.append("".join(rng.choice(["word ", "the ", "aaaaaa", "é", "\n"]) for _ in range(12 * rows))[: 64 * rows - 3])
    return [*out, "the long text " * 15_000, "z" * 200_000]


def test_stored_texts_by_a_second_reader():
    used = set()
    for text in texts():
        payload = tiff_media.payload_of(text.encode())
        used.add(len(payload) // 64 % len(tiff_media.LAYOUTS))
        if len(payload) > 100_000:
            payload_pages = b"".join(p.samples.tobytes() for p in tiff_media.read_tiff(tiff_media.text_to_tiff(text.encode())))
            assert payload_pages == payload
        else:
            assert b"".join(plain_pages(tiff_media.text_to_tiff(text.encode()))) == payload
    assert used == set(range(len(tiff_media.LAYOUTS)))


def test_report_goes_through_page_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (3, None), (0, ""), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("other")).withColumn("row", F.lit(1)).repartition(3)
    out = tiff_media.media_report(docs).collect()
    assert len(out) == len(rows)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload, stored = tiff_media.payload_of(raw), tiff_media.text_to_tiff(raw)
        pages = -(-len(payload) // (64 * tiff_media.PAGE_ROWS))
        feature = f"pages={pages} rows={len(payload) // 64} min={min(payload)} max={max(payload)} sum={sum(payload)} zeros={payload.count(0)}"
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    pages = tiff_media.read_pages(tiff_media.store_texts(docs.drop("media")))
    assert pages.groupBy("image.page").count().where("page = 3").first()["count"] == 2
    assert tiff_media.media_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
def test_packed_samples(bits, compression):
    rng = np.random.default_rng(bits)
    for shape in ((1, 1), (19, 13), (9, 7, 3)):
        page = rng.integers(0, 1 << bits, shape).astype(np.uint8)
        for tile in (None, (16, 16)):
            data = tiff_media.write_tiff([page], compression, 1, 4, tile, bits=bits)
            (back,) = tiff_media.read_tiff(data)
            assert np.array_equal(back.samples, page if page.ndim == 3 else page[:, :, None])
    row = tiff_media.write_tiff([np.array([[1, 0, 1, 1, 0, 0, 0, 0, 1]], np.uint8)], "none", 1, bits=1)
    assert row[8:10] == bytes([0b10110000, 0b10000000])
    with pytest.raises(ValueError):
        tiff_media.write_tiff([np.full((2, 2), 1 << bits, np.uint8)], compression, 1, bits=bits)


def test_big_files():
    pages = [np.arange(60, dtype=np.uint16).reshape(6, 10), np.ones((3, 3), np.uint8)]
    data = tiff_media.write_tiff(pages, "lzw", 2, 2, big=True)
    assert data[:4] == b"II+\0"
    assert [p.samples[:, :, 0].tolist() for p in tiff_media.read_tiff(data)] == [p.tolist() for p in pages]


def damaged_files():
    rng = random.Random(6)
    page = np.arange(30 * 20, dtype=np.uint8).reshape(30, 20)
    files = [tiff_media.write_tiff([page, page], c, 2, 7, t, big=b) for c in ("none", "lzw", "packbits", "deflate") for t in (None, (16, 16)) for b in (False, True)]
    files.append(tiff_media.write_tiff([page % 2], "packbits", 1, bits=1))
    for data in files:
        ends = {*range(0, 24), *(rng.randrange(len(data)) for _ in range(30)), len(data) - 1, len(data) - 4}
        yield from (data[:n] for n in ends)
        for _ in range(400):
            bad = bytearray(data)
            for _ in range(rng.choice([1, 1, 2, 8])):
                where = rng.randrange(len(bad)) if rng.random() < 0.4 else len(bad) - 1 - rng.randrange(min(len(bad), 160))
                bad[where] = rng.choice([0, 1, 255, rng.randrange(256)])
            yield bytes(bad)


def test_only_tiff_errors_come_out_of_damaged_files():
    began, broken = time.perf_counter(), 0
    for data in damaged_files():
        try:
            assert sum(p.samples.nbytes for p in tiff_media.read_tiff(data)) < 2 * tiff_media.MAX_PAGE_BYTES
        except tiff_media.TiffError:
            broken += 1
    assert broken > 1000 and time.perf_counter() - began < 120


def test_damaged_files_give_rows_with_errors(spark):
    data = tiff_media.text_to_tiff(b"x" * 200_000)
    huge = bytearray(tiff_media.write_tiff([np.zeros((4, 4), np.uint8)], "deflate"))
    at = struct.unpack_from("<I", huge, 4)[0]
    struct.pack_into("<I", huge, at + 2 + 8, 4_000_000_000)  # the width
    files = [b"junk", b"II*\0", b"II*\0\x01", None, data, data[:-4], bytes(huge), b""]
    df = spark.createDataFrame(list(enumerate(files)), "id int, media binary").coalesce(1)
    found = {}
    for r in tiff_media.read_pages(df).collect():
        found.setdefault(r.id, []).append((r.image.page, r.image.error is None))
    assert {i: found[i] for i in (0, 1, 2, 6, 7)} == dict.fromkeys((0, 1, 2, 6, 7), [(0, False)])
    assert 3 not in found and found[4] == [(i, True) for i in range(-(-3125 // tiff_media.PAGE_ROWS))]
    assert found[5][:-1] == found[4] and found[5][-1][1] is False
    assert tiff_media.read_pages(df.limit(0)).count() == 0
