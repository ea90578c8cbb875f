"""TIFF media columns: pages of samples written to and read from file bytes.

The reader walks the chain of image directories (of classic and of big files),
decodes PackBits, LZW or deflate strips and tiles, undoes horizontal and
floating-point predictors, and gives one page for each directory.  Whatever the
bytes, it either gives pages or raises ``TiffError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldloom.llm.textbatch import pieces, row_texts

#: Tags, and the sizes of field types 1 to 12.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
FILL_ORDER = 266
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_NUMBERS = {1: "B", 3: "H", 4: "I", 16: "Q"}
#: No coding here makes more than so many bytes of one; pages are refused beyond that, and beyond a size in all.
MOST_OF_ONE, MAX_PAGE_BYTES = 1500, 1 << 30
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
_OLD_DEFLATE = 32946


class TiffError(ValueError):
    """A file that isn't a readable TIFF."""


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 2 to 128 equal bytes, and stretches of up to 128 others."""
    out, at = bytearray(), 0
    a = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]).tolist() if len(a) else [0]
    held = bytearray()

    def flush() -> None:
        for i in range(0, len(held), 128):
            part = held[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        held.clear()

    for at, end in zip(edges, edges[1:]):
        n = end - at
        if n < 3:
            held.extend(data[at:end])
            continue
        flush()
        while n > 0:
            run = min(n, 128)
            if run == 1:
                held.append(data[at])
            else:
                out += bytes([257 - run, data[at]])
            n -= run
    flush()
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widening one code early, with clear codes."""
    table = {bytes([i]): i for i in range(256)}
    bits = acc = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, acc
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    width, following = 9, 258
    put(256, 9)
    seen = b""
    for i in range(len(data)):
        longer = seen + data[i : i + 1]
        if longer in table:
            seen = longer
            continue
        put(table[seen], width)
        table[longer] = following
        following += 1
        if following == 4094:
            put(256, width)
            table, width, following = {bytes([i]): i for i in range(256)}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
        seen = data[i : i + 1]
    if seen:
        put(table[seen], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, at, acc, bits = bytearray(), 0, 0, 0
    table: list[bytes] = []
    width, last = 9, b""
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out[:size])
            acc, bits, at = acc << 8 | data[at], bits + 8, at + 1
        bits -= width
        code, acc = acc >> bits, acc & (1 << bits) - 1
        if code == 257 or len(out) >= size:
            return bytes(out[:size])
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data don't begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1


def _pack(data: bytes, compression: int) -> bytes:
    return {1: lambda: data, 5: lambda: lzw_encode(data), 8: lambda: zlib.compress(data, 1), 32773: lambda: pack_bits(data)}[compression]()


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if size == 0:
        return b""
    if compression in (8, _OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from None
    if compression == 1:
        return data[:size]
    if compression == 5:
        return lzw_decode(data, size)
    if compression == 32773:
        return unpack_bits(data, size)
    raise TiffError(f"compression {compression}")


@dataclass(frozen=True)
class Page:
    """Samples of (height, width, samples of a pixel)."""

    samples: np.ndarray


def _predicted(block: np.ndarray, predictor: int, bits: int = 8) -> bytes:
    """A (rows, columns, samples) block as stored bytes; integer samples wrap around, those of under 8 bits are packed by rows."""
    if bits < 8:
        flat = block.reshape(len(block), -1, 1)
        return np.packbits(np.unpackbits(flat, axis=2)[:, :, 8 - bits :].reshape(len(block), -1), axis=1).tobytes()
    if predictor == 1:
        return block.tobytes()
    if predictor == 2:
        unsigned = block.view(f"<u{block.dtype.itemsize}")
        out = unsigned.copy()
        out[:, 1:] -= unsigned[:, :-1]
        return out.tobytes()
    rows = block.shape[0]
    size = block.dtype.itemsize
    planes = block.astype(block.dtype.newbyteorder(">")).reshape(rows, -1).view(np.uint8).reshape(rows, -1, size).transpose(0, 2, 1).reshape(rows, -1)
    out = planes.copy()
    step = block.shape[2]
    out[:, step:] -= planes[:, :-step]
    return out.tobytes()


def _row_bytes(columns: int, depth: int, bits: int) -> int:
    return -(-columns * depth * bits // 8)


def _undone(data: bytes, shape: tuple[int, int, int], dtype: np.dtype, predictor: int, bits: int) -> np.ndarray:
    rows, columns, depth = shape
    if bits < 8:
        wide = _row_bytes(columns, depth, bits)
        if len(data) < rows * wide or predictor != 1:
            raise TiffError("a strip or tile is too short, or packed samples have a predictor")
        parts = np.unpackbits(np.frombuffer(data, np.uint8, rows * wide).reshape(rows, wide), axis=1).reshape(rows, -1, bits)
        values = np.packbits(parts, axis=2)[:, :, 0] >> np.uint8(8 - bits)
        return values[:, : columns * depth].reshape(shape)
    need = int(np.prod(shape)) * dtype.itemsize
    if len(data) < need:
        raise TiffError("a strip or tile is too short")
    if predictor == 3:
        rows, columns, step = shape
        planes = np.frombuffer(data, np.uint8, need).reshape(rows, -1, step)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, columns * step)
        big = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">"))
        return big.reshape(shape).astype(dtype.newbyteorder("="))
    block = np.frombuffer(data, dtype, need // dtype.itemsize).reshape(shape)
    if predictor == 1:
        return block
    if predictor != 2:
        raise TiffError(f"predictor {predictor}")
    unsigned = block.astype(f"=u{dtype.itemsize}") if dtype.kind != "f" else block.view(f"u{dtype.itemsize}")
    return np.add.accumulate(unsigned, axis=1, dtype=unsigned.dtype).view(dtype.newbyteorder("="))


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, bits: int | None = None, big: bool = False) -> bytes:
    """A little-endian file with one directory for each (height, width[, samples]) array, in strips or in (height, width) tiles.

    ``bits`` of 1, 2 or 4 packs 8-bit samples below 2**bits (without a predictor);
    ``big`` makes a file with 64-bit places.
    """
    if not pages:
        raise ValueError("a file has one page at least")
    code, out = COMPRESSIONS[compression], bytearray(b"II+\0\x08\0\0\0" + bytes(8) if big else b"II*\0" + bytes(4))
    place_type, place_code, room = (16, "Q", 8) if big else (4, "I", 4)
    pointer = 8 if big else 4
    for page in pages:
        block = page[:, :, None] if page.ndim == 2 else page
        block = np.ascontiguousarray(block, block.dtype.newbyteorder("<"))
        height, width, samples = block.shape
        own_bits = bits or 8 * block.dtype.itemsize
        if own_bits < 8 and (block.dtype.kind != "u" or block.dtype.itemsize != 1 or predictor != 1 or block.size and block.max() >> own_bits):
            raise ValueError("packed samples are small 8-bit numbers without a predictor")
        if tile:
            th, tw = tile
            parts = []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    part = np.zeros((th, tw, samples), block.dtype)
                    cut = block[y : y + th, x : x + tw]
                    part[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(part)
        else:
            parts = [block[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        places, sizes = [], []
        for part in parts:
            stored = _pack(_predicted(np.ascontiguousarray(part), predictor, own_bits), code)
            places.append(len(out))
            sizes.append(len(stored))
            out += stored
            out += b"\0" * (len(out) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[block.dtype.kind]
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [own_bits] * samples), (COMPRESSION, 3, [code]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), (SAMPLE_FORMAT, 3, [kind] * samples)]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, place_type, places), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, place_type, places), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        entries = bytearray()
        for tag, type_, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{_NUMBERS[type_]}", *values)
            if len(raw) > room:
                place, body = len(out), raw
                out += body
                raw = struct.pack("<" + place_code, place)
                out += b"\0" * (len(out) % 2)
            entries += struct.pack("<HH" + place_code, tag, type_, len(values)) + raw.ljust(room, b"\0")
        out[pointer : pointer + room] = struct.pack("<" + place_code, len(out))
        out += struct.pack("<Q" if big else "<H", len(fields)) + entries
        pointer = len(out)
        out += bytes(room)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[Page]:
    """Each directory's page; either byte order, classic or big; ``TiffError`` where the bytes can't be read (further)."""
    try:
        yield from _pages(data)
    except TiffError:
        raise
    except (struct.error, ArithmeticError, LookupError, MemoryError, ValueError) as e:
        raise TiffError(f"{type(e).__name__}: {e}") from None


def _pages(data: bytes) -> Iterator[Page]:
    order, place, count_code, room = {b"II*\0": ("<", "I", "H", 4), b"MM\0*": (">", "I", "H", 4), b"II+\0": ("<", "Q", "Q", 8), b"MM\0+": (">", "Q", "Q", 8)}.get(data[:4], ("", "", "", 0))
    if not order:
        raise TiffError("no TIFF header")
    if room == 8 and struct.unpack_from(order + "HH", data, 4) != (8, 0):
        raise TiffError("a big file has places of 8 bytes")
    head, entry = struct.Struct(order + count_code), struct.Struct(order + "HH" + place)
    at, seen = struct.unpack_from(order + place, data, room)[0], set()
    while at:
        if at in seen or at + head.size > len(data):
            raise TiffError("directories run in a circle or out of the file")
        seen.add(at)
        (n,) = head.unpack_from(data, at)
        first, step = at + head.size, entry.size + room
        if first + n * step > len(data):
            raise TiffError("a directory runs out of the file")
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = entry.unpack_from(data, first + step * i)
            where = first + step * i + entry.size
            size = TYPE_SIZES.get(kind, 1) * count
            if size > room:
                (where,) = struct.unpack_from(order + place, data, where)
            if kind in _NUMBERS and count:
                if where + size > len(data):
                    raise TiffError("a field runs out of the file")
                tags[tag] = list(struct.unpack_from(f"{order}{count}{_NUMBERS[kind]}", data, where))
        yield _read_page(data, tags, order)
        after = first + n * step
        at = struct.unpack_from(order + place, data, after)[0] if after + room <= len(data) else _raise("a file ends before the place of the next directory")


def _raise(message: str) -> int:
    raise TiffError(message)


def _read_page(data: bytes, tags: dict[int, list[int]], order: str) -> Page:
    if WIDTH not in tags or HEIGHT not in tags:
        raise TiffError("a directory has no size")
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, kind = one(BITS, 1), one(SAMPLE_FORMAT, 1)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or kind not in (1, 2, 3) or kind == 3 and bits < 32 or bits < 8 and kind != 1 or len(set(tags.get(BITS, [1]))) > 1:
        raise TiffError(f"samples of {bits} bits")
    if one(FILL_ORDER, 1) != 1:
        raise TiffError("bits in reverse order")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{max(8, bits) // 8}")
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    tiled = TILE_OFFSETS in tags
    offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
    bh, bw = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    if not bh or not bw or not height or not samples:
        raise TiffError("empty pages, strips or tiles")
    across, down = -(-width // bw), -(-height // bh)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if min(len(offsets), len(sizes)) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    offsets, sizes = offsets[: across * down * planes], sizes[: across * down * planes]
    if any(o + n > len(data) for o, n in zip(offsets, sizes)) or sum(sizes) > len(data):
        raise TiffError("strips or tiles run out of the file or overlap")
    # what is made room for has to be in the stored bytes
    whole = max(height * width * samples * dtype.itemsize, (across * bw) * (down * bh) * samples * dtype.itemsize if tiled else 0)
    if whole > min(MAX_PAGE_BYTES, 8 * MOST_OF_ONE * sum(sizes)):
        raise TiffError("a page is larger than its stored bytes can be")
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for n in range(across * down * planes):
        plane, place = divmod(n, across * down)
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, height - y)
        stored = data[offsets[n] : offsets[n] + sizes[n]]
        need = rows * _row_bytes(bw, depth, bits)
        if need > MOST_OF_ONE * len(stored):
            raise TiffError("a strip or tile is too short")
        block = _undone(_unpack(stored, compression, need), (rows, bw, depth), dtype, predictor, bits)
        out[y : y + rows, x : x + bw, plane : plane + depth] = block[: height - y, : width - x]
    return Page(out)


#: How texts are stored: samples of a row, rows of a page, and by the number of rows how a file's pages are coded.
ROW, PAGE_ROWS = 64, 1024
LAYOUTS = (
    {"compression": "deflate", "predictor": 2},
    {"compression": "lzw", "predictor": 1, "tile": (32, 32)},
    {"compression": "packbits", "predictor": 1, "rows_per_strip": 64},
    {"compression": "deflate", "predictor": 1, "tile": (64, 16)},
    {"compression": "lzw", "predictor": 2, "rows_per_strip": 128},
    {"compression": "none", "predictor": 2},
    {"compression": "packbits", "predictor": 2, "tile": (16, 64)},
)
#: Decoded bytes after which rows are handed on.
_HELD_BYTES = 8 << 20


def payload_of(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of 64 bytes."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0")


def text_to_tiff(text: bytes) -> bytes:
    """The padded text as 8-bit samples, 64 in a row, in pages of up to 1,024 rows; the number of rows, divided by that of layouts, leaves the layout's place."""
    samples = np.frombuffer(payload_of(text), np.uint8).reshape(-1, ROW)
    return write_tiff([samples[i : i + PAGE_ROWS] for i in range(0, len(samples), PAGE_ROWS)], **LAYOUTS[len(samples) % len(LAYOUTS)])


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with a binary column ``media``: a TIFF with the text's bytes.

    A null text counts as empty, which is a page of one row of zeros; whole texts
    are stored, however long.  Repeated rows give repeated results, an empty table
    an empty one; ``media`` is replaced if it's there, other columns are kept.
    """
    keep = [c for c in docs.columns if c != media]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                files = [text_to_tiff(t) for t in row_texts(batch.column(batch.schema.get_field_index(text)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(files, pa.binary())], [*keep, media])

    return docs.select(*keep).mapInArrow(run, schema)


_PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("dtype", T.StringType()), T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType())])


def read_pages(df: DataFrame, media: str = "media", out: str = "image") -> DataFrame:
    """One row for each page of each file, in place of ``media``; a struct column ``out`` has the page from 0 and its samples.

    Samples are little-endian, row by row.  A null file gives no row; a file
    that can't be read (further) gives one row with an ``error`` and no samples,
    after those of the pages before it.  A file's rows follow one another;
    repeated files give repeated rows, an empty table an empty one.  A column
    already called ``out`` is replaced.
    """
    keep = [c for c in df.columns if c not in (media, out)]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, _PAGE)])
    names = [f.name for f in _PAGE.fields]
    kind = pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("dtype", pa.string()), ("samples", pa.binary()), ("error", pa.string())])

    def pages(data: bytes) -> Iterator[dict]:
        n = 0
        try:
            for page in read_tiff(data):
                s = page.samples
                yield dict(zip(names, (n, s.shape[1], s.shape[0], s.shape[2], s.dtype.name, s.astype(s.dtype.newbyteorder("<"), copy=False).tobytes(), None)))
                n += 1
        except TiffError as e:
            yield dict.fromkeys(names) | {"page": n, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, media):
                rows, found, held = [], [], 0
                kept = batch.select(keep)
                made = lambda rows, found: pa.RecordBatch.from_arrays([*kept.take(pa.array(rows, pa.int64())).columns, pa.array(found, kind)], [*keep, out])  # noqa: E731, B023
                for r, data in enumerate(batch.column(batch.schema.get_field_index(media)).to_pylist()):
                    for page in pages(data) if data is not None else ():
                        rows.append(r)
                        found.append(page)
                        held += len(page["samples"] or b"")
                        if held > _HELD_BYTES:
                            yield made(rows, found)
                            rows, found, held = [], [], 0
                yield made(rows, found)

    return df.select(*keep, media).mapInArrow(run, schema)


def media_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its text stored as a TIFF, read back page by page, and features of what was read.

    ``feature`` has pages, rows, and of the samples the least, the largest, the
    sum and the number of zeros.  A null text counts as empty and has 64 bytes of
    payload; null ids stay; repeated rows give repeated rows, an empty table an
    empty one; other columns, whatever their names, aren't read.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sha = None, hashlib.sha256()
        size = pages = rows = total = zeros = low = high = 0
        tail = b""

        def told() -> tuple:
            _, doc, n_bytes, media_bytes, media_sha = row
            return doc, n_bytes, size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha, f"pages={pages} rows={rows} min={low} max={high} sum={total} zeros={zeros}"

        def made(done: list[tuple]) -> pa.RecordBatch:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema.names)

        batch = None
        for batch in batches:
            done = []
            image = batch.column(batch.schema.get_field_index("image"))
            facts = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "doc_id", "n_bytes", "media_bytes", "media_sha256")))
            for i, now in enumerate(facts):
                if row is None or now[0] != row[0]:
                    if row is not None:
                        done.append(told())
                    row, sha = now, hashlib.sha256()
                    size = pages = rows = total = zeros = 0
                    low, high = 255, 0
                page = image[i].as_py()
                if page["error"]:
                    raise TiffError(page["error"])  # a file that was written here can be read
                back = page["samples"]
                a = np.frombuffer(back, np.uint8)
                sha.update(back)
                size, pages, rows, tail = size + len(back), pages + 1, rows + page["height"], back[-ROW:]
                total, zeros = total + int(a.sum(dtype=np.int64)), zeros + int((a == 0).sum())
                low, high = min(low, int(a.min())), max(high, int(a.max()))
            if done:
                yield made(done)
        if row is not None:
            yield made([told()])

    stored = store_texts(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    facts = stored.select("row", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return read_pages(facts).mapInArrow(run, schema)
