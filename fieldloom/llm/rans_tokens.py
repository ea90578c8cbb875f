"""Token-ID output coded by a static range asymmetric numeral system.

All blocks share one table of symbol frequencies, counted over the whole corpus.
Each block is coded by itself in interleaved lanes (symbol i belongs to lane
i mod L), which numpy steps through side by side.  A block's frame holds its
documents' ids and sizes, and every so many rounds a checkpoint: the states of
all lanes, the place in the word stream and the check sum of the ids up to the
next one.  Each such segment can be decoded by itself, wherever the others are.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm import scratch
from fieldloom.llm.textbatch import byte_table, pieces, runs, text_values
from fieldloom.llm.wordcache import WordCache

MAGIC = b"RLB2"
#: States are in [2**31, 2**63); words of 32 bits; frequencies add up to 2**SCALE_BITS.
SCALE_BITS = 20
LANES = 2048
CHECKPOINT_ROUNDS = 128
#: A block is closed when it has so many ids; a document isn't divided.
BLOCK_IDS = 1 << 20
END_ID = 2
_LOW = np.uint64(1 << 31)
_U = np.uint64
#: Magic, ids, lanes, rounds from checkpoint to checkpoint, words, documents; then the check sum of all before the words.
_HEAD = struct.Struct("<4sQIIQQ")


def frequencies(counts: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to whole numbers of at least 1 that add up to 2**scale_bits; symbols that never came keep 1."""
    total = 1 << scale_bits
    if len(counts) > total:
        raise ValueError("more symbols than the scale has room for")
    share = counts / max(1, counts.sum()) * (total - len(counts))
    out = 1 + np.floor(share).astype(np.int64)
    rest = total - int(out.sum())
    out[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
    if out.sum() != total:  # no counts at all
        out[: total - int(out.sum())] += 1
        out[0] += total - int(out.sum())
    return out


@dataclass(frozen=True)
class Frame:
    """A frame's numbers, the places of its checkpoints and words, and its documents."""

    n: int
    lanes: int
    every: int
    segments: int
    marks_at: int
    words_at: int
    words: int
    doc_ids: np.ndarray
    missing: np.ndarray
    sizes: np.ndarray

    def documents(self) -> list[int | None]:
        return [None if gone else d for d, gone in zip(self.doc_ids.tolist(), self.missing.tolist())]


class Coder:
    """Encodes and decodes blocks of ids under one table."""

    def __init__(self, freq: np.ndarray, scale_bits: int = SCALE_BITS):
        self.bits = _U(scale_bits)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.mask = _U((1 << scale_bits) - 1)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_ROUNDS, doc_ids: Sequence[int | None] = (), sizes: Sequence[int] = ()) -> bytes:
        """A frame: header, documents, checkpoints (first that of round 0), check sum of these, words."""
        n = len(ids)
        lanes = max(1, min(lanes, -(-n // 64)))  # short blocks: fewer lanes, so that their states weigh little
        rounds = -(-n // lanes)
        freq, start = self.freq[ids], self.start[ids]
        x = np.full(lanes, _LOW, np.uint64)
        out: list[np.ndarray] = []
        points: list[tuple[int, np.ndarray]] = []
        words = 0
        for r in range(rounds - 1, -1, -1):
            f, s = freq[r * lanes : (r + 1) * lanes], start[r * lanes : (r + 1) * lanes]
            k = len(f)
            y = x[:k]
            full = y >= f << (_U(63) - self.bits)
            if full.any():
                out.append(y[full].astype(np.uint32))
                words += len(out[-1])
                y = np.where(full, y >> _U(32), y)
            q = y // f
            x[:k] = (q << self.bits) + (y - q * f) + s
            if r % every == 0:
                points.append((words, x.copy()))
        stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        plain = np.asarray(ids).astype("<u4")
        span = lanes * every
        marks = b"".join(struct.pack("<QI", words - w, zlib.crc32(plain[i * span : (i + 1) * span])) + p.astype("<u8").tobytes() for i, (w, p) in enumerate(reversed(points)))
        missing = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
        named = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + missing + np.array(sizes, "<u4").tobytes()
        head = _HEAD.pack(MAGIC, n, lanes, every, words, len(doc_ids)) + named + marks
        return head + struct.pack("<I", zlib.crc32(head)) + stream.astype("<u4").tobytes()

    @staticmethod
    def opened(frame: bytes) -> Frame:
        """What stands before a frame's words; its check sum must hold."""
        try:
            magic, n, lanes, every, words, docs = _HEAD.unpack_from(frame)
            size, segments = 12 + 8 * lanes, -(-n // (lanes * every)) if magic == MAGIC else 0
            ids_at = _HEAD.size
            missing_at = ids_at + 8 * docs
            sizes_at = missing_at + -(-docs // 8)
            marks_at = sizes_at + 4 * docs
            end = marks_at + segments * size
            (crc,) = struct.unpack_from("<I", frame, end)
        except (struct.error, ZeroDivisionError):
            raise ValueError("not a frame") from None
        if magic != MAGIC or crc != zlib.crc32(frame[:end]) or len(frame) != end + 4 + 4 * words:
            raise ValueError("not a frame, or a damaged one")
        missing = np.unpackbits(np.frombuffer(frame, np.uint8, sizes_at - missing_at, missing_at), count=docs).astype(bool)
        return Frame(n, lanes, every, segments, marks_at, end + 4, words, np.frombuffer(frame, "<i8", docs, ids_at), missing, np.frombuffer(frame, "<u4", docs, sizes_at).astype(np.int64))

    def segment(self, frame: bytes, opened: Frame, number: int) -> np.ndarray:
        """The ids from one checkpoint to the next, whose check sum must hold; no other segment is read."""
        lanes, first = opened.lanes, number * opened.every
        end = min(first + opened.every, -(-opened.n // lanes))
        mark = opened.marks_at + number * (12 + 8 * lanes)
        at, crc = struct.unpack_from("<QI", frame, mark)
        x = np.frombuffer(frame, "<u8", lanes, mark + 12).astype(np.uint64)
        stream = np.frombuffer(frame, "<u4", opened.words, opened.words_at)
        out = np.empty(min(opened.n, end * lanes) - first * lanes, np.int32)
        try:
            for r in range(first, end):
                k = min(lanes, opened.n - r * lanes)
                y = x[:k]
                slot = y & self.mask
                sym = self.symbol[slot.astype(np.int64)]
                y = self.freq[sym] * (y >> self.bits) + slot - self.start[sym]
                low = np.flatnonzero(y < _LOW)
                if len(low):
                    y[low] = y[low] << _U(32) | stream[at : at + len(low)].astype(np.uint64)
                    at += len(low)
                x[:k] = y
                out[(r - first) * lanes : (r - first) * lanes + k] = sym
        except ValueError:  # the words end too early
            raise ValueError("damaged words") from None
        if zlib.crc32(out.astype("<u4")) != crc:
            raise ValueError("ids differ from their check sum")
        return out

    def decode(self, frame: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of a frame, or of its segments from ``first`` to before ``last``; check sums must hold."""
        opened = self.opened(frame)
        found = [self.segment(frame, opened, i) for i in range(first, opened.segments if last is None else min(last, opened.segments))]
        return np.concatenate(found) if found else np.zeros(0, np.int32)


class WordEncoder:
    """Ids of whole texts with a tokenizer that never joins characters across spaces; each distinct word is encoded once."""

    #: A special token, which ends whatever stands before it.
    PARTING = "<|startoftext|>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parting_id = self.tokenizer.token_to_id(self.PARTING)
        probe = "The quick, brown\nfox's 12\tＡ é é <|endoftext|>"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        if self.parting_id is None or whole != sum((e.ids for e in self.tokenizer.encode_batch(probe.split(), add_special_tokens=False)), []):
            raise ValueError("the tokenizer's ids of a text aren't those of its words")
        self.cache = WordCache(self._encode_words, np.uint16)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [], []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            joined = self.PARTING.join(some)
            if joined.count(self.PARTING) != len(some) - 1:  # a word has the parting token in it
                found = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                sizes.append(np.array([len(f) for f in found]))
                ids += found
                continue
            flat = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(flat == self.parting_id)
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(flat)]])) - 1)
            ids.append(flat[flat != self.parting_id].astype(np.uint16))
        return np.concatenate(sizes), np.concatenate(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as 16-bit numbers, and how many each text has."""
        data, offsets = text_values(texts)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told apart by letter case
            data, offsets = plain_words(data, offsets)
        else:
            data = np.where(data == 10, np.uint8(32), data)
        large = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        return self.cache.ids(large)


_SPACE, _LEAD = 0x20, 0xC3
#: Second bytes (after C3) of the letters from U+00C0 to U+00FF, and of those that have a small one 32 further on.
_LATIN = byte_table((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
_LATIN_LARGE = byte_table((0x80, 0x96), (0x98, 0x9E))
_LARGE, _LETTER = byte_table((0x41, 0x5A)), byte_table((0x41, 0x5A), (0x61, 0x7A))
_BREAK = byte_table((_SPACE, _SPACE), (0x0A, 0x0A))
_BEYOND = byte_table((0x80, _LEAD - 1), (_LEAD + 1, 0xFF))
_MOST_SIGNS = 16
#: Signs of ASCII but for apostrophes, which may begin a token with the letters after them.
_SIGN = byte_table((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with line feeds as spaces, and with fewer distinct words: in words of ASCII signs and the letters up to
    U+00FF, letters are made small and signs at the end (but apostrophes) stand apart.

    Such words hold nothing that composes, so the tokenizer's normalisation does the
    same to them; it cuts signs from letters anyway.  All other words stay as they are.
    """
    if not len(data):
        return data, offsets
    after = np.empty(len(data), bool)  # the second byte of a character from U+00C0
    after[0] = False
    np.equal(data[:-1], _LEAD, out=after[1:])
    space = _BREAK[data]
    out = np.where(space, np.uint8(_SPACE), data)
    starts, ends, _ = runs(~space, offsets)
    if not len(starts):
        return out, offsets
    word_of = lambda places: np.searchsorted(starts, places, side="right") - 1
    plain = np.ones(len(starts), bool)
    plain[word_of(np.flatnonzero(_BEYOND[data] & ~after))] = False
    large = np.flatnonzero(np.where(after, _LATIN_LARGE[data], _LARGE[data]))
    out[large[plain[word_of(large)]]] += np.uint8(32)
    # where the signs at the end of a word begin; a word with a long row of them stays whole
    word = np.flatnonzero(plain & _SIGN[data[ends - 1]])
    last = ends[word] - 1
    for _ in range(_MOST_SIGNS):
        more = (last > starts[word]) & _SIGN[data[last]]
        if not more.any():
            break
        last = last - more
    ended = np.where(after[last], _LATIN[data[last]], _LETTER[data[last]])
    cut = last[ended] + 1
    if len(cut):
        out = np.insert(out, cut, _SPACE)
        offsets = offsets + np.searchsorted(cut, offsets, side="left")
    return out, offsets


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_TOKENS = "part int, before long, doc_id long, ids binary, n int"


def tokenize_ordered(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(part, before, doc_id, ids, n) in ascending order of doc_id within and across parts; ``before`` counts the ids earlier in the part.

    Ids are 16-bit little-endian.  Null texts count as empty; null ids of
    documents come first; rows with one id come by their texts' hashes, then by
    their texts.  Parts are cut by all of these and by row, so that neither one
    id nor one text has to be in one part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                flat, sizes = encoder.encode(batch.column(1))
                raw, ends = flat.astype("<u2").tobytes(), np.cumsum(2 * sizes)
                ids = [raw[a:b] + end for a, b in zip((ends - 2 * sizes).tolist(), ends.tolist())]
                n = sizes + 1
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), batch.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int32())], ["part", "before", "doc_id", "ids", "n"])

    return ordered.mapInArrow(run, _TOKENS)


def count_symbols(tokens: DataFrame, n_symbols: int) -> np.ndarray:
    """How often each id comes in a token table; one row for each id is brought to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_symbols, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=n_symbols)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["id", "n"])

    out = np.zeros(n_symbols, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.id] = row.n
    return out


_BLOCKS = "part int, before long, n long, frame binary"


def encode_blocks(tokens: DataFrame, freq: np.ndarray, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Frames of consecutive documents of a token table; ``before`` and ``n`` tell which of the part's ids each has."""
    shared = tokens.sparkSession.sparkContext.broadcast(freq)  # one number for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            frame = coder.encode(np.frombuffer(b"".join(h[3] for h in held), "<u2"), doc_ids=[h[2] for h in held], sizes=[h[4] for h in held])
            row = {"part": held[0][0], "before": held[0][1], "n": sum(h[4] for h in held), "frame": frame}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for whole in batches:
            for batch in pieces(whole, "ids"):
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and (size >= block_ids or row[0] != held[0][0] or row[1] != held[0][1] + size):
                        yield block()
                        size = 0
                    held.append(row)
                    size += row[4]
        if held:
            yield block()

    return tokens.select("part", "before", "doc_id", "ids", "n").mapInArrow(run, _BLOCKS)


def read_blocks(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """(part, before, doc_id, ids) of each document of a table of blocks, ids as 32-bit little-endian numbers.

    A block is decoded segment by segment, each held against its check sum.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for whole in batches:
            for i in range(whole.num_rows):
                part, before, frame = (c[i].as_py() for c in whole.columns)
                opened = coder.opened(frame)
                ends, names = np.cumsum(opened.sizes), opened.documents()
                starts = ends - opened.sizes
                held, at, done = b"", 0, 0  # bytes of documents that aren't complete yet, from id ``at`` on
                for number in range(opened.segments):
                    held += coder.segment(frame, opened, number).astype("<u4").tobytes()
                    now = int(np.searchsorted(ends, at + len(held) // 4, side="right"))
                    if now == done:
                        continue
                    cuts = [(4 * (a - at), 4 * (b - at)) for a, b in zip(starts[done:now].tolist(), ends[done:now].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * (now - done), pa.int32()), pa.array(before + starts[done:now], pa.int64()), pa.array(names[done:now], pa.int64()), pa.array([held[a:b] for a, b in cuts], pa.binary())], ["part", "before", "doc_id", "ids"])
                    held, at, done = held[cuts[-1][1] :], int(ends[now - 1]), now

    return blocks.select("part", "before", "frame").mapInArrow(run, "part int, before long, doc_id long, ids binary")


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> tuple[str, np.ndarray]:
    """Encodes all documents into a table of blocks at ``path``; returns the path and the shared frequencies.

    Beside the blocks, the frequencies are written to ``path`` + ``.freq``, and
    how many ids stand before each part to ``path`` + ``.offsets``.
    """
    spark = docs.sparkSession
    path = path or scratch.new_path(spark, "blocks")
    tokens = tokenize_ordered(docs, tokenizer_path)
    where = scratch.new_path(spark, "tokens")
    tokens.write.option("compression", "zstd").parquet(where)
    tokens = spark.read.schema(tokens.schema).parquet(where)
    from tokenizers import Tokenizer

    freq = frequencies(count_symbols(tokens, max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), END_ID + 1)))
    encode_blocks(tokens, freq).write.option("compression", "none").parquet(path)
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n"))
    # one row for each task that wrote, however many documents there are
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    offsets.coalesce(1).write.parquet(path + ".offsets")
    spark.createDataFrame([(freq.tolist(),)], "freq array<long>").coalesce(1).write.parquet(path + ".freq")
    scratch.remove(spark, where)
    return path, freq


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    offsets = scratch.broadcast_if_small(spark.read.schema("part int, offset long").parquet(path + ".offsets"))
    return spark.read.schema(_BLOCKS).parquet(path), offsets, np.array(spark.read.parquet(path + ".freq").first().freq)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document in the files of ``write_tokens``; ``start`` counts the ids of all earlier documents."""
    blocks, offsets, freq = _opened(spark, path)
    return read_blocks(blocks, freq).join(offsets, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "ids")


def read_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(start, ids) of the stretch of ids from ``begin`` to before ``end`` in the files of ``write_tokens``, a row for each segment.

    Each row is made from one checkpoint and decodes nothing before it.
    """
    blocks, offsets, freq = _opened(spark, path)
    shared = spark.sparkContext.broadcast(freq)
    first = F.col("offset") + F.col("before")
    wanted = blocks.join(offsets, "part").where((first < end) & (first + F.col("n") > begin)).select(first.alias("first"), "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for whole in batches:
            for i in range(whole.num_rows):
                at, frame = (c[i].as_py() for c in whole.columns)
                opened = coder.opened(frame)
                span = opened.lanes * opened.every
                for number in range(max(0, begin - at) // span, min(opened.segments, -(-(end - at) // span))):
                    from_ = at + number * span
                    ids = coder.segment(frame, opened, number)[max(0, begin - from_) : end - from_]
                    yield pa.RecordBatch.from_arrays([pa.array([max(begin, from_)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    return wanted.mapInArrow(run, "start long, ids binary")


def tokens_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each document, from the written files: start, size and check sum of its ids.

    Null ids come first and stay null, a null text has the end id alone, repeated
    rows are documents of their own, an empty table gives an empty one; other
    columns, whatever their names, aren't read.
    """
    path, _ = write_tokens(docs, tokenizer_path)
    back = read_tokens(docs.sparkSession, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
