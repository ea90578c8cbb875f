"""Texts as sets of word shingles: signatures that likely copies share, and exact similarities of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.llm.textbatch import pieces, row_texts

SEED = 42
#: Bands of minhash rows: at a similarity of 0.8 a pair shares a band with a chance of 0.99995.
BANDS, ROWS = 25, 5
#: Of each minhash row two bits go into a sketch, 32 rows to a number.  At 0.8 a pair differs in 19 rows of 125, and in
#: more than this with a chance of 0.0003.
SKETCH_NUMBERS, MOST_DIFFERENT = 4, 33
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)
_CHUNK = 4096


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """XXH64 of each shingle of the words, repeats included; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = ends[words_each - 1 :] if len(words) >= words_each else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (last - 1).tolist())], np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; 0 if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the rows' functions over the hashes."""
    short, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), _CHUNK):
        low = np.minimum(low, (short[at : at + _CHUNK, None] * _TIMES + _PLUS).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - 2**63 for i, x in enumerate(low.reshape(BANDS, ROWS))]


def sketch_of(low: np.ndarray) -> list[int]:
    """Two bits of each row, packed into signed numbers."""
    two = np.zeros(32 * SKETCH_NUMBERS, np.uint64)
    # of bits that the multiplication has mixed
    two[: len(low)] = (low * np.uint32(0x9E3779B1)) >> np.uint32(30)
    return (two.reshape(SKETCH_NUMBERS, 32) << (2 * np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def rows_that_differ(one: Column, other: Column) -> Column:
    """In how many rows two sketches differ."""
    total = None
    for i in range(SKETCH_NUMBERS):
        x = one[i].bitwiseXOR(other[i])
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("long")))
        total = n if total is None else total + n
    return total


def signed(df: DataFrame, shingle_words: int) -> DataFrame:
    """(row, words, n, simhash, sketch, bands) of a table (row, text): a digest of all words, the number of distinct shingles, and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "text")):
            words, sizes, prints, sketches, keys = [], [], [], [], []
            for text in row_texts(batch.column(1)):
                words.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
                hashes = shingle_hashes(text, shingle_words)
                prints.append(simhash_of(hashes))
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                low = minhash(hashes)
                sketches.append(sketch_of(low))
                keys.append(band_keys(low))
            columns = [batch.column(0), pa.array(words, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sketches, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "words", "n", "simhash", "sketch", "bands"])

    return df.mapInArrow(run, "row bigint, words binary, n bigint, simhash bigint, sketch array<bigint>, bands array<bigint>")


def sets(df: DataFrame, shingle_words: int) -> DataFrame:
    """(row, shingles) of a table (row, text): the hashes of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "text")):
            found = [np.unique(shingle_hashes(x, shingle_words)).view(np.int64) for x in row_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["row", "shingles"])

    return df.mapInArrow(run, "row bigint, shingles array<bigint>")


def alike(pairs: DataFrame, shingles: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of rows whose sets (``row``, ``shingles``) are as similar as the fraction ``least``; two empty sets are."""
    part, whole = least
    one = shingles.select(F.col("row").alias("a"), F.col("shingles").alias("sa"))
    other = shingles.select(F.col("row").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(one, "a").join(other, "b").where(whole * both >= part * (F.size("sa") + F.size("sb") - both)).select("a", "b")
