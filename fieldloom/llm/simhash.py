"""Near-duplicate documents by 64-bit SimHash with deletion-variant signatures.

Fingerprints are cut into two halves.  Two fingerprints that differ in at most
three bits have a half that differs in at most one bit, so every fingerprint is
indexed under each half as it is, and under each half with one bit left out.
Pairs come from an equality join on these signatures, within buckets of equal
quarters where these are small, and are verified by counting the differing bits.  Copies share one fingerprint and are expanded only
at the end, so a hot group of copies is one row in all joins before that.

``keep_one`` wants all pairs as similar as 0.8 by shingles of five words, of which
fingerprints of 64 bits differ in about ten.  Segments of which one differs by
one bit at most would be too short to tell texts apart, so there bands of
minhashes give candidates beside the signatures, and each is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldloom.llm import scratch, shingle_sets
from fieldloom.llm.textbatch import row_texts

MAX_BITS = 3
SHINGLE_WORDS = 3
#: The shingles and the least Jaccard similarity, as a fraction, of texts of which ``keep_one`` keeps one.
KEPT_WORDS, LEAST = 5, (4, 5)
#: Texts of a bucket up to which all its pairs are held against each other at once.
SMALL = 16
#: A signature whose two sides would give more candidate pairs than this is split by finer signatures.
SPLIT_ABOVE = 4096
#: Fingerprints that share a quarter up to which one task always holds them.
TOGETHER = 1024
_HALF, _QUARTER = 32, 16
#: Fingerprints and candidate pairs that a task takes at once.
_TOGETHER, _PAIRS = 1 << 16, 1 << 21


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; zero for a text without words."""
    return shingle_sets.simhash_of(shingle_sets.shingle_hashes(text, shingle_words))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "simhash", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with a long column: the fingerprint's 64 bits.  A null text counts as empty; a column called ``out`` is replaced."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = row_texts(batch.column(batch.schema.get_field_index(text)))
            values = np.array([fingerprint(x, shingle_words) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(values)], [*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, _HALF * side).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _coded(value: Column, width: int, code: int) -> list[tuple[Column, Column]]:
    """(signature, side) of a value of ``width`` bits: as it is, on both sides; and without each bit, on the side that the bit names."""
    top = lambda n: F.lit((code * (width + 1) + n) << width).cast("long")
    out = [(top(width).bitwiseOR(value), F.lit(s)) for s in (0, 1)]
    for i in range(width):
        out.append((top(i).bitwiseOR(value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i)).cast("long"))), F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1).cast("long")).cast("int")))
    return out


def _exploded(df: DataFrame, options: list[tuple[Column, Column]], key: str) -> DataFrame:
    rows = F.array(*[F.struct(k.alias("k"), s.alias("s")) for k, s in options])
    return df.select("*", F.explode(rows).alias("_v")).select(*df.columns, F.col("_v.k").alias(key), F.col("_v.s").alias("side"))


def _matched(variants: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Verified pairs (a < b) of fingerprints that meet under a signature, from opposite sides."""
    left = variants.where("side = 0").select(*keys, F.col("fp").alias("a"))
    right = variants.where("side = 1").select(*keys, F.col("fp").alias("b"))
    pairs = left.join(right, keys).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _met(bucket: np.ndarray, prints: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_matched`` for whole buckets, held as arrays sorted by bucket: the signatures are made here, one wildcard at a time."""
    beside = (prints >> (np.uint64(16) * (bucket >> 16 ^ 1).astype(np.uint64))).astype(np.int64) & 0xFFFF
    for i in range(_QUARTER + 1):
        exact = i == _QUARTER
        key = bucket << 16 | (beside if exact else beside & ~(1 << i))
        side = np.zeros_like(beside) if exact else beside >> i & 1
        order = np.argsort(key << 1 | side, kind="stable")
        key, side, at = key[order], side[order], prints[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        ends = np.repeat(begins + sizes, sizes)
        # a fingerprint meets those of its signature on the other side, or those after it
        first = np.arange(1, len(key) + 1) if exact else ends - np.repeat(np.add.reduceat(side, begins), sizes)
        many = np.where(side == 0, ends - first, 0)
        total = np.cumsum(many)
        low = 0
        while low < len(key):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + _PAIRS, side="right")))
            each = many[low:high]
            one = np.repeat(np.arange(low, high), each)
            other = np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each) + first[one]
            a, b = at[one], at[other]
            near = np.bitwise_count(a ^ b) <= max_bits
            a, b = a[near].view(np.int64), b[near].view(np.int64)
            yield np.minimum(a, b), np.maximum(a, b)
            low = high


def _matched_in_buckets(dealt: DataFrame, max_bits: int) -> DataFrame:
    """Verified pairs (a < b) of a table (fp, bucket) of buckets that a task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append((batch.column(1).to_numpy(), batch.column(0).to_numpy().view(np.uint64)))
            if not held or batch is not None and sum(len(b) for b, _ in held) < _TOGETHER:
                continue
            bucket, prints = (np.concatenate(x) for x in zip(*held))
            whole = len(bucket) if batch is None else int(np.searchsorted(bucket, bucket[-1]))
            held = [(bucket[whole:], prints[whole:])]
            if whole:
                for a, b in _met(bucket[:whole], prints[:whole], max_bits):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").select("fp", "bucket").mapInArrow(run, "a bigint, b bigint")


def _matched_when_crowded(dealt: DataFrame, max_bits: int, split_above: int) -> DataFrame:
    """Verified pairs (a < b) of a table (fp, bucket) of buckets of any size: each signature is a row, and may have a task of its own.

    A crowded signature isn't cut off: its fingerprints agree in one half but
    for one bit at most, so the other half is signed once more by its quarters,
    one of which again differs in at most one bit.
    """
    beside = F.expr("shiftrightunsigned(fp, cast(16 * (shiftright(bucket, 16) ^ 1) as int)) & 65535")
    variants = _exploded(dealt, _coded(beside, _QUARTER, 0), "k").select("fp", (F.col("bucket") * (1 << 22) + F.col("k")).alias("k"), "side")
    met = variants.groupBy("k").agg(F.sum(F.expr("bigint(side = 0)")).alias("n0"), F.sum(F.expr("bigint(side = 1)")).alias("n1"))
    # an exact value stands on both sides, so it needs two fingerprints
    exact = F.shiftright(F.col("k") % (1 << 22), _QUARTER) == _QUARTER
    met = met.where((F.col("n0") > 0) & (F.col("n1") > 0) & (~exact | (F.col("n0") > 1)))
    # most signatures stand alone; the others' fingerprints are written once, for all that follows
    shared = scratch.written(variants.join(met.select("k", (F.col("n0") * F.col("n1") > split_above).alias("many")), "k"), "signatures")
    few, crowded = shared.where("not many").drop("many"), shared.where("many").drop("many")
    other = F.expr("shiftrightunsigned(fp, cast(32 * (1 - shiftright(k, 39)) as int)) & 4294967295")
    quarter = lambda q: F.shiftrightunsigned(other, 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))
    finer = crowded.withColumnRenamed("side", "outer")
    finer = _exploded(finer, [o for q in (0, 1) for o in _coded(quarter(q), 16, q)], "q")
    # sides of the finer signature; the verification below needs no sides of the outer one
    fine = _matched(finer.select("k", "q", "side", "fp").distinct(), ["k", "q"], max_bits)
    return _matched(few, ["k"], max_bits).unionByName(fine)


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE, together: int = TOGETHER) -> DataFrame:
    """Distinct pairs (a < b) of a table of distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` (3 at most) bits.

    A half that differs in one bit at most has a quarter that doesn't differ.  So
    fingerprints are dealt out by each of their quarters, in four rows and not in one
    for each signature, and a task makes the signatures of the buckets that it has.
    Only buckets of more than ``together`` fingerprints, and of more than four times
    the mean, are dealt out by the signatures themselves.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("two halves find pairs of at most 3 differing bits")
    places = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long")) + (q << 16) for q in range(4)]
    dealt = fingerprints.select("fp", F.explode(F.array(*places)).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("m"))
    # at most a quarter of all 4 * 65,536 buckets have more than four times the mean
    bound = max(together, fingerprints.count() // (1 << 14))
    crowded = scratch.written(sizes.where(F.col("m") > bound).select("bucket"), "crowded")
    if crowded.isEmpty():
        return _matched_in_buckets(dealt, max_bits).distinct()
    held = dealt.join(F.broadcast(crowded), "bucket", "left_anti")
    spread = dealt.join(F.broadcast(crowded), "bucket", "left_semi")
    return _matched_in_buckets(held, max_bits).unionByName(_matched_when_crowded(spread, max_bits, split_above)).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b"), F.col("m").alias("a")).where("a <> b").distinct().select("a", "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a < b; each b's smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): alternating stars until nothing changes, each round a written table."""
    spark = edges.sparkSession
    edges = scratch.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, old = state, edges
        edges = scratch.written(_small_star(_large_star(edges)), "edges")
        scratch.remove(spark, old)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def component_ids(fingerprinted: DataFrame, doc_id: str = "doc_id", simhash: str = "simhash", max_bits: int = MAX_BITS) -> DataFrame:
    """(simhash, component_id) of each distinct fingerprint: the smallest document id that links reach.

    Null ids don't count as smallest; a component with null ids only has a null id.
    """
    nodes = scratch.written(fingerprinted.groupBy(F.col(simhash).alias("fp")).agg(F.min(doc_id).alias("low")), "fingerprints")
    roots = components(links(nodes, max_bits))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    # a row for each component, and below for each fingerprint: never gathered by the driver, however small
    return placed.join(low.hint("merge"), "root").select(F.col("fp").alias(simhash), "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Null or empty texts have fingerprint zero and are linked like any other.
    Repeated rows give repeated rows.  Other columns, whatever their names,
    aren't read.  An empty table gives an empty table.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = scratch.written(with_fingerprint(ids).select("doc_id", "simhash"), "simhash")
    out = prints.join(component_ids(prints, max_bits=max_bits).hint("merge"), "simhash")
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def _wildcards(fp: Column) -> list[Column]:
    """The signatures of both halves without each of their bits: fingerprints of which a half differs in one bit at most share one."""
    out = []
    for side in (0, 1):
        out += [k for k, _ in _coded(_half(fp, side), _HALF, side)[2:]]
    return out


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = KEPT_WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of ``docs`` without near copies: a row goes if it is like one with a smaller id (null last).

    Like are rows whose shingle sets have a Jaccard similarity of at least
    ``least``.  Texts of equal words are one.  The others meet in buckets of equal
    SimHash signatures and equal minhash bands, and are verified on their whole
    sets.  In a large bucket a few texts are held against all others, what is like
    a smaller one goes, and the rest goes on to the next round with more of them, so
    that a hot group of copies doesn't make all its pairs and no pair is left out.

    Of any two rows that stay, none are like each other, but for pairs that share
    no bucket or whose sketches mislead.  Null and empty texts are like each other; of rows that tie,
    fully repeated ones included, one stays.  An empty table gives an empty one;
    all columns stay as they are.
    """
    table = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("doc_id")).withColumn("row", F.monotonically_increasing_id())
    table = scratch.written(table, "numbered")  # from here on row numbers are fixed
    texts = table.select("row", F.col("doc").getField(text).cast("string").alias("text"))
    signed = scratch.written(shingle_sets.signed(texts, shingle_words), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = table.select("row", order.alias("o")).join(signed.select("row", "words"), "row").groupBy("words").agg(F.min("o").alias("o"))
    heads = scratch.written(heads.select(F.col("o.row").alias("row"), "o"), "heads")
    nodes = scratch.written(signed.join(heads, "row").select("row", "o", "n", "simhash", "sketch", "bands"), "nodes")
    keys = nodes.select("row", F.explode(F.concat(F.array(*_wildcards(F.col("simhash"))), "bands")).alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    meeting = scratch.written(keys.join(shared, "k"), "keys")
    members = scratch.written(meeting.join(nodes.select("row", "o", "n", "sketch"), "row").select("k", "o", "n", "sketch"), "members")
    for done in (signed, nodes, meeting):
        scratch.remove(docs.sparkSession, done)
    gone = _like_smaller_ones(members, texts, shingle_words, least)
    stay = heads.select("row") if gone is None else heads.select("row").join(gone, "row", "left_anti")
    return table.join(stay, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, least: tuple[int, int]) -> DataFrame:
    """The greater rows of the pairs (a, b) that are alike, as a written table; only the pairs' texts are made into sets."""
    spark = pairs.sparkSession
    pairs = scratch.written(pairs, "pairs")
    wanted = scratch.written(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "wanted")
    sets = scratch.written(shingle_sets.sets(texts.join(scratch.broadcast_if_small(wanted), "row", "left_semi"), shingle_words), "shingles")
    fresh = scratch.written(shingle_sets.alike(pairs, sets, least).select(F.col("b").alias("row")).distinct(), "gone")
    for done in (pairs, wanted, sets):
        scratch.remove(spark, done)
    return fresh


def _like_smaller_ones(members: DataFrame, texts: DataFrame, shingle_words: int, least: tuple[int, int]) -> DataFrame | None:
    """The rows of a written table (k, o, n, sketch) of buckets' members that are like a smaller one of a bucket; ``texts`` is (row, text)."""
    spark, (part, whole) = members.sparkSession, least
    gone, leaders = None, 1
    while not members.isEmpty():
        sizes = members.groupBy("k").agg(F.count("*").alias("m"))
        parted = members.join(sizes.where("m > 1"), "k").withColumn("part", F.when(F.col("m") <= SMALL, F.col("o.row")).otherwise(F.pmod(F.xxhash64("o.row"), F.lit(leaders))))
        old, members = members, scratch.written(parted.drop("m"), "members")
        scratch.remove(spark, old)
        lead = members.groupBy("k", "part").agg(F.min(F.struct("o", "n", "sketch")).alias("l")).select("k", "l")
        close = (whole * F.least("n", "l.n") >= part * F.greatest("n", "l.n")) & (shingle_sets.rows_that_differ(F.col("sketch"), F.col("l.sketch")) <= shingle_sets.MOST_DIFFERENT)
        met = members.join(lead, "k").where((F.col("o.row") != F.col("l.o.row")) & close)
        pairs = met.select(F.least("o", "l.o").alias("a"), F.greatest("o", "l.o").alias("b")).select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).distinct()
        fresh = _verified(pairs, texts, shingle_words, least)
        gone = fresh if gone is None else gone.unionByName(fresh)
        led = lead.select("k", F.col("l.o.row").alias("row"))
        left = members.select("k", "o", "n", "sketch", F.col("o.row").alias("row")).join(led, ["k", "row"], "left_anti").join(fresh, "row", "left_anti")
        old, members = members, scratch.written(left.select("k", "o", "n", "sketch"), "members")
        scratch.remove(spark, old)
        leaders *= 8
    scratch.remove(spark, members)
    return gone
