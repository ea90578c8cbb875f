"""Quality rules: plain limits, then robust multivariate outliers for each language and source.

Each text becomes a vector of transformed statistics in whole 1/1024ths.  For
each (language, source) a minimum-covariance-determinant estimate is searched from
several starts: a diagonal one of medians and quartiles, the plain covariance of
all rows, and some of as few random rows as span a covariance.  Each goes through
concentration steps: distances under the last estimate go into a histogram for
each group, the least distant ``COVERAGE`` of the group is taken from it, and the
sums and cross products of those rows give the next estimate.  After a few steps
the start of the least determinant goes on until its determinant falls no more.
A group is never gathered anywhere; its sums are whole numbers and so exact in any
order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldloom.llm import scratch
from fieldloom.llm.textbatch import NOT_SPACE, byte_table, mix, pieces, runs, span_hashes, text_values

SYMBOLS = byte_table(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
UPPER = byte_table((0x41, 0x5A))
LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

SCALE = 1024
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats", "f_upper")
#: Standard deviations, in feature units, that an estimate has at least: less than this is no oddity in any text.
FLOORS = (0.08, 0.05, 0.08, 0.08, 0.04)
#: The share of a group that an estimate is made from; starts of random rows; steps of all starts, and of the best one at most.
COVERAGE, RANDOM_STARTS, STEPS, LAST_STEPS = 0.75, 3, 2, 8
#: The last steps end when no logarithm of a determinant falls by more than this.
SETTLED = 1e-4
#: Groups with fewer rows are pooled: by language, then all together; a pool that is still smaller rejects nothing.
MIN_GROUP = 60
#: A vector is rejected if a normal one is as far from the centre with this probability.
TAIL = 1e-9
_BINS_PER_OCTAVE = 16

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STATS = T.StructType([T.StructField(c, T.LongType()) for c in BASE] + [T.StructField(c, T.IntegerType()) for c in FEATURES])


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by its series."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    n = 1
    while term > total * 1e-17:
        term *= half / (a + n)
        total += term
        n += 1
    return min(1.0, total)


def chi2_quantile(p: float, k: int) -> float:
    """The x at which chi2_cdf is p, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _repeats(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each item, whether another of the same row has its hash; items are in order of rows."""
    keys = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    later = out.copy()  # equal to an earlier one
    out[order[:-1][same]] = True
    return np.stack([out, later])


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """How many words are in windows of eight that stand twice or more, and in ones that stand three times or more."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)).view(f"V{8 * WINDOW}").ravel()
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    out = []
    for least in (2, 3):
        at = np.flatnonzero(times[which] >= least)
        cover = np.cumsum(np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + WINDOW, minlength=len(ids) + 1))
        out.append(int((cover[:-1] > 0).sum()))
    return out[0], out[1]


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics and transformed features of each text of a flat batch."""
    n_rows = len(offsets) - 1
    at_rows = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    inside = NOT_SPACE[data]
    starts, ends, n_words = runs(inside, offsets)
    row = np.repeat(np.arange(n_rows), n_words)
    word_chars = at_rows(inside & ((data & 0xC0) != 0x80))
    n_symbols = at_rows(SYMBOLS[data])
    # lines with a word
    l_starts, l_ends, n_lines = runs(data != 10, offsets)
    words_in = np.searchsorted(starts, l_ends) - np.searchsorted(starts, l_starts)
    l_row = np.repeat(np.arange(n_rows), n_lines)
    real = words_in > 0
    l_starts, l_ends, l_row = l_starts[real], l_ends[real], l_row[real]
    n_dup_lines = np.bincount(l_row[_repeats(l_row, span_hashes(data, l_starts, l_ends))[1]], minlength=n_rows) if len(l_row) else np.zeros(n_rows, np.int64)
    # words in windows of eight that stand twice or more in the text, and three times or more
    n_repeat_words, n_often_words = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    if len(row) >= WINDOW:
        hashes = mix(span_hashes(data, starts, ends))
        n = len(row) - WINDOW + 1
        window = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
        whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        n_repeat_words[np.unique(row[whole[_repeats(row[whole], window[whole])[0]]])] = 1
    # equal hashes only tell in which texts to look; there, bytes are compared
    first = np.searchsorted(row, np.arange(n_rows + 1))
    for r in np.flatnonzero(n_repeat_words).tolist():
        a, b = first[r], first[r + 1]
        n_repeat_words[r], n_often_words[r] = repeated_words([data[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())])
    first = np.searchsorted(l_row, np.arange(n_rows + 1))
    for r in np.flatnonzero(n_dup_lines).tolist():
        a, b = first[r], first[r + 1]
        n_dup_lines[r] = b - a - len({data[x:y].tobytes() for x, y in zip(l_starts[a:b].tolist(), l_ends[a:b].tolist())})
    words, lines = np.maximum(n_words, 1), np.maximum(np.bincount(l_row, minlength=n_rows), 1)
    raw = (
        np.log(np.maximum(word_chars, 1) / words),
        np.log1p(n_symbols / words),
        # one repeated line is no oddity; weights let 0.38 of the lines, or 0.23 of the words, reach the cutoff over the floors
        1.5 * np.maximum(n_dup_lines - 1, 0) / lines,
        2.5 * n_often_words / words,
        at_rows(UPPER[data]) / np.maximum(at_rows(LETTER[data]), 1),
    )
    values = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)))
    return values | {c: np.rint(SCALE * x).astype(np.int32) for c, x in zip(FEATURES, raw)}


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct column ``out`` of base statistics and features; a null text has no words."""
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, _STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                stats = text_statistics(*text_values(batch.column(batch.schema.get_field_index(text))))
                kinds = [pa.int64()] * len(BASE) + [pa.int32()] * len(FEATURES)
                column = pa.StructArray.from_arrays([pa.array(stats[c], k) for c, k in zip((*BASE, *FEATURES), kinds)], [*BASE, *FEATURES])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), column], [*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)


def base_failed(stats: Column) -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"])


def _group_key(parts: list[Column]) -> Column:
    return F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]))


def _moments_schema() -> list[str]:
    return ["n"] + [f"s{i}" for i in range(len(FEATURES))] + [f"q{i}_{j}" for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _moments(features: list[Column]) -> list[Column]:
    """Whole-number sums; a feature is under 2**15 in size, so 2**33 rows stay within a long."""
    long = [f.cast("long") for f in features]
    out = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(long)]
    return out + [F.sum(long[i] * long[j]).alias(f"q{i}_{j}") for i in range(len(long)) for j in range(i, len(long))]


_MODEL = "key string, start int, mu array<double>, inv array<double>, size double"


def estimate(n: float, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse covariance (in feature units) and logarithm of the determinant, from sums; floors are added to the variances."""
    mu = sums / n
    cov = factor * (products - np.outer(sums, sums) / n) / n / SCALE**2 + np.diag(np.square(FLOORS))
    return mu / SCALE, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def consistency(coverage: float, k: int) -> float:
    """By how much the covariance of the central ``coverage`` of a normal sample is too small."""
    return coverage / chi2_cdf(chi2_quantile(coverage, k), k + 2)


def _sums(record: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    k = len(FEATURES)
    products = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            products[i, j] = products[j, i] = float(record[f"{prefix}q{i}_{j}"])
    return np.array([float(record[f"{prefix}s{i}"]) for i in range(k)]), products


def _models(table: DataFrame, made) -> DataFrame:
    """A row (key, start, mu, inv, size) for each (start, mu, inv, size) that ``made`` gives for a row of the table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(r["key"], start, np.asarray(mu).tolist(), np.asarray(inv).ravel().tolist(), size) for r in f.to_dict("records") for start, mu, inv, size in made(r)]
            yield pd.DataFrame(out, columns=["key", "start", "mu", "inv", "size"])

    return table.mapInPandas(run, _MODEL)


def _starts(keyed: DataFrame, min_group: int) -> DataFrame:
    """The first estimates of each group: 0 of quartiles, 1 of all rows, others of random rows."""
    k, features = len(FEATURES), [F.col(c) for c in FEATURES]
    quartiles = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, c in enumerate(features)]
    # the vector of the least hash under each of k + 1 hash functions
    drawn = [F.min(F.struct(F.xxhash64(F.lit(j * (k + 1) + i), *features), F.array(*features).alias("x")))["x"].alias(f"r{j}_{i}") for j in range(RANDOM_STARTS) for i in range(k + 1)]
    table = keyed.groupBy("key").agg(*_moments(features), *quartiles, *drawn).where(F.col("n") >= min_group)

    def made(r: dict) -> Iterator[tuple]:
        spread = np.array([max((r[f"p{i}"][2] - r[f"p{i}"][0]) / (1.349 * SCALE), FLOORS[i]) for i in range(k)])
        yield 0, np.array([r[f"p{i}"][1] for i in range(k)]) / SCALE, np.diag(1 / np.square(spread)), 2 * float(np.log(spread).sum())
        yield 1, *estimate(int(r["n"]), *_sums(r, ""), 1.0)
        for j in range(RANDOM_STARTS):
            x = np.array([r[f"r{j}_{i}"] for i in range(k + 1)], float)
            yield 2 + j, *estimate(k + 1, x.sum(0), x.T @ x, 1.0)

    return scratch.written(_models(table, made), "estimate")


def concentrated(keyed: DataFrame, model: DataFrame, coverage: float) -> DataFrame:
    """The estimates (key, start) after one step: of the least distant ``coverage`` of each group's rows.

    Rows are taken by bins of distance; of the bin in which the coverage is reached,
    all rows (ties, too) count by the share that is still needed.
    """
    features, names, by = [F.col(c) for c in FEATURES], _moments_schema(), ["key", "start"]
    far = keyed.join(scratch.broadcast_if_small(model), "key").withColumn("d2", distance2(features, F.col("mu"), F.col("inv")))
    bins = far.groupBy(*by, F.floor(_BINS_PER_OCTAVE * F.log2(F.col("d2") + 1e-6)).alias("bin")).agg(*_moments(features))
    # one row for each bin of a group, however many rows the group has
    size = bins.groupBy(*by).agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    need = F.ceil(F.lit(coverage) * F.col("size"))
    begin = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("share"))
    step = lambda acc, b: F.struct((acc["sum"] + b["n"]).alias("sum"), F.when(acc["sum"] < need, b["bin"]).otherwise(acc["last"]).alias("last"), F.when(acc["sum"] < need, F.least(F.lit(1.0), (need - acc["sum"]) / b["n"])).otherwise(acc["share"]).alias("share"))
    ends = size.select(*by, need.alias("need"), F.aggregate("bins", begin, step).alias("e")).select(*by, "need", "e.last", "e.share")
    core = bins.join(ends, by).where(F.col("bin") <= F.col("last"))
    whole = [F.sum(F.when(F.col("bin") < F.col("last"), F.col(c)).otherwise(0)).alias(f"w{c}") for c in names]
    edge = [F.max(F.when(F.col("bin") == F.col("last"), F.col(c))).alias(f"e{c}") for c in names]
    summed = core.groupBy(*by).agg(F.first("need").alias("need"), F.first("share").alias("share"), *whole, *edge)
    factor = consistency(coverage, len(FEATURES))

    def made(r: dict) -> Iterator[tuple]:
        (s, q), (es, eq), share = _sums(r, "w"), _sums(r, "e"), float(r["share"])
        yield int(r["start"]), *estimate(float(r["need"]), s + share * es, q + share * eq, factor)

    return scratch.written(_models(summed, made), "estimate")


def distance2(features: list[Column], mu: Column, inv: Column) -> Column:
    """The squared Mahalanobis distance of features in 1/1024ths, summed in a fixed order."""
    k = len(features)
    d = [f / F.lit(float(SCALE)) - mu[i] for i, f in enumerate(features)]
    total = None
    for i in range(k):
        for j in range(i, k):
            term = d[i] * d[j] * inv[i * k + j] * (1.0 if i == j else 2.0)
            total = term if total is None else total + term
    return total


def assign(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with the ``key`` of the estimate that their language and source use."""
    return rows.withColumn("fine", _group_key([F.col("lang"), F.col("source")])).join(keys, "fine").drop("fine")


def fit(rows: DataFrame, min_group: int = MIN_GROUP, coverage: float = COVERAGE, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Estimates of each group of a written table with columns ``lang``, ``source`` and the features.

    Returns two written tables: (fine, key), the estimate that each group uses,
    and (key, start, mu, inv, size), ``size`` being the logarithm of its determinant.  Groups of under ``min_group`` rows are pooled by language,
    such pools of under ``min_group`` all together, and a last pool that is
    still smaller has no estimate.  All rows of a group count.
    """
    fine, lang = _group_key([F.col("lang"), F.col("source")]), _group_key([F.col("lang")])
    counts = scratch.written(rows.groupBy(fine.alias("fine"), lang.alias("coarse")).agg(F.count(F.lit(1)).alias("n")), "groups")
    pools = counts.where(F.col("n") < min_group).groupBy("coarse").agg(F.sum("n").alias("pool"))
    keys = counts.join(pools, "coarse", "left").select("fine", F.when(F.col("n") >= min_group, F.col("fine")).when(F.col("pool") >= min_group, F.col("coarse")).otherwise(F.lit("*")).alias("key"))
    keys = scratch.broadcast_if_small(scratch.written(keys, "keys"))
    keyed = assign(rows, keys)
    model = _starts(keyed, min_group)
    for _ in range(steps):
        model = concentrated(keyed, model, coverage)
    # the start of the least determinant; of equal ones the first
    best = F.min_by(F.struct("start", "mu", "inv", "size"), F.struct("size", "start")).alias("b")
    model = scratch.written(model.groupBy("key").agg(best).select("key", "b.start", "b.mu", "b.inv", "b.size"), "estimate")
    for _ in range(LAST_STEPS):
        last, model = model, concentrated(keyed, model, coverage)
        fell = model.join(last.select("key", F.col("size").alias("before")), "key").agg(F.max(F.col("before") - F.col("size"))).first()[0]
        if fell is None or fell <= SETTLED:
            break
    return keys, model


def verdict(rows: DataFrame, keys: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """``rows`` with ``far2`` (null without an estimate) and ``outlier``."""
    cutoff = chi2_quantile(1 - tail, len(FEATURES))
    placed = assign(rows, keys).join(scratch.broadcast_if_small(model.select("key", "mu", "inv")), "key", "left")
    placed = placed.withColumn("far2", distance2([F.col(c) for c in FEATURES], F.col("mu"), F.col("inv"))).drop("key", "mu", "inv")
    return placed.withColumn("outlier", F.coalesce(F.col("far2") > cutoff, F.lit(False)))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each document: base statistics, ``base_failed``, ``kept`` and the squared distance ``far2``.

    Estimates come from the rows that pass the base rules.  A null text has no
    words and fails them; null languages and sources are groups of their own;
    repeated rows count each; whole texts are read, however long; rows that are
    equally distant are judged alike; an empty table gives an empty one; other
    columns, whatever their names, aren't read.
    """
    stated = with_statistics(docs.select("doc_id", "lang", "source", "text"), out="_s").select("doc_id", "lang", "source", *[F.col("_s")[c].alias(c) for c in (*BASE, *FEATURES)], base_failed(F.col("_s")).alias("base_failed"))
    table = scratch.written(stated, "statistics")
    passed = table.where("not base_failed")
    judged = verdict(passed, *fit(passed))
    good = judged.select("doc_id", *BASE, "base_failed", (~F.col("outlier")).alias("kept"), "far2")
    return good.unionByName(table.where("base_failed").select("doc_id", *BASE, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("far2")))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and are no outliers; all columns as they are.

    Texts go through their statistics twice, rather than be written once more
    beside them: first for the estimates, then for the verdict.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))

    def passed(df: DataFrame) -> DataFrame:
        stated = with_statistics(df, out="_s").drop("text").where(~base_failed(F.col("_s")))
        return stated.select("*", *[F.col("_s")[c].alias(c) for c in FEATURES]).drop("_s")

    features = scratch.written(passed(rows.drop("doc")), "features")
    keys, model = fit(features)
    scratch.remove(docs.sparkSession, features)
    judged = verdict(passed(rows), keys, model).where("not outlier")
    return judged.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
