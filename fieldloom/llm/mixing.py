"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate (its target share over its share).  A
hash of seed and document id, read as a uniform number, is put through the
inverse Poisson distribution with that mean; the document is exploded by the
count it gives, and the copies are dealt out anew by a second hash.  A large mean
is drawn in equal parts, each with a hash of its own: a sum of Poisson numbers is
one whose mean is the sum of the means, so the count is exact for any mean.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.llm import scratch

#: Weights of sources without given weights are their row counts to this power.
EXPONENT = 0.7
SEED = 17
#: A mean over this is drawn in parts of at most this mean, for which e**-mean is far from underflow.
PART_MEAN = 500
#: Inverse distributions reach this many standard deviations (and as many counts) over the mean; beyond, a tail has less than 1e-16.
_REACH = 12


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 48 bits of the md5 of the parts, joined by colons; nulls count as empty."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def rates(docs: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None, exponent: float = EXPONENT, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): how often a document of each source is taken on average.

    The target shares are ``weights`` (a source without one gets none), else
    powers of the row counts; the expected number of rows is ``epochs`` times
    the table's.  Rows with a null source are a source of their own, whose
    weight is given under the empty string.  If no source of the table has a
    weight, all rates are 0; an empty table gives an empty one.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    else:
        if any(w < 0 for w in weights.values()) or not any(weights.values()):
            raise ValueError("weights are numbers from 0, and not all 0")
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        weight = F.coalesce(F.element_at(table, F.coalesce("source", F.lit(""))), F.lit(0.0))
    weighed = counts.withColumn("w", weight)
    totals = weighed.agg(F.struct(F.sum("n").alias("n"), F.sum("w").alias("w"))).scalar()
    share = F.try_divide(F.lit(epochs) * F.col("w"), totals["w"])
    return weighed.select("source", "n", F.coalesce(share * totals["n"] / F.col("n"), F.lit(0.0)).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as far as it matters."""
    steps = F.sequence(F.lit(1), F.ceil(rate + _REACH * F.sqrt(rate)).cast("int") + F.lit(_REACH))
    first = F.exp(-rate)
    start = F.struct(F.array(first).alias("cdf"), first.alias("p"))
    return F.aggregate(steps, start, lambda acc, k: F.struct(F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"), (acc["p"] * rate / k).alias("p")), lambda acc: acc["cdf"])


def replicate(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: Mapping[str, float] | None = None, exponent: float = EXPONENT, epochs: float = 1.0, seed: int = SEED, extra: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count and the copies shuffled globally.

    ``extra`` names two more columns: the copy's number (from 1) and its place
    in the random order, by which partitions are dealt out and sorted.  Rows with
    the same id have the same count at the same rate.  Null ids share one draw, a
    null source is a source; whole rows are repeated, whatever their texts.  An
    empty table gives an empty one.  Columns with clashing names are kept as they
    are.  Tables of over 50,000 sources are joined by a shuffle, in which Spark's
    adaptive execution splits a hot source.
    """
    table = scratch.written(rates(docs, source, weights, exponent, epochs), "rates")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("long")
    cdf = table.select(F.col("source").alias("_source"), parts.alias("_parts"), _distribution(F.col("rate") / parts).alias("_cdf"))
    cdf = F.broadcast(cdf) if table.count() <= scratch.BROADCAST_ROWS else cdf
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col(source).alias("_of"), F.col(doc_id).alias("_id"))
    drawn = rows.join(cdf, F.col("_of").eqNullSafe(F.col("_source")))
    below = lambda u: F.size(F.filter("_cdf", lambda c: c <= u)).cast("long")
    first = below(uniform(F.lit(seed), "_id"))
    others = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_parts") - 1), F.lit(0).cast("long"), lambda n, j: n + below(uniform(F.lit(seed), "_id", F.lit("part"), j)))
    counted = drawn.select("_doc", "_id", F.when(F.col("_parts") > 1, first + others).otherwise(first).cast("int").alias("_n")).where("_n > 0")
    copies = counted.select("_doc", "_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    placed = copies.select("_doc", "_copy", uniform(F.lit(seed), "_id", "_copy").alias("_place"))
    dealt = placed.repartition(F.col("_place")).sortWithinPartitions("_place", "_copy")
    more = [F.col("_copy").alias(extra[0]), F.col("_place").alias(extra[1])] if extra else []
    return dealt.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], *more)


#: What ``replicate`` gives for the table ``documents`` with its defaults, in DuckDB.
ORACLE_SQL = f"""
with counts as (select source, count(*) n from documents group by source),
rate as (select source, n, {1.0} * power(n::double, {EXPONENT}) / sum(power(n::double, {EXPONENT})) over () * sum(n) over () / n r from counts),
divided as (select source, greatest(1, ceil(r / {PART_MEAN}))::bigint parts, r / greatest(1, ceil(r / {PART_MEAN}))::bigint m from rate),
terms as (select source, parts, m, k, exp(-m) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: m / j)), 1) p
          from (select source, parts, m, unnest(range(0, (ceil(m + {_REACH} * sqrt(m)) + {_REACH} + 1)::bigint)) k from divided)),
cdf as (select source, parts, k, sum(p) over (partition by source order by k) c from terms),
lists as (select source, parts, list(c order by k) c from cdf group by source, parts),
hashed as (select d.*, l.parts, l.c, list_transform(range(0, l.parts), lambda j: (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, '') || case when j = 0 then '' else ':part:' || j end), 1, 12))::bigint + 0.5) / {1 << 48}) u
           from documents d join lists l on d.source is not distinct from l.source),
drawn as (select * exclude (parts, c, u), list_sum(list_transform(u, lambda x: len(list_filter(c, lambda y: y <= x))))::bigint times from hashed),
copies as (select *, unnest(range(1, times + 1)) copy_no from drawn where times > 0)
select doc_id, text, lang, source, n_chars, copy_no::integer copy_no,
       (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || copy_no), 1, 12))::bigint + 0.5) / {1 << 48} place
from copies
"""
