"""Fields and points made of the shared tables: one SQL text each, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BATCHES = "(select b, row_number() over (order by b) - 1 as k from (select distinct event_type b from events) d)"

#: By name: the SQL, and the tables it reads.
SQL = {
    "f1": ("""
select t.b, d.x, coalesce(s.v, cast(0 as double)) v, cast(1 + d.x % 3 as double) / 2 wgt, cast(d.x % 5 as double) - 2 g, cast(2 + d.x % 2 as double) h
from (select distinct event_type b from events) t
cross join (select distinct cast(day(ts) as int) - 1 x from events) d
left join (select event_type b, cast(day(ts) as int) - 1 x, cast(count(*) as double) v from events group by 1, 2) s on s.b = t.b and s.x = d.x""", ("events",)),
    "p1": (f"""
select o_orderkey q, bt.b, cast(o_orderkey % 272 as double) / 8 - 2 lx, cast(o_custkey % 7 as double) - 3 g
from orders join {_BATCHES} bt on o_orderkey % 5 = bt.k""", ("orders", "events")),
    "p2": ("""
select o_orderkey q, cast(o_orderkey % n.images as int) b, cast(o_orderkey % 408 as double) / 8 - 1 ly, cast(o_custkey % 520 as double) / 8 - 0.5 lx, cast(o_custkey % 7 as double) - 3 g
from orders cross join (select cast(floor(max(vec_id) / 50) as bigint) + 1 images from embeddings) n""", ("orders", "embeddings")),
    "p3": ("""
select p_partkey q, cast(p_partkey % n.volumes as int) b, cast(p_partkey % 31 as double) / 4 - 0.5 lx, cast(p_size % 33 as double) / 4 - 0.5 ly, cast(p_partkey % 19 as double) / 4 - 0.5 lz, cast(p_size % 5 as double) - 2 g
from part cross join (select cast(floor(max(vec_id) / 4) as bigint) + 1 volumes from embeddings) n""", ("part", "embeddings")),
    "sym": ("""
select o_orderkey q, cast(6 + o_orderkey % 3 as double) h00, cast(7 + o_orderkey % 5 as double) h11, cast(8 + o_custkey % 4 as double) h22, cast(o_orderkey % 2 as double) h01,
       cast(-(o_custkey % 3) as double) h02, cast(o_orderkey % 4 as double) / 4 h12, cast(o_orderkey % 7 as double) v0, cast(o_custkey % 5 as double) - 2 v1, cast(1 as double) v2,
       cast(9 + o_custkey % 2 as double) h33, cast(o_orderkey % 3 as double) / 2 h03, cast(0.5 as double) h13, cast(-(o_orderkey % 2) as double) h23, cast(o_orderkey % 9 as double) - 4 v3,
       cast(o_orderkey % 4 as double) / 2 w0, cast(1 as double) w1, cast(o_custkey % 3 as double) w2, cast(2 as double) w3
from orders""", ("orders",)),
    "mask": ("""
select d.b, d.x, coalesce(s.f, cast(1000000 as double)) f
from (select u.b, c.x from (select distinct user_id b from events) u cross join (select distinct cast(event_id % 64 as int) x from events) c) d
left join (select user_id b, cast(event_id % 64 as int) x, case when max(case when event_type = 'error' then 1 else 0 end) = 1 then cast(0 as double) else cast(1000000 as double) end f
           from events group by 1, 2) s on s.b = d.b and s.x = d.x""", ("events",)),
    "pts": ("""
select p_partkey q, cast(p_size % 9 as double) / 2 - 2 px, cast(p_partkey % 7 as double) / 2 - 1.5 py, cast(p_partkey % 5 as double) / 2 - 1 pz from part""", ("part",)),
    "curve": ("select cast(n_nationkey as int) k, cast(n_nationkey as double) p0, cast(n_regionkey as double) p1 from nation", ("nation",)),
}

_IMAGE = "select cast(floor(vec_id / 50) as int) b, cast(vec_id % 50 as int) y, {pos} x, cast(floor(cast({value} as double) * 64) as double) v, cast(1 + vec_id % 2 as double) wgt, cast(vec_id % 3 as double) v2, cast(vec_id % 5 as double) - 2 g, cast(2 + vec_id % 2 as double) h from {source}"
_VOLUME = "select cast(floor(vec_id / 4) as int) b, {pos} % 8 x, cast(floor({pos} / 8) as int) y, cast(vec_id % 4 as int) z, cast(floor(cast({value} as double) * 64) as double) v, cast((vec_id * 11 + {pos}) % 7 - 3 as double) v1, cast((vec_id * 5 + {pos} * 3) % 9 - 4 as double) v2, cast(1 + (vec_id + {pos}) % 4 as double) / 2 wgt, cast((vec_id * 13 + {pos}) % 19 - 9 as double) g, cast(2 + (vec_id + {pos}) % 3 as double) h from {source}"

DUCK = {k: v for k, (v, _) in SQL.items()} | {
    "f2": _IMAGE.format(pos="cast(pos - 1 as int)", value="embedding[pos]", source="embeddings, range(1, 65) t(pos)"),
    "f3": _VOLUME.format(pos="cast(pos - 1 as int)", value="embedding[pos]", source="embeddings, range(1, 65) t(pos)"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    if name in ("f2", "f3"):
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        return spark.sql((_IMAGE if name == "f2" else _VOLUME).format(pos="pos", value="c", source="(select vec_id, posexplode(embedding) as (pos, c) from {embeddings})"), embeddings=vectors)
    text, tables = SQL[name]
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
