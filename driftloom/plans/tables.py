"""How the driver's tables stand in for point clouds: types, days, bouts and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scalars import FACTOR, SHIFT
from driftloom.operators import moments as M
from driftloom.operators.drift import supported_sides

TYPES = ["event_type"]
SIDE = ["event_type", "day"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def event_points(spark: SparkSession, sf_dir: str, supported: bool = True) -> DataFrame:
    """event_type, day, bout (the user), z = [value]; only days with 20 rows and 4 bouts."""
    points = M.points(events(spark, sf_dir), SIDE, "user_id", "value")
    return supported_sides(points, SIDE) if supported else points


def event_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bout_moments(event_points(spark, sf_dir), SIDE)


def in_pieces(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The frames' rows, ``size`` at a time, so that what is made of them does not pile up."""
    for frame in frames:
        for begin in range(0, len(frame), size):
            yield frame.iloc[begin : begin + size]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, bout (vec_id % 10), z: the embeddings as doubles."""
    z = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 10).alias("bout"), z.alias("z"))


#: The same relations for the SQL side.
SQL_EVENTS = """
e0 as (select *, ts::date as day from events),
e as (select * from e0 semi join (select event_type, day from e0 group by all
    having count(*) >= 20 and count(distinct user_id) >= 4) using (event_type, day)),
bm as (select event_type, day, user_id as bout, count(*) as n, sum(value) as sx, sum(value * value) as sxx, avg(value) as m from e group by all),
s as (select event_type, day, avg(m) as mu, var_samp(m) as v, count(*) as units from bm group by all),
p as (select a.event_type, a.day as day_a, b.day as day_b, (a.mu - b.mu) * (a.mu - b.mu) as naive,
    (a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units as drift
    from s a join s b on a.event_type = b.event_type and a.day < b.day),
tv as (select event_type, day, count(*) as n_rows, var_samp(value) as tv from e group by all)
"""


def sql_round(expression: str, places: int = 6) -> str:
    return f"(round({expression}, {places}) + 0.0::double)"


def sql_hashed(name: str, source: str, unit: str, seed: int, n_draws: int) -> str:
    """``name``: every row of ``source`` in draws 1 to ``n_draws``, with the hashes h1 and h2 of its ``unit`` and the draw."""
    lanes = lambda digest, a, b: f"('0x' || substr({digest}, 1, 8))::bigint as {a}, ('0x' || substr({digest}, 9, 8))::bigint as {b}"
    spread = lambda c: f"(xor({c}, {c} >> {SHIFT}) * {FACTOR}) % 4294967296 as {c}"
    return f"""
{name}_md as (select *, md5(concat_ws(':', {unit})) as md from {source}),
{name}_ln as (select * exclude (md), {lanes('md', 'zx', 'zy')} from {name}_md),
{name}_dr as (select draw, {lanes(f"md5(concat_ws(':', '{seed}', draw::varchar))", 'zp', 'zq')} from range(1, {n_draws + 1}) t(draw)),
{name}_z0 as (select l.* replace (xor(zx, zp) as zx, xor(zy, zq) as zy), draw from {name}_ln l, {name}_dr),
{name}_z1 as (select * replace ({spread('zx')}, {spread('zy')}) from {name}_z0),
{name}_z2 as (select * replace ({spread('zx')}, {spread('zy')}) from {name}_z1),
{name} as (select * exclude (zx, zy), xor(zx, zx >> {SHIFT}) as h1, xor(zy, zy >> {SHIFT}) as h2 from {name}_z2)"""
