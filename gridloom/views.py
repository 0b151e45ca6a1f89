"""Domain tables derived from the driver's tables by integer formulas, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys of a block: each block of places lies on its own quarter degree, 16 x 60 of them, and has a word of its own.
BLOCK = 2000


def _named(c: str, key: F.Column) -> F.Column:
    block = F.floor(key / BLOCK)
    word = F.concat(F.lit(" k"), F.char(97 + block % 26), F.char(97 + F.floor(block / 26) % 26))
    return F.concat(F.replace(F.replace(c, F.lit("i"), F.lit("ı")), F.lit("o"), F.lit("ö")), F.when(block > 0, word).otherwise(""), F.lit(" Parkı"))


def _lat(key: F.Column, jitter=0) -> F.Column:
    return (38.0 + ((key * 7919) % 20011 + jitter) / 1e5 + (F.floor(key / BLOCK) % 16) * 0.25).cast("double")


def _lon(key: F.Column, jitter=0) -> F.Column:
    return (27.0 + ((key * 104729) % 19997 + jitter) / 1e5 + (F.floor(key / (BLOCK * 16)) % 60) * 0.25).cast("double")


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A park for each customer, every fifth unnamed. The 200 names are broadcast, never the customers, and rows are dealt by
    key: a small file has one split."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part").where("p_partkey < 200").select("p_partkey", "p_name")
    j = c.select("c_custkey", "c_nationkey").repartition("c_custkey").join(F.broadcast(p), F.col("c_custkey") % 200 == F.col("p_partkey"))
    k = F.col("c_custkey")
    return j.select(
        k.alias("id"), F.concat(F.lit("node/"), k.cast("string")).alias("osm_id"), F.when(k % 5 == 0, "İsimsiz park").otherwise(_named("p_name", k)).alias("name"),
        F.concat(F.lit("R"), F.col("c_nationkey").cast("string")).alias("city"), F.concat(F.lit("D"), (k % 7).cast("string")).alias("district"),
        _lat(k).alias("latitude"), _lon(k).alias("longitude"), (k % 11 != 0).alias("active"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A municipal record for each part, a few hundred metres at most from the park with its key."""
    p, k = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").repartition("p_partkey"), F.col("p_partkey")
    return p.select(
        k.alias("id"), k.cast("string").alias("external_id"), _named("p_name", k).alias("name"), F.col("p_brand").alias("taxonomy"),
        _lat(k, k % 300).alias("latitude"), _lon(k, k % 170).alias("longitude"), k.alias("position"),
    )


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 L-shaped regions in a grid, with a part on every block; the missing quarters need the nearest boundary."""
    v = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 0.5), (3, 0.5, 0.5), (4, 0.5, 1.0), (5, 0.0, 1.0)]
    ring = F.array(*(F.struct(F.lit(v[i][1]).alias("ax"), F.lit(v[i][2]).alias("ay"), F.lit(v[(i + 1) % 6][1]).alias("bx"), F.lit(v[(i + 1) % 6][2]).alias("by")) for i in range(6)))
    # 960 blocks at most, whatever the data
    blocks = table(spark, sf_dir, "customer").select((F.floor(F.col("c_custkey") / BLOCK) % 960).alias("block")).distinct()
    n = blocks.crossJoin(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(ring).alias("seq", "e"))))
    x, y = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    east, north = F.floor(F.col("block") / 16) * 0.25, (F.col("block") % 16) * 0.25
    at = {"x1": 27.0 + (x + F.col("e.ax")) * 4e-2 + east, "y1": 38.0 + (y + F.col("e.ay")) * 4.1e-2 + north, "x2": 27.0 + (x + F.col("e.bx")) * 4e-2 + east, "y2": 38.0 + (y + F.col("e.by")) * 4.1e-2 + north}
    return n.select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("region"), "seq", *(v.cast("double").alias(c) for c, v in at.items()))


def feedings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), "user_id", (k % 150).alias("park_id"), F.floor("value").cast("int").alias("food_grams"), ((k % 4) * 250).cast("int").alias("water_ml"), F.col("ts").alias("occurred_at"),
        F.when(F.col("event_type") == "error", "hidden").when(F.col("event_type") == "signup", "deleted").otherwise("published").alias("status"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), "user_id", (k % 150).alias("park_id"), (k % 40).alias("point_id"), F.get(F.array(*map(F.lit, ("full", "low", "empty", "unknown"))), (k % 4).cast("int")).alias("food_status"),
        F.get(F.array(*map(F.lit, ("empty", "full", "low", "unknown"))), (k % 4).cast("int")).alias("water_status"), F.col("ts").alias("observed_at"),
    )


def vets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (38.0 + (k * 31 % 300) / 1e3).alias("latitude"), (27.0 + (k * 17 % 300) / 1e3).alias("longitude"), (k % 4 != 1).alias("active"))


def _sql_named(c: str, k: str) -> str:
    word = f"case when {k} // {BLOCK} > 0 then concat(' k', chr(cast(97 + {k} // {BLOCK} % 26 as int)), chr(cast(97 + {k} // {BLOCK} // 26 % 26 as int))) else '' end"
    return f"concat(replace(replace({c}, 'i', 'ı'), 'o', 'ö'), {word}, ' Parkı')"


def _sql_place(k: str, lat: str = "0", lon: str = "0") -> str:
    return (
        f"38e0 + (({k} * 7919) % 20011 + {lat}) / 1e5 + ({k} // {BLOCK} % 16) * 25e-2 as latitude, "
        f"27e0 + (({k} * 104729) % 19997 + {lon}) / 1e5 + ({k} // {BLOCK * 16} % 60) * 25e-2 as longitude"
    )


#: DuckDB text of the same tables, for the head of an oracle query.
SQL = {
    "parks": f"""parks as (select c_custkey as id, concat('node/', cast(c_custkey as varchar)) as osm_id,
      case when c_custkey % 5 = 0 then 'İsimsiz park' else {_sql_named('p_name', 'c_custkey')} end as name, concat('R', cast(c_nationkey as varchar)) as city,
      concat('D', cast(c_custkey % 7 as varchar)) as district, {_sql_place('c_custkey')},
      c_custkey % 11 <> 0 as active from customer join part on p_partkey = c_custkey % 200)""",
    "source": f"""source as (select p_partkey as id, cast(p_partkey as varchar) as external_id, {_sql_named('p_name', 'p_partkey')} as name, p_brand as taxonomy,
      {_sql_place('p_partkey', 'p_partkey % 300', 'p_partkey % 170')}, p_partkey as position from part)""",
    "edges": """v(k, dx, dy) as (values (0,0e0,0e0),(1,1e0,0e0),(2,1e0,5e-1),(3,5e-1,5e-1),(4,5e-1,1e0),(5,0e0,1e0)),
      blocks as (select distinct c_custkey // 2000 % 960 as block from customer),
      edges as (select concat('R', cast(n_nationkey as varchar)) as region, a.k as seq, 27e0 + (n_nationkey % 5 + a.dx) * 4e-2 + (block // 16) * 25e-2 as x1, 38e0 + (floor(n_nationkey / 5e0) + a.dy) * 4.1e-2 + (block % 16) * 25e-2 as y1,
      27e0 + (n_nationkey % 5 + b.dx) * 4e-2 + (block // 16) * 25e-2 as x2, 38e0 + (floor(n_nationkey / 5e0) + b.dy) * 4.1e-2 + (block % 16) * 25e-2 as y2 from blocks cross join nation cross join v a join v b on b.k = (a.k + 1) % 6)""",
    "vets": """vets as (select s_suppkey as id, 38e0 + (s_suppkey * 31 % 300) / 1e3 as latitude, 27e0 + (s_suppkey * 17 % 300) / 1e3 as longitude, s_suppkey % 4 <> 1 as active from supplier)""",
    "feedings": """feedings as (select event_id as id, user_id, event_id % 150 as park_id, cast(floor(value) as int) as food_grams, cast(event_id % 4 as int) * 250 as water_ml, ts as occurred_at,
      case event_type when 'error' then 'hidden' when 'signup' then 'deleted' else 'published' end as status from events)""",
    "observations": """observations as (select event_id as id, user_id, event_id % 150 as park_id, event_id % 40 as point_id,
      (['full','low','empty','unknown'])[event_id % 4 + 1] as food_status, (['empty','full','low','unknown'])[event_id % 4 + 1] as water_status, ts as observed_at from events)""",
}


def heads(*names: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)


def key_sql(c: str) -> str:
    """DuckDB form of ``text.name_key``."""
    return f"regexp_replace({plain_sql(c)}, '[^a-z0-9]', '', 'g')"


def plain_sql(c: str) -> str:
    return f"replace(strip_accents(lower(replace(replace(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')), 'İ', 'i'), 'I', 'ı'))), 'ı', 'i')"


def haversine_sql(a: str, b: str) -> str:
    return (
        f"2 * 6371000 * asin(least(1e0, sqrt(pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + "
        f"cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2))))"
    )
