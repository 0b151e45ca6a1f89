"""Keys, windows, sets, samples and small aggregates (JN-1, JN-2, WIN-*, TOP-8, TOP-9, SET-*, AGG-1, AGG-2, AGG-7..14, SNK-3)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.session import dealt
from gridloom.functions.text import name_key, tokens


def first_by(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position."""
    w = Window.partitionBy(key).orderBy(position)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_valid_by_id(df: DataFrame, id_col: str, position: str, valid: Column) -> DataFrame:
    """Adds ``reject``: missing_id, duplicate_id for all but the first valid row of an id, invalid_geometry."""
    missing = F.col(id_col).isNull() | (F.col(id_col).cast("string") == "")
    ranked = df.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    before = Window.partitionBy(id_col).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max("_valid").over(before), F.lit(False))
    reject = F.when(missing, "missing_id").when(taken, "duplicate_id").when(~F.col("_valid"), "invalid_geometry")
    return ranked.withColumn("reject", reject).drop("_valid")


def latest_per(df: DataFrame, key: str, time: str, id_col: str) -> DataFrame:
    """The row with the greatest (time, id) of each key, by a partial aggregate."""
    row = F.max_by(F.struct(*df.columns), F.struct(time, id_col))
    return df.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


#: Seconds of a time slice: rows of one key are sorted within a slice, and slices of a key are joined by their totals.
SLICE_S = 6 * 3600


def _key(keys: list[str]) -> Column:
    """The key columns as one text that tells nulls apart, so that it can be joined on."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def trailing_count_audit(df: DataFrame, keys: list[str], time: str, seconds: int, limit: int, slice_s: int = SLICE_S) -> DataFrame:
    """Rows with ``in_window``, the rows of the key in the interval up to and with them, and ``over_limit``. An audit: it
    counts refused rows too, unlike enforcement (streaming.events.rate_limited_batch).

    A count is the difference of two running counts of the key, up to the row's time and to the interval's begin. Each is one
    within its time slice and the total of the slices before, so no task takes more than a slice of a key, however many rows
    the key has. Rows of one time have one count; rows without a time are counted among themselves."""
    wide, width = seconds * 1_000_000, slice_s * 1_000_000
    marked = df.withColumn("_key", _key(keys)).withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    times = marked.groupBy("_key", "_t").agg(F.count(F.lit(1)).alias("_n"))
    end = F.struct(F.col("_t").alias("x"), F.lit(1).alias("sign"), F.col("_n").alias("n"))
    begin = F.struct((F.col("_t") - wide).alias("x"), F.lit(-1).alias("sign"), F.lit(0).cast("bigint").alias("n"))
    points = times.where("_t is not null").select("_key", "_t", F.explode(F.array(end, begin)).alias("e")).select("_key", "_t", "e.*").withColumn("slice", F.floor(F.col("x") / width))
    # a row a slice: as many as the key's time has slices
    earlier = Window.partitionBy("_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = points.groupBy("_key", "slice").agg(F.sum("n").alias("total")).select("_key", "slice", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # an interval's begin comes before a row of that very time, which is inside
    so_far = F.sum("n").over(Window.partitionBy("_key", "slice").orderBy("x", "sign").rowsBetween(Window.unboundedPreceding, 0))
    counts = points.withColumn("so_far", so_far).join(base, ["_key", "slice"]).groupBy("_key", "_t").agg(F.sum(F.col("sign") * (F.col("so_far") + F.col("base"))).alias("in_window"))
    counts = counts.unionByName(times.where("_t is null").select("_key", "_t", F.col("_n").alias("in_window")))
    told = counts.select(F.col("_key").alias("_of"), F.col("_t").alias("_at"), "in_window")
    joined = marked.join(told, (F.col("_key") == F.col("_of")) & F.col("_t").eqNullSafe(F.col("_at")))
    return joined.select(*df.columns, "in_window", (F.col("in_window") > limit).alias("over_limit"))


def cooldown_audit(df: DataFrame, keys: list[str], time: str, minutes: int, slice_s: int = SLICE_S) -> DataFrame:
    """Rows with ``too_soon``: less than so long after the row before of the same keys. A row looks back within its time slice,
    the first of a slice at the last time of the slices before. Rows without a time are not too soon."""
    marked = df.withColumn("_key", _key(keys)).withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_slice", F.floor(F.col("_t") / (slice_s * 1_000_000)))
    ends = marked.where("_t is not null").groupBy("_key", "_slice").agg(F.max("_t").alias("last"))
    ends = ends.select(F.col("_key").alias("_of"), F.col("_slice").alias("_nth"), F.lag("last").over(Window.partitionBy("_key").orderBy("_slice")).alias("_before"))
    joined = marked.join(ends, (F.col("_key") == F.col("_of")) & (F.col("_slice") == F.col("_nth")), "left")
    last = F.coalesce(F.lag("_t").over(Window.partitionBy("_key", "_slice").orderBy("_t")), F.col("_before"))
    return joined.withColumn("too_soon", F.coalesce(F.col("_t") - last < minutes * 60_000_000, F.lit(False))).select(*df.columns, "too_soon")


def shared_targets(pairs: DataFrame, claimant: str, target: str) -> DataFrame:
    """Adds ``claims``, how many claimants a target has. The claimants of a target are the rows that name it: nothing is
    gathered, so a target of any number of claimants makes no row grow."""
    groups = pairs.groupBy(target).agg(F.count(F.lit(1)).alias("claims"))
    return pairs.join(groups, target)


def shared_claimants(pairs: DataFrame, claimant: str, target: str) -> DataFrame:
    """Adds ``claims`` and ``others``, the other claimants of a shared target (empty for a sole one). What is told of a target
    grows with the square of its claimants."""
    groups = pairs.groupBy(target).agg(F.count(F.lit(1)).alias("claims"), F.array_sort(F.collect_set(claimant)).alias("_all"))
    return pairs.join(groups.hint("merge"), target).withColumn("others", F.array_remove("_all", F.col(claimant))).drop("_all")


def largest_member(df: DataFrame, key: str, area: str, id_col: str = "id") -> DataFrame:
    """The member with the greatest area of each key, the least id on ties."""
    return first_by(df.withColumn("_order", F.struct((-F.col(area)).alias("a"), F.col(id_col).alias("i"))), key, "_order").drop("_order")


def unique_key_match(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) with equal folded keys, each key held by one row on either side."""
    def single(df: DataFrame, name: str) -> DataFrame:
        folded = [name_key(k).alias(f"k{i}") for i, k in enumerate(keys)]
        # dealt, for what is sorted before a count should not be as much as one task of a join before has
        rows = dealt(df.select(F.struct(*df.columns).alias(name), *folded).where("k0 <> ''"), name)
        ks = [f"k{i}" for i in range(len(keys))]
        return rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.first(name).alias(name)).where("n = 1").drop("n")

    return single(a, "a").join(single(b, "b"), [f"k{i}" for i in range(len(keys))]).select("a", "b")


def match_boundaries(parks: DataFrame, polygons: DataFrame, position: str = "position") -> DataFrame:
    """First valid polygon by OSM id of each park."""
    return first_by(parks.join(polygons, "osm_id"), "id", position)


def id_sets(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, state): new, removed or common."""
    a, b = old.select(id_col).distinct().withColumn("_o", F.lit(True)), new.select(id_col).distinct().withColumn("_n", F.lit(True))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").otherwise("common")
    return a.join(b, id_col, "full_outer").select(id_col, state.alias("state"))


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def union_branches(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    found = reduce(DataFrame.unionByName, frames)
    return found.distinct() if distinct else found


def append_sources(registry: DataFrame, results: DataFrame, merged: DataFrame) -> DataFrame:
    """Adds new parks of sources that aren't in ``merged`` (source_code)."""
    fresh = results.join(merged.select("source_code"), "source_code", "left_anti")
    return registry.unionByName(fresh.drop("source_code"), allowMissingColumns=True)


def distinct_refs(refs: DataFrame, position: str = "position") -> DataFrame:
    """(park_id, source_refs): refs of a park by key, the last one wins."""
    key = Window.partitionBy("park_id", "source_code", "external_id").orderBy(F.desc(position))
    last = refs.withColumn("_n", F.row_number().over(key)).where("_n = 1")
    ref = F.struct("source_code", "external_id", "source_url")
    return last.groupBy("park_id").agg(F.array_sort(F.collect_list(ref)).alias("source_refs"))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


def stratified_sample(df: DataFrame, stratum: str, key: str, each: int, total: int, seed: int = 42) -> DataFrame:
    """Up to ``each`` rows of every stratum in hash order, topped up to ``total`` with the next ones."""
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(stratum).orderBy("_draw", key)
    ranked = df.withColumn("_draw", draw).withColumn("_rank", F.row_number().over(w))
    order = [F.when(F.col("_rank") <= each, 0).otherwise(1), "_draw", key]
    base = ranked.where(F.col("_rank") <= max(each, total))
    picked = base.orderBy(*order).limit(total)
    return base.where(F.col("_rank") <= each).unionByName(picked.where(F.col("_rank") > each)).drop("_draw", "_rank")


def canonical_order(df: DataFrame, *keys: str) -> DataFrame:
    """Total order by binary collation."""
    return df.orderBy(*keys)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distance_bands(df: DataFrame, distance: str, edges: tuple[float, ...] = (30, 100, 150, 250)) -> DataFrame:
    """(band, n): <=first, between, >last, none."""
    d = F.col(distance)
    band = F.when(d.isNull(), "none")
    low = None
    for e in edges:
        band = band.when(d <= e, f"<={e:g}" if low is None else f"{low:g}-{e:g}")
        low = e
    return count_by(df.withColumn("band", band.otherwise(f">{low:g}")), "band")


def common_tokens(df: DataFrame, name_col: str = "name", least: int = 15) -> DataFrame:
    """(token, n): words in the names of at least so many rows."""
    words = df.select(F.explode(F.array_distinct(tokens(name_col, expand=True))).alias("token"))
    return count_by(words, "token").where(F.col("n") >= least)


def signal_fractions(members: DataFrame, key: str, flags: list[str], least: float = 0.5) -> DataFrame:
    return members.groupBy(key).agg(*((F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")) >= least).alias(f) for f in flags))


def cluster_values(members: DataFrame, column: str, key: str = "component") -> DataFrame:
    """(component, value, n): the values of a column in each cluster, a row each."""
    return members.where(F.col(column).isNotNull()).groupBy(key, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def cluster_summary(members: DataFrame, links: DataFrame, key: str = "component") -> DataFrame:
    """(component, size, names, targets, max_gap_m, statuses): counts of members, of different names and of different targets,
    the widest gap, and counts by status. ``members``: (id, component, name, status, canonical_id); ``links``: (a, b, gap_m)
    within components. The names and targets themselves are rows of ``cluster_values``."""
    counts = members.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n"))
    # a status each, of a handful
    statuses = counts.groupBy(key).agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    gaps = links.join(members.select(F.col("id").alias("a"), key), "a").groupBy(key).agg(F.max("gap_m").alias("max_gap_m"))
    different = lambda c, name: cluster_values(members, c, key).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    told = statuses.join(different("name", "names"), key, "left").join(different("canonical_id", "targets"), key, "left").join(gaps, key, "left")
    return told.select(key, "size", F.coalesce("names", F.lit(0)).alias("names"), F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("max_gap_m", F.lit(0.0)).alias("max_gap_m"), "statuses")


def profile_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, non_null, distinct_values, unique_share) of candidate columns, one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    found = df.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''")
    values = found.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    stats = values.groupBy("field").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_values"))
    return stats.withColumn("unique_share", F.col("distinct_values") / F.col("non_null"))


def best_field(profile: DataFrame, priority: list[str]) -> Column:
    """Order in which an id field is chosen: unique values first, then the given priority."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("field"))
    return F.struct((F.col("unique_share") < 1).alias("repeats"), F.when(place == 0, 1 << 30).otherwise(place).alias("place"), F.col("field"))


def multi_ref_parks(registry: DataFrame) -> DataFrame:
    """(id, source_code, refs): parks with several refs of one source."""
    refs = registry.select("id", F.explode("source_refs.source_code").alias("source_code"))
    return refs.groupBy("id", "source_code").agg(F.count(F.lit(1)).alias("refs")).where("refs > 1")


def map_clusters(parks: DataFrame, zooms: list[int], radius_px: int = 62, selected: str | None = None, max_zoom: int = 17) -> DataFrame:
    """(zoom, cx, cy, n, latitude, longitude): parks in mercator cells of ``radius_px`` pixels at each zoom."""
    rest = parks if selected is None else parks.where(F.col("id") != selected)
    rest = rest.withColumn("zoom", F.explode(F.array(*(F.lit(z) for z in zooms if z <= max_zoom))))
    size = F.pow(F.lit(2.0), F.col("zoom")) * 256
    s = F.sin(F.radians("latitude"))
    x = (F.col("longitude") / 360 + 0.5) * size
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793)) * size
    cells = rest.withColumn("cx", F.floor(x / radius_px)).withColumn("cy", F.floor(y / radius_px))
    return cells.groupBy("zoom", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def top_groups(df: DataFrame, key: str, n: int = 15) -> DataFrame:
    """(key, n): the largest groups, ties by key (TOP-7)."""
    return count_by(df, key).orderBy(F.desc("n"), key).limit(n)


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """A row of ``schema`` for each row of ``df``: ``step(state, row)`` gives (state, row out), rows of equal keys in order,
    state None at the first. Rows stream through, so a key of any size needs the memory of its state alone."""

    def run(batches):
        names, now, state, begun = None, None, None, False
        for batch in batches:
            told = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if not begun or key != now:
                    now, state, begun = key, None, True
                state, out = step(state, row)
                told.append(out)
            if told:
                names = names or list(told[0])
                yield pa.RecordBatch.from_arrays([pa.array([t[n] for t in told], types[n]) for n in names], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = {f.name: f.type for f in to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)}
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
