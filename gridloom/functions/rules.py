"""Record rules and small derived columns (FLT-*, PRJ-*, DT-*, ARR-*). ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.geo import cosine_m
from gridloom.functions.text import UNNAMED, clean, has_park_word, name_key, plain, text, turkish_lower

FOODS = ("dry", "wet", "other")
# Source-side words for features that are no parks.
NON_PARK = r"bisiklet|otopark|kav[sş]ak|ref[uü]j|mezarl[ıi]k|cami\b|okul"
# Words that make a name about something other than a green area.
NON_GREEN = ("teknoloji", "teknopark", "otopark", "otopak", "karavan", "hayvanat", "lunapark")


def when_first(*rules: tuple[Column, str]) -> Column:
    """The label of the first rule that holds; null if none does."""
    found = F.lit(None).cast("string")
    for holds, label in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), F.lit(label)).otherwise(found)
    return found


def missing_id(c) -> Column:
    return text(c).isNull() | (text(c).cast("string") == "")


def non_park(layer, name, pattern: str = NON_PARK) -> Column:
    """A non-park word in the layer, or in the name unless the name has a park word."""
    hit = F.lit("(?iu)" + pattern)
    in_layer = F.coalesce(F.regexp_like(text(layer), hit), F.lit(False))
    return in_layer | (~has_park_word(name) & F.coalesce(F.regexp_like(text(name), hit), F.lit(False)))


def trustworthy(name, taxonomy=None, allowed: list[str] | None = None, non_green: tuple[str, ...] = NON_GREEN) -> Column:
    """Row-level evidence of a park: an allowed taxonomy value, else a park word and no word for something else."""
    by_name = has_park_word(name) & ~F.exists(F.array(*map(F.lit, non_green)), lambda w: F.contains(turkish_lower(clean(name)), w))
    if allowed is None:
        return by_name
    return F.coalesce(text(taxonomy).isin(allowed), F.lit(False))


def feeding_error(now: Column) -> Column:
    """The first rule that a feeding (columns of feeding_events) breaks; null for a valid one."""
    food, water = F.col("food_grams"), F.col("water_ml")

    def amount(c: Column) -> Column:
        return c.isNull() | F.isnan(c.cast("double")) | (c != F.floor(c)) | ~c.between(0, 100_000)

    return when_first(
        (amount(food), "food_grams"),
        (amount(water), "water_ml"),
        ((food == 0) & (water == 0), "nothing_given"),
        (~F.coalesce(F.col("food_type").isin(*FOODS), F.lit(False)), "food_type"),
        (F.length("note") > 500, "note"),
        (F.coalesce(F.col("photo_path"), F.lit("")) != F.concat("user_id", F.lit("/"), "id", F.lit(".jpg")), "photo_path"),
        (F.col("occurred_at").isNull() | (F.col("occurred_at") > now + F.expr("interval 5 minutes")), "in_the_future"),
        (F.col("occurred_at") < now - F.expr("interval 90 days"), "too_old"),
    )


def location_error(lat, lon, point_lat, point_lon, most_m: float = 200) -> Column:
    lat, lon = text(lat), text(lon)
    return when_first(
        (lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon), "location_missing"),
        (~lat.between(-90, 90) | ~lon.between(-180, 180), "location_invalid"),
        (cosine_m(lat, lon, point_lat, point_lon) > most_m, "too_far"),
    )


# Plain forms of labels that are no name.
LABELS = ("isimsiz park", "park alani", "park")


def name_proposal_error(proposed, current, evidence) -> Column:
    p, told = clean(proposed), F.trim(text(evidence))
    return when_first(
        (~F.length(p).between(3, 120), "length"),
        (~F.regexp_like(p, F.lit(r"\p{L}")), "no_letter"),
        (F.regexp_like(text(proposed), F.lit(r"[\p{Cntrl}<>]|(?i)https?://|www\.")), "forbidden_text"),
        (plain(p).isin(*LABELS), "generic"),
        (told.isNull() | ~F.length(told).between(10, 600), "evidence"),
        (F.lower(p) == F.lower(text(current)), "unchanged"),
    )


def park_status(last_fed_at, food_status, water_status, observed_at, now: Column) -> Column:
    """check if either bowl was seen empty in the last 24 hours; unknown if nobody ever gave food; old if that was over a
    week ago; else recent. Water given doesn't count."""
    fed, seen = text(last_fed_at), text(observed_at)
    empty = (seen > now - F.expr("interval 24 hours")) & ((text(food_status) == "empty") | (text(water_status) == "empty"))
    return when_first((empty, "check"), (fed.isNull(), "unknown"), (fed < now - F.expr("interval 7 days"), "old"), (F.lit(True), "recent"))


def needs(kind: str, last_water_at, water_status, status) -> Column:
    """Screen filters: ``water`` (never given, or the bowl seen empty), ``check`` (old, unknown or check); else all."""
    if kind == "water":
        return text(last_water_at).isNull() | F.coalesce(text(water_status) == "empty", F.lit(False))
    return text(status).isin("old", "unknown", "check") if kind == "check" else F.lit(True)


def age_label(ts, now: Column) -> Column:
    ts, now = text(ts).cast("timestamp"), now.cast("timestamp")
    minutes = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000))
    # The texts of ages.
    return (
        F.when(ts.isNull(), "Henüz kayıt yok").when(minutes < 1, "Az önce").when(minutes < 60, F.format_string("%d dk önce", minutes))
        .when(minutes < 24 * 60, F.format_string("%d saat önce", F.floor(minutes / 60)))
        .otherwise(F.format_string("%d gün önce", F.floor(minutes / (24 * 60))))
    )


def distance_label(km) -> Column:
    km = text(km)
    return F.when(km < 1, F.format_string("%d m", F.floor(km * 1000 + 0.5))).otherwise(F.format_string("%.1f km", km))


def short_code(c) -> Column:
    """The first ten characters of an id without dashes, in capitals."""
    return F.upper(F.substring(F.regexp_replace(text(c).cast("string"), "-", ""), 1, 10))


def is_unnamed(name) -> Column:
    return (F.trim(F.coalesce(text(name), F.lit(""))) == "") | (text(name) == UNNAMED)


def display_name(name, id_col) -> Column:
    return F.when(is_unnamed(name), F.concat(F.lit("Park alanı · "), short_code(id_col))).otherwise(text(name))


def place_label(address, district, city) -> Column:
    """The filled ones of address, district and city; the country if none is."""
    parts = F.filter(F.array(text(address), text(district), text(city)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(parts) == 0, "Türkiye").otherwise(F.array_join(parts, " · "))


def source_link(osm_id, url) -> Column:
    own = F.when(F.coalesce(text(osm_id), F.lit("")) != "", F.concat(F.lit("https://www.openstreetmap.org/"), text(osm_id)))
    return F.coalesce(F.nullif(text(url), F.lit("")), own, F.lit(""))


def only_source(refs, code: str) -> Column:
    """At least one ref, all of them of one source."""
    return (F.size(text(refs)) > 0) & F.forall(text(refs), lambda r: r["source_code"] == code)


def has_source(refs, code: str) -> Column:
    return F.coalesce(F.exists(text(refs), lambda r: r["source_code"] == code), F.lit(False))


def district_match(a, b) -> Column:
    """UNKNOWN if either is missing, else SAME_DISTRICT or DISTRICT_CONFLICT."""
    ka, kb = name_key(a), name_key(b)
    return F.when((ka == "") | (kb == ""), "UNKNOWN").when(ka == kb, "SAME_DISTRICT").otherwise("DISTRICT_CONFLICT")
