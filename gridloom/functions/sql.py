"""The text, id and distance columns as temporary SQL functions (``register`` once a session)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.functions.geo import EARTH
from gridloom.functions.names import STRONG
from gridloom.functions.text import ACCENTED, PARK_WORD, PLAIN, WEAK_WORDS

_CLEAN = r"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' '))"
_PLAIN = r"regexp_replace(translate(lower(translate({c}, 'İI', 'iı')), '{a}', '{p}'), '[\\u0300-\\u036f]', '')"
_WEAK = ", ".join(f"'{w}'" for w in WEAK_WORDS)


def _plain(c: str) -> str:
    return _PLAIN.format(c=_CLEAN.format(c=c), a=ACCENTED, p=PLAIN)


def _haversine() -> str:
    h = "pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)"
    return f"2 * {EARTH} * asin(least(1e0, sqrt({h})))"


def _key(c: str) -> str:
    return f"regexp_replace({_plain(c)}, '[^a-z0-9]', '')"


def _core(c: str) -> str:
    return f"array_join(filter(split({_plain(c)}, '[^a-z0-9]+'), t -> t <> '' and t not in ({_WEAK})), '')"


_EVIDENCE = (
    f"case when {_core('a')} = '' or {_core('b')} = '' then null when {_key('a')} = {_key('b')} then 'exact_normalized_name' when {_core('a')} = {_core('b')} then 'same_core_name' "
    f"when 1 - levenshtein({_key('a')}, {_key('b')}) / greatest(length({_key('a')}), length({_key('b')})) >= {STRONG} then 'high_similarity' end"
)
_EDGES = "flatten(transform(rings, r -> transform(slice(sequence(0, size(r)), 1, greatest(0, size(r) - 1)), i -> named_struct('x1', r[i][0], 'y1', r[i][1], 'x2', r[i + 1][0], 'y2', r[i + 1][1]))))"
_IN_RINGS = f"size(filter({_EDGES}, e -> (e.y1 > lat) <> (e.y2 > lat) and lon < (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1)) % 2 = 1"
_PLACES = "lat1 double, lon1 double, lat2 double, lon2 double"
#: Name, parameters, type, body.
FUNCTIONS = [
    ("fold", "value string", "string", f"trim(regexp_replace({_plain('value')}, '[^a-z0-9]+', ' '))"),
    ("name_key", "value string", "string", f"regexp_replace({_plain('value')}, '[^a-z0-9]', '')"),
    ("core_key", "value string", "string", f"array_join(filter(split({_plain('value')}, '[^a-z0-9]+'), t -> t <> '' and t not in ({_WEAK})), '')"),
    ("has_park_word", "value string", "boolean", "regexp_like(lower(translate(" + _CLEAN.format(c="value") + ", 'İI', 'iı')), '" + PARK_WORD.replace("\\", "\\\\") + "')"),
    ("name_similarity", "a string, b string", "double", "case when a = '' or b = '' then 0e0 else 1 - levenshtein(a, b) / greatest(length(a), length(b)) end"),
    ("det_uuid", "value string", "string", "concat_ws('-', substr(sha2(value, 256), 1, 8), substr(sha2(value, 256), 9, 4), concat('5', substr(sha2(value, 256), 14, 3)), "
     "concat(substr('89ab', cast(conv(substr(sha2(value, 256), 17, 1), 16, 10) as int) % 4 + 1, 1), substr(sha2(value, 256), 18, 3)), substr(sha2(value, 256), 21, 12))"),
    ("name_evidence", "a string, b string", "string", _EVIDENCE),
    ("point_in_rings", "lon double, lat double, rings array<array<array<double>>>", "boolean", _IN_RINGS),
    ("haversine_m", _PLACES, "double", _haversine()),
    ("cosine_m", _PLACES, "double", f"{EARTH} * acos(greatest(-1e0, least(1e0, sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1)))))"),
]


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions for this session, with ``prefix`` before their names; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {prefix}{name}({parameters}) returns {kind} return {body}")
    return [prefix + name for name, *_ in FUNCTIONS]
