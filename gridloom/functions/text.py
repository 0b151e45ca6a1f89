"""Turkish-aware text columns (STR-*)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the letters they stand on, built by rule: the first character of the decomposition.
_LETTERS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
_PAIRS = [(c, base) for c, base in _LETTERS if base != c and base.isascii() and base.isalpha()]
ACCENTED, PLAIN = "".join(c for c, _ in _PAIRS) + "ı", "".join(b for _, b in _PAIRS) + "i"

# Words that say nothing about which place a name means.
WEAK_WORDS = [
    "park", "parki", "parklar", "parklari", "cocuk", "kent", "mahalle", "semt", "belediye", "belediyesi",
    "yesil", "alan", "alani", "oyun", "grubu", "isimsiz", "sokak", "sokagi", "meydan", "meydani",
    "aile", "dinlenme", "spor", "mesire", "bahce", "bahcesi",
]
# Abbreviations in names.
ABBREVIATIONS = {"sht": "sehit"}
PARK_WORD = r"(?<![\p{L}\p{N}])park(lar)?[ıi]?(?![\p{L}\p{N}])"
UNNAMED = "İsimsiz park"


def text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c) -> Column:
    """White space collapsed and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(text(c).cast("string"), F.lit("")), r"\s+", " "))


def turkish_lower(c) -> Column:
    return F.lower(F.translate(text(c), "İI", "iı"))


def plain(c) -> Column:
    """Turkish lower case without accents, other characters kept."""
    return F.regexp_replace(F.translate(turkish_lower(clean(c)), ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def fold(c) -> Column:
    """Search form: plain letters, words set apart by single spaces."""
    return F.trim(F.regexp_replace(plain(c), r"[^a-z0-9]+", " "))


def name_key(c) -> Column:
    """Identity form: plain letters and digits only."""
    return plain_key(plain(c))


def plain_key(p: Column) -> Column:
    """Identity form of a text that is plain already."""
    return F.regexp_replace(p, r"[^a-z0-9]", "")


def turkish_title(c) -> Column:
    def raised(word: Column) -> Column:
        first = F.upper(F.translate(F.substring(word, 1, 1), "iı", "İI"))
        return F.concat(first, F.substring(word, F.lit(2), F.length(word)))

    return F.array_join(F.transform(F.split(turkish_lower(clean(c)), " "), raised), " ")


def _written_out(short: str, long: str):
    return lambda word: F.when(word == short, F.lit(long)).otherwise(word)


def plain_tokens(p: Column) -> Column:
    """Words of a text that is plain already."""
    return F.filter(F.split(p, r"[^a-z0-9]+"), lambda t: t != "")


def written_out(words: Column) -> Column:
    """Words with abbreviations written out."""
    for short, long in ABBREVIATIONS.items():
        words = F.transform(words, _written_out(short, long))
    return words


def tokens(c, expand: bool = False) -> Column:
    """Words of the plain form; ``expand`` writes out abbreviations."""
    words = plain_tokens(plain(c))
    return written_out(words) if expand else words


def _weak(word: Column) -> Column:
    return word.isin(WEAK_WORDS)


def core_key(c) -> Column:
    """Words that carry identity, joined; '' for a weak name."""
    return F.array_join(F.filter(tokens(c), lambda t: ~_weak(t)), "")


def is_weak_name(c) -> Column:
    return core_key(c) == ""


def source_name(tags) -> Column:
    """The display name among the tags of a map column."""
    tags = text(tags)
    wanted = ("name:tr", "name", "official_name", "loc_name")
    return F.coalesce(*(F.nullif(clean(tags[k]), F.lit("")) for k in wanted), F.lit(""))


def has_park_word(c) -> Column:
    return F.regexp_like(turkish_lower(clean(c)), F.lit(PARK_WORD))


def is_placeholder(c) -> Column:
    """Empty, a number, or 'park' and a number."""
    return F.regexp_like(clean(c), F.lit(r"(?i)^(|\d+|park\s*\d+)$"))


def is_generic(c, names: tuple[str, ...] = (UNNAMED, "Yeşil Alan", "Park")) -> Column:
    """Empty or one of the names that mean no particular place; each job has its own list."""
    key = name_key(c)
    found = key == ""
    for name in names:
        found = found | (key == name_key(F.lit(name)))
    return found


def matches_query(columns: list, query: str) -> Column:
    """Accent-free search in any of the columns; queries under two characters match all, 100 characters count."""
    if len(query.strip()) < 2:
        return F.lit(True)
    return F.contains(F.concat_ws(" ", *(fold(c) for c in columns)), fold(F.lit(query[:100])))
