"""Evidence that two names mean the same place (NAME-*). Works on parsed names, so that each is parsed once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import WEAK_WORDS, clean, is_placeholder, let, plain, plain_key, plain_tokens, text, written_out

STRONG = 0.88


def rounded(c: Column, digits: int) -> Column:
    """Half up, as the registry's figures are."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_match(a: Column, b: Column) -> Column:
    need = F.when(F.least(F.length(a), F.length(b)) >= 6, 0.75).otherwise(0.85)
    return (a == b) | (similarity(a, b) >= need)


def matched_count(a: Column, b: Column) -> Column:
    """Words of ``a`` that find a free partner in ``b``, each taking the first."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("used"))

    def step(acc: Column, word: Column) -> Column:
        places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
        free = F.filter(places, lambda i: ~F.array_contains(acc["used"], i) & token_match(word, F.get(b, i)))
        took = F.size(free) > 0
        return F.struct(
            (acc["n"] + took.cast("int")).alias("n"),
            F.when(took, F.concat(acc["used"], F.slice(free, 1, 1))).otherwise(acc["used"]).alias("used"),
        )

    return F.aggregate(a, start, step, lambda acc: acc["n"])


def _weak(word: Column) -> Column:
    return word.isin(WEAK_WORDS)


def _near_weak(word: Column) -> Column:
    """A misspelt weak word is still weak. Of two words three quarters alike, the shorter is at least three quarters as long."""
    long = F.array(*(F.lit(w) for w in WEAK_WORDS if len(w) >= 4))
    as_long = lambda w: F.length(w).between(F.length(word) * 0.75 - 0.01, F.length(word) / 0.75 + 0.01)
    return _weak(word) | ((F.length(word) >= 4) & F.exists(long, lambda w: as_long(w) & (similarity(word, w) >= 0.75)))


def _number(word: Column) -> Column:
    return F.regexp_like(word, F.lit(r"^\d+$"))


def parse_name(c) -> Column:
    """struct<key, words, core, plain_core, numbers, generic, placeholder> of a name."""
    c = text(c)
    read = F.struct(plain(c).alias("plain"), is_placeholder(c).alias("placeholder"))
    split = let(read, lambda r: F.struct(plain_key(r["plain"]).alias("key"), plain_tokens(r["plain"]).alias("tokens"), r["placeholder"].alias("placeholder")))
    parts = let(split, lambda s: F.struct(
        s["key"].alias("key"),
        written_out(s["tokens"]).alias("words"),
        F.array_join(F.filter(s["tokens"], lambda t: ~_weak(t)), "").alias("plain_core"),
        s["placeholder"].alias("placeholder"),
    ))

    def finished(p: Column) -> Column:
        core = F.filter(p["words"], lambda t: ~_weak(t))
        return let(
            F.filter(core, lambda t: ~_near_weak(t)),
            lambda own: F.struct(
                p["key"].alias("key"),
                p["words"].alias("words"),
                core.alias("core"),
                p["plain_core"].alias("plain_core"),
                F.array_sort(F.filter(p["words"], _number)).alias("numbers"),
                ((F.size(own) == 0) | (p["plain_core"] == "")).alias("generic"),
                (p["placeholder"] | ((F.size(own) > 0) & F.forall(own, _number))).alias("placeholder"),
            ),
        )

    return let(parts, finished)


def name_evidence(a: Column, b: Column) -> Column:
    """Strong evidence for parsed names: struct<kind, similarity>; null kind if there is none."""
    s = similarity(a["key"], b["key"])
    kind = (
        F.when((a["plain_core"] == "") | (b["plain_core"] == ""), None)
        .when(a["key"] == b["key"], "exact_normalized_name")
        .when(a["plain_core"] == b["plain_core"], "same_core_name")
        .when(s >= STRONG, "high_similarity")
    )
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), s).alias("similarity"))


def _kind(p: Column) -> Column:
    """Kind of relationship of words and cores (fields wa, wb, ca, cb, ka, kb, s)."""
    small = F.size(p["ca"]) <= F.size(p["cb"])
    both = (F.size(p["ca"]) > 0) & (F.size(p["cb"]) > 0)
    ordered = F.struct(F.when(small, p["ca"]).otherwise(p["cb"]).alias("fewer"), F.when(small, p["cb"]).otherwise(p["ca"]).alias("more"))
    contained = let(ordered, lambda o: (F.size(o["fewer"]) >= 2) & (matched_count(o["fewer"], o["more"]) == F.size(o["fewer"])))
    least = F.least(F.size(p["ca"]), F.size(p["cb"]))
    dice = 2 * matched_count(p["ca"], p["cb"]) / (F.size(p["ca"]) + F.size(p["cb"]))
    return (
        F.when(p["ka"] == p["kb"], "exact_normalized_name")
        .when(both & (F.array_join(p["ca"], "") == F.array_join(p["cb"], "")), "core_equal")
        .when(contained, "core_contained")
        .when((p["s"] >= STRONG) | ((least >= 2) & (dice >= 0.85)), "high_similarity")
    )


def numeric_conflict(a: Column, b: Column) -> Column:
    """Equal names but for different numbers."""
    return (a["numbers"] != b["numbers"]) & name_relationship(a, b)["numeric_conflict"]


def name_relationship(a: Column, b: Column, common: Column | None = None) -> Column:
    """struct of flags for two parsed names. ``common``: words too common here to set a place apart."""
    common = F.array().cast("array<string>") if common is None else common

    def compared(d: Column) -> Column:
        def strip(words: Column) -> Column:
            return F.when(d, F.filter(words, lambda t: ~_number(t))).otherwise(words)

        parts = F.struct(*(strip(side[field]).alias(name) for name, side, field in (("wa", a, "words"), ("wb", b, "words"), ("ca", a, "core"), ("cb", b, "core"))), d.alias("differs"))
        keyed = let(parts, lambda p: F.struct(*(p[f].alias(f) for f in ("wa", "wb", "ca", "cb", "differs")), F.array_join(p["wa"], "").alias("ka"), F.array_join(p["wb"], "").alias("kb")))
        scored = let(keyed, lambda p: F.struct(*(p[f].alias(f) for f in ("ca", "cb", "differs", "ka", "kb")), rounded(similarity(p["ka"], p["kb"]), 3).alias("s")))
        return let(scored, lambda p: F.struct(_kind(p).alias("found"), p["s"].alias("s"), p["differs"].alias("differs")))

    def telling(words: Column) -> Column:
        return F.filter(words, lambda t: (F.length(t) >= 4) & ~F.array_contains(common, t))

    shares = F.exists(telling(a["core"]), lambda t: F.exists(telling(b["core"]), lambda u: token_match(t, u)))

    def flags(r: Column) -> Column:
        kind = F.when(~r["differs"], r["found"])
        return F.struct(
            kind.alias("kind"),
            F.coalesce(kind == "exact_normalized_name", F.lit(False)).alias("exact_normalized_name"),
            F.coalesce(kind.isin("core_equal", "core_contained"), F.lit(False)).alias("distinctive_core_name_match"),
            F.coalesce(kind == "high_similarity", F.lit(False)).alias("high_name_similarity"),
            r["s"].alias("similarity"),
            (r["differs"] & r["found"].isNotNull()).alias("numeric_conflict"),
            (~r["differs"] & r["found"].isNull() & shares).alias("shares_distinctive_token"),
        )

    nothing = F.struct(
        F.lit(None).cast("string").alias("kind"), *(F.lit(False).alias(n) for n in ("exact_normalized_name", "distinctive_core_name_match", "high_name_similarity")),
        F.lit(0.0).alias("similarity"), F.lit(False).alias("numeric_conflict"), F.lit(False).alias("shares_distinctive_token"),
    )
    silent = a["generic"] | b["generic"] | a["placeholder"] | b["placeholder"]
    return F.when(silent, nothing).otherwise(let(compared(a["numbers"] != b["numbers"]), flags))


def has_evidence(relationship: Column) -> Column:
    return relationship["kind"].isNotNull()
