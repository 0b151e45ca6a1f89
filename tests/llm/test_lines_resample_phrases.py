import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lines, phrases, queries, resample

DOCS = "doc_id bigint, text string, lang string, lines string, rank int, keys int"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    """(doc_id, text[, lang]) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "x", 1, 2) for r in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- filters


def test_filter_counts_copies_and_takes_them_out_again():
    draw = np.random.default_rng(1)
    some = draw.integers(0, 1 << 63, 20_000).astype(np.uint64)
    own = lines.CuckooFilter.sized(30_000)
    own.add(np.concatenate([some, some[:10_000]]))
    own = lines.CuckooFilter.from_bytes(own.to_bytes())
    copies = own.copies(some)
    assert (copies[:10_000] >= 2).all() and (copies[10_000:] >= 1).all()
    assert (copies[10_000:] > 1).mean() < 0.01
    others = draw.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert (own.copies(others) > 0).mean() < 0.002
    own.remove(np.concatenate([some, some[:10_000]]))
    assert not own.table.any() and not len(own.stash)


def test_filter_keeps_what_does_not_fit_in_its_stash():
    draw = np.random.default_rng(2)
    some = draw.integers(0, 1 << 63, 500).astype(np.uint64)
    own = lines.CuckooFilter.sized(20)
    own.add(some)
    own.add(np.repeat(some[:1], 30))
    assert len(own.stash) > 400 and (own.copies(some) >= 1).all() and own.copies(some[:1])[0] >= 31
    own.remove(some[100:])
    assert (own.copies(some[:100]) >= 1).all()
    with pytest.raises(ValueError):
        lines.CuckooFilter.sized(4).remove(some[:1])


# ---- line dedup


def dedup_by_hand(rows, least=10):
    """doc_id -> (n_lines, n_dropped, kept) of each row, in order of rows."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)], key=order) != i)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def cleaned(index, docs):
    found, name = index.clean(docs)
    return sorted(((r["doc_id"], r[name]["n_lines"], r[name]["n_dropped"], r[name]["text"]) for r in found.collect()), key=repr)


ROWS = [
    (5, "a shared line here\nonly in five, long enough\nshort"), (3, "A SHARED line here  \n\nshort\n\ta shared line here"), (9, None), (10, ""), (None, "a shared line here\nnull has this one"),
    (7, "çok uzun ış\nÇok uzun ış"), (8, "çok uzun ış\nninechars"), (11, "ninechars\nten chars!\n" + "long line of words " * 2000), (12, "ten chars!\nten chars!\n" + "long line of words " * 2000),
    (12, "ten chars!\nten chars!"), (13, "ten\x0bchars!\x0b\nten\u00a0chars!"), (14, "ten\u00a0chars!"),
]


def test_line_dedup_by_hand(spark):
    index = lines.LineIndex.build(frame(spark, ROWS))
    docs = frame(spark, ROWS)
    found, name = index.clean(docs)
    assert name == "lines_" and found.columns == [*docs.columns, "lines_"]
    assert cleaned(index, docs) == dedup_by_hand(ROWS)


def test_line_dedup_is_reversible(spark):
    draw = random.Random(3)
    texts = [(i, "\n".join(f"sentence number {draw.randrange(60)}" for _ in range(draw.randrange(8)))) for i in range(120)]
    draw.shuffle(texts)
    first, second = texts[:70], texts[70:]
    index = lines.LineIndex.build(frame(spark, first), shard_keys=20)
    before = cleaned(index, frame(spark, first))
    assert before == dedup_by_hand(first)
    both = index.insert(frame(spark, second))
    assert cleaned(both, frame(spark, texts)) == dedup_by_hand(texts)
    gone = both.delete(frame(spark, [*second, (4_000, "unknown")]))
    assert cleaned(gone, frame(spark, first)) == before
    # counts and filters are those of an index that never had the second part
    rows = lambda df: sorted(df.select("key", "refs", "first").collect())
    assert rows(gone.counts()) == rows(index.counts())
    filled = lambda i: sum(int((lines.CuckooFilter.from_bytes(bytes(r["blob"])).table != 0).sum()) + len(lines.CuckooFilter.from_bytes(bytes(r["blob"])).stash) for r in i.filters().collect())
    assert filled(gone) == filled(index)
    less = both.delete(frame(spark, first[:35]))
    rest = first[35:] + second
    assert cleaned(less, frame(spark, rest)) == dedup_by_hand(rest)
    again = lines.LineIndex.open(spark, less.path)
    assert again.updates == less.updates
    small = again.compact()
    assert len(small.updates) == 1 and cleaned(small, frame(spark, rest)) == dedup_by_hand(rest)
    assert cleaned(small.insert(frame(spark, rest)), frame(spark, rest)) == dedup_by_hand(rest)  # nothing new


def test_line_dedup_hot_line_and_empty_table(spark):
    rows = [(i, ("the same line everywhere\n" if i % 3 == 0 else "") + f"line of document {i}") for i in range(600)]
    assert cleaned(lines.LineIndex.build(frame(spark, rows), shard_keys=50), frame(spark, rows)) == dedup_by_hand(rows)
    none = frame(spark, [])
    index = lines.LineIndex.build(none)
    assert cleaned(index, none) == []
    assert cleaned(index.insert(frame(spark, rows[:4])), frame(spark, rows[:4])) == dedup_by_hand(rows[:4])


# ---- resampling


def features_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resample_by_hand(docs, target, percent=5, least=20):
    found = [(i, *features_by_hand(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features_by_hand(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resample_query_by_hand(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    found = sorted((tuple(r) for r in queries.op12_resample(spark, data).collect()), key=repr)
    assert found == resample_by_hand(docs, target)


def test_resample_edges(spark):
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choice("alpha beta gamma ünïcode Delta 42 x".split()) for _ in range(n))
    rows = [(i, text(draw.randrange(60))) for i in range(80)] + [(None, text(30)), (3, None), (4, ""), (5, "-- ,,"), (6, "one"), (7, "\x00two\x7fthree four")] + [(90, "same words again " * 9)] * 20
    rows += [(91, text(60_000))]
    target = ["alpha beta", None, "gamma gamma gamma"]
    docs, wanted = frame(spark, rows).repartition(5), frame(spark, [(i, t) for i, t in enumerate(target)])
    kept = lambda percent, t: sorted((tuple(r) for r in resample.resample(docs, t, percent).collect()), key=repr)
    assert kept(50, wanted) == resample_by_hand(rows, target, 50)
    assert kept(100, wanted.limit(0)) == resample_by_hand(rows, [], 100)
    assert resample.resample(docs.limit(0), wanted).collect() == []


# ---- phrases


def phrases_by_hand(docs, top=2000, least=10):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        cuts = [(10**6 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((score, a, words, f[lang, *words[:k]], f[lang, *words[k:]]))
    inside = {(p[0], *p[1 + i : 3 + i]) for p, a in candidates.items() if len(p) == 4 for i in (0, 1) if 100 * a >= 50 * f[p[0], *p[1 + i : 3 + i]]}
    rows = []
    for lang, found in out.items():
        found = sorted((x for x in found if (lang, *x[2]) not in inside), key=lambda x: (-x[0], -x[1], " ".join(x[2]).encode()))
        rows += [(lang, i + 1, " ".join(w), a, left, right, n[lang], score) for i, (score, a, w, left, right) in enumerate(found[:top])]
    return sorted(rows)


@pytest.mark.parametrize("budget", [1 << 20, 300, 40, 1])
def test_phrases_by_hand(spark, monkeypatch, budget):
    monkeypatch.setattr(phrases, "MOST_HEAVY", 1 << 40)
    draw = random.Random(7)
    words = "the The of new york city ölçü a\x01b \x01 x".split(" ")
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(n))
    rows = [(i, text(draw.randrange(40)), draw.choice(["en", "de", None, "und"])) for i in range(150)]
    rows += [(200, None, "en"), (201, "", None), (202, ".,;\n", "fr"), (203, "new york city " * 300, "en"), (204, "lone", "fr")] + [(205, "same old phrase", "fr")] * 12
    rows += [(206, text(20_000), "en")]
    docs = frame(spark, rows).repartition(4)
    found = sorted(tuple(r) for r in phrases.collocations(docs, budget=budget).collect())
    assert found == phrases_by_hand([(t, g) for _, t, g in rows])
    if budget == 300:
        assert sorted(tuple(r) for r in phrases.collocations(docs, budget=budget, top=7).collect()) == phrases_by_hand([(t, g) for _, t, g in rows], 7)


def test_phrases_empty_and_exact(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    one = spark.createDataFrame([(10**14 - 1, 10**14, 10**14 + 7)], "a bigint, l bigint, r bigint").select(phrases._score("a", "l", "r").alias("s"))
    a, x, y = 10**14 - 1, 10**14, 10**14 + 7
    assert one.first()["s"] == 10**6 * a * a // (x * y)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_collocations"])
def test_new_queries_match_sql(spark, data, name):
    from oracle import check

    check(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])
