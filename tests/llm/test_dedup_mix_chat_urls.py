import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import chat, mixing, queries, simhash, urls


def print_by_hand(text, k=4):
    low = text.encode().lower().decode() if text else ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def wide_by_hand(text):
    """128 bits of the distinct five-word shingles."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) or [""]
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), seed=42) for i in range(max(1, len(words) - 4))}
    full, both = (1 << 64) - 1, []
    for h in hashes:
        x = h + 0x9E3779B97F4A7C15 & full
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        both.append(h | (x ^ x >> 31) << 64)
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in both) > len(both))


def components_by_hand(ids, prints, bits, blocks=4, radius=16):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x = prints[i] ^ prints[j]
            if x.bit_count() <= bits and any((x >> 16 * k & 0xFFFF).bit_count() <= radius for k in range(blocks)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: print_by_hand(t) for i, t in texts.items()}
    component = components_by_hand(sorted(texts), prints, 4)
    for r in queries.op8_simhash(spark, data).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", component[r["doc_id"]])


@pytest.mark.parametrize("bits,limit,leaf", [(4, 200_000, None), (4, 3, 1), (3, 5, 9), (7, 50, 20)])
def test_planted_links(spark, bits, limit, leaf):
    r = random.Random(bits * limit)
    prints = set()
    for _ in range(60):
        p = r.getrandbits(64)
        prints.add(p)
        for _ in range(r.randrange(8)):
            for _ in range(r.randrange(1, bits + 3)):
                p ^= 1 << r.randrange(64)
            prints.add(p)
    prints |= {0, 1, (1 << 64) - 1}
    signed = [(i, int(np.array([p], np.uint64).view(np.int64)[0])) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    links = simhash.fingerprint_links(df, bits, limit, leaf).collect()
    own = {f: i for i, f in signed}
    parent = {i: i for i, _ in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unsigned = {i: p for i, p in enumerate(sorted(prints))}
    for a, b in links:
        x, y = find(own[a]), find(own[b])
        parent[max(x, y)] = min(x, y)
    want = components_by_hand(list(unsigned), unsigned, bits)
    assert {i: find(i) for i in unsigned} == want


@pytest.mark.parametrize("limit,leaf", [(200_000, None), (40, 30), (3, 1)])
def test_planted_wide_links(spark, limit, leaf):
    r = random.Random(limit)
    prints = {0, (1 << 128) - 1}
    for _ in range(60):
        p = r.getrandbits(128)
        for _ in range(r.randrange(1, 8)):
            prints.add(p)
            for b in r.sample(range(128), r.randrange(1, 30)):
                p ^= 1 << b
    own = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, p.to_bytes(16, "little")) for i, p in own.items()], "doc_id long, fp binary")
    links = simhash.fingerprint_links(df, 24, limit, leaf, words=2, radius=1).collect()
    number = {p: i for i, p in own.items()}
    found = {(number[int.from_bytes(a, "little")], number[int.from_bytes(b, "little")]) for a, b in links}
    near = {(a, b) for a in own for b in own if (x := own[a] ^ own[b]).bit_count() <= 24 and any((x >> 16 * k & 0xFFFF).bit_count() <= 1 for k in range(8))}
    assert len(near) > len(own) + 100
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in own} == components_by_hand(list(own), own, 24, 8, 1)


@pytest.mark.parametrize("limit", [200_000, 60, 9])
def test_wide_links_need_no_near_block(spark, limit):
    """Pairs of up to 24 of 128 bits whose blocks all differ in two bits or more, and pairs just beyond."""
    r = random.Random(limit)
    prints = set()
    for i in range(150):
        p = r.getrandbits(128)
        prints.add(p)
        for flips in ([3] * 8, [2] * 8, [2, 2, 4, 4, 2, 2, 4, 4], [3] * 7 + [4])[i % 4 :: 2]:
            for block, n in enumerate(flips):
                for b in r.sample(range(16), n):
                    p ^= 1 << 16 * block + b
            prints.add(p)
    own = dict(enumerate(sorted(prints)))
    want = components_by_hand(list(own), own, 24, 8)
    assert len(set(want.values())) < len(set(components_by_hand(list(own), own, 24, 8, 1).values())) - 100
    df = spark.createDataFrame([(i, p.to_bytes(16, "little")) for i, p in own.items()], "doc_id long, fp binary")
    how = {k: v for k, v in simhash.SIMILAR.items() if k != "how"}
    nodes = simhash.star_components(simhash.fingerprint_links(df, shard_limit=limit, words=2, **how))
    number = {p.to_bytes(16, "little"): i for i, p in own.items()}
    groups = {}
    for node, component in nodes.collect():
        groups.setdefault(bytes(component), []).append(number[bytes(node)])
    assert {i: i for i in own} | {i: min(members) for members in groups.values() for i in members} == want


@pytest.mark.parametrize("large", [False, True])
def test_wide_shards_are_searched_exactly(large):
    rng = np.random.default_rng(5)
    n = 1500 if large else 900
    base = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64) | np.uint64(1 << 63)
    filed = [base]
    for flips in (1, 6, 11):
        near = base.copy()
        for _ in range(flips):
            near[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        filed.append(near)
    filed = np.concatenate(filed)
    block = 6
    shard = simhash.Shard(filed, 24, block, 1)
    assert bool(shard.index) == large
    want = set()
    for at in range(0, len(filed), 128):
        x = filed[at : at + 128, None] ^ filed[None]
        ok = (np.bitwise_count(x).sum(axis=2) <= 24) & (np.bitwise_count(x[:, :, 1] >> np.uint64(32) & np.uint64(0xFFFF)) <= 1)
        q, h = np.nonzero(ok)
        want |= set(zip((q + at).tolist(), h.tolist()))
    assert {p for q, h in shard.linked(filed) for p in zip(q.tolist(), h.tolist())} == want


def test_similar_texts_are_caught(spark):
    """Copies with some words changed: at a similarity of 0.8 or more nine of ten are caught, and unrelated texts are not."""
    r = random.Random(8)
    rows, similar = [], {}
    for i in range(300):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(60, 400))]
        other = list(words)
        for at in r.sample(range(len(words)), max(1, len(words) // 60)):
            other[at] = "changed"
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (words, other)]
        similar[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(i, " ".join(words), b"clash"), (1000 + i, " ".join(other).upper(), None)]
    rows += [(5000, None, None), (5001, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp binary")
    assert [simhash.fingerprint_of((x or "").encode(), simhash.SIMILAR["how"]).tobytes() for _, x, _ in rows[:40] + rows[-2:]] == [wide_by_hand(x).to_bytes(16, "little") for _, x, _ in rows[:40] + rows[-2:]]
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df, **simhash.SIMILAR).collect()}
    wanted = [i for i, x in similar.items() if x >= 0.8]
    assert len(wanted) > 50 and sum(found[1000 + i] == i for i in wanted) >= 0.9 * len(wanted)
    assert all(c in (i, i - 1000, 5000) for i, c in found.items()) and found[5001] == 5000
    kept = simhash.keep_one_of_each(df, **simhash.SIMILAR)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(found.values()))
    assert simhash.keep_one_of_each(df.where("false"), **simhash.SIMILAR).count() == 0


def test_large_shards_are_searched_exactly():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (5000, 3)).astype(np.uint64)
    filed = np.unique(np.concatenate([base, base ^ flips[:, 0] ^ flips[:, 1], base ^ flips[:, 2]]))
    block = np.uint64(0xFFFF)
    filed = np.unique(filed & ~block)  # one block near, as in a shard
    large, small = simhash.Shard(filed[:, None], 4, 0), simhash.Shard(filed[:4000, None], 4, 0)
    assert len(large.index) == 3 and not small.index
    want = set()
    for at in range(0, len(filed), 256):
        q, h = np.nonzero(np.bitwise_count(filed[at : at + 256, None] ^ filed[None]) <= 4)
        want |= set(zip((q + at).tolist(), h.tolist()))
    got = {p for q, h in large.linked(filed[:, None]) for p in zip(q.tolist(), h.tolist())}
    assert got == want


@pytest.mark.parametrize("radius,leaf", [(1, 1), (1, 40), (2, 300)])
def test_tree_finds_every_neighbour(radius, leaf):
    rng = np.random.default_rng(leaf)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 16, 3000), 0xABC ^ (1 << np.arange(16)), [0, 0xFFFF]]))
    counts = rng.integers(1, 50, len(values))
    t = simhash.BlockTree(values, counts, radius, leaf)
    assert t.sizes.sum() == counts.sum() and (t.sizes <= max(leaf, 49)).all()
    present, near = set(values.tolist()), [m for m in range(1 << 16) if m.bit_count() <= radius]
    for v in values[:: max(1, len(values) // 200)].tolist():
        leaves = {int(t.home[v ^ m]) for m in near if v ^ m in present}
        assert set(t.asks(np.array([v]))[1].tolist()) == {x for x in leaves if x > t.home[v]}


def test_keep_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, 0), (1, text, 0), (1, text, 0), (2, "completely different words here in this text", 0), (None, text, 0), (4, None, 0), (5, "", 0), (6, text.upper(), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    for limit in (0, 100):
        kept = simhash.keep_one_of_each(df, broadcast_rows=limit)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert simhash.near_duplicates(df.where("false")).count() == 0
    alone = simhash.near_duplicates(df.where("doc_id is null")).first()
    assert alone["component_id"] is None


def test_keep_one_of_components_that_share_an_id(spark):
    texts = ["one two three four five six seven eight nine ten", "completely different words here in this text", "a third text that resembles neither of the others at all"]
    unnamed = [(None, texts[0]), (None, texts[1]), (None, texts[1].upper())]
    repeated = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[2]), (9, texts[2])]
    for rows, want in ((unnamed, [(None, texts[0]), (None, texts[1])]), (repeated, [(7, texts[0]), (7, texts[1]), (8, texts[2])])):
        kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r["doc_id"], r["text"].lower()) for r in kept.collect()) == sorted(want)


def test_poisson_counts_follow_the_distribution(spark):
    import math

    df = spark.range(20000).select(F.col("id"), F.lit("s").alias("source"))
    for mean in (0.3, 2.5, 40.0):
        mixed, copy, _ = mixing.mix_sources(df, "source", {"s": 1.0}, total=20000 * mean)
        counts = [r["count"] for r in mixed.groupBy("id").count().collect()]
        zero = 20000 - len(counts)
        assert sum(counts) / 20000 == pytest.approx(mean, rel=0.03)
        assert zero / 20000 == pytest.approx(math.exp(-mean), abs=0.01)
        assert (sum(c * c for c in counts) / 20000 - (sum(counts) / 20000) ** 2) == pytest.approx(mean, rel=0.08)


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (None, "b"), (4, "gone")], "id long, source string").withColumn("copy", F.lit("clash")).withColumn("shuffle_key", F.lit(0))
    mixed, copy, order = mixing.mix_sources(df, "source", {"a": 2.0, None: 5.0, "gone": 0.0}, total=100)
    rows = mixed.collect()
    assert {copy, order} == {"copy_", "shuffle_key_"} and {r["source"] for r in rows} == {"a", None, "b"}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(df.repartition(3), "source", {"a": 2.0, None: 5.0, "gone": 0.0}, total=100)[0].collect()))
    assert mixing.mix_sources(df.where("false"), "source", {})[0].count() == 0


def test_mix_with_a_third_of_null_ids_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    nulls = spark.range(2000).select(F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    equal = spark.range(2000).select(F.lit(7).cast("bigint").alias("id"), F.lit("same").alias("text"), F.lit("b").alias("source"))
    own = spark.range(2000).select("id", F.col("id").cast("string").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    df = nulls.union(equal).union(own)
    mixed, copy, order = mixing.mix_sources(df, "source", {"a": 3.0, "b": 1.0}, total=8000)
    rows = mixed.withColumn("part", F.spark_partition_id()).collect()
    sizes = {s: sum(r["source"] == s for r in rows) for s in "ab"}
    assert sizes["a"] == pytest.approx(6000, rel=0.05) and sizes["b"] == pytest.approx(2000, rel=0.08)
    parts = [sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}]
    assert max(parts) < 1.2 * len(rows) / len(parts)
    assert len({r[order] for r in rows}) == len(rows)
    texts = [sum(r["text"] == t for r in rows) for t in ("text 1", "text 2", "text 3", "text 4", "text 5", "text 6")]
    assert len(set(texts)) > 1
    again = mixing.mix_sources(df.repartition(7), "source", {"a": 3.0, "b": 1.0}, total=8000)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))


def test_mix_with_more_sources_than_are_broadcast(spark, monkeypatch):
    df = spark.range(600).select("id", F.when(F.col("id") % 6 > 0, (F.col("id") % 6).cast("string")).alias("source"))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    few = sorted(map(str, mixing.mix_sources(df, "source", {"1": 3.0})[0].collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2_000)
    assert few == sorted(map(str, mixing.mix_sources(df, "source", {"1": 3.0})[0].collect())) and any("source=None" in r for r in few)


def test_chat(spark):
    rows = [("c", 2, "user", "hi"), ("c", 1, "system", "be kind"), ("c", 3, "bob smith", None), ("c", 4, "user", "bye"), ("n", 1, "system", "alone"), ("c", 4, "user", "bye")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("perspective", F.lit(0))
    found = chat.rotate_perspectives(df).collect()
    assert {r["conv_id"] for r in found} == {"c"}
    for who in ("user", "bob smith"):
        mine = sorted((r for r in found if r["perspective"] == who), key=lambda r: r["char_start"])
        text = "".join(r["rendered"] for r in mine)
        assert all(text[r["char_start"] : r["char_end"]] == r["rendered"] for r in mine)
        learned = [text[r["loss_start"] : r["loss_end"]] for r in mine if r["loss_start"] is not None]
        assert learned == (["hi<|im_end|>", "bye<|im_end|>", "bye<|im_end|>"] if who == "user" else ["<|im_end|>"])
        assert mine[0]["role"] == "system"
    assert any("user name=bob_smith\n" in r["rendered"] for r in found)
    assert chat.rotate_perspectives(df.where("false")).count() == 0


def test_long_conversation_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 5)
    df = spark.range(43).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("role"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    for who in "ab":
        at = 0
        for r in sorted((r for r in chat.rotate_perspectives(df).collect() if r["perspective"] == who), key=lambda r: r["turn"]):
            assert r["char_start"] == at
            at = r["char_end"]


def test_urls(spark):
    cases = {
        "http://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1"), "https://example.org/es/1#y": ("example.org", "/es/1", "example.org/es/"), "http://x.org": ("x.org", "", None),
        "http://x.org/": ("x.org", "/", "org/"), "http://b.com/de/": ("b.com", "/de/", "com/de/"), "ftp://notexample.org/es/": ("notexample.org", "/es/", "org/"), None: ("", "", None), "no scheme": ("", "", None),
        "http://h?a://b/c": ("h", "", None), "http://ÉX.com/fr/": ("Éx.com", "/fr/", "com/fr/"), "a://b\nc.com/fr/z": ("b\nc.com", "/fr/z", "com/fr/"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id int, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([(None, True), (0, None)], "page_id int, bad boolean")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge_urls(df, none, queries.URL_RULES).collect()}
    assert found == dict(enumerate(cases.values()))
    assert urls.judge_urls(df.where("false"), none, queries.URL_RULES).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://bad.spam.net/{i}") for i in range(60)] + [(100 + i, f"http://h{i}.good.com/") for i in range(200)] + [(900, "http://new.spam.net/"), (901, "http://one.good.com/")]
    df = spark.createDataFrame(rows, "page_id int, url string")
    bad = spark.createDataFrame([(i, True) for i in range(58)] + [(58, False), (59, False)] + [(100 + i, i % 20 == 0) for i in range(200)] + [(901, True)], "page_id int, bad boolean")
    found = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, bad, {}).collect()}
    assert found[0] == "block" and found[901] == "allow" and all(found[100 + i] == "allow" for i in range(200))


def test_long_suffix(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x",), ("u@h.com:80",)], "h string")
    s = urls.suffix_of(F.col("h"), ("co.uk",))
    assert [tuple(r) for r in df.select(s, urls.domain_of(F.col("h"), s)).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("x", "x"), ("com", "h.com")]
