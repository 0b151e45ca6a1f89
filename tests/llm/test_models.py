import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_by_hand(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


CASES = ["", " ", "\n\n", "a", "a b c a b c", "x x x x", "a\na\n a\na\r\n", "é日本 | <b> #1\u00a0x\u2028y", "\x1c a \x1d b", "w " * 5000]


def test_base_counts_against_brute_force(spark, data):
    for t in CASES + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]:
        assert quality.statistics(t.encode())[0] == base_by_hand(t)


def walk(trees, x):
    score = trees.base
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.limit[at] else trees.right[at]
        score += trees.value[at]
    return 1 / (1 + np.exp(-score))


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    down = [quality.FEATURES.index(f) for f in quality.DECREASING]
    y = ((x[:, 0] - x[:, down[0]] + np.sin(3 * x[:, down[1]]) + rng.normal(size=3000)) > 0).astype(float)
    trees = quality.grow(x, y, down)
    assert trees.probability(x[:50]) == pytest.approx([walk(trees, r) for r in x[:50]])
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.75
    for f in down:
        grid = np.repeat(x[:40], 30, axis=0)
        grid[:, f] = np.tile(np.linspace(-4, 4, 30), 40)
        assert (np.diff(trees.probability(grid).reshape(40, 30), axis=1) <= 1e-12).all()


def test_quality_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op6_quality_rules(spark, data).collect():
        n, chars, symbols, dup, rep = base_by_hand(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["base_failed"] and r["kept"])


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "word " * 60), (2, "")], "doc_id int, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id int, quality int")
    model = quality.fit_quality_model(df, none)
    assert model is None
    rows = df.select("doc_id", quality.quality(df, F.col("text"), model).alias("q")).collect()
    assert [r["q"]["kept"] for r in rows] == [False] * 4 and rows[2]["q"]["n_repeat_words"] == 60
    assert df.where("false").select(quality.quality(df, F.col("text"), model)).count() == 0


def test_learned_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality_model(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", quality.quality(docs, F.col("text"), model).alias("q")).select("quality", "q.*").collect()
    good, bad = ([r["score"] >= model.threshold for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.05


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97 and np.mean([r["rejected"] for r in held]) <= 0.03


def scores_by_hand(model, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    total, n = np.zeros(len(model.labels)), 0
    for size in langid.SIZES:
        for b in langid._subwords(langid.LOWER[raw], size):
            total += model.logits[b]
            n += 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_are_the_same_alone_and_in_chunks(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh é") for _ in range(r.randrange(0, 90))) for _ in range(60)] + ["", "a", "ab", "abc"]
    model = langid.train(texts * 2, (["x", "y"] * 64)[: len(texts) * 2], epochs=1)
    raws = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raws]))).astype(np.int64)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert model.scores(data, offsets) == pytest.approx(np.array([scores_by_hand(model, t) for t in texts]))


def test_language_edges(spark):
    rows = [(i, "the quick brown fox " * 5, "en", 1) for i in range(20)] + [(100 + i, "le petit chat noir dort " * 5, "fr", 1) for i in range(20)] + [(200, None, "en", 1), (201, "123 !?", "en", 1), (202, "", None, 1), (None, "le chat noir", "fr", 1), (203, "ЖЖ", None, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, score int")
    model = langid.fit_language_model(df)
    found = {r["doc_id"]: r["l"] for r in df.select("doc_id", langid.language(df, F.col("text"), model).alias("l")).collect()}
    assert [found[k]["lang"] for k in (200, 201, 202)] == ["und"] * 3 and found[200]["score"] == 0 and found[200]["rejected"]
    assert found[None]["lang"] == "fr" and found[203]["lang"] in ("en", "fr") and found[0]["lang"] == "en"
    nothing = df.where("lang is null")
    assert langid.fit_language_model(nothing) is None
    assert {r["l"]["lang"] for r in nothing.select(langid.language(df, F.col("text"), None).alias("l")).collect()} == {"und"}
    assert df.where("false").select(langid.language(df, F.col("text"), model)).count() == 0


def test_language_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model, texts = langid.fit_language_model(docs), {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op7_language_id(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        p = scores_by_hand(model, texts[r["doc_id"]])
        assert r["lang_pred"] == model.labels[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=2e-6)


def test_quality_verdicts_against_brute_force(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    trees, texts = quality.fit_quality_model(docs, labels), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op6_quality_rules(spark, data).collect():
        score = walk(trees, quality.statistics(texts[r["doc_id"]].encode())[1])
        assert r["kept"] == (not r["base_failed"] and score >= trees.threshold)


def test_ids_of_any_type_and_clashing_names(spark):
    """One id on many rows and string ids; samples stay bounded."""
    rows = [("x", f"the quick brown fox {i} " * 5, "en", i % 2) for i in range(60)] + [(f"d{i}", f"le petit chat noir {i} " * 5, "fr", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, kept int").union(spark.createDataFrame(rows[:9] * 3, "doc_id string, text string, lang string, kept int"))
    model = langid.fit_language_model(df, rows=40)
    assert model is not None and set(model.labels) <= {"en", "fr"}
    labels = df.select("doc_id", (F.col("kept") + 0).alias("quality"))
    trees = quality.fit_quality_model(df, labels, rows=50)
    judged = df.withColumn("score", F.lit(1)).withColumn("q", quality.quality(df, F.col("text"), trees))
    assert judged.count() == df.count() and judged.where("q.n_words is null").count() == 0


def test_labels_of_other_documents_do_not_crowd_out_the_sample(spark):
    good = "the quick brown fox jumps over the lazy dog and runs far away from here "
    rows = [(i, (good if i % 2 else "buy now !!! | | | ") * 8) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    model = quality.fit_quality_model(docs, labels, rows=100)
    assert model is not None
    judged = {r["doc_id"]: r["q"]["score"] for r in docs.select("doc_id", quality.quality(docs, F.col("text"), model).alias("q")).collect()}
    assert min(s for i, s in judged.items() if i % 2) > max(s for i, s in judged.items() if i % 2 == 0)
