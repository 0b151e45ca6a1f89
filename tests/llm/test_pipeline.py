"""Each stage of the corpus pipeline against a plain version of what it should keep."""

import hashlib
import math
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from gridloom.functions.session import saved
from gridloom.llm import langid, quality
from gridloom.llm.queries import SOURCE_WEIGHTS
from test_dedup_mix_chat_urls import components_by_hand, wide_by_hand
from test_models import base_by_hand, scores_by_hand, walk


def poisson(key, mean):
    n, parts = 0, max(1, math.ceil(mean / 16))
    for part in range(1, parts + 1):
        u = (int(hashlib.md5(f"{key}:mix:{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = total = math.exp(-mean / parts)
        k = 0
        while total <= u:
            k += 1
            p *= mean / parts / k
            total += p
            n += 1
    return n


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(saved(stage(spark, frames[-1], data), f"test-{k}"))
    assert all(f.columns == columns for f in frames[:-1])
    rows = [f.collect() for f in frames]
    ids = [Counter(r["doc_id"] for r in x) for x in rows]
    text = {r["doc_id"]: r["text"] for r in rows[0]}

    language = langid.fit_language_model(frames[0])
    assert ids[1] == Counter(i for i in ids[0] if round(scores_by_hand(language, text[i]).max(), 6) >= round(language.threshold, 6))

    trees = quality.fit_quality_model(frames[1], spark.read.parquet(f"{data}/labels.parquet"))
    keep = []
    for i in ids[1]:
        n, _, _, _, repeats = base_by_hand(text[i])
        if n >= 50 and 100 * repeats <= 50 * n and walk(trees, quality.statistics(text[i].encode())[1]) >= trees.threshold:
            keep.append(i)
    assert ids[2] == Counter(keep)

    component = components_by_hand(sorted(ids[2]), {i: wide_by_hand(text[i]) for i in ids[2]}, 24, 8)
    assert ids[3] == Counter(set(component.values()))

    source = {r["doc_id"]: r["source"] for r in rows[3]}
    sizes = Counter(source.values())
    weights = {s: SOURCE_WEIGHTS.get(s, 1.0) for s in sizes}
    means = {s: weights[s] / sum(weights.values()) * len(source) / sizes[s] for s in sizes}
    row = {r["doc_id"]: hashlib.md5("\x1f".join("\x1enull" if v is None else str(v) for v in r).encode()).hexdigest() + ":1" for r in rows[3]}
    want = Counter({i: n for i in source if (n := poisson(row[i], means[source[i]]))})
    assert ids[4] == want

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows[5]:
        pieces = library.encode(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(pieces), hashlib.sha256(",".join(map(str, pieces)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(pieces).encode()).hexdigest()
    assert ids[5] == ids[4]
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, rows[5]))
