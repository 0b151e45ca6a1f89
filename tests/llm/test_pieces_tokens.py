import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloom.llm import queries
from gridloom.llm.pieces import PieceCodec, PieceTable
from gridloom.llm.tokencount import TokenCounter, attribute, token_spans

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces ", "▁x▁", "<s></s><unk>", "日本語テキスト 🎉", "\n\n\t", "é" * 40, " " * 77 + "x", "x" * 3000, "abc " * 500, "\x00\x01"]


@pytest.fixture(scope="module")
def pair():
    return PieceTable(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library(pair, spark, data):
    table, library = pair
    r = random.Random(2)
    texts = ODD + [x[0] for x in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["".join(r.choice("abetr ▁\né日🎉.,<0x0A>s/INGthe  ") for _ in range(r.randrange(60))) for _ in range(2000)]
    for t in texts:
        ids = table.encode(t).tolist()
        assert ids == library.encode(t)
        assert table.decode(ids) == library.decode(ids)


def test_decodes_any_ids(pair):
    table, library = pair
    r = random.Random(4)
    for _ in range(2000):
        ids = [r.randrange(3, 259) if r.random() < 0.5 else r.randrange(32000) for _ in range(r.randrange(9))]
        assert table.decode(ids) == library.decode(ids)


def test_columns(spark):
    codec = PieceCodec(spark, MODEL)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello there", "z"), (3, "Hello there", "z")], "doc_id int, text string, ids string")
    rows = df.select("*", codec.round_trip(F.col("text")).alias("c"), codec.encode(F.col("text")).alias("e")).collect()
    assert [r["c"]["decoded"] for r in rows] == ["", "", "Hello there", "Hello there"]
    assert [r["e"] for r in rows] == [r["c"]["ids"] for r in rows] and rows[0]["e"] == []
    assert df.where("false").select(codec.encode(F.col("text"))).count() == 0
    assert df.select(codec.decode(codec.encode(F.col("text")))).collect()[2][0] == "Hello there"


def counts_by_hand(text, bounds, offsets, rule):
    n = [0.0] * (len(bounds) - 1)
    for a, b in offsets:
        shared = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(n))]
        touched = [k for k, s in enumerate(shared) if s]
        if rule == "split":
            for k in touched:
                n[k] += shared[k] / sum(shared)
        elif rule == "majority":
            n[max(touched, key=lambda k: (shared[k], -k))] += 1
        else:
            n[touched[0] if rule == "first" else touched[-1]] += 1
    return n


@pytest.mark.parametrize("rule", ["majority", "first", "last", "split"])
def test_attribution_against_offsets_of_another_library(spark, data, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    counter = TokenCounter(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule)
    texts = ["one\n\n\ntwo  \n  three", "\n", "", None, "日本\n🎉🎉\nété", "no newline"] + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in df.select("text", counter.by_section(F.col("text")).alias("s")).collect():
        text = row["text"] or ""
        bounds = [0]
        for part in text.split("\n"):
            bounds.append(bounds[-1] + len(part) + 1)
        bounds[-1] -= 1
        assert [(s["char_start"], s["char_end"]) for s in row["s"]] == list(zip(bounds, bounds[1:]))
        offsets = t.encode(text, add_special_tokens=False).offsets
        assert [s["n_tokens"] for s in row["s"]] == pytest.approx(counts_by_hand(text, bounds, offsets, rule))


def test_fields_add_up(spark):
    counter = TokenCounter(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([("a title", None, "some body text")], "t string, n string, b string")
    s = df.select(counter.by_field("t" and F.col("t"), F.col("n"), F.col("b")).alias("s")).first()["s"]
    assert len(s) == 3 and s[1]["char_end"] - s[1]["char_start"] == 1 and sum(x["n_tokens"] for x in s) > 5


def test_spans_of_split_characters():
    raw = "é".encode()
    assert [x.tolist() for x in token_spans(raw, np.array([1, 1]))] == [[0, 0], [1, 1]]
    assert attribute(np.array([0]), np.array([4]), np.array([0, 2, 4]), "majority")[0].tolist() == [1, 0]


def texts_of(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_piece_query_against_the_library(pair, spark, data):
    texts, library = texts_of(spark, data), pair[1]
    rows = queries.op2_sentencepiece(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def attributed_by_hand(text, encoding):
    """Tokens of each line, token by token and character by character; a crossing token goes to the line with most of it."""
    line_of, line = [], 0
    for c in text:
        line_of.append(line)
        line += c == "\n"
    at, counts, byte_of = 0, [0] * (text.count("\n") + 1), [i for i, c in enumerate(text) for _ in c.encode()]
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        lines = [line_of[i] for i in range(byte_of[at], byte_of[at + size - 1] + 1)]
        counts[max(sorted(set(lines)), key=lines.count)] += 1
        at += size
    return counts


def test_token_query_against_brute_force(spark, data):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts, found = texts_of(spark, data), {}
    for r in queries.op4_token_attribution(spark, data).collect():
        found.setdefault(r["doc_id"], {})[r["section"]] = (r["char_start"], r["char_end"], r["n_tokens"])
    assert set(found) == set(texts)
    for i, text in texts.items():
        own = [found[i][k] for k in range(len(found[i]))]
        assert len(own) == text.count("\n") + 1 and all(text[a:b].find("\n") in (-1, b - a - 1) for a, b, _ in own)
        assert "".join(text[a:b] for a, b, _ in own) == text
        assert [n for *_, n in own] == attributed_by_hand(text, encoding)


def test_token_counts_of_odd_tables(spark):
    counter = TokenCounter(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([(1, "a\nb", 5), (1, "a\nb", 5), (None, None, 6)], "id int, text string, n_tokens int")
    rows = [r["s"] for r in df.withColumn("s", counter.by_section(F.col("text"))).collect()]
    assert rows[0] == rows[1] and len(rows[0]) == 2 and [(s["char_start"], s["char_end"], s["n_tokens"]) for s in rows[2]] == [(0, 0, 0.0)]
    assert df.where("false").select(counter.by_section(F.col("text"))).count() == 0
