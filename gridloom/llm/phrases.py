"""Phrase collocation mining over depth-truncated suffix trees, built apart for groups of word prefixes.

Every word begins a suffix of at most three words of its piece. The suffixes' trees are partitioned vertically, by how they
begin, after one count of all words:

* A word with at most ``budget`` occurrences is a prefix. One with more is replaced by the word pairs that begin with it,
  counted in a second pass, and a pair with more than the budget by the word triples.
* Texts are read once more. A task sends what follows each prefix in one row for each of its blocks of text; rows are dealt
  and sorted by prefix.
* A task takes whole prefixes until they fill the budget, sorts their suffixes, and reads counts from leaf totals: a leaf
  is a distinct suffix, an inner node the sum of a run of leaves. So memory follows the budget and not the data.

The budget is at least the words' number divided by ``MOST_HEAVY``: there can't be more heavy prefixes than that, which
bounds what is broadcast. Nodes under ``least`` are not kept: no candidate needs them, as a part of a phrase occurs no less
often than the phrase.

Scores are exact decimals. A candidate's left parts are its ancestors in the tree; right parts come from two joins.

Defined results: null texts have no words; a null language is ``und``; repeated rows count each time; an empty table gives
an empty one. Phrases never span pieces or documents. Only text and language are read, so other columns cannot clash. A
text is worked on whole: a task needs some 60 bytes of memory for each of its longest text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.session import saved
from gridloom.llm.common import small_batches
from gridloom.llm.words import gathered

#: Suffixes of a group of prefixes.
BUDGET = 1 << 17
MOST_HEAVY = 100_000
#: Bytes of text that a task joins before it sends what it found.
BLOCK_BYTES = 4 << 20
SHARDS = 64
BLANK, STOP = np.isin(np.arange(256), list(b" \t")), np.isin(np.arange(256), list(b".,;:!?\n\v\f\r"))
LOWER = bytes(range(256)).lower()


@dataclass
class Words:
    """The words of a block of texts in order: their language and own number, the length of the suffix that begins with each
    (1 to 3 words), and what the numbers stand for."""

    lang: np.ndarray
    ids: np.ndarray
    length: np.ndarray
    langs: pa.Array
    names: pa.Array


def block_words(langs: pa.Array, texts: pa.Array) -> Words:
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(raw) else np.zeros(0, np.uint8)
    data, ends = np.frombuffer(data.tobytes().translate(LOWER), np.uint8), ends - ends[0]
    inside = ~(BLANK | STOP)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]  # a text begins a word, whatever the one before ends with
    starts = np.nonzero(begins)[0]
    row = np.searchsorted(ends, starts, "right") - 1
    # words without what lies between them are one buffer; places in it are counts of bytes inside words
    places = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    bounds = np.append(places[starts], places[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside].tobytes())).dictionary_encode()
    piece = np.cumsum(STOP[data], dtype=np.int32)[starts]
    two = np.zeros(len(starts), bool)
    two[:-1] = (row[:-1] == row[1:]) & (piece[:-1] == piece[1:])
    three = two.copy()
    three[:-1] &= two[1:]
    coded = langs.dictionary_encode()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    return Words(lang, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), 1 + two + (two & three), coded.dictionary, words.dictionary.cast(pa.string()))


def _distinct(parts: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations of numbers below ``sizes``, in order, and how often each occurs."""
    if np.prod([float(s) for s in sizes]) < 2.0**62:
        key = parts[0]
        for p, size in zip(parts[1:], sizes[1:]):
            key = key * size + p
        found, n = np.unique(key, return_counts=True)
        out = []
        for size in sizes[:0:-1]:
            out.append(found % size)
            found = found // size
        return [found, *out[::-1]], n
    found, n = np.unique(np.stack(parts), axis=1, return_counts=True)
    return list(found), n


def _counted(df: DataFrame, heavy: list[tuple[str, str]] | None) -> DataFrame:
    """(lang, w1, n) or, for heavy words, (lang, w1, w2, n): counts over ``df`` (lang, text)."""
    shared = df.sparkSession.sparkContext.broadcast(heavy)  # MOST_HEAVY at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BLOCK_BYTES):
            w = block_words(batch.column(0), batch.column(1))
            parts, sizes = [w.lang, w.ids], [len(w.langs), max(len(w.names), 1)]
            if shared.value is not None:
                at = np.nonzero((w.length > 1) & _marked(w, shared.value)[w.lang, w.ids])[0]
                parts, sizes = [w.lang[at], w.ids[at], w.ids[np.minimum(at + 1, len(w.ids) - 1)]], [*sizes, sizes[1]]
            (lang, *found), n = _distinct(parts, sizes)
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(lang)), *(w.names.take(pa.array(f)) for f in found), pa.array(n)], [*keys, "n"])

    keys = ["lang", "w1"] if heavy is None else ["lang", "w1", "w2"]
    schema = ", ".join(f"{k} string" for k in keys) + ", n bigint"
    return df.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def _marked(w: Words, heavy) -> np.ndarray:
    """[language, word] -> whether it is heavy."""
    marks = np.zeros((max(len(w.langs), 1), max(len(w.names), 1)), bool)
    langs = {g: k for k, g in enumerate(w.langs.to_pylist())}
    words = pc.index_in(pa.array([h[1] for h in heavy], pa.string()), w.names).to_pylist() if heavy else []
    for (g, _), k in zip(heavy, words):
        if g in langs and k is not None:
            marks[langs[g], k] = True
    return marks


def _prefix_rows(df: DataFrame, words: list[tuple[str, str]], pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(lang, depth, prefix, rests, counts): what follows each prefix in a block of text, with how often."""
    shared = df.sparkSession.sparkContext.broadcast((words, pairs))  # MOST_HEAVY each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, heavy_pairs = shared.value
        for batch in gathered(batches, BLOCK_BYTES):
            w = block_words(batch.column(0), batch.column(1))
            if not len(w.ids):
                continue
            after = np.concatenate([w.ids + 1, [0, 0]])  # 0: the suffix has ended
            size = len(w.names) + 1
            (lang, w1, w2, w3), n = _distinct([w.lang, w.ids, np.where(w.length > 1, after[1:-1], 0), np.where(w.length > 2, after[2:], 0)], [len(w.langs), size, size, size])
            depth = np.where(_marked(w, heavy)[lang, w1] & (w2 > 0), 2, 1)
            if heavy_pairs:
                known = {t: k for k, t in enumerate(w.names.to_pylist())}
                codes = {(g, known[a], known[b] + 1) for g, a, b in heavy_pairs if a in known and b in known}
                names = w.langs.to_pylist()
                for k in np.nonzero((depth == 2) & (w3 > 0))[0] if codes else ():
                    if (names[lang[k]], w1[k], w2[k]) in codes:
                        depth[k] = 3
            word = lambda c, where: pc.fill_null(w.names.take(pa.array(c - 1, mask=(c == 0) | ~where)), "")
            join = lambda *parts: pc.ascii_trim(pc.binary_join_element_wise(*parts, " "), " ")
            prefix = join(word(w1 + 1, depth > 0), word(w2, depth > 1), word(w3, depth > 2))
            rest = join(word(w2, depth < 2), word(w3, depth < 3))
            # combinations are in order, so those of a prefix lie together, but for words that are heavy and end a piece
            new = np.ones(len(n), bool)
            new[1:] = (lang[1:] != lang[:-1]) | (w1[1:] != w1[:-1]) | (depth[1:] != depth[:-1]) | ((depth[1:] > 1) & (w2[1:] != w2[:-1])) | ((depth[1:] > 2) & (w3[1:] != w3[:-1]))
            first = np.nonzero(new)[0]
            ends = pa.array([*first, len(n)], pa.int32())
            columns = [w.langs.take(pa.array(lang[first])), pa.array(depth[first], pa.int8()), prefix.take(pa.array(first)), pc.binary_join(pa.ListArray.from_arrays(ends, rest), "\n"), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "depth", "prefix", "rests", "counts"])

    return df.mapInArrow(run, "lang string, depth tinyint, prefix string, rests string, counts array<int>")


NODES = "lang string, w1 string, w2 string, w3 string, a bigint, l1 bigint, l2 bigint"
NODE_SCHEMA = pa.schema([(c, pa.int64() if c in ("a", "l1", "l2") else pa.string()) for c in ("lang", "w1", "w2", "w3", "a", "l1", "l2")])


def _subtrees(batches: list[pa.RecordBatch], least: int, heavy: dict, heavy_pairs: dict) -> pa.RecordBatch:
    """Nodes of two and three words, with the counts of their first word and first two words, of whole prefixes."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    one = lambda c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c]
    lang, prefix, depth = one("lang"), one("prefix"), one("depth").to_numpy()
    lists, counts = pc.split_pattern(one("rests"), "\n"), one("counts")
    n, row = pc.list_flatten(counts).to_numpy().astype(np.int64), pc.list_parent_indices(counts).to_numpy()
    # rows are sorted, so a prefix is a run of them
    tell = pc.binary_join_element_wise(lang, prefix, "\n").dictionary_encode().indices.to_numpy().astype(np.int64) * 4 + depth
    head = np.concatenate([[0], np.cumsum(tell[1:] != tell[:-1])])[row]
    total_of = np.bincount(head, n).astype(np.int64)
    keep = total_of[head] >= least
    rest = pc.list_flatten(lists).filter(pa.array(keep)).dictionary_encode()
    row, head, n, rests = row[keep], head[keep], n[keep], rest.dictionary
    if not len(n):
        return pa.RecordBatch.from_pylist([], schema=NODE_SCHEMA)
    # suffixes numbered in order of their first word, so that one sort of numbers puts the leaves of a node together
    next_word = pc.replace_substring_regex(rests, " .*", "").dictionary_encode()
    first = next_word.indices.to_numpy().astype(np.int64)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = head * len(order) + rank[rest.indices.to_numpy()]
    sort = np.argsort(key, kind="stable")
    begins = np.concatenate([[True], np.diff(key[sort]) != 0])
    leaf = sort[begins]
    total = np.add.reduceat(n[sort], np.nonzero(begins)[0])
    suffix = order[key[leaf] % len(order)]
    root, child = head[leaf], first[suffix]
    new_root = np.concatenate([[True], np.diff(root) != 0])
    new_child = new_root | np.concatenate([[True], np.diff(child) != 0])
    child_total = np.add.reduceat(total, np.nonzero(new_child)[0])[np.cumsum(new_child) - 1]
    length = np.where(pc.equal(rests, "").to_numpy(zero_copy_only=False), 0, 1 + pc.count_substring(rests, " ").to_numpy())[suffix]
    deep = depth[row[leaf]].astype(int)
    # a node is told at the first of its leaves: a prefix of two words or more, its children, and leaves two words below one word
    picks = [(0, new_root & (deep > 1)), (1, new_child & (length > 0) & (child_total >= least)), (2, (length > 1) & (total >= least))]
    found: list[tuple] = []
    names, words = rests, next_word.dictionary
    for below, mask in picks:
        for k in np.nonzero(mask)[0].tolist():
            g, own = lang[int(row[leaf[k]])].as_py(), prefix[int(row[leaf[k]])].as_py().split(" ")
            more = [] if below == 0 else [words[int(child[k])].as_py()] if below == 1 else names[int(suffix[k])].as_py().split(" ")
            at = [int(total_of[root[k]]), int(child_total[k]), int(total[k])]
            if below == 0 and (len(own) == 2 and (g, *own) in heavy_pairs):
                continue  # counted whole in the second pass
            phrase = own + more
            one_word = at[0] if len(own) == 1 else heavy[g, own[0]]
            if len(phrase) == 2:
                two_words = at[below]
            else:
                two_words = heavy_pairs[g, phrase[0], phrase[1]] if len(own) == 3 else at[2 - len(own)]
                if len(own) == 1:
                    two_words = at[1]
            found.append((g, *phrase, *[None] * (3 - len(phrase)), at[below], one_word, two_words))
    columns = list(zip(*found)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_SCHEMA)], schema=NODE_SCHEMA)


def phrase_nodes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, w1, n with n >= least), (nodes: ``NODES``), (totals: lang, n)."""
    df = small_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    every = saved(_counted(df, None), "phrase-words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    most = max(budget, sum(r["n"] for r in totals.collect()) // MOST_HEAVY)  # a row a language
    heavy = {(r["lang"], r["w1"]): r["n"] for r in every.where(F.col("n") > most).collect()}  # MOST_HEAVY at most
    pairs = {}
    if heavy:
        known = _counted(df, list(heavy)).where(F.col("n") > most)
        pairs = {(r["lang"], r["w1"], r["w2"]): r["n"] for r in known.collect()}  # MOST_HEAVY at most
    shared = df.sparkSession.sparkContext.broadcast((heavy, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            lang, depth, prefix = batch.column("lang"), batch.column("depth"), batch.column("prefix")
            new = np.ones(batch.num_rows, bool)
            same = lambda a: pc.equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~(same(lang) & same(depth) & same(prefix))
            if batch.num_rows:
                new[0] = (lang[0].as_py(), depth[0].as_py(), prefix[0].as_py()) != last
                last = (lang[-1].as_py(), depth[-1].as_py(), prefix[-1].as_py())
            filled = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("counts")).to_numpy())])
            begin = 0
            for k in np.nonzero(new)[0].tolist():
                if size + filled[k] - filled[begin] >= most:
                    yield _subtrees([*held, batch.slice(begin, k - begin)], least, *shared.value)
                    held, size, begin = [], 0, k
            held.append(batch.slice(begin))
            size += filled[-1] - filled[begin]
        if sum(b.num_rows for b in held):
            yield _subtrees(held, least, *shared.value)

    rows = _prefix_rows(df, list(heavy), list(pairs)).repartition("lang", "prefix").sortWithinPartitions("lang", "depth", "prefix")
    nodes = rows.mapInArrow(run, NODES)
    # a pair too heavy to be a prefix has its count from the second pass
    whole = [(g, a, b, None, n, heavy[g, a], n) for (g, a, b), n in pairs.items() if n >= least]
    if whole:
        nodes = nodes.unionByName(df.sparkSession.createDataFrame(whole, NODES))
    return every.where(F.col("n") >= least), saved(nodes, "phrase-nodes"), totals


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(10^6 a a / (left right)) in decimals of 38 digits, for counts below 10^15."""
    d = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"cast(cast(1000000 as decimal(7, 0)) * ({d(a)} * {d(a)}) div ({d(left)} * {d(right)}) as bigint)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside_percent: int = 50, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two and three words of each language."""
    words, nodes, totals = phrase_nodes(docs, text_col, lang_col, least, budget)
    single = words.select("lang", F.col("w1").alias("w2"), F.col("n").alias("r"))
    pairs = saved(nodes.where("w3 is null").drop("w3", "l2").join(single, ["lang", "w2"]), "phrase-pairs")
    tails = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    triples = nodes.where("w3 is not null").join(tails, ["lang", "w2", "w3"])
    triples = saved(triples.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2")), "phrase-triples")
    holds = lambda part: F.col("a") * 100 >= F.col(part) * inside_percent
    inside = triples.where(holds("l2")).select("lang", "w1", "w2").union(triples.where(holds("r1")).select("lang", "w2", "w3")).distinct()
    later = F.col("s2") < F.col("s1")
    found = pairs.join(inside, ["lang", "w1", "w2"], "left_anti").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("l1").alias("l"), "r", _score("a", "l1", "r").alias("score")
    ).unionByName(triples.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"),
    ))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first the best of each of a fixed number of shards, so that a language's last sort has a bounded number of rows
    shard = found.withColumn("_shard", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)))
    some = shard.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_shard").orderBy(*best))).where(F.col("_n") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
