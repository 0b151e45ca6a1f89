"""SimHash near-duplicates with vantage-point trees.

Fingerprints of 64 bits, or of several such words, are cut into blocks of 16. Two fingerprints link if they differ in at
most ``bits`` bits, and in at most ``radius`` of some block. With 64 bits and a radius of ``bits // 4`` the second follows
from the first. Wider fingerprints without a radius are compared in tiles: they are dealt to groups by hash, and each pair
of groups is a shard that compares all its pairs, so no pair within ``bits`` is left out. (24 of 128 bits leave three for each
block; balls that wide overlap most leaves of a tree of 16 bits, so trees would prune nothing.)
With a radius each block has a vantage-point tree over the values that the fingerprints have there, weighed by how many have them: a
node's vantage value sends values within the median distance to one side and the others to the other side, until a leaf
has few fingerprints or one value. So depth follows the data. A leaf is a shard. Every fingerprint is filed in one shard a
block, and also asks the later shards that its ball overlaps, found by descending with the triangle bounds. Inside a shard
all pairs are compared exactly over all bits, by a bounded matrix or, when the shard is large, through block values: for
64 bits those of the three other blocks, of which a linked pair differs in at most ``bits // 3`` bits of one, else those
of the shard's block.

The search goes twice, so that a large group gives few links. The first time shards compare only what is filed in them,
and every fingerprint's label is the least one that it reaches in any shard. The second time questions are asked as well, and
a shard returns a spanning forest of labels, none for fingerprints of one label. Components of labels and forests are those
of all links.

Trees are built from a histogram of block values (65,536 counts a block at most, whatever the data), the only thing that
the driver sees of the fingerprints.

Defined results: equal fingerprints are one class, so copies cost one row; null and wordless texts have fingerprint
zero (of several words: that of the empty shingle) and are linked like any other; rows with a null id take part and get the component's least non-null id (null if
there is none); repeated rows and ids each get a row; an empty table gives an empty table. Other columns are not read
and stay out of the result, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.session import saved
from gridloom.llm.common import free_name, small_batches
from gridloom.operators.graph import hot_limit, join_counted, star_components

#: Blocks of a word of 64 bits, and the bits of a block.
BLOCKS, WIDTH = 4, 16
VALUES = 1 << WIDTH
#: Shingles turned into bits at a time.
CHUNK = 1 << 15
#: Comparisons made at a time, and up to which a shard is compared by a matrix.
CELLS = 1 << 22
#: Comparisons of a tile made at a time: their buffers fit a core's cache.
TILE_CELLS = 1 << 16
#: Groups of fingerprints that tiles pair, unless that makes them smaller or larger than leaves may be.
TILE_GROUPS = 8
#: Fingerprints of a leaf: a 256th of all, but no fewer and no more than these.
LEAF = (2_000, 200_000)
#: Dropped rows up to which their keys are broadcast (some 60 bytes each).
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Fingerprint:
    """What is hashed, and into how many words of 64 bits. ``distinct``: a shingle counts once, however often it comes."""

    words_per_shingle: int = 4
    words: int = 1
    distinct: bool = False
    seed: int = 42

    @property
    def kind(self) -> str:
        return _kind(self.words)


#: Texts that share some four fifths of their five-word shingles: all pairs of such fingerprints within this many bits.
SIMILAR = {"how": Fingerprint(words_per_shingle=5, words=2, distinct=True), "bits": 24}


def _kind(words: int) -> str:
    """Type of a fingerprint column."""
    return "bigint" if words == 1 else "binary"


def _prints(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints of a column as rows of unsigned words."""
    if words == 1:
        return column.to_numpy().view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def _column(prints: np.ndarray) -> pa.Array:
    """Inverse of ``_prints``."""
    n, words = prints.shape
    flat = np.ascontiguousarray(prints)
    if words == 1:
        return pa.array(flat[:, 0].view(np.int64), pa.int64())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), n, [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _more_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` hashes from each hash: itself, then others by the SplitMix64 generator."""
    out = [hashes]
    for k in range(1, words):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint_of(raw: bytes, how: Fingerprint = Fingerprint()) -> np.ndarray:
    """SimHash of a UTF-8 text as unsigned words: majority of the bits of its shingles' XXH64."""
    import xxhash

    words = raw.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        if how.words == 1:
            return np.zeros(1, np.uint64)
        words = [b""]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = how.words_per_shingle - 1
    if len(words) > k:
        starts, ends = starts[: len(starts) - k], ends[k:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, seed = xxhash.xxh64_intdigest, how.seed
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), "<u8", len(starts))
    if how.distinct:
        hashes = np.unique(hashes)
    counts = np.zeros(64 * how.words, np.int64)
    for at in range(0, len(hashes), CHUNK):
        several = _more_words(hashes[at : at + CHUNK], how.words)
        counts += np.unpackbits(several.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def simhash(text: Column, how: Fingerprint = Fingerprint()) -> Column:
    """text -> fingerprint: a bigint of its 64 bits or, of several words, their bytes, the least first."""

    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint_of(x or b"", how) for x in texts.cast(pa.binary()).to_pylist()]
        return _column(np.array(found, np.uint64).reshape(-1, how.words))

    return F.arrow_udf(run, how.kind)(text)


class BlockTree:
    """Vantage-point tree over the values of a block and how many fingerprints have each. ``home``: the leaf of a value.
    ``asked``: for each value, the later leaves that hold a value within the radius (the earlier ones ask back).
    ``sizes``: fingerprints of each leaf."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, radius: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        weight = np.zeros(VALUES, np.int64)
        weight[values] = counts
        self.home, sizes = np.zeros(VALUES, np.int32), []
        masks = _masks(radius)
        visits: list[tuple[np.ndarray, int]] = [(np.zeros(0, np.int64), 0)]
        stack = [(values, values)] if len(values) else []  # the node's own values; the values whose ball may reach it
        while stack:
            own, asking = stack.pop()
            size = int(weight[own].sum())
            if size <= leaf or len(own) == 1:
                self.home[own] = len(sizes)
                member = np.zeros(VALUES, bool)
                member[own] = True
                visits.append((asking[member[asking[:, None] ^ masks].any(axis=1)], len(sizes)))
                sizes.append(size)
                continue
            vantage = own[rng.integers(len(own))]
            distance = np.bitwise_count(own ^ vantage)
            spread = np.cumsum(np.bincount(distance, weight[own]))
            cut = int(np.searchsorted(spread, spread[-1] / 2))
            if not (distance > cut).any():
                cut = int(distance.max()) - 1
            ask = np.bitwise_count(asking ^ vantage).astype(np.int64)
            stack.append((own[distance > cut], asking[ask + radius > cut]))
            stack.append((own[distance <= cut], asking[ask - radius <= cut]))
        found = np.concatenate([v for v, _ in visits])
        leaves = np.concatenate([np.full(len(v), n, np.int32) for v, n in visits])
        later = leaves > self.home[found]
        found, leaves = found[later], leaves[later]
        self.asked = leaves[np.argsort(found, kind="stable")]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(found, minlength=VALUES))))
        self.sizes = np.array(sizes, np.int64)

    def asks(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``values`` and leaf of every question."""
        return _ranges(self.start[values], self.start[values + 1], self.asked)


def block_trees(slots: np.ndarray, counts: np.ndarray, blocks: int, radius: int, leaf: int | None = None) -> list[BlockTree]:
    """The trees of a histogram: ``slots`` are block * 65,536 + value."""
    if leaf is None:
        leaf = int(np.clip(counts.sum() // blocks // 256, *LEAF))
    own = [slots >> WIDTH == b for b in range(blocks)]
    return [BlockTree(slots[o] & (VALUES - 1), counts[o], radius, leaf) for o in own]


def _ranges(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of ``of`` in [low, high) for each range: index of the range, element."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, of[np.repeat(low, n) + within]


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints[:, b // BLOCKS] >> np.uint64(WIDTH * (b % BLOCKS))) & np.uint64(VALUES - 1)).astype(np.int64)


@lru_cache(maxsize=4)
def _masks(radius: int) -> np.ndarray:
    values = np.arange(VALUES, dtype=np.int64)
    return values[np.bitwise_count(values) <= radius]


class Shard:
    """The fingerprints filed in a shard of a block, and the forest of their labels. ``labels``: fingerprints already known to
    be connected have the same (by default each is its own). Without a block it is a tile: near over all words is enough."""

    def __init__(self, filed: np.ndarray, bits: int, block: int | None, radius: int | None = None, labels: np.ndarray | None = None):
        self.filed, self.bits, self.block = filed, bits, block
        if labels is None:
            self.labels, self.group = filed, np.arange(len(filed))
        else:
            self.labels, self.group = np.unique(labels, axis=0, return_inverse=True)
        self.parent = list(range(len(self.labels)))
        self.made: list[tuple[int, int]] = []
        self.index: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.radius = bits // BLOCKS if radius is None else radius
        narrow = filed.shape[1] == 1
        self.reach = bits // (BLOCKS - 1) if narrow else self.radius
        if len(filed) > 4096 and block is not None:
            for b in range(BLOCKS) if narrow else [block]:
                if b != block or not narrow:
                    v = _block(filed, b)
                    self.index.append((b, np.argsort(v, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(v, minlength=VALUES))))))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def linked(self, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of ``asking`` with filed fingerprints, in bounded pieces: index of each."""
        if self.block is None:
            yield from self._tile(asking)
            return
        if not self.index:
            step = max(1, CELLS // max(1, len(self.filed)))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                q, h = np.nonzero(np.bitwise_count(some[:, None, 0] ^ self.filed[None, :, 0]) <= self.bits)
                yield self._near(asking, q + at, h)
            return
        for b, order, start in self.index:
            values = _block(asking, b)
            for mask in _masks(self.reach):
                low, high = start[values ^ mask], start[(values ^ mask) + 1]
                at, total = 0, np.cumsum(high - low)
                while at < len(asking):
                    to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS)))
                    q, h = _ranges(low[at:to], high[at:to], order)
                    q += at
                    yield self._near(asking, q, h)
                    at = to

    def _tile(self, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of all pairs; those of the filed with themselves once each. A pair within ``bits`` has its share or less of
        them in some word, which hardly any other pair has, so whole words are compared only then."""
        words = self.filed.shape[1]
        mine, theirs = np.ascontiguousarray(self.filed.T), np.ascontiguousarray(asking.T)
        step = max(1, TILE_CELLS // max(1, len(self.filed)))
        found, pairs = [], 0
        for at in range(0, len(asking), step):
            first = at if asking is self.filed else 0
            near = np.zeros((len(asking[at : at + step]), len(self.filed) - first), bool)
            for a, b in zip(theirs, mine):
                near |= np.bitwise_count(a[at : at + step, None] ^ b[None, first:]) <= self.bits // words
            hit = np.flatnonzero(near)
            if len(hit):
                q, h = hit // near.shape[1] + at, hit % near.shape[1] + first
                whole = np.bitwise_count(asking[q] ^ self.filed[h]).sum(axis=1, dtype=np.int64) <= self.bits
                found.append((q[whole], h[whole]))
                pairs += len(hit)
            if pairs > CELLS // 4:
                yield tuple(map(np.concatenate, zip(*found)))
                found, pairs = [], 0
        if found:
            yield tuple(map(np.concatenate, zip(*found)))

    def _near(self, asking: np.ndarray, q: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that are near over all words, and in the shard's block."""
        near = np.bitwise_count(asking[q] ^ self.filed[h]).sum(axis=1, dtype=np.int64) <= self.bits
        q, h = q[near], h[near]
        near = np.bitwise_count(_block(asking[q], self.block) ^ _block(self.filed[h], self.block)) <= self.radius
        return q[near], h[near]

    def roots(self, labels: np.ndarray) -> np.ndarray:
        """Roots of label numbers."""
        some, at = np.unique(labels, return_inverse=True)
        return np.fromiter(map(self.root, some.tolist()), np.int64, len(some))[at]

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.made.append((a, b))

    def join_filed(self) -> None:
        for q, h in self.linked(self.filed):
            a, b = self.group[q], self.group[h]
            a, b = a[a < b], b[a < b]
            roots = np.stack([self.roots(a), self.roots(b)])
            for i, j in np.unique(roots[:, roots[0] != roots[1]], axis=1).T.tolist():
                self.join(i, j)

    def links(self, asking: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One link from each label asking to each tree that it touches: the two ends of all links. Labels that are filed
        here too join the trees instead."""
        names, own = np.unique(labels, axis=0, return_inverse=True)
        out = [np.zeros((2, 0), np.int64)]
        for q, h in self.linked(asking):
            out.append(np.unique(np.stack([own[q], self.roots(self.group[h])]), axis=1))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        filed = {x.tobytes(): i for i, x in enumerate(self.labels)} if pairs.size else {}
        here = np.array([filed.get(names[o].tobytes(), -1) for o in pairs[0].tolist()], np.int64)
        for i, j in zip(here[here >= 0].tolist(), pairs[1, here >= 0].tolist()):
            self.join(i, j)
        o, r = np.unique(np.stack([pairs[0, here < 0], self.roots(pairs[1, here < 0])]), axis=1)
        return names[o], self.labels[r]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """The links that made the trees."""
        made = np.array(self.made, np.int64).reshape(-1, 2)
        return self.labels[made[:, 0]], self.labels[made[:, 1]]

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """Labels that are not the first of their tree, and that first one."""
        roots = self.roots(np.arange(len(self.labels)))
        other = roots != np.arange(len(roots))
        return self.labels[other], self.labels[roots[other]]


def _filing(prints: np.ndarray, trees: list[BlockTree], splits: dict[int, int], asking: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shard, role (0 filed, 1 ``asking``) and number in ``prints`` of every row to send. A shard over the size limit (of one
    value) is cut into parts: a fingerprint is filed in one part by its hash and asks the later parts; a question goes to
    all."""
    first = 0
    for b, t in enumerate(trees):
        values = _block(prints, b)
        rows = [(t.home[values].astype(np.int64), 0, np.arange(len(prints)))]
        if asking:
            q, leaf = t.asks(values)
            rows.append((leaf.astype(np.int64), 1, q))
        for leaf, role, at in rows:
            shard = leaf + first
            cut = np.isin(shard, list(splits)) if splits else np.zeros(len(shard), bool)
            yield shard[~cut] << 20, np.full((~cut).sum(), role, np.int8), at[~cut]
            for s in np.unique(shard[cut]).tolist():
                parts, own = splits[s], at[shard == s]
                home = ((prints[own, -1] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)
                for k in range(parts):
                    if role == 0:
                        yield np.full((home == k).sum(), (s << 20) + k), np.zeros((home == k).sum(), np.int8), own[home == k]
                    if asking:
                        asks = own[home < k] if role == 0 else own
                        yield np.full(len(asks), (s << 20) + k), np.ones(len(asks), np.int8), asks
        first += len(t.sizes)


def _tiling(prints: np.ndarray, parts: int, asking: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_filing``, of tiles: a fingerprint belongs to one of ``parts`` groups by its hash and is filed in its group's own
    tile or, ``asking``, filed in the tiles with later groups, where it meets those that ask from them."""
    home = (((prints[:, -1] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    if not asking:
        yield home * parts + home, np.zeros(len(home), np.int8), np.arange(len(home))
        return
    for other in range(parts):
        at = np.nonzero(home != other)[0]
        low, high = np.minimum(home[at], other), np.maximum(home[at], other)
        yield low * parts + high, (home[at] == high).astype(np.int8), at


def _tree_filing(prints: DataFrame, blocks: int, radius: int, leaf: int | None, shard_limit: int, words: int):
    """``_filing`` by the trees of the fingerprints, and where each block's shards end."""

    def count(batches):
        total = np.zeros(blocks * VALUES, np.int64)
        for batch in batches:
            p = _prints(batch.column(0), words)
            for b in range(blocks):
                total[b * VALUES : (b + 1) * VALUES] += np.bincount(_block(p, b), minlength=VALUES)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    # as many rows at most as the blocks have values, whatever the data
    histogram = prints.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).orderBy("slot").toArrow()
    trees = block_trees(histogram["slot"].to_numpy(), histogram["n"].to_numpy(), blocks, radius, leaf)
    sizes = np.concatenate([t.sizes for t in trees])
    splits = {int(s): -(-int(sizes[s]) // shard_limit) for s in np.nonzero(sizes > shard_limit)[0]}
    shared = prints.sparkSession.sparkContext.broadcast((trees, splits))  # some megabytes at most, see above
    return (lambda some, asking: _filing(some, *shared.value, asking)), np.cumsum([len(t.sizes) for t in trees])


def fingerprint_links(
    prints: DataFrame, bits: int = 4, shard_limit: int = 200_000, leaf: int | None = None, words: int = 1, radius: int | None = None
) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``words`` words in column ``fp`` that differ in 1 to ``bits`` bits,
    and, with a ``radius``, in so many bits at most of some block, or between ones that are connected through others: few, but
    with the components of all links. ``shard_limit``: fingerprints filed in one task; larger shards are cut into parts.
    ``leaf``: fingerprints up to which a tree's node is a leaf, by default as ``LEAF`` says."""

    blocks, kind = BLOCKS * words, _kind(words)
    tiled = words > 1 and radius is None
    radius = bits // blocks if radius is None else radius
    prints = prints.select("fp")
    if tiled:
        n = prints.count()
        parts = max(1, -(-n // max(1, min(max(n // TILE_GROUPS, LEAF[0]), shard_limit))))
        # tiles cost time, not bytes, so they are dealt by number
        tasks = min(max(parts * (parts + 1) // 2, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 20_000)
        filing, ends = (lambda some, asking: _tiling(some, parts, asking)), None
    else:
        filing, ends = _tree_filing(prints, blocks, radius, leaf, shard_limit, words)

    def file(asking):
        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    some = batch.slice(at, 4096)
                    for shard, role, own in filing(_prints(some.column(0), words), asking):
                        taken = [some.column(c).take(pa.array(own)) for c in (0, 1)]
                        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(role), *taken], ["shard", "role", "fp", "label"])

        return run

    def search(asking):
        def whole(filed, shard):
            prints, labels = (np.concatenate(x) for x in zip(*filed))
            block = None if tiled else int(np.searchsorted(ends, shard >> 20, "right"))
            made = Shard(prints, bits, block, radius, labels if asking else None)
            if not (tiled and asking):  # what a group's own tile found are labels by then
                made.join_filed()
            return made

        def done(shard, filed, now):
            if shard is None and filed:
                shard = whole(filed, now)
            if shard is not None:
                yield from told(shard.forest() if asking else shard.least())

        def run(batches):
            filed: list[tuple[np.ndarray, np.ndarray]] = []
            shard, now = None, -1
            for batch in batches:
                s, role, p = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _prints(batch.column(2), words)
                labels = _prints(pc.coalesce(batch.column(3), batch.column(2)), words)
                cuts = np.nonzero((np.diff(s) != 0) | (np.diff(role) != 0))[0] + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)]):
                    if a == b:
                        continue
                    if s[a] != now:
                        yield from done(shard, filed, now)
                        filed, shard, now = [], None, s[a]
                    if role[a] == 0:
                        filed.append((p[a:b], labels[a:b]))
                    elif filed or shard:
                        if shard is None:
                            shard, filed = whole(filed, now), []
                        yield from told(shard.links(p[a:b], labels[a:b]))
            yield from done(shard, filed, now)

        return run

    def told(links):
        if len(links[0]):
            yield pa.RecordBatch.from_arrays([_column(x) for x in links], ["a", "b"])

    def searched(labelled: DataFrame, asking: bool) -> DataFrame:
        filed = labelled.mapInArrow(file(asking), f"shard bigint, role tinyint, fp {kind}, label {kind}")
        dealt = filed.repartition(tasks, F.col("shard")) if tiled else filed.repartition(F.col("shard"))
        return dealt.sortWithinPartitions("shard", "role", "fp").mapInArrow(search(asking), f"a {kind}, b {kind}")

    alone = prints.withColumn("label", F.lit(None).cast(kind))
    labels = saved(searched(alone, False).groupBy("a").agg(F.min("b").alias("b")), "simhash-labels")
    labelled = prints.join(labels, F.col("fp") == F.col("a"), "left").select("fp", F.col("b").alias("label"))
    return searched(labelled, True).unionByName(labels)


def fingerprint_components(prints: DataFrame, bits: int = 4, words: int = 1, radius: int | None = None) -> DataFrame:
    """(fp, n, root, component_id), stored, for a stored table (doc_id, fp): n rows have the fingerprint; component_id is
    the least doc_id reachable by links (null if all are null, and shared by components that have rows of one id); root, the
    least fingerprint, tells components apart."""
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    nodes = star_components(fingerprint_links(classes, bits, words=words, radius=radius))
    members = nodes.join(classes.select("fp", "first_id"), nodes["node"] == classes["fp"]).select("fp", "first_id", "component")
    least = members.groupBy("component").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    linked = join_counted(members, least, "component", hot_limit(nodes.count())).select("fp", "component", "least_id")
    return saved(classes.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("component", "fp").alias("root"), F.coalesce("least_id", "first_id").alias("component_id")
    ), "simhash-components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Fingerprint = Fingerprint(), bits: int = 4, radius: int | None = None
) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = saved(small_batches(docs).select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col), how).alias("fp")), "simhash-prints")
    return join_counted(prints, fingerprint_components(prints, bits, how.words, radius), "fp", hot_limit(prints.count())).select("doc_id", "fp", "component_id")


def keep_one_of_each(
    docs: DataFrame, how: Fingerprint = Fingerprint(), bits: int = 4, radius: int | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row of each component, of its least doc_id (null if the component has no other). Components that share an id,
    or have none, each keep their row.

    Decided on (doc_id, hash of the text) alone; texts stay where they are unless more rows go than may be broadcast."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = saved(small_batches(docs).select("doc_id", key.alias("h"), simhash(F.col("text"), how).alias("fp")), "simhash-prints")
    found = join_counted(prints, fingerprint_components(prints.select("doc_id", "fp"), bits, how.words, radius), "fp", hot_limit(prints.count()))
    pairs = found.groupBy("doc_id", "h", "root", "component_id").agg(F.count(F.lit(1)).alias("times"))
    pairs = saved(pairs, "simhash-pairs")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keepers = pairs.where(least).groupBy("root").agg(F.min("h").alias("keeper"))
    # only rows of the least id can stay, so a large component doesn't gather at its root
    first = pairs.where(least).join(keepers, "root").select("doc_id", "h", "times", (F.col("h") == F.col("keeper")).alias("stays"))
    judged = saved(first.unionByName(pairs.where(~least).select("doc_id", "h", "times", F.lit(False).alias("stays"))), "simhash-judged")
    stays = F.col("stays")
    own, number = free_name(docs, "h"), free_name(docs, "n")
    hashed = docs.withColumn(own, key)

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        small = keys.limit(broadcast_rows + 1).count() <= broadcast_rows
        k = keys.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
        return rows.join(F.broadcast(k) if small else k, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(own) == F.col("__h")), how)

    # a row that comes once is let through; of those that come several times, one is picked
    repeated = judged.where(stays & (F.col("times") > 1)).select("doc_id", "h")
    kept = matched(hashed, judged.where(~(stays & (F.col("times") == 1))).select("doc_id", "h"), "left_anti")
    if repeated.limit(1).count():
        row = F.struct(*hashed.columns)
        some = matched(hashed, repeated, "left_semi").groupBy(F.col("doc_id").alias("__id"), F.col(own).alias("__h")).agg(F.min_by(row, F.xxhash64(row)).alias(number)).select(f"{number}.*")
        kept = kept.unionByName(some)
    return kept.select(*docs.columns)
