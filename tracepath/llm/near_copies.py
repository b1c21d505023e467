"""Near copies: SimHash search, further fingerprints for what SimHash can't reach, then exact verification.

A text is the set of the 64-bit hashes of its shingles of ``WORDS`` words; two texts are linked if the Jaccard
similarity of their sets is ``LEAST`` or more. Candidates are found in two ways, and verified alike. The first is that of
op3 (``simhash_dedup``): a 64-bit SimHash of the shingles, an index on choices of byte positions, the tally of shared ones, and at most
``BITS`` differing bits. Pairs of similarity 0.8 differ in about 10 bits, which no such index reaches, so there are ``BANDS`` further
fingerprints, each a hash of ``ROWS`` minima of the set under random orders: a pair of similarity s agrees in one with probability
s ** ROWS, and a pair of 0.8 has none of the 40 in common once in 8 million cases. Texts that either way joins, be it through
others, are a candidate group; within a group texts are compared with each other by their whole sets until what is linked
is connected.

The members of a group of more than ``block`` bytes stream past a pivot first, as often as that leaves fewer to be compared;
what isn't similar to a pivot is compared with all members, by blocks of a hash, each pair of blocks by a task of its own.
What is similar to one pivot is compared with that which is similar to another, unless links join them already: Jaccard distance is a
metric, so only members whose similarity to the other pivot is 2 * ``LEAST`` - 1 or more can be similar to what is similar to it.
Nothing is dropped, and no task holds more than two blocks.

Defined results: a null text is an empty text; texts without words are copies of each other; a text of fewer than
``WORDS`` words is one shingle; null ids come after all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracepath.llm.common import cut, let_go, release, spread_join
from tracepath.llm.components import connected_components
from tracepath.llm.simhash_dedup import links, majority, shingle_hashes

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 40, 5
BLOCK = 4 << 20  # bytes of text

_ORDERS = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint64).astype(np.uint32) | np.array([[1], [0]], np.uint32)


def content_key(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def shingles(text: str | None, words_in_shingle: int = WORDS) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(shingle_hashes(text, words_in_shingle))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The fingerprints, as signed longs."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(least) if len(low) else 0, 50):
        least[i : i + 50] = (low[None, :] * _ORDERS[0, i : i + 50, None] + _ORDERS[1, i : i + 50, None]).min(axis=1)
    rows = least.tobytes()
    return [xxhash.xxh64_intdigest(rows[4 * ROWS * i : 4 * ROWS * (i + 1)], i) - (1 << 63) for i in range(BANDS)]


def jaccard_links(sets: list[np.ndarray], linked: list[int | None] | None = None, asks: list[bool] | None = None, least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets, by their places. Those of one number in ``linked`` are linked already; each that
    ``asks`` (without it: all) is compared with all others, whatever their numbers, that it isn't linked to yet."""
    n = len(sets)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.empty(0, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    marked = np.zeros(int(inverse.max(initial=-1)) + 1, bool)
    group, first = np.arange(n), {}
    for i in range(n):
        if linked is not None and linked[i] is not None:
            group[i] = first.setdefault(linked[i], i)
    out, compared = [], np.zeros(n, bool)
    for x in range(n) if asks is None else np.flatnonzero(asks):
        if (group == group[x]).all():
            break
        left = np.flatnonzero((group != group[x]) & ~compared)
        compared[x] = True
        own = inverse[ends[x] - sizes[x] : ends[x]]
        marked[own] = True
        so_far = np.concatenate([[0], np.cumsum(marked[inverse])])
        marked[own] = False
        both = so_far[ends[left]] - so_far[ends[left] - sizes[left]]
        either = sizes[x] + sizes[left] - both
        near = left[(both / np.maximum(either, 1) >= least) | (either == 0)]
        for g, at in zip(*np.unique(group[near], return_index=True)):
            out.append((int(x), int(near[at])))
            group[group == g] = group[x]
    return out


def _classes(docs: DataFrame) -> DataFrame:
    """node, sha256, least (id), size, fp (SimHash, signed) and keys of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps, keys = np.empty(len(batch), np.uint64), np.empty((len(batch), BANDS), np.int64)
            for i, t in enumerate(batch.column(2)):
                h = shingle_hashes(t.as_py(), WORDS)
                fps[i], keys[i] = majority(h), band_keys(np.unique(h))
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
            size = pc.fill_null(pc.utf8_length(batch.column(2)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array(fps.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["sha256", "doc_id", "size", "fp", "keys"])

    rows = docs.select(content_key().alias("sha256"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "sha256 string, doc_id long, size long, fp long, keys array<long>").groupBy("sha256")
    found = found.agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("size", "fp", "keys")])
    return cut(found.withColumn("node", F.monotonically_increasing_id()))  # fixed by the checkpoint


def _candidates(classes: DataFrame) -> DataFrame:
    """node, component for the texts that SimHash links to others or that share further fingerprints with them."""
    near = cut(connected_components(links(cut(classes.select("fp").distinct()))).select(F.col("node").alias("fp"), "component"))
    let_go(classes.sparkSession)
    # a fingerprint stands for all that links lead to from it
    simhash = classes.select("node", "fp").join(near, "fp", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key"))
    keys = classes.select("node", F.explode("keys").alias("key")).union(simhash)
    firsts = cut(keys.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("count")).where("count > 1"))
    shared = spread_join(keys, firsts.select("key", "first"), "key", firsts.select("key", "count"))
    return connected_components(shared.where("first <> node").distinct(), "first", "node")


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """a, b: links that connect what is similar among the rows (also node, linked, asks, text) that have the keys in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last, group = None, {}

        def close() -> pa.RecordBatch:
            nodes, (linked, asks, sets) = list(group), zip(*group.values())
            return _pairs([(nodes[x], nodes[y]) for x, y in jaccard_links(list(sets), list(linked), list(asks))])

        for batch in batches:
            for *key, node, linked, asks, text in _rows(batch):
                if key != last:
                    if len(group) > 1:
                        yield close()
                    last, group = key, {}
                if node not in group:
                    group[node] = (linked, asks, shingles(text))
        if len(group) > 1:
            yield close()

    return rows.select(*keys, "node", "linked", "asks", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The batch's rows, whose last column is text: one text at a time is taken out of it."""
    return zip(*(c.to_pylist() for c in batch.columns[:-1]), (t.as_py() for t in batch.columns[-1]))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ((), ()))], ["a", "b"])


def _star(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """component, a, b, near: for each member (component, node, text, g) that is similar to its component's pivot, that link, and those
    (not near) that may be similar to what is. The pivot is sent to each of g parts of the members, which stream past it."""
    rows = members.select("component", F.pmod(F.xxhash64("node"), F.col("g")).cast("int").alias("part"), F.lit(False).alias("pivot"), "node", "text")
    sent = members.join(pivots, ["component", "node"], "left_semi").select("component", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"), F.lit(True).alias("pivot"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for component, _, pivot, node, text in _rows(batch):
                if pivot:
                    at, own = node, shingles(text)
                elif node != at:
                    other = shingles(text)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    either = len(own) + len(other) - both
                    if both >= (2 * LEAST - 1 - 1e-9) * either:
                        found.append((component, at, node, both >= LEAST * either))
            columns = zip((pa.int64(),) * 3 + (pa.bool_(),), zip(*found) if found else ((),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for t, x in columns], ["component", "a", "b", "near"])

    dealt = rows.union(sent).repartition("component", "part").sortWithinPartitions("component", "part", F.desc("pivot"))
    return dealt.mapInArrow(run, "component long, a long, b long, near boolean")


def _across(large: DataFrame, homes: DataFrame, stars: DataFrame, per: DataFrame) -> DataFrame:
    """What is similar to one pivot against that which is similar to another, as rows for ``_blocks``. homes: node, home (a pivot that
    it is similar to, or is), linked (what links lead to from there); stars: as of ``_star``. A pair is met at the greater of its homes."""
    at, on = (homes.select(*[F.col(c).alias(f"{x}_{c}") for c in homes.columns]) for x in "ab")
    pairs = stars.where("NOT near").join(at, F.col("a") == F.col("a_node")).join(on, F.col("b") == F.col("b_node"))
    pairs = pairs.where("a_linked <> b_linked AND b_home < a").select("component", F.col("a").alias("star"), F.col("b").alias("node"), F.col("b_linked").alias("linked"))
    pairs = cut(pairs.distinct())
    told = homes.select(F.col("home").alias("star"), "node", "linked").join(pairs.select("star", "component").distinct(), "star")
    counts = pairs.groupBy("component", "star").agg(F.count(F.lit(1)).alias("r")).join(told.groupBy("star").agg(F.count(F.lit(1)).alias("l")), "star").join(per, "component")
    dealt = cut(counts.select("component", "star", *[F.ceil(F.col(x) / F.col("per")).cast("int").alias(x) for x in "lr"]))
    texts, key = large.select("node", "text"), ["component", "star"]
    l, r = (F.pmod(F.xxhash64("node"), F.col(x)).cast("int") for x in "lr")
    every_l, every_r = (F.explode(F.sequence(F.lit(0), F.col(x) - 1)) for x in "lr")
    ones = told.join(dealt, key).select(*key, l.alias("i"), every_r.alias("j"), "node", "linked", F.lit(False).alias("asks"))
    others = pairs.join(dealt, key).select(*key, every_l.alias("i"), r.alias("j"), "node", "linked", F.lit(True).alias("asks"))
    return ones.union(others).join(texts, "node").select(*key, "i", "j", "node", "linked", "asks", "text")


def _verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, block: int) -> DataFrame:
    """a, b: links that connect whatever candidates are similar."""
    members = candidates.join(classes.select("node", "sha256", "size"), "node")
    g = F.greatest(F.ceil(F.sum("size") / block), F.lit(1)).cast("int").alias("g")
    sizes = cut(members.groupBy("component").agg(F.count(F.lit(1)).alias("count"), g))
    members = spread_join(members.select("component", "node", "sha256"), sizes.select("component", "g"), "component", sizes.select("component", "count"))
    held = members.join(docs.select(content_key().alias("sha256"), "text"), "sha256").select("component", "node", "text", "g")
    zero, none, star, asks = F.lit(0), F.lit(None).cast("long").alias("linked"), F.lit(-1).cast("long").alias("star"), F.lit(True).alias("asks")
    small = held.where("g = 1").select("component", star, zero.alias("i"), zero.alias("j"), "node", none, asks, "text")
    keys = ["component", "star", "i", "j"]
    if sizes.where("g > 1").isEmpty():
        return _blocks(small, keys)
    # A pivot's links leave few members to be compared with all others.
    large = cut(held.where("g > 1").dropDuplicates(["node"]))
    per = sizes.where("g > 1").select("component", F.ceil(F.col("count") / F.col("g")).alias("per"))
    rest, found, pays, chosen = large.select("component", "node"), None, F.lit(True), None
    counted = cut(large.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("node"), F.lit(0).alias("before")).join(per, "component"))
    while True:
        pivots = counted.where(pays).select("component", "node")
        stars = cut(_star(large.join(pivots.select("component"), "component", "left_semi"), pivots))
        found = stars if found is None else found.union(stars)
        chosen = pivots.select("node") if chosen is None else chosen.union(pivots.select("node"))
        done = stars.where("near").select(F.col("b").alias("node")).union(pivots.select("node")).distinct()
        rest = cut(rest.join(done, "node", "left_anti").select("component", "node"))
        now = rest.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("node"))
        counted = cut(now.join(counted.select("component", F.col("count").alias("before"), "per"), "component"))
        pays = (F.col("count") > F.col("per")) & (F.col("before") - F.col("count") > F.col("per"))
        if counted.where(pays).isEmpty():
            break  # a further pass over a component's members pays if it may save a block's pass
    left = counted.select("component", F.ceil(F.col("count") / F.col("per")).cast("int").alias("u"))
    near = found.where("near").select("a", "b")
    home = near.select(F.col("b").alias("node"), F.col("a").alias("home")).union(chosen.select("node", F.col("node").alias("home"))).groupBy("node").agg(F.min("home").alias("home"))
    joined = connected_components(near).select("node", F.col("component").alias("linked"))
    homes = cut(home.join(joined, "node", "left").select("node", "home", F.coalesce("linked", "node").alias("linked")))
    every = large.join(left, "component").join(homes.select("node", "linked"), "node", "left")
    i, j = (F.pmod(F.xxhash64("node"), F.col(x)).cast("int") for x in "ug")
    one = every.join(rest.select("node"), "node", "left_semi").select("component", star, i.alias("i"), F.explode(F.sequence(zero, F.col("g") - 1)).alias("j"), "node", none, asks, "text")
    other = every.join(rest.select("node"), "node", "left_anti").select("component", star, F.explode(F.sequence(zero, F.col("u") - 1)).alias("i"), j.alias("j"), "node", "linked", F.lit(False).alias("asks"), "text")
    rests = one.where("j = 0").select("component", "i", "node", "text").join(left, "component")
    rests = rests.select("component", "i", F.explode(F.sequence(zero, F.col("u") - 1)).alias("k"), "node", "text").where("i <> k").select("component", star, (-1 - F.least("i", "k")).alias("i"), F.greatest("i", "k").alias("j"), "node", none, asks, "text")
    return _blocks(small.union(one).union(other).union(rests).union(_across(large, homes, found, per)), keys).union(near)


def first_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """sha256, doc_id: of each component of near copies (columns doc_id, text) the text with the smallest id, and that id."""
    classes = _classes(docs)
    candidates = _candidates(classes)
    let_go(docs.sparkSession)
    linked = connected_components(_verified(docs, classes, candidates, block))
    linked = cut(linked.join(classes.select("node", "sha256", "least"), "node"))
    best = linked.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sha256")).alias("best"))
    others = spread_join(linked, best, "component").where("sha256 <> best.sha256").select("node")
    return classes.join(others, "node", "left_anti").select("sha256", F.col("least").alias("doc_id"))
