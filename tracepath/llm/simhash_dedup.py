"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Search is by an inverted index on byte positions. Fingerprints that differ in at most 4 bits differ in at most
4 of their 8 bytes, so they share at least 4 positional bytes. The index has one posting for each way to
choose 4 positions. For the pairs of a posting list the shared positional bytes are tallied; pairs that reach the
guaranteed minimum are retained under the first 4 positions that they share, and verified by their differing bits.

Equal fingerprints are one class from the start. Within a posting list only a spanning forest of the verified
links is kept, found by sweeps over the members not yet reached; components need no more. Lists longer than ``block``
are indexed once more, by the bits that are not in their key: of the 32 others, dealt over 5 parts, a pair within 4 bits
has one part in common. What is longer still is cut into blocks by hash, and every pair of blocks is searched by a
task of its own: nothing is dropped, and no task holds more than two blocks.

Defined results: a null text is an empty text; a text without words has fingerprint zero and is linked like
any other; a text may be of any length, its shingles being counted as one array; repeated rows give a row each; a null id is
not the smallest unless all ids of a component are null, whose component_id is null then; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import cut, read_table, spread_join
from tracepath.llm.components import connected_components

BITS = 4
BLOCK = 2000
BYTES = 8

_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, words_in_shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The hash of each shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = min(words_in_shingle, len(words))
    first, last = (ends - lengths)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], "<u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes: a bit is 1 if it is set in over half of them."""
    places = h.view(np.uint8).reshape(-1, BYTES).astype(np.int64) + 256 * np.arange(BYTES)
    counts = np.bincount(places.ravel(), minlength=256 * BYTES).reshape(BYTES, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits(counts * 2 > len(h), axis=1, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words_in_shingle: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, words_in_shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_in_shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, fp long")


def _choices(bits: int) -> list[tuple[int, ...]]:
    return list(combinations(range(BYTES), BYTES - bits))


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _part_masks(positions: tuple[int, ...], parts: int) -> list[int]:
    """The bits that are not at these positions, dealt over so many parts."""
    others = [k for k in range(8 * BYTES) if k // 8 not in positions]
    return [sum(1 << k for k in others[i::parts]) for i in range(parts)]


def _first_shared(bits: int) -> np.ndarray:
    """By the set of shared positions (as 8 bits): the number of the choice made of its first ones, or -1 where the tally
    of the set is below the guaranteed minimum."""
    number = {c: i for i, c in enumerate(_choices(bits))}
    sets = ([p for p in range(BYTES) if s >> p & 1] for s in range(256))
    return np.array([number[tuple(x[: BYTES - bits])] if len(x) >= BYTES - bits else -1 for x in sets])


def _shared(x: np.ndarray) -> np.ndarray:
    """The positions of zero bytes in the difference x, as 8 bits."""
    zero = np.ascontiguousarray(x).view(np.uint8).reshape(-1, BYTES) == 0
    return np.packbits(zero, axis=1, bitorder="little").ravel()


def retained(d: np.ndarray, choice: int | np.ndarray, first_shared: np.ndarray, bits: int) -> np.ndarray:
    """Of pairs by their differences: which are retained by the tally under this choice and then verified."""
    near = np.bitwise_count(d) <= bits  # the cheaper test of the two goes first; both must hold
    if near.any():
        near[near] = first_shared[_shared(d[near])] == (choice[near] if isinstance(choice, np.ndarray) else choice)
    return near


def spanning_links(fps: np.ndarray, choice: int, first_shared: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of this posting list that fall under this choice."""
    left, out = np.unique(fps), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = retained(left ^ x, choice, first_shared, bits)
            out += [(int(x), int(y)) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return out


def links(classes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect whatever fingerprints (column fp, distinct) differ in at most ``bits`` bits."""
    choices = _choices(bits)

    def anded(masks: list[int]) -> Column:
        return F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])

    def counted(postings: DataFrame, where: str) -> DataFrame:
        """The lists' lengths (n) by c, k, of those that fulfil the condition."""
        return cut(postings.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where(where))

    every = classes.select("fp", F.posexplode(anded([_mask(c) for c in choices])).alias("c", "k"))
    every = every.select("fp", F.col("c").cast("short").alias("c"), "k")
    # Lists are told apart in full only where a bucket of many short ones is as long.
    buckets = F.pmod(F.xxhash64("k"), F.lit(max(4096, classes.count() // 256))).alias("bucket")
    full = cut(every.groupBy("c", buckets).agg(F.count(F.lit(1)).alias("n")).where(f"n > {block}").select("c", "bucket"))
    long = counted(every.select("*", buckets).join(full, ["c", "bucket"], "left_semi"), f"n > {block}")  # fewer than 70 / block of all postings have a list so long
    short = every
    if not long.isEmpty():
        short = every.join(long, ["c", "k"], "left_anti")
        table = F.array(*[anded(_part_masks(c, bits + 1)) for c in choices])
        again = every.join(long.select("c", "k"), ["c", "k"], "left_semi").select("fp", "c", "k", F.posexplode(F.get(table, F.col("c"))).alias("part", "bits"))
        again = again.select("fp", "c", F.xxhash64("k", "part", "bits").alias("k"))
        still = counted(again, f"n > {block}")
        g = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
        again = again.join(still, ["c", "k"], "left").select("fp", "c", "k", g.alias("g")).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        again = again.select("c", "k", "i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"), "fp")
        short = short.select("c", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp").union(again.select("c", "k", F.least("i", "j"), F.greatest("i", "j"), "fp"))
    else:
        short = short.select("c", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    postings = short
    keys = ["c", "k", "i", "j"]
    table = _first_shared(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            c, fp = cols[0], cols[-1]
            n = len(fp)
            if not n:
                return
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:-1]])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            two = starts[sizes == 2]  # most lists: all at once
            d = fp[two] ^ fp[two + 1]
            ok = (d != 0) & retained(d, c[two], table, bits)
            a, b = [fp[two][ok]], [fp[two + 1][ok]]
            for s, z in zip(starts[sizes > 2], sizes[sizes > 2]):
                found = spanning_links(fp[s : s + z], c[s], table, bits)
                if found:
                    x = np.array(found, np.uint64)
                    a.append(x[:, 0])
                    b.append(x[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)] + [batch.column(4).to_numpy().view(np.uint64)]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            same = np.logical_and.reduce([x == x[-1] for x in cols[:-1]])
            keep = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            carry = [x[keep:] for x in cols]
            yield from pairs([x[:keep] for x in cols])
        if carry is not None:
            yield from pairs(carry)

    return postings.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (signed), component_id: the least doc_id that links lead to."""
    prints = cut(fingerprints(docs, id_col, text_col, words_in_shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = connected_components(links(classes.select("fp"), bits, block))
    linked = cut(comps.select(F.col("node").alias("fp"), "component").join(classes, "fp"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = cut(spread_join(linked.select("fp", "component"), least, "component").select("fp", "component_id"))
    alone = classes.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return spread_join(prints, cut(linked.union(alone)), "fp").select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
