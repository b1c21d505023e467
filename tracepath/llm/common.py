"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder named in spark.checkpoint.dir; make one only for a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tracepath-checkpoints-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, keep it in the shared checkpoint folder and forget its lineage."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Files of finished shuffles stay on the executors' disks until the driver's JVM finds that nothing refers to them;
    a driver with little to do may not look for hours, so ask it to. Python's frames refer to the JVM's, stand in cycles, and are taken
    back in the background once a second."""
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def narrow(union: DataFrame) -> DataFrame:
    """Without a shuffle, no more partitions than a shuffle has: a union adds up those of its parts, and in a loop that cuts
    lineage they would double each round, with a file or two for each task."""
    return union.coalesce(int(union.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """Rows of left with the row of right (one a key) of their key, on columns named alike. The ``most`` commonest keys with
    more than 1000 rows, if there are such, are broadcast with their rows of right; the rest is dealt by key, so no task gets
    more than 1/most of left through one key. ``counts``: left's rows by key (columns key, count), if they are at hand; keys
    that right has not may be missing."""
    counts = left.groupBy(key).count() if counts is None else counts
    common = counts.where("count > 1000").orderBy(F.desc("count")).limit(most).select(key).collect()  # no row of data: a bounded list of keys
    if not common:
        return left.join(right, key)
    hot = F.broadcast(left.sparkSession.createDataFrame(common, left.select(key).schema))
    rare = left.join(hot, key, "left_anti").join(right, key)
    return narrow(rare.unionByName(left.join(F.broadcast(right.join(hot, key)), key)))


#: Blanks of one byte.
ASCII_BLANKS = b"\t\n\x0b\x0c\r "


class Stretches:
    """Cuts texts into stretches: blanks, then what is not blank; at a text's end blanks alone. Works on the bytes of a
    whole column at once, and finds the distinct stretches by hashing them where they stand."""

    def __init__(self, wide_blanks: str = ""):
        self.narrow = np.isin(np.arange(256), list(ASCII_BLANKS))
        self.wide: list[tuple[int, np.ndarray, list[int]]] = []
        for n in (2, 3):
            codes = [x for c in wide_blanks if len(x := c.encode()) == n]
            if codes:
                self.wide.append((n, np.isin(np.arange(256), [x[0] for x in codes]), [int.from_bytes(x, "big") for x in codes]))

    def _blank(self, data: np.ndarray) -> np.ndarray:
        b = self.narrow[data]
        for n, leads, codes in self.wide:
            at = np.flatnonzero(leads[data[: len(data) - n + 1]]) if len(data) >= n else np.empty(0, np.int64)
            value = np.zeros(len(at), np.int64)
            for k in range(n):
                value = value << 8 | data[at + k]
            at = at[np.isin(value, codes)]
            for k in range(n):
                b[at + k] = True
        return b

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The first stretch of each text (and the number of all), the number of each stretch's content, the contents."""
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(len(offsets), np.int64), np.empty(0, np.int32), []
        starts, found = self._found(data, offsets[:-1][np.diff(offsets) > 0])
        found = found.dictionary_encode()
        return np.searchsorted(starts, offsets), found.indices.to_numpy(), found.dictionary.to_pylist()

    def _found(self, data: np.ndarray, texts_begin: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Where stretches start, and their contents."""
        b = self._blank(data)
        begins = np.zeros(len(data), bool)
        begins[1:] = b[1:] & ~b[:-1]
        begins[texts_begin] = True
        starts = np.flatnonzero(begins)
        ends = pa.py_buffer(np.append(starts, len(data)))
        return starts, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(data))])


def portions(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of whole texts of about so many bytes, for each of which some 40 are held while it is cut; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


_memories: weakref.WeakSet[Memory] = weakref.WeakSet()


def release() -> None:
    """Tasks that need no remembered stretches let go of those that earlier tasks left in their worker, and of Arrow's empty pages."""
    for m in _memories:
        m.clear()
    pa.default_memory_pool().release_unused()


class Memory:
    """Remembers what short stretches are encoded to, in two generations of bounded size: when the younger one is full it
    becomes the older one, and what is asked for again comes back from there."""

    def __init__(self, encode: Callable[[list[bytes]], dict[bytes, bytes]], most: int = 60_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        _memories.add(self)

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def __call__(self, distinct: list[bytes]) -> list[bytes]:
        """The code of each of some distinct stretches."""
        codes = list(map(self.young.get, distinct))
        missing = [s for s, c in zip(distinct, codes) if c is None]
        new = {s: v for s in missing if (v := self.old.get(s)) is not None}
        new |= self.encode([s for s in missing if s not in new])
        if len(self.young) + len(new) > self.most:
            self.young, self.old = {}, self.young
        self.young |= {s: v for s, v in new.items() if len(s) <= self.longest}
        return [new[s] if c is None else c for s, c in zip(distinct, codes)]


def encode_texts(texts: pa.Array, stretches: Stretches, memory: Memory) -> Iterator[np.ndarray]:
    """The ids of each text, the codes of its stretches (little-endian 32-bit numbers) joined."""
    for part in portions(texts):
        first, which, distinct = stretches(part)
        codes = memory(distinct)
        lengths = np.fromiter((len(c) >> 2 for c in codes), np.int64, len(codes))
        flat = np.frombuffer(b"".join(codes), "<u4")
        each = lengths[which]
        ends = np.cumsum(each)
        shift = (np.cumsum(lengths) - lengths)[which] - (ends - each)
        ids = flat[np.repeat(shift, each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.append(0, ends)[first].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b]
