"""Exact deduplication by Grace hashing.

Every map task first folds its own equal texts, so a text that fills a third of the table is sent once a task.
The folded records are partitioned by hash. A task takes its records into an open-addressing table that compares
complete contents; if the distinct contents outgrow ``table_bytes``, table and rest are partitioned to spill files
by another hash and each file is treated in the same way, until each fits. Spill files belong to one task, have no
name and go with it; a task that is run again after a loss reads its records from the shuffle once more.
Rows then find their class by the content's SHA-256, in a join that carries no texts.

Defined results: a null text equals an empty text; a null doc_id is smaller than any other; rows that repeat both
doc_id and text count each, and are kept or dropped together; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import read_table, release

TABLE_BYTES = 96 << 20
FAN_OUT = 16
MAX_DEPTH = 12
NONE = -(1 << 63) - 1  # below every id

#: content, largest id (NONE if there is none), number of rows
Record = tuple[bytes, int, int]


class ContentTable:
    """Open addressing with linear probing; equal means that all bytes are equal."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keep: list[int] = []
        self.count: list[int] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def _find(self, h: int, content: bytes) -> tuple[int, int]:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return at, entry

    def add(self, content: bytes, keep: int, count: int) -> None:
        h = xxhash.xxh64_intdigest(content)
        at, entry = self._find(h, content)
        if entry >= 0:
            self.keep[entry] = max(self.keep[entry], keep)
            self.count[entry] += count
            return
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.keep.append(keep)
        self.count.append(count)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, x in enumerate(self.hashes):
                at = x & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i

    def records(self) -> Iterator[Record]:
        return zip(self.contents, self.keep, self.count)


def fold(records: Iterable[Record], table_bytes: int = TABLE_BYTES) -> Iterator[Record]:
    """Equal contents within a stretch of records are made one; the table is emptied whenever it is full."""
    table = ContentTable()
    for r in records:
        table.add(*r)
        if table.bytes > table_bytes:
            yield from table.records()
            table = ContentTable()
    yield from table.records()


_HEAD = struct.Struct("<?qqQ")


def grace(records: Iterable[Record], table_bytes: int = TABLE_BYTES, depth: int = 0, fan_out: int = FAN_OUT) -> Iterator[Record]:
    """One record for each distinct content."""
    table, rest = ContentTable(), iter(records)
    for r in rest:
        table.add(*r)
        if table.bytes > table_bytes and len(table) > 1 and depth < MAX_DEPTH:
            break
    else:
        yield from table.records()
        return
    files = [tempfile.TemporaryFile() for _ in range(fan_out)]
    try:
        for source in (table.records(), rest):
            for content, keep, count in source:
                f = files[xxhash.xxh64_intdigest(content, depth + 1) % fan_out]
                f.write(_HEAD.pack(keep != NONE, max(keep, NONE + 1), count, len(content)))
                f.write(content)
        del table
        for f in files:
            f.seek(0)
            yield from grace(_read(f), table_bytes, depth + 1, fan_out)
            f.close()
    finally:
        for f in files:
            f.close()


def _read(f) -> Iterator[Record]:
    while head := f.read(_HEAD.size):
        there, keep, count, n = _HEAD.unpack(head)
        yield f.read(n), keep if there else NONE, count


def content_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """sha256, keep_id, group_size of each distinct text."""
    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS keep", f"CAST(coalesce(`{text_col}`, '') AS BINARY) AS content")

    def or_none(x: int | None) -> int:
        return NONE if x is None else x

    def out(records: Iterable[Record], as_row) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for r in records:
            rows.append(as_row(r))
            held += len(r[0])
            if held > 4 << 20 or len(rows) >= 20_000:
                yield pack(rows)
                rows, held = [], 0
        if rows:
            yield pack(rows)

    def pack(rows: list) -> pa.RecordBatch:
        first = pa.binary() if isinstance(rows[0][0], bytes) else pa.string()
        kinds = [first, pa.int64(), pa.int64(), pa.int64()][: len(rows[0])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["content" if first == pa.binary() else "sha256", "keep", "n", "h"][: len(kinds)])

    def fold_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        records = ((c.as_py(), or_none(k.as_py()), 1) for b in batches for k, c in zip(b.column(0), b.column(1)))
        yield from out(fold(records, table_bytes), lambda r: (r[0], None if r[1] == NONE else r[1], r[2], xxhash.xxh64_intdigest(r[0], 99) - (1 << 63)))

    def grace_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        records = ((c.as_py(), or_none(k.as_py()), n.as_py()) for b in batches for c, k, n in zip(b.column(0), b.column(1), b.column(2)))
        yield from out(grace(records, table_bytes), lambda r: (hashlib.sha256(r[0]).hexdigest(), None if r[1] == NONE else r[1], r[2]))

    folded = rows.mapInArrow(fold_part, "content binary, keep long, n long, h long")
    dealt = folded.repartition("h").select("content", "keep", "n")
    return dealt.mapInArrow(grace_part, "sha256 string, keep long, n long").selectExpr("sha256", "keep AS keep_id", "n AS group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    members = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"sha2(CAST(coalesce(`{text_col}`, '') AS BINARY), 256) AS sha256")
    found = members.join(content_classes(docs, id_col, text_col, table_bytes), "sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN c USING (t)
"""
