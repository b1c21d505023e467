"""Best-fit packing of token sequences, in bulk.

Documents are tokenized where they are read and cut into pieces of at most ``size`` tokens; a piece is kept as its
length and a checksum. Pieces of equal length are interchangeable, so supersteps run over the classes of a range-sorted
census (at most ``size`` lengths, whatever the number of documents): a class sweeps to its successor, the smallest
class of gaps that it fits; ranks resolve conflicts, the r-th piece of a class taking the r-th gap; the gaps taken
shrink and are sorted in again; the rest of the class sweeps on, and opens sequences when no gap is left. Longest
classes go first. What the supersteps leave is a table of rank intervals, the size of which depends on the number of
lengths and not on that of documents; it is sent to the tasks, and every piece finds its place by its rank.

Ranks are dealt without a sort: a task numbers its pieces by length, and sums of the tasks' counts per length shift
those numbers, so no length, however common, is gathered in one task.

Defined results: a null text is an empty text, which still has its end token; repeated rows and null ids are packed like
any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from string import ascii_letters, ascii_uppercase, punctuation

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

from tracepath.llm.common import ASCII_BLANKS, Memory, Stretches, cut, encode_texts, read_table

SIZE = 4096
END_ID = 1


#: Small letters of ASCII and Latin-1 in UTF-8: letters that normalisation leaves alone if no other characters stand by them.
SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Words(Stretches):
    """Cuts texts into words, whose blanks are left out. The marks that end a word after a letter of ASCII or Latin-1 are a word
    of their own, and words of such letters alone come in lower case. Other letters may change with normalisation, so
    the words that have any stay as they are."""

    def __init__(self, marks: str = ".,"):
        super().__init__()
        self.narrow_letter = np.isin(np.arange(256), list(ascii_letters.encode()))
        self.large = np.isin(np.arange(256), list(ascii_uppercase.encode()))
        self.second = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])  # of a letter that begins with C3
        self.large_second = self.second & (np.arange(256) < 0x9F)
        self.mark = np.isin(np.arange(256), list(marks.encode()))

    def _found(self, data: np.ndarray, texts_begin: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        blank, letter = self._blank(data), self.narrow_letter[data]
        large, c3 = self.large[data], np.flatnonzero(data[:-1] == 0xC3)
        c3 = c3[self.second[data[c3 + 1]]]
        letter[c3] = letter[c3 + 1] = True
        large[c3 + 1] = self.large_second[data[c3 + 1]]
        edge = np.append(blank, True)  # here no word goes on
        edge[texts_begin] = True
        begins = ~blank
        begins[1:] &= edge[1:-1] | blank[:-1]
        mark = self.mark[data] & ~edge[:-1]
        after = np.flatnonzero(mark[1:] & letter[:-1]) + 1
        others = np.append(np.flatnonzero(~mark), len(data))
        begins[after[edge[others[np.searchsorted(others, after)]]]] = True
        starts, dark = np.flatnonzero(begins), ~blank
        ends = np.append(0, np.cumsum(dark))[np.append(starts, len(data))]
        letter, large, data = letter[dark], large[dark], data[dark]
        if len(starts):
            plain = np.repeat(np.logical_and.reduceat(letter, ends[:-1]), np.diff(ends))
            data = data | ((plain & large).view(np.uint8) << 5)
        return starts, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


class WordIds:
    """Ids as little-endian 32-bit numbers. The tokenizer drops blanks and no token spans one, so the ids of words are
    remembered. Words of ``SMALL`` letters need no normalisation and no pattern to cut them: its model alone encodes
    them, many at once, and each one's last id is of a token that ends words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        for t in added:
            if t.lstrip or t.rstrip or t.single_word or any(c in t.content.encode() for c in ASCII_BLANKS):
                raise ValueError(f"the token {t.content!r} depends on more than a stretch between blanks")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        letters = [*ascii_letters, *(chr(x) for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))]
        pairs = [a + b for a in letters for b in ["", *letters]]
        library, plain = self._library([p.encode() for p in pairs]), self._plain([p.lower().encode() for p in pairs])
        if any(library[p.encode()] != plain[p.lower().encode()] for p in pairs):
            raise ValueError("the tokenizer does more to words of letters of ASCII and Latin-1 than to lower their case")
        self.memory, self.stretches = Memory(self._words), Words("".join(c for c in punctuation if not any(c in t.content for t in added)))

    def _library(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            e = self.tokenizer.encode([w.decode("utf-8", "replace") for w in some], is_pretokenized=True, add_special_tokens=False)
            out |= _cut_ids(some, np.array(e.ids, "<u4"), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1)))
        return out

    def _plain(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            ids = np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(some) + 1:
                raise ValueError("the tokenizer's tokens don't tell where words end")
            out |= _cut_ids(some, ids, cuts)
        return out

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, others = [], []
        for w in words:
            (plain if SMALL.fullmatch(w) else others).append(w)
        return self._plain(plain) | self._library(others)

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return encode_texts(texts, self.stretches, self.memory)

    def __call__(self, text: str) -> bytes:
        return next(self.encode_column(pa.array([text]))).tobytes()


def _cut_ids(words: list[bytes], ids: np.ndarray, cuts: np.ndarray) -> dict[bytes, bytes]:
    whole, at = ids.tobytes(), (4 * cuts).tolist()
    return {w: whole[a:b] for w, a, b in zip(words, at, at[1:])}


@cache
def word_ids(path: str) -> WordIds:
    """One a worker process."""
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, place: the place of the piece among the task's of its length."""
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = word_ids(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_column(batch.column(1))):
                ids = ids.tobytes() + end
                for piece, i in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[i : i + 4 * size]
                    n = len(part) // 4
                    rows.append((doc, piece, i // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def match_classes(census: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """length, first rank, count, first sequence, offset of each match of a class of pieces with a class of gaps:
    the piece of rank first + i goes into sequence first + i at that offset. And the number of sequences."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: first sequence, how many
    gaps: list[int] = []
    out, opened = [], 0

    def put(gap: int, run: tuple[int, int]) -> None:
        if not runs[gap]:
            insort(gaps, gap)
        runs[gap].append(run)

    for length in sorted(census, reverse=True):
        rank, left = 0, census[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                new = -(-left // (size // length))
                put(size, (opened, new))
                opened += new
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del gaps[at]
            take = min(n, left, -(-left // (gap // length)))
            out.append((length, rank, take, first, size - gap))
            if take < n:
                put(gap, (first + take, n - take))
            if gap > length:
                put(gap - length, (first, take))
            rank, left = rank + take, left - take
    return out, opened


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``token_pieces``."""
    if not 0 < size < 1 << 15:
        raise ValueError("size must be below 32768: a length and a rank share one long")
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    census = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    matches, _ = match_classes(census, size)
    table = np.array(sorted(matches), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(((table[:, 0] << 48) | table[:, 1], table[:, 1], table[:, 3], table[:, 4]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
