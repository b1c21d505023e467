"""Byte-level BPE, encoding and decoding, with merges found by a segment tree.

A piece of text is a row of bytes. A segment tree over byte positions stores, for each node, the leftmost position
of the least rank of a pair that starts there. A merge joins the pair at the root's position and updates three leaves
at most: the merged token's own, its live left neighbour's and the swallowed one's; each update climbs to the root,
so a piece of n bytes takes O(n log n) however long it is. Trees of short pieces are worked on side by side.

Texts are cut by the published pattern, with the letters and numbers of one version of Unicode whatever the worker's own
is. Stretches of blanks followed by other characters never share a match of it, so the distinct stretches of a column
are found first, and their tokens are remembered in a table of bounded size. Decoding goes from ids to bytes.

Defined results: a null text is an empty text with no tokens; repeated rows give a row each; an empty table gives an
empty result; other columns are not read. The work is row by row, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracepath.llm.common import Memory, Stretches, encode_texts, read_table

#: Unicode's White_Space.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_BLANKS = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The letters and numbers that Unicode 16, which defines the result, has and Unicode 15 has not.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x2EBF0, 0x2EE5D),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NO_RANK = 1 << 62
SIDE_BY_SIDE = 64


@cache
def characters(kind: str) -> str:
    """The letters ("L") or numbers ("N") of Unicode 16, as ranges of a character class."""
    if not "15" <= unicodedata.unidata_version < "17":
        raise RuntimeError(f"Unicode {unicodedata.unidata_version} can't be brought to version 16")
    new = NEW_LETTERS if kind == "L" else NEW_NUMBERS
    codes = {c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind} | {c for a, b in new for c in range(a, b + 1)}
    firsts, lasts = (sorted(c for c in codes if c + d not in codes) for d in (-1, 1))
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(firsts, lasts))


def compiled(pattern: str) -> re.Pattern:
    """The pattern with its classes written out. They may stand by themselves or within brackets."""
    classes = {r"\p{L}": characters("L"), r"\p{N}": characters("N"), r"\s": BLANK, r"\S": None}

    def within(m: re.Match) -> str:
        if m[0] in classes:
            return f"[^{BLANK}]" if m[0] == r"\S" else f"[{classes[m[0]]}]"
        return re.sub(r"\\p\{[LN]\}|\\s", lambda x: classes[x[0]], m[0])

    return re.compile(re.sub(r"\[(?:[^\]\\]|\\.)*\]|\\p\{[LN]\}|\\[sS]", within, pattern))


class Merges:
    """Merges by segment tree, over one long piece or over many short ones side by side.

    A tree's leaf at position i holds the rank of the pair that starts there, then i, as one number, so the least number
    below a node is the least rank at its leftmost position.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bits = max(ranks.values(), default=0).bit_length()
        pairs = sorted((ranks[t[:i]] << self.bits | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.codes = np.array([c for c, _ in pairs] + [NO_RANK], np.int64)
        self.joined = np.array([r for _, r in pairs] + [NO_RANK], np.int64)
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def one(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of least rank is merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        shift = size.bit_length()
        end = list(range(1, n + 1))  # of the token that starts here
        before = list(range(-1, n - 1))  # start of the live token to the left
        tree = [NO_RANK] * (2 * size)

        def leaf(i: int, j: int) -> int:
            r = ranks.get(piece[i:j])
            return NO_RANK if r is None else r << shift | i

        def put(i: int, value: int) -> None:
            x = size + i
            tree[x] = value
            while x := x >> 1:
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    return
                tree[x] = least

        tree[size : size + n - 1] = [leaf(i, i + 2) for i in range(n - 1)]
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        while tree[1] < NO_RANK:
            i = tree[1] & ((1 << shift) - 1)
            j = end[i]  # the token that is swallowed
            k = end[i] = end[j]
            put(j, NO_RANK)
            if k < n:
                before[k] = i
            put(i, leaf(i, end[k]) if k < n else NO_RANK)
            if (p := before[i]) >= 0:
                put(p, leaf(p, k))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << self.bits | right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.joined[at], NO_RANK)

    def many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The same for pieces of 2 to ``size`` bytes (a power of two) at once, as little-endian 32-bit ids. Every round
        makes the next merge of each piece that has one."""
        m, shift = len(pieces), size.bit_length()
        n = np.fromiter(map(len, pieces), np.int64, m)
        text = np.zeros((m, size), np.uint8)
        text[np.arange(size) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        places = np.arange(size)
        ids = self.byte_ids[text]  # of the token that starts here
        end = np.tile(places + 1, (m, 1))
        before = np.tile(places - 1, (m, 1))
        live = places < n[:, None]
        tree = np.full((m, 2 * size), NO_RANK, np.int64)
        pairs = places[:-1] < (n - 1)[:, None]
        r, c = np.nonzero(pairs)
        ranks = self._rank(ids[r, c], ids[r, c + 1])
        tree[r, size + c] = np.where(ranks < NO_RANK, ranks << shift | c, NO_RANK)
        x = size
        while x > 1:
            tree[:, x // 2 : x] = np.minimum(tree[:, x : 2 * x : 2], tree[:, x + 1 : 2 * x : 2])
            x //= 2
        ids_, end_, before_, live_, tree_ = (a.reshape(-1) for a in (ids, end, before, live, tree))
        rows = np.arange(m)

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
            base, x = rows * (2 * size), size + i
            tree_[base + x] = value
            for _ in range(shift - 1):
                x = x >> 1
                y = base + 2 * x
                tree_[base + x] = np.minimum(tree_[y], tree_[y + 1])

        while True:
            top = tree[rows, 1]
            go = top < NO_RANK
            rows, top = rows[go], top[go]
            if not len(rows):
                break
            at, base = top & ((1 << shift) - 1), rows * size
            i = base + at
            swallowed = end_[i]
            k = end_[i] = end_[base + swallowed]
            ids_[i] = top >> shift
            live_[base + swallowed] = False
            put(rows, swallowed, NO_RANK)
            right = k < n[rows]
            after = base + np.minimum(k, size - 1)
            before_[after[right]] = at[right]
            value = np.full(len(rows), NO_RANK, np.int64)
            value[right] = self._rank(ids_[i[right]], ids_[after[right]])
            put(rows, at, np.where(value < NO_RANK, value << shift | at, NO_RANK))
            p = before_[i]
            left = p >= 0
            p, some = p[left], rows[left]
            value = self._rank(ids_[base[left] + p], ids_[i[left]])
            put(some, p, np.where(value < NO_RANK, value << shift | p, NO_RANK))
        flat = ids[live].astype("<u4").tobytes()
        cuts = [0, *np.cumsum(4 * live.sum(axis=1)).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.merges = Merges(ranks)
        self.tokens = dict((i, t) for t, i in ranks.items())
        self.whole = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.pattern = compiled(pattern)
        self.memory, self.stretches = Memory(self._stretches), Stretches(WIDE_BLANKS)
        most = max(self.tokens, default=0) + 1
        digits = [f"{i} ".encode() for i in range(most)]
        width = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(most, width)

    def _pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces; short ones are merged side by side."""
        out, sized = {}, defaultdict(list)
        for p in pieces:
            if (w := self.whole.get(p)) is not None:
                out[p] = w
            elif len(p) <= SIDE_BY_SIDE:
                sized[max(8, 1 << (len(p) - 1).bit_length())].append(p)
            else:
                out[p] = np.array(self.merges.one(p), "<u4").tobytes()
        for size, some in sized.items():
            for i in range(0, len(some), 4096):
                out |= zip(some[i : i + 4096], self.merges.many(some[i : i + 4096], size))
        return out

    def _stretches(self, stretches: list[bytes]) -> dict[bytes, bytes]:
        cuts = {s: [x.encode("utf-8", "surrogateescape") for x in self.pattern.findall(s.decode("utf-8", "surrogateescape"))] for s in stretches}
        ids = self._pieces({x for xs in cuts.values() for x in xs})
        return {s: b"".join([ids[x] for x in xs]) for s, xs in cuts.items()}

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return encode_texts(texts, self.stretches, self.memory)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_column(pa.array([text]))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal digits, one space between them."""
        d = self.digits[ids]
        return d[d != 0].tobytes()[:-1]


@cache
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One a worker process."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids: the tokens of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            ids = pa.array([x.astype(np.int32) for x in t.encode_column(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, content: the bytes that the ids stand for. An id without a token is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes, decodes and digests in one pass, so that ids need not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids in t.encode_column(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(t.decimal(ids)).hexdigest())
                b.append(hashlib.sha256(t.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
