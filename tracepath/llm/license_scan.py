"""Fuzzy search for short licence notices.

Each notice may be found with up to ``edits`` character edits. A notice is split into edits + 1 pieces: with
so few edits one piece stands unchanged (pigeonhole), so exact search for the pieces locates every candidate,
and bounded-error matching verifies the window of each and yields the span and the number of edits. Of matches that
overlap the best stays.

Texts are lower-cased (A-Z only) and brought to words joined by single spaces, as UTF-8 bytes; words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Spans are in words, the first being 0.

Defined results: a null text is an empty text without words, places or labels; a text of any length is searched as one row of
bytes; null ids and repeated rows give a row each; an empty table gives an empty result; other columns are not read. The work is row by row, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tracepath.llm.common import read_table

#: Exact phrases, each found place of which counts.
PHRASES: tuple[tuple[str, str], ...] = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    """``words`` tell it from other licences and must be there (None: those of its label); with one of ``spoils`` it is another."""

    label: str
    text: str
    edits: int
    words: tuple[str, ...] | None = None
    spoils: tuple[str, ...] = ()


NOTICES: tuple[Notice, ...] = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit-0", "released under the mit 0 license", 3),
    Notice("mit", " spdx license identifier mit ", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 8, ("this", "software"), ("font", "fonts")),
    Notice("apache-2", "licensed under the apache license version 2", 4),
    Notice("apache-2", " apache license 2 0 ", 2),
    Notice("apache-2", " apache 2 0 ", 0),
    Notice("cc-by-nc", "licensed under cc by nc", 2),
    Notice("cc-by-nc-sa", " cc by nc sa ", 1),
    Notice("cc-by-nc-nd", " cc by nc nd ", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 2),
    Notice("cc-by-nd", "licensed under cc by nd", 2),
    Notice("cc0", "cc0 1 0 universal public domain dedication", 3),
    Notice("gpl-3", "gnu general public license version 3", 3),
    Notice("gpl-2", "gnu general public license version 2", 3),
    Notice("gpl-3", " gnu general public license v3 ", 2, ("v3",)),
    Notice("gpl-2", " gnu general public license v2 ", 2, ("v2",)),
    Notice("gpl-3", " gnu gpl version 3 ", 1),
    Notice("gpl-2", " gnu gpl version 2 ", 1),
    Notice("gpl-3", " gnu gpl v3 ", 0),
    Notice("gpl-2", " gnu gpl v2 ", 0),
    Notice("lgpl-3", "gnu lesser general public license version 3", 3),
    Notice("lgpl-2", "gnu lesser general public license version 2", 3),
    Notice("agpl-3", "gnu affero general public license version 3", 3),
    Notice("mpl-2", "mozilla public license version 2", 3),
    Notice("epl-2", "eclipse public license version 2", 3),
    Notice("bsl-1", "boost software license version 1", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("bsd", "released under the bsd license", 3),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", 9, ("with", "or", "without", "fee", "provided"), ("documentation",)),
    Notice("isc", "released under the isc license", 3),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
)

#: The base phrases, in any surroundings, with edits.
CORES: tuple[Notice, ...] = (
    Notice("mit", "under the mit license", 2),
    Notice("apache-2", "apache license version 2", 3),
    Notice("cc-by-nc", "cc by nc", 1),
)

#: What tells a notice from others: words that must all be there, and words that stand there in other licences. Long texts of their
#: own either have such words themselves or need nothing told.
_NAMES = ("mit", "bsd", "isc", "gpl", "lgpl", "agpl", "mpl", "zlib")
_GNU = ("lesser", "affero", "library")
TELLING: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "mit": (("mit",), ("0", *_NAMES[1:])),
    "mit-0": (("mit", "0"), _NAMES[1:]),
    **{x: ((x,), tuple(y for y in _NAMES if y != x)) for x in ("bsd", "isc")},
    "apache-2": (("2",), ()),
    **{f"cc-by-{x}": ((x,), tuple(y for y in ("nc", "nd", "sa") if y != x)) for x in ("nc", "nd", "sa")},
    **{f"cc-by-nc-{x}": (("nc", x), tuple(y for y in ("nd", "sa") if y != x)) for x in ("nd", "sa")},
    "cc0": (("cc0",), ()),
    **{f"gpl-{n}": ((n,), _GNU) for n in "23"},
    **{f"lgpl-{n}": (("lesser", n), _GNU[1:]) for n in "23"},
    "agpl-3": (("affero", "3"), ("lesser", "library")),
    "mpl-2": (("mozilla", "2"), ("eclipse", "netscape")),
    "epl-2": (("eclipse", "2"), ("mozilla", "netscape")),
    "bsl-1": (("boost", "1"), ()),
}

KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normal_words(text: str | None) -> bytes:
    """The words, lower-cased, between single spaces, with a space at either end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(KEEP).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def pieces(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 parts of nearly equal length, with the place of each."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(a: str, b: str) -> int:
    """Edits between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


VOWELS = frozenset("aeiouy")


def tells(s: bytes, n: Notice, start: int, end: int) -> bool:
    """Whether the words at this place have each of the notice's telling words, and none that makes it another licence. A number stands
    as it is; a word as it is, or with spaces moved between it and its neighbours; or, if it is short, with one edit that leaves no
    vowel (no word of a language, so not another word), and if it is longer, with one edit; but not if that is nearer to another
    licence's word."""
    by_label, rivals = TELLING.get(n.label, ((), ()))
    own = n.text.split()
    words = by_label if n.words is None else n.words
    words = [w for w in words if w in own]
    while start < end and s[start] == 0x20:
        start += 1
    while end > start and s[end - 1] == 0x20:
        end -= 1
    here = s[s.rfind(b" ", 0, start) + 1 : max(s.find(b" ", end), end)].decode("utf-8", "replace").split()
    rest = [w for w in here if w not in own]
    if any(w in n.spoils for w in rest) or words and n.words is None and any(w in rivals for w in rest):
        return False
    for word in words:
        if word in here:
            continue
        k = own.index(word)
        moved = "".join(own[:k])[-2:] + word + "".join(own[k + 1 :])[:2]
        if moved in "".join(here) and word.isalpha():
            continue
        edited = [w for w in rest if distance(w, word) == 1 and all(distance(w, x) > 1 for x in rivals)]
        if not word.isalpha() or not any(len(word) > 3 or not VOWELS & set(w) for w in edited):
            return False
    return True


class Scanner:
    """Finds notices in normalised texts."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, cores: tuple[Notice, ...] = CORES):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices, self.cores = [], []
        seeds: dict[bytes, list[tuple[Notice, int]]] = {}
        for forms, n in [*((self.notices, n) for n in notices), *((self.cores, n) for n in cores)]:
            p = n.text.encode()
            forms.append((n, regex.compile(rb"(?b)(?:" + regex.escape(p, special_only=True) + rb"){e<=%d}" % n.edits)))
            for at, piece in pieces(p, n.edits):
                seeds.setdefault(piece, []).append((n, at + len(piece) - 1))
        self.seeds = ahocorasick.Automaton()
        for piece, whose in seeds.items():
            self.seeds.add_word(piece.decode("latin-1"), whose)
        self.seeds.make_automaton()

    def windows(self, s: bytes) -> dict[Notice, set[tuple[int, int]]]:
        """Stretches of s, one for each place that a seed gives to a candidate, by one pass for the seeds of all notices."""
        found: dict[Notice, set[tuple[int, int]]] = {}
        for end, whose in self.seeds.iter(s.decode("latin-1")):
            for n, behind in whose:
                start = end - behind
                found.setdefault(n, set()).add((max(0, start - n.edits), min(len(s), start + len(n.text) + 2 * n.edits)))
        return found

    def search(self, s: bytes, forms: list, windows: dict | None = None) -> list[tuple[Notice, int, int, int]]:
        """notice, start, end, edits of the matches of each form; of those of a form that overlap the best, then the first."""
        out = []
        windows = self.windows(s) if windows is None else windows
        for n, pattern in forms:
            found = {(sum(m.fuzzy_counts), *m.span()) for a, b in sorted(windows.get(n, ())) if (m := pattern.search(s, a, b))}
            taken: list[tuple[int, int]] = []
            for e, i, j in sorted(found):
                k = bisect_left(taken, (i, j))
                if (k == 0 or taken[k - 1][1] <= i) and (k == len(taken) or taken[k][0] >= j):
                    taken.insert(k, (i, j))
                    out.append((n, i, j, e))
        return out

    def placed(self, s: bytes, found: list[tuple[Notice, int, int, int]]) -> list[tuple[str, int, int, int]]:
        """label, first word, last word, edits, by place."""
        out = []
        for n, i, j, e in found:
            body = s[i:j].strip()
            if body:
                first = s.count(b" ", 0, s.index(body, i) + 1) - 1
                out.append((n.label, first, first + body.count(b" "), e))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def fuzzy(self, s: bytes) -> list[tuple[str, int, int, int]]:
        """label, first word, last word, edits of each verified notice, by place."""
        return self.placed(s, self.search(s, self.notices))

    def near(self, s: bytes) -> list[tuple[Notice, int, int, int]]:
        """The verified notices, and the edited base phrases that stand in none of them, if their telling word is there."""
        windows = self.windows(s)
        whole = [x for x in self.search(s, self.notices, windows) if tells(s, *x[:3])]
        for n, i, j, e in self.search(s, self.cores, windows):
            if e and tells(s, n, i, j) and not any(m.label == n.label and a < j and i < b for m, a, b, _ in whole):
                whole.append((n, i, j, e))
        return whole

    def exact(self, s: bytes) -> list[tuple[str, int]]:
        """label and first word of each place of a phrase."""
        out = []
        for p, label in self.phrases:
            i = s.find(p)
            while i >= 0:
                out.append((label, s.count(b" ", 0, i)))
                i = s.find(p, i + 1)
        return out

    def scan(self, text: str | None) -> dict:
        s = normal_words(text)
        base, found = self.exact(s), self.near(s)
        near = self.placed(s, found)
        starts = [at for _, at in base]
        return {
            "n_words": s.count(b" ") - 1,
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for x, _ in base})),
            "labels": ",".join(sorted({x for x, _ in base} | {x[0] for x in near})),
            "score": 1.0 if base else max((1 - e / len(n.text) for n, _, _, e in found), default=0.0),
            "spans": ",".join(f"{x}:{a}:{b}:{e}" for x, a, b, e in near),
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """One row per document; ``spans`` lists label:first word:last word:edits of the verified notices."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string()}
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], ["doc_id", *kinds])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(scan, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
