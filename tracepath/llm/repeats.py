"""Removal of long repeats by a suffix array with common prefixes, built for many texts at once, column by column.

Equal windows of ``length`` bytes have equal least hashes of the k-grams in them. So each text is cut into runs of windows with one
least hash (the anchor), and only runs whose anchor stands in another text, or twice in one, can hold a repeat. Of each such run its piece
of text goes to the task of its anchor; there the pieces of some anchors make a collection whose suffixes are put in order column by
column (``suffix_collection``). Neighbours with ``length`` common bytes are equal windows; of these the first stays
and the others are removed. Pieces are short, so rounds are few, whatever the length of texts.

Equal texts are judged once: the row with the smallest id is, the other ones are removed whole. Equal pieces are folded in each task
before they are shuffled, and so are anchors that one task meets twice, so copies in any number send a row a task. Pieces about an anchor of
very many different texts are dealt by their single windows instead; these anchors are a bounded list.

Defined results: a null text counts as empty; a null doc_id is smaller than any other; rows that repeat both doc_id and text count
each, and one of them is the first; of rows with one doc_id and different texts the one with the smaller SHA-256 is the first. Texts
shorter than ``length`` stay whole. Very long texts are read whole, a piece at a time. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import cut, let_go, read_table, release
from tracepath.llm.suffix_collection import Collection

LENGTH, K = 100, 24
NONE = -(1 << 63)  # stands for a null id
PIECE, CHUNK, PORTION = 1 << 16, 1 << 16, 32 << 20  # bytes: of a text, hashed at once, whose anchors are held at once
FOLDED = 48 << 20  # bytes of pieces that a task holds to fold equal ones
COLLECTED, WAITING = 1000, 2 << 20  # texts of a collection; bytes of pieces that wait for one
HOT, MOST_HOT = 2048, 100_000  # texts with an anchor from which it may be dealt by windows; how many such anchors at most


def powers(k: int) -> dict[int, int]:
    base = 0x9E3779B97F4A7C15
    return {n: pow(base, n, 1 << 64) for n in range(1, k + 1)}


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k bytes, from hashes of 1, 2, 4, ... bytes."""
    power = powers(k)
    whole, done = None, 0
    step, size = data.astype(np.uint64) + np.uint64(1), 1
    while done < k:
        if k & size:
            if whole is None:
                whole = step
            else:
                n = min(len(step), len(whole) - size)
                whole = step[:n] * np.uint64(power[done]) + whole[size : size + n]
            done += size
        if done < k:
            step, size = step[:-size] * np.uint64(power[size]) + step[size:], 2 * size
    whole = whole ^ (whole >> np.uint64(29))
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other: text, first window, number of windows and anchor of each run, and whether the
    anchor stands twice there, so that a window may too."""
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    width = length - k + 1
    hashes = gram_hashes(data, k)
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width)  # a hash's high bits and its place
    begins = np.append(0, ends[:-1])
    starts = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, begins[begins < len(least)])
    anchor = hashes[(least[starts] & low).astype(np.int64)].view(np.int64)
    text = np.searchsorted(ends, starts, side="right")
    stop = np.minimum(np.append(starts[1:], len(least)), ends[text] - length + 1)
    some = stop > starts
    starts, stop, text, anchor = starts[some], stop[some], text[some], anchor[some]
    goes_on = np.append(False, (anchor[1:] == anchor[:-1]) & (text[1:] == text[:-1])) if len(starts) else np.empty(0, bool)
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(starts)) - 1
    again = last > first
    starts, n, text, anchor = starts[first], (stop[last] - starts[first]), text[first], anchor[first]
    parts = -(-n // width)  # a long run is a text that repeats itself; its parts are of bounded length
    of = np.repeat(np.arange(len(n)), parts)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * width
    return text[of], starts[of] + at - begins[text[of]], np.minimum(n[of] - at, width), anchor[of], again[of]


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of each owner, those that meet or overlap made one."""
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    if not len(owner):
        return owner, begin, end
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * far)  # owners lie one after the other
    new = np.append(True, begin[1:] + owner[1:] * far > reach[:-1])
    new |= np.append(True, owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], begin[first], (reach - owner * far)[np.append(first[1:], len(owner)) - 1]


def _spread(t: np.ndarray) -> np.ndarray:
    return (t.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


RUNS = "route long, anchor long, id long, t long, run long"
KNOWN, WINDOWS = 21, 22  # bits of a run: how many windows, above them whether it is known to be wanted, above that its first window + 1


def _run(s: np.ndarray, c: np.ndarray, known: np.ndarray) -> np.ndarray:
    return ((s.astype(np.int64) + 1) << WINDOWS) | (known.astype(np.int64) << KNOWN) | c


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) if not isinstance(c, np.ndarray) else pa.array(c).cast(kinds[kind]) for c, (_, kind) in zip(columns, fields)], [f for f, _ in fields])


def _anchors_of(length: int, k: int):
    """Rows of runs: an anchor met once goes where its likes go; one met more often tells that by a row without a run, whose id
    is how often, and its runs, known to be wanted, go anywhere."""

    def hand_on(held: list) -> Iterator[pa.RecordBatch]:
        anchor, ident, t, s, c, again = map(np.concatenate, zip(*held))
        if not len(anchor):
            return
        order = np.argsort(anchor, kind="stable")
        anchor, ident, t, s, c, again = (x[order] for x in (anchor, ident, t, s, c, again))
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        n = np.diff(np.append(first, len(anchor))) + np.logical_or.reduceat(again, first)
        once = np.repeat(n == 1, np.diff(np.append(first, len(anchor))))
        for at in range(0, len(anchor), 100_000):
            x = slice(at, at + 100_000)
            yield _batch(RUNS, np.where(once[x], anchor[x], _spread(t[x])), anchor[x], ident[x], t[x], _run(s[x], c[x], ~once[x]))
        told = anchor[first[n > 1]]
        yield _batch(RUNS, told, told, n[n > 1].astype(np.int64), np.zeros(len(told), np.int64), np.zeros(len(told), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: dict[int, int] = {}
        held, size = [], 0
        chunk, filled = [], 0

        def hashed() -> None:
            data = np.frombuffer(b"".join(x[3] for x in chunk), np.uint8)
            ends = np.cumsum([len(x[3]) for x in chunk])
            text, s, c, anchor, again = anchored_runs(data, ends, length, k)
            ident, t, before = (np.array([x[i] for x in chunk], np.int64)[text] for i in range(3))
            held.append((anchor, ident, t, s + before, c, again))

        for batch in batches:
            for ident, t, content in zip(*(c.to_pylist() for c in batch.columns)):
                if seen.get(t, ident + 1) <= ident or len(content) < length:
                    continue  # not the first of equal texts
                if len(seen) > 1_000_000:
                    seen.clear()
                seen[t] = ident
                for before in range(0, len(content) - length + 1, PIECE):
                    piece = content[before : before + PIECE + length - 1]
                    chunk.append((ident, t, before, piece))
                    filled += len(piece)
                    if filled >= CHUNK:
                        hashed()
                        size, chunk, filled = size + filled, [], 0
                if size >= PORTION:
                    if chunk:
                        hashed()  # a text's anchors stay together
                    yield from hand_on(held)
                    held, size, chunk, filled = [], 0, [], 0
        if chunk:
            hashed()
        if held:
            yield from hand_on(held)

    return run


FOUND = "anchor long, id long, t long, s int, c int, n long"


def _repeated(hot_from: int):
    """The runs whose anchor stands in two texts or twice in one; and, with s below 0, anchors of very many."""
    return lambda batches: _repeated_runs(batches, hot_from)


def _repeated_runs(batches: Iterator[pa.RecordBatch], hot_from: int) -> Iterator[pa.RecordBatch]:
    carried = [np.empty(0, np.int64) for _ in range(4)]

    def unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (run >> WINDOWS) - 1, run & ((1 << KNOWN) - 1)

    def judged(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, ident, t, run = columns
        if not len(anchor):
            return
        s, c = unpacked(run)
        n = np.where(s < 0, ident, 1)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        total = np.add.reduceat(n, first)
        wanted = (np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first)) | np.logical_or.reduceat(n > 1, first)
        rows = np.repeat(wanted, np.diff(np.append(first, len(anchor)))) & (s >= 0)
        yield _batch(FOUND, *(x[rows] for x in (anchor, ident, t, s, c)), np.zeros(int(rows.sum()), np.int64))
        hot = first[wanted & (total >= hot_from)]
        none = np.zeros(len(hot), np.int64)
        yield _batch(FOUND, anchor[hot], none, none, none - 1, none, total[wanted & (total >= hot_from)])

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns[1:]]
        known = columns[3] & (1 << KNOWN) > 0
        if known.any():
            anchor, ident, t, run = (x[known] for x in columns)
            yield _batch(FOUND, anchor, ident, t, *unpacked(run), np.zeros(len(run), np.int64))
        columns = [np.concatenate([a, x[~known]]) for a, x in zip(carried, columns)]
        ends = np.searchsorted(columns[0], columns[0][-1]) if len(columns[0]) else 0  # the last anchor may go on
        yield from judged([x[:ends] for x in columns])
        carried = [x[ends:] for x in columns]
    yield from judged(carried)


PIECES = "anchor long, id long, t long, s long, e long, piece binary"


def _stretches(schema: str, owners: list[tuple[int, int]], owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    owner, begin, end = merged(owner, begin, end)
    ident, t = (np.array([o[i] for o in owners], np.int64)[owner] for i in range(2))
    if schema == SPANS:
        return _batch(SPANS, ident, t, begin, end)
    return _batch(PIECES, _spread(t), ident, t, begin, end, pa.nulls(len(owner), pa.binary()))


class Fold:
    """Equal contents with the first of their places; the other places are removed."""

    def __init__(self):
        self.first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        self.owners: dict[tuple[int, int], int] = {}
        self.lost: tuple[list[int], list[int], list[int]] = ([], [], [])
        self.bytes = 0

    def add(self, anchor: int, place: tuple[int, int, int], content: bytes) -> None:
        key = (anchor, content)
        other = self.first.setdefault(key, place)
        if other is place:
            self.bytes += len(content) + 250
            return
        if place == other:
            return
        if place < other:
            self.first[key], place = place, other
        self.lose(place, len(content))

    def lose(self, place: tuple[int, int, int], n: int) -> None:
        owner, begin, end = self.lost
        owner.append(self.owners.setdefault(place[:2], len(self.owners)))
        begin.append(place[2])
        end.append(place[2] + n)

    def forget(self) -> None:
        self.owners, self.lost = {}, ([], [], [])

    def stretches(self, schema: str) -> pa.RecordBatch:
        return _stretches(schema, list(self.owners), *(np.array(x, np.int64) for x in self.lost))


def _pieces_of(length: int, hot: frozenset[int]):
    """The pieces of the wanted runs, equal ones folded; and stretches that are known to be repeats, without a piece."""

    def hand_on(fold: Fold) -> Iterator[pa.RecordBatch]:
        windows, some = Fold(), []
        for (anchor, content), place in fold.first.items():
            if anchor in hot:
                for at in range(len(content) - length + 1):
                    window = content[at : at + length]
                    windows.add(xxhash.xxh64_intdigest(window) - (1 << 63), (place[0], place[1], place[2] + at), window)
            else:
                some.append((anchor, *place, 0, content))
        for (anchor, content), place in windows.first.items():
            some.append((anchor, *place, 0, content))
        for at in range(0, len(some), 20_000):
            yield _batch(PIECES, *zip(*some[at : at + 20_000]))
        for f in (fold, windows):
            yield f.stretches(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        fold = Fold()
        for batch in batches:
            batch = batch.select(["id", "t", "content", "runs"])
            for i in range(batch.num_rows):
                ident, t, content = (batch.column(c)[i].as_py() for c in range(3))
                runs = batch.column(3)[i].values
                for anchor, s, c in zip(*(runs.field(f).to_pylist() for f in range(3))):
                    fold.add(anchor, (ident, t, s), content[s : s + c + length - 1])
                if fold.bytes > FOLDED:
                    yield from hand_on(fold)
                    fold = Fold()
        yield from hand_on(fold)

    return run


SPANS = "id long, t long, b long, e long"


def repeats_of(pieces: list[bytes], places: list[tuple[int, int, int]], length: int) -> pa.RecordBatch | None:
    """Stretches of windows that also start earlier, by the order of the pieces' suffixes."""
    collection = Collection(pieces)
    piece, size, shared = map(np.concatenate, zip(*collection.chunks()))
    collection.close()
    like_above = shared >= length
    some = like_above | np.append(like_above[1:], False)
    if not some.any():
        return None
    piece, size, like_above = piece[some], size[some], like_above[some]
    owners = sorted({p[:2] for p in places})
    number = {o: i for i, o in enumerate(owners)}
    owner = np.array([number[p[:2]] for p in places])[piece]
    begin = np.array([p[2] for p in places])[piece] + np.array([len(p) for p in pieces])[piece] - size
    first = np.flatnonzero(~like_above)
    order = np.lexsort((begin, owner))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    least = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(place))))
    later = place > least
    return _stretches(SPANS, owners, owner[later], begin[later], begin[later] + length)


def windows_met_twice(pieces: list[bytes], length: int) -> list[tuple[int, int]]:
    """The first window of each piece whose hash stands elsewhere in these pieces too, and what is behind the last; the other windows
    can't be repeats and need no order."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    n = sizes - length + 1
    first = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(ends - sizes, n) + number
    _, which, times = np.unique(gram_hashes(np.frombuffer(b"".join(pieces), np.uint8), length)[at], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    low = np.minimum.reduceat(np.where(twice, number, np.iinfo(np.int64).max), first)
    high = np.maximum.reduceat(np.where(twice, number + 1, 0), first)
    return list(zip(np.minimum(low, high).tolist(), high.tolist()))


def _order_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, fold, size = None, Fold(), 0
        waiting: list[tuple[bytes, tuple[int, int, int]]] = []  # equal windows have one anchor, and an anchor's pieces stay together
        starts: list[int] = []

        def ordered() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, starts, size
            if fold.lost[0]:
                yield fold.stretches(SPANS)
                fold.forget()
            groups = []
            if waiting:
                spans = windows_met_twice([w[0] for w in waiting], length)
                for a, b in zip(starts, [*starts[1:], len(waiting)]):
                    group = [(content[low : high + length - 1], (ident, t, s + low)) for (content, (ident, t, s)), (low, high) in zip(waiting[a:b], spans[a:b]) if high]
                    if group:
                        groups.append(group)
            waiting, starts, size = [], [], 0
            groups.sort(key=lambda g: max(len(content) for content, _ in g))  # texts of a collection are about as long
            held: list = []
            for group in groups:
                held += group
                if len(held) > COLLECTED:
                    yield from found(held)
                    held = []
            yield from found(held)

        def found(held: list) -> Iterator[pa.RecordBatch]:
            if held and (spans := repeats_of(*map(list, zip(*held)), length)) is not None:
                yield spans

        def group_ends() -> Iterator[pa.RecordBatch]:
            nonlocal size
            starts.append(len(waiting))
            for (_, content), place in fold.first.items():
                waiting.append((content, place))
                size += len(content)
            fold.first = {}
            if size > WAITING:
                yield from ordered()

        for batch in batches:
            known = batch.filter(pc.is_null(batch.column(5)))
            if known.num_rows:
                yield _batch(SPANS, *(known.column(i).to_numpy() for i in (1, 2, 3, 4)))
            batch = batch.filter(pc.is_valid(batch.column(5)))
            for anchor, ident, t, s, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != now:
                    yield from group_ends()
                    now = anchor
                fold.add(0, (ident, t, s), piece)
        yield from group_ends()
        yield from ordered()

    return run


KEPT = "doc_id long, t long, first boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc_id, t, content, first = (batch.column(c)[i].as_py() for c in range(4))
                n = len(content)
                if first:
                    spans = batch.column(4)[i].values
                    b, e = (spans.field(f).to_numpy() for f in range(2)) if spans is not None else (np.empty(0, np.int64),) * 2
                    _, b, e = merged(np.zeros(len(b), np.int64), b, e)
                else:
                    b, e = (np.array([0]), np.array([n])) if n >= length else (np.empty(0, np.int64),) * 2
                digest, at = hashlib.sha256(), 0
                for x, y in zip(b.tolist(), e.tolist()):
                    digest.update(memoryview(content)[at:x])
                    at = y
                digest.update(memoryview(content)[at:])
                rows.append((doc_id, t, first, n, int((e - b).sum()), len(b), digest.hexdigest()))
            if rows:
                names = [f.split()[0] for f in KEPT.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot_from: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sha = F.sha2("content", 256)
    t = F.coalesce(F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"), F.lit(0))  # never null: both joins take the texts by one shuffle
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content.alias("content")).withColumn("sha", sha)
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NONE)).alias("id"), t.alias("t"), "content", "sha")
    texts = rows.select("doc_id", "id", "t", "content")
    firsts = rows.groupBy("sha").agg(F.min("id").alias("id")).select("id", t.alias("t"))
    runs = texts.select("id", "t", "content").mapInArrow(_anchors_of(length, k), RUNS)
    found = cut(runs.repartition("route").sortWithinPartitions("route", "anchor").mapInArrow(_repeated(hot_from), FOUND))
    hot = frozenset(r[0] for r in found.where("s < 0").orderBy(F.desc("n")).limit(MOST_HOT).select("anchor").collect())  # a bounded list of anchors
    let_go(docs.sparkSession)  # all runs lie in the files of that shuffle, more than the texts themselves
    wanted = found.where("s >= 0").join(firsts, ["id", "t"], "left_semi").groupBy("id", "t").agg(F.collect_list(F.struct("anchor", "s", "c")).alias("runs"))
    pieces = texts.join(wanted, ["id", "t"]).select("doc_id", "id", "t", "content", "runs").mapInArrow(_pieces_of(length, hot), PIECES)
    spans = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_order_pieces(length), SPANS)
    spans = spans.groupBy("id", "t").agg(F.collect_list(F.struct("b", "e")).alias("spans"))
    told = firsts.join(spans, ["id", "t"], "left").withColumn("first", F.lit(True))
    kept = texts.join(told, ["id", "t"], "left").select("doc_id", "t", "content", F.coalesce("first", F.lit(False)).alias("first"), "spans").mapInArrow(_removed(length), KEPT)
    # of rows that repeat id and text one is the first
    n = kept.groupBy(*[f.split()[0] for f in KEPT.split(", ")]).count().withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
    whole = F.col("first") & (F.col("row") > 1) & (F.col("n_bytes") >= length)
    return n.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(whole, EMPTY).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
