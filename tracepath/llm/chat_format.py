"""Chat records of many layouts, formatted as one template.

A record is JSON. The paths of its fields, sorted and hashed, are its fingerprint, and the fingerprint selects a
declared mapping to canonical turns (role, text). Fields that no mapping reads are left out of the fingerprint, so a record
may have more of them; what stands within a field that is read as a text is not left out. Turns are written as

    ### role: text</turn>

with a line's end after each; within role and text every ``\\``, ``#`` and ``<`` (in a role ``:`` too) has a ``\\`` before
it, so no control string can stand inside a text, and dropping those brings the text back. The loss mask covers the
texts of assistant turns.

Rows of a conversation are formatted apart from each other; only their order and offsets need the conversation, which
is streamed in order and never held: a conversation may be of any length.

Defined results: null text and null role are empty; turns of equal number are ordered by their formatted segment; null
turn numbers come first; repeated rows count each; records of an unknown layout, or that are null or no JSON, become no
turns and are counted by ``layout_counts``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import read_table

PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def field_paths(value, path: str = "") -> set[str]:
    """Paths of the leaves; a list is one step ``[]``, an empty object or list is a leaf. Dots, brackets and backslashes of a
    name have a backslash before them."""
    if isinstance(value, dict) and value:
        names = {k: re.sub(r"[.\[\\]", r"\\\g<0>", k) for k in value}
        return set().union(*(field_paths(v, f"{path}.{names[k]}" if path else names[k]) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{path}[]") for v in value)) if value else {f"{path}[]"}
    return {path}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256(json.dumps(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """From a layout's fields to turns. Either ``items`` names a list whose members have ``role`` and ``text``, or the
    record itself has them (items empty), or ``fixed`` gives for each role the fields whose non-empty texts are joined."""

    name: str
    paths: frozenset[str]
    items: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    role_names: dict = field(default_factory=dict, hash=False)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.fixed:
            return [(role, "\n\n".join(t for f in fields if (t := as_text(record.get(f))))) for role, fields in self.fixed if role != "system" or any(record.get(f) for f in fields)]
        members = record.get(self.items) if self.items else [record]
        return [(self.role_names.get(r := as_text(m.get(self.role)), r), as_text(m.get(self.text))) for m in members or []]


def as_text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


SHARED_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn row", frozenset({"role", "text"}), role="role", text="text"),
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), "messages", "role", "content"),
    Mapping("no messages", frozenset({"messages[]"}), "messages", "role", "content"),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), "conversations", "from", "value", role_names=SHARED_NAMES),
    Mapping("no conversations", frozenset({"conversations[]"}), "conversations", "from", "value"),
    Mapping("prompt", frozenset({"prompt", "response"}), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt, completion", frozenset({"prompt", "completion"}), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system prompt", frozenset({"system", "prompt", "response"}), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", frozenset({"instruction", "output"}), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction, input", frozenset({"instruction", "input", "output"}), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def escape(s: str, more: str = "") -> str:
    return re.sub(rf"[\\#<{more}]", r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The segment, and where in it the text is."""
    head, body = f"### {escape(role, ':')}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything that isn't one is an error."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Layouts(dict):
    """Mappings by fingerprint."""

    def __init__(self, items):
        super().__init__(items)
        self.paths = frozenset().union(*(m.paths for m in self.values()))
        self.within = tuple(p + x for p in self.paths if not p.endswith("[]") for x in ".[")

    def read(self, paths: set[str]) -> set[str]:
        """The paths that any mapping reads, and those within them."""
        return {p for p in paths if p in self.paths or p.startswith(self.within)}


def convert(record: str | None, mappings: Layouts) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout's name, or None for an unknown one, and the turns."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    m = mappings.get(fingerprint(mappings.read(field_paths(value)))) if isinstance(value, dict) else None
    return (m.name, m.turns(value)) if m else (None, [])


def by_fingerprint(mappings: tuple[Mapping, ...]) -> Layouts:
    return Layouts((fingerprint(set(m.paths)), m) for m in mappings)


SEGMENTS = "conv_id long, turn long, place int, layout string, segment string, loss_start int, loss_end int"


def format_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """From conv_id, turn, record to a formatted segment for each canonical turn, in no order. ``place`` is the turn's
    place in its record; a record without turns gives one row whose segment is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = by_fingerprint(mappings)
        names = ["conv_id", "turn", "place", "layout", "segment", "loss_start", "loss_end"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = []
            for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns)):
                layout, turns = convert(record, known)
                for place, (role, text) in enumerate(turns):
                    segment, a, b = write_turn(role, text)
                    rows.append((conv, turn, place, layout, segment, *((a, b) if role == "assistant" else (None, None))))
                if not turns:
                    rows.append((conv, turn, None, layout, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return records.selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "record").mapInArrow(run, SEGMENTS)


def layout_counts(segments: DataFrame) -> DataFrame:
    """layout (null: unknown), n: what the records were."""
    return segments.where("coalesce(place, 0) = 0").groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


def in_order(segments: DataFrame) -> DataFrame:
    """Each conversation in one partition, its segments side by side and in order."""
    return segments.where("segment IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "segment")


def place_segments(ordered: DataFrame) -> DataFrame:
    """Adds ``start``, the segment's offset in its conversation, and makes the loss span's ends offsets there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = (), 0
        for batch in batches:
            starts, a, b = [], [], []
            for conv, segment, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6))):
                if (conv,) != last:
                    last, at = (conv,), 0
                starts.append(at)
                a.append(None if x is None else at + x)
                b.append(None if y is None else at + y)
                at += len(segment)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x, pa.int64()) for x in (starts, a, b))], ["conv_id", "turn", "place", "layout", "segment", "start", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, "conv_id long, turn long, place int, layout string, segment string, start long, loss_start long, loss_end long")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(placed: DataFrame) -> DataFrame:
    """Reads the output of ``place_segments`` back, in its order, and digests each conversation as it streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        last, state, done = (), None, []

        def close() -> None:
            if state:
                done.append((last[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, segment, start, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7))):
                if (conv,) != last:
                    close()
                    last, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    text = unescape(segment[a - start : b - start])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] = start + len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)

    return placed.mapInArrow(run, DIGESTS)


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as records of the layout "turn row"."""
    return conversations.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = json.dumps({"messages": [{"role": r, "content": PROBE_TEXT} for r in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(probe).alias("record"))
    records = turn_records(read_table(spark, sf_dir, "conversations")).union(extra)
    return read_back(place_segments(in_order(format_turns(records))))
