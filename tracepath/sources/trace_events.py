"""Recordings in the Trace Event Format: one file a recording, parsed where it is read.

Every event becomes a row with typed fields; what a field of the wrong type means is settled here, so that the rest is
DataFrame work. A file that is no recording gives a single row with a ``problem``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.functions.columns import ORIGIN
from tracepath.sources.vocabulary import BY_NAME, Vocabulary

RAW = (
    "trace_id string, pos long, problem string, ph string, name string, cat string, pid long, tid long, ts long, dur long, whole_dur long, "
    "ident string, scope string, binds string, fields array<struct<path:string,value:string>>, "
    "presents boolean, stimulus boolean, kind string, interaction long, phases struct<input_delay:long,processing:long,presentation_delay:long,latency:long>, origins array<string>"
)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_ORIGIN = re.compile(ORIGIN)


def as_micros(value) -> int | None:
    """Numbers only: whole ones as they are, others cut toward zero and held in range."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(value, float):
        value = 0 if math.isnan(value) else HIGH if value >= HIGH else LOW if value <= LOW else int(value)
    return value if LOW <= value <= HIGH else (HIGH if value > 0 else LOW)


def render(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def leaves(args) -> list[tuple[str, str]]:
    """Dotted paths of an argument tree's leaves, fields in alphabetical order; a list is one leaf."""
    out, todo = [], [(k, v) for k, v in sorted(args.items(), reverse=True)] if isinstance(args, dict) else []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}", v) for k, v in sorted(value.items(), reverse=True)]
        else:
            out.append((path, render(value)))
    return out


def named_origins(args, depth: int = 0) -> list[str]:
    """The first origin in each text of an argument tree, three levels down at most, lists left out."""
    if depth > 3:
        return []
    if isinstance(args, str):
        m = _ORIGIN.search(args)
        return [m[1]] if m else []
    return [o for v in args.values() for o in named_origins(v, depth + 1)] if isinstance(args, dict) else []


def identity(event: dict) -> str | None:
    value = event.get("id", event.get("id2"))
    if isinstance(value, dict):
        return render(value[min(value)]) if value else None
    return value if isinstance(value, str) else render(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def phases_of(data: dict, stated: tuple[str, ...]) -> tuple[int, int, int, int] | None:
    """Milliseconds of the producer's own clock as differences in microseconds; all four must be stated."""
    v = [data.get(k) for k in stated[1:]]
    if not v or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in v):
        return None
    began, start, end, latency = v

    def micros(ms: float) -> int:
        x = ms * 1000
        return max(0, min(HIGH, int(math.copysign(math.floor(abs(x) + 0.5), x)))) if math.isfinite(x) else 0

    return micros(start - began), micros(end - start), micros(latency - (end - began)), micros(latency)


def parse(trace_id: str, text: str, vocabulary: Vocabulary) -> list[dict]:
    try:
        value = json.loads(text)
    except ValueError as e:
        return [{"trace_id": trace_id, "problem": f"not JSON: {e}"}]
    events = value.get("traceEvents") if isinstance(value, dict) else value
    if not isinstance(events, list):
        return [{"trace_id": trace_id, "problem": "no event array"}]
    return [row(trace_id, i, e if isinstance(e, dict) else {}, vocabulary) for i, e in enumerate(events)]


def row(trace_id: str, pos: int, e: dict, v: Vocabulary) -> dict:
    def text(k: str) -> str:
        return e[k] if isinstance(e.get(k), str) else ""

    pid, tid, name = as_micros(e.get("pid")), as_micros(e.get("tid")), text("name")
    ph = e["ph"] if isinstance(e.get("ph"), str) else None
    scope = {"g": "g", "p": f"p{pid or 0}"}.get(text("s"), f"t{pid or 0}/{tid or 0}")
    binds = "enclosing" if ph in ("s", "t") or e.get("bp") == "e" else "next" if "bp" not in e else None
    args = e.get("args")
    data = args.get("data") if isinstance(args, dict) and isinstance(args.get("data"), dict) else {}
    kind = data.get(v.stimulus_kind) if isinstance(data.get(v.stimulus_kind), str) else ""
    stimulus = ph is not None and name in v.stimuli and kind in v.from_a_person
    interaction = data.get(v.stated[0]) if v.stated and stimulus else None
    dur = e.get("dur")
    return {
        "trace_id": trace_id, "pos": pos, "ph": ph, "name": name, "cat": text("cat"), "pid": pid, "tid": tid, "ts": as_micros(e.get("ts")), "dur": as_micros(dur),
        "whole_dur": max(dur, 0) if isinstance(dur, int) and not isinstance(dur, bool) else 0, "ident": identity(e), "scope": scope, "binds": binds,
        "fields": [{"path": p, "value": x} for p, x in leaves(args)], "presents": ph is not None and name in v.presentations, "stimulus": stimulus, "kind": kind,
        "interaction": interaction if isinstance(interaction, int) and not isinstance(interaction, bool) else None,
        "phases": dict(zip(("input_delay", "processing", "presentation_delay", "latency"), p)) if stimulus and v.stated and (p := phases_of(data, v.stated)) else None,
        "origins": named_origins(args) if ph is not None else [],
    }


def parse_texts(texts: DataFrame, producer: str = "chrome") -> DataFrame:
    """From trace_id, text (a whole file) to raw events."""
    vocabulary = BY_NAME[producer]
    columns = [c.split()[0] for c in re.split(r", (?=\w+ )", RAW)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for trace_id, text in zip(frame["trace_id"], frame["text"]):
                rows = parse(trace_id, text or "", vocabulary)
                for i in range(0, len(rows), 20_000):
                    out = pd.DataFrame(rows[i : i + 20_000], columns=columns, dtype=object)
                    for c in ("pos", "pid", "tid", "ts", "dur", "whole_dur", "interaction"):
                        out[c] = out[c].astype("Int64")
                    yield out.astype(object).where(out.notna(), None)

    return texts.select("trace_id", "text").mapInPandas(run, RAW)


def read_traces(spark: SparkSession, path: str, producer: str = "chrome") -> DataFrame:
    """Raw events of every file at path; a recording is named by its file's path."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("trace_id"), F.col("value").alias("text"))
    return parse_texts(texts, producer)
