"""Source maps, version 3, as tables: segments, with what follows each, and the lines of embedded sources."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The digits of base 64 numbers.
DIGITS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}
SEGMENTS = "map_name string, gen_line long, gen_column long, seq long, source_id long, source string, line long, column long, last_line long"
LINES = "map_name string, source_id long, line long, text string"
U32 = 1 << 32


def numbers(field: str) -> list[int]:
    """The signed numbers of a field: five bits a digit, least first, a sixth for more, the sign in the lowest bit."""
    out, value, shift = [], 0, 0
    for c in field:
        digit = DIGITS.get(c)
        if digit is None or shift > 60:
            break
        value |= (digit & 31) << shift
        shift += 5
        if not digit & 32:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return out


def parts(node, line: int = 0, column: int = 0) -> Iterator[tuple[dict, int, int]]:
    """The maps of a map, each with its offset; an index map has sections."""
    if isinstance(node.get("sections"), list):
        for s in node["sections"]:
            yield from parts(s["map"], line + int(s["offset"]["line"]), column + int(s["offset"]["column"]))
    else:
        yield node, line, column


def parse_map(text: str) -> tuple[list[tuple], list[tuple]] | None:
    """Segments (gen_line, gen_column, source_id, source, line, column) in order, and lines (source_id, line, text); lines and
    columns count from 0. None if this isn't a map."""
    try:
        segments, lines, base = [], [], 0
        for node, first_line, first_column in parts(json.loads(text)):
            root, named = node.get("sourceRoot") or "", [s if isinstance(s, str) else "" for s in node["sources"]]
            sources = [f"{root.removesuffix('/')}/{s}" if root else s for s in named]
            for i, content in enumerate((node.get("sourcesContent") or [])[: len(sources)]):
                if isinstance(content, str):
                    lines += [(base + i, k, x.rstrip("\r")) for k, x in enumerate(content.split("\n"))]
            at = [0, 0, 0]
            for k, group in enumerate(node["mappings"].split(";")):
                column = first_column if k == 0 else 0
                for field in group.split(","):
                    if not (v := numbers(field)):
                        continue
                    column += v[0]
                    if len(v) >= 4:
                        at = [a + d for a, d in zip(at, v[1:4])]
                        if all(0 <= x < U32 for x in (column, *at)) and at[0] < len(sources):
                            segments.append((first_line + k, column, base + at[0], sources[at[0]], at[1], at[2]))
            base += len(sources)
        return sorted(segments, key=lambda s: s[:2]), lines
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def spans(segments: list[tuple]) -> Iterator[tuple]:
    """Each segment with the last original line that it can stand for: up to the line before the next segment, on this or the
    adjoining generated line, if that goes on in the same source."""
    for i, s in enumerate(segments):
        n = segments[i + 1] if i + 1 < len(segments) else None
        goes_on = n is not None and n[0] - s[0] <= 1 and n[2] == s[2] and n[4] > s[4]
        yield (*s, n[4] - 1 if goes_on else s[4])


def read_maps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "([^/]*)$", 1).alias("map_name"), F.col("value").alias("text"))
    return parse_maps(texts)


def parse_maps(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From map_name, text to segments and lines."""

    def of_segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, text in zip(f["map_name"], f["text"]):
                if found := parse_map(text or ""):
                    rows = [(name, s[0], s[1], k, *s[2:]) for k, s in enumerate(spans(found[0]))]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    def of_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, text in zip(f["map_name"], f["text"]):
                if found := parse_map(text or ""):
                    yield pd.DataFrame([(name, *x) for x in found[1]], columns=[c.split()[0] for c in LINES.split(", ")])

    texts = texts.select("map_name", "text")
    return texts.mapInPandas(of_segments, SEGMENTS), texts.mapInPandas(of_lines, LINES)
