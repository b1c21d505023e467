"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3, within words and their borders), most
frequent first. A document's own list is compared with each profile by out-of-place distance: how far apart the ranks
of an n-gram are, or the length of a profile if the n-gram isn't in it. The nearest language wins.

Profiles are counted over all training rows: tasks add up what their rows hold, and the sums of the n-grams are
ranked by language. Only the ranked heads, ``size`` n-grams a language, come to the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was
learned; equal counts are ordered by n-gram and equal distances by language; rows with a null text or language teach
nothing; repeated rows give a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracepath.llm.common import read_table, release

SIZE = 300
LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"
_COLLECT = 500_000


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams, as numbers of 21 bits a character, and their counts."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    return np.unique(np.concatenate([a[a != 32], two, three[a[1:-1] != 32]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent first; equals by n-gram."""
    if len(grams) > 4 * size:  # what is below the last place's count needn't be sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:size]]


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> dict[str, list[int]]:
    """Each language's n-grams in order of rank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def add_up() -> None:
            for lang, parts in held.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                held[lang] = [(grams, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64))]

        def out() -> Iterator[pa.RecordBatch]:
            add_up()
            for lang, ((grams, n),) in sorted(held.items()):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                grams, n = ngrams(text.as_py())
                if len(grams):
                    held.setdefault(lang, []).append((grams, n))
                    size += len(grams)
                if size > _COLLECT:
                    add_up()
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > _COLLECT // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    head = sums.select("lang", "gram", place.alias("place")).where(F.col("place") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in head.collect():  # size rows a language
        out.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {lang: [g for _, g in sorted(x)] for lang, x in out.items()}


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = SIZE):
        self.size, self.profiles = size, []
        for lang, grams in sorted(profiles.items()):
            order = np.argsort(grams)
            self.profiles.append((lang, np.array(grams, np.int64)[order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language, and 1 less the distance as a part of the greatest possible."""
        grams, counts = ngrams(text)
        if not len(grams) or not self.profiles:
            return UNKNOWN, 0.0
        own = ranked(grams, counts, self.size)
        places, best = np.arange(len(own)), (self.size * len(own) + 1, UNKNOWN)
        for lang, known, rank in self.profiles:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            far = np.where(known[at] == own, np.abs(rank[at] - places), self.size)
            best = min(best, (int(far.sum()), lang))
        return best[1], max(0.0, 1 - best[0] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, carry: Column | None = None) -> DataFrame:
    """doc_id, carry, lang_pred, score. ``carry`` is a boolean taken along; the prediction sees the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        classify = Classifier(profiles, size)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "carry", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if carry is None else carry).alias("carry"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, carry boolean, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out, predicted for all."""
    profiles = learn(docs.where(~held_out()), size=size)
    return predict(docs, profiles, size=size, carry=held_out()).withColumnRenamed("carry", "held_out")


def drop_unknown(docs: DataFrame, size: int = SIZE, least: float = 0.05) -> DataFrame:
    """The rows of docs whose language can be told: there is a letter, and the nearest profile shares some ranks."""
    profiles = learn(docs.where(~held_out()), size=size)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        classify = Classifier(profiles, size)
        for batch in batches:
            found = (classify(t.as_py()) for t in batch.column("text"))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
