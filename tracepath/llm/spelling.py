"""Grouping of spelling variants by bands of letter parities.

A word's mask has a bit for each letter, set if the letter stands an odd number of times. One inserted, deleted or replaced code
point flips at most two bits, so of three bands of the mask at least one is left as it was; and it leaves the first or the
last half of the longer word as it was. Words are joined on length, half, band and the band's bits, together; a pair is taken
at the first half and band that it shares and verified by its edit distance. Halves keep the lists of common bands short.

Defined results: a null text has no words; a null doc_id counts as an empty string; rows that repeat both count each. Very long texts
are read whole. Of equally common near words the smallest in code-point order is the form. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import cut, read_table

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, BANDS = 63, 3
BAND_MASKS = [sum(1 << bit for bit in range(band, BITS, BANDS)) for band in range(BANDS)]
SHORTEST = 7


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters, one in 31 with a letter deleted, that are long enough and occur twice or more."""
    small = F.translate(F.col(text_col), CAPITALS, SMALL)
    # shorter runs give no words, whether a letter is deleted or not
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(small, F.lit(f"[a-z\\u00C0-\\u00FF]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    deleted = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, deleted).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def parities(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n of words one edit apart, each pair once."""
    w = words.withColumns({"mask": parities(F.col("word")), "length": F.char_length("word")})

    def keyed(role: str, longer: Column) -> DataFrame:
        """A row for each half and band, by the length of the pair's longer word."""
        half = F.floor(longer / 2).cast("int")
        places = [F.struct(F.lit(side).alias("side"), F.lit(band).alias("band"), F.xxhash64(longer, F.lit(side), text, F.lit(band), F.col("mask").bitwiseAND(F.lit(m))).alias("key")) for side, text in ((0, F.left("word", half)), (1, F.right("word", half))) for band, m in enumerate(BAND_MASKS)]
        return w.select(F.inline(F.array(*places)), F.col("word").alias(f"{role}_word"), F.col("n").alias(f"{role}_n"), F.col("mask").alias(f"{role}_mask"), F.col("length").alias(f"{role}_length")).toDF("side", "band", "key", role, f"{role}_n", f"{role}_mask", f"{role}_length")

    a = keyed("a", F.col("length"))
    b = keyed("b", F.col("length")).unionByName(keyed("b", F.col("length") + 1)).drop("side", "band")
    flipped = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    half = F.floor(F.col("a_length") / 2).cast("int")
    first_half = (F.col("side") == 0) | (F.left("a", half) != F.left("b", half))
    first_band = (F.col("band") == 0) | (flipped.bitwiseAND(F.lit(BAND_MASKS[0])) != 0) & ((F.col("band") == 1) | (flipped.bitwiseAND(F.lit(BAND_MASKS[1])) != 0))
    once = (F.col("a_length") != F.col("b_length")) | (F.col("a") < F.col("b"))
    meets = (a["key"] == b["key"]) & (F.bit_count(flipped) <= 2) & once & first_band & first_half & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, meets).select("a", "b", "a_n", "b_n")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    words = cut(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = near_pairs(words).select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = F.col("n") * times <= -F.col("best.less")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = cut(found)
    # each form is at least ten times as common, so runs of forms are short and doubling ends them in a few rounds
    ends = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = cut(ends.join(ends.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ends = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(corpus_words(read_table(spark, sf_dir, "documents")))
