"""Quality rules as a bitmask ledger, with DataFrame expressions only.

``ledger`` measures every document and evaluates every rule once, keeping the failed rules as bits of one
long beside the measurements. Policies are named, versioned masks over those bits: applying one, or asking
what a rule costs, never looks at a text again.

Defined results: a null text is an empty text, it has no words and fails ``few_words``; repeated rows and
null ids give one ledger row each; an empty table gives an empty ledger; other columns are not read.
A text's windows are compared by 64-bit hashes within that text only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import read_table

BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

#: Name and failing condition over the measurements; a rule's bit is its place here. Append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
)

#: Policy and version: the rules that it enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base.v1": ("few_words", "repeated_windows"),
    "prose.v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "prose.v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "shouting"),
}
CURRENT = "prose.v2"


def rule_bit(name: str, rules: Sequence[tuple[str, str]] = RULES) -> int:
    return 1 << [r for r, _ in rules].index(name)


def policy_mask(names: Sequence[str], rules: Sequence[tuple[str, str]] = RULES) -> int:
    return sum(rule_bit(n, rules) for n in set(names))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id and the measurements of each row. Work on a text stays within its row: nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    trimmed = F.btrim("t", F.lit(BLANK_CHARS))
    none = F.array().cast("array<string>")
    d = d.select(
        "doc_id",
        F.when(trimmed == "", none).otherwise(F.split(trimmed, BLANK)).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "").alias("lines"),
        F.length(F.regexp_replace("t", BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    d = d.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0))"
        ).alias("windows"),
    ).drop("words", "lines")
    # Windows side by side after a sort are repeats; only texts that have any are sorted.
    repeats = F.expr("size(array_distinct(windows)) < size(windows)")
    by_hash = F.when(repeats, F.expr("array_sort(transform(windows, (h, i) -> struct(h, i)))"))
    d = d.select("*", by_hash.alias("s")).drop("windows")
    places = F.expr("array_sort(transform(filter(s, (x, k) -> coalesce(x.h = get(s, k - 1).h, false) OR coalesce(x.h = get(s, k + 1).h, false)), x -> x.i))")
    d = d.select("*", places.alias("p")).drop("s")
    covered = F.expr("aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, x) -> a + x)")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The measurements and ``failure_bits``: bit i is set if rule i fails."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).select("*", bits.alias("failure_bits"))


def apply_policy(rows: DataFrame, mask: int, column: str = "kept") -> DataFrame:
    """A boolean column: no rule of the mask fails."""
    return rows.withColumn(column, F.col("failure_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """policy, rule, n_docs, n_kept, n_failing (of this rule), n_only (failing this rule of the policy alone:
    what leaving it out would bring back). One pass of bitwise aggregation: at most 2^rules counts are made
    before the policies are looked at."""
    counts = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(policy_mask(names, rules)).cast("long").alias("mask"), F.lit(rule_bit(r, rules)).cast("long").alias("bit")) for p, names in policies.items() for r in names])
    each = counts.select("failure_bits", "n", F.explode(cases).alias("c")).select("failure_bits", "n", "c.*")
    enforced = F.col("failure_bits").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(enforced == 0).alias("n_kept"),
        total(F.col("failure_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        total(enforced == F.col("bit")).alias("n_only"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read_table(spark, sf_dir, "documents")), policy_mask(POLICIES[CURRENT]), "passed")
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("passed")).alias("kept"), "failure_bits", "n_lines", "n_upper")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END
     + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS failure_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failure_bits = 0 AS kept, failure_bits, n_lines, n_upper FROM b
"""
