"""Secrets in texts, and multipart credentials, with DataFrame expressions only.

Patterns with a meaning of their own (an assignment to a secret's name, an access identifier, a long hexadecimal
run) are reported wherever they stand. A bare run of letters and digits is a weak candidate, which alone means nothing: it
is reported, as kind ``weak``, only if a complementary part stands within ``SCOPE`` code points of it and outside it: an
access identifier, a client's or user's name that is assigned, or an endpoint. An endpoint is reported, as kind
``endpoint``, if something that unlocks it is within that scope: an assigned secret, an access identifier or a weak
candidate that was confirmed. Parts meet by an interval join: an equi-join on scopes of that width, each part also
standing in the scopes beside its own, with the distance checked after it. Parts of one kind don't overlap, so a scope
holds a bounded number of them, whatever the length of its text.

Texts don't leave the scan: a row with matches sends the lengths of its matches and of the stretches between them, and
sums over those give the places. Only redaction moves texts, and of them only those that may have a span.

Defined results: a null text is an empty text without spans; a text of any length is scanned as one row; rows that repeat doc_id and text give a row each with
the same spans; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracepath.llm.common import cut, read_table

#: Kinds in their order, each with its pattern, the group that is measured and that group's least length.
PATTERNS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("weak", r"[A-Za-z0-9+/_]{20,}", 0, 20),
    ("endpoint", r"""https?://[A-Za-z0-9][^\x00-\x20"'<>]*""", 0, 8),
    ("name", r"""([Cc][Ll][Ii][Ee][Nn][Tt]|[Uu][Ss][Ee][Rr]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])_?([Ii][Dd]|[Nn][Aa][Mm][Ee])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 3, 3),
)
BASE = ("assign", "access", "hex")
KINDS = [k for k, *_ in PATTERNS]
SCOPE = 240
REDACTED = "[secret]"


def _matches(kind: str, pattern: str, group: int, least: int) -> Column:
    """For each match, in order: kind, place in order, code points before it since the last, its length, and whether it counts."""
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    between = F.split("t", pattern, -1)
    measured = F.regexp_extract_all("t", F.lit(pattern), F.lit(group)) if group else found

    def row(x: Column, i: Column) -> Column:
        long_enough = F.length(x.m if group else x.f) >= least
        telling = x.f.rlike("[0-9]") & x.f.rlike("[A-Za-z]") if kind == "weak" else F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x.b).alias("before"), F.length(x.f).alias("chars"), (long_enough & telling).alias("counts"))

    parts = [found.alias("f"), between.alias("b"), *([measured.alias("m")] if group else [])]
    zipped = F.filter(F.arrays_zip(*parts), lambda x: x.f.isNotNull())
    return F.when(F.col("t").rlike(pattern), F.transform(zipped, row)).otherwise(F.array().cast("array<struct<kind:string,i:int,before:int,chars:int,counts:boolean>>"))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (a hash of the text), row, kind, start, end of every part, those that mean nothing alone as well."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("*", F.xxhash64("t").alias("h"))
    rows = rows.select("row", "doc_id", "h", F.explode(F.concat(*[_matches(*p) for p in PATTERNS])).alias("x")).select("row", "doc_id", "h", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before").cast("long") + F.col("chars")).over(so_far)
    rows = rows.withColumn("end", end).where("counts")
    return rows.select("row", "doc_id", "h", "kind", (F.col("end") - F.col("chars")).alias("start"), "end")


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Rows of left with a row of right in the same text that is beside it, with a gap of at most scope code points."""
    bucket = F.floor(F.col("start") / scope)
    r = right.select(F.col("row").alias("r_row"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("r_bucket"))
    l = left.withColumn("bucket", F.explode(F.sequence(bucket, F.floor(F.col("end") / scope))))
    close = F.greatest(F.col("r_start") - F.col("end"), F.col("start") - F.col("r_end")).between(0, scope)
    return l.join(r, (F.col("row") == F.col("r_row")) & (F.col("bucket") == F.col("r_bucket")) & close, "left_semi").drop("bucket").distinct()


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans to report: those of BASE, and weak candidates (outside of those) and endpoints whose complement is at hand."""
    base = parts.where(F.col("kind").isin(*BASE))
    weak = _near(parts.where("kind = 'weak'"), parts.where("kind IN ('access', 'name', 'endpoint')"), scope)
    spoken = base.select(F.col("row").alias("b_row"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("b_bucket"))
    weak = weak.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    inside = (F.col("row") == F.col("b_row")) & (F.col("bucket") == F.col("b_bucket")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    covered = weak.join(spoken, inside, "left_semi").select("row", "start").distinct()
    weak = weak.drop("bucket").distinct().join(covered, ["row", "start"], "left_anti").select(parts.columns)
    endpoints = _near(parts.where("kind = 'endpoint'"), weak.union(base.where("kind IN ('assign', 'access')")), scope)
    return base.union(weak).union(endpoints.select(parts.columns))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, h, spans: sorted structs of start, the kind's number and end, for the texts that have any."""
    spans = link_parts(cut(find_parts(docs, id_col, text_col)), scope)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    each = F.struct("start", number.alias("kind"), "end")
    # Repeats of a row have the same spans; one of them is enough.
    lists = spans.groupBy("row", "doc_id", "h").agg(F.array_sort(F.collect_list(each)).alias("spans"))
    return lists.groupBy("doc_id", "h").agg(F.first("spans").alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.kind.cast("int")), x.start, x.end)), ",")


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = spans.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    here = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(found, docs[id_col].eqNullSafe(F.col("_doc")) & (here == F.col("_h")), "left")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    spans = secret_spans(docs, id_col, text_col, scope)
    base = F.filter("spans", lambda x: x.kind <= len(BASE))
    counts = [F.expr(f"size(filter(spans, x -> x.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(BASE, 1)]
    told = spans.select("doc_id", "h", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("listed"))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    d, s = keys.alias("d"), told.alias("s")
    found = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.h") == F.col("s.h")), "left")
    return found.select("d.doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("listed", F.lit("")).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mark: str = REDACTED) -> DataFrame:
    """docs with every reported span of the text replaced by a mark; all rows and columns stay."""
    may = F.lit(False)  # in these kinds every reported span has its start, but for endpoints, which need one of them
    for kind, pattern, _, _ in PATTERNS:
        if kind in (*BASE, "weak"):
            may = may | F.coalesce(F.col(text_col).rlike(pattern), F.lit(False))
    some, columns = docs.where(may), docs.columns
    found = _with_spans(some, secret_spans(some, id_col, text_col, scope), id_col, text_col)
    t = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        add = F.concat(F.substring(t, (acc.at + 1).cast("int"), F.greatest(x.start - acc.at, F.lit(0)).cast("int")), F.when(x.start >= acc.at, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc.at, x.end).alias("at"), F.concat(acc.out, add).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("_spans", start, step, lambda acc: F.concat(acc.out, F.substring(t, (acc.at + 1).cast("int"), F.length(t))))
    return found.withColumn(text_col, F.when(F.col("_spans").isNull(), t).otherwise(whole)).select(columns).union(docs.where(~may))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


_SPLIT = """
  SELECT rid, '{kind}' AS kind, {k} AS k, s AS start, s + length(f) AS stop FROM (
    SELECT rid, unnest(list_transform(range(1, len(f) + 1), lambda i: list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s,
      unnest(f) AS f, unnest(m) AS m
    FROM (SELECT rid, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', 0) AS f, regexp_extract_all(t, '{p}', {group}) AS m FROM d WHERE regexp_matches(t, '{p}')))
  WHERE length(m) >= {least}"""

#: The definition once more, by itself: all pairs of parts of a text, without scopes.
OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED (
{_SPLIT.format(kind="assign", k=0, group=2, least=12, p='((?i:password|passwd|secret|token|api_?key))["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)')} UNION ALL
{_SPLIT.format(kind="access", k=1, group=0, least=18, p="AKIA[A-Z0-9]+")} UNION ALL
{_SPLIT.format(kind="hex", k=2, group=0, least=16, p="[0-9a-f]+")} UNION ALL
{_SPLIT.format(kind="weak", k=3, group=0, least=20, p="[A-Za-z0-9+/_]+")} AND regexp_matches(f, '[0-9]') AND regexp_matches(f, '[A-Za-z]') UNION ALL
{_SPLIT.format(kind="endpoint", k=4, group=0, least=8, p='https?://[A-Za-z0-9][^\\x00-\\x20"\'\'<>]*')} UNION ALL
{_SPLIT.format(kind="name", k=5, group=2, least=3, p='(?i:client|user|account)_?(?i:id|name)(["\'\']?\\x20*[:=]\\x20*["\'\']?)([A-Za-z0-9_.@-]+)')}),
base AS (SELECT * FROM p WHERE k < 3),
weak AS MATERIALIZED (
  SELECT * FROM p a WHERE kind = 'weak' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = a.rid AND a.start < b.stop AND b.start < a.stop)
    AND EXISTS (SELECT 1 FROM p b WHERE b.rid = a.rid AND b.kind IN ('access', 'name', 'endpoint') AND greatest(b.start - a.stop, a.start - b.stop) BETWEEN 0 AND 240)),
strong AS (SELECT * FROM weak UNION ALL SELECT * FROM base WHERE kind <> 'hex'),
s AS (SELECT * FROM base UNION ALL SELECT * FROM weak UNION ALL
  SELECT * FROM p a WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM strong b WHERE b.rid = a.rid AND greatest(b.start - a.stop, a.start - b.stop) BETWEEN 0 AND 240)),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
