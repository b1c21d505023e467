"""A corpus made ready for training: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and works on all rows that its
predecessor kept. Stages but the last return those columns; the last returns the packed pieces.

A row is known by its text and doc_id together. Ids may be null, which come after all others when one row is chosen, and
may stand on several rows: each text with an id is judged by itself. Of rows that repeat text and id, the dedup stages
keep the one whose lang, source and n_chars come first; the other stages treat each row alike. Nulls may stand in any column;
a null text is an empty text. Texts may be of any length and are read whole. A stage of an empty table is an empty
table. Columns beyond those of ``documents`` are left behind by the first stage, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.best_fit_pack import pack, token_pieces
from tracepath.llm.common import cut, let_go, use_checkpoint_dir
from tracepath.llm.exact_dedup import content_classes
from tracepath.llm.language_id import drop_unknown
from tracepath.llm.near_copies import content_key, first_copies
from tracepath.llm.secret_scan import redact_secrets

#: Documents whose score of language identification (0 to 1) is below this have too little in common with any language.
REJECT_BELOW = 0.05
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express language profiles, chains of near copies or the tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those with a null text or without a letter, and those whose nearest profile
    scores below ``REJECT_BELOW``. If no row has a text and a language to learn from, all go. Rows that repeat stay alike."""
    return drop_unknown(docs.select(*COLUMNS), least=REJECT_BELOW)


def _keep(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each sha256, doc_id of chosen the one row of docs with that text and id."""
    rows, key = docs.select(*COLUMNS, content_key().alias("sha256")), ["doc_id", "sha256"]

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("k_id"), F.col("sha256").alias("k_sha256"))
        return rows.join(k, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("sha256") == F.col("k_sha256")), how)

    kept = among(rows, chosen, "left_semi")
    repeated = cut(rows.select(*key).groupBy(*key).count().where("count > 1"))
    if not repeated.isEmpty():  # only these rows are folded, where they are read first
        one = among(rows, among(repeated, chosen, "left_semi"), "left_semi").groupBy(*key).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("x"))
        kept = among(kept, repeated, "left_anti").select(*COLUMNS).union(one.select("doc_id", "x.*").select(*COLUMNS))
    return kept.select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays; null and empty texts are equal; one of null ids if all are null."""
    docs = docs.select(*COLUMNS)
    return _keep(docs, content_classes(docs).select("sha256", F.col("keep_id").alias("doc_id")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one row with the smallest doc_id stays, of equal ids the text whose SHA-256 comes first. SimHash over five-word
    shingles and its index give candidates, as in op3, further fingerprints those that it can't reach; linked is what has a Jaccard
    similarity of 0.8 or more. Texts without words are copies of each other."""
    docs = docs.select(*COLUMNS)
    return _keep(docs, first_copies(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars is that of the new text; every document stays, null texts as they are."""
    docs = redact_secrets(docs.select(*COLUMNS))
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of at most 4096 tokens; an empty or null text is one piece of its end token."""
    return pack(token_pieces(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("best_fit_pack", best_fit_pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written to the shared folder and read again, and deleted
    when the next one stands there. The last one written stays as long as the result may be read."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            written = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            docs.write.parquet(written.toString())
            docs = spark.read.parquet(written.toString())
            let_go(spark)
            if before is not None:
                before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
            before = written
    return docs
