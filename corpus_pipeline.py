"""A training corpus out of raw documents: five stages over the operators of ``tidewatch.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads it again as the
next stage's ``docs``. All stages but the last return the columns of ``documents``.

Rows without an id get one from a hash of their text while a stage needs it; extra columns pass through, also if they are named like a
column that an operator adds. Empty tables pass every stage. SQL can't express the stages, so ORACLE_SQL is None and the tests compare
each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, table
from tidewatch.llm.op1_decontamination import mark
from tidewatch.llm.op2_minhash import near_duplicates
from tidewatch.llm.op3_language import learn, predict
from tidewatch.llm.op6_mixing import mix_sources
from tidewatch.llm.op8_suffix import remove_repeats

WORDS, PERCENT = 5, 80
LEAST_SCORE, GRAM = 0.05, 4  # of the language decision; bytes of the n-grams that it rests on
ORACLE_SQL = None


def _aside(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """Columns named like those an operator adds get another name meanwhile."""
    names = {f"_given_{c}": c for c in added if c in docs.columns}
    return docs.withColumnsRenamed({c: n for n, c in names.items()}), names


def _identified(docs: DataFrame) -> DataFrame:
    """``_id``: the id, or for rows without one a number above all real ids from the text."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.xxhash64("text").bitwiseAND((1 << 61) - 1)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages of the labelled ones go: no letters, or hardly an n-gram of any language, whatever the length.

    A text of fewer bytes than one n-gram says nothing about its language and stays if it has a letter.
    """
    given = docs.columns
    docs, names = _aside(docs, "lang_pred", "score")
    told = predict(docs, learn(docs)).where((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_SCORE) | (F.octet_length("text") < GRAM)))
    return told.drop("lang_pred", "score").withColumnsRenamed(names).select(given)


def _told_apart(named: DataFrame) -> DataFrame:
    """``_key``: one number per id and text. It is the id for the id's first text (by hash); other texts of the same id get one above all real ids."""
    named = named.withColumn("_text", F.xxhash64("text"))
    several = keep(named.groupBy("_id").agg(F.min("_text").alias("_first"), F.max("_text").alias("_last")).where("_first <> _last").select("_id", "_first"), "several")
    if several.isEmpty():  # no text needs to move
        return named.withColumn("_key", F.col("_id"))
    other = F.lit(1 << 61) + F.xxhash64("_id", "_text").bitwiseAND((1 << 61) - 1)
    return named.join(several, "_id", "left").withColumn("_key", F.when(F.col("_first") != F.col("_text"), other).otherwise(F.col("_id"))).drop("_first")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of repeated rows one. An id with several texts stands for its
    first text; its other texts are documents of their own that come after all ids."""
    named = _told_apart(_identified(docs))
    groups = near_duplicates(named.select(F.col("_key").alias("doc_id"), "text"), WORDS, PERCENT)
    stays = groups.where("kept").select(F.col("doc_id").alias("_key")).distinct()
    return named.join(stays, "_key").dropDuplicates(["_key"]).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats is cut out of the texts; documents of which no word is left go."""
    given = docs.columns
    docs, names = _aside(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    cut = remove_repeats(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in given:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.drop("n_bytes", "n_removed", "n_spans", "kept_sha256").withColumnsRenamed(names).select(given)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    given = docs.columns
    docs, names = _aside(docs, "matches")
    return mark(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).drop("matches").withColumnsRenamed(names).select(given)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their copies in the mix, a row each, with the columns of ``mix_sources`` and the number of the copy."""
    docs, _ = _aside(docs, "size", "source_size", "target", "copies", "taken", "copy")
    mixed = mix_sources(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


STAGES = [("language identification", language), ("MinHash near-dedup", near_copies), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminate),
          ("mixing sources", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
