"""From raw documents to training sequences: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; extra columns pass through.
"""
from pyspark.sql import functions as F

from filingsift.llm import decontaminate as contamination
from filingsift.llm import language_id as languages
from filingsift.llm import near_dedup, piece_sampling, substring_dedup
from filingsift.llm.tables import Tables


def _measured(docs):
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark, docs, sf_dir):
    """Drops documents without a letter and those that resemble no learned language.

    The profiles are learned from the given documents' own lang values.
    """
    return languages.accepted(docs, languages.learn(docs))


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    return near_dedup.keep_one(docs, percent=80)


def substrings(spark, docs, sf_dir):
    """Cuts passages that an earlier document has; documents of which nothing is left go."""
    return _measured(substring_dedup.without_repeats(docs).filter("text <> ''"))


def decontamination(spark, docs, sf_dir):
    """Drops documents that the benchmark contaminates and cuts its phrases from the others."""
    return _measured(contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pieces(spark, docs, sf_dir):
    """Training sequences: a sampled segmentation of each text, with the text that its pieces decode to."""
    coded = piece_sampling.encode(docs.select("doc_id", "text", "lang", "source"), decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), F.size("pieces").alias("n_pieces"), "pieces", "lossless")


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", pieces),
]

#: The first and the last stage fit or sample; tests compare them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    tables, docs = Tables(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        docs = tables.write(f"stage{number}", stage(spark, docs, sf_dir))
        tables.drop(f"stage{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
