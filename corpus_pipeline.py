"""The corpus pipeline: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last keep the columns of
documents; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import batches_of, materialise, table

#: Texts that a task judges at once: whole batches lie in the executor outside of its heap and in the worker.
BATCH = 256


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null, empty and letterless texts, and texts unlike every learned language.

    Rows without an id are judged like others but never learned from; without any label every document goes. Repeated
    rows are judged alike; an empty table stays empty."""
    from tokenloom.llm.language_id import identify_language

    with batches_of(spark, BATCH):
        return materialise(identify_language(docs).where("not rejected").select(*docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of the same source hold go; documents stay, with null and empty texts as they are.

    Documents without a source are judged together; an empty table stays empty."""
    from tokenloom.llm.line_dedup import drop_boilerplate_lines

    kept = drop_boilerplate_lines(docs)
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Texts without words are linked with nothing; rows without an id stay; of rows that repeat an id one stays."""
    from tokenloom.llm.jaccard_join import keep_one

    return keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none, repeated rows are judged alike."""
    from tokenloom.llm.decontaminate import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a null or empty text is its end token, an empty table has no pieces."""
    import public_tokenizers

    from tokenloom.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("packing", packing)]

#: Language models and the tokenizer's packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
