"""From raw documents to packed token sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns
a frame. Outputs are written as Parquet and read again before the next stage starts, so
a stage may remove what its predecessors staged. All stages but the last return the
columns of ``documents``.

Defined results: null and empty texts, and texts without words, pass all filters and are packed as
they are. A document all of whose words stood in lines that earlier documents hold goes with those lines.
Of near copies the row of the smallest id stays, rows without an id coming last; rows that share an id are
documents of their own, told apart by their texts. Very long texts are worked on whole. Columns beside
those of ``documents`` are carried along. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.functions.ids import with_objectid
from linehaul.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from linehaul.llm.queries import word_tokenizer
from linehaul.llm.stage import release, small_batches
from linehaul.plans.inputs import table
from linehaul.session import new_work_folder

TOXIC_FROM = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    release(small_batches(spark))
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document of a smaller id holds; ``n_chars`` follows. Documents
    that are left without a word by it go."""
    release(small_batches(spark))
    kept = line_dedup.drop_repeated_lines(docs)
    kept = kept.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text")).alias("text")
    changed = {
        "text": text,
        "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"),
    }
    return kept.select(*[changed.get(c, F.col(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id."""
    release(small_batches(spark))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    key, rows = "doc_id", docs
    if not ids.where("n > 1 or doc_id is null").isEmpty():
        # Ids that don't tell rows apart: number the rows in the order of ids and texts.
        key = "row_number_of_stage"
        rows = with_objectid(docs, [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")], name=key)
    groups = jaccard.jaccard_components(rows, id_col=key, n_words=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = groups.where("id <> component").select(F.col("id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    release(small_batches(spark))
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with their ids."""
    release(small_batches(spark))
    return packing.pack_documents(docs, word_tokenizer())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack),
]

#: The toxicity stage is a fitted model, which SQL can't express; the tests hold the
#: pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_work_folder(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
