"""From raw documents to packed training sequences: five stages, each written as Parquet
in the shared scratch folder and read again as the next one's documents.

1. quality rules: documents that the rules reject go.
2. line dedup: lines that many documents share are dropped.
3. n-gram Jaccard join: one document of each group of near copies stays; rows with a
   null doc_id and each different text of a repeated doc_id take part.
4. mixing: every document is repeated (or left out) as the mix of its source asks.
5. packing: all that is left is packed into sequences.

All stages but the last return the columns of documents. A stage that changes texts
sets n_chars to the new length; other columns stay as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import materialize, near, read_table, unused
from scholarlake.llm.line_dedup import dedup_lines
from scholarlake.llm.mixing import mix
from scholarlake.llm.ngram_join import one_of_each
from scholarlake.llm.packing import default_tokenizer, pack
from scholarlake.llm.quality_rules import judge


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. A rejected (doc_id, text) goes in all its repeated rows.

    A null or empty text has no words and goes; rows with a null doc_id, lang or source are
    judged like any other; an empty table stays empty; other columns are kept as they are.
    """
    judged = judge(docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("hash")))
    rejected = judged.filter(~F.col("kept")).select(*[F.col(c).alias(f"rejected_{c}") for c in ("doc_id", "hash", "lang", "source")]).distinct()
    rejected = materialize(rejected, "rejected")
    same = (
        docs["doc_id"].eqNullSafe(rejected["rejected_doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(rejected["rejected_hash"])
        & docs["lang"].eqNullSafe(rejected["rejected_lang"]) & docs["source"].eqNullSafe(rejected["rejected_source"])
    )
    # few rejected rows are brought to the texts; beyond the bound the texts are shuffled
    return docs.join(near(rejected.count())(rejected), same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with shared lines dropped; a document that has lost all its text goes.

    Null and empty texts are one empty line and stay; a null doc_id counts as one document;
    repeated rows lose the same lines; an empty table stays empty.
    """
    kept = dedup_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    out = kept.filter((F.col("n_dropped") == 0) | (F.length(F.btrim("kept_text", F.lit("\x20\x09\x0a\x0b\x0c\x0d"))) > 0))
    # a text that lost nothing stays as it was, null too
    changed = {"text": F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept_text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    new = out.select("row", F.struct(*[value.alias(c) for c, value in changed.items()]).alias("changed"))
    return new.select(*[F.col("changed" if c in changed else "row").getField(c).alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id; a row with a null doc_id only where all have none.

    Texts without words are copies of none, but repeated rows of one (doc_id, text) are
    kept once; equal ids go by hash of the text; an empty table stays empty.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows of 0 copies go, so those without words too.

    Rows with null or repeated ids are mixed for themselves; a null source is a source;
    ties go by hash of doc_id and text; an empty table stays empty.
    """
    # rows are numbered, as ids may be null or repeated
    row = unused("row", docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    mixed = mix(numbered.select("doc_id", "source", "text", F.col(row).alias("row")), row="row").filter("copies > 0")
    copies = mixed.select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("copies"))
    joined = numbered.select(row, F.struct(*docs.columns).alias("kept")).join(copies, row)
    return joined.select("kept", F.explode("copies").alias("copy")).select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens.

    A null text is an end token alone; rows with null or repeated ids are packed each; no
    rows give no pieces; other columns than doc_id, source and text are not read.
    """
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: The covariance estimates, similarity groups and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
