"""The corpus pipeline: toxicity, exact, near and substring deduplication, then packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of ``documents``.  Between stages the rows are written to the shared checkpoint
folder as Parquet and read again, so a lost executor costs no more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import common, exact_dedup, packing, simhash_bk, substring_index, toxicity
from trellis.session import materialize, prepare, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier rejects go; the labels are those of the tables.

    Null and empty texts have no words and get the score of no evidence; long texts are scored whole; equal
    texts share their fate, so repeated rows do and ties cannot arise; without labels of both classes nothing
    can be learnt, a warning says so and all documents stay; an empty table stays empty; other columns pass
    through.
    """
    model = toxicity.fit(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one of smallest doc_id stays.

    Null counts as empty, and empty texts are copies of each other; long texts are hashed whole; a null doc_id
    comes after every number; of rows that share the doc_id too, one stays, the smallest by its other columns
    where the texts are the same; an empty table stays empty; other columns pass through.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 of their five-word shingles the one of smallest doc_id stays.

    Null, empty and blank texts are alike; texts shorter than a shingle are one shingle; long texts are compared
    by all their shingles; a null doc_id comes last; repeated rows leave one, as in ``drop_copies``; an empty table
    stays empty; other columns pass through.
    """
    return simhash_bk.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that an earlier document has go; a text without any stays as it is.

    Null and empty texts stay as they are; long texts are cut like others; a null doc_id comes before every
    number, and rows of one doc_id follow in the order of their texts' MD5; of repeated rows the first keeps its
    text; an empty table stays empty; other columns pass through, but n_chars counts what is left.
    """
    cut = substring_index.remove_repeats(docs)
    kept, _, removed = map(F.col, cut.columns[-3:])
    touched = removed > 0
    new = {"text": F.when(touched, kept).otherwise(F.col("text")), "n_chars": F.when(touched, F.length(kept).cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    Null counts as empty; an empty text is its end id alone; long texts are cut into pieces; a null doc_id is
    carried along; repeated rows and ties are packed like any others; an empty table gives no pieces; other
    columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Classifier, similarity search, suffix removal and tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    given = True
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if not given:  # what the stage before wrote is not read again
            release(before)
        given = False
    return STAGES[-1][1](spark, docs, sf_dir)
