"""A corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. run() writes each stage's rows as
Parquet in the shared folder and reads them again for the next, so no stage is computed twice.

docs needs doc_id, text and source; all other columns, of whatever names, pass through. Rows that share id and text are
one document. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, linededup, mixing, neardup, toxicity
from textloom.llm.common import materialize, table

#: Columns that stages add for themselves begin with this.
_OWN = "_corpus_"
_KEY = f"{_OWN}key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that tells rows apart which share a doc_id but not the text."""
    return docs.withColumn(_KEY, F.struct("doc_id", F.xxhash64("text").alias("h")))


def _once(keyed: DataFrame, rows: str) -> DataFrame:
    """One of the rows that share a key; `rows` says how many do. Only those that do are brought together."""
    return keyed.where(F.col(rows) == 1).unionByName(keyed.where(F.col(rows) > 1).dropDuplicates([_KEY]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3. The model learns from the labelled ones among them.

    Null, empty and wordless texts score about 0 and stay; without labels of both kinds all documents stay.
    """
    return toxicity.drop_toxic(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier one repeats; a document whose lines all go, goes.

    Null and empty texts and blank lines stay. n_chars, where docs has it, is told anew for texts that lose lines.
    """
    counts = (f"{_OWN}lines", f"{_OWN}dropped")
    out = linededup.dedup_lines(docs, counts=counts).where((F.col(counts[1]) == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 on 5-word shingles: that with the smallest doc_id.

    (op3_near_duplicates has a contract of its own, with 0.85.) Null and wordless texts are copies of nothing and stay;
    of rows equal in id and text one stays.
    """
    keyed, rows = _keyed(docs), f"{_OWN}rows"
    found = neardup.near_duplicates(keyed, _KEY, num=80).where("kept").groupBy(_KEY).agg(F.count("*").alias(rows))
    return _once(keyed.join(found, _KEY), rows).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item, nor all of a shorter item. Null texts stay."""
    keyed = _keyed(docs)
    hit = decontam.contaminated_documents(keyed, table(spark, sf_dir, "benchmark"), _KEY).where("contaminated").select(_KEY)
    return keyed.join(hit.distinct(), _KEY, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size in words, their source's target, copies (1 or 2) and taken words.

    Columns of docs by these four names are replaced. Wordless documents are not taken; a null source is a source.
    """
    added = ["size", "target", "copies", "taken"]
    keyed, rows = _keyed(docs.drop(*added)), f"{_OWN}rows"
    mixed = mixing.mix_sources(keyed, _KEY).groupBy(_KEY).agg(F.first("size").alias("size"), F.first("target").alias("target"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count("*").alias(rows)).where("copies > 0")
    return _once(keyed.join(mixed, _KEY), rows).select(*(c for c in docs.columns if c not in added), *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
