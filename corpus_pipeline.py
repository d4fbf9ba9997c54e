"""A corpus for training: toxic documents go, near copies go, secrets are cut out, sources are mixed, texts become ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import jaccard, mixing, scratch, secrets, sentencepiece_codec, toxicity

#: Documents that score at least this are rejected.
TOXIC = 0.5
#: Near copies share at least NUM / DEN of their sets of WIDTH words.
WIDTH, NUM, DEN = 5, 8, 10


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by the labelled examples of the folder.

    Null and empty texts are scored as texts without terms; each row is scored by its own text, so
    repeated rows stand or fall together, and rows without an id are scored like others. Labels
    without a document teach nothing. An empty table gives no rows; all columns stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), into="__toxicity")
    return _like(scored.where(F.col("__toxicity") < TOXIC), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null and empty texts have no near copies. Rows that share an id, or have none, stand or fall
    together, but of equal texts with one id, empty ones too, one stays. An empty table gives no rows; all columns
    stay as they are.
    """
    return _like(jaccard.one_of_each(docs, WIDTH, NUM, DEN), docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars counted anew.

    Null texts stay null, empty ones empty; repeated rows stay repeated, ids are not looked at, and
    an empty table gives no rows. Columns named as those of the scan keep their values.
    """
    own = {c: f"doc_{c}" for c in docs.columns}  # no name of the scan is one of these
    found = secrets.find_secrets(docs.withColumnsRenamed(own), "doc_text", redacted=True)
    found = found.withColumn("doc_n_chars", F.length("doc_text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{new}`").alias(c) for c, new in own.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: a document that the mix repeats stands as often.

    Null sources are one source, the last; null and empty texts have no words, so they stand only in
    their source's whole epochs. Rows that share an id are ordered by their size, and each may be taken. An empty table
    gives no rows; all columns stay as they are.
    """
    return _like(mixing.mixed_rows(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids) of every row; null and empty texts have no ids, repeated rows are rows of their own."""
    ids = sentencepiece_codec.encode(docs.select("doc_id", "text"), sentencepiece_codec.load())
    return ids.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", cut_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.materialize(docs, f"stage{i}")
    return docs
