"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, language_id, mixing, piece_codec, shingles
from tablewright.llm.common import prepare, quoted
from tablewright.llm.queries import tokenizer
from tablewright.session import configure, shared_folder

# How far the mean probability of the best language has to lie above an even guess, as a part of what is left.
LEAST_MARGIN = 0.1


def least_score(languages: int) -> float:
    """Mean probability of the best of so many languages below which a text is taken to be in none of them."""
    return 1 / languages + LEAST_MARGIN * (1 - 1 / languages)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Null and empty texts, texts without a letter and texts that the
    network finds no language in (see ``least_score``) go; if no row is labelled, or all in one language, only the former
    go. Repeated rows share their fate; an empty table gives an empty one."""
    prepare(configure(spark))
    net = language_id.fit(docs)
    if net is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    bound = least_score(len(net.languages)) if len(net.languages) > 1 else 0.0
    # Under numbered names, so that columns called like the operator's stay.
    held = {name: f"_c{n}" for n, name in enumerate(docs.columns)}
    found = language_id.predict(docs.select(*[quoted(name).alias(c) for name, c in held.items()]), net, held["text"])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= bound))
    return kept.select(*[F.col(c).alias(name) for name, c in held.items()])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id. A null text counts as empty, a null id as the
    smallest; of rows equal in id and text one stays; texts of any length are told apart by SHA-256."""
    prepare(configure(spark))
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest
    id, null ids last. The SimHash operator (pigeonring) and MinHash bands propose the pairs, the whole sets settle them.
    Null and empty texts are copies of each other; of repeated rows one stays."""
    prepare(configure(spark))
    return shingles.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the curriculum takes them, in training order. Null texts have no words; a null source
    is a source of its own, the last; repeated rows are documents each; ties are settled by hash."""
    prepare(configure(spark))
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and digests of ids and decoded text. A null text is encoded as an empty one; repeated rows and
    texts of any length are encoded whole, each."""
    prepare(configure(spark))
    rows = docs.select("doc_id", "lang", "source", "text")
    coded = piece_codec.encode_pieces(rows, tokenizer("piece_bpe_32k.model"), columns=(*piece_codec.DIGESTS, "ids"))
    return coded.drop("text")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

# The network, the components and the tokenizer are beyond SQL; tests hold each stage and the
# whole against plain Python.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each stage's table goes to a fresh shared folder, and goes once the next one's
    is written."""
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs
