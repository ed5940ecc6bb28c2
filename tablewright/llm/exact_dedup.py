"""Exact dedup in two passes around a Bloom filter.

The first pass reads only hashes. Each text sets a few bits inside one 64-bit word of the
filter; a bit that two rows set is kept as "repeated". A row whose bits are all repeated
possibly has a copy; every other row has certainly none and passes straight through. Only the
possibly repeated rows are shuffled, by the SHA-256 of the text, and settled exactly, so a false
alarm of the filter costs a shuffled row and never changes a result.

The filter has ``words`` words of 64 bits, a parameter; at most ``words`` rows of 16 bytes are
broadcast, whatever the corpus. A corpus far beyond the filter raises more false alarms and
shuffles more rows. All steps are DataFrame operations.

Results: texts are equal when identical; null counts as empty. Of equal texts the row with the
largest id stays (a null id is the smallest); of rows equal in id and text exactly one stays. An
empty table gives an empty one. Input columns called like an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import prepare, quoted, without

SALTS = 64  # parts of a large group of copies


def possibly_repeated(docs: DataFrame, text: str = "text", words: int = bloom.WORDS) -> DataFrame:
    """``docs`` with ``_tw_repeated``: false only if no other row has this text."""
    prepare(docs.sparkSession)
    key = F.coalesce(quoted(text), F.lit(""))
    held = bloom.filled(docs.select(quoted(text)), key, words, repeated=True)
    return bloom.tested(without(docs, ["_tw_repeated"]), key, held, "_tw_repeated", words)


def mark_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = bloom.WORDS) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows that pass through and rows that were settled come from one checkpoint of these narrow
    rows, so that the row picked among equal ids is the same wherever it is looked at.
    """
    narrow = possibly_repeated(docs.select(quoted(id).alias("_tw_id"), quoted(text).alias("_tw_text")), "_tw_text", words)
    sha = F.sha2(F.coalesce("_tw_text", F.lit("")), 256)
    rows = narrow.select("_tw_id", sha.alias("text_sha256"), "_tw_repeated", F.monotonically_increasing_id().alias("_tw_row"))
    rows = rows.checkpoint()
    single = rows.where("NOT _tw_repeated").select(
        "_tw_id", F.col("_tw_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    suspects = rows.where("_tw_repeated").select(
        "_tw_id", "_tw_row", F.unhex("text_sha256").alias("_tw_key"), F.pmod("_tw_row", F.lit(SALTS)).alias("_tw_salt")
    )
    # A large group is settled in parts, and meets its rows again under each of its salts.
    parts = suspects.groupBy("_tw_key", "_tw_salt").agg(
        F.max(F.struct("_tw_id", "_tw_row")).alias("_tw_kept"), F.count("*").alias("group_size")
    )
    groups = parts.groupBy("_tw_key").agg(
        F.max("_tw_kept").alias("_tw_kept"), F.sum("group_size").alias("group_size"), F.collect_set("_tw_salt").alias("_tw_salts")
    )
    groups = groups.select("_tw_key", "_tw_kept", "group_size", F.explode("_tw_salts").alias("_tw_salt"))
    settled = suspects.join(groups, ["_tw_key", "_tw_salt"]).select(
        "_tw_id",
        F.col("_tw_kept._tw_id").alias("keep_id"),
        "group_size",
        (F.col("_tw_kept._tw_row") == F.col("_tw_row")).alias("kept"),
        F.lower(F.hex("_tw_key")).alias("text_sha256"),
    )
    return single.unionByName(settled).withColumnRenamed("_tw_id", id)


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = bloom.WORDS) -> DataFrame:
    """``docs`` with one row of each text. Rows without copies are not shuffled; of the others
    each map task keeps one row per text before the shuffle."""
    marked = possibly_repeated(docs, text, words)
    single = marked.where("NOT _tw_repeated").drop("_tw_repeated")
    suspects = marked.where("_tw_repeated").drop("_tw_repeated")
    names = single.columns
    key = F.sha2(F.coalesce(quoted(text), F.lit("")), 256)
    # Columns under numbered names, as struct fields of any name would clash.
    fields = F.struct(*[quoted(name).alias(f"c{n}") for n, name in enumerate(names)])
    # The largest id; maps cannot be compared, so other columns take no part.
    rank = F.struct(quoted(id).alias("a"), F.xxhash64(*[quoted(n) for n, t in suspects.dtypes if "map<" not in t]).alias("b"))
    picked = suspects.groupBy(key.alias("_tw_key")).agg(F.max_by(fields, rank).alias("_tw_one"))
    kept = picked.select(*[F.col(f"_tw_one.c{n}").alias(name) for n, name in enumerate(names)])
    return single.unionByName(kept)
