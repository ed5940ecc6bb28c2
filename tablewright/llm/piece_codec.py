"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary has a white-space marker behind another character, no merge
can cross from one marked word into the next. A text is then the row of its marked words, each
of which is segmented on its own: a worker segments every distinct marked word it meets once,
keeps ids and decoded text in a table, and joins them back by position.

The table is cleared when it holds ``TABLE_CHARS`` characters, so a worker's memory does not
grow with the corpus; a word met again after that is segmented again.

Results: a null text counts as empty and gives no ids; an empty text gives no ids; texts of any
length are worked as a whole; repeated rows give repeated results; an empty table gives an
empty one. Input columns called like an output give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, quoted, without

MARK = "▁"
TABLE_CHARS = 8_000_000


def load(model: str) -> bytes:
    """Bytes of the model file, checked: its pieces carry markers only at the front."""
    with open(model, "rb") as file:
        proto = file.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=proto)
    crossing = [p for p in map(pieces.id_to_piece, range(pieces.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing or pieces.encode("  a ", out_type=str)[0][:1] != MARK or pieces.decode(pieces.encode("  a ")) != "  a ":
        raise ValueError("pieces of this model cross white-space markers, or white space is not kept")
    return proto


class ChunkTable:
    """Number of ids, ids (as decimals joined by commas) and decoded text of distinct marked words.

    A chunk is written without its first marker, as the library puts one before every text it
    is given; further markers of a run are leading spaces.
    """

    def __init__(self, proto: bytes, limit: int = TABLE_CHARS) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.lone = self.pieces.piece_to_id(MARK)
        self.limit, self.size = limit, 0
        self.entries: dict[str, tuple[int, str, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text. Markers written in the text count as spaces."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ") if MARK in text else text.split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        last = len(parts) - 1
        for n, part in enumerate(parts):
            if part or n == last:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        return out

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks, in one call of the library."""
        if self.size > self.limit:
            self.entries.clear()
            self.size = 0
        new = [c for c in chunks if c not in self.entries]
        # The empty chunk stands for a single marker, which an empty text does not get.
        encoded = [ids if c else [self.lone] for c, ids in zip(new, self.pieces.encode(new, num_threads=1))]
        for chunk, ids, text in zip(new, encoded, self.pieces.decode(encoded, num_threads=1)):
            self.entries[chunk] = len(ids), ",".join(map(str, ids)), chunk if text == chunk else text
            self.size += len(chunk) + 40

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, joined ids and decoded text of each text of a batch."""
        split = [self.chunks(text or "") for text in texts]
        self.learn(set().union(*split))
        for chunks in split:
            if chunks:
                counts, ids, decoded = zip(*map(self.entries.__getitem__, chunks))
                yield sum(counts), ",".join(ids), " ".join(decoded)
            else:
                yield 0, "", ""


def _id_lists(rows: list[tuple[int, str, str]]) -> pa.Array:
    """Ids of the rows of a batch as lists."""
    joined = ",".join(ids for _, ids, _ in rows if ids)
    flat = np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32)
    ends = np.cumsum([0, *(n for n, _, _ in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_pieces(docs: DataFrame, model: str, text: str = "text", columns: Sequence[str] = ("ids", "decoded")) -> DataFrame:
    """``docs`` with the columns asked for: ``n_tokens``, ``ids`` (array of int), ``decoded``
    (string), ``ids_sha256`` and ``decoded_sha256``, the SHA-256 of the decimal ids joined by
    commas and of the decoded text in UTF-8. What is not asked for does not leave the worker."""
    prepare(docs.sparkSession)
    proto = load(model)
    make = {
        "n_tokens": ("long", lambda rows: pa.array([n for n, _, _ in rows], pa.int64())),
        "ids": ("array<int>", _id_lists),
        "decoded": ("string", lambda rows: pa.array([text for _, _, text in rows], pa.string())),
        "ids_sha256": ("string", lambda rows: pa.array([_sha(ids) for _, ids, _ in rows], pa.string())),
        "decoded_sha256": ("string", lambda rows: pa.array([_sha(text) for _, _, text in rows], pa.string())),
    }
    made = [make[name][1] for name in columns]

    @F.arrow_udf(", ".join(f"{name} {make[name][0]}" for name in columns))
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(proto)
        for batch in batches:
            rows = list(table.encode(batch.to_pylist()))
            yield pa.StructArray.from_arrays([build(rows) for build in made], names=list(columns))

    rows = without(docs, [*columns, "_tw_coded"])
    return rows.withColumn("_tw_coded", coded(quoted(text))).select(*map(quoted, rows.columns), "_tw_coded.*")


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
