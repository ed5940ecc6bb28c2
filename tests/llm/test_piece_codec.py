import random

import pytest
import sentencepiece
from helpers import SCHEMA, clashing, frame

from tablewright.llm import piece_codec
from tablewright.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("limit", [10, piece_codec.TABLE_CHARS])
def test_equals_the_library(library, limit):
    dice = random.Random(5)
    texts = ["".join(dice.choices(" ▁a\nbé<>s/\U0001f600\x00　\tThe", k=dice.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "  ", " a", "a ", "▁", "▁▁ a", "</s><unk> <0x0A>", "x" * 9000, " " * 50 + "z" + " " * 33]
    table = piece_codec.ChunkTable(piece_codec.load(MODEL), limit)
    for at in range(0, len(texts), 100):
        for text, (n, ids, decoded) in zip(texts[at : at + 100], table.encode(texts[at : at + 100])):
            wanted = library.encode(text)
            assert (n, ids, decoded) == (len(wanted), ",".join(map(str, wanted)), library.decode(wanted)), repr(text)


def test_columns_of_documents(spark, library):
    docs = clashing(frame(spark), ["ids", "_tw_coded"])
    for row in piece_codec.encode_pieces(docs, MODEL).collect():
        assert row.ids == library.encode(row.text or "") and row.decoded == library.decode(row.ids)
    for row in piece_codec.encode_pieces(docs, MODEL, columns=piece_codec.DIGESTS).collect():
        assert row.n_tokens == len(library.encode(row.text or ""))
        assert row.ids_sha256 == piece_codec._sha(",".join(map(str, library.encode(row.text or ""))))
    assert piece_codec.encode_pieces(frame(spark, [], SCHEMA), MODEL).collect() == []
