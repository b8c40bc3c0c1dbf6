"""SentencePiece rounds (op6) against the sentencepiece library."""

import hashlib
import random

import pyarrow as pa
import sentencepiece

from scorelens.llm import sentence_pieces
from scorelens.llm.sentence_pieces import PieceEncoder

from conftest import SF_SMALL


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_ids_and_text_of_odd_strings(piece_model):
    library, enc = sentencepiece.SentencePieceProcessor(model_file=piece_model), PieceEncoder(piece_model)
    random.seed(2)
    texts = ["", " ", "  ", "a \n b", " x  ", "▁a ▁▁ b", "<s> </s> <unk> <0x0A>", "日本 語　 テ", "ﬁ é Ａ", "\x00 a",
             "a" * 900, "ab" * 700, " " * 900, "the quick " * 200, "😀😀 x", "mississippi" * 100]
    texts += ["".join(random.choice("abcdehtins  ▁,.é") for _ in range(random.choice([5, 60, 500]))) for _ in range(400)]
    ids, off = enc.encode(pa.array(texts, pa.large_string()))
    decoded = enc.decode(ids, off)
    for k, t in enumerate(texts):
        want = library.encode(t)
        assert ids[off[k]:off[k + 1]].tolist() == want, t[:40]
        assert decoded[k].decode() == library.decode(want)


def check(rows, docs, library):
    want = sorted((repr(i), len(e), sha(",".join(map(str, e)).encode()), sha(library.decode(e).encode()))
                  for i, e in ((i, library.encode(t or "")) for i, t in docs))
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_hard_documents(hard, piece_model):
    rows = sentence_pieces.sentence_pieces(hard, piece_model).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in hard.collect()], sentencepiece.SentencePieceProcessor(model_file=piece_model))
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_query(spark, piece_model):
    rows = sentence_pieces.op6_sentence_pieces(spark, SF_SMALL).collect()
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, docs, sentencepiece.SentencePieceProcessor(model_file=piece_model))


def test_nothing(empty, piece_model):
    assert sentence_pieces.sentence_pieces(empty, piece_model).count() == 0
