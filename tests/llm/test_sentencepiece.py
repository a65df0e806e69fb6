import random

import sentencepiece
from indicata.llm import sentencepiece_codec as S
from indicata.llm.common import table


def test_parity_with_the_library(spark):
    docs = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert S.parity(docs) == []
    random.seed(1)
    odd = ["".join(random.choice("aAzÉéßñ İıſΣ.,'!1 \n\t\r\x0b\xa0́ <|>▁漢字🙂  the unk") for _ in range(random.randint(0, 60)))
           for _ in range(2000)]
    assert S.parity(odd + ["<unk> <s> </s>", "▁", " ", "  a", "", "x" * 20_000]) == []


def unigram_model():
    """A small unigram model file, written field by field."""
    def message(*fields):
        out = b""
        for number, value in fields:
            if isinstance(value, bytes):
                n, size = len(value), b""
                while True:
                    size += bytes([n & 127 | (128 if n > 127 else 0)])
                    n >>= 7
                    if not n:
                        break
                out += bytes([number << 3 | 2]) + size + value
            elif isinstance(value, float):
                import struct
                out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            else:
                key = number << 3
                out += (bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])) + bytes([value])
        return out
    pieces = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)]
    words = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "▁b", "ca"]
    pieces += [(w, -1.5 - 0.37 * i, S.NORMAL) for i, w in enumerate(words)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    return body + message((2, message((3, S.UNIGRAM), (35, 1)))) + message((3, message((3, 1), (4, 0), (5, 1))))


def test_unigram_scores_and_byte_fallback(tmp_path):
    path = str(tmp_path / "small.model")
    with open(path, "wb") as f:
        f.write(unigram_model())
    model = S.Model.parse(unigram_model())
    assert (model.kind, model.byte_fallback, model.trim_spaces) == (S.UNIGRAM, True, False)
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(2)
    texts = ["".join(random.choice("abc z") for _ in range(n % 12)) for n in range(300)]
    codec = S.Codec.of(path)
    ids = codec.encode(texts)
    assert ids == theirs.encode(texts) and codec.decode(ids) == [theirs.decode(i) for i in ids]


def test_round_trip(spark, odd_docs, no_docs):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    theirs = sentencepiece.SentencePieceProcessor(model_file=S.model_file())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in S.round_trip(docs).collect():
        assert r["ids"] == theirs.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["lossless"]
    rows = S.round_trip(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["lossless"] for r in rows)
    assert {r["doc_id"]: r["ids"] for r in rows}[2] == []
    assert S.round_trip(no_docs).count() == 0
    back = {r["id"]: r["text"] for r in S.decode(S.encode(odd_docs)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert S.decode(S.encode(no_docs)).count() == 0
