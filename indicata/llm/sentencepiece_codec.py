"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file is a protobuf message; its pieces, scores, piece types,
normaliser and trainer settings are read here field by field.  From them a
``tokenizers`` pipeline is rebuilt: the precompiled character map, the
white-space rules, the dummy prefix and the ``U+2581`` marker as normaliser; a
unigram lattice over the scores, or, for a merge model, the merges in score
order; byte fallback and the marker's removal as decoder.  Where no piece of
the vocabulary holds a marker after another character, words never interact
and the text is split in front of each marker run, so that the library may
encode the words of a batch on its threads and remember frequent ones.

Parity with the ``sentencepiece`` library is checked by ``parity`` and in
tests/llm.

Edge cases: a null text counts as empty and has no ids; unknown characters
become bytes where the model has them, else the unknown id; repeated rows are
encoded alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.llm.common import slices
from indicata.llm.forms import FormMemory

DEFAULT_MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers, and the longest of them.
CACHE_FORMS, CACHE_CHARS = 400_000, 48
_SLICE_BYTES = 1 << 21
_CODECS: dict[str, "Codec"] = {}

# Piece types and model types of the SentencePiece model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def model_file(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_MODEL)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[i:i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, raw[i:i + n]
            i += n


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    mark_spaces: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> "Model":
        out = cls()
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))
                out.pieces.append(got.get(1, b"").decode())
                out.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                out.types.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                out.kind, out.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))
                out.char_map = got.get(2, b"")
                out.dummy_prefix, out.trim_spaces, out.mark_spaces = (bool(got.get(n, 1)) for n in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        return out


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, best score first (ties: lower id first)."""
    rank = {p: i for i, p in enumerate(model.pieces) if model.types[i] in (NORMAL, USER_DEFINED)}
    found = []
    for p, i in rank.items():
        for cut in range(1, len(p)):
            if p[:cut] in rank and p[cut:] in rank:
                found.append((-model.scores[i], i, rank[p[:cut]], rank[p[cut:]], p[:cut], p[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def words_apart(model: Model) -> bool:
    """No piece has the marker after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in model.pieces)


def build(model: Model):
    """The ``tokenizers`` pipeline of ``model``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    unknown = model.types.index(UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, _merges(model), fuse_unk=True,
                          unk_token=model.pieces[unknown], byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.mark_spaces else " "))
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if words_apart(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class Codec:
    """Batch encoder and decoder of one model file."""

    def __init__(self, path: str, threads: int = 1):
        # the library's thread pool reads these once, before its first batch
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.pipeline = build(self.model)
        m = self.model
        #: With these settings a text's ids are those of its words one after the other.
        self._by_word = (words_apart(m) and m.mark_spaces and m.dummy_prefix and not m.trim_spaces and not m.char_map)
        self._memory = FormMemory(self._learn, CACHE_FORMS, CACHE_CHARS)

    @classmethod
    def of(cls, path: str, threads: int = 1) -> "Codec":
        if path not in _CODECS:
            _CODECS[path] = cls(path, threads)
        return _CODECS[path]

    def _learn(self, forms: list[str]) -> dict[str, bytes]:
        got = self.pipeline.encode_batch_fast(forms, add_special_tokens=False)
        return {f: array("I", e.ids).tobytes() for f, e in zip(forms, got)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, by batches on the library's threads."""
        whole = [not self._by_word or "  " in t or t[:1] == " " or t[-1:] == " " or MARK in t for t in texts]
        flat, starts = self._memory.ids(pa.array(["" if w else t for w, t in zip(whole, texts)], pa.string()))
        flat, starts = flat.tolist(), starts.tolist()
        out = [flat[a:b] for a, b in zip(starts, starts[1:])]
        direct = [i for i, w in enumerate(whole) if w]
        for i, e in zip(direct, self.pipeline.encode_batch_fast([texts[i] for i in direct], add_special_tokens=False)):
            out[i] = e.ids if texts[i] else []
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.pipeline.decode_batch(ids, skip_special_tokens=False)

    def normalised(self, text: str) -> str:
        """What a lossless decoding of ``text`` gives back."""
        out = self.pipeline.normalizer.normalize_str(text).replace(MARK, " ") if text else ""
        return out[1:] if self.model.dummy_prefix and out else out


def parity(texts: list[str], path: str | None = None) -> list[str]:
    """The texts whose ids or decoding differ from the ``sentencepiece`` library's."""
    import sentencepiece
    codec = Codec.of(model_file(path))
    theirs = sentencepiece.SentencePieceProcessor(model_file=model_file(path))
    ids = codec.encode(texts)
    wanted = theirs.encode(texts, num_threads=1)
    return [t for t, a, b, d in zip(texts, ids, wanted, codec.decode(ids)) if a != b or d != theirs.decode(b)]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
           threads: int = 1) -> DataFrame:
    """(id, ids) of every row; ``threads`` of the library per task (an executor's spare cores)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model_file(path), threads)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices([len(t) for t in texts], _SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(codec.encode(texts[i:j]), pa.list_(pa.int32()))],
                    names=["id", "ids"])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, id_col: str = "id", ids: str = "ids", path: str | None = None,
           threads: int = 1) -> DataFrame:
    """(id, text) of every row of ids; null ids decode to an empty text."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model_file(path), threads)
        for batch in batches:
            found = [v or [] for v in batch.column(1).to_pylist()]
            for i, j in slices([len(v) for v in found], _SLICE_BYTES // 4):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(codec.decode(found[i:j]), pa.string())],
                    names=["id", "text"])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, threads: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids, lossless of every row: decoding gives the normalised text back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model_file(path), threads)
        plain = not codec.model.char_map and not codec.model.trim_spaces and codec.model.dummy_prefix
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices([len(t) for t in texts], _SLICE_BYTES):
                ids = codec.encode(texts[i:j])
                same = [d == t or d == (t.replace(MARK, " ") if plain else codec.normalised(t))
                        for d, t in zip(codec.decode(ids), texts[i:j])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(v) for v in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids", "lossless"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")
