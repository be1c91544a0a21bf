"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised directly from a rank vocabulary: every byte becomes one printable character,
every token the string of its bytes' characters, scored by its negative rank, under an identity
normaliser. Merging the best-scored pair first is then merging the lowest rank first. Texts are cut
into pre-tokens by a pattern; a pre-token that is itself a token gets its id, all others go through
the model. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

#: Pre-tokens of at most LONGEST characters that a worker remembers, some 50 MB; beyond CACHE of them it forgets all and starts again.
CACHE, LONGEST = 200_000, 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank. Ranks have to be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model in which piece i is token i; the last piece, of no use, is the unknown one."""
    to = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(to[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=-float(len(tokens)), type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.byte_fallback = pb.TrainerSpec.BPE, len(model.pieces), False
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(tokens), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec(dict):
    """Encodes and decodes with a serialised model; one for each worker process.

    As a dict it holds the ids of the pre-tokens met so far, as decimals joined by a space.
    """

    def __init__(self, model: bytes, pattern: str) -> None:
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        to = byte_characters()
        self.to = dict(enumerate(to))
        back = {c: bytes([b]) for b, c in enumerate(to)}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.whole = {p: str(i) for i, p in enumerate(pieces)}
        self.bytes = {str(i): b"".join(back[c] for c in p) for i, p in enumerate(pieces)}

    def __missing__(self, word: str) -> str:
        mapped = word.encode().decode("latin-1").translate(self.to)
        ids = self.whole.get(mapped)
        if ids is None:
            ids = " ".join(map(str, self.model.encode(mapped)))
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> str:
        """The ids of a text as decimals joined by one space."""
        out = " ".join(map(self.__getitem__, self.cut(text)))
        if len(self) > CACHE:
            self.clear()
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, schema: str, row: Callable[[Codec, str], tuple], names: dict[str, pa.DataType], keep: tuple[str, ...] = ()) -> DataFrame:
    model = serialise(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, pattern)
        for batch in batches:
            rows = [row(c, x.as_py() or "") for x in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(columns, names.values())), *batch.columns[2:]], ["doc_id", *names, *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *keep).mapInArrow(run, f"doc_id long, {schema}{kept}")


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text, without special tokens.

    docs has doc_id and text; other columns, whatever their names, are left out. Null and empty texts
    have no ids, a null doc_id stays null, each repeated row is encoded, and an empty table gives an
    empty one. Texts of any length are encoded whole. vocabulary is a rank file that the driver reads;
    executors get the serialised model.
    """
    return _mapped(docs, vocabulary, pattern, "ids array<int>", lambda c, t: ([int(x) for x in c.encode(t).split()],), {"ids": pa.list_(pa.int32())})


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, data binary: the bytes that ids (array<int>) stand for; null ids give no bytes.

    An id outside the vocabulary fails the job with a KeyError; a null among ids stands for nothing.
    """
    model = serialise(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, pattern)
        for batch in batches:
            out = [b"".join(c.bytes[str(i)] for i in (x.as_py() or ()) if i is not None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "data"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens long, ids_sha256, decoded_sha256: every whole text encoded, and its ids decoded; then the columns in keep.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded bytes. Nulls,
    empty texts, repeats and other columns are taken as encode() takes them.
    """

    def row(c: Codec, text: str) -> tuple:
        ids = c.encode(text)
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _mapped(docs, vocabulary, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, keep)
