"""Token ids of texts by a public byte-level BPE vocabulary, through a sentencepiece model made from it.

The model is serialised here, directly from the rank file: each token is a
piece of the printable characters that stand for its bytes, scored by its
negative rank, with identity normalisation. Texts are cut into pre-tokens by
the vocabulary's pattern, pre-tokens mapped to those characters and encoded;
the piece numbers are the ranks. Decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The vocabulary and the folder of the vocabularies; parameters of the queries.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into pre-tokens for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept in a worker's memory, and the longest kept.
CACHE, CACHE_CHARS = 400_000, 48
#: Ids in one output batch, about; bounds the memory for batches of very long texts.
BATCH_IDS = 2_000_000


def byte_characters() -> list[str]:
    """For each byte its character: itself if printable, otherwise the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model(path: str) -> bytes:
    """A serialised sentencepiece BPE model of a rank file; its last piece is the unknown one, which bytes never need."""
    characters, tokens = byte_characters(), ranks(path)
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(characters[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    off = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, off) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    def __init__(self, serialised: bytes):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised)
        self.cut = regex.compile(PATTERN).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts have none."""
        out: list[int] = []
        known = self.known
        for token in self.cut(text or ""):
            ids = known.get(token)
            if ids is None:
                ids = self.pieces.encode(token.encode("utf-8").decode("latin-1").translate(self.table))
                if len(token) <= CACHE_CHARS:
                    if len(known) >= CACHE:
                        known.clear()
                    known[token] = ids
            out += ids
        return out


class Decoder:
    def __init__(self, path: str):
        self.tokens = ranks(path)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", errors="replace")


_workers: dict[int, Encoder] = {}


def _encoder(serialised) -> Encoder:
    """The encoder of this Python worker, made once."""
    key = hash(serialised.value)
    if key not in _workers:
        _workers[key] = Encoder(serialised.value)
    return _workers[key]


def _columns(batches: Iterator[pa.RecordBatch], serialised, counts: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(serialised)
    for batch in batches:
        *kept, texts = batch.columns
        start, values, sizes = 0, [], []

        def part(stop: int) -> pa.RecordBatch:
            if counts:
                made = pa.array(sizes, pa.int64())
            else:
                offsets = [0]
                for n in sizes:
                    offsets.append(offsets[-1] + n)
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            return pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in kept), made], [*batch.schema.names[:-1], "n_tokens" if counts else "ids"])

        for i, text in enumerate(texts):
            ids = encoder.encode(text.as_py())
            sizes.append(len(ids))
            if not counts:
                values += ids
            if len(values) >= BATCH_IDS:
                yield part(i + 1)
                start, values, sizes = i + 1, [], []
        if sizes:
            yield part(len(texts))


def encoded(df: DataFrame, keep: list[str], text: str = "text", path: str = f"{FOLDER}/{VOCABULARY}", counts: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with ``ids`` (list of integers), or with ``n_tokens`` if counts.

    Whole texts are encoded, of any length; null and empty texts give the empty
    list. The model (about 1 MB, fixed by the vocabulary) is made on the
    driver and sent to the workers, so only the driver needs the file.
    """
    serialised = df.sparkSession.sparkContext.broadcast(model(path))
    made = T.StructField("n_tokens", T.LongType()) if counts else T.StructField("ids", T.ArrayType(T.IntegerType()))
    rows = df.select(*keep, text)
    return rows.mapInArrow(lambda batches: _columns(batches, serialised, counts), T.StructType([*rows.schema.fields[:-1], made]))


def decoded(df: DataFrame, keep: list[str], path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """The columns ``keep`` with the text that ``ids`` stand for; a null list gives a null text."""
    tokens = df.sparkSession.sparkContext.broadcast(ranks(path))
    rows = df.select(*keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.__new__(Decoder)
        decoder.tokens = tokens.value
        for batch in batches:
            *kept, lists = batch.columns
            texts = [None if x is None else decoder.decode(x) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())]))
