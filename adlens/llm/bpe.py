"""Byte-level BPE encoding and decoding (operator 10).

Every text is encoded by the tiktoken library from a local rank file, and the
ids are decoded back to raw bytes. The rank file (under 1 MB) is read once on
the driver and broadcast, so executors need no copy of it.

Long texts are cut before encoding, only at places where the splitting
pattern always starts a new match, so the ids equal those of the whole text:

* before an ASCII blank, tab or line end that follows a letter, digit or mark
  of ASCII (no alternative of the pattern runs from such a character into
  white space, and none looks back);
* between an ASCII letter and an ASCII digit, either way round.

A long text without such a place stays one piece.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; repeated rows give repeated results; an empty table
gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import by_size, ready

_SAFE = regex.compile(r"(?<=[!-~])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_ENCODERS: dict[str, tiktoken.Encoding] = {}  # one per worker process and rank file


def load_ranks(path: str) -> bytes:
    """The rank file's content: lines of ``base64(token) rank``."""
    with open(path, "rb") as f:
        return f.read()


def encoder(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, rank_file.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks-" + key[:8], pat_str=pattern, mergeable_ranks=ranks,
                                           special_tokens={})
    return _ENCODERS[key]


def token_sizes(rank_file: bytes) -> np.ndarray:
    """The bytes of every token, by rank."""
    ranks = {int(rank): len(base64.b64decode(tok)) for tok, rank in map(bytes.split, rank_file.splitlines())}
    sizes = np.zeros(max(ranks) + 1, np.int64)
    sizes[list(ranks)] = list(ranks.values())
    return sizes


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters or a little more, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, piece_chars: int = 1 << 16) -> np.ndarray:
    """Ids of the whole text as little-endian unsigned 32-bit integers."""
    parts = [np.frombuffer(array("I", enc.encode_ordinary(p)), dtype=np.uint32).astype("<u4", copy=False) for p in safe_pieces(text, piece_chars)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_ids(enc: tiktoken.Encoding, packed: bytes) -> bytes:
    return enc.decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())


def _with_columns(df: DataFrame, of: str, outs: list[str], make) -> DataFrame:
    """``df`` with the binary columns ``outs``, which ``make()`` computes from each value of column ``of``."""
    base = ready(df).drop(*(c for c in outs if c != of))
    schema = base.schema
    at_col = schema.names.index(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in by_size(batches, of):
            values = zip(*[f(x.as_py()) for x in b.column(at_col)])
            yield pa.record_batch([*b.columns, *(pa.array(v, pa.binary()) for v in values)], names=[*schema.names, *outs])

    out = type(schema)(list(schema.fields))
    for c in outs:
        out = out.add(c, "binary")
    return base.mapInArrow(run, out)


def encode(docs: DataFrame, *, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "ids",
           decoded_col: str | None = None, piece_chars: int = 1 << 16) -> DataFrame:
    """``docs`` with ``out_col``: each text's ids, packed as little-endian uint32; with ``decoded_col`` also the
    raw bytes that these ids decode to, in the same pass. Columns of these names are replaced."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))

    def make():
        enc = encoder(ranks.value, pattern)

        def both(text: str | None) -> tuple[bytes, ...]:
            ids = encode_text(enc, text or "", piece_chars).tobytes()
            return (ids, decode_ids(enc, ids)) if decoded_col else (ids,)
        return both

    return _with_columns(docs, text_col, [out_col, decoded_col] if decoded_col else [out_col], make)


def decode(tokens: DataFrame, *, rank_path: str, pattern: str, ids_col: str = "ids",
           out_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``out_col``: the raw bytes that the packed ids stand for
    (null for null ids). A column of that name is replaced."""
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(rank_path))

    def make():
        enc = encoder(ranks.value, pattern)
        return lambda ids: (None if ids is None else decode_ids(enc, ids),)

    return _with_columns(tokens, ids_col, [out_col], make)


def token_digests(docs: DataFrame, *, rank_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both: ``id, n_tokens, ids_sha256, decoded_sha256``."""
    both = encode(docs.select(id_col, text_col), rank_path=rank_path, pattern=pattern, text_col=text_col,
                  decoded_col="decoded")
    return both.select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
