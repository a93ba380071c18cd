"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .textkit import slices

#: Pre-tokenisation pattern that goes with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_RANK_BYTES = 64 << 20  #: a rank file is sent to the workers only up to this size
PIECE_CHARS = 1 << 15  #: longer texts are cut at safe boundaries about this far apart

#: No piece of PATTERN crosses these places, and none looks ahead across them:
#: where white space begins, and where a run of letters or of digits ends.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")


def read_ranks(path: str) -> bytes:
    """The rank file's content, its size checked."""
    if os.path.getsize(path) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """An encoder without special tokens from the content of a rank file."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries so that encoding the pieces gives the tokens of the whole.

    A run without any safe boundary (one giant word) stays in one piece.
    """
    at, n = 0, len(text)
    while n - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """Token ids of one text as int32."""
    if len(text) <= size:
        return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()).astype(np.int32) for p in safe_pieces(text, size)])


def encode(spark: SparkSession, docs: DataFrame, *, rank_file: str = RANK_FILE, pattern: str = PATTERN, doc_id: str = "doc_id",
           text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Encode every text and prove the round trip.

    Returns ``doc_id``, ``token_ids`` (array<int>), ``n_tokens``, ``n_bytes``
    (UTF-8) and ``round_trip`` (the tokens' raw bytes equal the text's bytes).
    A null text gives null in all four; an empty text gives no tokens and
    true.  Very long texts are encoded whole, piece by piece.  Special-token
    strings in a text are ordinary text.  Ids of any type, null and repeated
    ones too, pass through row by row; an empty table gives an empty result;
    further columns are ignored, whatever their names.  One narrow map:
    nothing is shuffled.
    """
    shared = spark.sparkContext.broadcast(read_ranks(rank_file))
    schema = pa.schema([("doc_id", docs_type(docs, doc_id)), ("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()),
                        ("n_bytes", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids, count, size, same = [], [], [], []
                for t in part.column(1).to_pylist():
                    if t is None:
                        ids.append(None), count.append(None), size.append(None), same.append(None)
                        continue
                    got, raw = encode_text(enc, t, piece_chars), t.encode()
                    ids.append(got), count.append(len(got)), size.append(len(raw))
                    same.append(enc.decode_bytes(got.tolist()) == raw)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                ends = np.cumsum([0 if c is None else c for c in count])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([c is None for c in count] + [False]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(count, pa.int32()),
                     pa.array(size, pa.int64()), pa.array(same, pa.bool_())], schema=schema)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, token_ids array<int>, n_tokens int, n_bytes bigint, round_trip boolean")


def decode(spark: SparkSession, tokens: DataFrame, *, rank_file: str = RANK_FILE, pattern: str = PATTERN, doc_id: str = "doc_id",
           token_ids: str = "token_ids") -> DataFrame:
    """Decode token ids to raw bytes: ``doc_id``, ``raw`` (binary) and ``text``.

    ``text`` is null where the bytes are not valid UTF-8 (a token sequence may
    end inside a character); a null list gives nulls, an empty one an empty
    text; an unknown token raises.  Ids pass through row by row; an empty
    table gives an empty result; further columns are ignored.
    """
    shared = spark.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [None if x is None else enc.decode_bytes(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(raw, pa.binary()), pa.array([_text(x) for x in raw], pa.string())], names=["doc_id", "raw", "text"])

    kind = tokens.schema[doc_id].dataType.simpleString()
    return tokens.select(tokens[doc_id].alias("doc_id"), tokens[token_ids].alias("token_ids")).mapInArrow(
        run, f"doc_id {kind}, raw binary, text string")


def _text(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def docs_type(docs: DataFrame, column: str) -> pa.DataType:
    """Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)
