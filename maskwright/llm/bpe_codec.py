"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they reach the library, only where the split pattern has a boundary whatever stands
around: before white space that follows another character, and between letters and numbers. The pieces'
ids in order are the ids of the whole text, and memory and the library's regex stack stay bounded by the
piece (or by one unbroken run of a single class, which is one pre-token and cannot be cut). A very long run of white space is one pre-token too, all but its last character
if another character follows, and goes to the library's merges by itself, past the regex.

Decoding concatenates the ranks' raw bytes, so ids that end inside a UTF-8 character decode as well.
Null and empty texts have no ids; decoding no ids gives no bytes. Repeated rows are encoded once each.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table

PIECE = 1 << 16
#: The library's regex stack overflows on white space far longer than this; such a run is encoded by itself.
LONG_SPACE = 1 << 12


class Codec:
    def __init__(self, path: str, pattern: str, piece: int = PIECE):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.border = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
        self.run_of_space = regex.compile(r"\s{%d,}" % LONG_SPACE)
        self.piece = piece

    def pieces(self, text: str):
        at = 0
        while len(text) - at > self.piece:
            found = self.border.search(text, at + self.piece)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE:
            return self.library.encode_ordinary(text)
        ids, at = [], 0
        for run in self.run_of_space.finditer(text):
            # The pattern leaves the run's last character to what follows, if anything does.
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self._encode_pieces(text[at : run.start()]) + self.library._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self._encode_pieces(text[at:])

    def _encode_pieces(self, text: str) -> list[int]:
        if len(text) <= self.piece:
            return self.library.encode_ordinary(text)
        return [i for piece in self.pieces(text) for i in self.library.encode_ordinary(piece)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def listing(self, ids) -> bytes:
        return ",".join(map(self.decimal.__getitem__, ids)).encode()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """Built once in each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    import pyarrow as pa

    def run(batches):
        c = codec(path, pattern)
        for part in blocks(batches, "text", 1 << 20):
            ids = [c.encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (binary) of every row; null ids give no bytes."""
    import pyarrow as pa

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            data = [c.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(encoded.dtypes)[id_col]}, data binary")


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import pyarrow as pa

    def run(batches):
        c = codec(path, pattern)
        for part in blocks(batches, "text", 1 << 20):
            n, first, second = [], [], []
            for text in part.column("text").to_pylist():
                ids = c.encode(text)
                n.append(len(ids))
                first.append(hashlib.sha256(c.listing(ids)).hexdigest())
                second.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
