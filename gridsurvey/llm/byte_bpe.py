"""Byte-level BPE with the tokenizers library over Arrow batches.

The rank file is read once on the driver and turned into a tokenizers model
whose symbols are one character per byte. In a task a text is split by the
pattern, pieces not seen before go through the library in one call per batch,
and a document's ids are the ids of its pieces joined. Ids are kept as token
files keep them: little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces a task remembers before it starts anew (about 100 MB), and the longest piece worth remembering.
CACHED_PIECES, CACHED_CHARS = 400_000, 40


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable bytes as they are, the rest from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build_model(ranks: dict[bytes, int]) -> str:
    """The tokenizers model of a rank file, as JSON.

    A rank file lets any two neighbours merge whose bytes together are a
    token, so each split of a token into two tokens becomes a merge with the
    token's rank.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    of = byte_characters()
    spelled = {token: "".join(of[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = ((token[:i], token[i:]) for i in range(1, len(token)))
        known = sorted((ranks[a], ranks[b], a, b) for a, b in halves if a in ranks and b in ranks)
        merges += [(spelled[a], spelled[b]) for _, _, a, b in known]
    model = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return model.to_str()


def token_bytes(model) -> dict[int, bytes]:
    """The bytes of each id, by the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_characters())}
    return {i: bytes(back[c] for c in token) for token, i in model.get_vocab().items()}


def character_offsets(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; a token inside a character has that character's span."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    of_byte = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return of_byte[ends - lengths[ids]].astype("<u4"), (of_byte[ends - 1] + 1).astype("<u4")


class Encoder:
    """Encodes texts in one task."""

    def __init__(self, model_json: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model_json)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        table = token_bytes(self.model)
        self.lengths = np.zeros(max(table, default=0) + 1, np.int64)
        for i, token in table.items():
            self.lengths[i] = len(token)

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        known = self.known
        new = list({p for pieces in split for p in pieces if p not in known})
        found = self.model.encode_batch_fast(new, add_special_tokens=False)
        ids = {p: struct.pack(f"<{len(i)}I", *i) for p, i in zip(new, (e.ids for e in found), strict=True)}
        known.update(ids)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for p in ids:
            if len(p) > CACHED_CHARS:
                del known[p]
        return out


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = True) -> DataFrame:
    """(id, ids, starts, ends): the ids of each text and the characters each covers, as packed 32-bit integers.

    Each match of ``pattern`` is encoded by itself and no special token is
    added. A null text counts as empty; an empty text has no ids. Null and
    repeated ids are passed on, other columns are not. Without ``offsets``
    there are only the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_model(read_ranks(ranks_path)))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for whole in batches:
            for batch in _slices(whole):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = encoder.batch(texts)
                columns = [batch.column(0), pa.array(ids, pa.binary())]
                if offsets:
                    spans = [character_offsets(t, np.frombuffer(i, "<u4"), encoder.lengths) for t, i in zip(texts, ids, strict=True)]
                    columns += [pa.array([s[k].tobytes() for s in spans], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "ids", "starts", "ends"] if offsets else ["doc_id", "ids"]
    schema = f"doc_id {kind}" + "".join(f", {n} binary" for n in names[1:])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data): the bytes that the ids stand for.

    Ids cut out of a text may start or end inside a character; ``data`` then
    has only some of its bytes, and ``decoded_text`` shows what is incomplete
    as U+FFFD. Null ids count as none. An id that the ranks lack is an error.
    """
    model = build_model(read_ranks(ranks_path))
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        of = token_bytes(Tokenizer.from_str(shared.value)).__getitem__
        for whole in batches:
            for batch in _slices(whole):
                packed = [i or b"" for i in batch.column(1).to_pylist()]
                data = [b"".join(map(of, np.frombuffer(i, "<u4").tolist())) for i in packed]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, data binary")


def decoded_text(data):
    """Column of text for a column of decoded bytes; incomplete characters show as U+FFFD."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def to_text(values):
        return values.map(lambda v: v.decode("utf-8", "replace"), na_action="ignore")

    return to_text(data)
