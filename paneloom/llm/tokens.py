"""Encoding of texts with a public byte-level BPE tokenizer, and back.

Arrow batches go to the ``tokenizers`` library in the executors. Byte-level BPE never merges across the tokenizer's
pre-tokens, so plain texts are cut with the tokenizer's own pattern and each distinct pre-token is encoded once for a
worker; texts with characters outside the plain sets, and all texts of a tokenizer that normalises or cuts in another way,
go to the library whole. The tokenizer file is a parameter and must be readable at the same path on every executor:
``.json`` (tokenizers), ``.tiktoken`` (ranks) or ``.model`` (sentencepiece).
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of pre-tokens and ids that a worker remembers before it starts anew, and characters of the longest one that it
#: remembers; bounds on memory, not on results.
REMEMBERED, LONGEST = 32 << 20, 64


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Lists of texts to lists of ids by the file's own library."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1) if texts else []
    return lambda texts: [e.ids for e in load(path).encode_batch(texts, add_special_tokens=False)]


class _Remembered(dict):
    """Pre-token -> ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]) -> None:
        super().__init__()
        self.encode, self.size = encode, 0

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode([piece])[0]
        if len(piece) <= LONGEST:
            self.size += 200 + len(piece) + 8 * len(ids)
            if self.size > REMEMBERED:
                self.clear()
                self.size = 0
            self[piece] = ids
        return ids


@lru_cache(maxsize=16)
def _cuts_as_here(path: str) -> bool:
    """Whether the file's tokenizer is byte-level BPE that leaves texts as they are and cuts them by the pattern below."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    cut, model = own.get("pre_tokenizer") or {}, own["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(plain and not own.get("normalizer") and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))


# The tokenizer's pattern over texts whose letters are ASCII or CJK ideographs and whose numbers are ASCII digits.
_L = "A-Za-z一-龥"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r -~一-龥、。《》“”，；：？！（）]*").fullmatch


@lru_cache(maxsize=4)
def _remembered(path: str) -> _Remembered | None:
    """None where every text is the library's."""
    return _Remembered(_encoder(path)) if _cuts_as_here(path) else None


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text without special tokens; strings that look like special tokens are ordinary text; empty and null give []."""
    known = _remembered(path)
    out: list[list[int]] = [[]] * len(texts)
    odd = []
    for i, text in enumerate(texts):
        if text:
            if known is not None and _PLAIN(text):
                out[i] = list(chain.from_iterable(map(known.__getitem__, _PIECES.findall(text))))
            else:
                odd.append(i)
    for i, ids in zip(odd, _encoder(path)([texts[i] for i in odd])):
        out[i] = ids
    return out


def _lists(rows: list) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int32, len(rows))
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(np.concatenate([[0], sizes.cumsum()]).astype(np.int32), flat)


def encoded(df: DataFrame, text: str, keep: list[str], path: str | None = None, ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``ids`` (list of integers), one row for each row of ``df``, in narrow scans without a shuffle."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # very long texts: little in memory at a time
                part = batch.slice(at, 1000)
                rows = encode_texts(part.column(text).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _lists(rows)], names=[*keep, ids])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def encoded_with_offsets(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """``ids`` with ``starts`` and ``ends``: for each token the code points of the text that it covers, end excluded. A
    character that is split over several tokens belongs to each of them. Empty and null texts have empty lists. Only
    ``.json`` files have offsets."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = tokenizer.encode_batch([t or "" for t in part.column(text).to_pylist()], add_special_tokens=False)
                spans = [e.offsets for e in found]
                lists = [_lists([e.ids for e in found]), _lists([[a for a, _ in s] for s in spans]), _lists([[b for _, b in s] for s in spans])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *lists], names=[*keep, "ids", "starts", "ends"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, ints) for c in ("ids", "starts", "ends"))])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the rest
    in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of byte-level vocabulary."""
    if path.endswith(".tiktoken"):
        ranks = _ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        return table
    back = byte_characters()
    vocab = load(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def decode_ids(ids: list[int] | None, path: str) -> str:
    """The text of a whole list of ids. Bytes are joined before they are read as UTF-8, so that split characters come back;
    bytes that are no UTF-8, as in a cut list, become U+FFFD. Tokenizers that are not byte-level throughout are left to their
    library, and don't give back what they normalise away."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).decode(list(ids or []))
    if path.endswith(".json") and not _cuts_as_here(path):
        return load(path).decode(list(ids or []), skip_special_tokens=False)
    table = token_bytes(path)
    return b"".join(table[i] for i in ids or []).decode("utf-8", errors="replace")


def decoded(df: DataFrame, ids: str, keep: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` and the text of each list of ids; a null list gives the empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode_ids(x, path) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, text])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])
    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
