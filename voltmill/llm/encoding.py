"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by forced boundaries.

A byte pair that stands inside no vocabulary token can never be merged, so every place where it occurs between two
characters is a certain cut. Fragments between cuts are encoded on their own, equal ones once per worker, and
concatenated. Cuts must also keep the way the vocabulary's pattern splits text. The pattern looks ahead only past white
space, and joins a character to what follows only within runs of one class, after a space, or after an apostrophe.
So a cut is made only

* behind a character that is not white space, and
* not in front of an apostrophe (which might begin a contraction on its own), and
* not inside a contraction.

Behind such a character a run that continues is matched by the same alternative from any start, and white space or
another class begins a new match anyway. The result therefore equals that of the undivided text, token by token.
"""

from __future__ import annotations

import base64
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files.
TOKENIZER_DIR = os.environ.get("VOLTMILL_TOKENIZERS", "/opt/tokenizers")
#: Fragments a worker remembers, and the longest it remembers in bytes.
CACHE_ENTRIES = 300_000
CACHE_BYTES = 64
#: Bytes of text cut at a time.
SLICE_BYTES = 1 << 20

# The splitting pattern of the vocabulary, its contractions, and the UTF-8 forms of white space beyond ASCII.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class ForcedBoundaryEncoder:
    """Encodes UTF-8 buffers of many texts at once."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken"):
        import tiktoken

        with open(os.path.join(folder, name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self._whole = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = np.zeros((256, 256), bool)
        for token in chain(ranks, (c.encode() for c in CONTRACTIONS)):
            for a, b in zip(token, token[1:]):
                joined[a, b] = True
        joined[:, ord("'")] = True
        joined[:, 0x80:0xC0] = True  # inside a character
        joined[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = True
        self._joined = joined
        self._spaces = [tuple(c.encode()) for c in WIDE_SPACES]
        self._known: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """True at each byte before which a cut is certain; the first byte never is one."""
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            cut[1:] = ~self._joined[data[:-1], data[1:]]
            for space in self._spaces:
                n = len(space)
                if len(data) > n:
                    at = np.flatnonzero(data[n - 1 : -1] == space[-1])
                    for k, byte in enumerate(space[:-1]):
                        at = at[data[at + k] == byte]
                    cut[at + n] = False
        return cut

    def _encode_fragment(self, fragment: bytes) -> list[int]:
        ids = self._whole.encode_ordinary(fragment.decode("utf-8", "replace"))
        if len(fragment) <= CACHE_BYTES:
            if len(self._known) >= CACHE_ENTRIES:
                self._known.clear()
            self._known[fragment] = ids
        return ids

    def encode(self, data: bytes, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[borders[i]:borders[i + 1]]``, concatenated, and their number per text."""
        ids, counts = [], np.zeros(len(borders) - 1, np.int64)
        first = 0
        while first < len(borders) - 1:
            last = max(first + 1, int(np.searchsorted(borders, borders[first] + SLICE_BYTES, side="right")) - 1)
            lo, hi = int(borders[first]), int(borders[last])
            if hi > lo:
                piece = data[lo:hi]
                cut = self.cuts(np.frombuffer(piece, np.uint8))
                inner = borders[first:last] - lo
                cut[inner[inner < hi - lo]] = True
                cut[0] = True
                start = np.flatnonzero(cut)
                ends = np.r_[start[1:], hi - lo].tolist()
                known, encode = self._known, self._encode_fragment
                lists = []
                for s, e in zip(start.tolist(), ends):
                    fragment = piece[s:e]
                    found = known.get(fragment)
                    lists.append(encode(fragment) if found is None else found)
                ids.append(np.fromiter(chain.from_iterable(lists), np.int32))
                per_fragment = np.fromiter(map(len, lists), np.int64, len(lists))
                owner = np.searchsorted(borders[first + 1 : last + 1] - lo, start, side="right")
                counts[first:last] = np.bincount(owner, per_fragment, minlength=last - first).astype(np.int64)
            first = last
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts


_ENCODERS: dict[tuple[str, str], ForcedBoundaryEncoder] = {}


def encoder(folder: str, name: str) -> ForcedBoundaryEncoder:
    """The worker's encoder, made once per vocabulary."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = ForcedBoundaryEncoder(folder, name)
    return _ENCODERS[folder, name]


def _texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a text column and the borders of its texts; null is as empty."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    borders = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    return (data.to_pybytes() if data is not None else b""), borders


def encode_texts(documents: DataFrame, text: str, ids: str, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``documents`` with the column ``ids``, the token ids of ``text`` without special tokens.

    Null and empty texts have the empty list. Strings that spell special tokens are ordinary text. All other columns
    and repeated rows are kept; a column already called ``ids`` is replaced.
    """
    kept = documents.drop(ids) if ids != text else documents
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):  # noqa: ANN001, ANN202
        own = encoder(folder, name)
        for batch in batches:
            data, borders = _texts(batch.column(text))
            flat, counts = own.encode(data, borders)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def count_tokens(documents: DataFrame, text: str, size: str, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``documents`` with ``size``, the number of token ids of ``text``, in place of the text."""
    kept = documents.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(size, T.LongType(), False)])

    def run(batches):  # noqa: ANN001, ANN202
        own = encoder(folder, name)
        for batch in batches:
            data, borders = _texts(batch.column(text))
            counts = own.encode(data, borders)[1]
            rest = [c for c, n in zip(batch.columns, batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64())], [*(n for n in batch.schema.names if n != text), size])

    return documents.mapInArrow(run, schema)
