"""Token ids of a public byte-level BPE vocabulary, one Arrow pass over the texts.

The pre-tokeniser's pattern looks ahead only to leave the last of several white
spaces to what follows. Texts are cut there instead, so a pattern without
look-ahead, which its engine runs much faster, gives the same ids.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Folder of the public vocabulary files; a parameter of every operator that tokenises.
VOCAB = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ``PATTERN`` for texts in which no white space is between another one and a non-space.
CUT_PATTERN = PATTERN.replace(r"|\s+(?!\S)", "")
# The engine's \s; Python's has four control characters besides.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_cuts = re.compile(f"[{_SPACE}](?=[{_SPACE}][^{_SPACE}])").finditer
_workers: dict[str, "Encoder"] = {}


class Encoder:
    """``pack(text)``: the ids as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.size = max(ranks.values()) + 1
        self.width = 2 if self.size < 65535 else 4
        self.end = self.size  # id after the vocabulary, free for an end-of-document mark
        self._kind = np.dtype(f"<u{self.width}")
        self._name, self._ranks = os.path.basename(path), ranks
        self._plain = self._encoding(CUT_PATTERN).encode_ordinary

    def _encoding(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding(self._name, pat_str=pattern, mergeable_ranks=self._ranks, special_tokens={})

    @cached_property
    def encoding(self):
        """The vocabulary's encoding with the whole pattern."""
        return self._encoding(PATTERN)

    def pack(self, text: str) -> bytes:
        ids, at = [], 0
        for cut in _cuts(text):
            ids += self._plain(text[at : cut.end()])
            at = cut.end()
        ids += self._plain(text[at:])
        return np.asarray(ids, dtype=self._kind).tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, read once for each Python worker."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def with_ids(docs: DataFrame, text: str = "text", vocab: str = VOCAB, ids: str = "ids") -> DataFrame:
    """All columns but ``text``, and ``ids`` (packed little-endian, 2 bytes an id below 65,535 ids, else 4) and ``n_tokens``.

    A null text has null ids and 0 tokens; an empty text has empty ids.
    """
    from pyspark.sql import types as T

    keep = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in keep]

    def run(batches):
        enc = encoder(vocab)
        for b in (part for whole in batches for part in slices(whole, text)):
            packed = [None if t is None else enc.pack(t) for t in b.column(text).to_pylist()]
            n = [0 if p is None else len(p) // enc.width for p in packed]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(packed, pa.binary()), pa.array(n, pa.int64())], names=[*names, ids, "n_tokens"]
            )

    return docs.mapInArrow(run, schema)
