"""Subword ids by a public vocabulary file (never trained here, never copied here)."""

from __future__ import annotations

import base64
from functools import lru_cache

#: The public split pattern that belongs to the vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Id that ends a document; the vocabulary leaves it free.
END = 50_256


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
