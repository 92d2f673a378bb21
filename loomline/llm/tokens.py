"""Token ids of the public byte-level BPE, as bytes.

The vocabulary is read by name through ``public_tokenizers.path`` (``location`` overrides it) and never copied. The
same vocabulary as ranks is encoded by the faster of the two libraries. The other one, which gives the same ids, encodes
texts that hold the special token's string, which it reads as one token, and texts with very long runs of white space,
on which the faster one overflows its stack.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

BYTE_BPE = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Runs of white space from this length on don't go through the faster library, which fails between 300,000 and 1,000,000.
RUN = 20_000
_LONG_RUN = re.compile(rf"\s{{{RUN}}}")


@lru_cache(maxsize=4)
def encoder(vocabulary: str = BYTE_BPE, location: str | None = None) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers, without added special tokens."""
    import public_tokenizers
    import tiktoken

    def path(name: str) -> str:
        return f"{location}/{name}" if location else public_tokenizers.path(name)

    with open(path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> bytes:
        if SPECIAL not in text and not (len(text) >= RUN and _LONG_RUN.search(text)):
            return array("I", fast.encode_ordinary(text)).tobytes()
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path(f"{vocabulary}.json")))
        return array("I", slow[0].encode(text, add_special_tokens=False).ids).tobytes()

    return encode
