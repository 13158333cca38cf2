"""Token ids of texts by the public byte-level vocabulary, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Ends every document in packed and flat streams.
END = 0
MARK = "<|endoftext|>"
#: Beyond these letters the two libraries may split words by different Unicode tables.
FAR = re.compile("[^\x00-ɏ]")


class Encoder:
    """Ids of the ``tokenizers`` vocabulary file, computed by the faster of two libraries.

    ``tiktoken`` holds the same merges as ranks and gives the same ids for plain
    text of Latin letters; other texts, and texts with the special token's
    string, go through ``tokenizers`` itself, as do texts whose runs of white
    space are too long for the other's regular expressions. Without ``special``
    that string is ordinary text.
    """

    def __init__(self, vocabulary: str = VOCABULARY, special: bool = True):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = public_tokenizers.path(f"{vocabulary}.json")
        self.exact = None
        self.special = special

    def __call__(self, text: str) -> np.ndarray:
        if not (FAR.search(text) or (self.special and MARK in text)):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its backtracking is bounded: too much white space in a row
                pass
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.file)
            self.exact.encode_special_tokens = not self.special
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
