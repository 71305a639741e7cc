"""Byte-level BPE ids of texts, shared by the operators that count, pack or
align tokens."""

from __future__ import annotations

import base64
from collections.abc import Callable

import public_tokenizers

VOCABULARY = "byte_bpe_50k"
END_OF_TEXT = "<|endoftext|>"
# a run of blanks longer than this overflows the stack of tiktoken's pattern
MAX_BLANKS = 100_000


def vocabulary_bytes(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The ids of the vocabulary by their bytes, special tokens excepted."""
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _longest_blanks(text: str) -> bool:
    """Whether a run of blanks may be longer than MAX_BLANKS: a text of more
    characters than that is cut in stretches of half the length, one of which
    lies wholly inside such a run."""
    half = MAX_BLANKS // 2
    return len(text) > MAX_BLANKS and any(text[k:k + half].isspace() for k in range(0, len(text), half))


def byte_bpe(vocabulary: str = VOCABULARY, special: bool = True) -> Callable[[str], list[int]]:
    """The ids of a text as ``tokenizers`` gives them from
    ``<vocabulary>.json`` without adding special tokens.  With ``special`` the
    string of the end token inside a text is that token (the library's
    default), else plain text.  tiktoken reads the same vocabulary and gives
    the same ids several times faster; texts with blanks beyond its stack go
    to ``tokenizers`` itself."""
    import tiktoken
    ranks = vocabulary_bytes(vocabulary)
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={END_OF_TEXT: len(ranks)})
    exact = []

    def slow(text: str) -> list[int]:
        if not exact:
            from tokenizers import Tokenizer
            exact.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            exact[0].encode_special_tokens = not special
        return exact[0].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if _longest_blanks(text):
            return slow(text)
        if special and END_OF_TEXT in text:
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)
    return encode
