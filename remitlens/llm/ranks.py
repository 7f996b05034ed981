"""Byte-pair encoders from rank files, and the places where a text may be cut.

A cut between two characters is *fixed* when no match of the split pattern can
hold both: after a letter before a non-letter, after a digit before a non-digit,
or before white space after anything else. Matches are found from left to right
without memory, so the tokens on either side of a fixed cut are those of the two
parts encoded alone, whatever stands further away.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache
from unicodedata import category

import numpy as np

_ASCII_SPACE = frozenset("\t\n\v\f\r ")
_TWO_SPACES = re.compile(r"\s\s|[\x1c-\x1f\x85]")


def file_of(vocabulary: str) -> str:
    """An absolute path as it is; a bare name is looked up on the worker itself."""
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def fixed_cut(text: str, at: int) -> bool:
    """Whether tokens never span position ``at``; the two ends count as cuts."""
    if at <= 0 or at >= len(text):
        return True
    left, right = category(text[at - 1])[0], category(text[at])[0]
    space = right == "Z" or text[at] in _ASCII_SPACE
    if left == "L":
        return space or right in "NPS"
    if left == "N":
        return space or right in "LPS"
    return left in "PS" and (space or right == "N")


def cut_before(text: str, at: int, least: int) -> int | None:
    """The last fixed cut in ``[least, at]``."""
    return next((q for q in range(at, least - 1, -1) if fixed_cut(text, q)), None)


def cut_after(text: str, at: int, most: int) -> int | None:
    """The first fixed cut in ``[at, most]``."""
    return next((q for q in range(at, most + 1) if fixed_cut(text, q)), None)


class RankEncoder:
    """``encode`` gives the ids of a text; ``lengths`` the bytes of each id.

    The pattern's look-ahead only matters where two white-space characters meet.
    Texts without such a place take a pattern without it, which the same library
    runs faster, with the same matches.
    """

    def __init__(self, vocabulary: str, specials: tuple[tuple[str, int], ...] = ()):
        import public_tokenizers
        import tiktoken

        with open(file_of(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.specials = dict(specials)
        self.exact = tiktoken.Encoding(
            "exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.specials
        )
        self.plain = tiktoken.Encoding(
            "plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(1 + max([*ranks.values(), *self.specials.values()]), np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        for token, rank in self.specials.items():
            self.lengths[rank] = len(token.encode())

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.specials):
            return self.exact.encode(text, allowed_special="all")
        if _TWO_SPACES.search(text):
            return self.exact.encode_ordinary(text)
        return self.plain.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.exact.decode_bytes(ids)

    def inside_special(self, text: str, at: int) -> bool:
        """Whether a special string holds both characters beside ``at``."""
        for s in self.specials:
            found = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
            if 0 <= found < at < found + len(s):
                return True
        return False


@lru_cache(maxsize=4)
def encoder(vocabulary: str, specials: tuple[tuple[str, int], ...] = ()) -> RankEncoder:
    """One encoder per Python worker and vocabulary."""
    return RankEncoder(vocabulary, specials)
