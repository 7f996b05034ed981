"""Ids of the tokenizers library, one distinct word at a time.

The vocabulary this is made for replaces white space by a space and then drops it, so
no token, no special string and no composed character reaches over white space: the
ids of a text are those of its words one after the other. Texts are split as a column, in
ASCII lower case (as the library lowers them) and with a space between a Latin letter
and a sign that follows it (the library parts them as well), so few words differ. Each
worker asks the library once per distinct word and keeps the answers in arrays of a
bounded size. Of words in Latin letters, digits and signs it asks the library's model once
per distinct run of letters or signs, which the library would keep apart too. Texts that
may hold a special string, or an information separator, which part words for the splitter
but not for the library, go to the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .ranks import file_of

_WHOLE = "[\x1c-\x1f]|<[|]"
#: Letters that stay one composed letter when lower-cased.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Words of letters, digits and signs; an apostrophe may begin a contraction.
_PLAIN = re.compile(rf"[!-&(-~{_LETTERS}]+")
_LETTER_RUN = re.compile(rf"[{_LETTERS}]+")
_RUNS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_SIGN_AFTER = rf"([{_LETTERS}])([.,;:!?])"
#: Words, runs, and code points of words kept per worker before it starts anew (about 200 MB).
MOST_WORDS, MOST_RUNS, MOST_CHARS = 1 << 20, 1 << 15, 1 << 24
#: Bytes of a text that are split at once.
PIECE = 1 << 22
_GAP = re.compile(r"[ \n]")


def _byte_signs() -> dict[int, str]:
    """The sign that the byte-level vocabulary writes for each byte: itself if it is visible, else the next free one."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _written(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` from ``at`` on, of twice the size if it is too small."""
    if at + len(new) > len(held):
        held = np.concatenate([held, np.zeros(max(len(held), len(new)), held.dtype)])
    held[at : at + len(new)] = new
    return held


class _Numbered(dict):
    """Numbers words from 0 as they are first asked for; ``new`` are those not yet learned."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """``end`` is the id that ends every text, if one does."""

    def __init__(self, vocabulary: str, end: int | None = None, most: int = MOST_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file_of(vocabulary))
        self.model = self.library.model
        self.signs = _byte_signs()
        self.end = end
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.place = _Numbered()
        self.runs: dict[str, bytes] = {}
        self.used = self.chars = 0
        self.flat = np.zeros(1 << 16, "<u4")
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)

    def _tokens(self, run: str) -> bytes:
        signs = run if run.isascii() else "".join(map(self.signs.__getitem__, run.encode()))
        return _packed([t.id for t in self.model.tokenize(signs)])

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) >= MOST_RUNS:
                self.runs.clear()
            ids = self.runs[run] = self._tokens(run)
        return ids

    def _asked(self, words: list[str]) -> list[bytes]:
        found = [
            self._tokens(w.lower()) if _LETTER_RUN.fullmatch(w)
            else b"".join([self._run(run) for run in _RUNS.findall(w.lower())]) if _PLAIN.fullmatch(w)
            else None
            for w in words
        ]
        odd = [k for k, ids in enumerate(found) if ids is None]
        for k, got in zip(odd, self.library.encode_batch_fast([words[k] for k in odd], add_special_tokens=False)):
            found[k] = _packed(got.ids)
        return found

    def _learn(self) -> None:
        words, self.place.new = self.place.new, []
        found = self._asked(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        n = len(self.place) - len(words)
        self.flat = _written(self.flat, self.used, ids)
        self.starts = _written(self.starts, n, self.used + np.cumsum(sizes) - sizes)
        self.sizes = _written(self.sizes, n, sizes)
        self.used += len(ids)
        self.chars += sum(map(len, words))

    def _spelled(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts`` without special strings or separators, and where each text's ids end."""
        if len(self.place) > self.most or self.chars > MOST_CHARS:
            self._clear()
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _SIGN_AFTER, r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.array(list(map(self.place.__getitem__, distinct)), np.int64)
        if self.place.new:
            self._learn()
        at = known[coded.indices.to_numpy()]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[at] - (ends - sizes), sizes)
        shift += np.arange(len(shift))
        n_words = np.cumsum(pc.list_value_length(lists).to_numpy())
        return self.flat[shift], np.append(0, ends)[n_words]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _long(self, text: str) -> np.ndarray:
        """A long text, cut where white space stands."""
        parts, start = [], 0
        while start < len(text):
            gap = _GAP.search(text, start + PIECE)
            stop = gap.start() if gap else len(text)
            parts.append(self._spelled(pa.array([text[start:stop]]))[0])
            start = stop
        return np.concatenate(parts)

    def encode_all(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts`` (unsigned 32-bit) in one run, and where each text's ids end.

        No special tokens are added, but for the ``end`` of each text. A null is an empty text.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.fill_null("")
        apart = pc.or_(pc.match_substring_regex(texts, _WHOLE), pc.greater(pc.binary_length(texts), PIECE))
        ids, ends = self._spelled(pc.if_else(apart, "", texts))
        if pc.any(apart).as_py():
            cuts, parts = np.append(0, ends), []
            for k, one in enumerate(apart.to_pylist()):
                text = texts[k].as_py() if one else ""
                ask = self._whole if re.search(_WHOLE, text) else self._long
                parts.append(ask(text) if one else ids[cuts[k] : cuts[k + 1]])
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        if self.end is None:
            return ids, ends
        return np.insert(ids, ends, self.end), ends + np.arange(1, len(ends) + 1)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def word_encoder(vocabulary: str, end: int | None = None) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    return WordEncoder(vocabulary, end)
