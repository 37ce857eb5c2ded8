"""Token ids by a public tokenizer, with bounded caches of words."""

from __future__ import annotations

import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Separators of str.split() that are no white space for the tokenizer.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: Words of these characters only are cut into pieces here, others by the tokenizer.
_SIMPLE = re.compile(r"(?:[!-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ĩı-ɏ–-„€])+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Special tokens begin so.
_SPECIAL = "<|"
#: Most cached words, some 200 bytes each; a task lets them go at its end, for Spark uses its worker again.
CACHED_WORDS = 600_000


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones are themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens:
    """Ids of a lower-casing word tokenizer, as little-endian unsigned 32-bit bytes.

    White space only parts words for this kind of tokenizer, so the ids of a
    text are those of its words. Words and their pieces, which are words too,
    are cached in two generations: once the younger fills its half it becomes
    the elder, and the elder goes.
    """

    _made: dict[str, WordTokens] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def clear(self) -> None:
        """Lets all cached words go."""
        self.young, self.old = {}, {}

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            mapped = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = _packed([t.id for t in self.model.tokenize(mapped)])
        self.young[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._piece(word.lower())
        if _SPECIAL in word or not _SIMPLE.fullmatch(word):
            return self._whole(word)
        return b"".join(map(self._piece, _PIECE.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _ODD_SPACES):
            return self._whole(text)
        words = text.split()
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:
            if len(self.young) >= CACHED_WORDS // 2:
                self.young, self.old = {}, self.young
            young, old = self.young, self.old
            for w in set(words).difference(young):
                ids = old.get(w)
                young[w] = self._word(w) if ids is None else ids
            return b"".join(map(young.__getitem__, words))
