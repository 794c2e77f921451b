"""Encoding of whole texts with the ``tokenizers`` library, one new pre-token at a time.

Byte-level BPE never merges over pre-token borders, so the ids of a text are the ids of its
pre-tokens in order. Where single spaces separate pieces that neither begin nor end with white space,
a pre-token border lies before each space whatever surrounds it; such a text is split at its spaces
and each piece's ids are looked up in a cache. Other texts, and pieces with white space inside, are
cut by the pre-tokenizer's pattern. Ids of new pre-tokens are made by the library's model. A text that
holds one of the tokenizer's added tokens is encoded by the library itself.
The cache lives as long as the Python worker and is emptied at ``CACHE_PIECES`` entries.
"""

from __future__ import annotations

import re

import public_tokenizers
import regex
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
CACHE_PIECES = 1_200_000
LONG = 64  # longer pieces are not kept
# Unicode's White_Space property.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_MARKS = frozenset(".,;:!?")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self._library = Tokenizer.from_file(path)
        self._tokenize = self._library.model.tokenize
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._letters = _byte_alphabet()
        self._spaced: dict[str, bytes] = {}  # ids of a space and the key
        self._plain: dict[str, bytes] = {}  # ids of the key itself

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self._tokenize(mapped)])

    def _keep(self, cache: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(key) < LONG:
            if len(self._spaced) + len(self._plain) >= CACHE_PIECES:
                self._spaced.clear()
                self._plain.clear()
            cache[key] = ids
        return ids

    def _pre_token(self, word: str) -> bytes:
        """Ids of a pre-token from the cache that its first character decides."""
        cache, key = (self._spaced, word[1:]) if word[0] == " " and not word[1:2].isspace() and len(word) > 1 else (self._plain, word)
        found = cache.get(key)
        return self._keep(cache, key, self._word(word)) if found is None else found

    def _new(self, piece: str) -> bytes:
        """Ids of a space and a piece that is not in the cache."""
        if piece.isalpha():
            return self._keep(self._spaced, piece, self._word(" " + piece))
        if piece[-1] in _MARKS and piece[:-1].isalpha():
            return self._keep(self._spaced, piece, self._pre_token(" " + piece[:-1]) + self._pre_token(piece[-1]))
        if "\n" in piece:  # hardly ever seen twice
            return self._cut(" " + piece)
        return self._keep(self._spaced, piece, self._cut(" " + piece))

    def _cut(self, text: str) -> bytes:
        """Ids of any text, by the pattern."""
        out = []
        for chunk in CHUNK.findall(text):
            body = chunk[1:] if chunk[0] == " " else chunk
            cache, key = (self._spaced, body) if chunk[0] == " " and body and not body[0].isspace() else (self._plain, chunk)
            ids = cache.get(key)
            if ids is None:
                ids = self._keep(cache, key, b"".join([self._pre_token(w) for w in _PRE_TOKEN.findall(chunk)]))
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null is the empty text."""
        if not text:
            return b""
        for added in self._added:
            if added in text:
                return b"".join([i.to_bytes(4, "little") for i in self._library.encode(text, add_special_tokens=False).ids])
        pieces = text.split(" ")
        first = pieces[0]
        if not first or first[0].isspace() or first[-1].isspace():
            return self._cut(text)
        found = list(map(self._spaced.get, pieces))
        found[0] = self._cut(first)
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    piece = pieces[at]
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        return self._cut(text)
                    found[at] = self._new(piece)
        return b"".join(found)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder for a public tokenizer file (a name of ``public_tokenizers`` or a path)."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _ENCODERS[name]
