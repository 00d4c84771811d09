"""Token ids by a public tokenizer, with the ids of words kept per process."""

from __future__ import annotations

import contextlib
import functools
import os
import re
from array import array
from collections.abc import Callable

from .common import CACHES

#: Pieces that a process keeps in each of two generations, about 0.3 KB each.
KEPT_WORDS = 150_000
#: Marks of pieces seen once, a byte each; a piece is kept from the second time on.
SEEN = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """How a byte-level BPE vocabulary writes each byte, for str.translate of Latin-1 text."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The pattern that :func:`_splitter` knows another way for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLANE = ["".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x10000)))]


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern. For the usual one by ``re``, in half the time, unless a text has characters beyond 16 bits: its
    classes are spelled out as ``regex`` sees them, and what is frequent is tried first (no two of the branches before the blanks
    can begin at the same character)."""
    import regex

    whole = regex.compile(pattern).findall
    if pattern != _PATTERN:
        return whole
    # without the surrogates, which are no characters of a text
    letter, digit, blank = ("".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for part in _PLANE for r in regex.findall(f"{kind}+", part)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    narrow = re.compile(f" ?[{letter}]+| ?[{digit}]+|'(?:[stmd]|re|ve|ll)| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+").findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: narrow(text) if text.isascii() or not beyond(text) else whole(text)


class Ids:
    """of(texts): for each text the tokenizer's encode(text, add_special_tokens=False).ids, as little-endian 32-bit bytes.

    A byte-level BPE tokenizer splits a text by a pattern and encodes each piece by itself, so the tokenizer's model gets
    every piece once or twice, and pieces seen more often are looked up. Pieces not used in a whole generation are forgotten. A text that
    holds one of the special tokens goes to the tokenizer whole; with ``ordinary``, such strings are text like other text.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.split = _splitter(public_tokenizers.PATTERN)
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)

    def _learn(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            if piece.isascii() and piece.isprintable():  # of these only the blank is written as another letter
                letters = piece.replace(" ", self.letters[32])
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            seat = hash(piece) % SEEN
            if not self.seen[seat]:
                self.seen[seat] = 1
                return got
        if len(self.young) >= KEPT_WORDS:
            self.young, self.old, self.seen = {}, self.young, bytearray(SEEN)
        self.young[piece] = got
        return got

    def rest(self) -> None:
        """Between tasks no more than one generation's worth is kept."""
        if len(self.young) + len(self.old) > KEPT_WORDS:
            self.old = {}

    def of(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            pieces = self.split(text)
            found = list(map(self.young.get, pieces))
            i = -1
            with contextlib.suppress(ValueError):  # until no piece is unknown
                while True:
                    i = found.index(None, i + 1)
                    found[i] = self.young.get(pieces[i]) or self._learn(pieces[i])
            out.append(b"".join(found))
        return out


@functools.cache
def ids(path: str, ordinary: bool = False) -> Ids:
    return Ids(path, ordinary)


CACHES.append(ids.cache_clear)
