"""Exact, cheap encoding of whole texts with the public tokenizers.

Both vocabularies used here cut a text into pieces by a pattern before they merge
bytes, so a text's tokens are its pieces' tokens, one after the other. Pieces
repeat, and each different one is merged once per worker by the library's model.

Texts of ASCII and Latin letters without apostrophes are cut by the same pattern
here, written for those characters. All others are cut at blanks that no piece
reaches over (a single space between two characters that are not blank; any
blank where the vocabulary drops blanks), and the stretches between go to the
library whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: A single space between two characters that are not blank; Python's blanks include all of the libraries'.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Blanks to Python, but not to the libraries.
_CONTROLS = re.compile("[\x1c-\x1f]")
_L, _B = "A-Za-zÀ-ÖØ-öø-ÿ", "\\t-\\r "
#: Characters that the two patterns below know how to cut: all of ASCII but the apostrophe, and Latin letters.
_KNOWN = bytes(b for b in range(256) if b < 128 and b != 39 or b >= 192 and b not in (215, 247))
_WORD_PIECES = re.compile(f"[{_L}]+|[0-9]|[^{_B}{_L}0-9]+")
_BYTE_PIECES = re.compile(f" ?[{_L}]+| ?[0-9]+| ?[^{_B}{_L}0-9]+|[{_B}]+(?![^{_B}])|[{_B}]+")


def plain(text: str) -> bool:
    """Whether the text has nothing but known characters, and no string of a special token."""
    try:
        latin = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not latin.translate(None, _KNOWN) and "<|" not in text


def stretches(text: str) -> list[str]:
    """The text between safe cuts; joined by one space they give the text again."""
    words = text.split()
    # every blank stands alone if there is one less of them than of words
    if len(text) - len("".join(words)) == len(words) - 1:
        return text.split(" ")
    return CUT.split(text)


def words(text: str) -> list[str]:
    """The text between blanks of any kind."""
    return CUT.split(text) if _CONTROLS.search(text) else text.split()


def _byte_letters() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_LETTER = _byte_letters()


class _Recent(dict):
    """Key -> ids, worked out once. Two generations: what is asked for stays, the rest goes when the newer one is full."""

    def __init__(self, value, limit: int):
        super().__init__()
        self.value, self.limit, self.old = value, limit, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.value(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """One tokenizer file, with the ids of recent stretches.

    ``lead``: byte-level vocabularies, where the space before a stretch belongs
    to its first token. Otherwise words end in a mark, case is folded and blanks
    are dropped.
    """

    def __init__(self, path: str, lead: bool, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.lead = lead
        self.cut = (_BYTE_PIECES if lead else _WORD_PIECES).findall
        self.pieces = _Recent(self._piece, limit)
        self.known = _Recent(self._stretch, limit // 20)

    def whole(self, text: str) -> bytes:
        """Little-endian 32-bit ids, by the library."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        folded = piece if self.lead else piece.lower()
        # ASCII letters stand for themselves
        plain_ = folded.isascii() and folded.isalnum()
        letters = folded if plain_ else "".join(map(_LETTER.__getitem__, folded.encode()))
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        """Ids of a stretch that is not the first of its text."""
        return self.whole(" " + stretch if self.lead else stretch)

    def parts(self, text: str) -> list[bytes]:
        """Ids of every piece or stretch of the text, in order."""
        if plain(text):
            return list(map(self.pieces.__getitem__, self.cut(text)))
        if not self.lead:
            return list(map(self._part, words(text)))
        first, *rest = stretches(text)
        return [self.whole(first), *map(self._part, rest)]

    def _part(self, stretch: str) -> bytes:
        """A stretch of a text that is not all plain; most of its stretches are."""
        if stretch and plain(stretch):
            return b"".join(map(self.pieces.__getitem__, self.cut(" " + stretch if self.lead else stretch)))
        return self.known[stretch]

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        return b"".join(self.parts(text))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, lead: bool) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, lead)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the worker's encoders (some 50 MB each with their pieces): other work goes on in it."""
    _ENCODERS.clear()


def decoded(text: bytes) -> str:
    """Text for the library; bytes that are no UTF-8 become the replacement character."""
    return text.decode(errors="replace")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine; imported where it is needed."""
    import public_tokenizers

    return public_tokenizers.path(name)
