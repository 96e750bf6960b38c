"""Token ids of whole texts by the tokenizers library, each piece once.

The byte-level pre-tokenizer never joins text across a single space between
two non-space characters, so a text is cut there and the ids of the pieces
are joined. A piece goes to the library the first time it is seen; the memo
of pieces is bounded and lives as long as the Python worker. Ids equal those
of encoding the whole text (tested on whole texts against the library).
"""

from __future__ import annotations

import gc
import re
from array import array

#: Pieces remembered in each of two generations of each of two memos (about 200
#: bytes each). A job that shares its workers with others can ask for fewer.
MEMO_ENTRIES = 500_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?*%$&#|"


class _Odd(Exception):
    """A piece with white space at an end."""


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others follow from
    code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))


class _Memo(dict):
    """Ids (little-endian uint32 bytes) of pieces that follow ``prefix``.

    Full, it becomes the older generation; pieces used again move back."""

    def __init__(self, prefix: str, tokenizer, entries: int, head=None):
        super().__init__()
        self.prefix, self.tokenizer, self.model = prefix, tokenizer, tokenizer.model
        self.entries = entries
        self.head = self if head is None else head
        self.older: dict[str, bytes] = {}
        self.line_end = self.whole("\n") if head is None else head.line_end

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self._ids(piece)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def _ids(self, piece: str) -> bytes:
        if piece.isalpha():  # one word: the merges alone decide
            raw = self.prefix + piece
            raw = ("Ġ" + piece if self.prefix else piece) if piece.isascii() \
                else raw.encode().decode("latin-1").translate(_LETTERS)
            return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        if len(piece) > 1 and piece[0] == "\n" and not piece[1].isspace() and self is not self.head:
            # a line end between two non-space characters is a token of its own
            return self.head.line_end + self.head[piece[1:]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        word = piece.rstrip(_MARKS)
        if len(word) < len(piece) and word[-1:].isalpha():
            # a letter and the run of marks after it are never in one token
            return self[word] + self.head[piece[len(word):]]
        return self.whole(piece)

    def whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(self.prefix + piece, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Whole-text encoder over one tokenizer file."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self._head = _Memo("", tok, entries)
        self._next = _Memo(" ", tok, entries, self._head)

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian uint32 bytes."""
        if not text:
            return b""
        try:
            if " \n" in text:
                raise _Odd
            first, *rest = text.replace("\n", " \n").split(" ")
            return self._head[first] + b"".join(map(self._next.__getitem__, rest))
        except _Odd:  # some space has white space beside it: cut at the others only
            first, *rest = _CUT.split(text)
            return self._head.whole(first) + b"".join(map(self._next.whole, rest))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, entries: int = MEMO_ENTRIES) -> Encoder:
    """The worker's encoder for a tokenizer file (kept between tasks)."""
    if (path, entries) not in _ENCODERS:
        gc.set_threshold(100_000, 20, 50)  # the memo holds no cycles to look for
        _ENCODERS[path, entries] = Encoder(path, entries)
    return _ENCODERS[path, entries]
