"""Token ids of whole texts, by the tokenizers library.

Byte pairs are merged within pieces that the tokenizer's own split makes, and between two non-space characters a single space always starts a
new piece. So a text is cut there, each distinct piece is encoded once by the library and kept in a bounded table of the Python worker, and the
ids of a text are those of its pieces in order: the same as encoding it whole, at a fraction of the time.
"""

from __future__ import annotations

import os
import re
import struct

from sdkatlas.llm import common

#: End of a paragraph inside a piece: a line break between two non-space characters is a piece of its own.
_BREAK = re.compile(r"(?<=\S)\n(?=\S)")
#: Letters with marks behind them: two pieces of the split. An apostrophe may begin a contraction, so it is none of the marks.
_TAIL = re.compile(r"( ?[^\W\d_]+)([^\w\s']+)")
#: How byte-level models write bytes: visible Latin-1 characters stand for themselves, the others for characters from 256 on.
_SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_VISIBLE = {b: b if b in _SEEN else 256 + b - sum(x < b for x in _SEEN) for b in range(256)}
_SPACE_SEEN = chr(_VISIBLE[32])
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(17)]
KEPT = 550_000
LONGEST_KEPT = 64


def odd(text: str) -> bool:
    """Whether there is white space beside a space, or a space at an end. Searches for single characters cost next to nothing."""
    return text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _WHITE)


class Encoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}
        self.kept = kept

    def whole(self, text: str) -> bytes:
        """The library's own answer."""
        return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        if (found := self.old.get(piece)) is not None:
            return self._keep(piece, found)
        if "\n" in piece and len(lines := _BREAK.split(piece)) > 1:
            return self["\n"].join([self[line] for line in lines])
        if (piece[1:] if piece[:1] == " " else piece).isalpha():  # the split leaves these whole: the model alone is enough
            seen = piece.replace(" ", _SPACE_SEEN) if piece.isascii() else piece.encode().decode("latin-1").translate(_VISIBLE)
            found = _raw([t.id for t in self.model.tokenize(seen)])
        elif (parts := _TAIL.fullmatch(piece)) and parts[1].strip(" ").isalpha():
            found = self[parts[1]] + self[parts[2]]
        else:
            found = self.whole(piece)
        return self._keep(piece, found)

    def _keep(self, piece: str, found: bytes) -> bytes:
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.kept:  # what was looked up lately comes back from `old`
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """All ids of a text; none for null."""
        if not text:
            return b""
        if "\0" in text or odd(text):
            first, *rest = _SPACE.split(text)
            pieces = [first, *[" " + r for r in rest]]
        else:  # single spaces between other characters only
            pieces = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.__getitem__, pieces))


def _raw(ids: list[int]) -> bytes:
    return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """The Python worker's encoder for a tokenizer file, with a table of `kept` entries twice; other operators' tasks free it."""
    return common.held(f"tokens {kept} {path}", lambda: Encoder(path, kept))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
