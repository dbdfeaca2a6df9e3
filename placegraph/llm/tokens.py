"""Exact tokenizer ids of whole texts, encoding each distinct white-space piece once.

Neither vocabulary merges across the cuts made here, so the ids of a text are the
ids of its pieces put together. Pieces repeat far more often than texts do; each
Python worker remembers the ids of pieces it has met, up to a bound in bytes. Pieces
not met before are encoded many at a time, as one text with separators between them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

#: Bytes of remembered pieces and ids in one Python worker before they are forgotten.
REMEMBER = 200_000_000
#: Longer pieces are encoded but not remembered.
LONGEST = 200
#: New pieces encoded as one text.
AT_ONCE = 1024

#: A word with the space before it, else a run of white space short of that space.
_SPACED = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: White space outside ASCII: the byte-level pattern looks across it, so such texts are encoded whole.
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MAYBE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: White space that the quick way of cutting does not handle.
_UNEVEN = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c")
_SPACES = b" \t\n\r\x0b\x0c"
#: A letter and then stops or commas up to the end: these are tokens of their own.
_STOPPED = re.compile(rb"(.*[A-Za-z\x80-\xff])([.,]+)", re.S)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of pieces, encoded when first asked for."""

    def __init__(self, encode, stops: dict[bytes, bytes]):
        self.encode, self.stops, self.held = encode, stops, 0

    def __missing__(self, piece: bytes) -> bytes:
        m = _STOPPED.fullmatch(piece) if piece[-1] in b".," and piece.isascii() else None
        ids = self[m[1]] + self._stop(m[2]) if m else self.encode(piece)
        if len(piece) <= LONGEST:
            self.held += 150 + len(piece) + len(ids)
            self[piece] = ids
        return ids

    def _stop(self, run: bytes) -> bytes:
        if run not in self.stops:
            self.stops[run] = self.encode(b"\0" + run)
        return self.stops[run]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the library gives them.

    With ``specials_as_text`` special strings in a text are plain text; without, they
    are their own ids, which is what the library does.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.specials = [] if specials_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = self._ids("a b") != self._ids("a  b")
        #: What stands between pieces encoded at once, and its only id.
        self.mark, self.between, self.before = (b"\n", "\n", " ") if self.keeps_space else (b"|", " | ", "")
        self.mark_id = int.from_bytes(self._ids(self.mark.decode()), "little")
        self.forget()

    def forget(self) -> None:
        self.known = _Known(self._spaced if self.keeps_space else self._bare, {})

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _bare(self, piece: bytes) -> bytes:
        return self._ids(piece.lstrip(b"\0").decode() if len(piece) > 1 else piece.decode())

    def _spaced(self, piece: bytes) -> bytes:
        """Ids of a piece as it follows a space, or as it is if it brings its own line end."""
        if piece[:1] == b"\0":
            return self._ids(piece[1:].decode())
        return self._ids(piece.decode() if piece[:1] == b"\n" else " " + piece.decode())

    def _cut(self, text: str) -> tuple[bytes, list[bytes]] | None:
        """A text's first piece, where it has no space before it, and the pieces after; None where it is to be cut with care."""
        raw = text.encode()
        if b"\0" in raw or any(x in raw for x in self.specials):
            return None
        if not self.keeps_space:
            if b"\xcc" not in raw and b"\xcd" not in raw:  # no combining marks: lower case first changes nothing
                raw = raw.lower()
            return b"", raw.split()
        if raw[0] in _SPACES or raw[-1] in _SPACES or any(x in raw for x in _UNEVEN) or (not raw.isascii() and any(x in raw for x in _MAYBE_SPACE)):
            return None
        pieces = raw.replace(b"\n", b" \n").split(b" ")
        return b"\n" + pieces[0], pieces[1:]

    def _learn(self, pieces: set[bytes]) -> None:
        """Encode pieces not met before, many as one text."""
        new = set()
        for p in pieces:
            if p not in self.known:
                if p[-1] in b".,":
                    base = p.rstrip(b".,")
                    if base[-1:].isalpha() and p.isascii():
                        p = base
                if len(p) <= LONGEST and self.mark not in p and p not in self.known:
                    new.add(p)
        ordered = sorted(new)
        for at in range(0, len(ordered), AT_ONCE):
            some = ordered[at : at + AT_ONCE]
            raw = self._ids(self.between.join([self.before + p.decode() for p in some]))
            ends = [*(np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark_id) * 4).tolist(), len(raw)]
            if len(ends) != len(some):
                continue  # a piece brought the mark itself: each is encoded alone when asked for
            start = 0
            for p, end in zip(some, ends):
                self.known[p] = raw[start:end]
                self.known.held += 150 + len(p) + end - start
                start = end + 4

    def _whole(self, text: str) -> bytes:
        """Ids of a text that is cut with care or not at all."""
        raw = text.encode()
        if b"\0" in raw or any(x in raw for x in self.specials) or _OTHER_SPACE.search(text):
            return self._ids(text)
        return b"".join(map(self._piece, _SPACED.findall(text)))

    @property
    def line_end(self) -> bytes:
        return self.known.stops.get(b"\n") or self.known.stops.setdefault(b"\n", self._ids("\n"))

    def _piece(self, piece: str) -> bytes:
        """Ids of a word with or without its space, or of a run of white space."""
        if piece[0] == " " and len(piece) > 1 and piece[1] not in " \t\n\r\x0b\x0c":
            return self.known[piece[1:].encode()]
        if piece.isspace():
            return self.known.stops.get(piece.encode()) or self.known.stops.setdefault(piece.encode(), self._ids(piece))
        return self.known[b"\n" + piece.encode()][len(self.line_end) :]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; null and empty texts have none."""
        if self.known.held > REMEMBER:
            self.forget()
        cuts = [self._cut(t) if t else (b"", []) for t in texts]
        self._learn(set().union(*[c[1] for c in cuts if c is not None]))
        get, skip, out = self.known.__getitem__, len(self.line_end), []
        for text, cut in zip(texts, cuts):
            if cut is None:
                out.append(self._whole(text))
            else:
                first, rest = cut
                out.append((get(first)[skip:] if first else b"") + b"".join(map(get, rest)))
            if self.known.held > 2 * REMEMBER:
                self.forget()
                get = self.known.__getitem__
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
