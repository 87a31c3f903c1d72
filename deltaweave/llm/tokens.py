"""Token ids by the ``tokenizers`` library, with an exact memo of units between white space.

With the usual byte-level pre-tokenisation a token never runs from a non-space character into white space after it, a
space goes with the word behind it, and a lone line feed stands alone. So a text whose white space is single spaces and
line feeds falls apart into units (``word``, ``' word'``, line feed) whose ids, one after another, are the text's. A unit of
Latin letters is one pre-token, which the library's model encodes at once; a mark after it is another; any other unit goes
through the library's whole pipeline. Each distinct unit is encoded once per worker. A text with other white space, or with
a special token's name, is encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable

#: Most units that one worker remembers (about 200 bytes each).
MEMO_UNITS = 700_000
#: One optional space and Latin letters, perhaps with one mark after them.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+")
_MARKS = frozenset(",.;:!?|")
_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memo(dict):
    """Unit -> ids; what is missing is encoded and kept."""

    def __init__(self, lib) -> None:
        self.lib, self.model, self.letters = lib, lib.model, _byte_letters()

    def __missing__(self, unit: str) -> bytes | None:
        if unit != "\n" and (not unit or unit[-1].isspace() or (unit[0].isspace() and unit[0] != " ")):
            self[unit] = None  # white space next to white space: the text is encoded whole
            return None
        at = _LETTERS.match(unit)
        end = at.end() if at else 0
        if end and end == len(unit):
            piece = unit.encode().decode("latin-1").translate(self.letters)
            out = _packed([t.id for t in self.model.tokenize(piece)])
        elif end and end == len(unit) - 1 and unit[end] in _MARKS:
            out = self[unit[:end]] + self[unit[end]]
        else:
            out = _packed(self.lib.encode(unit, add_special_tokens=False).ids)
        self[unit] = out
        return out


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        pre = self.lib.pre_tokenizer
        self.by_unit = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.lib.normalizer is None and type(self.lib.model).__name__ == "BPE"
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.memo = _Memo(self.lib)

    def whole(self, text: str) -> bytes:
        return _packed(self.lib.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_unit or "\0" in text or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if not units[0]:
            del units[0]
        if units and not units[-1]:
            del units[-1]
        try:
            return b"".join(map(self.memo.__getitem__, units))
        except TypeError:  # None among them
            return self.whole(text)


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(path: str, texts: Iterable[str | None], end_id: int = 0) -> Iterable[bytes]:
    """Ids of each whole text (null: empty), each followed by ``end_id``."""
    enc, end = encoder(path), _packed([end_id])
    for text in texts:
        yield enc.encode(text or "") + end
