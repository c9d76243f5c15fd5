"""Word-level BPE with a bounded memo of pre-tokens: whole texts to little-endian uint32 ids.

The vocabulary's pre-tokeniser never joins text across ASCII white space, and each pre-token is merged by itself.  So a
text's ids are its pre-tokens' ids one after another, and a pre-token costs the library's merging only when the memo
has forgotten it.  Stretches whose characters are printable ASCII or Latin (where normalising is lower-casing and
nothing else) are cut by an equivalent pattern of the re module; chunks with any other character go to the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

_LOADED: dict[tuple, WordBpe] = {}
#: Characters outside the plain range; U+0130 lower-cases to two characters.
_OTHER = re.compile("[^\t-\r -~¡-įı-ɏ]")
#: The vocabulary's pre-token pattern, for that range: letters are word characters but for digits, _ and these numbers.
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\s\\w]|_)+")
_SPACE = re.compile("[\t-\r ]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return table


MEMO_CHARS = 64


class _Memo(dict):
    """Pre-token to its ids as bytes, learned when first asked for; long ones are not kept, so that entries bound bytes."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.alphabet = model.tokenize, _byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = np.array([t.id for t in self.tokenize(spelled)], "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


class WordBpe:
    def __init__(self, path: str, memo_limit: int = 300_000, specials_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.by_pieces = specials_as_text  # special strings could span pre-tokens
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.limit = memo_limit
        self.memo = _Memo(self.tokenizer.model)

    @classmethod
    def load(cls, path: str, **options) -> WordBpe:
        """One per Python worker; the memo outlives a task."""
        key = (path, *sorted(options.items()))
        if key not in _LOADED:
            _LOADED[key] = cls(path, **options)
        return _LOADED[key]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, _PRE_TOKENS.findall(text.lower())))

    @staticmethod
    def _stretches(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
        """Cuts of a long text, each at ASCII white space."""
        at = 0
        while len(text) - at > size:
            end = at + size
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes; a null text has none."""
        if not text:
            return b""
        if not self.by_pieces:
            return self._library(text.decode("utf-8", "replace"))
        out = []
        for stretch in self._stretches(text):
            if len(self.memo) > self.limit:
                self.memo.clear()
            s = stretch.decode("utf-8", "replace")
            if not _OTHER.search(s):
                out.append(self._plain(s))
                continue
            for chunk in _SPACE.split(s):
                if chunk:
                    out.append(self._library(chunk) if _OTHER.search(chunk) else self._plain(chunk))
        return b"".join(out)

    def encode_many(self, texts: list[bytes | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]
