"""Token ids of whole texts by the tokenizers library.

Words repeat, so a text is cut where byte-level BPE always cuts, before each
single space and around other white space, and the library encodes each piece
once per worker. The ids are those of the text encoded in one call by the library's
defaults: a text with the string of an added token goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

# Unicode White_Space: fixed values.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A run of letters before plain punctuation or space ends a piece for certain.
_PIECE = re.compile(
    rf" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?![^ \n.,!?;:])"
    rf"| ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)

ID_TYPE = np.dtype("<u4")
MAX_REMEMBERED = 600_000
MAX_REMEMBERED_PIECE = 40


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones themselves, others from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


class PieceEncoder(dict):
    """The ids of each piece met so far, as little-endian unsigned 32-bit integers.

    At most ``MAX_REMEMBERED`` pieces are kept, about 120 MB. A piece that is one
    word goes straight to the library's BPE model; any other through its whole
    pipeline.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._model = self._tokenizer.model
        self._letters = _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if piece.removeprefix(" ").isalpha():
            letters = piece.encode().decode("latin-1").translate(self._letters)
            ids = [t.id for t in self._model.tokenize(letters)]
        else:
            ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < MAX_REMEMBERED and len(piece) <= MAX_REMEMBERED_PIECE:
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self._added):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker process's encoder for a vocabulary file."""
    return PieceEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
