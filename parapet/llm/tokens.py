"""Token ids of whole texts, by way of their pieces between single spaces.

A byte-level BPE vocabulary splits text by a pattern before it merges. A space before a visible character always opens a new
match and nothing spans it, so " word" has the same ids wherever it stands. Texts are therefore cut at single spaces and each
distinct piece is encoded once; a text whose white space is not of that plain kind, or which names a special token, is encoded whole.
"""

from __future__ import annotations

import base64
import sys
from array import array
from functools import lru_cache

import public_tokenizers

MOST_PIECES = 700_000


@lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceIds:
    """Encoder of texts to the little-endian unsigned 32-bit ids that `tokenizers` gives for a vocabulary file."""

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # the same vocabulary as ranks: quicker on single pieces, and tested to give the same ids
        self.piece = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_vocabulary(ranks_path), special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return packed(self.whole.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if not text or any(s in text for s in self.special):
            return self._whole(text)
        pieces = text.split(" ")
        first = pieces[0]
        if not first or first[-1].isspace():
            return self._whole(text)
        known = self.known
        pieces[0] = ""
        try:
            rest = b"".join(map(known.__getitem__, pieces[1:]))
        except KeyError:
            if len(known) > MOST_PIECES:
                known.clear()
            new = [p for p in set(pieces[1:]) if p not in known]
            if any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                return self._whole(text)
            for p in new:
                known[p] = packed(self.piece(" " + p))
            rest = b"".join(map(known.__getitem__, pieces[1:]))
        return packed(self.piece(first)) + rest


@lru_cache(maxsize=2)
def piece_ids(json_path: str, ranks_path: str) -> PieceIds:
    """One encoder for each Python worker, kept between its tasks."""
    return PieceIds(json_path, ranks_path)
