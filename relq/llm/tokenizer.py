"""Byte-level BPE ids with a bounded cache of segments.

A token of this kind never has white space after a character that is none, so a text may be encoded in segments that
begin at a space after such a character. Segments repeat far more often than texts do.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space after white space does not begin a segment.
IRREGULAR = re.compile(r"\s ")
#: Segments kept by one worker, and the longest one that is kept.
CACHE, LONGEST = 300_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder(dict):
    """Maps a segment without its leading space to the little-endian uint32 ids of the segment with it.

    The vocabulary file's added tokens are single ids wherever their names stand in a text; what is between them is encoded
    as texts of their own.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters, self.special = _byte_letters(), {x["content"]: x["id"].to_bytes(4, "little") for x in held["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): n for word, n in held["model"]["vocab"].items() if word not in self.special}
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        names = sorted(self.special, key=len, reverse=True)
        self.names = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def has_special(self, text: str) -> bool:
        return any(x in text for x in self.special)

    def raw(self, text: str) -> bytes:
        if self.has_special(text):
            return b"".join(self.special[x] if x in self.special else self.raw(x) for x in self.names.split(text) if x)
        ids = self.plain(text)
        return b"".join(n.to_bytes(4, "little") for n in ids)

    def __missing__(self, part: str) -> bytes:
        found = self.raw(" " + part)
        if len(part) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian uint32."""
        if IRREGULAR.search(text) or self.special and self.has_special(text):
            return self.raw(text)
        first, *rest = text.split(" ")
        return self.raw(first) + b"".join(map(self.__getitem__, rest))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
