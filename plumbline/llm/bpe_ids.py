"""Ids of a public tokenizer file, computed once per word of a text.

A byte-level BPE of this family starts a new piece at every space that stands between two other non-space characters,
so a text may be cut there and the parts encoded one by one. Parts repeat, so each worker keeps the packed ids of the
parts it has seen, in a dictionary of bounded size. Parts that are new go to the faster of the two libraries that read
this vocabulary (ranks instead of a merge list); the tests hold its ids against the other's.

The string of a special token in a text is ordinary text, or, with `special`, becomes its id, as the tokenizer file has
it by default.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from functools import lru_cache

import numpy as np

#: Parts kept per worker before the dictionary starts anew, and the longest part that is kept.
CACHE_PARTS, CACHE_CHARS = 200_000, 48

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A run of Latin letters that an ASCII character other than a letter, or the end, follows: a piece of its own.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([\\x00-@\\[-`{-\\x7f].*)?", re.S)
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def rank_file(path: str) -> str:
    """The rank file beside a tokenizer file."""
    return path.removesuffix(".json") + ".tiktoken"


def special_tokens(path: str) -> dict[str, int]:
    """The strings and ids of a tokenizer file's added tokens, the longest first: they are found before the pattern cuts."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path} has added tokens that depend on what is around them")
    return {t["content"]: t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}


class Encoder:
    """Packed little-endian unsigned 32-bit ids of whole texts; none are added at the ends."""

    def __init__(self, path: str, special: bool = False):
        import public_tokenizers
        import tiktoken

        with open(rank_file(path), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self._special = special_tokens(path) if special else {}
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._seen: dict[str, bytes] = {}
        self._rest: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self._encode(text), dtype="<u4").tobytes()

    @staticmethod
    def _parts(text: str) -> list[str]:
        words = text.split()
        if len(text) - len("".join(words)) == len(words) - 1:  # no two spaces together, none at either end
            return text.split(" ")
        return _CUT.split(text)

    def _spaced(self, part: str) -> bytes:
        """The ids of a part behind its space."""
        match = _WORD.fullmatch(part)
        if match is None:
            return self.whole(" " + part)
        word, rest = match.groups()
        seen = self._seen
        ids = seen.get(word)
        if ids is None:
            new = self._piece((" " + word).encode())
            ids = _PACK[len(new)](*new) if len(new) < len(_PACK) else np.asarray(new, dtype="<u4").tobytes()
            if len(word) <= CACHE_CHARS:
                seen[word] = ids
        if not rest:
            return ids
        more = self._rest.get(rest)
        if more is None:
            more = self.whole(rest)
            if len(rest) <= 4:
                self._rest[rest] = more
        return ids + more

    def ids(self, text: str) -> bytes:
        if self._cut is not None and any(s in text for s in self._special):
            # Odd parts are special tokens.
            return b"".join(_PACK[1](self._special[x]) if k % 2 else self._plain(x) for k, x in enumerate(self._cut.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = self._parts(text)
        seen, spaced, out = self._seen, self._spaced, []
        if len(seen) > CACHE_PARTS:
            seen.clear()
        if len(self._rest) > CACHE_PARTS:
            self._rest.clear()
        for part in rest:
            out.append(seen.get(part) or spaced(part))
        return self.whole(first) + b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> Encoder:
    """The worker's encoder for a file; kept between batches and tasks."""
    return Encoder(path, special)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
