"""Token ids of whole texts by public byte-level BPE ranks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: A cut before a space that precedes a visible character always lies between
#: two matches of the splitting pattern, so pieces can be encoded one by one.
CUT = re.compile(r" (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    """Encodes whole texts as the tokenizer does without adding special tokens.

    Special tokens that stand in a text (``special``: text to id) are told apart
    first; without them all is ordinary text.
    """

    def __init__(self, path: str, special: dict[str, int] | None = None):
        ranks = read_ranks(path)
        self._special = special or {}
        if max([*ranks.values(), *self._special.values()]) > 0xFFFF:
            raise ValueError("ids beyond 16 bits")
        self._encode = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        longest_first = sorted(self._special, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self._special else None

    def encode(self, text: str) -> np.ndarray:
        # Splitting leaves the special tokens at the odd places.
        parts = self._marks.split(text) if self._marks else [text]
        ids = self._encode(parts[0])
        for i, part in enumerate(parts[1:], 1):
            ids.extend([self._special[part]] if i % 2 else self._encode(part))
        return np.array(ids, dtype=np.uint16)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        return map(self.encode, texts)


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, special_path: str | None = None) -> Encoder:
    """One encoder per worker process and vocabulary; ``special_path`` is a tokenizer file that names special tokens."""
    key = path, special_path
    if key not in _ENCODERS:
        special = {}
        if special_path:
            added = Tokenizer.from_file(special_path).get_added_tokens_decoder()
            special = {token.content: number for number, token in added.items()}
        _ENCODERS[key] = Encoder(path, special)
    return _ENCODERS[key]
