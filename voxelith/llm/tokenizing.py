"""Token ids of a byte-level BPE tokenizer file, at the speed of its rank table."""

from __future__ import annotations

import json
import re

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: Characters whose Unicode classes no library version disagrees on; texts with any other
#: character are encoded by the tokenizers library itself.
_SETTLED = re.compile("[^\t\n\r -~¡-¬®-ɏ‐-‧]")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts as the tokenizers library does with add_special_tokens=False: none is added,
    but the string of one in a text is that token."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = re.compile("|".join(map(re.escape, special)) or "(?!)")
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in special
        }
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def encode(self, text: str) -> list[int]:
        if _SETTLED.search(text) or self.added.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.fast.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str = BYTE_BPE) -> Encoder:
    """One encoder for each process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
