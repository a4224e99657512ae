"""Token ids of a byte-level BPE vocabulary given as a tokenizers JSON file."""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np

_loaded: dict[str, Encoder] = {}

#: The pre-tokenisation pattern of byte-level BPE as used by the vocabulary's own library.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    """The default vocabulary; installed on every node, never copied into this package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: itself, or 256 and up in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids as the `tokenizers` library gives them without special tokens added.

    The merges run in the faster `tiktoken`, built from the same file. Its ids equal the
    library's when ranks and ids are in the same order, which is tried on a few strings at
    load; otherwise, for texts that hold one of the file's special strings, and for texts on which
    `tiktoken` gives up, the library itself is used.
    """

    TRIALS = ("", " a  b\n\n\tc ", "It's 12,345.67€ — naïve Ünïcode x", "aaaaaaaaaaaaaaaa\r\n   z", "日本語 текст 🙂👍🏽")

    def __init__(self, path: str, tried: bool = False):
        """tried: the trials have been passed elsewhere; then the library is loaded only for a text that needs it, which spares workers memory."""
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
        symbols = _byte_symbols()
        self.fast = None
        try:
            import tiktoken

            ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            if not tried and any(self.fast.encode_ordinary(t) != self._plain_ids(t) for t in self.TRIALS):
                self.fast = None
        except (ImportError, KeyError, ValueError):
            self.fast = None

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain_ids(self, text: str) -> list[int]:
        return self.plain.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # its pattern engine has a bounded stack, which a million blanks in a row exceed
                pass
        return np.array(self._plain_ids(text), np.uint32)

    @property
    def id_bytes(self) -> int:
        """Bytes that hold any id: 2 or 4."""
        return 2 if self.size <= 1 << 16 else 4


def encoder(path: str, tried: bool = False) -> Encoder:
    """One encoder for each process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, tried)
    return _loaded[path]
