"""Token ids of whole texts by the vocabulary in a ``tokenizers`` file.

Byte-level BPE files (vocabulary in the order of merges) are run by the faster of the two installed libraries, which
gives the same ids (tested); texts with the name of an added token, and files of another kind, go through ``tokenizers``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import cached_property

import numpy as np

DEFAULT_FILE = "byte_bpe_50k.json"
#: How the ``ByteLevel`` pre-tokenizer cuts texts.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str | None = None) -> str:
    """A place of a vocabulary file; by default the public byte-level BPE file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str | None = None) -> None:
        self.place = vocabulary(path)
        with open(self.place, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranks(spec)

    @cached_property
    def tokenizer(self) -> object:
        """Loaded for the texts that need it only; it takes much more memory than the ranks."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.place)

    def _ranks(self, spec: dict) -> object | None:
        first = spec["pre_tokenizer"] or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        if not plain or spec["normalizer"] or spec["model"]["type"] != "BPE":
            return None
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts (with the total at the end)."""
        parts = [self._one(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), starts

    @cached_property
    def ends_of_sentences(self) -> np.ndarray:
        """For each id, whether a sentence or line may end with it."""
        with open(self.place, encoding="utf-8") as file:
            spec = json.load(file)
        known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        out = np.zeros(max(known.values()) + 1, bool)
        for token, i in known.items():
            out[i] = token.endswith((".", "!", "?", "Ċ"))  # the last is the line feed in byte-level letters
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a file; kept between tasks."""
    place = vocabulary(path)
    if place not in _encoders:
        _encoders[place] = Encoder(place)
    return _encoders[place]
