"""A tokenizers-library vocabulary behind a cache of pre-tokens.

The library's byte-level BPE encodes each pre-token by itself, so the ids of a
text are those of its pre-tokens in order. Pre-tokens are cut as for operator
1, looked up, and encoded by its segment trees when new. Texts that hold an
added token, and vocabularies of another kind, go to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from citeloom.llm.bpe import Bpe

#: The pre-token pattern of the library's ByteLevel step (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_spec(data: bytes) -> tuple[dict, dict[bytes, int], list[tuple[bytes, bytes]]] | None:
    """(added tokens, vocabulary, merges) of a plain byte-level BPE, else None."""
    spec = json.loads(data)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    plain = plain and not model.get("ignore_merges") and not model.get("dropout")
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if not plain or any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    byte_of = byte_letters()
    raw = lambda token: bytes(byte_of[c] for c in token)
    vocabulary = {raw(token): i for token, i in model["vocab"].items() if token not in added}
    merges = [tuple(map(raw, pair.split(" ") if isinstance(pair, str) else pair)) for pair in model["merges"]]
    return added, vocabulary, merges


class CachedEncoder:
    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.bpe = None
        if (spec := byte_level_spec(data)) is not None:
            added, vocabulary, merges = spec
            self.bpe = Bpe.from_merges(vocabulary, merges, BYTE_LEVEL)
            # Added tokens are found in a text before anything else.
            self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids as the library gives them without special tokens, four bytes each."""
        if self.bpe is None:
            return self._library(texts)
        special = [i for i, t in enumerate(texts) if self.added.search(t)]
        if not special:
            return self.bpe.encode_texts(texts)
        own = set(special)
        out = dict(zip(special, self._library([texts[i] for i in special]), strict=True))
        rest = [i for i in range(len(texts)) if i not in own]
        out |= dict(zip(rest, self.bpe.encode_texts([texts[i] for i in rest]), strict=True))
        return [out[i] for i in range(len(texts))]


_LOADED: dict[str, CachedEncoder] = {}


def cached_encoder(digest: str, data: bytes) -> CachedEncoder:
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = CachedEncoder(data)
    return _LOADED[digest]
