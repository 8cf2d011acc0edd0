"""Public tokenizers, read from a vocabulary file given by path; nothing is trained and no file is copied.

The tokenizers library defines the ids. Its speed, some 2 MB a second, would be most of the cost of every operator that
needs ids, so texts whose characters are all in ranges where both were compared character by character take a second route
to the same ids: the library's split pattern, then tiktoken's merges over ranks read from the same file, a word's ids being
kept in a bounded cache. Any other text, and any that holds a special token's string, goes to the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Latin letters with their signs, and general punctuation.
_SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ž‐-―‘-‟†-•…€]*")
_WORDS_KEPT = 250_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _word_pattern() -> re.Pattern:
    """The split pattern of lower-case word vocabularies, its Unicode classes written out for the safe characters."""
    safe = [c for c in map(chr, range(0x2100)) if _SAFE.fullmatch(c)]
    letters, numbers = ("".join(re.escape(c) for c in safe if unicodedata.category(c)[0] == kind) for kind in "LN")
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\s{letters}{numbers}]+")


def _bytes_of_characters() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def version_digest(path: str) -> str:
    """SHA-256 of the vocabulary file: counts made with another file or version never mix."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Words(dict):
    """Ids of words, found by ``ids_of`` where missing; emptied when full."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word):
        if len(self) >= _WORDS_KEPT:
            self.clear()
        ids = self[word] = array("H", self.ids_of(word)).tobytes()
        return ids


class Encoder:
    """Ids of whole texts as ``encode(text, add_special_tokens=False)`` of the library gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec)

    @property
    def library(self):
        """Loaded where a text asks for it: it takes more memory than the rest of a worker."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _fast(self, spec):
        """A function from text to little-endian 16-bit ids, or None for a kind of file that it doesn't know."""
        import tiktoken

        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or len(vocab) > 1 << 16 or model.get("dropout") or model.get("unk_token"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get(a + b) for a, b in pairs]
        if None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)):
            return None
        added, of = {t["id"] for t in spec["added_tokens"]}, _bytes_of_characters()
        end = model.get("end_of_word_suffix") or ""
        ranks = {}
        for token, k in vocab.items():
            if k not in added:
                last = bool(end) and token.endswith(end)
                ranks[bytes(of[c] for c in (token[: -len(end)] if last else token)) + b"\xff" * last] = k
        if end:
            if spec["normalizer"] != {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}:
                return None
            split = spec["pre_tokenizer"]["pretokenizers"][0]
            if split.get("behavior") != "Removed" or not split.get("invert"):
                return None
            if split["pattern"]["Regex"] != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                return None
            find = _word_pattern().findall
            ranks.setdefault(b"\xff", (1 << 16) + 1)  # never left alone: a word's last byte has its own symbol
            core = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            words = _Words(lambda w: core.encode_single_piece(w.encode() + b"\xff"))
            get = words.__getitem__
            return lambda text: b"".join(map(get, find(text.lower())))  # NFC leaves every safe character as it is
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: coder.encode_to_numpy(text).astype("<u2").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast and _SAFE.fullmatch(text) and not any(s in text for s in self.special):
            return np.frombuffer(self.fast(text), "<u2")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)
