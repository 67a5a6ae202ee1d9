"""Byte-level BPE by a ``tokenizers`` JSON file.

The vocabulary is read from the JSON file. Its merges are in id order, so the
rank-based encoder of ``tiktoken`` gives the same ids at four times the speed
(``tests/llm/test_byte_bpe.py`` compares them over all code points). Where the
file is not of that kind, or that encoder refuses a text, the ``tokenizers``
library encodes."""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded piece by piece, cut before white space (the pattern's
#: own) that follows other characters, where the pattern always begins a new match.
PIECE_CHARS = 1 << 20
_CUT = regex.compile(r"(?<=\S)\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def version(path: str) -> str:
    """Digest of the tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        model = spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain = plain and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        ranked = plain and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ranked = ranked and spec["normalizer"] is None and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        self._fast = None
        if ranked:
            import tiktoken

            byte = _byte_of()
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
            self._fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:  # its regex gives up on very long runs of white space
                pass
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _parts(self, text: str | None):
        at, text = 0, text or ""
        while at < len(text):
            found = _CUT.search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
            upto = found.start() if found else len(text)
            yield self._encode(text[at:upto])
            at = upto

    def array(self, text: str | None) -> np.ndarray:
        """The ids of a text, of which null is an empty one."""
        parts = list(self._parts(text))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])

    def encode(self, text: str | None) -> list[int]:
        return self.array(text).tolist()

    def count(self, text: str | None) -> int:
        return sum(map(len, self._parts(text)))

    def decode(self, ids) -> str:
        return self._library.decode(list(map(int, ids)), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)

