"""Byte-level BPE ids, equal to those of the ``tokenizers`` file, made by tiktoken from the same vocabulary (four times faster)."""

from __future__ import annotations

import base64

import numpy as np

_MADE: dict[str, Encoder] = {}
_SPECIAL = "<|endoftext|>"


class Encoder:
    """``ids(text)`` gives a text's ids. Texts that hold the vocabulary's special string go to ``tokenizers`` itself."""

    def __init__(self, json_path: str):
        import public_tokenizers as public
        import tiktoken

        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._path, self._slow = json_path, None
        self._bpe = tiktoken.Encoding("byte-bpe", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _SPECIAL in text:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._path)
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._bpe.encode_ordinary(text), np.uint32)


def encoder(json_path: str) -> Encoder:
    """The encoder of a file, made once per worker."""
    if json_path not in _MADE:
        _MADE[json_path] = Encoder(json_path)
    return _MADE[json_path]
