"""Byte-level BPE at speed: ids of whole texts from a tokenizer's vocabulary file."""

from __future__ import annotations

import numpy as np

from .common import byte_letters, worker_state


class ByteEncoder:
    """Ids of texts by the byte-level BPE in ``path``.

    A vocabulary whose ids follow the order of its merges is also one of byte
    ranks, and its texts are encoded from those; texts that name a special token
    take the tokenizer itself, unless ``plain`` makes such names ordinary text.
    """

    def __init__(self, path: str, plain: bool) -> None:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.names = [] if plain else sorted(special)
        back = {letter: byte for byte, letter in enumerate(byte_letters())}
        shown = {token: i for token, i in model["vocab"].items() if token not in special}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in shown.items()}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [shown.get(m) for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the ids of this vocabulary are not its merge ranks")
        ranks = {token: i for i, token in self.bytes_of.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(name in text for name in self.names):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


def byte_encoder(path: str, plain: bool = False) -> ByteEncoder:
    """The worker's encoder, built once and kept while the worker is reused."""
    held = worker_state("byte_encoders", dict)
    return held.get((path, plain)) or held.setdefault((path, plain), ByteEncoder(path, plain))
