"""Public tokenizer vocabularies, loaded once per Python worker."""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable

from glyphmill.llm.arrays import process_cache

#: Bytes of words and their ids that a worker keeps; beyond it starts anew.
KEPT_BYTES = 48 << 20


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sentence_pieces(path: str):
    """A BPE vocabulary with byte fallback: (encode a text, ids that stand for
    a single byte)."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        single = {i for i in range(model.get_piece_size()) if model.is_byte(i) or model.is_unknown(i)}
        return model.encode, single

    return process_cache(f"pieces:{path}", load)


def byte_ranks(path: str, pattern: str | None = None):
    """A byte-level BPE vocabulary given as ranks: text to ids, no special tokens."""

    def load():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(
            path, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    return process_cache(f"ranks:{path}", load)


def json_tokenizer(path: str):
    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return process_cache(f"json:{path}", load)


class Remembered(dict):
    """A dict that makes what it lacks, and starts anew once keys and values take
    ``limit`` bytes. What takes a thousandth of that by itself is not kept."""

    #: What an entry takes besides its two objects.
    ENTRY = 100

    def __init__(self, make: Callable, limit: int = KEPT_BYTES):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        size = sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
        if 1000 * size <= self.limit:
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self.held += size
            self[key] = value
        return value
