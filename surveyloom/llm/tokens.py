"""Token ids of whole texts with the public vocabulary files."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

#: Characters for which both byte-level libraries split words alike beyond doubt.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ–-…]*")

#: White-space runs from this length on are not left to the fast pattern, which recurses over them.
LONG_SPACE = 10_000

_SPACE_RUN = re.compile(r"\s{100,}")

END = "<|endoftext|>"
END_ID = 50256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_bpe(json_path: str, ranks_path: str):
    """texts -> arrays of ids as the ``tokenizers`` library gives them for the json file.

    Plain texts are encoded from the same vocabulary given as ranks, several times as
    fast; texts with rarer characters, or with white-space runs of ``LONG_SPACE`` characters,
    go to the library itself. The end mark inside a text is one token, as it is there.
    """
    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(json_path)

    def plain(text: str):
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    def encode(text: str):
        if _PLAIN.fullmatch(text) is None or any(m.end() - m.start() >= LONG_SPACE for m in _SPACE_RUN.finditer(text)):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if END not in text:
            return plain(text)
        first, *rest = map(plain, text.split(END))
        mark = np.array([END_ID], dtype="<u4")
        return np.concatenate([first, *(part for ids in rest for part in (mark, ids))])

    return encode
