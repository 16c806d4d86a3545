"""Token ids of a byte-level BPE vocabulary file, inside Python workers.

The file is a ``tokenizers`` JSON (``byte_bpe_50k.json`` by default; a name
is looked up in the installed vocabulary package of the worker, a path is
taken as it is).  Its vocabulary is handed to the faster ``tiktoken`` merge
loop; the ids are the same, which the tests hold against ``tokenizers``
itself.  Control strings inside texts are ordinary text.
"""

from __future__ import annotations

import json
import os

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_file(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable letter: itself if printable, else 256 + n."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def encoder(vocabulary: str = VOCABULARY):
    """The worker's encoder for ``vocabulary``; loaded once a process."""
    import public_tokenizers
    import tiktoken

    known = tiktoken.registry.ENCODINGS  # the library's own table of loaded encodings
    key = f"loadkit:{vocabulary}"
    if key not in known:
        with open(vocabulary_file(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): rank
                 for token, rank in spec["model"]["vocab"].items() if token not in special}
        known[key] = tiktoken.Encoding(key, pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})
    return known[key]


def encode(enc, text: str | None, last: int) -> np.ndarray:
    """Ids of ``text`` (null: empty) and then the id ``last``, as unsigned 32-bit numbers."""
    ids = enc.encode_ordinary(text) if text else []
    ids.append(last)
    return np.array(ids, dtype="<u4")
