"""Token ids of texts, by the vocabulary files of public tokenizers."""

from __future__ import annotations

import functools
from collections.abc import Callable


def _byte_of() -> dict[str, int]:
    """The byte that each character stands for in a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids as by tokenizers' Tokenizer.from_file(path).encode(text, add_special_tokens=False).

    For byte-level BPE whose merges have the order of its ids, tiktoken gives the same ids several times as fast;
    texts that hold a special token's string go through tokenizers itself, and so do all texts for other files.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"].get("vocab"), [t["content"] for t in spec.get("added_tokens", [])]
    split, byte = spec.get("pre_tokenizer") or {}, _byte_of()
    if not (spec["model"].get("type", "BPE") == "BPE" and isinstance(vocab, dict) and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer")):
        return plain
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = [vocab["".join(m)] for m in pairs]
    if made != sorted(made):
        return plain
    ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in special and all(c in byte for c in word)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: plain(text) if any(s in text for s in special) else fast.encode_ordinary(text)
