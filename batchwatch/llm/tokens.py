"""Token ids of whole texts by a public vocabulary file."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: how a byte-level vocabulary of this kind cuts a text before it joins bytes (fixed value)
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level vocabulary whose ids follow the order of its merges, else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    added = {x["content"] for x in spec["added_tokens"]}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in added}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    usual = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
             and not cut.get("add_prefix_space") and not spec["normalizer"] and merged == sorted(merged))
    symbol = byte_symbols()
    return {bytes(map(symbol.__getitem__, k)): v for k, v in vocabulary.items()} if usual else None


@lru_cache(maxsize=4)
def codec(path: str, added: bool = False) -> tuple[Callable[[str], array], Callable[[list[int]], bytes], int]:
    """(text to ids, ids to UTF-8, first id that the vocabulary leaves free), once per worker process.

    Ids equal those of the tokenizers library with add_special_tokens=False.  With ``added``, strings of the
    vocabulary's added tokens in a text become their ids, as the library does by default; else they are ordinary
    text.  A byte-level vocabulary whose ids follow its merges is run by tiktoken, which is several times faster; any
    other, and texts with added tokens, by tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    free = tokenizer.get_vocab_size()
    ranks = _ranks(path)

    def by_library(text: str) -> array:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids)

    if ranks is None:
        return by_library, lambda ids: tokenizer.decode(ids, skip_special_tokens=False).encode(), free
    import tiktoken

    fast = tiktoken.Encoding("ids", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})
    if not added:
        return lambda text: array("I", fast.encode_ordinary(text)), fast.decode_bytes, free
    found = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
    return (lambda text: by_library(text) if found(text) else array("I", fast.encode_ordinary(text)),
            fast.decode_bytes, free)
