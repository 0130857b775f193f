"""Token ids of public tokenizer files.

A byte-level BPE file gives the same ids through ``tiktoken``, several times faster than through ``tokenizers``: equal vocabulary,
equal pattern, and merge ranks in the order of the ids. ``by_ranks`` compares both on ``PROBES`` before it is used; where they differ
``tokenizers`` is. Special-token strings inside texts are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

PROBES = ("", " ", "The cat's 12 mats,\n\n  don't!", "Éaux  être\t\tß — 漢字  x  y ٣٤ \U0001f600", "<|endoftext|> a\r\n\r\nb ", "AbC" * 50 + "   \n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The ``tokenizers`` object of a file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def byte_of_symbol() -> dict[str, int]:
    """The printable symbols that byte-level vocabularies use for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks(path: str) -> dict[bytes, int]:
    model = json.load(open(path, encoding="utf-8"))
    special = {x["content"] for x in model.get("added_tokens", [])}
    byte = byte_of_symbol()
    return {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def by_ranks(path: str, slow, marks: dict[str, int] | None = None):
    """The ``tiktoken`` object of a byte-level BPE file with the ``marks`` added, if it gives the ids of ``slow`` on ``PROBES``; else None."""
    try:
        import public_tokenizers
        import tiktoken

        found = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=marks or {})
        if all(found.encode_ordinary(p) == slow.encode(p, add_special_tokens=False).ids for p in PROBES):
            return found
    except (ImportError, KeyError, ValueError, AttributeError):  # not a byte-level BPE file, or no such library
        pass
    return None


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> unsigned 32-bit ids, without special tokens."""
    slow = load(path)
    fast = by_ranks(path, slow)
    if fast is not None:
        return lambda text: np.array(fast.encode_ordinary(text), np.uint32)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def offset_encoder(path: str, marks: list[str]) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """text -> (ids, [start, end) code points of each token), with ``marks`` as added tokens.

    A token that holds a part of a character's bytes reaches over the whole character. With ``tiktoken`` the offsets are sums of the tokens'
    lengths in bytes, counted back to code points where a text isn't ASCII.
    """
    plain, slow = load(path), load(path)
    slow.encode_special_tokens = False
    slow.add_special_tokens(marks)
    ids = {m: slow.token_to_id(m) for m in marks}
    fast = by_ranks(path, plain, ids)

    def by_tokenizers(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = slow.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.array(found.offsets, np.int32).reshape(-1, 2)

    if fast is None:
        return by_tokenizers
    widths = np.zeros(max(max(fast._mergeable_ranks.values()), *ids.values()) + 1, np.int64)
    for token, i in fast._mergeable_ranks.items():
        widths[i] = len(token)
    for token, i in ids.items():
        widths[i] = len(token.encode())
    allowed = set(marks)

    def by_widths(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(fast.encode(text, allowed_special=allowed, disallowed_special=()), np.int32)
        ends = np.cumsum(widths[found])
        starts = ends - widths[found]
        if not text.isascii():
            leads = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32)
            starts, ends = leads[starts] - 1, leads[ends - 1]
        return found, np.stack([starts, ends], axis=1).astype(np.int32)

    return by_widths
