"""Token ids of whole texts, cached by blank-separated chunk.

Both vocabularies encode a chunk between single blanks the same way wherever it stands, so a cache of chunks replaces
most of the work of the tokenizer. Texts with other white space, with characters outside a plain set, or with what may be
one of the vocabulary's added tokens (such as ``<|endoftext|>``, which the tokenizer reads as that token's id) are given
whole to the tokenizer itself. Results are equal to ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

#: Letters, digits, marks and blanks that every Unicode version classes alike.
PLAIN = "\t\n\r\x20-\x7eÀ-ÖØ-öø-įĲ-žА-я€‐-‧‰-⁕"
_plain = re.compile(f"[{PLAIN}]*").fullmatch
_uneven = re.compile(r"[\t\r]|[ \n][ \n]").search
CACHE, LONGEST = 600_000, 48  #: entries of a worker's cache, and characters of its longest key
BYTE_CACHE = 150_000  #: entries for byte-level chunks, which stand beside other stages' workers in a pipeline
TEXT_BLOCK = 1 << 20  #: characters of a text whose chunks are a list at once


def packed(ids) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    a = array("I", ids)
    if a.itemsize != 4 or __import__("sys").byteorder != "little":
        return b"".join(int(i).to_bytes(4, "little") for i in ids)
    return a.tobytes()


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _added(tokenizer):
    """Whether a text may hold an added token: a function that looks for the tokens' first two characters, in any case."""
    heads = sorted({t.content[:2].lower() for t in tokenizer.get_added_tokens_decoder().values()})
    if not heads:
        return lambda text: False
    if any(h != h.upper() for h in heads):
        return lambda text: any(h in text.lower() for h in heads)
    return lambda text: any(h in text for h in heads)


class _Chunks(dict):
    """chunk -> packed ids, filled on demand up to ``most`` entries."""

    def __init__(self, encode, most: int = CACHE):
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        found = self.encode(chunk)
        if len(chunk) <= LONGEST and len(self) < self.most:
            self[chunk] = found
        return found


class ByteBpe:
    """Byte-level BPE; ``ranks`` holds the same vocabulary for the faster library that encodes new chunks."""

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.whole = _load(path)
        self.added = _added(self.whole)
        self.chunks = _Chunks(lambda c: packed(self.plain(c if c[:1] == "\n" else f" {c}")), BYTE_CACHE)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not _plain(text) or self.added(text):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        if _uneven(text):
            return packed(self.plain(text))
        text = text.replace("\n", " \n")  # each chunk but the first follows a blank or starts with its line feed
        at = text.find(" ")
        if at < 0:
            return packed(self.plain(text))
        parts = [packed(self.plain(text[:at]))]
        while at >= 0:
            end = text.find(" ", at + TEXT_BLOCK)
            parts.append(b"".join(map(self.chunks.__getitem__, (text[at + 1 : end] if end >= 0 else text[at + 1 :]).split(" "))))
            at = end
        return b"".join(parts)


def _bytes_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Lower-casing BPE with word ends, which drops white space: chunks between white space are independent.

    New words of plain chunks are merged by the faster library, over the same vocabulary with the word end written as one
    control byte; every merge makes the token of the lowest id first, as in the vocabulary's own list of merges.
    """

    END = "\x01"

    def __init__(self, path: str):
        import json

        import tiktoken

        self.whole = _load(path)
        self.added = _added(self.whole)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte, end = _bytes_of(), self.END.encode()
        ranks = {}
        for token, i in vocabulary.items():
            word = token.removesuffix("</w>")
            if all(c in byte for c in word) and not (token.startswith("<|") and token.endswith("|>")):
                ranks[bytes(byte[c] for c in word) + end * (word != token)] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        letters = "a-zà-öø-įĲ-žß-öø-ÿа-я"
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\\s{letters}0-9]+").findall
        self.words = _Chunks(lambda w: packed(self.merge(w + self.END)))
        self.chunks = _Chunks(lambda c: b"".join(map(self.words.__getitem__, self.pieces(c))))

    def batch(self, texts: list[str]) -> list[bytes]:
        known = self.chunks.__getitem__
        return [b"".join(map(known, t.lower().split())) if _plain(t) and not self.added(t) else packed(self.whole.encode(t, add_special_tokens=False).ids) for t in texts]


_made: dict[tuple, object] = {}


def let_go(encoders: bool = True) -> None:
    """Give back what a worker process has kept of other tasks: free memory and, for a task that encodes nothing, the encoders."""
    import ctypes
    import gc

    import pyarrow as pa

    if encoders:
        _made.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function of batches, in a worker process that lets go of other tasks' memory before it and of its own after it."""

    def within(batches: Iterator) -> Iterator:
        let_go()
        yield from run(batches)
        let_go()

    return within


def encoder(kind: type, *args: str):
    """One encoder for each worker process, so that its cache serves all of the worker's tasks."""
    key = (kind.__name__, *args)
    if key not in _made:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _made[key] = kind(*args)
    return _made[key]
