"""Byte-level BPE ids of texts, through a bounded memory of words.

Where a single space stands between two characters that aren't white space, no token crosses from before the space, so
a text without other white space next to spaces is encoded piece by piece; each piece (with the space before it) is
encoded once while it is remembered. Other texts are encoded whole. Both give the tokenizer's own ids.
"""

from __future__ import annotations

import array
import json
import os
import re

_ODD = re.compile(r"\s | \s")
#: Pieces remembered by one Python worker; then it forgets all and starts again.
REMEMBERED = 800_000
_encoders: dict[str | tuple[str, str], object] = {}


class _Pieces(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def encoder(name: str):
    """A function from text to the bytes of its ids, 32-bit little-endian. name: of a public tokenizer's rank file, or a path to one.

    The rank file is the vocabulary and merge order of the tokenizer file of the same name, so ids are the same (a test
    holds the two against each other); its encoder has several times less work a call. Names of special tokens in a
    text are ordinary text here; library_encoder() takes them as the tokenizer file does.
    """
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(name if os.path.sep in name else public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole = lambda text: array.array("I", plain(text)).tobytes()
        known = _Pieces(whole)

        def encode(text: str) -> bytes:
            if _ODD.search(text):
                return whole(text)
            first, *more = text.split(" ")
            return (known[first] if first else b"") + b"".join(map(known.__getitem__, [" " + p for p in more]))

        _encoders[name] = encode
    return _encoders[name]


def library_encoder(name: str):
    """encoder(name) with the ids that the tokenizer file of the same name gives by default: a text that holds the name of an added token is encoded with that file itself. A rank file without such a file beside it has no added tokens."""
    import public_tokenizers

    key = (name, "library")
    if key not in _encoders:
        plain = encoder(name)
        base = os.path.splitext(name)[0] + ".json"
        path = base if os.path.sep in name else public_tokenizers.path(base)
        added: list[str] = []
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                added = [t["content"] for t in json.load(f).get("added_tokens") or []]
        known = re.compile("|".join(map(re.escape, added))) if added else None
        files: list = []

        def encode(text: str) -> bytes:
            if known is None or not known.search(text):
                return plain(text)
            if not files:
                from tokenizers import Tokenizer

                files.append(Tokenizer.from_file(path))
            return array.array("I", files[0].encode(text, add_special_tokens=False).ids).tobytes()

        _encoders[key] = encode
    return _encoders[key]
