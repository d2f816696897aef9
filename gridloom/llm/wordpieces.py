"""Ids of texts by a tokenizer file whose tokens never hold white space, through a bounded memory of chunks.

Such a tokenizer drops white space and cuts at it, so a text's ids are those of its chunks between spaces and line feeds, in
order. It lowers letters, so ASCII letters are lowered first; and a run of letters is a word of its own, so marks of punctuation that follow a letter and end a
chunk are chunks of their own. Both leave the ids as they are and the chunks fewer. (Texts that may hold names of added tokens, which have
a case, are left as they are.) A batch's chunks that aren't remembered are encoded in one call, joined by spaces.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Chunks remembered by one Python worker, and bytes of the longest; then it forgets all and starts again.
REMEMBERED, LONGEST = 900_000, 64
#: Bytes encoded in one call, and of a text that is cut into chunks at once.
CALL = 1 << 20
#: Punctuation at the end of a chunk after a letter: a to z, or one of those that UTF-8 begins with C3.
_END = re.compile(rb"[.,;:!?](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,;:!?]*(?=[ \n]|\Z)")
_encoders: dict[str, object] = {}


def _portions(chunks: list[str]) -> Iterator[list[str]]:
    """Chunks in runs of about CALL characters."""
    own, size = [], 0
    for chunk in chunks:
        own.append(chunk)
        size += len(chunk) + 1
        if size >= CALL:
            yield own
            own, size = [], 0
    if own:
        yield own


def _chunks(text: bytes) -> list[bytes]:
    if b"<|" not in text:
        text = _END.sub(rb" \g<0>", text.lower())
    return text.replace(b"\n", b" ").split(b" ")


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._of = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {b"": b""}

    def _encoded(self, chunks: list[str], letters: bool) -> list[bytes]:
        """The ids of each chunk, 32-bit little-endian, from one call. letters: each is a run of letters, and so the tokenizer's word of the same number."""
        found = self._of.encode(" ".join(chunks), add_special_tokens=False)
        ids = array.array("I", found.ids).tobytes()
        if letters:
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(chunks)), "right")
        else:
            ends = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), np.cumsum([len(c) + 1 for c in chunks]))
        ends = (ends * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that aren't remembered. Those of bounded length are from now on, and the others are returned."""
        passing: dict[bytes, bytes] = {}
        texts = b" ".join(fresh).decode().split(" ")
        for letters in (True, False):
            own = {t: c for c, t in zip(fresh, texts) if t.isalpha() is letters}
            for part in _portions(list(own)):
                for t, ids in zip(part, self._encoded(part, letters)):
                    c = own[t]
                    (self._known if len(c) <= LONGEST else passing)[c] = ids
        return passing

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), 32-bit little-endian."""
        if any(len(t) > CALL for t in texts):
            return [b"".join(self._few([part])[0] for part in _parts(t)) for t in texts]
        return self._few(texts)

    def _few(self, texts: list[bytes]) -> list[bytes]:
        cut = [_chunks(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known = {b"": b""}
        fresh = set(chain.from_iterable(cut)).difference(self._known)
        passing = self._learn(list(fresh)) if fresh else {}
        known = self._known
        if passing:
            return [b"".join([known[c] if c in known else passing[c] for c in chunks]) for chunks in cut]
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CALL bytes, cut at spaces and line feeds; one without them is one part."""
    at = 0
    while len(text) - at > CALL:
        ends = [x for x in (text.find(b" ", at + CALL), text.find(b"\n", at + CALL)) if x >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


def word_encoder(name: str) -> WordEncoder:
    """name: of a public tokenizer's file, or a path to one."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = WordEncoder(name if os.path.sep in name else public_tokenizers.path(name))
    return _encoders[name]
