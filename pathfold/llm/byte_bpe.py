"""Byte-level BPE ids of whole texts through the tokenizers library, encoding each distinct pre-token once.

The vocabulary's split pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Pre-tokens are encoded independently of each other, so their boundaries are found here for a whole block at once and
only pre-tokens not met before go to the library. Texts with characters outside PLAIN, or with a special token's
string, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from pathfold.llm.textvec import Block, Memo, blocks

#: Code points below it are split here (Latin scripts and general punctuation are most of a corpus); others go whole.
PLAIN = 0x2100
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_WHITE = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}


def _kind(code: int) -> int:
    if code in _WHITE:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(code))[0], _OTHER)


_KINDS = np.array([_kind(c) for c in range(PLAIN)], dtype=np.int8)
_KINDS_OK = np.array([unicodedata.category(chr(c)) != "Cn" for c in range(PLAIN)])


def pre_tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of all texts of the block, in order. All code points are below PLAIN."""
    codes, n = block.codes, len(block.codes)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    kind = _KINDS[codes]
    between = np.zeros(n + 1, dtype=bool)  # the newlines that join the texts
    between[block.ends[:-1]] = True
    start = np.zeros(n + 1, dtype=bool)
    start[0] = start[n] = True
    start[1:n] = kind[1:] != kind[:-1]
    start[block.ends] = True
    start[np.minimum(block.ends + 1, n)] = True
    space = np.zeros(n + 1, dtype=bool)
    space[:n] = kind == _SPACE
    solid = np.zeros(n + 1, dtype=bool)
    solid[:n] = (kind != _SPACE) & ~between[:n]
    # The last white-space character before a solid one leaves its run; a blank joins what follows.
    before = np.flatnonzero(space[:n] & ~between[:n] & solid[1:])
    start[before] = True
    blank = before[codes[before] == 32]
    start[blank + 1] = False
    # Contractions: an apostrophe that begins a pre-token, alone in its run, before one of the fixed endings.
    apostrophes = np.flatnonzero((codes == 39) & start[:n] & start[1:])
    if len(apostrophes):
        pad = np.concatenate((codes, np.zeros(3, dtype=codes.dtype)))
        a, b = pad[apostrophes + 1], pad[apostrophes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hits, size in ((apostrophes[one], 2), (apostrophes[two], 3)):
            start[hits + 1] = False
            start[hits + size] = True
    at = np.flatnonzero(start)
    s, e = at[:-1], at[1:]
    keep = ~between[s]
    return s[keep], e[keep]


class Encoder:
    """encode(texts) gives one int32 array of ids for each text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self._library)

    def _library(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), 2_000):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + 2_000], add_special_tokens=False)]
        return out

    def _whole(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, group in blocks(texts):
            block = Block(group)
            wild = np.flatnonzero((block.codes >= PLAIN) | ~_KINDS_OK[np.minimum(block.codes, PLAIN - 1)])
            odd = set(block.owner(wild).tolist()) | {i for i, t in enumerate(group) if self._whole(t)}
            whole = dict(zip(sorted(odd), self._library([group[i] for i in sorted(odd)]), strict=True))
            if odd:
                block = Block(["" if i in odd else t for i, t in enumerate(group)])
            s, e = pre_tokens(block)
            ids, size = self.memo.gather(self.memo.rows(block, s, e)) if len(s) else (np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))
            upto = np.concatenate(([0], np.cumsum(size)))
            first = upto[np.searchsorted(s, block.starts)]
            last = upto[np.searchsorted(s, block.ends)]
            out += [np.array(whole[i], dtype=np.int32) if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True))]
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this process for the vocabulary file; its memo lives as long as the worker."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]
