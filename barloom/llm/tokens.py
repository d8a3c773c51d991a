"""Token ids of many texts: the tokenizer runs once per distinct chunk, the rest is gathering."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from barloom.llm.words import NON_SPACE, Words, byte_hashes, ragged_ranges, split_words

#: Chunks that a Python worker keeps; it starts anew beyond them.
CACHE_CHUNKS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkTokenizer:
    """Byte-level BPE over chunks that its pre-tokenizer never joins.

    Such a pre-tokenizer takes at most one space in front of a run of non-space
    characters and never crosses from such a run into white space.  So a text is the
    concatenation of chunks: a run with the space before it, and what is left of a gap
    (its last character apart, unless the gap ends the text or goes to a run).  Texts
    with white space beyond ASCII, or with strings of special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self):
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.at = np.zeros(1 << 14, dtype=np.int64)  # slot k has ids[at[k] : at[k + 1]]
        self.slots = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of the texts in them."""
        words = split_words(texts, NON_SPACE)
        start, end = _chunks(words)
        odd = _odd_texts(words)
        first = np.searchsorted(start, words.text_at)
        first[-1] = len(start)
        hashes = byte_hashes(words.data, start, end)
        uniq, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > CACHE_CHUNKS:
            self._forget()
        slots = np.array([self.known.get(h, -1) for h in uniq.tolist()], dtype=np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            data = words.data.tobytes()
            said = [data[s:e].decode("utf-8", "replace") for s, e in zip(start[where[new]].tolist(), end[where[new]].tolist())]
            slots[new] = self._keep([x.ids for x in self.tokenizer.encode_batch_fast(said, add_special_tokens=False)])
            self.known.update(zip(uniq[new].tolist(), slots[new].tolist()))
        slot = slots[inverse]
        begin, count = self.at[slot], self.at[slot + 1] - self.at[slot]
        ids = self.ids[ragged_ranges(begin, count)]
        ends = np.concatenate([[0], np.cumsum(count)])[first]
        if odd.any():
            ids, ends = self._whole(texts, odd, ids, ends)
        return ids, ends

    def _keep(self, found: list[list[int]]) -> np.ndarray:
        """Stores the ids of new chunks; returns their slots."""
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        first, used = self.slots, int(self.at[self.slots])
        total = used + int(counts.sum())
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(found) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[used:total] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=total - used)
        self.at[first + 1 : first + len(found) + 1] = used + np.cumsum(counts)
        self.slots += len(found)
        return np.arange(first, self.slots)

    def _whole(self, texts, odd, ids, ends):
        parts = [ids[ends[k] : ends[k + 1]] for k in range(len(odd))]
        for k in np.flatnonzero(odd).tolist():
            parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _chunks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    data, at = words.data, words.text_at
    doc = words.doc
    start, end = words.start, words.end
    before = at[:-1][doc]  # where the gap before each word begins
    later = np.zeros(len(start), dtype=bool)
    later[1:] = doc[1:] == doc[:-1]
    before[later] = end[:-1][later[1:]]
    spaced = (start > before) & (data[np.maximum(start - 1, 0)] == 0x20)
    head = start - spaced
    gap = head > before
    cut = np.where(gap & ~spaced, start - 1, head)  # the last character of a gap stands alone unless it is the word's space
    some = gap & (cut > before)
    single = gap & ~spaced
    filled = words.counts > 0
    tail = at[:-1].copy()
    tail[filled] = end[words.first[1:][filled] - 1]
    trailing = tail < at[1:]
    starts = np.concatenate([head, before[some], cut[single], tail[trailing]])
    ends = np.concatenate([end, cut[some], start[single], at[1:][trailing]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _odd_texts(words: Words) -> np.ndarray:
    """Texts with separators 0x1C-0x1F, white space beyond ASCII, or '<|'."""
    d = words.data
    x, y, z = d, np.append(d[1:], [0])[: len(d)], np.append(d[2:], [0, 0])[: len(d)]
    odd = (x >= 0x1C) & (x <= 0x1F) | (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == ord("<")) & (y == ord("|"))
    odd |= (x == 0xE1) & ((y == 0x9A) | (y == 0xA0)) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    odd |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8B) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    at = np.flatnonzero(odd)
    out = np.zeros(len(words.text_at) - 1, dtype=bool)
    out[np.searchsorted(words.text_at, at, side="right") - 1] = True
    return out
