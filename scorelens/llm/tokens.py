"""Token ids of whole texts by a ``tokenizers`` file, fast enough for a corpus.

The pre-tokeniser of byte-level vocabularies always ends a piece at certain
places, whatever stands around them (before a space that a visible character
follows, between a letter and a punctuation mark, around a single line break). A
text may be cut there and the ids of the parts concatenated. The cuts are found on
the Arrow text buffer with numpy, equal parts of a batch are encoded once, and a
worker remembers the ids of parts it has met (a bounded memory; forgetting costs
time, not results). ``tests/llm`` holds this against plain encoding.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scorelens.llm import common as C
from scorelens.llm.common import ragged_take

# Byte classes for the cuts. Lead bytes C2, E1, E2 and E3 may start Unicode white
# space, "<" and "|" belong to special tokens: no cut depends on them.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_AFTER_SPACE = _VISIBLE.copy()
_AFTER_SPACE[0xC3:0xF5] = True
_AFTER_SPACE[[ord("<"), 0xE1, 0xE2, 0xE3]] = False
_WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _WORD[_a:_b] = True
_MARK = _VISIBLE & ~_WORD
_MARK[[ord("<"), ord("|")]] = False

REMEMBERED = 1_500_000
LONGEST_REMEMBERED = 64
JOINED = 1000
# parts of these characters can be encoded joined by line breaks and split at them
_PLAIN = r"^ ?[!-;=-~\x{C0}-\x{FF}]+$"


def pieces_of(text: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """The texts cut at safe places: all parts, and the index of each text's first
    part (with the total at the end). Joined parts give back the texts."""
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64, count=text.offset + n + 1)[text.offset:]
    if n == 0 or off[-1] == off[0]:
        return pa.array([], pa.large_string()), np.zeros(n + 1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[off[0]:off[-1]]
    bounds = off - off[0]
    filled = bounds[1:] > bounds[:-1]
    first = bounds[:-1][filled]
    # the byte before / after within the same text (0: none)
    before = np.empty_like(data)
    before[0], before[1:] = 0, data[:-1]
    before[first] = 0
    after = np.empty_like(data)
    after[-1], after[:-1] = 0, data[1:]
    after[bounds[1:][filled] - 1] = 0
    latin = np.zeros(len(data), bool)  # last byte of a two-byte letter of the C3 block
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    word_before = _WORD[before]
    word_before[1:] |= latin[:-1]
    word_before[first] = False
    seen_before = _VISIBLE[before] | word_before
    line = data == 0x0A
    cut = (data == 0x20) & _AFTER_SPACE[after]
    cut |= word_before & _MARK[data]
    alone = line & seen_before  # a line break after a visible character
    cut |= alone
    cut[1:] |= alone[:-1] & _AFTER_SPACE[data[1:]]
    cut[first] = True
    at = np.flatnonzero(cut)
    offsets = np.append(at, len(data)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return parts, np.searchsorted(at, bounds)


class TokenEncoder:
    """Encodes batches of texts with ``tokenizers`` (no special tokens added)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        ids = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = ids[0] if len(ids) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.known_starts = np.empty(0, np.int64)
        self.known_lens = np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0

    def _store(self, flat: np.ndarray) -> int:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(flat)), np.int32)])
        at = self.used
        self.flat[at:at + len(flat)] = flat
        self.used += len(flat)
        return at

    def _fresh(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ``flat`` of the ids of new parts."""
        starts, lens = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        plain = np.zeros(len(parts), bool)
        if self.line is not None:
            plain = pc.match_substring_regex(parts, _PLAIN).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain)
        if len(at):
            groups = np.append(np.arange(0, len(at), JOINED), len(at)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups), parts.take(pa.array(at)).cast(pa.string())), "\n")
            done = 0
            for e in self.tok.encode_batch_fast(joined.to_pylist(), add_special_tokens=False):
                ids = np.array(e.ids, np.int32)
                ends = np.append(np.flatnonzero(ids == self.line), len(ids))
                begins = np.concatenate([[0], ends[:-1] + 1])
                where = at[done:done + len(ends)]
                starts[where] = self._store(ids) + begins
                lens[where] = ends - begins
                done += len(ends)
            if done != len(at):
                raise ValueError("the tokenizer joins line breaks with other text")
        other = np.flatnonzero(~plain)
        if len(other):
            for k, e in zip(other, self.tok.encode_batch_fast(parts.take(pa.array(other)).to_pylist(),
                                                              add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                starts[k], lens[k] = self._store(ids), len(ids)
        return starts, lens

    def encode(self, text: pa.LargeStringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts, and the offset of each text's first id
        (total at the end). ``end_id`` is appended to every text if given."""
        if len(self.known) > REMEMBERED or self.known.nbytes > C.REMEMBERED_BYTES or 4 * self.used > C.REMEMBERED_BYTES:
            self._forget()
        parts, first = pieces_of(text)
        coded = parts.dictionary_encode()
        words = coded.dictionary
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        starts, lens = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = at >= 0
        starts[old], lens[old] = self.known_starts[at[old]], self.known_lens[at[old]]
        new = np.flatnonzero(~old)
        short = pc.less_equal(pc.binary_length(words), LONGEST_REMEMBERED).to_numpy(zero_copy_only=False)
        keep, long = new[short[new]], new[~short[new]]
        if len(keep):
            starts[keep], lens[keep] = self._fresh(words.take(pa.array(keep)))
            self.known = pa.concat_arrays([self.known, words.take(pa.array(keep))])
            self.known_starts = np.concatenate([self.known_starts, starts[keep]])
            self.known_lens = np.concatenate([self.known_lens, lens[keep]])
        remembered = self.used
        if len(long):
            starts[long], lens[long] = self._fresh(words.take(pa.array(long)))
        of = coded.indices.to_numpy(zero_copy_only=False) if len(parts) else np.empty(0, np.int64)
        of_lens = lens[of]
        ids = ragged_take(self.flat, starts[of], of_lens)
        self.used = remembered  # the ids of long parts are for this batch only
        if len(self.flat) > 4 * max(self.used, 1 << 16):
            self.flat = self.flat[:2 * max(self.used, 1 << 16)].copy()
        offsets = np.concatenate([[0], np.cumsum(of_lens)])[first]
        if end_id is None:
            return ids, offsets
        n = len(text)
        out = np.empty(len(ids) + n, np.int32)
        ends = offsets[1:] + np.arange(n)
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body] = ids
        out[ends] = end_id
        return out, offsets + np.arange(n + 1)


def encoder(path: str) -> TokenEncoder:
    """The worker's encoder for a tokenizer file."""
    return C.held(("tokens", path), lambda: TokenEncoder(path))
