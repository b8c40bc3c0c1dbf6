"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no merge can reach over: between two characters that stand side
by side in no piece of the vocabulary. What lies between two cuts is a word; its ids
do not depend on its neighbours, so equal words of a batch are encoded once (and
remembered by the worker, in bounded memory).

All words of a batch lie in one flat numpy array of symbols. In a round each word's
smallest pair rank is found by a segmented minimum, every word merges the leftmost
pair of that rank at the same time, and the array is compacted; finished words
leave it. It ends when no pair is left. Since words are independent and each merges
exactly the pair the library's queue would take next, the ids are the library's.
Words of more than ``LONG_WORD`` symbols (a text without any cut) would need as many
rounds as symbols; they take the same merges in the same order from a heap.

Defined cases: null counts as the empty text, which has no ids; any length; repeated
rows are encoded like others; an empty table gives an empty result; characters
outside the vocabulary become byte pieces. Models with user-defined or unused pieces
or a normaliser that rewrites characters are refused with ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scorelens.llm import common as C

LONG_WORD = 256
REMEMBERED = 1_500_000
SPACE = "▁"
_NONE = np.iinfo(np.int32).max


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        field, kind = tag >> 3, tag & 7
        if kind == 0:
            yield field, kind, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield field, kind, data[at:at + n]
            at += n


class PieceModel:
    """The vocabulary and merge table of a BPE model file."""

    # field numbers of the public model format, fixed values
    PIECE, TRAINER, NORMALIZER = 1, 2, 3
    NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, kinds, scores, trainer, normal = [], [], [], {}, {}
        for field, _, value in _fields(data):
            if field == self.PIECE:
                own = {k: v for k, _, v in _fields(value)}
                pieces.append(own.get(1, b"").decode())
                scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                kinds.append(own.get(3, self.NORMAL))
            elif field == self.TRAINER:
                trainer = {k: v for k, _, v in _fields(value)}
            elif field == self.NORMALIZER:
                normal = {k: v for k, _, v in _fields(value)}
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if self.USER_DEFINED in kinds or self.UNUSED in kinds or trainer.get(24, 0):
            raise ValueError("user-defined or unused pieces, or spaces as suffixes, are not supported")
        if normal.get(2, b"") or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models that keep the characters as they are")
        self.pieces, self.dummy_prefix = pieces, bool(normal.get(3, 1))
        plain = {p: i for i, p in enumerate(pieces) if kinds[i] == self.NORMAL}
        self.unknown = kinds.index(self.UNKNOWN)
        self.byte_ids = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)]) if trainer.get(35, 0) else None

        # symbols: the normal pieces by id, then characters that only occur inside pieces
        symbol = dict(plain)
        inner = sorted({c for p in plain if len(p) > 1 for c in p} - set(plain))
        symbol |= {c: len(pieces) + k for k, c in enumerate(inner)}
        self.inner = inner
        rank = {s: k for k, s in enumerate(sorted({-scores[i] for i in plain.values()}))}
        merges = [(symbol[p[:k]], symbol[p[k:]], rank[-scores[i]], i)
                  for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.n_symbols = len(pieces) + len(inner)
        left, right, ranks, made = (np.array(x, np.int64) for x in zip(*merges))
        key = left * self.n_symbols + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], ranks[order].astype(np.int32), made[order]
        self.merge = {int(k): (int(r), int(m)) for k, r, m in zip(key, ranks, made)}

        self.symbol_of_char = np.full(0x110000, -1, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.symbol_of_char[ord(c)] = s
        # a cut lies between characters that stand side by side in no piece
        inside = sorted({c for p in plain if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.int16)
        self.kind[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.beside = np.zeros((len(inside) + 1,) * 2, bool)
        for p in plain:
            if len(p) > 1:
                k = self.kind[[ord(c) for c in p]]
                self.beside[k[:-1], k[1:]] = True
        # text of each id: bytes stand for themselves, control pieces for nothing
        shown = [p.replace(SPACE, " ").encode() if kinds[i] == self.NORMAL else
                 bytes([int(p[3:5], 16)]) if kinds[i] == self.BYTE else
                 " ⁇ ".encode() if kinds[i] == self.UNKNOWN else b"" for i, p in enumerate(pieces)]
        self.shown = pa.array(shown, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())

    def _heap(self, symbols: list[int]) -> list[int]:
        """The merges of one long word, best first from a heap."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                m = self.merge.get(symbols[i] * self.n_symbols + symbols[j])
                if m:
                    heapq.heappush(heap, (m[0], i, symbols[i], symbols[j]))

        symbols = list(symbols)
        dead = [False] * n
        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = self.merge[a * self.n_symbols + b][1]
            dead[j] = True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s, d in zip(symbols, dead) if not d]

    def merge_words(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left. symbols: all words' symbols (below 0: stands
        alone); starts: each word's first one. Returns the symbols left, and starts."""
        n_words = len(starts)
        size = np.diff(np.append(starts, len(symbols)))
        word = np.repeat(np.arange(n_words), size)
        done_word, done_symbols = [], []
        long = size > LONG_WORD
        for w in np.flatnonzero(long):
            s = self._heap(symbols[starts[w]:starts[w] + size[w]].tolist())
            done_word.append(np.full(len(s), w))
            done_symbols.append(np.array(s, np.int64))
        keep = ~long[word]
        s, word = symbols[keep].astype(np.int64), word[keep]
        while len(s):
            rank = np.full(len(s), _NONE, np.int32)
            made = np.zeros(len(s), np.int64)
            if len(s) > 1:
                key = s[:-1] * self.n_symbols + s[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                pair = (self.keys[at] == key) & (word[:-1] == word[1:]) & (s[:-1] >= 0) & (s[1:] >= 0)
                rank[:-1][pair] = self.ranks[at[pair]]
                made[:-1] = self.made[at]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            of = np.repeat(least, np.diff(np.append(first, len(s))))
            open_ = of != _NONE
            if not open_.all():  # finished words leave
                done_word.append(word[~open_])
                done_symbols.append(s[~open_])
                s, word, rank, made, of = s[open_], word[open_], rank[open_], made[open_], of[open_]
                if not len(s):
                    break
            hit = np.flatnonzero(rank == of)
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]  # the leftmost of each word
            s[hit] = made[hit]
            stay = np.ones(len(s), bool)
            stay[hit + 1] = False
            s, word = s[stay], word[stay]
        if not done_word:
            return np.empty(0, np.int64), np.zeros(n_words, np.int64)
        word, s = np.concatenate(done_word), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return s[order], np.searchsorted(word[order], np.arange(n_words))


class PieceEncoder:
    """Encodes and decodes batches of texts with a model."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.starts = np.empty(0, np.int64)
        self.lens = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the words, and each word's start and number of ids."""
        m = self.model
        chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        shown = np.where(chars == 0x20, ord(SPACE), chars)
        symbols = m.symbol_of_char[shown].astype(np.int64)
        symbols = np.where(symbols < 0, -1 - shown, symbols)  # outside the vocabulary: the character itself
        s, starts = m.merge_words(symbols, np.cumsum(size) - size)
        lens = np.diff(np.append(starts, len(s)))
        # characters without a piece of their own become bytes, or unknown
        bare = (s < 0) | (s >= len(m.pieces))
        if not bare.any():
            return s.astype(np.int32), starts, lens
        out, width = [], np.ones(len(s), np.int64)
        odd = {}
        for k in np.flatnonzero(bare):
            c = chr(-1 - s[k]) if s[k] < 0 else m.inner[s[k] - len(m.pieces)]
            if c not in odd:
                odd[c] = m.byte_ids[list(c.encode())] if m.byte_ids is not None else np.array([m.unknown])
            out.append(odd[c])
            width[k] = len(odd[c])
        ends = np.cumsum(width)
        ids = np.empty(int(ends[-1]), np.int32)
        ids[(ends - 1)[~bare]] = s[~bare]
        fill = np.repeat(bare, width)
        ids[fill] = np.concatenate(out)
        total = np.append(0, ends)
        first = np.append(starts, len(s))
        return ids, total[first[:-1]], total[first[1:]] - total[first[:-1]]

    def encode(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offset of each text's first id (and the end)."""
        m = self.model
        if len(self.known) > REMEMBERED or self.known.nbytes > C.REMEMBERED_BYTES or self.flat.nbytes > C.REMEMBERED_BYTES:
            self._forget()
        whole = pc.replace_substring(text, SPACE, " ")  # both stand for the same symbol
        if m.dummy_prefix:
            none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
            whole = pc.if_else(pc.equal(whole, none), none, pc.binary_join_element_wise(space, whole, none))
        n = len(whole)
        off = np.frombuffer(whole.buffers()[1], np.int64, count=whole.offset + n + 1)[whole.offset:]
        if n == 0 or off[0] == off[-1]:
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        raw = np.frombuffer(whole.buffers()[2], np.uint8)[off[0]:off[-1]]
        bounds = off - off[0]
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        begin = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
        kind = m.kind[np.where(chars == 0x20, ord(SPACE), chars)]
        cut = np.ones(len(chars), bool)
        cut[1:] = ~m.beside[kind[:-1], kind[1:]]
        cut[np.searchsorted(begin, bounds[:-1][bounds[1:] > bounds[:-1]])] = True
        at = begin[cut]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int64)),
                                                 pa.py_buffer(raw)).dictionary_encode()
        first = np.searchsorted(at, bounds)
        unique = words.dictionary
        where = pc.fill_null(pc.index_in(unique, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(where < 0)
        starts, lens = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        old = where >= 0
        starts[old], lens[old] = self.starts[where[old]], self.lens[where[old]]
        if len(new):
            fresh = unique.take(pa.array(new))
            ids, s, k = self._encode_words(fresh)
            starts[new], lens[new] = s + len(self.flat), k
            self.flat = np.concatenate([self.flat, ids])
            self.known = pa.concat_arrays([self.known, fresh])
            self.starts, self.lens = np.concatenate([self.starts, starts[new]]), np.concatenate([self.lens, k])
        of = words.indices.to_numpy(zero_copy_only=False)
        n_ids = lens[of]
        return C.ragged_take(self.flat, starts[of], n_ids), np.append(0, np.cumsum(n_ids))[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids. Bytes that are no UTF-8 become U+FFFD each."""
        data, at = _taken(self.model.shown, ids)
        out = []
        for a, b in zip(at[offsets[:-1]].tolist(), at[offsets[1:]].tolist()):
            t = bytes(data[a:b])
            if self.model.dummy_prefix and t[:1] == b" ":
                t = t[1:]
            try:
                t.decode()
            except UnicodeDecodeError:
                t = t.decode(errors="replace").encode()
            out.append(t)
        return out


def _taken(values: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Bytes of ``values`` in the order of ``ids``, and the offset of each (and the end)."""
    if not len(ids):
        return memoryview(b""), np.zeros(1, np.int64)
    got = values.take(pa.array(ids))
    return memoryview(got.buffers()[2]), np.frombuffer(got.buffers()[1], np.int64, count=len(ids) + 1)


def encoder(path: str) -> PieceEncoder:
    return C.held(("pieces", path), lambda: PieceEncoder(path))


def sentence_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text",
                    keep: bool = True) -> DataFrame:
    """Ids of every whole text and the text decoded from them: id, n_tokens,
    ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and, if kept,
    ids and decoded."""
    C.prepare(docs.sparkSession)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in C.slices(batches, text):
            ids, off = enc.encode(C.texts(batch, text))
            digits, at = _taken(enc.model.decimal, ids)
            a, b = at[off[:-1]].tolist(), at[off[1:]].tolist()
            ids_sha = [hashlib.sha256(digits[i:max(i, j - 1)]).hexdigest() for i, j in zip(a, b)]
            decoded = enc.decode(ids, off)
            cols = [C.column(batch, id_col), pa.array(np.diff(off)), pa.array(ids_sha, pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string())]
            if keep:
                cols += [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)),
                         pa.array(decoded, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, C.text_or_empty(text).alias(text)).mapInArrow(run, T.StructType(fields))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = C.table(spark, sf_dir, "documents")
    return sentence_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=False)
