"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of bounded size, each beginning at a
code point, with the cumulative number of code points at each frame's end. A range of
code points is found by binary search in these numbers: only the frames that a cut
goes through are decompressed and compressed anew, whole frames in between are taken
over as they are. The rearranged text is such a store again; texts, digests and the
restored original are read from it frame by frame, so that no step but the reading of
the given row holds a whole text.

The prefix ends after the smaller and the middle after the larger of two hashes of the
id modulo n + 1 (n code points); further hashes choose plain, psm or spm
(``Cuts``). psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm ``<S>`` suffix
``<P>`` prefix ``<M>`` middle.

Defined cases: a null text is empty; an empty text, or one that holds a marker, stays
plain, with null prefix and middle lengths; a null id counts as the empty id;
repeated rows give repeated rows; an empty table gives no rows; input columns named
like an output column give way to it, all others but the text travel along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME_BYTES = 1 << 16
RUN_BYTES = 4 << 20  # compressed bytes of the rows in one output batch
STORE = [T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType()),
         T.StructField("frames", T.ArrayType(T.BinaryType())), T.StructField("ends", T.ArrayType(T.LongType()))]
SHAPE = [T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
         T.StructField("middle_chars", T.LongType())]


def units(raw: bytes) -> int:
    """Code points of UTF-8 bytes that begin at one."""
    if raw.isascii():
        return len(raw)
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def byte_at(raw: bytes, unit: int) -> int:
    """Where the code point number ``unit`` begins."""
    if raw.isascii():
        return unit
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return int(starts[unit]) if unit < len(starts) else len(raw)


class Frames:
    """A text as independent frames with the number of code points up to each end."""

    pack = staticmethod(zstandard.ZstdCompressor(level=1).compress)
    unpack = staticmethod(zstandard.ZstdDecompressor().decompress)

    def __init__(self, data: list[bytes] | None = None, ends: list[int] | None = None):
        self.data, self.ends = data or [], ends or []

    @classmethod
    def of(cls, raw: bytes, size: int = FRAME_BYTES) -> Frames:
        out, at = cls(), 0
        while at < len(raw):
            stop = min(at + size, len(raw))
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop += 1
            out.add(raw[at:stop])
            at = stop
        return out

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, raw: bytes) -> None:
        if raw:
            self.data.append(self.pack(raw))
            self.ends.append(len(self) + units(raw))

    def add_range(self, other: Frames, start: int, stop: int) -> None:
        """Append the code points [start, stop) of ``other``; whole frames are not unpacked."""
        for k, a, b in other._cuts(start, stop):
            if (a, b) == (0, other._size(k)):
                self.data.append(other.data[k])
                self.ends.append(len(self) + b)
            else:
                self.add(other._part(k, a, b))

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The bytes of the code points [start, stop), a frame at a time."""
        for k, a, b in self._cuts(start, len(self) if stop is None else stop):
            yield self._part(k, a, b)

    def find(self, mark: bytes, start: int = 0) -> int:
        """The first code point at or after ``start`` where the ASCII ``mark`` begins, or -1."""
        kept, at = b"", start  # at: code point where the held bytes begin
        for raw in self.stream(start):
            raw = kept + raw
            hit = raw.find(mark)
            if hit >= 0:
                return at + units(raw[:hit])
            cut = max(len(raw) - len(mark) + 1, 0)
            while cut > 0 and raw[cut:cut + 1] and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            at, kept = at + units(raw[:cut]), raw[cut:]
        return -1

    def _size(self, k: int) -> int:
        return self.ends[k] - (self.ends[k - 1] if k else 0)

    def _part(self, k: int, a: int, b: int) -> bytes:
        raw = self.unpack(self.data[k])
        return raw if (a, b) == (0, self._size(k)) else raw[byte_at(raw, a):byte_at(raw, b)]

    def _cuts(self, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first, last + 1 code point in it) of a range."""
        if start >= stop:
            return
        k = int(np.searchsorted(self.ends, start, side="right"))
        while k < len(self.ends) and (before := self.ends[k - 1] if k else 0) < stop:
            yield k, max(start - before, 0), min(stop, self.ends[k]) - before
            k += 1


class Cuts:
    """Form and cut points of a document: from the first four 32-bit numbers of the
    sha256 of ``seed:id``."""

    def __init__(self, seed: int = 1, plain_from: int = 90, spm_below: int = 20):
        self.seed, self.plain_from, self.spm_below = seed, plain_from, spm_below

    def __call__(self, doc_id, n: int, marked: bool) -> tuple[str, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        h = np.frombuffer(digest[:16], ">u4").tolist()
        if n == 0 or marked or h[2] % 100 >= self.plain_from:
            return "plain", 0, 0
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        return ("spm" if h[3] % 100 < self.spm_below else "psm"), a, b


def rearranged(text: Frames, form: str, a: int, b: int) -> Frames:
    out = Frames()
    head, tail = [(PREFIX, 0, a)], [(SUFFIX, b, len(text))]
    if form == "plain":
        return text
    for mark, start, stop in (head + tail if form == "psm" else tail + head) + [(MIDDLE, a, b)]:
        out.add(mark)
        out.add_range(text, start, stop)
    return out


def restored(out: Frames, form: str) -> Iterator[bytes]:
    """The original text, in pieces, from the rearranged one and its form."""
    if form == "plain":
        yield from out.stream()
        return
    second = out.find(SUFFIX if form == "psm" else PREFIX, 3)
    middle = out.find(MIDDLE, second + 3)
    one, two = (3, second), (second + 3, middle)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    yield from out.stream(*prefix)
    yield from out.stream(middle + 3)
    yield from out.stream(*suffix)


def _runs(rows: Iterator[tuple[int, list, int]], batch: pa.RecordBatch, keep: list[str],
          fields: list[T.StructField]) -> Iterator[pa.RecordBatch]:
    """Output batches of kept columns and computed ones from (row, values, bytes)."""
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in fields]
    held, first, size = [], 0, 0

    def flush(last):
        cols = [C.column(batch, c).slice(first, last - first) for c in keep]
        made = [pa.array([v[i] for v in held], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(cols + made, names=keep + [f.name for f in fields])

    for i, values, weight in rows:
        held.append(values)
        size += weight
        if size >= RUN_BYTES:
            yield flush(i + 1)
            held, first, size = [], i + 1, 0
    if held:
        yield flush(batch.num_rows)


def _mapped(df: DataFrame, drop: list[str], fields: list[T.StructField], row) -> DataFrame:
    """``df`` without ``drop``, with ``fields`` computed by ``row(batch)`` (values, bytes)."""
    gone = {c.lower() for c in drop} | {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in gone]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _runs(((i, *x) for i, x in enumerate(row(batch))), batch, keep, fields)

    return df.mapInArrow(run, schema)


def frame_store(docs: DataFrame, text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Every column but the text, with ``n`` (code points), ``marked`` (a marker occurs),
    ``frames`` and ``ends``."""
    C.prepare(docs.sparkSession)

    def row(batch):
        for piece in C.slices([batch], text):
            for raw in C.texts(piece, text).cast(pa.large_binary()):
                raw = raw.as_py()
                store = Frames.of(raw, frame_bytes)
                yield [len(store), any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)), store.data, store.ends], sum(map(len, store.data)) + 64

    return _mapped(docs, [text], STORE, row)


def fill_in_middle(store: DataFrame, id_col: str = "doc_id", cuts: Cuts | None = None) -> DataFrame:
    """A store rearranged: ``form``, ``prefix_chars``, ``middle_chars``; ``frames`` and
    ``ends`` are those of the output, ``n`` still counts the text."""
    cuts = cuts or Cuts()
    fields = SHAPE + STORE[2:]

    def row(batch):
        cols = [C.column(batch, c) for c in (id_col, "n", "marked", "frames", "ends")]
        for k in range(batch.num_rows):
            doc_id, n, marked, data, ends = (c[k].as_py() for c in cols)
            form, a, b = cuts(doc_id, n, marked)
            out = rearranged(Frames(data, ends), form, a, b)
            lens = [None, None] if form == "plain" else [a, b - a]
            yield [form, *lens, out.data, out.ends], sum(map(len, out.data)) + 64

    return _mapped(store, [], fields, row)


def read_frames(store: DataFrame, text: str = "text", original: bool = False) -> DataFrame:
    """A store's texts in place of its frames; ``original``: as they were before
    ``fill_in_middle``."""
    def row(batch):
        forms = C.column(batch, "form").to_pylist() if original else ["plain"] * batch.num_rows
        for data, ends, form in zip(C.column(batch, "frames"), C.column(batch, "ends"), forms):
            raw = b"".join(restored(Frames(data.as_py(), ends.as_py()), form))
            yield [raw.decode()], len(raw) + 64

    return _mapped(store, ["frames", "ends"], [T.StructField(text, T.StringType())], row)


def digests(store: DataFrame) -> DataFrame:
    """Digests of a rearranged store in place of its frames: ``output_sha256`` of the
    output and ``restored_sha256`` of the text rebuilt from output and form."""
    def row(batch):
        for data, ends, form in zip(C.column(batch, "frames"), C.column(batch, "ends"), C.column(batch, "form").to_pylist()):
            out, both = Frames(data.as_py(), ends.as_py()), [hashlib.sha256(), hashlib.sha256()]
            for h, pieces in zip(both, (out.stream(), restored(out, form))):
                for raw in pieces:
                    h.update(raw)
            yield [h.hexdigest() for h in both], 200

    return _mapped(store, ["frames", "ends"],
                   [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())], row)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    store = C.written(frame_store(docs))
    return digests(fill_in_middle(store)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
