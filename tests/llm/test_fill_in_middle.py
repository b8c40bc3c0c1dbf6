"""Fill-in-middle over compressed frames (op12)."""

import hashlib

import duckdb
import pytest

from scorelens.llm import fill_in_middle as M

from conftest import SF_SMALL

COLS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
MIXED = "aé日本𝄞 <p>" * 37


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    parts = {"P": t[:a], "M": t[a:b], "S": t[b:]}
    form, order = ("spm", "SPM") if h[3] % 100 < 20 else ("psm", "PSM")
    return n, form, a, b - a, "".join(f"<{k}>{parts[k]}" for k in order)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({M.OP12_SQL})").fetchall()
    got = [tuple(r) for r in M.op12_fill_in_middle(spark, SF_SMALL).select(COLS).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1 << 16])
def test_frames_seek_and_find(size):
    raw = MIXED.encode()
    f = M.Frames.of(raw, size)
    assert len(f) == len(MIXED) and all(M.Frames.unpack(d).decode() for d in f.data)
    for a in range(0, len(MIXED) + 1, 13):
        for b in range(a, len(MIXED) + 1, 17):
            assert b"".join(f.stream(a, b)).decode() == MIXED[a:b]
            part = M.Frames()
            part.add_range(f, a, b)
            assert b"".join(part.stream()).decode() == MIXED[a:b] and len(part) == b - a
    for a in range(0, len(MIXED), 29):
        assert f.find(b"<p>", a) == MIXED.find("<p>", a)
    assert f.find(b"<M>") == -1


def test_whole_frames_are_taken_over():
    text = M.Frames.of(MIXED.encode(), 16)
    out = M.rearranged(text, "psm", 100, 200)
    assert sum(d in set(text.data) for d in out.data) >= len(text.data) - 2


@pytest.mark.parametrize("frame_bytes", [7, 1 << 16])
def test_hard_documents(hard, frame_bytes):
    rows = hard.collect()
    store = M.frame_store(hard, frame_bytes=frame_bytes)
    out = M.fill_in_middle(store)
    got = M.read_frames(out).collect()
    want = sorted((repr(r["doc_id"]), *map(repr, brute(r["doc_id"], r["text"]))) for r in rows)
    assert want == sorted((repr(g["doc_id"]), *[repr(g[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "text")]) for g in got)
    assert all((g["__rid"], g["spans"], g["score"]) == (9, "mine", 0.5) for g in got)
    back = M.read_frames(out, original=True).collect()
    assert sorted((repr(b["doc_id"]), b["text"]) for b in back) == sorted((repr(r["doc_id"]), r["text"] or "") for r in rows)
    for r in M.digests(out).collect():
        assert r["output_sha256"] in {hashlib.sha256(g["text"].encode()).hexdigest() for g in got if g["doc_id"] == r["doc_id"]}
        assert r["restored_sha256"] in {hashlib.sha256((x["text"] or "").encode()).hexdigest() for x in rows if x["doc_id"] == r["doc_id"]}


def test_markers_across_frames_stay_plain(spark):
    texts = ["x" * k + "<M>" + "y" * 9 for k in range(9)] + ["<P", "<S> ", "<P<S", "> <"]
    rows = M.fill_in_middle(M.frame_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frame_bytes=4)).collect()
    for r in rows:
        assert (r["form"] == "plain") == (brute(r["doc_id"], texts[r["doc_id"]])[1] == "plain")


def test_nothing(empty):
    assert M.digests(M.fill_in_middle(M.frame_store(empty))).count() == 0
