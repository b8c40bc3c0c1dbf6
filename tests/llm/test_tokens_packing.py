"""Token ids, best-two-fit packing (op1) and Re-Pair token files (op9)."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scorelens.llm import packing, token_files
from scorelens.llm.tokens import TokenEncoder

from conftest import SF_SMALL


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cut_encoding_equals_plain_encoding(byte_bpe):
    enc, plain = TokenEncoder(byte_bpe), Tokenizer.from_file(byte_bpe)
    random.seed(1)
    texts = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "x  ", "it's  we'll 're", "\x1c a \x1d b", "a\r\n b\t c",
             "日本 語　 テ", "é è  ê,ü.", "x \x85 y", "foo\n\n <|endoftext|>bar <|endoftext|> x", "a <b> <|endoftext|"]
    texts += ["".join(random.choice("ab'sé, .\n<|1\t× ") for _ in range(40)) for _ in range(3000)]
    ids, off = enc.encode(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert ids[off[k]:off[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def brute_best_two_fit(lengths, capacity):
    """The algorithm one bin at a time on plain lists."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap, i = [], capacity, 0
        while i < len(left):
            if left[i] <= gap:
                gap -= left[i]
                own.append(left.pop(i))
            else:
                i += 1
        if gap and own:
            room = gap + own[-1]
            best = max(((left[a] + left[b], a, b) for a in range(len(left)) for b in range(a + 1, len(left))
                        if left[a] + left[b] <= room), default=(0, 0, 0))
            if best[0] > own[-1]:
                small = own.pop()
                own += [left[best[1]], left[best[2]]]
                left = sorted([x for k, x in enumerate(left) if k not in best[1:]] + [small], reverse=True)
        bins.append(sum(own))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing_equals_one_bin_at_a_time(seed):
    random.seed(seed)
    lengths = [random.choice([random.randint(1, 60), 20, 33]) for _ in range(120)]
    counts = np.bincount(lengths, minlength=61)
    plan = packing.best_two_fit(counts, 60)
    used = np.zeros(61, int)
    for times, own in plan:
        assert sum(n * k for n, k in own) <= 60
        for n, k in own:
            used[n] += times * k
    assert (used == counts).all()
    assert sum(t for t, _ in plan) == len(brute_best_two_fit(lengths, 60))


def check_packing(rows, docs, tok, capacity):
    by, seqs, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    want = defaultdict(int)
    for i, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        at, piece = 0, 0
        while at < len(ids):
            n = first if piece == 0 else capacity
            want[(i, piece, at, n, crc(ids[at:at + n]))] += 1
            at, piece = at + n, piece + 1
    got = defaultdict(int)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    assert got == want
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(seqs), total


def test_packing_of_hard_documents(hard, byte_bpe):
    rows = packing.pack_documents(hard, byte_bpe, capacity=64).collect()
    docs = [(r["doc_id"], r["text"]) for r in hard.collect()]
    n, total = check_packing(rows, docs, Tokenizer.from_file(byte_bpe), 64)
    assert n <= -(-total // 64) + 3
    for r in rows:
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]


def test_packing_query(spark, byte_bpe):
    rows = packing.op1_best_fit_packing(spark, SF_SMALL).collect()
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    n, total = check_packing(rows, docs, Tokenizer.from_file(byte_bpe), 1024)
    assert n <= 1.02 * total / 1024 + 2


def test_packing_of_nothing(empty, byte_bpe):
    assert packing.pack_documents(empty, byte_bpe).count() == 0


def test_re_pair_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    docs = [np.append(rng.choice([3, 4, 5, 5, 5, 9], rng.integers(0, 400)), 0) for _ in range(60)] + [np.array([0]), np.array([0])]
    ids = np.concatenate(docs).astype(np.int32)
    shard = token_files.Shard(token_files.pack_shard(ids, np.array([len(d) for d in docs]), 0, 10, min_count=4))
    assert len(shard.rules) > 3 and len(shard.symbols) < len(ids) / 2
    assert (shard.all_ids() == ids).all()
    for k, d in enumerate(docs):
        assert (shard.ids(k) == d).all()
        assert (shard.ids(k, 2, 9) == d[2:9]).all()
        assert (shard.ids(k, len(d) - 1) == d[-1:]).all()
    for k, (a, b) in enumerate(shard.rules):
        part = lambda s: 1 if s < 10 else shard.lengths[s - 10]
        assert shard.lengths[k] == part(a) + part(b)


@pytest.mark.parametrize("least,alphabet", [(2, 3), (4, 6), (24, 40)])
def test_re_pair_leaves_no_frequent_pair(least, alphabet):
    """Long copies become few symbols, runs of one id shrink, nothing frequent is left."""
    rng = np.random.default_rng(least)
    copy = np.append(rng.integers(1, alphabet, 700), 0)
    docs = [copy] * 40 + [np.append(np.full(k, 2), 0) for k in range(1, 80)]
    docs += [np.append(rng.integers(1, alphabet, k), 0) for k in rng.integers(0, 300, 40)]
    ids = np.concatenate([docs[i] for i in rng.permutation(len(docs))]).astype(np.int32)
    symbols, rules = token_files.re_pair(ids, 0, 50, least)
    assert (token_files.expand(symbols, rules, 50) == ids).all()
    inside = (symbols[:-1] != 0) & (symbols[1:] != 0)
    _, counts = np.unique(symbols[:-1][inside].astype(np.int64) << 32 | symbols[1:][inside], return_counts=True)
    assert not len(counts) or counts.max() < least
    assert len(np.unique(rules, axis=0)) == len(rules) and not (rules == 0).any()
    assert token_files.expansion_lengths(rules, 50).max() >= 64


@pytest.mark.parametrize("ids", [[], [0], [0, 0], [5], [5, 0, 5, 0], [7] * 9])
def test_re_pair_of_small_streams(ids):
    symbols, rules = token_files.re_pair(np.array(ids, np.int32), 0, 50, 2)
    assert token_files.expand(symbols, rules, 50).tolist() == ids


def check_files(rows, docs, tok):
    """docs in the order of the files; equal ids in any order of their texts."""
    at = 0
    for r, (i, text) in zip(sorted(rows, key=lambda r: r["start"]), docs, strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), crc(ids))
        at += len(ids)


def order(docs):
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))


def test_token_files_of_hard_documents(spark, hard, byte_bpe, tmp_path):
    token_files.write_token_files(hard, byte_bpe, str(tmp_path / "ids"), shard_ids=500)
    rows = token_files.read_token_files(spark, str(tmp_path / "ids")).collect()
    check_files(rows, order([(r["doc_id"], r["text"]) for r in hard.collect()]), Tokenizer.from_file(byte_bpe))
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in rows)


def test_token_files_query(spark, byte_bpe):
    rows = token_files.op9_token_files(spark, SF_SMALL).collect()
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_files(rows, order(docs), Tokenizer.from_file(byte_bpe))


def test_a_shard_ends_with_the_document_that_fills_it(spark, byte_bpe, tmp_path):
    """A batch of many texts is not one shard: Re-Pair works on about as many ids as it was asked to."""
    docs = spark.range(0, 300, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' and '), 20) AS text")
    token_files.write_token_files(docs, byte_bpe, str(tmp_path / "ids"), shard_ids=1000)
    longest = max(r["n_tokens"] for r in token_files.read_token_files(spark, str(tmp_path / "ids")).collect())
    sizes = [r["n_ids"] for r in spark.read.parquet(str(tmp_path / "ids")).collect()]
    assert len(sizes) > 5 and max(sizes) < 1000 + longest


def test_token_files_of_nothing(spark, empty, byte_bpe, tmp_path):
    token_files.write_token_files(empty, byte_bpe, str(tmp_path / "ids"))
    assert token_files.read_token_files(spark, str(tmp_path / "ids")).count() == 0


def test_long_parts_leave_nothing_behind(byte_bpe):
    """Texts without a cut are encoded anew: what a worker holds does not grow with them."""
    from tokenizers import Tokenizer
    from scorelens.llm.tokens import TokenEncoder
    enc, tok, used = TokenEncoder(byte_bpe), Tokenizer.from_file(byte_bpe), []
    for k in range(4):
        texts = ["".join(chr(0x4E00 + (7 * i * (k + 1)) % 5000) for i in range(20_000)), "plain words", "x" * (500 + k)]
        ids, off = enc.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        used.append(enc.used)
    assert used[-1] == used[0] < 100 and len(enc.flat) <= 1 << 18


def test_workers_hold_one_operators_tables():
    from scorelens.llm import common as C
    a = C.held("one", list)
    assert C.held("one", list) is a
    C.held("two", list)
    assert C.held("one", list) is not a
