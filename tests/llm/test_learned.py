"""Toxicity (op2), quality (op3) and personal data (op10)."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorelens.llm import personal_data as P
from scorelens.llm import quality, toxicity
from scorelens.llm import common as C

from conftest import SF_CHECK, SF_SMALL


# ---- toxicity

def brute_kneser_ney(counts, word, cls, order, shared):
    """ln P(word | cls) by dictionaries; counts: {word: (n0, n1)}."""
    def grams(w, k):
        b = [1] * (order - 1) + list(w.encode()) + [2]
        return [tuple(b[i - k + 1:i + 1]) for i in range(order - 1, len(b))]

    raw = [None] + [defaultdict(lambda: [0, 0]) for _ in range(order)]
    for w, n in counts.items():
        for k in range(1, order + 1):
            for g in grams(w, k):
                for c in (0, 1):
                    raw[k][g][c] += n[c]
    used = [None] * (order + 1)
    used[order] = {g: tuple(n) for g, n in raw[order].items()}
    for k in range(order - 1, 0, -1):
        left = {g: [0, 0, 0] for g in raw[k]}
        for g, n in raw[k + 1].items():
            for c in (0, 1):
                left[g[1:]][c] += n[c] > 0
            left[g[1:]][2] += n[0] + n[1] > 0
        used[k] = {}
        for g, n in left.items():
            own = (*raw[k][g], sum(raw[k][g])) if k > 1 and g[0] == 1 else tuple(n)
            used[k][g] = (own[2], own[2]) if k <= shared else own[:2]
    p_all = 0.0
    for i in range(len(grams(word, 1))):
        p = 1 / 256
        for k in range(1, order + 1):
            g = grams(word, k)[i]
            once = sum(n[cls] == 1 for n in used[k].values())
            twice = sum(n[cls] == 2 for n in used[k].values())
            d = once / (once + 2 * twice) if once else 0.5
            same = [n[cls] for h, n in used[k].items() if h[:-1] == g[:-1]]
            t = sum(same)
            if t:
                c = used[k].get(g, (0, 0))[cls]
                p = max(c - d, 0) / t + d * sum(n > 0 for n in same) / t * p
        p_all += math.log(p)
    return p_all


def test_kneser_ney_equals_dictionaries():
    counts = {"idiot": (0, 5), "idle": (3, 1), "the": (9, 8), "then": (2, 2), "é": (1, 0), "id": (1, 1), "moron": (0, 2)}
    words = pa.array(sorted(counts), pa.large_string())
    model = toxicity.KneserNey(words, np.array([counts[w] for w in sorted(counts)]), order=4, shared=1)
    ask = ["idiot", "idiots", "the", "x", "éé", "then"]
    got = model.log_ratio(pa.array(ask, pa.large_string()))
    for w, g in zip(ask, got):
        want = brute_kneser_ney(counts, w, 1, 4, 1) - brute_kneser_ney(counts, w, 0, 4, 1)
        assert g == pytest.approx(want, rel=1e-4, abs=1e-5), w


def test_toxicity_held_out(spark):
    random.seed(12)
    word = lambda: "".join(random.choice(["th", "er", "on", "an", "ti", "re", "st"]) for _ in range(random.randint(1, 4)))
    rows = []
    for i in range(1200):
        w = [word() for _ in range(random.randint(20, 200))]
        if i % 5 == 0:  # a few insults, inflected at random
            for _ in range(3 + len(w) // 40):
                w[random.randrange(len(w))] = random.choice(["idiot", "scum", "worthless"]) + random.choice(["", "s", "ly", ","])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score_toxicity(t.drop("toxic"), t.drop("text")).join(t.drop("text"), "doc_id").where(C.fold("doc_id", 5) == 0).toPandas()
    assert (out[out.toxic == 1].predicted == 1).mean() >= 0.9
    assert (out[out.toxic == 0].predicted == 1).mean() <= 0.03
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_hard_documents(spark, hard, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2 + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(hard, labels)
    assert out.columns == [c for c in hard.columns if c not in toxicity.OUT] + toxicity.OUT
    rows = out.collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["__rid"], r["__d"]) == (9, 3) for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r["text"]].add(round(r["score"], 12))
    assert all(len(s) == 1 for s in by.values())  # equal texts score alike
    assert by[None] == by[""]
    assert toxicity.score_toxicity(empty, labels).count() == 0
    one = toxicity.score_toxicity(hard, labels.where("toxic = 1")).agg(F.min("score"), F.max("score")).first()
    assert tuple(one) == (1.0, 1.0)
    none = toxicity.score_toxicity(hard, labels.limit(0)).agg(F.min("score"), F.max("predicted")).first()
    assert tuple(none) == (0.0, 0)


def test_toxicity_query(spark):
    rows = toxicity.op2_toxicity(spark, SF_SMALL).collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


# ---- quality

def graded(spark, n=1500):
    random.seed(6)
    rows = []
    for i in range(n):
        g = random.randint(0, 4)
        rows.append((i, " ".join(random.choice(["good", "fine", "clear"]) if random.random() < g / 5 else
                                 random.choice(["bad", "junk", "noise", "x%%", "the"]) for _ in range(40)), g))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_ordinal_regression_orders_five_grades(spark):
    t = graded(spark)
    out = quality.grade_quality(t.drop("quality"), t, want=3).join(t.select("doc_id", "quality"), "doc_id")
    held = out.where(C.fold("doc_id", 5) == 0).toPandas()
    assert np.corrcoef(held.expected_grade, held.quality)[0, 1] > 0.9
    assert (held.kept == (held.quality >= 3)).mean() > 0.85
    assert ((held.predicted_grade - held.quality).abs() <= 1).mean() > 0.95
    assert held.tail_probability.between(0, 1).all() and held.expected_grade.between(0, 4).all()


def test_quality_query_held_out(spark):
    out = quality.op3_quality(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.95
    assert out[out.quality == 0].kept.mean() < 0.6


def test_quality_hard_documents(spark, hard, empty):
    t = graded(spark, 200)
    out = quality.grade_quality(hard.withColumn("kept", F.lit("theirs")), t)
    assert out.columns == hard.columns + quality.OUT and out.count() == hard.count()
    assert all(r["__rid"] == 9 and 0 <= r["tail_probability"] <= 1 for r in out.collect())
    assert quality.grade_quality(empty, t).count() == 0
    none = quality.grade_quality(hard, t.limit(0)).first()
    assert none["expected_grade"] is None and none["kept"]
    one = quality.grade_quality(hard, t.where("quality = 2"), want=3).first()
    assert (one["expected_grade"], one["tail_probability"], one["kept"]) == (2.0, 0.0, False)
    with pytest.raises(ValueError):
        many = spark.range(1000).selectExpr("id as doc_id", "'some text' as text", "id as quality")
        quality.grade_quality(many.drop("quality"), many)


# ---- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or k == 2 and 12 <= len(d) <= 19 and P.luhn(d) or k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_equal_plain_regular_expressions():
    random.seed(3)
    for _ in range(20000):
        s = "".join(random.choice("a@.1 23+-()9é\n%4") for _ in range(random.randint(0, 30)))
        assert P.base_spans(s) == plain_spans(s), s


def test_patterns_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "@" * 300_000):
        P.base_spans(t)  # would take hours if starts were tried again and again


@pytest.fixture(scope="module")
def crf():
    return P.Crf([P.read_example(e) for e in P.EXAMPLES])


def test_crf_reads_its_examples_and_adds_missed_spans(crf):
    for words, labels in map(P.read_example, P.EXAMPLES):
        assert list(crf.decode([words])[0]) == labels
    text = "cards 4111111111111111 5500000000000004, from 97.51.17.173 4111111111111111 é +1 (826) 555-4081 190.137.223.204 x"
    (base, every), = P.find_spans([text], crf)
    assert set(base) <= set(every)
    got = [(P.KINDS[k], text[a:b]) for a, b, k in every]
    for want in (("card", "4111111111111111"), ("card", "5500000000000004"), ("phone", "+1 (826) 555-4081"), ("ip", "97.51.17.173")):
        assert want in got
    clean = ["only words here, and more", "version 3.2.1 of 2019, 1234567890123456 items", "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    assert [s for _, s in P.find_spans(clean, crf)] == [[], [], []]


def test_windows_decode_as_whole_texts(spark, crf):
    texts = [r[0] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("text").collect() if re.search("[0-9@]", r[0])][:150]
    whole = P.Crf.__new__(P.Crf)
    whole.__dict__.update(crf.__dict__)
    whole.reach = None
    assert crf.reach is not None and P.find_spans(texts, crf) == P.find_spans(texts, whole)


def test_viterbi_equals_all_paths(crf):
    import itertools
    words = ["card", "4111111111111111", "4929573638125985", "x"]
    feats = [P.word_features(w) for w in words]
    e = [sum(crf.weights[i] for i in crf.numbers(crf._all(feats, k))) for k in range(len(words))]
    best = max(itertools.product(range(9), repeat=4),
               key=lambda y: sum(e[i][y[i]] for i in range(4)) + sum(crf.pairs[y[i], y[i + 1]] for i in range(3)))
    assert tuple(crf.decode([words])[0]) == best


def test_personal_data_hard_documents(hard, empty):
    rows = P.personal_data(hard).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert r["base_spans"] == P.as_text(plain_spans(r["text"] or "")) and r["__rid"] == 9
    own = next(r for r in rows if r["doc_id"] == 15)
    assert (own["n_email"], own["n_ip"], own["n_card"], own["n_phone"]) == (1, 1, 0, 1)
    masked = P.personal_data(hard, replace=True)
    assert masked.columns == hard.columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[15] == "mail [EMAIL] or [PHONE] é [IP]" and texts[1] is None and texts[2] == ""
    assert P.personal_data(empty).count() == 0


def test_personal_data_query(spark):
    import hashlib
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = P.op10_personal_data(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(P.as_text(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert set(P.as_text(base).split(",")) - {""} <= set(r["spans"].split(","))


def _toxic_corpus(copies):
    """Clean texts (some in words of their own, far from both classes), rude ones, and labels."""
    rng = np.random.default_rng(copies)
    plain = [f"{a}{b}" for a in ("ver", "lan", "sto", "mi") for b in ("da", "ro", "net", "lis", "ton", "gar")]
    odd = [f"zz{k}qx" for k in range(40)]
    rude = ["wretch", "vermin", "dolt", "fiend"]
    texts, labels = [], []
    for k in range(900):
        words = list(rng.choice(odd if k % 7 == 0 else plain, rng.integers(4, 60)))
        bad = k % 4 == 1
        if bad:
            for _ in range(2):
                words.insert(rng.integers(len(words)), str(rng.choice(rude)))
        for _ in range(copies):
            texts.append(" ".join(words))
            labels.append(int(bad))
    return texts, labels


@pytest.mark.parametrize("copies,cap", [(1, 16_000), (1, 150), (5, 400), (5, 16_000)])
def test_toxicity_keeps_clean_texts_whatever_the_sample(spark, copies, cap):
    """Copies on both sides of the folds, or a class that the cap cuts, move no clean text."""
    texts, labels = _toxic_corpus(copies)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, known, max_docs=cap).collect()}
    clean = [got[i] for i, y in enumerate(labels) if not y]
    toxic = [got[i] for i, y in enumerate(labels) if y]
    assert np.mean(clean) < 0.02 and np.mean(toxic) > 0.9


def test_logistic_settles_where_classes_are_nearly_apart():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.05, 0.1, (3000, 3)), rng.normal(-30, 20, (300, 3)), rng.normal(0.9, 0.3, (900, 3))])
    y = np.repeat([0.0, 0.0, 1.0], [3000, 300, 900])
    x = np.arcsinh(4 * x)
    p = toxicity.predict_logistic(toxicity.fit_logistic(x, y), x)
    assert np.mean((p >= 0.5) == (y == 1)) > 0.99
    twice = toxicity.fit_logistic(np.concatenate([x, x[y == 1]]), np.append(y, y[y == 1]))
    heavy = toxicity.fit_logistic(x, y, times=np.where(y == 1, 2.0, 1.0))
    assert np.allclose(toxicity.predict_logistic(twice, x), toxicity.predict_logistic(heavy, x), atol=0.05)
