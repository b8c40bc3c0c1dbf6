"""Personal data: patterns, and a linear-chain conditional random field.

Base spans are found by fixed patterns for e-mail addresses, IP addresses, card
numbers (Luhn) and phone numbers. A linear-chain CRF over word-shape features reads
the same text as words and adds spans that the patterns miss, as when a pattern runs
into a neighbouring number and its match fails as a whole. A span that it decodes is
added if it satisfies the checks of its kind and touches no other span of that kind.

The CRF is trained at each call from a small labelled table (``EXAMPLES``, or the
caller's), by gradient ascent on the conditional likelihood with forward-backward
over the padded batch. Texts are decoded by Viterbi in numpy batches. All words
without digit and "@" share one feature; the trained weights bound how far a word
can influence the decoding through such words (``Crf.reach``), so the decoder skips
longer runs of them: whole texts are covered, with the path that full decoding gives.

Defined cases: null counts as the empty text, which has no spans; any length; the
patterns take time in proportion to the text (no start is tried twice); repeated
rows are read each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C

KINDS = ("email", "ip", "card", "phone")

# A small labelled table: spans as {kind text}. Fixed values, made for training.
EXAMPLES = [
    "write to {email anna.smith@post.example.org} for details",
    "Contact: {email j.doe42@mail.example.com}, office hours nine to five",
    "{email info@shop.example.net} answers within two days",
    "mail {email k_lee+news@sub.example.co.uk}.",
    "her address is {email m-99@web7.example.com} and his {email b.78@mail3.example.com}",
    "und.{email 34@mail7.example.com} der text geht weiter",
    "senden Sie {email jörg.groß@post.example.de} eine Nachricht",
    "the host {ip 192.168.10.24} did not answer",
    "ping {ip 10.0.0.1}, then {ip 8.8.4.4}",
    "from {ip 97.51.17.173} to the gateway",
    "blocked: {ip 203.0.113.9}.",
    "la adresse {ip 172.16.254.3} est en panne",
    "server {ip 240.56.125.154} {ip 12.7.200.31} restarted",
    "{ip 129.38.82.176} esnd and so on",
    "card {card 4111111111111111} was charged",
    "paid with {card 5500 0000 0000 0004} on Monday",
    "number {card 3400-0000-0000-009} expires soon",
    "the {card 4929573638125985} {card 4485040371536584} cards were stolen",
    "{card 6011000990139424}",
    "please use {card 30569309025904} instead",
    "from {ip 97.51.17.173} {card 4111111111111111} was used",
    "tarjeta {card 4532015112830366} vence pronto",
    "call {phone +1 (017) 555-7713} before noon",
    "phone {phone +44 20 7946 0958} or write",
    "tel. {phone +49 30 901820}, fax on request",
    "{phone +33 1 70 18 99 00} est le numéro",
    "at {phone +1-202-555-0143}.",
    "ring {phone +1 (974) 555-3436} thatenon it of that",
    "{phone +34 912 345 678} y {email luz@correo.example.es}",
    "reach {phone +1 (826) 555-4081} {ip 190.137.223.204} des un",
    "version 3.2.1 was released in 2019",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.",
    "the token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 is secret",
    "token = \"7f5790b897549d620aedfc0705a565f96e3741e8\" stung",
    "in 1998 there were 25 towns with 1200 houses",
    "it costs $19.99 or 3 for 50",
    "open 9-17 on 24/12/2021 and 01.01.2022",
    "chapter 12.4 of 30, page 1-17",
    "see https://www.example.org/a/12?x=7 for more",
    "follow @someone or #42 there",
    "100% of 5,000,000 votes",
    "order 20231104 shipped in box 17",
    "isbn 978-3-16-148410-0 is a book",
    "the distance is 384400 km and 12 m",
    "a plain sentence with no number at all",
    "only words, commas and dots. Nothing else here.",
    "noch ein Satz ohne Zahlen und Zeichen",
    "une phrase simple sans chiffres",
    "una frase corta y nada más",
]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOTABLE = re.compile(r"[0-9@]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only, and never given back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """The check that a match of the kind must pass."""
    if kind == "email":
        left, _, right = s.partition("@")
        return bool(left) and "@" not in right and "." in right.strip(".")
    if kind == "ip":
        return bool(_PARTS.fullmatch(s)) and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    d = only_digits(s)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' valid matches, leftmost and without
    overlap per kind, by start and kind."""
    out = []
    at, since = text.find("@"), 0
    while at >= 0:
        head = text[since:at]
        local = len(head) - len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if local else None
        if m:
            out.append((at - local, m.end(), 0))
        since = m.end() if m else at + 1
        at = text.find("@", since)
    if _NOTABLE.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            if kind == 3 and "+" not in text:
                continue
            out += [(*m.span(), kind) for m in pattern.finditer(text) if valid(KINDS[kind], m.group())]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---- word-shape features ----

_PLAIN = ("plain",)
_SMALL, _LARGE, _DIGIT = re.compile("[^\\W\\d_]", re.U), re.compile("[A-Z]"), re.compile("[0-9]+")


def word_features(word: str) -> tuple[str, ...]:
    """Shape features of a word; words without digit and "@" have one in common."""
    if not _NOTABLE.search(word):
        return _PLAIN
    body = word.strip("\"'`,;:!?.*#%&$|<>[]{}")
    if not body or not _NOTABLE.search(body):
        body = word
    n = len(only_digits(body))
    size = str(n) if n < 4 else "4-8" if n < 9 else "9-11" if n < 12 else "12-19" if n < 20 else "20+"
    sign = _DIGIT.sub("0", _LARGE.sub("A", body))
    sign = re.sub(r"(.)\1+", r"\1", _SMALL.sub("a", sign))
    domain = body.rpartition("@")[2]
    return ("shape:" + sign[:12], "digits:" + size, "first:" + sign[:1], "last:" + sign[-1:],
            "dots:" + str(min(body.count("."), 4)), "at:" + str("@" in body[1:] and "." in domain),
            "plus:" + str(body[:1] == "+"), "only:" + str(n == len(body)), "letters:" + str("a" in sign or "A" in sign))


def neighbour(features: tuple[str, ...]) -> str:
    return "plain" if features is _PLAIN or features == _PLAIN else features[1] + features[6]


LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]


def read_example(example: str) -> tuple[list[str], list[int]]:
    """Words and label numbers of a marked sentence."""
    text, spans = "", []
    for part in re.split(r"(\{[a-z]+ [^}]*\})", example):
        if part[:1] == "{" and part[-1:] == "}":
            kind, _, own = part[1:-1].partition(" ")
            spans.append((len(text), len(text) + len(own), KINDS.index(kind)))
            text += own
        else:
            text += part
    words, labels = [], []
    inside = None
    for m in _WORD.finditer(text):
        hit = next((k for k, (a, b, _) in enumerate(spans) if m.start() < b and m.end() > a), None)
        words.append(m.group())
        labels.append(0 if hit is None else 1 + 2 * spans[hit][2] + (hit == inside))
        inside = hit
    return words, labels


class Crf:
    """Weights of word features, of the neighbours' classes, and of label pairs."""

    def __init__(self, examples: list[tuple[list[str], list[int]]], steps: int = 250, rate: float = 0.2, l2: float = 0.02):
        feats = [[self._all([word_features(w) for w in words], i) for i in range(len(words))] for words, _ in examples]
        names = sorted({f for s in feats for t in s for f in t})
        self.number = {f: k for k, f in enumerate(names)}
        self.weights = np.zeros((len(names) + 1, len(LABELS)))  # the last row: features not met
        self.pairs = np.zeros((len(LABELS), len(LABELS)))
        self._fit(feats, [y for _, y in examples], steps, rate, l2)
        self.seen: dict[str, tuple[str, ...]] = {}
        self.reach = self._reach()

    @staticmethod
    def _all(own: list[tuple[str, ...]], i: int) -> list[str]:
        before = neighbour(own[i - 1]) if i else "plain"
        after = neighbour(own[i + 1]) if i + 1 < len(own) else "plain"
        out = list(own[i]) + ["before:" + before, "after:" + after]
        return out if own[i] == _PLAIN else out + [own[i][0] + "<" + before]

    def numbers(self, names: list[str]) -> list[int]:
        return [self.number.get(f, len(self.number)) for f in names]

    def _fit(self, feats, labels, steps, rate, l2) -> None:
        n, length = len(feats), max(map(len, feats), default=0)
        size = np.array([len(f) for f in feats])
        width = max((len(t) for f in feats for t in f), default=0)
        ids = np.full((n, length, width), len(self.number))
        y = np.zeros((n, length), int)
        for k, (f, lab) in enumerate(zip(feats, labels)):
            for i, t in enumerate(f):
                own = self.numbers(t)
                ids[k, i, :len(own)] = own
            y[k, :len(lab)] = lab
        real = np.arange(length) < size[:, None]
        m = len(LABELS)
        observed, observed_pairs = np.zeros_like(self.weights), np.zeros_like(self.pairs)
        np.add.at(observed, (ids[real], y[real][:, None]), 1)
        follow = real[:, 1:]
        np.add.at(observed_pairs, (y[:, :-1][follow], y[:, 1:][follow]), 1)
        moments = [np.zeros_like(self.weights), np.zeros_like(self.pairs)]
        squares = [np.zeros_like(self.weights), np.zeros_like(self.pairs)]
        for step in range(1, steps + 1):
            e = self.weights[ids].sum(2)
            alpha, beta = np.zeros((n, length, m)), np.zeros((n, length, m))
            alpha[:, 0] = e[:, 0]
            for i in range(1, length):
                go = np.logaddexp.reduce(alpha[:, i - 1, :, None] + self.pairs[None], axis=1) + e[:, i]
                alpha[:, i] = np.where(real[:, i, None], go, alpha[:, i - 1])
            for i in range(length - 2, -1, -1):
                go = np.logaddexp.reduce(self.pairs[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
                beta[:, i] = np.where(real[:, i + 1, None], go, 0)
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            node = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
            edge = np.exp(alpha[:, :-1, :, None] + self.pairs + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
            expected = np.zeros_like(self.weights)
            np.add.at(expected, ids.reshape(-1, width), np.repeat(node.reshape(-1, 1, m), width, 1))
            grads = [observed - expected - l2 * self.weights,
                     observed_pairs - (edge * follow[..., None, None]).sum((0, 1)) - l2 * self.pairs]
            grads[0][-1] = 0
            for k, (w, g) in enumerate(zip((self.weights, self.pairs), grads)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                squares[k] = 0.99 * squares[k] + 0.01 * g * g
                w += rate * (moments[k] / (1 - 0.9 ** step)) / (np.sqrt(squares[k] / (1 - 0.99 ** step)) + 1e-6)
        self.weights[-1] = 0

    def _reach(self) -> int | None:
        """Number of plain words (after the two next to a notable one) through which no
        label other than O can pay: None if the weights give no such bound."""
        own = [self.weights[self.number.get(f, -1)] for f in ("plain", "before:plain", "after:plain")]
        e = sum(own)
        margin = e[0] - e[1:].max()  # lost on each plain word among plain words that is not O
        span = self.pairs.max() - self.pairs.min()
        gap = margin - 2 * max(0.0, self.pairs[1:, 1:].max() - self.pairs[0, 0])
        if gap <= 0:
            return None
        edge = sum(np.abs(self.weights[k] - self.weights[k, :1]).max() for f, k in self.number.items()
                   if f.startswith(("before:", "after:")) and not f.endswith("plain"))
        return 2 + int(np.ceil((2 * span + edge) / gap))

    def features(self, word: str) -> tuple[str, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[word] = word_features(word)
        return got

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """Best label numbers of sequences of words: Viterbi over all of them, step by step."""
        if not windows:
            return []
        size = np.array([len(w) for w in windows])
        order = np.argsort(-size, kind="stable")
        ids, width = [], []
        for k in order:
            own = [self.features(w) for w in windows[k]]
            for i in range(len(own)):
                t = self.numbers(self._all(own, i))
                ids += t
                width.append(len(t))
        at = np.cumsum(width) - width
        e = np.add.reduceat(self.weights[ids], at)
        first = np.cumsum(size[order]) - size[order]
        live = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")  # windows longer than t
        score, back = e[first], []
        for t in range(1, int(size.max())):
            n = live[t]
            go = score[:n, :, None] + self.pairs
            best = go.argmax(1)
            back.append(best)
            score = np.concatenate([np.take_along_axis(go, best[:, None], 1)[:, 0] + e[first[:n] + t], score[n:]])
        out: list = [None] * len(windows)
        label = score.argmax(1)
        path = np.zeros((len(windows), int(size.max())), int)
        for t in range(int(size.max()) - 1, -1, -1):
            n = live[t]
            path[:n, t] = label[:n]
            if t:
                label = np.concatenate([np.take_along_axis(back[t - 1], label[:n, None], 1)[:, 0], label[n:]])
        for rank, k in enumerate(order):
            out[k] = path[rank, :size[k]]
        return out


def _trim(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """Cut signs that do not belong to a span of the kind off its ends."""
    good = (lambda c: c.isalnum()) if kind == 0 else (lambda c: "0" <= c <= "9")
    while b > a and not good(text[b - 1]):
        b -= 1
    while a < b and not (good(text[a]) or kind == 3 and text[a] == "+"):
        a += 1
    return a, b


def windows_of(text: str, reach: int | None) -> list[list[re.Match]]:
    """Runs of words around the notable ones that decoding must look at."""
    words = list(_WORD.finditer(text))
    if reach is None:
        return [words]
    out, last = [], -1
    for i in (i for i, w in enumerate(words) if _NOTABLE.search(w.group())):
        a, b = max(0, i - reach), min(len(words), i + reach + 1)
        if a <= last:
            out[-1] += words[last:b]
        else:
            out.append(words[a:b])
        last = b
    return out


def find_spans(texts: list[str], crf: Crf) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text."""
    base = [base_spans(t) for t in texts]
    owner, windows = [], []
    for k, t in enumerate(texts):
        if _NOTABLE.search(t):
            for w in windows_of(t, crf.reach):
                owner.append(k)
                windows.append(w)
    every = [list(b) for b in base]
    for k, words, labels in zip(owner, windows, crf.decode([[m.group() for m in w] for w in windows])):
        i = 0
        while i < len(words):
            if labels[i] == 0:
                i += 1
                continue
            kind, j = (labels[i] - 1) // 2, i + 1
            while j < len(words) and labels[j] == 2 * kind + 2:
                j += 1
            a, b = _trim(kind, texts[k], words[i].start(), words[j - 1].end())
            if a < b and valid(KINDS[kind], texts[k][a:b]) and not any(s[2] == kind and a < s[1] and b > s[0] for s in every[k]):
                every[k].append((a, b, int(kind)))
            i = j
    return [(b, sorted(e, key=lambda s: (s[0], s[2]))) for b, e in zip(base, every)]


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones as one) replaced by its kind."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, text: str = "text", examples: list[str] | None = None,
                  replace: bool = False) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans of each kind),
    base_spans and spans (all). ``replace``: ``docs`` with the spans of ``text``
    replaced by their kinds instead (nulls stay)."""
    spark = docs.sparkSession
    C.prepare(spark)
    names = [f"n_{k}" for k in KINDS] + ["base_spans", "spans"]
    docs = docs if replace else C.drop_clashing(docs, names)
    crf = Crf([read_example(e) for e in (examples or EXAMPLES)])  # a small table: bounded
    more = [] if replace else [T.StructField(n, T.LongType()) for n in names[:4]] + [T.StructField(n, T.StringType()) for n in names[4:]]
    schema = T.StructType(list(docs.schema) + more)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, text, limit=4 << 20):
            own = batch.column(where).to_pylist()
            found = find_spans([t or "" for t in own], crf)
            cols = list(batch.columns)
            if replace:
                cols[where] = pa.array([t if t is None else masked(t, s) for t, (_, s) in zip(own, found)], batch.column(where).type)
            else:
                cols += [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in range(4)]
                cols += [pa.array([as_text(b) for b, _ in found], pa.string()), pa.array([as_text(s) for _, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
                                      "spans")
