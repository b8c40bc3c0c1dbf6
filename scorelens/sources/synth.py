"""Survey look-alike generators (S-12, S-13), driven by a key table.

One synthetic response per key row (e.g. per order), so the output grows with
the input. Random draws come from a counter-based hash of (seed, stream, key)
(splitmix64, vectorised in numpy inside ``mapInPandas``): the same key always
gets the same values whatever the partitioning, so a task recomputed after an
executor loss reproduces its rows exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOMAINS = ["t1", "t2", "d", "c", "q1", "q2"]
KINDS = ["csi", "cci"]
PARTS = ["res", "core", "comm"]
KIND_RANGE = {"csi": (0.0, 10.0), "cci": (-5.0, 5.0)}
SCORE_COLS = [f"{d}_{k}_{p}" for d in DOMAINS for k in KINDS for p in PARTS + ["total"]]

_M64 = (1 << 64) - 1


def _splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform_np(keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """U(0, 1) from 53 bits of splitmix64(splitmix64(seed, stream) ^ key)."""
    salt = _splitmix64(np.array([((seed & 0xFFFFFFFF) << 32) | (stream & 0xFFFFFFFF)], dtype=np.uint64))[0]
    h = _splitmix64(keys.astype(np.int64).view(np.uint64) ^ salt)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(2 ** 53)


def normal_np(keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """N(0, 1) by Box-Muller from two hash uniforms."""
    u1 = uniform_np(keys, seed, 2 * stream)
    u2 = uniform_np(keys, seed, 2 * stream + 1)
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2 * np.pi * u2)


def _clip_round(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return np.round(np.clip(v, lo, hi), 2)


def synth_survey_balanced(keys: DataFrame, key: str, n_classes: int = 5, seed: int = 42,
                          class_col: str | None = None, sigma: float = 1.0, shift: float = 0.3,
                          total_mode: str = "mean") -> DataFrame:
    """S-12: class-conditional scores: class mean moves linearly with the class
    (class 1 best), each domain gets a +/- ``shift`` offset, values clipped to
    the kind's range and rounded to 2 decimals. ``class_col`` takes the class
    from the key table; otherwise it is drawn uniformly."""
    src = keys.select(F.col(key).cast("long").alias("id"),
                      (F.col(class_col).cast("int") if class_col else F.lit(None).cast("int")).alias("c"))

    def fn(it):
        for pdf in it:
            ids = pdf["id"].to_numpy(dtype=np.int64)
            if class_col:
                rpi = pdf["c"].to_numpy(dtype=np.int64)
            else:
                rpi = (np.floor(uniform_np(ids, seed, 0) * n_classes) + 1).astype(np.int64)
            out = {"id": ids, "rpi": rpi.astype(np.int32)}
            stream = 10
            for di, dom in enumerate(DOMAINS):
                off = shift if di % 2 == 0 else -shift
                for kind in KINDS:
                    lo, hi = KIND_RANGE[kind]
                    mid, span = (lo + hi) / 2, (hi - lo) / 2
                    center = mid + span * 0.6 * ((n_classes + 1) / 2.0 - rpi) / ((n_classes - 1) / 2.0) + off
                    parts = []
                    for part in PARTS:
                        v = _clip_round(center + sigma * normal_np(ids, seed, stream), lo, hi)
                        stream += 1
                        out[f"{dom}_{kind}_{part}"] = v
                        parts.append(v)
                    if total_mode == "mean":
                        out[f"{dom}_{kind}_total"] = np.round((parts[0] + parts[1] + parts[2]) / 3.0, 2)
                    else:
                        out[f"{dom}_{kind}_total"] = _clip_round(center + sigma * normal_np(ids, seed, stream), lo, hi)
                        stream += 1
            yield pd.DataFrame(out)[["id", "rpi", *SCORE_COLS]]

    schema = "id long, rpi int, " + ", ".join(f"{c} double" for c in SCORE_COLS)
    return src.mapInPandas(fn, schema)


def synth_survey_latent(keys: DataFrame, key: str, class_probs: list[float], seed: int = 7,
                        boost: float = 0.8, jitter: float = 0.4) -> DataFrame:
    """S-13: class drawn by probability (cumulative thresholds on a hash
    uniform); each domain has a latent level = class signal + noise, boosted
    for the first domain; parts = latent + jitter; total = mean of parts; plus
    skewed segment draws (year / area / client)."""
    cum = np.cumsum(np.asarray(class_probs, dtype=float))
    n = len(class_probs)
    src = keys.select(F.col(key).cast("long").alias("id"))

    def fn(it):
        for pdf in it:
            ids = pdf["id"].to_numpy(dtype=np.int64)
            u = uniform_np(ids, seed, 0)
            rpi = np.minimum(np.searchsorted(cum, u, side="right") + 1, n)
            signal = ((n + 1) / 2.0 - rpi) / ((n - 1) / 2.0)
            out = {"id": ids}
            u900 = uniform_np(ids, seed, 900)
            out["year"] = np.where(u900 < 0.5, 2025, np.where(u900 < 0.8, 2024, 2023)).astype(np.int32)
            out["area"] = np.asarray(DOMAINS, dtype=object)[
                np.minimum((uniform_np(ids, seed, 901) ** 2.0 * len(DOMAINS)).astype(int), len(DOMAINS) - 1)]
            out["client"] = np.asarray(list("abcde"), dtype=object)[
                np.minimum((uniform_np(ids, seed, 902) ** 1.5 * 5).astype(int), 4)]
            out["rpi"] = rpi.astype(np.int32)
            stream = 100
            for di, dom in enumerate(DOMAINS):
                lat = signal * (1.0 + (boost if di == 0 else 0.0)) + 0.5 * normal_np(ids, seed, stream)
                stream += 1
                for kind in KINDS:
                    lo, hi = KIND_RANGE[kind]
                    mid, span = (lo + hi) / 2, (hi - lo) / 2
                    parts = []
                    for part in PARTS:
                        v = _clip_round(mid + span * 0.5 * (lat + jitter * normal_np(ids, seed, stream)), lo, hi)
                        stream += 1
                        out[f"{dom}_{kind}_{part}"] = v
                        parts.append(v)
                    out[f"{dom}_{kind}_total"] = np.round((parts[0] + parts[1] + parts[2]) / 3.0, 2)
            yield pd.DataFrame(out)[["id", "year", "area", "client", "rpi", *SCORE_COLS]]

    schema = ("id long, year int, area string, client string, rpi int, "
              + ", ".join(f"{c} double" for c in SCORE_COLS))
    return src.mapInPandas(fn, schema)
