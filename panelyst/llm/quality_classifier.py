"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention
weights, learned from document labels alone, say how much each passage counts;
the weighted passage representation is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 2000
PASSAGE_WORDS = 60
CHUNK = 1_000_000
_HIDDEN, _GATE = 24, 12
_KINDS = 12


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 11, np.uint8)  # other marks
    for k, chars in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"|", b"#*$%&<>@^~=+\\/_{}[]`"]):
        kind[list(chars)] = k
    kind[128:] = 10
    return kind


_BYTES = _byte_kinds()
N_FEATURES = _KINDS + _KINDS * _KINDS + 4


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of whole texts, and each text's number of passages (one at least)."""
    raw = [(t if isinstance(t, str) else "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = _BYTES[b]
    blank = (kind == 3) | (kind == 4)
    start = ~blank & np.r_[True, blank[:-1]]
    ends = np.cumsum(sizes)
    word_no = np.cumsum(start)
    before = np.r_[0, word_no[ends - 1]]  # words ahead of each text
    n_words = np.diff(before)
    counts = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(raw)), sizes)
    place = np.maximum(word_no - 1 - before[doc], 0) // PASSAGE_WORDS
    owner = base[doc] + np.minimum(place, counts[doc] - 1)
    n = int(counts.sum())
    uni = np.bincount(owner * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    pair = (owner[1:] * (_KINDS * _KINDS) + kind[:-1].astype(np.int64) * _KINDS + kind[1:])[owner[1:] == owner[:-1]]
    two = np.bincount(pair, minlength=n * _KINDS * _KINDS).reshape(n, -1)
    size = np.maximum(uni.sum(1), 1)[:, None]
    at = np.flatnonzero(start)
    if len(at):
        which, whose = owner[at], doc[at]
        inside = np.arange(len(b)) - np.repeat(np.r_[0, at], np.diff(np.r_[0, at, len(b)]))
        spell = np.where(blank, np.uint64(0), C.mix((b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + inside.astype(np.uint64)))
        word = np.add.reduceat(spell, at)
        own = np.bincount(which, minlength=n)
        distinct = np.bincount(which[np.unique(C.mix(word + which.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)[1]], minlength=n)
        three = C.mix(word + np.r_[word[1:], word[:1]] * np.uint64(5) + np.r_[word[2:], word[:2]] * np.uint64(11) + whose.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        _, back, times = np.unique(three, return_inverse=True, return_counts=True)
        repeated = np.bincount(which, weights=times[back] > 1, minlength=n)
    else:
        own = distinct = repeated = np.zeros(n)
    safe = np.maximum(own, 1)
    extra = np.column_stack([distinct / safe, repeated / safe, np.log1p(own) / 5, size[:, 0] / safe / 10])
    return np.hstack([uni / size, two / size, extra]).astype(np.float32), counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]


def _forward(p: dict, x: np.ndarray, counts: np.ndarray) -> tuple:
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    a = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))


def fit(texts: list[str | None], y: np.ndarray, steps: int = 400, seed: int = 5) -> Model:
    """Full-batch Adam on the logistic loss of the documents' labels."""
    x, counts = (np.concatenate(p) for p in zip(*[passages(texts[a:b]) for a, b in chunks(texts)]))
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.02)
    x, rng = (x - mean) * scale, np.random.default_rng(seed)
    p = {"W": rng.normal(0, 0.08, (x.shape[1], _HIDDEN)), "b": np.zeros(_HIDDEN), "V": rng.normal(0, 0.3, (_HIDDEN, _GATE)), "U": rng.normal(0, 0.3, (_HIDDEN, _GATE)), "w": rng.normal(0, 0.3, _GATE), "o": rng.normal(0, 0.3, _HIDDEN), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    starts, n = np.cumsum(counts) - counts, len(y)
    for i in range(1, steps + 1):
        h, t, s, a, z, out = _forward(p, x, counts)
        dl = ((out - y) / n).astype(np.float32)
        dz = np.repeat(dl[:, None] * p["o"], counts, axis=0)
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "o": z.T @ dl, "c": dl.sum(keepdims=True)}
        for k in p:
            d = g[k] + 1e-4 * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return Model(mean, scale, p)


def chunks(texts: list[str | None]):
    """Slices of the texts of about CHUNK characters, whole texts each."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") < CHUNK):
            size += len(texts[stop] or "")
            stop += 1
        yield at, stop
        at = stop


def score(model: Model | None, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    for a, b in chunks(texts) if model is not None else ():
        x, counts = passages(texts[a:b])
        out[a:b] = _forward(model.p, (x - model.mean) * model.scale, counts)[-1]
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on a bounded sample of the labelled documents outside the held-out share; None without any."""
    known = labels.where((C.crc_bucket(5) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    wanted = {r[0]: r[1] for r in C.sample(known, sample_rows).collect()}
    if not wanted:
        return None
    rows = docs.where(F.col("doc_id").isin(list(wanted))).select("doc_id", "text").collect()
    rows = sorted((r[0], r[1] or "") for r in rows)
    return fit([t for _, t in rows], np.array([wanted[d] for d, _ in rows], np.float32)) if rows else None


def classify(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) and ``predicted`` to every row; one pass, no shuffle.

    Null and empty texts are one passage without words. Without a model the
    score is 0.5. Other columns pass through; existing ones of the names are
    replaced. Every passage of a text counts, however long the text is.
    """
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for pdf in C.slices(batches):
            s = score(shared.value, [t if isinstance(t, str) else None for t in pdf["text"]]).astype(float)
            yield pdf.assign(score=s, predicted=(s >= threshold).astype(np.int32))

    return kept.mapInPandas(run, C.extended(kept, "score double, predicted int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, C.read(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", (C.crc_bucket(5) == 0).alias("held_out"), "score", "predicted")
