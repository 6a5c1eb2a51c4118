"""Language identification by error-correcting output codes.

Every language gets a codeword. One binary character-n-gram classifier per bit
learns which languages have that bit set; a text gets the language whose
codeword has the least weighted loss against the predicted bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Rows the classifiers are fitted on, at most; a bounded sample of the labelled rows.
SAMPLE_ROWS = 3000
BUCKETS = 1 << 15
CHUNK = 300_000


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    table: np.ndarray  # buckets x bits, log odds
    scale: np.ndarray  # bits
    bias: np.ndarray  # bits
    weight: np.ndarray  # bits, from the training accuracy


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes up to 6 languages, seeded random ones of good distance beyond."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        rows = [[1] * bits] + [[1 if j >> (n - 1 - i) & 1 else -1 for j in range(bits)] for i in range(1, n)]
        return np.array(rows, float)
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(7)
    tries = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(50)]
    tries = [x for x in tries if (abs(x.sum(0)) < n).all()] or tries
    return max(tries, key=lambda x: -(x @ x.T - 2 * bits * np.eye(n)).max())


def features(text: str) -> np.ndarray:
    """Hash buckets of the character trigrams of the whole text, letters in lower case."""
    b = np.frombuffer(_squeeze(text), np.uint8).astype(np.uint32)
    v = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return (v * np.uint32(2654435761)) >> np.uint32(17)


_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _squeeze(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" "


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Fit on (text, language) pairs; None without any."""
    rows = [(t, y) for t, y in rows if has_letter(t)]
    langs = sorted({y for _, y in rows})
    if not langs:
        return None
    codes, index = codewords(len(langs)), {y: i for i, y in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    grams = [features(t) for t, _ in rows]
    for g, (_, y) in zip(grams, rows):
        counts[index[y]] += np.bincount(g, minlength=BUCKETS)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    bits = codes.shape[1]
    table = np.zeros((BUCKETS, bits))
    for b in range(bits):
        side = [share[codes[:, b] == s].mean(0) if (codes[:, b] == s).any() else share.mean(0) for s in (1, -1)]
        table[:, b] = np.log(side[0] + 1e-6) - np.log(side[1] + 1e-6)
    m = np.array([table[g].mean(0) for g in grams])
    y = codes[[index[y] for _, y in rows]]
    scale, bias = np.ones(bits), np.zeros(bits)
    for b in range(bits):  # logistic calibration of each bit, by Newton steps
        w, x, t = np.zeros(2), np.column_stack([m[:, b], np.ones(len(m))]), (y[:, b] + 1) / 2
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            w += np.linalg.solve(h, x.T @ (t - p) - 1e-2 * w)
        scale[b], bias[b] = w
    hit = ((m * scale + bias) * y > 0).mean(0)
    return Model(langs, codes, table.astype(np.float32), scale, bias, np.maximum(hit - 0.5, 0.01) * 2)


def has_letter(text: str | None) -> bool:
    import regex

    return text is not None and regex.search(r"\p{L}", text) is not None


def predict(model: Model | None, texts: list[str | None], margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score in 0..1 and an ambiguity flag for every text."""
    n = len(texts)
    lang, score, vague = ["und"] * n, np.zeros(n), np.ones(n, bool)
    todo = [i for i in range(n) if model is not None and has_letter(texts[i])]
    at = 0
    while at < len(todo):
        some, size = [], 0
        while at < len(todo) and (not some or size + len(texts[todo[at]]) < CHUNK):
            size += len(texts[todo[at]])
            some.append(todo[at])
            at += 1
        grams = [features(texts[i]) for i in some]
        ends = np.cumsum([len(g) for g in grams])
        sums = np.add.reduceat(model.table[np.concatenate(grams)], np.r_[0, ends[:-1]], axis=0, dtype=np.float64)
        bits = sums / np.diff(np.r_[0, ends])[:, None] * model.scale + model.bias
        loss = (np.logaddexp(0, -bits[:, None, :] * model.codes[None]) * model.weight).sum(2)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        two = np.sort(p, axis=1)
        for j, i in enumerate(some):
            lang[i], score[i] = model.langs[best[j]], p[j, best[j]]
            vague[i] = len(model.langs) > 1 and two[j, -1] - two[j, -2] < margin
    return lang, score, vague


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on a bounded, hash-ordered sample of the labelled rows outside the held-out share."""
    labelled = docs.where((C.crc_bucket(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = C.sample(labelled.select("doc_id", "text", "lang"), sample_rows).select("text", "lang").collect()
    return fit([(r[0], r[1]) for r in rows])


def identify(docs: DataFrame, model: Model | None, margin: float = 0.2) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous`` to every row; one pass, no shuffle.

    Null texts and texts without a letter give ``und`` with score 0, and without a
    model (no labelled row) all texts do. Ties go to
    the first language in sort order and count as ambiguous. Other columns pass
    through; existing columns of the three names are replaced.
    """
    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = C.extended(kept, "lang_pred string, score double, ambiguous boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches):
        for pdf in C.slices(batches):
            lang, score, vague = predict(shared.value, [t if isinstance(t, str) else None for t in pdf["text"]], margin)
            yield pdf.assign(lang_pred=pd.Series(lang, pdf.index, dtype=object), score=score, ambiguous=vague)

    return kept.mapInPandas(run, schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (C.crc_bucket(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of no language: without text or without a letter; the rest stays as it is.

    Ambiguous documents stay, they are clean text of one language or another.
    Where there is nothing to learn a language from, no document is dropped for that.
    """
    columns, model = docs.columns, train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, model).where(F.col("lang_pred") != "und").select(*columns)
