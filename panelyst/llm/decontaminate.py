"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to lower-case words and every window of
them becomes a pattern. Each document is normalised the same way and scanned
once; matches are carried back to its words and character offsets.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common as C

WINDOW = 13
#: Benchmark text for one automaton, in bytes; a larger benchmark is scanned for in blocks.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    if not isinstance(text, str):
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def build(items: list[tuple], window: int = WINDOW):
    """Automaton over the windows of all items; None without any word."""
    import ahocorasick

    owners = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[i : i + window])].update(() if item is None else (item,))
    if not owners:
        return None
    machine = ahocorasick.Automaton()
    for words, who in owners.items():
        machine.add_word(f" {' '.join(words)} ", (len(words), sorted(who, key=str)))
    machine.make_automaton()
    return machine


def scan(machine, words: list[str]) -> tuple[np.ndarray, set]:
    """Which words lie in an occurrence of a window, and the items whose windows occur."""
    hit, items = np.zeros(len(words), bool), set()
    if machine is None or not words:
        return hit, items
    ends = None
    for end, (n, who) in machine.iter(f" {' '.join(words)} "):
        if ends is None:  # position of the blank after each word
            ends = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(ends, end))
        hit[last - n + 1 : last + 1] = True
        items.update(who)
    return hit, items


def spans(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the original text that the hit words make up."""
    out: list[tuple[int, int]] = []
    where = [m.span() for m in _ANY_CASE.finditer(text)] if isinstance(text, str) and hit.any() else []
    for i in np.flatnonzero(hit):
        if out and i and hit[i - 1]:
            out[-1] = (out[-1][0], where[i][1])
        else:
            out.append(where[i])
    return out


def blocks(bench: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in hash parts of about ``block_bytes`` at most."""
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return [bench] if n == 1 else [bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def match(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document ``n_words``, ``n_hit``, ``items`` and ``spans`` besides its own columns.

    Null texts have no words and no hits; so have all documents under an empty
    benchmark. An item of fewer words than a window is one window; one without
    words has none. Equal items are each reported; the windows of an item without
    an id hit, but it is not among the items. Documents are never shuffled.
    """
    spark, names = docs.sparkSession, ["n_words", "n_hit", "items", "spans"]
    out = docs.drop(*names)
    bits, ids = C.free("_hit", out), C.free("_items", out)
    parts = blocks(bench.select("item_id", "text"), block_bytes)
    carried = C.extended(out, f"{bits} binary, {ids} array<string>")
    final = C.extended(out, "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>")
    for k, part in enumerate(parts):
        machine = spark.sparkContext.broadcast(build([(None if r[0] is None else str(r[0]), r[1]) for r in part.collect()], window))

        def run(batches, machine=machine, first=k == 0, last=k == len(parts) - 1):
            for pdf in C.slices(batches):
                hits, found, counts, where, total = [], [], [], [], []
                for i, text in enumerate(pdf["text"]):
                    words = words_of(text)
                    hit, items = scan(machine.value, words)
                    if not first:
                        hit |= np.unpackbits(np.frombuffer(pdf[bits].iat[i], np.uint8), count=len(words)).astype(bool)
                        items.update(pdf[ids].iat[i])
                    if last:
                        where.append([{"start": a, "stop": b} for a, b in spans(text, hit)])
                        counts.append(int(hit.sum()))
                        total.append(len(words))
                    else:
                        hits.append(np.packbits(hit).tobytes())
                    found.append(sorted(items))
                pdf = pdf.drop(columns=[c for c in (bits, ids) if c in pdf])
                if last:
                    yield pdf.assign(n_words=np.array(total, np.int64), n_hit=np.array(counts, np.int64), items=pd.Series(found, pdf.index, dtype=object), spans=pd.Series(where, pdf.index, dtype=object))
                else:
                    yield pdf.assign(**{bits: pd.Series(hits, pdf.index, dtype=object), ids: pd.Series(found, pdf.index, dtype=object)})

        out = out.mapInPandas(run, final if k == len(parts) - 1 else carried)
    return out


def contaminated():
    """The contract's rule on the columns of ``match``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return match(docs, C.read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    columns = docs.columns
    return match(docs, C.read(spark, sf_dir, "benchmark")).where(~contaminated()).select(*columns)
