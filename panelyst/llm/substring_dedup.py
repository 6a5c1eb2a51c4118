"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every window of 13 words holds a content-defined anchor: the least hash among
its 5-word runs. Windows that share an anchor occurrence form a segment, and
the anchor names the reference block in which all equal windows of the corpus
meet. Anchors of one document only are dropped early. Within a block the
distinct segments are parsed greedily, in document order, against the index of
the segments before them; a factor ends where the reference stops agreeing, and
the window at that boundary is looked up anew. Factors are at least one window
long and become the duplicate spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common as C

WINDOW = 13
ANCHOR = 5


def segments(text: str | None, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each segment, and the word hashes."""
    h = C.word_hashes(text)
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, none, none, h
    least = C.least_in(C.windows(h, anchor, seed=2), window - anchor + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first].view(np.int64), first, np.diff(np.r_[first, len(least)]), h


def _docs(docs: DataFrame) -> DataFrame:
    """Rows by id and a small text hash, which keeps repeated ids with other texts apart."""
    return docs.select("doc_id", "text", (F.xxhash64("text") % 32768).cast("smallint").alias("_t"))


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches):
        for pdf in C.slices(batches):
            out = [[], [], [], []]
            for d, t, text in zip(pdf["doc_id"], pdf["_t"], pdf["text"]):
                a, first, _, _ = segments(text, window, anchor)
                for col, x in zip(out, (a, first, np.full(len(a), d), np.full(len(a), t, np.int16))):
                    col.append(x)
            yield pd.DataFrame({c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in zip(("anchor", "first", "doc_id", "_t"), out)})

    return docs.where("text is not null and doc_id is not null").mapInPandas(run, "anchor long, first int, doc_id long, _t smallint")


def contents(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """The windows' hashes of the marked segments of each document, packed as 64-bit values."""

    def run(batches):
        for pdf in C.slices(batches):
            rows = []
            for d, t, text, firsts in zip(pdf["doc_id"], pdf["_t"], pdf["text"], pdf["firsts"]):
                a, first, count, h = segments(text, window, anchor)
                w = C.windows(h, window, seed=3).astype("<u8")
                for k in np.flatnonzero(np.isin(first, firsts)):
                    rows.append((int(a[k]), w[first[k] : first[k] + count[k]].tobytes(), d, t, int(first[k])))
            yield pd.DataFrame(rows, columns=["anchor", "content", "doc_id", "_t", "first"])

    return marked.mapInPandas(run, "anchor long, content binary, doc_id long, _t smallint, first int")


def parse(contents_by_block: DataFrame) -> DataFrame:
    """Greedy parse of each distinct segment against its block; rows must come by anchor and first document."""

    def run(batches):
        block, doc, index, pending = None, None, {}, []
        for pdf in C.slices(batches):
            masks = []
            for a, content, lo in zip(pdf["anchor"], pdf["content"], pdf["lo"]):
                if a != block:
                    block, doc, index, pending = a, None, {}, []
                if lo != doc:  # a document is no reference for itself
                    for ref in pending:
                        for o, x in enumerate(ref):
                            index.setdefault(x, (ref, o))
                    doc, pending = lo, []
                w = np.frombuffer(content, "<u8").tolist()
                mask, i = bytearray(len(w)), 0
                while i < len(w):
                    if (found := index.get(w[i])) is None:
                        i += 1
                        continue
                    ref, o = found
                    while i < len(w) and o < len(ref) and ref[o] == w[i]:
                        mask[i] = 1
                        i, o = i + 1, o + 1
                pending.append(w)
                masks.append(bytes(mask))
            yield pdf.assign(mask=masks)

    return contents_by_block.mapInPandas(run, "anchor long, content binary, lo long, mask binary")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every row with its ``kept_text`` (words joined by blanks), ``n_words``, ``n_removed`` and removed word ``spans``.

    A word goes if a window over it also starts in a document of smaller id.
    Null texts have no words. Rows without an id are neither searched nor
    reference. Rows of one id are no reference for each other. Other columns are
    not returned. Exact copies of a segment are aggregated before the shuffle,
    and copies never meet in one task.
    """
    spark, keys = docs.sparkSession, ["doc_id", "_t"]
    tables, base = C.Tables(spark, "substring"), _docs(docs)
    found = anchors(base, window, anchor)
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    marks = tables.cut(found.join(shared, "anchor").groupBy(keys).agg(F.collect_set("first").alias("firsts")), "marks")
    C.release(spark)
    parts = tables.cut(contents(base.join(marks.hint("merge"), keys), window, anchor), "segments")
    C.release(spark)
    distinct = parts.groupBy("anchor", "content").agg(F.min("doc_id").alias("lo"))
    # from here on a content goes by 128 bits of hashes, which are shorter
    names = ["anchor", F.xxhash64("content").alias("c1"), F.xxhash64(F.lit(5), "content").alias("c2")]
    parsed = tables.cut(parse(distinct.repartition("anchor").sortWithinPartitions("anchor", "lo", "content")).select(*names, "lo", "mask"), "parsed")
    C.release(spark)
    # later documents have all of a segment from the first one; the first has what the parse found
    mask = F.when(F.col("doc_id") > F.col("lo"), F.lit(None).cast("binary")).otherwise(F.col("mask"))
    spans = (
        parts.select(*names, *keys, "first", (F.length("content") / 8).cast("int").alias("n"))
        .join(parsed, ["anchor", "c1", "c2"]).select(*keys, "first", "n", mask.alias("mask"))
        .where("mask is null or position('01', hex(mask)) > 0")
        .groupBy(keys).agg(F.collect_list(F.struct("first", "n", "mask")).alias("found"))
    )
    spans = tables.cut(spans, "spans")
    tables.keep_only(spans)
    C.release(spark)

    def run(batches):
        for pdf in C.slices(batches):
            out = []
            for d, text, marked in zip(pdf["doc_id"], pdf["text"], pdf["found"]):
                words = C.words(text)
                if marked is None:
                    out.append((d, b" ".join(words).decode("utf-8", "surrogatepass"), len(words), 0, []))
                    continue
                starts = [m["first"] + (np.arange(m["n"]) if m["mask"] is None else np.flatnonzero(np.frombuffer(m["mask"], np.uint8))) for m in marked]
                at = np.concatenate(starts)
                gone = np.bincount(at[at < len(words)], minlength=len(words) + 1)
                gone = np.cumsum(gone - np.r_[np.zeros(window, np.int64), gone[:-window]])[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                kept = b" ".join([w for w, x in zip(words, gone.tolist()) if not x])
                out.append((d, kept.decode("utf-8", "surrogatepass"), len(words), int(gone.sum()), [{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)]))
            yield pd.DataFrame(out, columns=["doc_id", "kept_text", "n_words", "n_removed", "spans"])

    schema = C.extended(docs.select("doc_id"), "kept_text string, n_words long, n_removed long, spans array<struct<start:int,stop:int>>")
    return base.join(spans.hint("merge"), keys, "left").select("doc_id", "text", "found").mapInPandas(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
