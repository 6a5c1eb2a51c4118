"""Near-duplicate documents by DartMinHash.

Darts are thrown, by hashing, at the region of every element (a word shingle),
as wide as its weight. Each dart has a time and falls on one coordinate of the
signature; per coordinate the earliest dart that hits the document's regions
stays. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Bands of coordinates give candidates, the exact
similarity of the shingle sets decides, union-find forms the classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .components import EPS, components, owed, rare

WORDS = 5
SIMILARITY = 0.8
#: Classes of shingles that are counted to order them from rare to common; so many numbers, of four bytes, are sent to the tasks.
SLOTS = 1 << 20
BANDS, ROWS = 24, 4
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 16)]))
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles in order, and how often each occurs; a text of fewer words is one shingle."""
    h = C.word_hashes(text)
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(C.windows(h, min(k, len(h)), seed=4), return_counts=True)


def darts(x: np.ndarray, w: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and ids of the darts that hit elements ``x`` of weights ``w`` before ``until``.

    Weight and time are cut into unit squares, each of which gets a
    Poisson-distributed number of darts that only the element, the square and
    the dart's number decide.
    """
    wide, long = np.ceil(w).astype(np.int64), int(np.ceil(until))
    each = wide * long
    at = np.repeat(np.arange(len(x)), each)
    square = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    column, row = square // long, square % long
    h = C.mix(x[at] + column.astype(np.uint64) * _SALTS[0] + row.astype(np.uint64) * _SALTS[1])
    count = np.searchsorted(_POISSON, (h >> np.uint64(11)) / 2.0**53, side="right")
    again = np.repeat(np.arange(len(h)), count)
    number = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
    d = C.mix(h[again] ^ (number.astype(np.uint64) + np.uint64(1)) * _SALTS[2])
    time = row[again] + (d >> np.uint64(32)) / 2.0**32
    height = column[again] + (d & np.uint64(0xFFFFFFFF)) / 2.0**32
    hit = (time < until) & (height < w[at[again]])
    return time[hit], d[hit]


def signature(x: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The id of the earliest dart on each of k coordinates."""
    until = k * (np.log(k) + 3) / w.sum()
    while True:
        time, d = darts(x, w, until)
        on = (C.mix(d ^ _SALTS[3]) % np.uint64(k)).astype(np.int64)
        order = np.argsort(time, kind="stable")[::-1]
        out, seen = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[on[order]] = d[order]  # the earliest is written last
        seen[on] = True
        if seen.all():
            return out
        until *= 2


def sketches(docs: DataFrame, bands: int, rows: int, weighted: bool) -> DataFrame:
    """``doc_id``, content digest, band keys and the signature (16 bits a coordinate) of every document."""
    named = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))

    def run(batches):
        number = C.mix(np.arange(bands, dtype=np.uint64))
        factor = C.mix(np.arange(rows, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
        for pdf in C.slices(batches):
            keys, sig = [], []
            for text in pdf["text"]:
                x, n = shingles(text)
                if not len(x):
                    keys.append([])
                    sig.append(b"")
                    continue
                s = signature(x, n.astype(float) if weighted else np.ones(len(x)), bands * rows)
                keys.append(C.mix((s.reshape(bands, rows) * factor).sum(1) + number).view(np.int64))
                sig.append((s >> np.uint64(48)).astype("<u2").tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "keys": pd.Series(keys, pdf.index, dtype=object), "sig": pd.Series(sig, pdf.index, dtype=object)})

    return named.mapInPandas(run, C.extended(docs.select("doc_id"), "digest string, keys array<long>, sig binary"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Each text's shingle set, hashed to 32 bits, ascending."""

    def run(batches):
        for pdf in C.slices(batches):
            yield pd.DataFrame({"rep": pdf["rep"], "s": [np.unique(shingles(t)[0] >> np.uint64(32)).astype("<u4").tobytes() for t in pdf["text"]]})

    return docs.mapInPandas(run, "rep long, s binary")


def plausible(pairs: DataFrame, bands: int, rows: int, similarity: float) -> DataFrame:
    """Pairs whose signatures do not rule the similarity out (five standard errors)."""
    k = bands * rows
    least = max(1.0, k * (similarity - 5 * np.sqrt(similarity * (1 - similarity) / k)))

    def run(batches):
        for pdf in C.slices(batches):
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(-1, k) for c in ("sig_a", "sig_b"))
                yield pdf.loc[(a == b).sum(1) >= least, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs of which the shingle sets have the similarity."""

    def run(batches):
        for pdf in C.slices(batches):
            keep = []
            for p, q in zip(pdf["sa"], pdf["sb"]):
                p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= similarity * max(len(p), len(q)) else 0
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """The prefix tokens (key, node, n, r) of shingle sets (rep, s), rarest first.

    Tokens are ordered by how often their class occurs in all the sets, then by
    value. What is collected are the classes' counts, SLOTS numbers at most.
    """
    slot = lambda tokens: tokens % np.uint32(SLOTS)

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for pdf in batches:
            for s in pdf["s"]:
                np.add.at(total, slot(np.frombuffer(s, "<u4")), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": total[at]})

    counted = sets.select("s").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(SLOTS, np.uint32)
    often[counted["slot"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**32 - 1)

    def run(batches):
        for pdf in C.slices(batches):
            keys, nodes, sizes, ranks = [], [], [], []
            for node, s in zip(pdf["rep"], pdf["s"]):
                tokens = np.frombuffer(s, "<u4")
                n = len(tokens)
                length = n - int(np.ceil(n * similarity - EPS)) + 1 if n else 0
                keys.append(tokens[np.lexsort((tokens, often[slot(tokens)]))[:length]].astype(np.int64))
                nodes.append(np.full(length, node, np.int64))
                sizes.append(np.full(length, n, np.int32))
                ranks.append(np.arange(1, length + 1, dtype=np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "r": np.concatenate(ranks)})

    return sets.mapInPandas(run, "key long, node long, n int, r int")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """``doc_id``, ``class_id`` (least id of the class) and ``n_links`` (accepted links of its text) per row.

    Documents of equal text are one class member from the start; texts without a
    word are in a class only with equal texts, null being empty. Within a bucket
    all are compared with the member that meets most others over all bands. Where
    the members are then of several components they owe each other a comparison:
    small buckets pay in pairs, members of large ones are matched by their rarest
    shingles, which finds every similar pair among them. Rows without an id are
    left out. Repeated rows give repeated rows. Of one id's different texts only
    the one of the least digest can be similar to others; the rest are in classes
    with equal texts. ``weighted`` lets repeated shingles count in the signatures.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text").where("doc_id is not null")
    tables = C.Tables(spark, "minhash")
    table = tables.cut(sketches(docs, bands, rows, weighted), "sketches")
    texts = tables.cut(table.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "texts")
    several = texts.groupBy("rep").agg(F.min("digest").alias("least"), F.count("digest").alias("n"))
    several = tables.cut(several.where("n > 1").select("rep", "least"), "several")  # ids of more than one text
    owner = texts.join(several, "rep", "left").where("least is null or least = digest").drop("least")
    C.release(spark)
    keyed = owner.select("rep", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("rep").alias("n"))
    met = tables.cut(keyed.join(sizes, "key").groupBy("rep").agg(F.sum("n").alias("pop"), F.max("n").alias("most")), "met")
    C.release(spark)
    busy = met.where("most > 1").select("rep").hint("merge")  # the same plan at every size
    named = docs.withColumnRenamed("doc_id", "rep").join(busy, "rep").join(several, "rep", "left")
    named = named.where(F.col("least").isNull() | (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("least"))).select("rep", "text")
    sets = tables.cut(shingle_sets(named).dropDuplicates(["rep"]), "sets")
    C.release(spark)
    sig = owner.select("rep", "sig")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose shingle sets have the similarity."""
        pairs = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        pairs = tables.cut(plausible(pairs, bands, rows, similarity), "plausible")
        pairs = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
        good = tables.cut(similar(pairs, similarity), "links")
        C.release(spark)
        return good

    members = keyed.join(met.where("most > 1").select("rep", "pop"), "rep")
    centers = members.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("r"))).alias("c"), F.count("rep").alias("n")).where("n > 1").select("key", (-F.col("c")["r"]).alias("center"))
    star = tables.cut(members.join(centers, "key").select("key", F.col("rep").alias("node"), "center"), "stars")
    accepted = alike(star.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct())
    known = tables.cut(components(accepted, tables), "roots")
    pairs, crowd = owed(star, known, tables)
    accepted = accepted.union(alike(pairs))
    crowd = tables.cut(crowd, "crowd")
    if not crowd.isEmpty():
        tokens = tables.cut(rarest(sets.join(crowd.withColumnRenamed("node", "rep"), "rep"), similarity), "tokens")
        C.release(spark)
        accepted = accepted.union(alike(rare(tokens, known, similarity)))
    links = tables.cut(accepted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = tables.cut(components(links, tables), "roots")
    stands = tables.cut(owner.select("rep", "digest"), "stands")
    tables.keep_only(table, links, roots, stands)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("node").alias("n_links"))
    joined = roots.join(degree, "node").withColumnRenamed("node", "rep").join(stands, "rep")
    named = owner_of(table).join(joined, ["rep", "digest"], "left")
    return named.select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def owner_of(table: DataFrame) -> DataFrame:
    """Every row's id, its text's digest and the least id that has its text."""
    return table.select("doc_id", "digest").join(table.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digest")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(C.read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of least id; rows without an id stay."""
    gone = classes(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
