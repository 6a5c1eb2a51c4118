"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines become sets of character shingles. A signature deals all of a line's
shingles out to a few bins by one hash (one-permutation MinHash) and takes the
least and the greatest of two hashes in each, every one of which agrees for two
lines with the probability of their Jaccard similarity. Bands of
coordinates give candidate pairs, the exact Jaccard similarity of the shingle
sets decides, and union-find joins the accepted pairs; of each component the
first line of the corpus stays.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from . import common as C
from .components import components, owed, ranked, rare

#: Characters of a shingle, for the similarity and for the signature.
SHINGLE = 8
#: Bins of shingles, and bands for each of the SHIFTS: with these, a band's four coordinates are of four bins.
BANDS, SHIFTS = 8, (1, 2, 3)
SIMILARITY = 0.8
#: Shingles cut from one slice of a line, so that a long line is not carried along with each of its shingles.
RUN = 256
#: How tables of hashes are written: a dictionary of them is larger than they are, and is built in vain.
HASHES = {"parquet.enable.dictionary": "false"}
#: Bits of the filter that says which lines can be of use; 8 MB are broadcast at any size of the corpus.
BITS = 1 << 26


BLANKS = " \t\x0b\x0c\r"


def normal(line: Column) -> Column:
    """Lines are compared in lower case (their text is lowered before it is split), without blanks at their ends."""
    return F.trim(line, F.lit(BLANKS))


def line_id(norm: Column) -> Column:
    """128-bit identity of a line. Candidates are found by its first half, of which an accidental repeat does no harm."""
    return F.struct(F.xxhash64(norm).alias("h"), F.xxhash64(F.lit(77), norm).alias("g"))


def lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: document, digest of its text, position and normal form."""
    split = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    return split.select("doc_id", "t", "pos", normal(F.col("line")).alias("norm")).where("norm <> ''")


def signatures(found: DataFrame, shingle: int, bands: int) -> DataFrame:
    """The coordinates of every distinct line, four bytes each, its copies, and the shingles in all of them (often).

    The signature sees all shingles that the exact similarity sees. One hash
    deals them out to bins; the least and the greatest of its upper and of its
    lower half in each bin are four coordinates. Those of an empty bin are null,
    which agrees with null: then both sets have nothing there. They are aggregated
    where the lines are read, so that repeated lines leave there as one row.
    """
    starts = lambda u: F.sequence(F.lit(0), F.greatest(F.octet_length(u) / 4 - shingle, F.lit(0)).cast("int"), F.lit(RUN))
    runs = lambda u: F.transform(starts(u), lambda i: F.substring(u, i * 4 + 1, F.lit(4 * (RUN + shingle - 1))))
    cut = found.select(F.xxhash64("norm").alias("line"), F.posexplode(F.transform(F.array(F.encode("norm", "UTF-32")), runs)[0]).alias("run", "u"))
    places = cut.select("line", "run", "u", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("u") / 4 - shingle, F.lit(0)).cast("int"))).alias("i"))
    each = places.select("line", (F.col("run") + F.col("i")).alias("at"), F.xxhash64(F.substring("u", F.col("i") * 4 + 1, F.lit(4 * shingle))).alias("h"))
    halves = each.select("line", "at", F.expr("h >> 32").alias("u"), F.expr("(h & 4294967295) - 2147483648").alias("l"), F.pmod(F.shiftright("h", 32), F.lit(bands)).cast("int").alias("bin"))
    of_bin = lambda c, b: F.expr(f"{c.replace('_', '(')}) filter (where bin = {b})")
    signed = halves.groupBy("line").agg(*[of_bin(kind, b).alias(f"{kind}{b}") for b in range(bands) for kind in KINDS], F.count("line").alias("often"), F.expr("count(line) filter (where at = 0)").alias("copies"))
    return signed.select("line", "often", "copies", *[F.col(c).cast("int").alias(c) for c in coordinates(bands)])


KINDS = [f"{f}_{n}" for n in "ul" for f in ("min", "max")]


def coordinates(bands: int) -> list[str]:
    return [f"{kind}{b}" for b in range(bands) for kind in KINDS]


def band_keys(bands: int) -> list[list[Column]]:
    """The keys of the bands, by shift.

    Bands take four coordinates each, one of every kind and of bins a shift apart,
    so that every coordinate is in as many bands as there are ``SHIFTS``. The key
    of a band of empty bins only is null, as nothing in it is shared.
    """

    def key(shift: int, b: int) -> Column:
        band = [f"{kind}{(b + shift * k) % bands}" for k, kind in enumerate(KINDS)]
        return F.when(F.coalesce(*band).isNotNull(), F.xxhash64(F.lit(shift * bands + b), *[F.coalesce(c, F.lit(0)) for c in band]))

    return [[key(shift, b) for b in range(bands)] for shift in SHIFTS]


def sketches(bands: int) -> dict[str, Column]:
    """A byte of each coordinate, eight to a long."""
    places = coordinates(bands)
    byte = lambda c, k: F.shiftleft(F.xxhash64(c).bitwiseAND(255), 8 * k)
    return {f"s{at // 8}": reduce(Column.bitwiseOR, [byte(c, k) for k, c in enumerate(places[at : at + 8])]) for at in range(0, len(places), 8)}


def agreements(a: list[Column], b: list[Column]) -> Column:
    """In how many of their bytes two sketches agree."""
    total = F.lit(0)
    for p, q in zip(a, b):
        x = p.bitwiseXOR(q)
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        total = total + 8 - F.bit_count(x.bitwiseAND(0x0101010101010101))
    return total


def alike(pairs: DataFrame, a: str, b: str, similarity: float) -> DataFrame:
    """The pairs whose shingles, arrays in two columns, have the Jaccard similarity.

    Both counts are made once and in compiled code: no condition moves before the
    explosion of the one array, and none of it is a lambda, in which sets would be of boxed values.
    """
    counts = F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("any"))
    return pairs.withColumn("counts", F.explode(F.array(counts))).where(F.col("counts")["both"] / F.col("counts")["any"] >= similarity)


def shingles(norm: Column, shingle: int) -> Column:
    """All character shingles, hashed; a shorter line is one shingle. In UTF-32 a shingle is a slice of bytes."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(norm) - shingle, F.lit(0)) * 4 + 1, F.lit(4))
    hashed = lambda u: F.transform(at, lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * shingle))))
    return F.transform(F.array(F.encode(norm, "UTF-32")), hashed)[0]


def marked(rows: DataFrame, line: Column, lines: DataFrame) -> DataFrame:
    """The rows whose ``line`` (long) is among ``lines``, and a share of the others: one bit a line says so.

    Filters rows where they are read, so that most of them, of lines that meet no
    other, are not moved at all.
    """
    slot = lambda c: F.pmod(c, F.lit(BITS)) + 1
    table = lines.select(slot(F.col("line")).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    x, part, bits = (C.free(n, rows) for n in ("slot", "part", "bits"))
    given = rows.withColumn(x, slot(line)).join(F.broadcast(table.toDF(part, bits)), F.bitmap_bucket_number(x) == F.col(part))
    at = F.bitmap_bit_position(x)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return given.where(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def buckets(signed: DataFrame, tables: C.Tables, bands: int) -> DataFrame:
    """Lines (node) that share a band key with others, and a center of each key: the line with most in its copies.

    Of lines that differ a little from one another that is likely the one that
    they all come from. Only members of shared keys are put in order. The bands are
    dealt out in one turn a shift, so that only a part of their rows is between
    tasks at a time.
    """
    alone = W.partitionBy("key")
    ties, turns = alone.orderBy(F.desc("often"), "node").rowsBetween(W.unboundedPreceding, W.unboundedFollowing), []
    for keys in band_keys(bands):
        keyed = signed.select(F.col("line").alias("node"), "often", F.explode(F.array(*keys)).alias("key")).where("key is not null")
        met = keyed.withColumn("n", F.count("node").over(alone)).where("n > 1")  # most keys go here, by a sort of one column
        found = met.withColumn("center", F.first("node").over(ties))
        turns.append(tables.cut(found.select("key", "node", "center"), "buckets", **HASHES))
        C.release(signed.sparkSession)
    return reduce(DataFrame.union, turns)


def links(found: DataFrame, tables: C.Tables, shingle: int, bands: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of lines that connect the components of similar candidates, and the places of all lines that may have others beside them.

    Within a bucket, all lines are first compared with the bucket's centre.
    A bucket whose lines are then of one component is done, in rows in
    proportion to its size. The lines of the others owe each other a comparison:
    small buckets pay in pairs, lines of large ones are matched by their rarest
    shingles, which finds every similar pair among them. Pairs whose sketches rule
    the similarity out (five standard errors) are not compared exactly.
    """
    spark = found.sparkSession
    signed = tables.cut(signatures(found, shingle, bands), "signatures", **HASHES)
    C.release(spark)
    active = buckets(signed, tables, bands)
    sketch = [*sketches(bands)]
    shared = tables.cut(signed.select("line", *[c.alias(n) for n, c in sketches(bands).items()]).join(active.select(F.col("node").alias("line")).distinct(), "line"), "shared")
    C.release(spark)
    again = signed.where("copies > 1").select("line").union(shared.select("line"))
    at = found.select("doc_id", "t", "pos", line_id(F.col("norm")).alias("line"), "norm")
    at = tables.cut(marked(at, F.col("line")["h"], again), "places")
    tables.drop(signed)
    C.release(spark)
    texts = at.select(F.col("line")["h"].alias("line"), "norm").join(shared.hint("merge"), "line").distinct()  # the same plan at every size
    texts = tables.cut(texts, "texts")
    tables.drop(shared)
    C.release(spark)
    k = 4 * bands
    least = k * (similarity - 5 * (similarity * (1 - similarity) / k) ** 0.5)

    def plausible(a: list[Column], b: list[Column]) -> Column:
        return agreements(a, b) >= least

    def similar(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(texts.select(F.col("line").alias(x), F.col("norm").alias(f"n{x}"), *[F.col(c).alias(f"{c}{x}") for c in sketch]), x)
        near = pairs.where(plausible(*[[F.col(f"{c}{x}") for c in sketch] for x in "ab"]))
        each = F.struct(*[shingles(F.col(f"n{x}"), shingle).alias(f"s{x}") for x in "ab"])
        sets = near.select("na", "nb", F.explode(F.array(each)).alias("s")).select("na", "nb", "s.*")
        good = alike(sets, "sa", "sb", similarity)
        out = tables.cut(good.select(line_id(F.col("na")).alias("a"), line_id(F.col("nb")).alias("b")), "links")
        C.release(spark)
        return out

    roots = tables.cut(components(similar(active.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()), tables), "roots")
    known = roots.select(F.col("node")["h"].alias("node"), F.col("root")["h"].alias("root"))
    pairs, crowd = owed(active, known, tables)
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(similar(pairs))
    crowd = tables.cut(crowd, "crowd")
    if not crowd.isEmpty():
        sets = texts.join(crowd.withColumnRenamed("node", "line"), "line").select(F.col("line").alias("node"), line_id(F.col("norm")).alias("id"), F.array_distinct(shingles(F.col("norm"), shingle)).alias("s"), *sketch)
        sets = tables.cut(sets, "sets")
        tokens = tables.cut(ranked(sets.drop("id"), similarity, sketch), "tokens")
        C.release(spark)
        met = tables.cut(rare(tokens, known, similarity, plausible, sketch), "met")
        tables.drop(tokens)
        C.release(spark)
        for x in "ab":
            met = met.join(sets.select(F.col("node").alias(x), F.col("id").alias(f"i{x}"), F.col("s").alias(f"s{x}")), x)
        edges = edges.union(tables.cut(alike(met, "sa", "sb", similarity).select(F.col("ia").alias("a"), F.col("ib").alias("b")), "links"))
    tables.drop(texts)
    C.release(spark)
    return edges, at.drop("norm")


def removals(docs: DataFrame, tables: C.Tables, shingle: int = SHINGLE, bands: int = BANDS, similarity: float = SIMILARITY) -> DataFrame:
    """Positions (gone) of the lines that go, as one list per document: per id and digest of its text (t)."""
    found = lines(docs.select("doc_id", "text").where("doc_id is not null"))
    edges, at = links(found, tables, shingle, bands, similarity)
    roots = components(edges, tables)
    C.release(docs.sparkSession)
    each = at.groupBy("line").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count("pos").alias("n"))
    each = each.join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    heads = each.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("root", "first")
    known = tables.cut(each.select("line", "root").join(heads, "root").select("line", "first"), "heads")
    C.release(docs.sparkSession)
    gone = at.join(known, "line").where("struct(doc_id, t, pos) <> first")
    out = tables.cut(gone.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone")), "gone")
    tables.keep_only(out)
    C.release(docs.sparkSession)
    return out


def dedup(docs: DataFrame, **parameters) -> DataFrame:
    """Every row with ``text`` less its removed lines, ``n_lines`` and ``n_removed`` (long).

    Lines without a word stay and are not counted. Of equal or similar lines
    anywhere in the corpus the one of the least document id stays, the first in
    it. Null texts stay null; rows without an id are left alone. Repeated rows are
    one document and lose the same lines; of one id's different texts, the one of
    the least digest comes first. Other columns pass through; existing ones of
    the two new names are replaced.
    """
    tables = C.Tables(docs.sparkSession, "lines")
    gone = removals(docs, tables, **parameters)
    rest = docs.drop("n_lines", "n_removed")
    at, t, i = (C.free(n, rest) for n in ("gone", "t", "i"))
    names = gone.select(F.col("doc_id").alias(i), F.col("t").alias(t), F.col("gone").alias(at)).hint("merge")
    rows = rest.join(names, (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(t)), "left")
    parts = F.split("text", "\n")
    counted = F.size(F.filter(parts, lambda s: normal(s) != ""))
    kept = F.array_join(F.filter(parts, lambda _, k: ~F.array_contains(at, k)), "\n")
    return rows.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(counted).cast("long"),
            "n_removed": F.coalesce(F.size(at), F.lit(0)).cast("long"),
            "text": F.when(F.col(at).isNull(), F.col("text")).otherwise(kept),
        }
    ).select(*rest.columns, "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that repeat others."""
    columns = docs.columns
    return dedup(docs).select(*columns)
