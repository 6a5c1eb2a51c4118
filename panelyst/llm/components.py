"""Distributed union-find and the comparisons that buckets still owe, in DataFrame functions only."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from .common import Tables

#: Members of a bucket, besides its centre, up to which all its pairs are compared; each member then has so many partners at most.
SMALL = 8
#: Classes of tokens that are counted to order them from rare to common; the counts, so many rows at any size of the corpus, are broadcast.
SLOTS = 1 << 18
#: Takes what rounding may add to a product out of a bound, so that no pair is lost to it.
EPS = 1e-9


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (a, b).

    Each round every node chooses the first, in a pseudo-random order, of itself
    and its neighbours, and the graph shrinks to the chosen nodes. The first two
    rounds use one order, so that stars end in them; then every second round draws
    a new one, which leaves three quarters of the nodes at most on average
    whatever the graph's shape: the rounds are logarithmic in the longest path,
    and all rounds together read a multiple of the edges. The choices are put
    together from the last round back. Loops and repeated edges do no harm; edges
    with a null end are ignored. Nothing is collected.
    """
    live = tables.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not live.isEmpty():
        seed = F.lit(len(rounds) if len(rounds) > 1 and len(rounds) % 2 else 0)
        place = lambda c: F.struct(F.xxhash64(seed, c).alias("r"), F.col(c).alias("n"))
        both = live.union(live.select("b", "a"))
        chosen = both.groupBy("a").agg(F.min(place("b")).alias("p")).select("a", F.least("p", place("a"))["n"].alias("p"))
        rounds.append(tables.cut(chosen, "chosen"))
        of_a, of_b = rounds[-1].select("a", F.col("p").alias("pa")), rounds[-1].select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = live.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        fewer = tables.cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        tables.drop(live)
        live = fewer
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = rounds[-1].select(F.col("a").alias("node"), F.col("p").alias("label"))
    for chosen in rounds[-2::-1]:
        later = label.select(F.col("node").alias("p"), "label")
        label = chosen.join(later, "p", "left").select(F.col("a").alias("node"), F.coalesce("label", "p").alias("label"))
    label = tables.cut(label, "labels")
    tables.drop(live, *rounds)
    least = label.groupBy("label").agg(F.min("node").alias("root"))
    return label.join(least, "label").select("node", "root")


def owed(members: DataFrame, roots: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """What buckets still owe after their members (key, node, center) met their centre: pairs (a, b), and crowded nodes.

    ``roots`` has the component of the nodes linked so far (node, root). Two
    members owe a comparison unless they are of one component or one is the
    bucket's centre. Buckets of up to SMALL such members pay in pairs. The
    members of larger ones are returned as ``node``, once each: ``rare`` finds
    all similar pairs among them without going through the pairs of a bucket.
    """
    rooted = members.where("node <> center").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key").agg(F.count("node").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "n")
    still = tables.cut(rooted.join(sizes, "key").select("key", "node", "root", "n"), "open")
    few = still.where(F.col("n") <= SMALL)
    a, b = (few.select("key", F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    pairs = a.join(b, "key").where("a < b and ra <> rb").select("a", "b").distinct()
    return pairs, still.where(F.col("n") > SMALL).select("node").distinct()


def prefix_length(n: Column, similarity: float) -> Column:
    """So many of a set's rarest tokens hold one that any set of the similarity shares with it."""
    return n - F.ceil(n * similarity - EPS).cast("int") + 1


def rare(tokens: DataFrame, roots: DataFrame, similarity: float, plausible=None, carried: list[str] = []) -> DataFrame:
    """All pairs (a, b) of different components that may have the similarity, by their sets' rarest tokens.

    ``tokens`` has, for each set (``node``, ``n`` its size), the tokens (``key``)
    of its prefix with their rank ``r`` from 1 in one order of all tokens. Two
    sets of the similarity share a token of both prefixes, are of alike size, and
    have enough tokens left behind it; so no similar pair is missed. In each
    token's bucket, members outside its largest component meet the others.
    ``plausible`` makes a further condition of the ``carried`` columns of both
    sides, that similar sets always or all but always meet.
    """
    rooted = tokens.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key", "root").agg(F.count("node").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("m"), F.count("root").alias("k")).where("k > 1").select("key", F.col("m")["root"].alias("main"))
    still = rooted.join(main, "key")
    a = still.where("root <> main").select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("r").alias("pa"), *[F.col(c).alias(f"{c}a") for c in carried])
    b = still.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("r").alias("pb"), "main", *[F.col(c).alias(f"{c}b") for c in carried])
    fits = (F.col("nb") >= F.col("na") * similarity - EPS) & (F.col("na") >= F.col("nb") * similarity - EPS)
    fits &= 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - EPS
    if plausible is not None:
        fits &= plausible(*[[F.col(f"{c}{x}") for c in carried] for x in "ab"])
    met = a.join(b, "key").where("ra <> rb and (rb = main or a < b)").where(fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ranked(sets: DataFrame, similarity: float, carried: list[str] = []) -> DataFrame:
    """The prefix tokens (key, node, n, r and the carried columns) of sets (node, ``s`` array of distinct 64-bit tokens), rarest first.

    Tokens are ordered by how often their class occurs in all the sets, then by
    value. The classes' counts are broadcast: SLOTS rows at most.
    """
    each = sets.repartition("node").select("node", F.size("s").alias("n"), F.explode("s").alias("key"), *carried).withColumn("slot", F.pmod("key", F.lit(SLOTS)).cast("int"))
    counts = each.groupBy("slot").agg(F.count("key").alias("often"))
    order = W.partitionBy("node").orderBy("often", "key")
    return each.join(F.broadcast(counts), "slot").withColumn("r", F.row_number().over(order)).where(F.col("r") <= prefix_length(F.col("n"), similarity)).select("key", "node", "n", "r", *carried)
