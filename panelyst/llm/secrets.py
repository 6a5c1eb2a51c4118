"""Secret scanning over an incremental blob ledger, in DataFrame functions only.

Every version of a file is a blob named by the digest of its content. Only
pairs of blob and rule version that the ledger lacks are scanned; findings are
joined back to every path whose version has that blob.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from . import common as C


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str  # Java regular expression
    group: int = 0  # what ``least`` measures
    least: int = 1  # characters


#: The base kinds in their listed order, then what this engine adds.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("hosted_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 36),
)
BASE = ("assign", "access", "hex")
FINDING = "array<struct<kind:string,start:int,stop:int>>"
LEDGER_SCHEMA = f"blob string, kind string, version int, found {FINDING}"


def before(sizes: Column) -> Column:
    """The sum of the sizes before each one.

    Appending copies a list. Sums are made within blocks of about the square
    root of all sizes, then over the blocks, so that n sizes take n**1.5 steps.
    """

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocks(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), width), lambda i: sums(F.slice(a, i + 1, width)))

    def shifted(made: Column) -> Column:
        starts = sums(F.transform(made, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(made, starts, lambda b, at: F.transform(b["out"], lambda x: x + at)))

    return once(sizes, lambda a: once(blocks(a), shifted))


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out a single time however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def found(text: Column, rule: Rule) -> Column:
    """Spans of the rule in the text, in code points, leftmost and not overlapping.

    The texts between the matches have the lengths that the matches' offsets
    are summed from; texts without a match skip all of it.
    """
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)
    read = F.struct(lengths(0).alias("m"), F.transform(F.split(text, rule.pattern, -1), F.length).alias("g"), lengths(rule.group).alias("k"))

    def spans(r: Column) -> Column:
        ends = F.zip_with(F.slice(r["g"], 1, F.size(r["m"])), r["m"], lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        placed = F.zip_with(ends, before(F.transform(ends, lambda e: e["g"] + e["m"])), lambda e, at: F.struct((at + e["g"]).alias("start"), (at + e["g"] + e["m"]).alias("stop")))
        long = F.filter(F.zip_with(placed, r["k"], lambda p, k: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), k.alias("k"))), lambda s: s["k"] >= rule.least)
        return F.transform(long, lambda s: F.struct(F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    return F.when(text.rlike(rule.pattern), once(read, spans)).otherwise(F.array().cast(FINDING))


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """``blob`` and ``found`` (spans of all rules by start, then rule order) for each row of ``path`` and ``text``.

    Null texts count as empty. Copies of a content are scanned once, whatever
    their number. The ledger is an append-only parquet table; a row appended
    twice by a retried job is read once. A changed rule needs a new version
    number. Columns other than ``path`` are not returned.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col(path), text.alias("text"), F.sha2(text, 256).alias("blob"))
    blobs = named.select("blob", "text").distinct()
    wanted = {(r.kind, r.version) for r in rules}
    try:
        ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    except Exception as e:  # only a missing table means an empty ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    seen = F.array().cast("array<struct<kind:string,version:int>>")
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        blobs = blobs.join(done, "blob", "left")
        seen = F.coalesce("seen", seen)
    unseen = lambda r: ~F.exists(seen, lambda s: (s["kind"] == r.kind) & (s["version"] == r.version))
    todo = F.filter(
        F.array(*[F.when(unseen(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), found(F.col("text"), r).alias("found"))) for r in rules]),
        lambda x: x.isNotNull(),
    )
    fresh = blobs.select("blob", F.explode(todo).alias("x")).select("blob", "x.*")
    fresh.write.mode("append").parquet(ledger_path)
    current = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    keep = F.lit(False)
    for kind, v in sorted(wanted):
        keep = keep | ((F.col("kind") == kind) & (F.col("version") == v))
    # only blobs with findings are gathered and joined; the rest have none
    by_blob = (
        current.where(keep & (F.size("found") > 0)).groupBy("blob").agg(F.collect_set("found").alias("sets"))
        .select("blob", F.array_sort(F.transform(F.flatten("sets"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))).alias("found"))
    )
    return named.select(path, "blob").join(by_blob, "blob", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>"))
    )


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, C.Tables(spark, "secrets").path("ledger"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select(
        "doc_id",
        *[F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
