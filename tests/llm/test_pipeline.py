"""The pipeline against its plain restatement, stage by stage."""

import corpus_pipeline
from panelyst.llm import common as C
from panelyst.llm import components

from . import brute as B
from .test_operators import encoder

DATA = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_in_order(spark):
    import pyarrow.parquet as pq

    tables = C.Tables(spark, "test-pipeline")
    docs = C.read(spark, DATA, "documents").unionByName(spark.createDataFrame([(900001, "12 34 !!", None, "s", 8), (900002, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    bench = pq.read_table(f"{DATA}/benchmark.parquet").to_pydict()
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(kept)
        kept = tables.cut(stage(spark, kept, DATA), name.replace(" ", "-"))
        if name != "packing":
            assert kept.columns == docs.columns
            after = pairs(kept)
        if name == "language ID":
            assert {d for d, _ in before} - {d for d, _ in after} == {900001, 900002}
        elif name == "line dedup":
            want = B.line_dedup(before)
            assert sum(want[d][2] != B.sha(t) for d, t in after) <= 2 and len(after) == len(before)
        elif name == "MinHash near-dedup":
            assert {d for d, _ in after} == {d for d, r in B.near_classes(before).items() if d == r}
        elif name == "benchmark decontamination":
            gone = {d for d, v in B.contamination(before, list(zip(bench["item_id"], bench["text"]))).items() if v[4]}
            assert {d for d, _ in after} == {d for d, _ in before} - gone
    B.pieces_ok(after, [r.asDict() for r in kept.collect()], encoder())


def test_run_is_its_stages(spark, tmp_path):
    out = corpus_pipeline.run(spark, DATA)
    kept = C.read(spark, DATA, "documents")
    tables = C.Tables(spark, "test-run")
    for name, stage in corpus_pipeline.STAGES:
        kept = tables.cut(stage(spark, kept, DATA), name.replace(" ", "-"))
    assert sorted(map(tuple, out.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, kept.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_components_of_long_chains(spark):
    import numpy as np

    n, rng = 5000, np.random.default_rng(3)
    orders = {"rising": np.arange(n), "falling": np.arange(n)[::-1], "random": rng.permutation(n)}
    edges = [(int(o[i]) + k * n, int(o[i + 1]) + k * n) for k, o in enumerate(orders.values()) for i in range(n - 1)]
    tables = C.Tables(spark, "test-chains")
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), tables).collect()}
    assert len(out) == 3 * n and all(root == node // n * n for node, root in out.items())
    assert sum("chosen" in path for path in tables.made) <= 40  # rounds


def test_rare_tokens_miss_no_similar_pair(spark):
    """All pairs of 0.8 or more among sets that share most of their tokens, against brute force."""
    import numpy as np
    import pyspark.sql.functions as F

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 60)
    sets = []
    for i in range(300):
        own = base[rng.random(60) < rng.choice([0.7, 0.9, 0.97])]
        sets.append(sorted({*map(int, own), *map(int, rng.integers(0, 2**62, rng.integers(0, 12)))}))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node long, s array<long>")
    alone = df.select("node", F.col("node").alias("root"))
    got = {(r.a, r.b) for r in components.rare(components.ranked(df, 0.8), alone, 0.8).collect()}
    like = {(i, j) for i in range(300) for j in range(i + 1, 300) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert len(like) > 500 and like <= got


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3), (5, 6)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), C.Tables(spark, "test-cc")).collect()}
    assert all(out[i] == i // 20 * 20 for i in range(60)) and all(out[i] == 100 for i in range(100, 180))


def test_release_gives_memory_outside_the_heap_back(spark):
    """What the driver has freed outside its heap does not stay with its process."""
    import re
    from pathlib import Path

    status, heap = Path(f"/proc/{spark.sparkContext._gateway.proc.pid}/smaps_rollup"), spark._jvm.System.gc
    used = lambda: int(re.search(r"\nRss:\s+(\d+)", status.read_text())[1]) / 1024
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(1000)]
    for d in made[:-1]:
        d.end()
    for _ in range(3):  # what collecting garbage gives back is not counted
        heap()
    before = used()
    C.release(spark)
    assert before - used() > 40
