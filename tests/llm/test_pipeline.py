"""The pipeline's stages, each on what its predecessor kept."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framerank.llm.common import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] and docs.where("text rlike '@mail[0-9]'").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == counts[4]
    sizes = packed.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert sizes.max() <= 4096 and len(sizes) <= 1.02 * sizes.sum() / 4096 + 1


def plain_stages(before, after, name):
    """What a stage must do to its input, checked on the rows themselves."""
    key = lambda r: (r.doc_id, r.text)
    if name in ("quality_rules", "near_dedup"):
        assert not collections.Counter(map(key, after)) - collections.Counter(map(key, before))
    if name == "quality_rules":
        for r in after:
            words = (r.text or "").split()
            windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
            cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
            assert len(words) >= 20 and 100 * len(cover) <= 30 * len(words)
    if name == "near_dedup":
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((r.text or "").lower().split() for r in before)]
        kept, root = {key(r) for r in after}, list(range(len(before)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[max(top(i), top(j))] = min(top(i), top(j))
        classes = collections.defaultdict(set)
        for i, r in enumerate(before):
            classes[top(i)].add(key(r))
        assert all(len(c & kept) == 1 for c in classes.values()) and len(after) == len(classes)
    if name == "pii":
        assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
        assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) for r in after)
        assert all(len(r.text) == r.n_chars for r in after)
    if name == "mix_sources":
        times = collections.Counter(map(key, after))
        assert set(times) <= set(map(key, before)) and max(times.values()) <= 3 * max(collections.Counter(map(key, before)).values())


def test_each_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, SF), name)
        plain_stages(docs.collect(), after.collect(), name)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert (packed["start"] == 0).sum() == docs.count()


def test_awkward_tables_go_through(spark, docs, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns with names that operators use themselves."""
    wide = docs.withColumn("root", F.lit(1)).withColumn("node", F.lit("x")).withColumn("length", F.lit(2)).withColumn("piece", F.lit(3)).withColumn("kept", F.lit(True)).withColumn("h", F.lit(4)).withColumn("terms", F.lit("t"))
    words = " ".join(f"word{i} of" for i in range(60_000))
    more = spark.createDataFrame([(50, words, "en", "s0", len(words), 1), (51, words, "en", "s0", len(words), 1), (52, None, None, None, None, None)], docs.schema)
    more = more.withColumn("root", F.lit(1)).withColumn("node", F.lit("x")).withColumn("length", F.lit(2)).withColumn("piece", F.lit(3)).withColumn("kept", F.lit(True)).withColumn("h", F.lit(4)).withColumn("terms", F.lit("t"))
    spark.createDataFrame([(50, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (wide.unionByName(more), wide.where("false")):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = cut(stage(spark, rows, str(tmp_path)), name)
            assert out.columns == rows.columns, name
            if name == "quality_rules":
                assert {r.doc_id for r in out.select("doc_id").collect()} <= {50, 51}
                # The stages behind it get the awkward rows as well.
                rows = table
            elif name == "near_dedup":
                assert {50, 51} & {r.doc_id for r in out.select("doc_id").collect()} in ({50}, set())
                rows = table
            else:
                rows = out
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).toPandas()
        assert (packed["start"] == 0).sum() == rows.count()


def test_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_trimming_passes_all_batches_and_gives_memory_back_once(monkeypatch):
    import ctypes

    from framerank.llm.common import trimming

    given = []
    monkeypatch.setattr(ctypes, "CDLL", lambda name: type("Libc", (), {"malloc_trim": staticmethod(given.append)}))
    assert list(trimming(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
    assert given == [0]
