"""Intermediate tables and shuffle files go as soon as nothing reads them any more."""

import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard
from ledgerloom.llm.shared import shared_folder, shuffles_freed, stored


def shuffled(spark) -> set[Path]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in Path(d).glob("*/shuffle_*.data")}


def left(spark, before: set[Path]) -> set[Path]:
    """Shuffle files that are still there some seconds later: they are freed in the background."""
    for _ in range(100):
        if not (found := shuffled(spark) - before):
            break
        time.sleep(0.1)
    return found


def tables(spark) -> set[str]:
    return {p.name.rsplit("-", 1)[0] + p.name[-8:] for p in Path(shared_folder(spark).removeprefix("file:")).glob("llm/*")}


def near_copies(spark):
    """Three families of near copies, texts of frequent shingles only, and rows without words or id."""
    rows = []
    for family in range(3):
        words = [f"w{family}x{i}" for i in range(60)]
        rows += [(100 * family + k, " ".join([*words[:k], f"new{family}y{k}", *words[k + 1 :]])) for k in range(20)]
    rows += [(1000 + k, "one very common line of words in all of these") for k in range(40)] + [(None, "a b"), (2000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    found = stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    assert not left(spark, before)
    assert sorted(r["count"] for r in found.collect()) == [142] * 1 + [143] * 6


@pytest.mark.parametrize("value", [None, "false", "true"])
def test_the_setting_is_put_back(spark, value):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    try:
        with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
            assert spark.conf.get(key) == "true"
            raise ZeroDivisionError
        assert spark.conf.get(key, None) == value
    finally:
        spark.conf.unset(key)


def test_shingle_counts_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    values, dfs = jaccard.frequent_shingles(near_copies(spark), 3)
    assert len(values) and set(dfs) >= {40.0}
    assert not left(spark, before)


def test_jaccard_keeps_only_the_tables_its_result_reads(spark):
    before = tables(spark)
    found = jaccard.jaccard_components(near_copies(spark), words=3, percent=80)
    kept = {name[:-8] for name in tables(spark) - before}
    assert kept <= {"profiles", "linked", "united", "final"}
    rows = {r.doc_id: r.component_id for r in found.collect()}
    assert rows == {
        **{100 * f + k: 100 * f for f in range(3) for k in range(20)},
        **{1000 + k: 1000 for k in range(40)},
        **{None: None, 2000: 2000},
    }


def test_frequent_entries_go_over_all_ranges_and_come_through():
    """Two light entries of one shingle, a lone one, and a long list of a frequent one."""
    common, light, lone = 5 << 50, 7 << 50, 9 << 50
    rows = [(i, 9, 2, len(t) - 1, np.array(t, np.uint64).tobytes()) for i, t in enumerate([[light, common]] * 2 + [[lone, common]] + [[common]] * 97)]
    kinds = {"node": pa.int64(), "n": pa.int32(), "m": pa.int32(), "light": pa.int32(), "prefix": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
    posted = pa.Table.from_batches(jaccard._posted(4)([batch]))
    assert posted["range"].null_count == 0
    dealt = posted.filter(pa.compute.is_null(posted["block"]))
    assert dealt.num_rows == 100 and set(dealt["range"].to_pylist()) == {0, 1, 2, 3}
    got = []
    for r in range(4):
        part = posted.filter(pa.compute.equal(posted["range"], r)).combine_chunks()
        for out in jaccard._shared(iter(part.to_batches(max_chunksize=7))):
            assert out.schema.names == ["token", "node", "n", "m", "pos"]
            got += [tuple(x.values()) for x in out.to_pylist()]
    want = [(light, i, 9, 2, 0) for i in range(2)] + [(common, i, 9, 2, 1 if i < 3 else 0) for i in range(100)]
    assert sorted(got) == sorted(want)


def test_rows_that_repeat_an_id_count_once(spark):
    """Equal and different texts under one id, and without an id."""
    rows = near_copies(spark).union(near_copies(spark).where("doc_id < 5 OR doc_id IS NULL")).collect()
    rows += [(3, " ".join(f"w1x{i}" for i in range(60)))] + [(None, " ".join([*(f"w2x{i}" for i in range(59)), "end"]))] * 3
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=80).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id == 3} == {0, 3}
    assert {r.component_id for r in found if r.doc_id is not None and 200 <= r.doc_id < 300} == {200}
    assert [r.component_id for r in found if r.doc_id is None].count(200) == 3
