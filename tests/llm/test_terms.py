"""Value frequencies against brute force and their SQL, and their edge cases."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.llm import queries, termfreq

E = "ent_id long, imports array<string>, calls array<string>, loaded_at timestamp, mark string"


def counted(spark, rows, limit=termfreq.COUNTERS, **more):
    out = termfreq.frequencies(spark.createDataFrame(rows, E).withColumn("loaded_at", F.current_timestamp()), "ent_id", ["imports", "calls"], **more)
    return {(r.field, r.term): (r.n_occ, r.n_records, r.mark) for r in out.collect()}


def test_frequencies_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice(["a", " a\t", "b\n", "", None, "  ", f"t{i % 37}", "é" * 300]) for _ in range(rng.randrange(6))] if i % 9 else None, ["hot"], None, "x") for i in range(400)]
    rows += rows[:50]  # delivered again
    occ, rec, all_ = Counter(), defaultdict(set), defaultdict(set)
    for i, imports, calls, *_ in rows[:400]:
        for field, values in (("imports", imports), ("calls", calls)):
            for v in values or []:
                if v is not None and v.strip(" \t\n"):
                    t = v.strip(" \t\n")
                    occ[field, t] += 1
                    rec[field, t].add(i)
                    all_[field].add(i)
    want = {k: (n, len(rec[k]), "common" if len(rec[k]) > 0.05 * len(all_[k[0]]) else "rare" if len(rec[k]) < 3 else "ok") for k, n in occ.items()}
    assert counted(spark, rows, common=0.05) == want


def test_frequencies_edges(spark):
    assert counted(spark, []) == {}
    assert counted(spark, [(None, ["x"], [], None, None), (1, ["x", "X"], None, None, None)])["imports", "x"] == (2, 2, "common")


def test_counters_are_passed_on(spark):
    rows = spark.createDataFrame([(i, [f"t{i}", "hot", "hot"]) for i in range(500)], "r long, a array<string>")
    got = {(x.term): (x.n_occ, x.n_records) for x in termfreq.term_counts(rows, "r", ["a"], limit=10).collect()}
    assert got["hot"] == (1000, 500) and got[None] == (1500, 500) and got["t7"] == (1, 1)


def test_counters_of_records_in_several_rows(spark):
    """Rows of a record one after the other, over the borders of batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(i // 4 if i < 40 else None, ["a", f"t{i % 4}"]) for i in range(44)], "r long, a array<string>").coalesce(1)
        got = {x.term: (x.n_occ, x.n_records) for x in termfreq.term_counts(rows, "r", ["a"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"a": (44, 11), None: (88, 11), **{f"t{i}": (11, 11) for i in range(4)}}


def test_delivered_again_in_files(spark, tmp_path):
    """Of a Parquet table the latest delivery stands, and no arrays are shuffled for it."""
    row = "select {} as ent_id, array({}) as imports, timestamp '2024-01-0{} 00:00:00' as loaded_at"
    df = spark.sql(" union all ".join(row.format(*x) for x in ((1, "'old'", 1), (1, "'new'", 3), (1, "'mid'", 2), (2, "'x'", 1), ("null", "'y'", 1), ("null", "'z'", 2))))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    out = termfreq.frequencies(spark.read.parquet(str(tmp_path / "e")), "ent_id", ["imports"])
    assert {r.term for r in out.collect()} == {"new", "x", "z"}


def test_as_its_sql(spark):
    duckdb, data = pytest.importorskip("duckdb"), Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no data")
    con = duckdb.connect()
    con.sql(f"create view entities as select * from '{data}/entities.parquet'")
    rel = con.sql(queries.ORACLE["p5_found"])
    df = queries.p5_found(spark, str(data)).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
