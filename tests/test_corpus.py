"""Snapshot changes against brute force, and their edge cases."""

import random

from skein.operators import snapshots

META = "graph_id long, repo string, branch string, commit_sha string, generated_at string"
ENT = "graph_id long, ord long, id string, name string, calls array<string>, last_modified string, change_count int"
FILE = "graph_id long, path string, modified string"


def found(spark, meta, ents, files):
    df = snapshots.graph_changes(spark.createDataFrame(meta, META), spark.createDataFrame(ents, ENT), spark.createDataFrame(files, FILE))
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_changes_by_kind(spark):
    meta = [
        (2, "r", "main", "c2", "2024-01-02T01:00:00+02:00"),  # the second instant
        (1, "r", "main", "c1", "2024-01-01T00:00:00Z"),
        (9, "r", "main", "c2", "2024-01-01T23:00:00Z"),  # delivered twice
        (3, "r", "main", "c3", "2024-01-03T00:00:00Z"),  # has no rows
        (4, "q", "main", "d1", "2024-01-03T00:00:00Z"),  # the first yields nothing
    ]
    ents = [
        (1, 0, "same", "a", ["x", "y", None], "2024-01-01T00:00:00Z", None), (2, 5, "same", "a", ["", "y", "x"], "2024-01-01T02:00:00+02:00", 0),
        (2, 6, "same", "a", ["", "y", "x"], "2024-01-01T02:00:00+02:00", 0),  # repeated
        (1, 1, "bag", "a", ["x", "x"], None, 1), (2, 1, "bag", "a", ["x"], "", 1),
        (1, 2, "gone", None, None, "not a time", 1), (2, 3, "new", "", [], None, 1),
        (4, 1, "other", "", [], None, 1), (77, 1, "unknown snapshot", "", [], None, 1),
    ]
    files = [(1, "a.go", "2024-01-01T00:00:00Z"), (2, "a.go", "2023-12-31T19:00:00-05:00"), (1, "b.go", None), (2, "b.go", "2024-01-01T00:00:00Z")]
    assert found(spark, meta, ents, files) == {
        ("c2", "entity", "bag", "changed"), ("c2", "entity", "gone", "removed"), ("c2", "entity", "new", "added"), ("c2", "file", "b.go", "changed"),
        ("c3", "entity", "same", "removed"), ("c3", "entity", "bag", "removed"), ("c3", "entity", "new", "removed"), ("c3", "file", "a.go", "removed"), ("c3", "file", "b.go", "removed"),
    }


def test_changes_against_brute_force(spark):
    rng = random.Random(4)
    meta, ents = [], []
    state = {f"k{i}": 0 for i in range(900)}
    truth = set()
    for g in range(5):
        if g:
            before = dict(state)
            for k in rng.sample(sorted(state), 12):
                state[k] += 1
            for k in rng.sample(sorted(state), 5):
                del state[k]
            for i in range(4):
                state[f"n{g}-{i}"] = 0
            truth |= {(f"c{g}", "entity", k, "added") for k in state.keys() - before.keys()} | {(f"c{g}", "entity", k, "removed") for k in before.keys() - state.keys()}
            truth |= {(f"c{g}", "entity", k, "changed") for k in state.keys() & before.keys() if state[k] != before[k]}
        meta.append((g, "r", None, f"c{g}", f"2024-01-0{g + 1}T00:00:00Z"))
        ents += [(g, n, k, "x" * v, None, None, v) for n, (k, v) in enumerate(state.items())]
    assert found(spark, meta, ents, []) == truth


def test_changes_of_empty_tables(spark):
    assert found(spark, [], [], []) == set()
    assert found(spark, [(1, "r", "b", None, None)], [(None, 1, None, None, None, None, None)], []) == set()
