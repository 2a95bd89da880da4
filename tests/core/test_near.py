"""Near duplicates where many hashes are near each other: rows made, and results against all pairs compared here."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import cells, duplicates, passes


def hashes(n, flips, seed=3):
    """Hashes that differ from one of two others in up to ``flips`` places, with a few equal ones and none."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(63) for _ in range(2)]
    made = [c ^ sum(1 << b for b in draw.sample(range(63), draw.randint(0, flips))) for c in draw.choices(centres, k=n)]
    made += [made[0], made[1], 0, 0, draw.getrandbits(63)]
    return [(f"i{k:04}", h if k % 2 else h - (1 << 63)) for k, h in enumerate(made)]


def wanted(rows, threshold):
    """Pairs of representatives, groups, diameters."""
    distance = lambda x, y: ((x ^ y) % 2**64).bit_count()
    reps = {}
    for item, h in sorted(rows, reverse=True):
        if h:
            reps[h] = item
    names = sorted((item, h) for h, item in reps.items())
    pairs = {(a, b, distance(x, y)) for k, (a, x) in enumerate(names) for b, y in names[k + 1 :] if distance(x, y) <= threshold}
    root = {a: a for a, _ in names}
    for a, b, _ in sorted(pairs):
        least, most = sorted((root[a], root[b]))
        root = {k: least if v == most else v for k, v in root.items()}
    groups = {}
    for item, h in rows:
        if h:
            groups.setdefault(root[reps[h]], []).append((item, h))
    groups = {g: m for g, m in groups.items() if len(m) > 1}
    return pairs, {(item, g) for g, m in groups.items() for item, _ in m}, {(g, len(m), max(distance(x, y) for _, x in m for _, y in m)) for g, m in groups.items()}


def most_rows(df):
    """The most rows that any step of df's plan makes, the filter of a join left out."""
    df.collect()
    seen, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += inner + [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
    return max(seen)


@pytest.fixture(scope="module")
def dense(spark):
    rows = hashes(300, 6)
    return rows, spark.createDataFrame(rows, "p string, h long").localCheckpoint()


@pytest.fixture(params=[8_192, 60], ids=["one cell", "many cells"])
def few(request, monkeypatch):
    monkeypatch.setattr(cells, "FEW", request.param)
    monkeypatch.setattr(cells, "TOGETHER", 200)
    monkeypatch.setattr(cells, "WIDE", 50)


def test_diameters_without_a_row_for_each_pair(dense):
    rows, df = dense
    groups = duplicates.near_groups(df, "p", "h", 12).localCheckpoint()
    got = duplicates.group_diameters(groups, df, "p", "h")
    assert most_rows(got) <= 20 * len(rows)
    assert {tuple(r) for r in got.collect()} == wanted(rows, 12)[2]


def test_diameters_in_cells(dense, few):
    rows, df = dense
    for threshold in (1, 5, 12):
        got = duplicates.group_diameters(duplicates.near_groups(df, "p", "h", threshold), df, "p", "h")
        assert {tuple(r) for r in got.collect()} == wanted(rows, threshold)[2]
    told = df.sparkSession.createDataFrame([("i0001", "x"), ("i0002", "x"), ("i0001", "y")], "item string, group_id string")
    got = duplicates.group_diameters(told, df.withColumn("h", F.when(F.col("p") != "i0002", F.col("h"))), "p", "h")
    assert {tuple(r) for r in got.collect()} == {("x", 2, 0), ("y", 1, 0)}


def test_groups_from_fewer_links_than_pairs(dense, monkeypatch):
    rows, df = dense
    pairs, groups, _ = wanted(rows, 12)
    taken = []
    whole = duplicates.components
    monkeypatch.setattr(duplicates, "components", lambda edges: whole((taken.append(edges.count()), edges)[1]))
    assert {tuple(r) for r in duplicates.near_groups(df, "p", "h", 12).collect()} == groups
    assert taken[0] < len(rows) < len(pairs)


def test_groups_in_cells(dense, few):
    rows, df = dense
    for threshold in (1, 5, 12):
        assert {tuple(r) for r in duplicates.near_groups(df, "p", "h", threshold).collect()} == wanted(rows, threshold)[1]
    assert duplicates.near_groups(df.where("h = 0"), "p", "h", 12).count() == 0


def test_findings_from_fewer_links_than_pairs(dense, monkeypatch):
    rows, df = dense
    groups = wanted(rows, 12)[1]
    sizes = {g: sum(g == x for _, x in groups) for _, g in groups}
    taken = []
    whole = duplicates.components
    monkeypatch.setattr(duplicates, "components", lambda edges: whole((taken.append(edges.count()), edges)[1]))
    got = passes.near_duplicates(df.withColumn("d", F.when(F.col("p") < "i0002", "same").otherwise(F.col("p"))), "p", "h", "d", 12)
    assert {(r.item, r.observation) for r in got.collect()} == {(i, f"Visually similar to {sizes[g] - 1} other file(s) in this folder (dHash distance ≤ 12).") for i, g in groups if i >= "i0002"}
    assert taken[0] < len(rows)


def test_pairs_without_probes_as_rows(dense):
    rows, df = dense
    pairs = wanted(rows, 16)[0]
    got = duplicates.near_pairs(df, "p", "h", 16)
    assert most_rows(got) <= max(len(pairs), 20 * len(rows))
    assert {tuple(r) for r in got.collect()} == pairs


def test_pairs_in_cells_and_bands(dense, few):
    rows, df = dense
    for threshold, bands in ((0, (1, 0)), (1, (1, 1)), (2, (3, 0)), (10, (4, 2))):
        pairs = wanted(rows, threshold)[0]
        got = duplicates.near_pairs(df, "p", "h", threshold).collect()
        assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs
        classes = duplicates._classes(df, "p", "h")
        found = duplicates.banded_pairs(classes, threshold, 64, *bands)
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
        assert {tuple(r) for r in found.collect()} == pairs


def test_bands_only_where_they_leave_little():
    assert duplicates.band_plan(16, 63, 100_000) is None and duplicates.band_plan(10, 64, 1_000_000) is None
    assert duplicates.band_plan(2, 64, 10_000_000) and duplicates.band_plan(2, 64, 500) is None
