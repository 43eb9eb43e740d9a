"""Windows, numbering, segments and the gate over long series that are cut into cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.operators import segments as G
from cadenza.operators.windows import numbered_within, over_cells
from cadenza.plans import columns


@pytest.fixture(scope="module")
def series(spark):
    """One source with nine tenths of the rows, in no order."""
    rng = np.random.default_rng(2)
    rows = [(0 if i < 900 else 1 + i % 3, i if i < 900 else (i - 900) // 3, float(x)) for i, x in enumerate(rng.integers(0, 50, 1000))]
    return spark.createDataFrame(rows, "source_id long, frame_idx long, value double").repartition(7)


def test_numbers_within_keys(spark):
    rows = [(None if k == 5 else k, (i * 7919) % 101, i) for k in range(6) for i in range(101 if k else 900)]
    d = spark.createDataFrame(rows, "k int, x int, i int").repartition(6)
    got = numbered_within(d, ["k"], ["x", "i"], "n", start=1).collect()
    for k in {r["k"] for r in got}:
        mine = sorted((r["x"], r["i"], r["n"]) for r in got if r["k"] == k)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
    assert len(got) == len(rows) and numbered_within(d.limit(0), ["k"], ["x"], "n").collect() == []


@pytest.mark.parametrize("size, reach", [(32, 31), (10, 3), (7, 1), (1 << 16, 31)])
def test_windows_over_cells_equal_whole_windows(series, size, reach):
    of = lambda w: {"m": F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-reach, -1)), "before": F.lag("value", reach).over(w)}
    got = over_cells(series, ["source_id"], "frame_idx", reach, of, size)
    want = series.withColumns(of(W.partitionBy("source_id").orderBy("frame_idx")))
    rows = lambda d: sorted(d.select("source_id", "frame_idx", "value", "m", "before").collect(), key=lambda r: r[:2])
    assert rows(got) == rows(want) and set(got.columns) == set(want.columns)
    with pytest.raises(ValueError, match="longer"):
        over_cells(series, ["source_id"], "frame_idx", size, of, size)


def test_context_and_flux_over_cells(spark):
    rows = [(s, t * 10 + s, f"t{t}") for s in range(3) for t in range(40)]
    d = spark.createDataFrame(rows, "source_id long, turn long, text string")
    got = {(r["source_id"], r["turn"]): r["context"] for r in columns.context_of(d, 2, size=5).collect()}
    assert got == {(s, t * 10 + s): "\n".join(f"t{x}" for x in range(max(0, t - 2), t)) or None for s in range(3) for t in range(40)}
    assert {r["context"] for r in columns.context_of(d, 0).collect()} == {None}


def test_a_source_of_a_million_rows_is_many_tasks(spark):
    """Windows and numbers of one source: no task has more than a few cells, and results are those of a formula."""
    n = 1_000_000
    d = spark.range(n).select(F.lit(1).alias("source_id"), F.col("id").alias("frame_idx"), (F.col("id") % 1000).cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = columns.with_baseline(d, size=50_000).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in out.groupBy("task").count().collect()]
        assert len(tasks) > 3 and max(tasks) < n / 2
        want = F.when(F.col("frame_idx") == 0, 0.0).when((F.col("value") >= 31) & (F.col("frame_idx") > 31), F.col("value") - 16)
        assert out.filter(want.isNotNull() & (want != F.col("baseline"))).isEmpty()
        numbered = numbered_within(d.select("source_id", "frame_idx"), ["source_id"], ["frame_idx"], "i").withColumn("task", F.spark_partition_id())
        assert numbered.filter("i != frame_idx").isEmpty() and numbered.select("task").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("size", [4, 16, G.CELL])
def test_hysteresis_segments_of_cut_sources(spark, size):
    rng = np.random.default_rng(size)
    loud = {s: rng.random(200) < (0.05 if s == 2 else 0.4) for s in range(3)}
    d = spark.createDataFrame([(s, i, float(x)) for s, xs in loud.items() for i, x in enumerate(xs)], "source_id long, frame_idx long, p double").repartition(5)
    want = []
    for s, xs in loud.items():
        at = np.flatnonzero(xs)
        cuts = np.flatnonzero(np.diff(at) - 1 >= 3)
        want += [(s, int(a), int(b) + 1) for a, b in zip(at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]], strict=True)]
    got = sorted((r["source_id"], r["start_frame"], r["end_frame"]) for r in G.hysteresis_segments(d, 0.5, 3, size=size).collect())
    assert got == sorted(want)


def whole_gate(rows, config):
    out = {}
    for s in {r[0] for r in rows}:
        state = (0.0, False, 0)
        for _, i, x in sorted(r for r in rows if r[0] == s):
            state = G.gate_step(state, x, config)
            out[s, i] = (state[1], x if state[1] else x * config.floor)
    return out


def gated(d, config, size):
    return {(r["source_id"], r["frame_idx"]): (r["open"], r["gated"]) for r in G.hysteresis_gate(d, config, size=size).collect()}


@pytest.mark.parametrize("config", [G.GateConfig(50.0, 30.0, 1, 3, 0.1), G.GateConfig(30.0, 30.0, 2, 9), G.GateConfig(60.0, 5.0, 3, 40)])
def test_gate_by_cells_equals_one_fold(spark, config):
    """Random series with long quiet and loud stretches, so that a gate stays open, or closed, through whole cells, and holds end inside others."""
    rng = np.random.default_rng(3)
    rows = []
    for s in range(4):
        level = np.repeat(rng.choice([0.0, 2.0, 20.0, 40.0, 90.0], 60), 10)
        rows += [(s, i, float(x)) for i, x in enumerate(level * rng.choice([-1, 1], 600) * rng.random(600) ** (0.2 * s))]
    d = spark.createDataFrame(rows, "source_id long, frame_idx long, value double").repartition(6)
    want = whole_gate(rows, config)
    assert {o for o, _ in want.values()} == {True, False}
    assert gated(d, config, 40) == want


def test_gate_whose_envelope_never_forgets_is_repeated(spark, monkeypatch):
    """With a release of a million rows, and cells too short for it, every first guess is wrong; repeating the fold mends it."""
    monkeypatch.setattr(G, "MEMORY", 1e-9)
    rows = [(1, i, 100.0 if i == 2 else 1.0) for i in range(40)]
    config = G.GateConfig(80.0, 60.0, 1, 1_000_000)
    d = spark.createDataFrame(rows, "source_id long, frame_idx long, value double")
    assert gated(d, config, 8) == whole_gate(rows, config)


def test_gate_edge_cases(spark):
    d = spark.createDataFrame([(1, 5, 9.0), (1, 900, 70.0), (2, 0, 0.0)], "source_id long, frame_idx long, value double")
    config = G.GateConfig(50.0, 30.0, 1, 3)
    assert gated(d, config, 4) == whole_gate([(1, 5, 9.0), (1, 900, 70.0), (2, 0, 0.0)], config)
    assert gated(d.limit(0), config, 4) == {}
    with pytest.raises(ValueError, match="closes"):
        G.hysteresis_gate(d, G.GateConfig(10.0, 20.0, 1, 1))
