"""Closing, components, findings and their ranking against brute force and hand-made masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landshift.operators import pixels, regions


def frame(spark, mask, diff=None, valid=None, g=1):
    diff = np.full(mask.shape, -0.3) if diff is None else diff
    rows = [(g, r, c, bool(mask[r, c]), float(diff[r, c]) if valid is None or valid[r, c] else None, True if valid is None else bool(valid[r, c])) for r in range(mask.shape[0]) for c in range(mask.shape[1])]
    return spark.createDataFrame(rows, "g int, r long, c long, changed boolean, ndvi_diff float, valid boolean")


def closed_by_hand(mask, size):
    half, (h, w) = size // 2, mask.shape
    big = np.pad(mask, half)
    dilated = np.array([[big[r : r + size, c : c + size].any() for c in range(w)] for r in range(h)])
    big = np.pad(dilated, half)
    return np.array([[big[r : r + size, c : c + size].all() for c in range(w)] for r in range(h)])


@pytest.mark.parametrize(("shape", "size"), [((40, 37), 25), ((20, 20), 25), ((30, 18), 5), ((9, 9), 3)])
def test_closing_is_brute_force(spark, shape, size):
    mask = np.random.default_rng(size).random(shape) < 0.05
    got = regions.closing(frame(spark, mask), ["g"], "changed", size).where("changed").select("r", "c").collect()
    assert {(r["r"], r["c"]) for r in got} == set(map(tuple, np.argwhere(closed_by_hand(mask, size)).tolist()))


def test_closing_merges_a_gap_and_fills_a_hole(spark):
    mask = np.zeros((60, 80), bool)
    mask[20:40, 15:30] = mask[20:40, 40:60] = True
    mask[25:35, 18:28] = False
    labels = regions.components(regions.closing(frame(spark, mask), ["g"], "changed"), ["g"], "changed")
    assert labels.select("label").distinct().count() == 1


def flood(mask):
    out, label = np.full(mask.shape, -1, np.int64), {}
    for r, c in np.argwhere(mask):
        if out[r, c] < 0:
            stack, name = [(r, c)], r * (1 << 32) + c
            while stack:
                y, x = stack.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and out[y, x] < 0:
                    out[y, x] = name
                    stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    del label
    return out


@pytest.mark.parametrize("density", [0.0, 0.4, 0.6, 1.0])
def test_components_are_brute_force(spark, density):
    mask = np.random.default_rng(7).random((24, 31)) < density
    want = {(r, c): v for (r, c), v in np.ndenumerate(flood(mask)) if v >= 0}
    df = frame(spark, mask)
    assert {(r["r"], r["c"]): r["label"] for r in regions.components(df, ["g"], "changed").collect()} == want


def test_components_by_runs_agree(spark):
    mask = np.random.default_rng(3).random((15, 20)) < 0.55
    df = frame(spark, mask)
    a = {(r["r"], r["c"]): r["label"] for r in regions.components(df, ["g"], "changed").collect()}
    assert {(r["r"], r["c"]): r["label"] for r in regions.components_by_runs(df, ["g"], "changed").collect()} == a


def found(spark, mask, **kw):
    df = frame(spark, mask, **kw)
    return regions.findings(regions.components(df, ["g"], "changed"), df, ["g"])


def test_a_block_is_one_hectare(spark):
    mask = np.zeros((30, 30), bool)
    mask[5:15, 5:15] = True
    (r,) = found(spark, mask).collect()
    assert (r["valid_pixels"], r["area_ha"]) == (100, 1.0) and r["score"] == pytest.approx(0.6)


def test_small_blobs_go_and_masked_pixels_count(spark):
    mask, valid = np.zeros((30, 30), bool), np.ones((30, 30), bool)
    mask[1:8, 1:8] = True  # 49
    mask[12:20, 12:20] = True
    valid[12:16, 12:20] = False
    (r,) = found(spark, mask, valid=valid).collect()
    assert r["valid_pixels"] == 64 and r["ndvi_delta_mean"] == pytest.approx(-0.3)


def test_carried_columns_and_outlines_agree_with_joins(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, rng.random((25, 25)) < 0.6, valid=rng.random((25, 25)) < 0.8)
    labelled = regions.components(df, ["g"], "changed", ("ndvi_diff",))
    a, b = regions.findings(labelled, None, ["g"], 1), regions.findings(labelled.drop("ndvi_diff"), df, ["g"], 1)
    rows = lambda x: sorted((r["label"], r["valid_pixels"], round(r["score"], 9)) for r in x.collect())
    assert rows(a) == rows(b) and len(rows(a)) > 3
    rings = {r["label"]: r["ring"] for r in regions.hulls(labelled, ["g"]).collect()}
    assert all(rings[r["label"]] == r["ring"] for r in regions.outlined(a).collect())


def test_assessed_says_what_its_parts_say(spark):
    df = frame(spark, np.random.default_rng(2).random((20, 20)) < 0.3)
    (one,) = regions.assessed(df, ["g"]).collect()
    (x,), (y,) = pixels.pair_summary(df, ["g"]).collect(), regions.seasonal(df, ["g"]).collect()
    assert one.asDict() == x.asDict() | y.asDict() | {"any_changed": True}


def test_top_twenty(spark):
    df = spark.createDataFrame([(1, k, (k + 1) / 100) for k in range(25)], "g int, label long, score double")
    got = regions.top(df, ["g"]).orderBy("finding_id").collect()
    assert len(got) == 20 and got[0]["score"] == 0.25 and got[0]["finding_id"] == 1


def test_hulls(spark):
    assert regions.hull(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2]])) == [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    assert regions.hull(np.array([[1, 2], [3, 2], [5, 2]])) == [[1.0, 2.0], [5.0, 2.0], [5.0, 2.0], [1.0, 2.0], [1.0, 2.0]]
    assert regions.hull(np.array([[7, 7]]))[0] == [7.0, 7.0]
    mask = np.random.default_rng(1).random((12, 12)) < 0.7
    for r in regions.hulls(regions.components(frame(spark, mask), ["g"], "changed"), ["g"]).collect():
        p = np.array(r["ring"])
        step = p[1:] - p[:-1]
        after = np.roll(step, -1, axis=0)
        turn = step[:, 0] * after[:, 1] - step[:, 1] * after[:, 0] if len(p) > 5 else np.ones(1)
        assert (turn >= 0).all()


@pytest.mark.parametrize(
    ("values", "share", "want"),
    [
        ([-0.2], 1.0, (0.0, 1.0, True, True)),
        ([-0.5, -0.05], 1.0, (None, 1.0, False, False)),
        ([-0.2], 0.04, (0.0, 0.04, True, False)),
        ([1e-8], 1.0, (0.0, 1.0, True, True)),
        ([-0.2], 0.0196, (None, None, None, None)),
    ],
)
def test_seasonal(spark, values, share, want):
    mask = np.zeros(2500, bool)
    mask[: int(round(2500 * share))] = True
    diff = np.array([values[k * len(values) // 2500] for k in range(2500)])
    (r,) = regions.seasonal(frame(spark, mask.reshape(50, 50), diff.reshape(50, 50)), ["g"]).collect()
    cv, coverage, uniform, abstain = want
    if cv is not None:
        assert r["cv"] == pytest.approx(cv, abs=1e-6)
    assert (r["coverage"], r["is_uniform"], r["should_abstain"]) == (pytest.approx(coverage) if coverage else None, uniform, abstain)


def test_composite_and_stretch(spark):
    rows = [(1, 0, 0, s, 1000 * (s + 1), s != 2, s + 1) for s in range(4)] + [(1, 0, 1, 0, 5, False, 1)]
    df = spark.createDataFrame(rows, "g int, r long, c long, s int, b int, valid boolean, rank int")
    got = {r["c"]: (r["b"], r["valid"]) for r in pixels.median_composite(df, ["g"], ["b"], rank="rank").collect()}
    assert got == {0: (1500.0, True), 1: (None, False)}
    flat = spark.createDataFrame([(1, 0, c, 0) for c in range(5)], "g int, r long, c long, b int")
    assert {r["b_8bit"] for r in pixels.percent_clip(flat, ["g"], "b").collect()} == {0}
    ramp = spark.createDataFrame([(1, 0, c, c) for c in range(101)], "g int, r long, c long, b int")
    got = {r["c"]: r["b_8bit"] for r in pixels.percent_clip(ramp, ["g"], "b").collect()}
    assert (got[0], got[2], got[50], got[98], got[100]) == (0, 0, 127, 255, 255)


def test_pair_guards(spark):
    small = frame(spark, np.zeros((9, 30), bool))
    (r,) = pixels.pair_summary(small, ["g"]).collect()
    assert (r["usable"], r["valid_fraction"]) == (False, 0.0)
    valid = np.zeros((10, 10), bool)
    valid[:3] = True
    (r,) = pixels.pair_summary(frame(spark, valid, valid=valid), ["g"]).collect()
    assert r["usable"] and r["valid_fraction"] == pytest.approx(0.3)


def test_one_exchange_before_the_labels(spark):
    df = regions.closing(frame(spark, np.zeros((30, 30), bool)), ["g"], "changed")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_closing_of_a_grid_that_lacks_pixels(spark):
    """Pixels absent between set ones count by their place, as unset ones."""
    mask = np.zeros((9, 9), bool)
    mask[3:6, 2] = mask[3:6, 4] = True
    full = frame(spark, mask)
    sparse = full.where("NOT (r IN (3, 4) AND c = 3) AND NOT (r = 8 AND c > 5)")
    want = {(r["r"], r["c"]) for r in regions.closing(full, ["g"], "changed", 3).where("changed").collect()}
    got = {(r["r"], r["c"]) for r in regions.closing(sparse, ["g"], "changed", 3, dense=False).where("changed").collect()}
    assert got == want and {(3, 2), (4, 3), (5, 4)} <= got


def test_runs_of_a_long_snake_have_one_label(spark):
    """Vertical legs of 90 rows, joined by turns at their ends: far more rounds than any fixed number of them would allow."""
    mask = np.zeros((90, 7), bool)
    mask[:, ::2] = True
    for k, c in enumerate(range(1, 7, 2)):
        mask[89 if k % 2 == 0 else 0, c] = True
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    labels = {r["label"] for r in regions.components_by_runs(frame(spark, mask), ["g"], "changed").select("label").distinct().collect()}
    assert len(labels) == 1


@pytest.mark.parametrize(("shape", "size", "block"), [((40, 37), 25, 16), ((70, 55), 25, 32), ((30, 18), 5, 7), ((9, 9), 3, 512)])
def test_closing_by_blocks_is_the_same(spark, shape, size, block):
    mask = np.random.default_rng(size).random(shape) < 0.08
    got = regions.closing_by_blocks(frame(spark, mask), ["g"], "changed", size, block)
    assert got.count() == mask.size and got.columns == frame(spark, mask).columns
    assert {(r["r"], r["c"]) for r in got.where("changed").collect()} == set(map(tuple, np.argwhere(closed_by_hand(mask, size)).tolist()))


def test_closing_by_blocks_of_sparse_grids_off_the_origin(spark):
    mask = np.random.default_rng(8).random((26, 31)) < 0.2
    full = frame(spark, mask).withColumns({"r": F.col("r") - 9, "c": F.col("c") + 1000})
    sparse = full.where("changed OR (r + c) % 3 = 0 OR r IN (-9, 16) OR c IN (1000, 1030)").withColumn("changed", F.when(F.col("changed"), True))
    ends = lambda df: {(r["r"], r["c"]) for r in df.where("changed").collect()}
    want = ends(regions.closing(sparse, ["g"], "changed", 5, dense=False))
    assert ends(regions.closing_by_blocks(sparse, ["g"], "changed", 5, 8, dense=False)) == want and want


@pytest.mark.parametrize(("density", "block"), [(0.0, 8), (0.45, 8), (0.6, 5), (1.0, 7), (0.6, 512)])
def test_components_by_blocks_are_the_same(spark, density, block):
    mask = np.random.default_rng(7).random((24, 31)) < density
    want = {(r, c): v for (r, c), v in np.ndenumerate(flood(mask)) if v >= 0}
    got = regions.components_by_blocks(frame(spark, mask), ["g"], "changed", ("ndvi_diff",), block)
    assert {(r["r"], r["c"]): r["label"] for r in got.collect()} == want and got.columns == ["g", "r", "c", "ndvi_diff", "label"]


def test_a_snake_through_many_blocks_has_one_label(spark):
    mask = np.zeros((60, 7), bool)
    mask[:, ::2] = True
    for k, c in enumerate(range(1, 7, 2)):
        mask[59 if k % 2 == 0 else 0, c] = True
    assert regions.components_by_blocks(frame(spark, mask), ["g"], "changed", block=4).select("label").distinct().count() == 1


def test_no_task_gets_more_than_a_block(spark):
    """One grid over many blocks: the exchange before the Python step goes by grid and block."""
    plan = regions.closing_by_blocks(frame(spark, np.zeros((40, 40), bool)), ["g"], "changed", 25, 8)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and "_i" in plan and "_j" in plan and "Window" not in plan


def test_abstained_grids_have_no_findings_and_border_changes_no_abstention(spark):
    everywhere, border, none = np.zeros((50, 50), bool), np.zeros((50, 50), bool), np.zeros((50, 50), bool)
    everywhere[5:45, 5:45] = True
    border[:3] = True
    valid = np.zeros((50, 50), bool)
    valid[10:40, 10:40] = True
    df = frame(spark, everywhere, valid=valid, g=1).union(frame(spark, border, g=2)).union(frame(spark, none, g=3)).withColumn("raw", F.col("changed"))
    px = regions.closing_by_blocks(df, ["g"], "changed")
    found = regions.findings(regions.components_by_blocks(px, ["g"], "changed", ("ndvi_diff",)), None, ["g"])
    told = {r["g"]: (r["status"], r["reason"], r["n_findings"]) for r in regions.outcomes(regions.assessed(px, ["g"], raw="raw"), found, ["g"]).collect()}
    assert told == {1: ("abstained", "seasonal pattern", 0), 2: ("review_recommended", None, 0), 3: ("abstained", "no significant change detected", 0)}
    assert found.where("g = 1").count() == 1 and regions.granted(found, regions.verdicts(regions.assessed(px, ["g"], raw="raw")), ["g"]).count() == 0
