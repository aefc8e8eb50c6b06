"""Boosted trees against plain loops, whatever the partitions; scoring from the written tables."""

from __future__ import annotations

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.operators import boosting, modelling, scoring
from tilewright.operators.boosting import LEAVES, LEVELS, SYMMETRIC, boost, node_tables

LEARNERS = (LEVELS, LEAVES, SYMMETRIC)
FEATURES = ["a", "b", "c.d", "e"]


def grid(n, seed=1, classes=3):
    """Rows with few distinct values, missing and infinite ones, and labels that follow them loosely."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[rng.random((n, 4)) < 0.05] = np.nan
    x[rng.random((n, 4)) < 0.02] = np.inf
    x[:, 3] = 2.0
    y = (np.nan_to_num(x[:, 0], posinf=3) + 0.7 * np.nan_to_num(x[:, 1], posinf=3) + rng.normal(size=n) > 0).astype(int) + (np.nan_to_num(x[:, 2], posinf=3) > 0.8)
    return x, y % classes


def frame(spark, x, y, fits):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row], int(t), fits(i)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id BIGINT, a DOUBLE, b DOUBLE, `c.d` DOUBLE, e DOUBLE, target INT, fits ARRAY<STRUCT<fit: INT, train: BOOLEAN>>").repartition(3)


def plain(x, y, all_x, classes, learner, rounds, depth, bins):
    """Splits {(class, tree, level, node): (feature, cut, gain)} and scores by plain loops."""
    cuts = []
    for column in all_x.T:
        v = np.sort(column[~np.isnan(column)])
        cuts.append(np.unique([v[int(np.ceil(len(v) * (k / (bins - 1)))) - 1] for k in range(1, bins - 1)]))
    place = lambda m: np.stack([np.where(np.isnan(m[:, i]), 0, [(c < v).sum() for v in m[:, i]]) for i, c in enumerate(cuts)], axis=1)
    train, every = place(x), place(all_x)
    scores, all_scores, found = np.zeros((len(x), classes)), np.zeros((len(all_x), classes)), {}
    for tree in range(rounds):
        g, h = boosting.gradients(scores, y, classes)
        for k in range(classes):
            node, all_node = np.zeros(len(x), int), np.zeros(len(all_x), int)
            is_open, leaves = {0}, 1
            totals = {0: (g[:, k].sum(), h[:, k].sum())}
            for level in range(depth):
                options = {}
                for at in range(2**level):
                    own = node == at
                    for f, c in enumerate(cuts):
                        for cut in range(max(map(len, cuts))):
                            left = own & (train[:, f] <= cut)
                            gl, hl, gn, hn = (v / boosting.SCALE for v in (g[left, k].sum(), h[left, k].sum(), *totals[at]))
                            gr, hr, gain = gn - gl, hn - hl, 0.0
                            if hl >= learner.least_weight and hr >= learner.least_weight:
                                gain = gl * gl / (hl + learner.ridge) + gr * gr / (hr + learner.ridge) - gn * gn / (hn + learner.ridge)
                            options.setdefault(at, []).append((gain, f, cut, gl, hl))
                if learner.growth == "symmetric":
                    worth = np.array([[o[0] for o in options[at]] for at in sorted(options)]).sum(axis=0)
                    best = {at: options[at][int(worth.argmax())] for at in options} if worth.max() > 0 else {}
                else:
                    best = {at: max(o, key=lambda z: z[0]) for at, o in options.items()}
                    best = {at: o for at, o in best.items() if o[0] > 0}
                best = {at: o for at, o in best.items() if at in is_open}
                if learner.growth == "leaves":
                    spare = int(learner.leaf_share * 2**depth) - leaves
                    best = dict(sorted(best.items(), key=lambda z: (-z[1][0], z[0]))[: max(spare, 0)])
                leaves += len(best)
                children = {}
                for at in range(2**level):
                    g0, h0 = totals[at]
                    children[2 * at], children[2 * at + 1] = (g0, h0), (0.0, 0.0)
                    if at in best:
                        gain, f, cut, gl, hl = best[at]
                        found[k, tree, level, at] = (f, float(cuts[f][cut]), round(gain, 9))
                        children[2 * at] = (gl * boosting.SCALE, hl * boosting.SCALE)
                        children[2 * at + 1] = (g0 - children[2 * at][0], h0 - children[2 * at][1])
                go = lambda bins_, node_: 2 * node_ + np.array([at in best and bins_[i, best[at][1]] > best[at][2] for i, at in enumerate(node_)], int)
                node, all_node = go(train, node), go(every, all_node)
                totals, is_open = children, {2 * at + side for at in best for side in (0, 1)}
            value = {at: -learner.rate * (gg / boosting.SCALE) / (hh / boosting.SCALE + learner.ridge) if hh / boosting.SCALE + learner.ridge > 0 else 0.0 for at, (gg, hh) in totals.items()}
            scores[:, k] += [value[at] for at in node]
            all_scores[:, k] += [value[at] for at in all_node]
    return found, all_scores


@pytest.mark.parametrize("block, refresh, depth, bins", [(65_536, 10, 3, 8), (17, 2, 2, 32)])
def test_trees_against_plain_loops(spark, monkeypatch, block, refresh, depth, bins):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    x, y = grid(130)
    # Fit 0 learns from all, fit 1 leaves out a third, fit 2 only sees two classes.
    fits = lambda i: [(0, True), (1, i % 3 != 0), (2, True)] if y[i] < 2 else [(0, True), (1, i % 3 != 0), (2, False)]
    boosted, scored = boost(frame(spark, x, y, fits), FEATURES, "id", 3, 3, LEARNERS, rounds=5, depth=depth, bins=bins)
    rows = scored.collect()
    for fit, member in enumerate([np.full(len(x), True), np.arange(len(x)) % 3 != 0, y < 2]):
        nodes = node_tables(spark, boosted, fit)[0].collect()
        own = sorted((r for r in rows if r["fit"] == fit), key=lambda r: r["_key"])
        got_scores = np.stack([np.frombuffer(r["scores"]) for r in own])
        assert [r["train"] for r in own] == member.tolist()
        for number, learner in enumerate(LEARNERS):
            found, scores = plain(x[member], y[member], x, 3, learner, 5, depth, bins)
            got = {(r["class"], r["tree"], r["level"], r["node"]): (FEATURES.index(r["feature"]), r["threshold"], round(r["gain"], 9)) for r in nodes if r["learner"] == learner.name}
            assert got == found
            assert np.allclose(got_scores[:, 3 * number : 3 * number + 3], scores, rtol=0, atol=1e-9)


SETTINGS = modelling.StackSettings(n_estimators=6, folds=3, final_iterations=20)


def labelled(spark, n=150):
    x, y = grid(n, seed=4)
    return frame(spark, x, y, lambda i: []).drop("fits").withColumn("label", F.expr("concat('k', target)")).drop("target")


def test_written_tables_score_like_the_model(spark, tmp_path):
    df = labelled(spark)
    model = modelling.fit_stack(df, FEATURES, "id", "label", SETTINGS)
    model.save(spark, str(tmp_path / "model"))
    again = modelling.StackModel.load(spark, str(tmp_path / "model"))
    unseen = df.withColumn("a", F.expr("a * 1.3 + 0.05")).withColumn("prediction_note", F.lit("x"))
    first, second = (sorted(map(tuple, m.predict(unseen).collect())) for m in (model, again))
    assert first == second and len({r[-1] for r in first}) > 1
    each = {r["id"]: [r[f"{x.name}_prediction"] for x in LEARNERS] for r in again.base.predict_each(unseen).collect()}

    # The same from the files alone: a row's leaf is the lowest bit that all passed splits keep.
    con = duckdb.connect()
    values = unseen.select("id", *[F.col(f"`{c}`") for c in FEATURES]).toPandas()
    long = values.melt("id", var_name="feature", value_name="v")
    con.register("long", long)
    for name in ("nodes", "leaves"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/model/{name}/*.parquet')")
    found = con.execute("""
WITH passed AS (SELECT id, learner, class, tree, bit_and(CAST(kept AS UBIGINT)) AS kept
                FROM long JOIN nodes ON long.feature = nodes.feature AND long.v > nodes.threshold GROUP BY ALL),
t AS (SELECT DISTINCT learner, class, tree FROM leaves),
placed AS (SELECT i.id, t.learner, t.class, t.tree, coalesce(kept, 255) AS kept
           FROM (SELECT DISTINCT id FROM long) i CROSS JOIN t
           LEFT JOIN passed p ON p.id = i.id AND p.learner = t.learner AND p.class = t.class AND p.tree = t.tree),
scored AS (SELECT id, p.learner, p.class, sum(value) AS score FROM placed p JOIN leaves l
           ON l.learner = p.learner AND l.class = p.class AND l.tree = p.tree
           AND kept & (1 << l.leaf) > 0 AND kept & ((1 << l.leaf) - 1) = 0 GROUP BY ALL)
SELECT id, learner, arg_max(class, score) FROM scored GROUP BY ALL""").fetchall()
    names = [x.name for x in LEARNERS]
    assert len(found) == 3 * len(each)
    assert all(each[i][names.index(learner)] == f"k{k}" for i, learner, k in found)

    raw = scoring.predict_raw_zero_fill(unseen, again).collect()
    filled = unseen.select("id", *[F.expr(f"CASE WHEN `{c}` < double('infinity') THEN `{c}` ELSE 0D END AS `{c}`") for c in FEATURES])
    assert {r["id"]: r["prediction"] for r in raw} == {r["id"]: r["prediction"] for r in again.predict(filled).collect()}


def test_all_folds_at_once_equal_one_by_one(spark):
    df = labelled(spark, 90)
    training = modelling.train_stacking(df, FEATURES, "id", "label", SETTINGS)
    split = modelling.stratified_split(df, "id", "label")
    train = split.filter("NOT is_test").drop("is_test")
    alone = modelling.fit_stack(train, FEATURES, "id", "label", SETTINGS)
    # Bins come from all rows that are there, so only the splits' shape is compared where rows differ.
    folds = modelling.cross_val_scores(train, FEATURES, "id", "label", SETTINGS).collect()
    assert [r["fold"] for r in folds] == [0, 1, 2] and all(0 <= r["score"] <= 1 for r in folds)
    record = training.metrics.first()
    scores = [r["score"] for r in training.fold_scores.collect()]
    assert record["cv_mean_score"] == pytest.approx(np.mean(scores)) and record["cv_std_score"] == pytest.approx(np.std(scores))
    tested = training.model.predict(split.filter("is_test")).selectExpr("label AS truth", "prediction", "true AS is_test")
    assert record["test_score"] == pytest.approx(modelling.holdout_score(tested).first()["test_score"])
    assert alone.base.leaves.count() == training.model.base.leaves.count()


def test_importances_on_their_own_scales(spark):
    model = modelling.fit_base(labelled(spark), FEATURES, "id", "label", SETTINGS)
    found = {}
    for r in model.importances().collect():
        found.setdefault(r["learner"], {})[r["feature"]] = r["importance"]
    nodes = model.nodes.toPandas()
    assert {k: sorted(v) for k, v in found.items()} == {x.name: sorted(FEATURES) for x in LEARNERS}
    assert sum(found["levels"].values()) == pytest.approx(1) and sum(found["symmetric"].values()) == pytest.approx(100)
    assert found["leaves"] == {f: float(((nodes.learner == "leaves") & (nodes.feature == f)).sum()) for f in FEATURES}
    assert all(v["e"] == 0 for v in found.values())


def test_tables_without_rows_or_labels(spark):
    df = labelled(spark, 10)
    with pytest.raises(ValueError):
        modelling.fit_base(df.limit(0), FEATURES, "id", "label", SETTINGS)
    one = df.withColumn("label", F.lit("only"))
    model = modelling.fit_base(one, FEATURES, "id", "label", SETTINGS)
    assert model.nodes.count() == 0 and {r["levels_prediction"] for r in model.predict_each(one).collect()} == {"only"}


@pytest.mark.parametrize("packed", [0, 1 << 30])
def test_histograms_against_sums(monkeypatch, packed):
    monkeypatch.setattr(boosting, "PACKED_ROWS", packed)
    rng = np.random.default_rng(5)
    bins, target = rng.integers(0, 6, (400, 5)).astype(np.uint8), rng.integers(0, 3, 400)
    weights = boosting._gradients_by_tree(rng.normal(size=(400, 3)), target, 3)
    node = rng.integers(0, 4, (3, 400)).astype(np.uint16)
    node[2] = 0
    pairs = boosting._pairs(bins, 6)
    above, _ = boosting.histograms(bins, pairs, weights, node // 2, 2, 6)
    whole, counts = boosting.histograms(bins, pairs, weights, node, 4, 6)
    rest, _ = boosting.histograms(bins, pairs, weights, node, 4, 6, above)
    for kind, feature, tree, at, cell in np.ndindex(whole.shape):
        assert whole[kind, feature, tree, at, cell] == weights[kind][tree][(node[tree] == at) & (bins[:, feature] == cell)].sum()
    assert (whole == rest).all() and counts.tolist() == [[int((n == at).sum()) for at in range(4)] for n in node]


@pytest.mark.parametrize("width, features, rows", [(256, 3, 700), (31, 6, 2_000)])
def test_pairs_are_two_bytes_a_row_and_cells_are_written_once(width, features, rows):
    rng = np.random.default_rng(6)
    bins = rng.integers(0, width, (rows, features)).astype(np.uint8)
    bins[0] = width - 1
    pairs = boosting._pairs(bins, width)
    # One task keeps them for all rounds; whatever their size, the last pair of bins fits.
    assert pairs.nbytes == 2 * -(-features // 2) * rows
    assert pairs[0, 0] == width * width - 1
    # Trees take turns in the same cells: what one of them leaves there is of no other.
    weights = [rng.integers(-9, 9, (4, rows)).astype(float) for _ in range(2)]
    node = rng.integers(0, 2, (4, rows)).astype(np.uint16)
    node[1], node[2] = 0, 1
    root, _ = boosting.histograms(bins, pairs, weights, node * 0, 1, width)
    children, _ = boosting.histograms(bins, pairs, weights, node, 2, width, root)
    for kind, feature, tree, at in np.ndindex(2, features, 4, 2):
        own = node[tree] == at
        assert (children[kind, feature, tree, at] == np.bincount(bins[own, feature], weights[kind][tree][own], width)).all()
    assert (children.sum(axis=3) == root[:, :, :, 0]).all()


def test_a_fit_of_several_blocks_is_one_job(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    x, y = grid(130)
    whole, _ = boost(frame(spark, x, y, lambda i: [(0, True)]), FEATURES, "id", 3, 1, LEARNERS, rounds=2, depth=2)
    monkeypatch.setattr(boosting, "ALONE_BLOCKS", 0)
    cut, _ = boost(frame(spark, x, y, lambda i: [(0, True)]), FEATURES, "id", 3, 1, LEARNERS, rounds=2, depth=2)
    assert (whole.trees.value == cut.trees.value).all()
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    monkeypatch.setattr(boosting, "_level_job", None)
    again, _ = boost(frame(spark, x, y, lambda i: [(0, True)]), FEATURES, "id", 3, 1, LEARNERS, rounds=2, depth=2)
    assert (whole.trees.value == again.trees.value).all()


def test_each_learner_is_a_task_and_only_asked_rows_are_scored(spark, monkeypatch):
    x, y = grid(130)
    rows = frame(spark, x, y, lambda i: [(f, i % 3 != f) for f in range(3)])
    every, scored = boost(rows, FEATURES, "id", 3, 3, LEARNERS, rounds=3, depth=2)
    together, plain = boosting._alone, []
    monkeypatch.setattr(boosting, "_refreshed", lambda state, *rest, f=boosting._refreshed: plain.append(state.count()) or f(state, *rest))
    again, held = boost(rows, FEATURES, "id", 3, 3, LEARNERS, rounds=3, depth=2, held_out=True)
    assert plain == [130] and scored.count() == 390
    got = lambda df: sorted((r["_key"], r["fit"], bytes(r["scores"])) for r in df.filter("NOT train").collect())
    assert got(held) == got(scored) and held.filter("train").isEmpty()
    # The learners of a fit do not depend on each other.
    cuts, own = every.cuts, np.arange(130) % 3 != 1
    trees = together(boosting.binned(x[own], cuts), y[own], boosting.replace(every, fits=1), 3)
    assert (trees.value[:, 0] == again.trees.value[:, 1]).all() and (trees.feature[:, 0] == again.trees.feature[:, 1]).all()


def test_rows_are_binned_once_whatever_the_number_of_their_fits(spark):
    x, y = grid(130)
    rows = frame(spark, x, y, lambda i: [(f, i % 3 != f) for f in range(3)])
    cuts = boosting.thresholds(rows, FEATURES, 8)
    shape = boosting.Boosting(FEATURES, cuts, 3, 3, LEARNERS, 2, boosting.Trees.empty(1, 3, 9, 2), np.full(3, 130))
    placed = boosting._placed(rows, "id", shape)
    # The plan lists what comes last first.
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow")
    wanted = boosting.binned(x, cuts)
    found = placed.collect()
    assert sorted((r["_key"], r["fit"], r["train"]) for r in found) == [(i, f, i % 3 != f) for i in range(130) for f in range(3)]
    assert all(bytes(r["bins"]) == wanted[r["_key"]].tobytes() and r["target"] == y[r["_key"]] and not any(r["scores"]) for r in found)


def test_few_rows_are_few_tasks_of_the_final_model(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(modelling.LogisticRegression, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    rows = spark.range(40).selectExpr("id % 2 AS targets", "id").repartition(8)
    modelling._fit_final(rows, 5)
    monkeypatch.setattr(modelling, "FINAL_ROWS", 10)
    modelling._fit_final(rows, 5)
    assert seen == [(1, 40), (4, 40)]


def test_folds_of_all_sets_are_cut_in_one_go(spark, monkeypatch):
    df, cut, calls = labelled(spark, 90).select("id", "label"), modelling.stratified_folds, []
    monkeypatch.setattr(modelling, "stratified_folds", lambda *x: calls.append(x) or cut(*x))
    parts = modelling._parts(df, "id", "label", SETTINGS, range(4)).collect()
    # Once for the folds that are left out, once for all that is left.
    assert len(calls) == 2
    folds = lambda rows: {r["id"]: r["fold"] for r in cut(rows, "id", "label", 3, 42).collect()}
    outer, wanted = folds(df), {i: [] for i in range(90)}
    for left_out in range(4):
        gone = [i for i, fold in outer.items() if fold == left_out - 1]
        inner = folds(df.filter(~F.col("id").isin(gone)))
        assert len(inner) == 90 - len(gone)
        for i in wanted:
            wanted[i] += [(4 * left_out + j, j != inner[i]) for j in range(4)] if i in inner else [(4 * left_out + 3, False)]
    assert {r["_key"]: sorted(map(tuple, r["fits"])) for r in parts} == wanted


def test_a_fit_of_many_blocks_is_one_job_and_its_rows_lie_in_several(spark, monkeypatch):
    # Six times 102,560 rows are a fit of ten blocks; one task for each learner takes it.
    assert boosting._is_alone(615_360)
    x, y = grid(130)
    whole, _ = boost(frame(spark, x, y, lambda i: [(0, True)]), FEATURES, "id", 3, 1, LEARNERS, rounds=2, depth=2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 13)
    monkeypatch.setattr(boosting, "_level_job", None)
    dealt, place = [], boosting._placed
    monkeypatch.setattr(boosting, "_placed", lambda *x: dealt.append(place(*x)) or dealt[0])
    cut, _ = boost(frame(spark, x, y, lambda i: [(0, True)]), FEATURES, "id", 3, 1, LEARNERS, rounds=2, depth=2)
    assert all((getattr(whole.trees, name) == getattr(cut.trees, name)).all() for name in boosting._PARTS)
    # What a fit only scores is many tasks' work.
    assert dealt[0].select(F.expr("spark_partition_id()")).distinct().count() > 3


def test_bytes_that_a_task_keeps_for_a_row():
    rng, rows = np.random.default_rng(7), 20_000
    columns, target = rng.integers(0, 31, (64, rows)).astype(np.uint8), rng.integers(0, 10, rows)
    shape = boosting.Boosting([f"f{i}" for i in range(64)], [np.arange(30.0)] * 64, 10, 1, [LEVELS], 3, boosting.Trees.empty(0, 1, 10, 3), np.array([rows]))
    tracemalloc.start()
    boosting._alone(columns.T, target, shape, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Histograms of one tree included, which do not grow with rows.
    assert peak < 530 * rows
    assert boosting._gradients_by_tree(rng.normal(size=(50, 10)), target[:50], 10)[0].nbytes == 4 * 50 * 10


def test_thresholds_of_more_features_than_a_task_merges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 11)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"f.{i}" for i in range(11)] + ["none", "whole"]
    rows = spark.createDataFrame([(*map(float, r), None, i % 7) for i, r in enumerate(x)], ", ".join(f"`{n}` DOUBLE" for n in names[:-1]) + ", whole INT")
    grouped, group = [], type(rows).groupBy
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *c: grouped.append(c) or group(self, *c))
    found = boosting.thresholds(rows, names, 6)
    # Two groups of features meet in tasks of their own.
    assert grouped == [("_at",)]
    for i, cuts in enumerate(found):
        v = np.sort(x[:, i][~np.isnan(x[:, i])]) if i < 11 else np.sort(np.arange(90) % 7) if i == 12 else np.zeros(0)
        assert cuts.tolist() == np.unique([v[int(np.ceil(len(v) * (k / 5))) - 1] for k in range(1, 5)] if len(v) else []).tolist()
    assert [c.tolist() for c in boosting.thresholds(rows.limit(0), names, 6)] == [[]] * 13
    assert boosting.thresholds(rows, [], 6) == []


def test_small_batches_are_scored_together(monkeypatch):
    monkeypatch.setattr(boosting, "SCORED_ROWS", 5)
    batches = [pa.RecordBatch.from_pydict({"x": list(range(3 * i, 3 * i + 3))}) for i in range(5)]
    found = [b.column(0).to_pylist() for b in boosting._gathered(iter(batches))]
    assert found == [list(range(6)), list(range(6, 12)), list(range(12, 15))] and not list(boosting._gathered(iter([])))


def test_scores_of_a_block_of_rows_against_plain_steps(spark):
    # More rows than are looked up at once, in trees with and without splits, with missing and infinite values.
    df = labelled(spark, 700).coalesce(1)
    model = modelling.fit_base(df, FEATURES, "id", "label", modelling.StackSettings(n_estimators=3))
    feature, threshold, value = model._arrays
    found = df.select("id", *[F.col(f"`{c}`") for c in FEATURES], model.scores().alias("s")).collect()
    assert (feature < 0).any() and len(found) == 700
    for r in found:
        x, total = [np.nan if v is None else v for v in r[1:5]], np.zeros(value.shape[1])
        for number, tree in np.ndindex(value.shape[:2]):
            node = 0
            for level in range(3):
                at = 2**level - 1 + node
                split = feature[number, tree, at]
                node = 2 * node + bool(split >= 0 and x[split] > threshold[number, tree, at])
            total[tree] += value[number, tree, node]
        assert r["s"] == boosting.probabilities(total[None], len(model.classes))[0].tolist()


def test_final_models_of_many_rows_are_fitted_two_at_a_time(spark, monkeypatch):
    df, settings = labelled(spark, 90), modelling.StackSettings(n_estimators=1, folds=3, final_iterations=3)
    seen, pool = [], modelling.ThreadPoolExecutor
    monkeypatch.setattr(modelling, "ThreadPoolExecutor", lambda max_workers: seen.append(max_workers) or pool(max_workers))
    few = modelling.cross_val_scores(df, FEATURES, "id", "label", settings).collect()
    # Sixty rows of a fit on four cores.
    monkeypatch.setattr(modelling, "FINAL_ROWS", 14)
    many = modelling.cross_val_scores(df, FEATURES, "id", "label", settings).collect()
    assert seen == [3, 2] and few == many
