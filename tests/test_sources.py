"""Image folders, files and bundles in a temporary directory."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import pytest

from tilewright.operators.cleaning import clean_features
from tilewright.operators.boosting import LEAVES, LEVELS
from tilewright.operators.modelling import StackSettings, fit_stack
from tilewright.operators.scoring import predict
from tilewright.plans.end_to_end import run_all, run_csv
from tilewright.plans.score import score_csv
from tilewright.sources.images import first_tiff, read_rasters
from tilewright.sources.tables import load_bundle, read_feature_csv, save_bundle, write_feature_csv


def tiff_bytes(width, height, pixels):
    """Uncompressed 8-bit RGB TIFF with one strip."""
    data = bytes(v for p in pixels for v in p)
    entries = [
        (256, 4, 1, width), (257, 4, 1, height), (258, 3, 3, None), (259, 3, 1, 1), (262, 3, 1, 2),
        (273, 4, 1, None), (277, 3, 1, 3), (278, 4, 1, height), (279, 4, 1, len(data)),
    ]
    after = 8 + 2 + 12 * len(entries) + 4
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries))
    for tag, kind, count, value in entries:
        if tag == 258:
            value = after
        if tag == 273:
            value = after + 6
        out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 and count == 1 else struct.pack("<I", value))
    return out + struct.pack("<I", 0) + struct.pack("<HHH", 8, 8, 8) + data


def crop(seed, width=10, height=8):
    return [((seed * 7 + i * 13) % 256, (i * i + seed * 31) % 256, (i * 5) % 256) for i in range(width * height)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("crops") / "Good Crops + more"
    for label in ("30", "45 days"):
        (root / label).mkdir(parents=True)
    for i in range(6):
        (root / "30" / f"a{i}.tif").write_bytes(tiff_bytes(10, 8, crop(i)))
        (root / "45 days" / f"b {i}.TIFF").write_bytes(tiff_bytes(10, 8, crop(50 + i)))
    (root / "30" / "broken.tif").write_bytes(b"II*\0")
    (root / "30" / "note.png").write_bytes(b"not read")
    (root / "30" / "deep").mkdir()
    (root / "30" / "deep" / "0.tif").write_bytes(tiff_bytes(10, 8, crop(9)))
    return root


def test_scan_and_decode(spark, folder):
    rows = {r.image_id.rsplit("/", 1)[1]: r for r in read_rasters(spark, str(folder)).collect()}
    assert set(rows) == {f"a{i}.tif" for i in range(6)} | {f"b {i}.TIFF" for i in range(6)} | {"broken.tif"}
    assert rows["b 2.TIFF"].label == "45 days" and str(folder) in rows["b 2.TIFF"].image_id
    assert not rows["broken.tif"].ok and rows["broken.tif"].red is None and rows["broken.tif"].h == 0
    a = rows["a3.tif"]
    assert (a.h, a.w, a.ok) == (8, 10, True)
    assert list(zip(a.red, a.green, a.blue)) == crop(3)


def test_first_tiff_at_any_depth(spark, folder, tmp_path):
    assert first_tiff(spark, str(folder)).first().path.endswith("/30/a0.tif")
    (tmp_path / "x.txt").write_text("none")
    assert first_tiff(spark, str(tmp_path)).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, float("inf")), ("b", None, -2.0)], "label STRING, x DOUBLE, y DOUBLE")
    write_feature_csv(df, str(tmp_path / "f"))
    assert sorted(read_feature_csv(spark, str(tmp_path / "f"), df.schema).collect()) == sorted(df.collect())
    assert read_feature_csv(spark, str(tmp_path / "f")).dtypes == df.dtypes
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_feature_csv(spark, str(tmp_path / "missing"))


def test_bundle_round_trip_gives_equal_predictions(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "CAST(id % 3 AS STRING) AS label", "id % 3 + rand(1) AS x", "CASE WHEN id % 9 > 0 THEN rand(2) END AS y", "rand(3) AS z")
    df = spark.createDataFrame(df.collect(), df.schema)
    cleaned, saved = clean_features(df, "label", ["id"])
    settings = StackSettings(n_estimators=2, depth=2, folds=2, final_iterations=10)
    model = fit_stack(cleaned, saved.feature_columns, "id", "label", settings)
    save_bundle(spark, str(tmp_path / "bundle"), saved, model)
    saved2, model2 = load_bundle(spark, str(tmp_path / "bundle"))
    one, two = (predict(df, s, m).orderBy("id").collect() for s, m in ((saved, model), (saved2, model2)))
    assert one == two and set(one[0].asDict()) == {"id", "label", "x", "y", "z", "prediction"}
    assert sum(r.label == r.prediction for r in one) > 40
    assert {r.learner for r in model2.importances().collect()} == {"levels", "leaves", "symmetric"}


@pytest.mark.parametrize("scope", ["all", "holdout"])
def test_whole_run(spark, folder, tmp_path, scope):
    settings = StackSettings(n_estimators=2, depth=2, folds=2, final_iterations=5, learners=(LEVELS, LEAVES))
    out = run_all(spark, str(folder), str(tmp_path), settings, scope=scope, top_features=3)
    assert out["features"].count() == 13
    assert out["predictions"].count() == (13 if scope == "all" else 3)
    text = spark.read.text(str(tmp_path / "reports" / "classification_report")).first().value
    assert {"accuracy", "macro avg", "_training_metrics"} <= set(json.loads(text))
    assert out["importances"].count() == 132
    assert out["trends"].count() == 3 and out["violins"].count() == 6
    assert spark.read.option("header", True).csv(str(tmp_path / "reports" / "feature_trends")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "reports" / "feature_violins")).count() == 6
    assert (tmp_path / "models" / "parameters").exists()


def test_run_and_scoring_from_a_feature_file(spark, sf, tmp_path):
    cells = ", ".join(f"CAST(embedding[{i}] + 5 * (label % 2) AS DOUBLE) AS a{i}" for i in range(4))
    table = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS image_id", *cells.split(", "), "label % 2 AS label")
    write_feature_csv(table, str(tmp_path / "csv"))
    settings = StackSettings(n_estimators=2, depth=2, folds=2, final_iterations=5, learners=(LEVELS, LEAVES))
    out = run_csv(spark, str(tmp_path / "csv"), str(tmp_path / "run"), settings, top_features=2)
    assert out["predictions"].filter("truth <> prediction").count() == 0
    again = score_csv(spark, str(tmp_path / "csv"), str(tmp_path / "run" / "models"), str(tmp_path / "scored"))
    assert again["predictions"].filter("label = prediction").count() == table.count()
    assert json.loads(spark.read.text(str(tmp_path / "scored" / "classification_report")).first().value)["accuracy"] == 1.0
    write_feature_csv(table.drop("a1"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="a1"):
        score_csv(spark, str(tmp_path / "short"), str(tmp_path / "run" / "models"), str(tmp_path / "none"))


def test_unknown_scope(spark, tmp_path):
    with pytest.raises(ValueError):
        run_all(spark, "nowhere", str(tmp_path), scope="some")


def test_stopped_run_goes_on(spark, sf, tmp_path, monkeypatch):
    from tilewright.plans import end_to_end
    from tilewright.session import shared_dir

    cells = ", ".join(f"CAST(embedding[{i}] + 5 * (label % 2) AS DOUBLE) AS a{i}" for i in range(4))
    table = spark.read.parquet(f"{sf}/embeddings.parquet").limit(80).selectExpr("vec_id AS image_id", *cells.split(", "), "label % 2 AS label")
    table = spark.createDataFrame(table.collect(), table.schema)
    settings = StackSettings(n_estimators=2, depth=2, folds=2, final_iterations=5, learners=(LEVELS, LEAVES))
    before = {p for p in Path(shared_dir(spark)).rglob("*") if p.is_dir()}
    calls = []

    def once(name, fails):
        real = getattr(end_to_end, name)

        def run(*args, **kwargs):
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError("stopped")
            return real(*args, **kwargs)

        monkeypatch.setattr(end_to_end, name, run)

    for name, fails in (("clean_features", False), ("train_stacking", True), ("violin_summary", True)):
        once(name, fails)
    run = lambda df=table: end_to_end.run_features(df, str(tmp_path / "out"), settings, top_features=2)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="stopped"):
            run()
    out = run()
    assert calls == ["clean_features", "train_stacking", "train_stacking", "violin_summary", "violin_summary"]
    first = sorted(map(tuple, out["predictions"].collect()))
    assert sorted(map(tuple, run()["predictions"].collect())) == first and len(first) == 80 and len(calls) == 5
    # Another input starts anew.
    assert run(table.filter("image_id > 5"))["predictions"].count() == 80 - table.filter("image_id <= 5").count() and len(calls) == 8
    assert {p for p in Path(shared_dir(spark)).rglob("*.parquet") if not any(b in p.parents for b in before)} == set()


def test_folders_are_listed_once_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    from tilewright.sources import images

    for label, names in (("1", [f"{i}.tif" for i in range(90)]), ("_2", ["x.TIFF"]), ("3", ["no.png"])):
        (tmp_path / "c" / label).mkdir(parents=True)
        for name in names:
            (tmp_path / "c" / label / name).write_bytes(tiff_bytes(2, 2, crop(1, 2, 2)))
    monkeypatch.setattr(images, "TASKS_PER_CORE", 1)
    # Files that cost more to open than a task may take are one task each, unless put together.
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 28))
    try:
        found = images.scan_labelled_images(spark, str(tmp_path / "c"))
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert sorted(r.label for r in found.select("label").collect()) == ["1"] * 90 + ["_2"]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "none" / "1").mkdir(parents=True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.scan_labelled_images(spark, str(tmp_path / "none"))
