"""Images that fail in their task, restarts, replays and overwriting: one row an image throughout."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorecover import blocks
from shorecover.models import Factory
from shorecover.operators import segment
from shorecover.plans import jobs
from shorecover.sources import rasters, tables
from shorecover.sources.store import ResultStore
from shorecover.streaming.watch import _one_a_name, watch

SCHEMA = "image_name string, v int"


def pictures(n=3):
    """n rasters of noise; the pixel in the corner tells them apart."""
    rng = np.random.default_rng(1)
    out = {}
    for k in range(n):
        a = rng.integers(60, 140, (16, 20, 3)).astype(np.uint8)
        a[0, 0] = k
        out[f"drone_2022_Cove_DSC0000{k}.png"] = a
    return out


def raising(corner):
    """A model that fails on the raster with this corner."""

    def model(rgb, points):
        if (rgb[:, 0, 0] == corner).all(-1).any():
            raise RuntimeError(f"no mask for {corner}")
        return rgb[..., 0] > 100

    return model


PLAIN = dict(size=20, hierarchical=False, uniformity=False, threshold_max=1000.0, num_points=1)


@pytest.fixture
def survey_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, rgb in pictures().items():
        (folder / name).write_bytes(rasters.png(rgb))
    colors = spark.createDataFrame([("drone_2022", 120, 114, 117)], "location string, L int, A int, B int")
    known = spark.createDataFrame([(n, k, 36.9, -122.0) for k, n in enumerate(pictures())], "image_name string, image_id long, latitude double, longitude double")
    return str(folder), colors, known


def test_analyze_goes_on_without_the_image_that_fails(spark, survey_files):
    folder, colors, known = survey_files
    read = rasters.read_rasters(spark, folder)
    names = sorted(pictures())
    for _ in range(2):
        results, errors = jobs.analyze(read, colors, known, model_fn=raising(1), **PLAIN)
        assert sorted(r.image_name for r in results.collect()) == [names[0], names[2]]
        assert [tuple(r) for r in errors.collect()] == [(names[1], "RuntimeError: no mask for 1")]
    # a restart that knows the results tries the failed image alone
    again, errors = jobs.analyze(read, colors, known, results, model_fn=raising(7), **PLAIN)
    assert sorted(r.image_name for r in again.collect()) == names and not errors.count()
    with pytest.raises(Exception, match="no mask for 1"):
        blocks.coverage(read.withColumns({"water_l": F.lit(47.0), "water_a": F.lit(-14.0), "water_b": F.lit(-10.0)}), model_fn=raising(1), **PLAIN).collect()


def test_broken_data_is_an_error_row(spark, survey_files):
    read = rasters.read_rasters(spark, survey_files[0]).withColumn("location", F.lit("drone_2022"))
    broken = read.withColumn("data", F.when(F.col("image").contains("00001"), F.substring("data", 1, 7)).otherwise(F.col("data")).cast("binary"))
    ok, errors = tables.split_errors(blocks.sample_colors(broken, 10, errors=True))
    assert ok.groupBy("image").count().count() == 2 and ok.count() == 20 and errors.count() == 1
    assert "ValueError" in blocks.sample_colors(broken, 10, errors=True).where("error is not null").first().error


def test_stream_of_image_files(spark, survey_files, tmp_path):
    """analyze as the processor: an image that fails, a restart with a sound model, documents of the first run."""
    folder, colors, known = survey_files
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    rows = lambda: {r.image_name: (r.coverage_percentage is not None, r.error, r.image_id) for r in ResultStore(spark, store).read().collect()}
    names = sorted(pictures())
    for _ in range(2):
        jobs.analyze_stream(spark, folder, store, state, colors, known, batch=2, model_fn=raising(1), **PLAIN).awaitTermination(300)
        assert rows() == {names[0]: (True, None, 0), names[1]: (False, "RuntimeError: no mask for 1", None), names[2]: (True, None, 2)}
    first = jobs.publish(spark, store, "analyze", {"n": "1"}, str(tmp_path / "one"))
    assert tables.read_results(spark, first, False).count() == 2
    jobs.analyze_stream(spark, folder, store, state, colors, known, batch=2, model_fn=raising(7), **PLAIN).awaitTermination(300)
    assert rows() == {n: (True, None, k) for k, n in enumerate(names)}
    second = jobs.publish(spark, store, "other", {"n": "2"}, str(tmp_path / "two"))
    assert tables.read_results(spark, second, False).count() == 3
    assert {(r.command, r.run_args["n"]) for r in spark.read.schema("command string, run_args map<string, string>").json(second).collect()} == {("analyze", "1")}


def add(spark, source, rows, n=1):
    spark.createDataFrame(rows, SCHEMA).coalesce(n).write.mode("append").parquet(source)


def judged(df):
    return df.withColumn("error", F.when(F.col("v") < 0, F.lit("bad")))


def test_rows_of_one_name_in_a_file(spark):
    """The least row counts, in any order of the rows; a map column does not matter."""
    rows = [("a", 3, "x", {"k": 1}), ("a", 2, "z", {"k": 2}), ("a", 2, "y", {"k": 3}), ("b", None, "w", None), ("b", 1, "v", {})]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "image_name string, u int, v string, m map<string, int>").coalesce(1)
        assert sorted(tuple(r) for r in _one_a_name(df).collect()) == [rows[2], rows[3]]
        assert sorted(tuple(r) for r in _one_a_name(df.select("v", "image_name", "u").where("u is not null")).collect()) == [("v", "b", 1), ("x", "a", 3)]
    assert _one_a_name(df.select("image_name")).count() == 2


def test_retry_replay_and_overwrite(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in [1]", "store", "state"))
    store = ResultStore(spark, out)
    assert store.read() is None
    rows = lambda: sorted((r.image_name, r.v, r.error) for r in store.read().collect())
    go = lambda process=judged, **how: watch(spark, source.replace("[", "\\[").replace("]", "\\]"), SCHEMA, out, state, process, **how).awaitTermination(300)
    add(spark, source, [("a", 1), ("b", -1)])
    go()
    assert rows() == [("a", 1, None), ("b", -1, "bad")]
    # the failed image is tried again at the start, with no new file, and stays an error while it fails
    go()
    assert rows() == [("a", 1, None), ("b", -1, "bad")]
    go(lambda df: judged(df.withColumn("v", F.abs("v"))))
    assert rows() == [("a", 1, None), ("b", 1, None)]
    # a name with a result is skipped, or overwritten by the newest file
    add(spark, source, [("a", 5), ("c", 3), ("d", -4)])
    go()
    assert rows() == [("a", 1, None), ("b", 1, None), ("c", 3, None), ("d", -4, "bad")]
    add(spark, source, [("a", 7), ("d", 4)])
    go(overwrite=True)
    assert rows() == [("a", 7, None), ("b", 1, None), ("c", 3, None), ("d", 4, None)]
    before = store.commits()
    store.compact()
    assert len(before) > 1 and len(store.commits()) == 1 and rows() == [("a", 7, None), ("b", 1, None), ("c", 3, None), ("d", 4, None)]
    go(overwrite=True)
    add(spark, source, [("e", 1)])
    go()
    assert rows()[-1] == ("e", 1, None) and len(rows()) == 5


def test_a_batch_that_runs_again_is_saved_once(spark, tmp_path):
    """The driver dies after the batch is saved and before the stream notes it; or before its record is there."""
    source, out, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    add(spark, source, [("a", 1), ("b", 2)])
    watch(spark, source, SCHEMA, out, state, judged).awaitTermination(300)
    for name in ("0", ".0.crc"):
        os.remove(f"{state}/commits/{name}")
    ran = []
    watch(spark, source, SCHEMA, out, state, lambda df: ran.append(1) or judged(df)).awaitTermination(300)
    assert not ran and ResultStore(spark, out).read().count() == 2 and len(ResultStore(spark, out).commits()) == 1
    # rows without a record are never read
    add(spark, source, [("c", 3)])

    def dies(df):
        raise OSError("the driver dies")

    with pytest.raises(Exception, match="the driver dies"):
        watch(spark, source, SCHEMA, out, state, dies).awaitTermination(300)
    spark.createDataFrame([("c", 9, None)], f"{SCHEMA}, error string").write.parquet(f"{out}/rows/left-by-a-crash")
    assert ResultStore(spark, out).read().count() == 2
    watch(spark, source, SCHEMA, out, state, judged).awaitTermination(300)
    assert {(r.image_name, r.v) for r in ResultStore(spark, out).read().collect()} == {("a", 1), ("b", 2), ("c", 3)}
    # another checkpoint has batch numbers of its own
    add(spark, source, [("d", 4)])
    watch(spark, source, SCHEMA, out, state + "2", judged).awaitTermination(300)
    assert ResultStore(spark, out).read().count() == 4


def slices(spark, shapes, copies=1):
    rng = np.random.default_rng(3)
    rows = [(f"i{k}", h, w, bytearray(rng.integers(0, 256, h * w * 3, np.uint8).tobytes()), [1, 2] if k % 2 else None) for k, (h, w) in enumerate(shapes * copies)]
    return rows, spark.createDataFrame(rows, "image string, height int, width int, data binary, points array<int>")


def test_the_model_is_loaded_once_a_worker(spark, tmp_path):
    """Many tasks and slices, few workers: as many loads as workers at most. Masks are those of the model on each slice; batches go across images."""
    log = str(tmp_path / "loads")
    sizes = str(tmp_path / "sizes")

    def make():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(rgb, points):
            with open(sizes, "a") as f:
                f.write(f"{len(rgb)}\n")
            return (rgb[..., 2] > 99) & np.array([len(p) > 0 for p in points])[:, None, None]

        return model

    rows, df = slices(spark, [(8, 6), (5, 9), (8, 6)], 40)
    df = df.repartition(24)
    served = Factory(make)
    for _ in range(2):
        found = segment.predict_masks(df, served, 4).collect()
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) and 1 <= len(pids) <= spark.sparkContext.defaultParallelism
    assert {int(n) for n in open(sizes).read().split()} >= {4} and max(map(int, open(sizes).read().split())) == 4
    by = {r.image: r for r in found}
    for i, h, w, data, p in rows:
        want = (np.frombuffer(bytes(data), np.uint8).reshape(h, w, 3)[..., 0] > 99) & (p is not None)
        assert (segment.unpack_mask(by[i].mask, h, w) == want).all() and by[i].n_water == want.sum() and by[i].error is None


def test_a_slice_that_fails_leaves_its_batch_alone(spark):
    rows, df = slices(spark, [(4, 4)], 9)
    bad = bytes(rows[3][3])

    def model(rgb, points):
        if any(r[..., ::-1].tobytes() == bad for r in rgb):
            raise RuntimeError("bad slice")
        return rgb[..., 0] > 50

    df = df.coalesce(1).withColumn("data", F.when(F.col("image") == "i5", F.substring("data", 1, 5)).otherwise(F.col("data")).cast("binary"))
    found = {r.image: r for r in segment.predict_masks(df, model, 4).collect()}
    assert len(found) == 9 and {i for i, r in found.items() if r.error} == {"i3", "i5"} and found["i3"].error == "RuntimeError: bad slice"
    assert all((r.mask is None) == (r.error is not None) for r in found.values())
    wrong = segment.predict_masks(df, lambda rgb, points: rgb, 4)
    assert wrong.where("error is null").count() == 0 and segment.predict_masks(df.limit(0), model).count() == 0


def test_block_coverage_by_a_factory(spark, survey_files, tmp_path):
    """The whole job with a model that each worker loads once gives what the model itself gives."""
    read = rasters.read_rasters(spark, survey_files[0]).withColumns({"water_l": F.lit(47.0), "water_a": F.lit(-14.0), "water_b": F.lit(-10.0)}).repartition(8)
    log, sound = str(tmp_path / "loads"), raising(99)

    def make():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return sound

    share = lambda model: sorted(tuple(r) for r in blocks.coverage(read, model_fn=model, **PLAIN).collect())
    served = Factory(make)
    assert share(sound) == share(served) == share(served)
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))
