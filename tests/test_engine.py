"""Goldens, invariants and edge cases of the compression engine."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tokensieve import cli
from tokensieve.config import CompressionConfig, check_pruning_rate, ratio_from_environment
from tokensieve.operators import attention as A
from tokensieve.operators import budget as B
from tokensieve.operators import cluster as K
from tokensieve.operators import compress as C
from tokensieve.operators import merge as M
from tokensieve.operators import reports as R
from tokensieve.operators import segment as S
from tokensieve.operators import select as P
from tokensieve.functions import vectors as V
from tokensieve.register import register
from tokensieve.sources import requests as Q
from tokensieve.sources.videos import BEHIND, FRAMES, LEAST_VIDEOS, SCENE, TOKENS as PER_FRAME
from tokensieve.streaming.videos import windowed_requests

TOKENS = "video_id long, frame int, token int, vec array<double>, attention double"


def video(spark, x, attention=None, video_id=0):
    f, n, _ = x.shape
    a = np.full((f, n), 1 / n) if attention is None else attention
    return spark.createDataFrame([(video_id, i, j, x[i, j].tolist(), float(a[i, j])) for i in range(f) for j in range(n)], TOKENS)


@pytest.mark.parametrize("bad", [{"retention_ratio": 0}, {"retention_ratio": 1.01}, {"alpha": -0.1}, {"temporal_threshold": 1.1}, {"segment_threshold": -2}, {"min_segments": 0}, {"query_chunk": 0}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        CompressionConfig(**bad)


def test_ratio_from_environment_and_pruning_rate():
    assert ratio_from_environment({}) == 0.1
    assert ratio_from_environment({"TOKENSIEVE_RETENTION_RATIO": "0.5"}) == 0.5
    with pytest.raises(ValueError):
        ratio_from_environment({"TOKENSIEVE_RETENTION_RATIO": "0"})
    check_pruning_rate(0.1, 0.9)
    with pytest.raises(ValueError):
        check_pruning_rate(0.1, 0.8)


def lengths(spark, frames, threshold=0.9, least=4):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(frames)], "video_id long, frame int, vec array<double>")
    return [r["length"] for r in S.segment_lengths(S.segments(df, threshold, least)).orderBy("seg_id").collect()]


def test_segments_respect_the_minimum(spark):
    frames = [[1.0, 0.0], [0.99, 0.01], [0.0, 1.0], [0.01, 0.99]]
    assert lengths(spark, frames, 0.9, 3) == [1, 1, 2]
    assert lengths(spark, frames[:1]) == [1]
    assert lengths(spark, frames, 0.9, 1) == [2, 2]
    assert lengths(spark, [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [1.0, 0.0]], 0.9, 1) == [1, 1, 1, 1]  # zero vectors cut


def test_selection_follows_the_greedy_rule(spark):
    x = np.array([[[1, 0], [0.9, 0.1], [0, 1], [-1, 0]]], float)
    tokens = video(spark, x, np.array([[0.2, 0.1, 0.6, 0.1]]))
    counts = spark.createDataFrame([(0, 0, 2)], "video_id long, frame int, n long")
    got = {r["pick"]: r["token"] for r in P.diverse_tokens(tokens, counts).collect()}
    assert got == {0: 2, 1: 0}
    nearest = P.first_picks(tokens).first()
    assert nearest["token"] == 2 and math.isclose(nearest["nearest"], 533741.0844, abs_tol=1e-3)


def test_greedy_matches_the_full_minimum():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(2, 12))
        cal = rng.random((n, n)).round(1)
        np.fill_diagonal(cal, 0)
        picks = P.greedy(cal, n)
        assert sorted(picks) == list(range(n))
        for k in range(1, n):
            least = cal[picks[:k]].min(0)
            least[picks[:k]] = -1
            assert picks[k] == least.argmax()
    assert P.greedy(np.zeros((1, 1)), 1) == [0] and P.greedy(np.zeros((3, 3)), 0) == []
    assert P.greedy(np.zeros((3, 3)), 3) == [0, 1, 2]  # no attention: in order


def test_too_many_picks_fail(spark):
    counts = spark.createDataFrame([(0, 0, 9)], "video_id long, frame int, n long")
    with pytest.raises(PySparkException):
        P.diverse_tokens(video(spark, np.ones((1, 2, 2))), counts).collect()


def test_merging_identical_frames(spark):
    tokens = video(spark, np.array([[[1, 0], [0, 1]]] * 2, float)).withColumn("seg_id", F.lit(0))
    rows = M.merged_tokens(tokens).orderBy("frame", "token").collect()
    assert [(r["frame"], r["token"], r["members"], r["vec"]) for r in rows] == [(0, 0, 2, [1.0, 0.0]), (0, 1, 2, [0.0, 1.0])]


def test_merged_tokens_are_means_of_whole_trees(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 5))
    x = np.array([base + 0.1 * rng.normal(size=base.shape) for _ in range(6)])
    seg = [0, 0, 0, 1, 1, 1]
    free = rng.random((6, 4)) > 0.2
    tokens = video(spark, x).filter(F.array_contains(F.array(*(F.struct(F.lit(f).alias("frame"), F.lit(t).alias("token")) for f, t in zip(*np.nonzero(free), strict=True))), F.struct("frame", "token")))
    tokens = tokens.withColumn("seg_id", F.element_at(F.array(*map(F.lit, seg)), F.col("frame") + 1))
    u = x / np.linalg.norm(x, axis=2, keepdims=True)
    trees = {}
    for f in range(6):
        for t in np.flatnonzero(free[f]):
            root = (f, int(t))
            if f and seg[f] == seg[f - 1] and free[f - 1].any():
                sims = np.where(free[f - 1], u[f, t] @ u[f - 1].T, -1)
                if sims.max() > 0.8:
                    root = next(r for r, m in trees.items() if (f - 1, int(sims.argmax())) in m)
            trees.setdefault(root, []).append((f, int(t)))
    got = {(r["frame"], r["token"]): r for r in M.merged_tokens(tokens).collect()}
    assert set(got) == set(trees)
    for root, members in trees.items():
        assert got[root]["members"] == len(members)
        assert np.allclose(got[root]["vec"], np.mean([x[m] for m in members], axis=0))


def test_density_peaks():
    got = K.density_peaks(np.array([[0, 0], [0.1, 0], [10, 10], [10.1, 10]], float), 2, 2)
    assert got["centres"].tolist() == [0, 1] and got["cluster"].tolist() == [0, 1, 1, 1]
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.normal(size=(int(rng.integers(2, 20)), 4))
        c = int(rng.integers(1, len(x) + 1))
        got = K.density_peaks(x, c)
        assert got["cluster"][got["centres"]].tolist() == list(range(c))
        assert set(got["cluster"]) == set(range(c))
    masked = K.density_peaks(rng.normal(size=(6, 3)), 3, valid=np.array([True, False, False, False, False, True]))
    assert masked["density"][1] == 0 and masked["cluster"][masked["centres"]].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        K.density_peaks(np.ones((2, 2)), 3)


def allocated(spark, caps, budget):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(caps)], "video_id long, frame int, capacity long")
    return [r["n"] for r in B.allocate(df, budget).orderBy("frame").collect()]


def test_allocation(spark):
    assert allocated(spark, [0, 5, 3, 2], 4) == [0, 2, 1, 1]
    assert allocated(spark, [1, 1, 1], 2) == [1, 1, 0]
    assert allocated(spark, [10, 0, 0], 3) == [3, 0, 0]
    assert allocated(spark, [4, 2], 0) == [0, 0]
    assert allocated(spark, [20] * 8, 28) == [4, 4, 4, 4, 3, 3, 3, 3]
    with pytest.raises(PySparkException):
        allocated(spark, [1, 2], 4)


def test_targets(spark):
    row = spark.range(1).select(B.library_target(F.lit(1000), 0.1).alias("a"), B.service_target(F.lit(10), F.lit(100), 0.1).alias("b"), B.library_target(F.lit(8192), 0.1).alias("c"), B.service_target(F.lit(32), F.lit(256), 0.1).alias("d"), B.service_target(F.lit(2), F.lit(100), 0.1).alias("e")).first()
    assert tuple(row) == (1000 * 0.1, 100, 820, 819, 100)


def test_service_target_rounds_down(spark):
    assert spark.range(1).select(B.service_target(F.lit(1000), F.lit(1), 0.1)).first()[0] == 99


@pytest.mark.parametrize(("ratio", "n"), [(1.0, 160), (0.5, 80), (0.25, 40), (0.1, 16)])
def test_compression_hits_its_target(spark, ratio, n):
    x = np.random.default_rng(7).normal(size=(8, 20, 16))
    rows = C.compress(video(spark, x), CompressionConfig(retention_ratio=ratio)).orderBy("anchor").collect()
    assert len(rows) == n and len({r["anchor"] for r in rows}) == n
    if ratio == 1:
        assert [r["vec"] for r in rows] == [v.tolist() for v in x.reshape(-1, 16)]


@pytest.mark.parametrize(("alpha", "target"), [(0.0, 9), (1.0, 9), (0.5, 1), (0.3, 25), (0.7, 30)])
def test_compression_edges(spark, alpha, target):
    x = np.random.default_rng(8).normal(size=(3, 10, 4))
    x[1, 3] = 0
    x[2, 5] = x[2, 6]
    other = np.random.default_rng(9).normal(size=(1, 30, 4))
    tokens = video(spark, x, np.zeros((3, 10))).union(video(spark, other, video_id=1))
    config = CompressionConfig(alpha=alpha)
    both = C.compress(tokens, config, target)
    assert {r["video_id"]: r["n"] for r in both.groupBy("video_id").agg(F.countDistinct("anchor").alias("n")).collect()} == {0: target, 1: target}
    assert C.asserted(both, C.video_targets(tokens, config, target)).count() == 2
    alone = C.compress(tokens.filter("video_id = 0"), config, target)
    assert sorted(r["anchor"] for r in alone.collect()) == sorted(r["anchor"] for r in both.filter("video_id = 0").collect())


def test_compression_rejects_bad_input(spark):
    tokens = video(spark, np.ones((2, 3, 2)))
    with pytest.raises(PySparkException):
        C.compress(tokens, target_tokens=7).collect()
    with pytest.raises(PySparkException):
        C.compress(tokens.filter("frame = 0 OR token < 2"), target_tokens=2).collect()
    assert C.compress(tokens.limit(0), target_tokens=2).count() == 0


def test_received_attention(spark):
    rng = np.random.default_rng(2)
    q, k = rng.normal(size=(2, 2, 6, 4)), rng.normal(size=(2, 2, 6, 4))
    rows = [(0, f, h, p, q[f, h, p].tolist(), k[f, h, p].tolist()) for f in range(2) for h in range(2) for p in range(6)]
    got = A.received_attention(spark.createDataFrame(rows, "video_id long, frame int, head int, patch int, q array<double>, k array<double>"), query_chunk=4)
    w = np.exp(np.einsum("fhqd,fhkd->fhqk", q, k) / 2)
    want = (w / w.sum(3, keepdims=True)).mean((1, 2))
    assert all(math.isclose(r["attention"], want[r["frame"], r["patch"]]) for r in got.collect())
    pooled = A.pooled_attention(got, 2)
    assert all(math.isclose(r["s"], 0.5) for r in pooled.groupBy("frame").agg(F.sum("attention").alias("s")).collect())


def test_ragged_offsets_check_the_total(spark):
    grid = spark.createDataFrame([(1, 2, 3, 4), (2, 1, 1, 5)], "video_id long, temporal int, height int, width int")
    assert [(r["start"], r["stop"]) for r in A.ragged_offsets(grid, 29).orderBy("video_id").collect()] == [(0, 24), (24, 29)]
    with pytest.raises(PySparkException):
        A.ragged_offsets(grid, 30).collect()


def test_mask_and_alignment(spark):
    tokens = video(spark, np.random.default_rng(1).normal(size=(3, 4, 3)))
    result = C.compress(tokens, target_tokens=5)
    mask = C.retention_mask(tokens, result)
    assert mask.filter("kept").count() == 5 and mask.count() == 12
    assert C.tokens_per_frame(mask).count() == 3
    attention = tokens.select("video_id", "frame", "token", "attention")
    assert A.aligned(tokens.drop("attention"), attention).count() == 12
    with pytest.raises(PySparkException):
        A.aligned(tokens.drop("attention"), attention.filter("token > 0")).select("attention").collect()
    stamps = spark.createDataFrame([(0, 0, 0.5)], "video_id long, frame int, ts double")
    assert C.with_timestamps(result, stamps).count() == 5


def test_event_stream_lines(spark):
    lines = [("a", 0, 3, ": ping"), ("a", 1, 5, 'data: {"x": 1}'), ("a", 2, 6, 'data: {"usage": {"completion_tokens": 4}}'), ("a", 3, 7, 'data: {"usage": {}}'), ("a", 4, 8, "data: [DONE]"), ("b", 0, 1, 'data: {"usage": {"completion_tokens": 0}}'), ("c", 0, 1, "data: [DONE]")]
    got = {r["request"]: (r["first_ts"], r["chunks"], r["output_tokens"]) for r in R.responses(spark.createDataFrame(lines, "request string, seq int, ts int, value string")).collect()}
    assert got == {"a": (5, 3, 4), "b": (1, 1, 1), "c": (None, 0, 0)}


def test_report(spark, tmp_path):
    rows = [(1, i, i != 2, "boom" if i == 2 else None, float(i), None if i == 3 else i / 2, 1, 10) for i in range(5)] + [(2, 0, False, "x", 1.0, None, 0, 0)]
    requests = spark.createDataFrame(rows, "run long, seq long, ok boolean, error string, latency_s double, ttft_s double, chunks long, output_tokens long")
    elapsed = spark.createDataFrame([(1, 2.0), (2, 1.0)], "run long, elapsed_s double")
    one, two = R.request_report(requests, elapsed).orderBy("run").collect()
    assert (one["requests"], one["successful"], one["failed"], one["requests_per_s"], one["output_tokens_per_s"], one["latency_mean_s"], one["latency_p50_s"], one["errors"]) == (5, 4, 1, 2.0, 20.0, 2.0, 2.0, ["boom"])
    assert two["latency_mean_s"] is None and two["ttft_p50_s"] is None and two["output_tokens_per_s"] == 0
    R.report_sink(R.request_report(requests, elapsed).filter("run = 2"), str(tmp_path / "a" / "b.json"))
    assert json.loads((tmp_path / "a" / "b.json").read_text())["latency_p50_s"] is None


def test_best_run(spark):
    reports = spark.createDataFrame([(0, 1, 9.0), (1, 0, 5.0), (2, 0, 5.0), (3, 0, 4.0)], "run_no int, failed long, output_tokens_per_s double")
    assert R.checked_best(reports)["run_no"] == 1
    full = R.summary(R.with_config(reports, R.config_grid(spark))).first()
    assert full["best"]["run_no"] == 1 and [r["run_no"] for r in full["runs"]] == [0, 1, 2, 3] and full["runs"][1]["config"]["dp"] == 1
    with pytest.raises(LookupError):
        R.checked_best(reports.filter("failed > 0"))
    assert R.summary(reports.filter("failed > 0")).first()["best"] is None
    assert R.config_grid(spark).count() == 24


def test_serve_command():
    command, env = cli.serve_command(["m", "--vision-retention-ratio", "0.1", "--port", "9"], "Arch", environment={})
    assert command[:2] == ["vllm", "serve"] and command[command.index("--video-pruning-rate") + 1] == "0.9" and command[-2:] == ["--port", "9"]
    assert env["TOKENSIEVE_RETENTION_RATIO"] == "0.1"
    for bad in ("0", "-0.1", "1.1"):
        with pytest.raises(SystemExit):
            cli.serve_command(["m", "--vision-retention-ratio", bad], "Arch")
    for bad in ("--hf-overrides", "--video-pruning-rate=0.5"):
        with pytest.raises(SystemExit):
            cli.serve_command(["m", bad], "Arch")


def test_sql_functions(spark):
    register(spark)
    register(spark)
    assert spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)), vec_distance(array(0D), array(2D)), vec_unit(array(0D, 0D))").first()[:] == (11.0, 2.0, [0.0, 0.0])


def test_streamed_videos(spark, tmp_path):
    from tokensieve.streaming.videos import compress_stream

    for v in range(2):
        video(spark, np.random.default_rng(v).normal(size=(2, 5, 3)), video_id=v).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    compress_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), CompressionConfig(retention_ratio=0.5), 1).awaitTermination()
    assert {r["video_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("video_id").count().collect()} == {0: 5, 1: 5}


def test_masked_points_are_farther_than_anything_in_any_frame(spark):
    """Frame 1 is ten times as wide as frame 0; the masked point of frame 0 is beyond frame 1's greatest distance."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 6, 3)) * np.array([1, 10])[:, None, None]
    rows = [(0, f, t, x[f, t].tolist(), 2, t != 3) for f in range(2) for t in range(6)]
    points = spark.createDataFrame(rows, "video_id long, frame int, token int, vec array<double>, n int, valid boolean")
    most = max(K.distances(x[f]).max() for f in range(2))
    assert K.greatest_distance(points) == most
    got = {(r["frame"], r["token"]): r for r in K.clustered_points(points).collect()}
    for f in range(2):
        want = K.density_peaks(x[f], 2, 7, np.arange(6) != 3, most)
        assert [got[f, t]["cluster"] for t in range(6)] == want["cluster"].tolist()
        assert [got[f, t]["delta"] for t in range(6)] == want["delta"].tolist() and max(want["delta"]) == most + 1


def test_means_of_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(f), rng.normal(size=3 + g).tolist()) for g, f in rng.integers(0, 3, (200, 2))]
    df = spark.createDataFrame(rows, "g long, f int, vec array<double>").repartition(7)
    for r in V.group_means(df, {"g": "long", "f": "int"}).collect():
        own = [v for g, f, v in rows if (g, f) == (r["g"], r["f"])]
        assert r["members"] == len(own) and np.allclose(r["vec"], np.mean(own, axis=0))
    assert V.group_means(df.limit(0), {"g": "long"}).collect() == []


def test_offsets_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(A, "RUN", 4)
    grid = spark.createDataFrame([(i, i % 3 + 1, 2, i % 2 + 1) for i in range(3, 40, 2)], "video_id long, temporal int, height int, width int")
    rows = A.ragged_offsets(grid).orderBy("video_id").collect()
    at = 0
    for r in rows:
        assert (r["start"], r["stop"]) == (at, at + r["temporal"] * r["height"] * r["width"])
        at = r["stop"]
    with pytest.raises(PySparkException):
        A.ragged_offsets(grid, at + 1).collect()


def test_a_broken_line_ends_its_request(spark):
    lines = [("a", 1, "data: {}"), ("a", 2, 'data: {"usage": {"completion_tokens": 5}}'), ("a", 3, "data: [1]"), ("a", 4, 'data: {"usage": {"completion_tokens": 9}}'), ("b", 1, "data: {oops"), ("c", 1, ": ping"), ("d", 1, 'data: {"usage": {}}'), ("d", 2, "data: [DONE]")]
    df = spark.createDataFrame(lines, "request string, seq long, value string").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r["request"]: (r["chunks"], r["output_tokens"], r["error"]) for r in R.responses(df).collect()}
    assert got == {"a": (2, 5, "no JSON object in line 3"), "b": (0, 0, "no JSON object in line 1"), "c": (0, 0, None), "d": (1, 1, None)}
    times = spark.createDataFrame([("a", 1.0, 1.5, 4.0, None), ("b", 2.0, None, 2.5, "reset")], "request string, started double, first double, ended double, error string")
    assert [tuple(r) for r in R.request_log(times).orderBy("request").collect()] == [("a", True, None, 3.0, 0.5), ("b", False, "reset", 0.5, None)]


def test_stored_streams_and_reports_are_read(spark, tmp_path):
    (tmp_path / "streams").mkdir()
    (tmp_path / "streams" / "one.txt").write_text('data: {"id": 1}\n\ndata: {"usage": {"completion_tokens": 7}}\r\n: ping\ndata: [DONE]\n')
    (tmp_path / "streams" / "two.txt").write_text("")
    got = R.responses(Q.event_stream_lines(spark, str(tmp_path / "streams"))).collect()
    assert [(r["request"].rsplit("/")[-1], r["chunks"], r["output_tokens"], r["error"]) for r in got] == [("one.txt", 2, 7, None)]
    for i in range(2):
        R.report_sink(spark.createDataFrame([(i, 1.5, None)], "run_no int, output_tokens_per_s double, errors string"), str(tmp_path / "reports" / f"{i}.json"))
    assert sorted((r["run_no"], r["output_tokens_per_s"]) for r in Q.reports(spark, str(tmp_path / "reports")).collect()) == [(0, 1.5), (1, 1.5)]


@pytest.mark.parametrize("size", [1, 99, 500, 733, 2000])
def test_derived_videos_use_every_embedding(spark, tmp_path, size):
    videos = max(LEAST_VIDEOS, math.ceil(size / BEHIND))
    used = {x for v in range(videos) for f in range(FRAMES) for t in range(PER_FRAME) for x in ((f // SCENE * PER_FRAME + t + 137 * v) % size, ((f * PER_FRAME + t) * 7 + 3 + 137 * v) % size)}
    assert used == set(range(size))


def test_compress_checks_its_result(spark, monkeypatch):
    tokens = video(spark, np.random.default_rng(1).normal(size=(4, 6, 5)))
    monkeypatch.setattr(C, "attention_fill", lambda marked, context, targets: marked.limit(1).select(*C.OUT))
    with pytest.raises(ValueError, match="target is missed"):
        C.compress(tokens, CompressionConfig(retention_ratio=0.5))


def test_ratio_of_the_command_line(spark, tmp_path, monkeypatch):
    video(spark, np.random.default_rng(1).normal(size=(4, 6, 5))).write.parquet(str(tmp_path / "tokens"))
    monkeypatch.setenv("TOKENSIEVE_RETENTION_RATIO", "0.25")
    assert cli.main(["compress", str(tmp_path / "tokens"), str(tmp_path / "out"), "--pruning-rate", "0.75"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    with pytest.raises(SystemExit):
        cli.main(["compress", str(tmp_path / "tokens"), str(tmp_path / "other"), "--pruning-rate", "0.5"])


def test_requests_in_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, True, 5), ("2024-01-01 00:20:00", 1, False, 3), ("2024-01-01 01:10:00", 1, True, 2), ("2024-01-01 00:30:00", 2, True, 1)]
    spark.createDataFrame(rows, "ts string, run long, ok boolean, output_tokens long").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, run long, ok boolean, output_tokens long").parquet(str(tmp_path / "in"))
    query = windowed_requests(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["hour"], r["run"]): (r["requests"], r["failed"], r["output_tokens"]) for r in spark.sql("SELECT hour(window.start) AS hour, * FROM windows").collect()}
    assert got == {(0, 1): (2, 1, 8), (1, 1): (1, 0, 2), (0, 2): (1, 0, 1)}
