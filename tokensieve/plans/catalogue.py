"""Registered queries of the token compression engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.config import CompressionConfig
from tokensieve.functions import vectors as V
from tokensieve.operators import attention as A
from tokensieve.operators import budget as B
from tokensieve.operators import cluster as K
from tokensieve.operators import compress as C
from tokensieve.operators import merge as M
from tokensieve.operators import reports as R
from tokensieve.operators import segment as S
from tokensieve.operators import select as P
from tokensieve.plans import oracles as O
from tokensieve.sources import requests as Q
from tokensieve.sources.scratch import scratch, stored
from tokensieve.sources.videos import checked_tokens, derived_tokens, derived_videos

FLAGSHIP = "compress_r25"
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
QUARTER = CompressionConfig(retention_ratio=0.25)


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql is not None:
            _oracles[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def six(c: Column | str) -> Column:
    return F.round(c, 6)


def digest(vec: Column) -> list[Column]:
    """Two numbers that stand for a vector."""
    ramp = F.aggregate(F.transform(vec, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return [six(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)).alias("vec_sum"), six(ramp).alias("vec_ramp")]


def elements(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("vec").alias("pos", "x")).select(*keys, "pos", six("x").alias("x"))


UNNEST = "SELECT {keys}, (p - 1)::INT AS pos, round(x, 6) + 0.0 AS x FROM (SELECT {keys}, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS p FROM {of})"


@query(O.chain(UNNEST.format(keys="video_id, frame, token", vec="u", of="vid"), "vid"))
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived_tokens(spark, sf).select("video_id", "frame", "token", V.unit(F.col("vec")).alias("vec"))
    return elements(rows, "video_id", "frame", "token")


@query(O.chain("SELECT video_id, frame, i, j, round(dist, 6) + 0.0 AS dist FROM pairs", "pairs"))
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.cosine_pairs(derived_tokens(spark, sf)).select("video_id", "frame", "i", "j", six("dist").alias("dist"))


@query(O.chain("SELECT a.video_id, a.frame, a.token AS i, b.token AS j, round(round(list_distance(a.vec, b.vec) / sqrt(len(a.vec)::DOUBLE), 9), 6) AS dist FROM tok a JOIN tok b USING (video_id, frame)", "tok"))
def euclid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return K.euclid_pairs(derived_tokens(spark, sf)).select("video_id", "frame", "i", "j", six("dist").alias("dist"))


@query(O.chain(UNNEST.format(keys="video_id, frame", vec="vec", of="fm"), "fm"))
def frame_mean(spark: SparkSession, sf: str) -> DataFrame:
    return elements(S.frame_means(derived_tokens(spark, sf)), "video_id", "frame")


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return S.frame_means(derived_tokens(spark, sf))


@query(O.chain("SELECT video_id, frame, round(sim, 6) + 0.0 AS sim FROM tr", "tr"))
def frame_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return S.transitions(_means(spark, sf)).select("video_id", "frame", six("sim").alias("sim"))


@query(O.chain("SELECT video_id, frame, cut FROM cuts", "cuts"))
def segment_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return S.cuts(S.transitions(_means(spark, sf))).select("video_id", "frame", "cut")


LENGTHS = "SELECT video_id, seg_id, min(frame) AS start_frame, count(*) AS length FROM seg GROUP BY ALL"


@query(O.chain(LENGTHS, "seg"))
def segment_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return S.segment_lengths(S.segments(_means(spark, sf)))


@query(O.chain(LENGTHS, "seg", cuts=O.cut(0.2, 9)))
def segment_min_fill(spark: SparkSession, sf: str) -> DataFrame:
    return S.segment_lengths(S.segments(_means(spark, sf), 0.2, 9))


@query(O.chain("SELECT video_id, frame, token, round(attention, 6) AS attention FROM att", "att"))
def received_attention(spark: SparkSession, sf: str) -> DataFrame:
    return derived_videos(spark, sf).select("video_id", "frame", "token", six("attention").alias("attention"))


#: Four heads of a quarter of the dimensions each; the keys are those of the next head.
HEADS = 4
MANY_HEADS = f"""SELECT video_id, frame, kt AS token, round(avg(p), 6) AS attention FROM (
  SELECT video_id, frame, head, kt, z / sum(z) OVER (PARTITION BY video_id, frame, head, qt) AS p FROM (
    SELECT *, exp(l - max(l) OVER (PARTITION BY video_id, frame, head, qt)) AS z FROM (
      SELECT a.video_id, a.frame, a.head, a.token AS qt, b.token AS kt, list_dot_product(a.part, b.part) / sqrt(len(a.part)::DOUBLE) AS l
      FROM heads a JOIN heads b ON a.video_id = b.video_id AND a.frame = b.frame AND b.head = (a.head + 1) % {HEADS}))) GROUP BY ALL"""
PARTS_OF_HEADS = f"SELECT video_id, frame, token, head, vec[(head * len(vec) // {HEADS} + 1):((head + 1) * len(vec) // {HEADS})] AS part FROM tok, (SELECT unnest(range({HEADS})) AS head)"


@query(O.chain(MANY_HEADS.replace("heads a", f"({PARTS_OF_HEADS}) a").replace("heads b", f"({PARTS_OF_HEADS}) b"), "tok"))
def attention_of_heads(spark: SparkSession, sf: str) -> DataFrame:
    width = F.floor(F.size("vec") / HEADS)
    part = lambda h: F.slice("vec", (F.lit(h % HEADS) * width + 1).cast("int"), width.cast("int"))
    heads = F.explode(F.array(*(F.struct(F.lit(h).alias("head"), part(h).alias("q"), part(h + 1).alias("k")) for h in range(HEADS))))
    qk = derived_tokens(spark, sf).select("video_id", "frame", F.col("token").alias("patch"), heads.alias("h")).select("video_id", "frame", "h.head", "patch", "h.q", "h.k")
    return A.received_attention(qk).select("video_id", "frame", F.col("patch").alias("token"), six("attention").alias("attention"))


@query(O.chain("SELECT video_id, frame, token // 4 AS token, round(avg(attention), 6) AS attention FROM att GROUP BY ALL", "att"))
def pooled_attention(spark: SparkSession, sf: str) -> DataFrame:
    pooled = A.pooled_attention(derived_videos(spark, sf).withColumnRenamed("token", "patch"), 4)
    return pooled.select("video_id", "frame", "token", six("attention").alias("attention"))


GRID = "SELECT c_custkey AS video_id, (c_custkey % 7 + 1)::INT AS temporal, (c_custkey % 5 + 2)::INT AS height, (c_custkey % 3 + 2)::INT AS width FROM customer"


@query(f"SELECT video_id, temporal, height, width, (stop - temporal * height * width)::BIGINT AS start, stop::BIGINT AS stop FROM (SELECT *, sum(temporal * height * width) OVER (ORDER BY video_id) AS stop FROM ({GRID}))")
def ragged_offsets(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    sizes = [(key % 7 + 1).cast("int").alias("temporal"), (key % 5 + 2).cast("int").alias("height"), (key % 3 + 2).cast("int").alias("width")]
    return A.ragged_offsets(spark.read.parquet(f"{sf}/customer.parquet").select(key.alias("video_id"), *sizes))


@query(O.chain("SELECT video_id, frame, i, j, round(cal, 1) + 0.0 AS cal FROM cal", "cal"))
def calibrated_distance(spark: SparkSession, sf: str) -> DataFrame:
    return P.calibrated_distances(derived_videos(spark, sf)).select("video_id", "frame", "i", "j", F.round("cal", 1).alias("cal"))


@query(O.chain("SELECT video_id, frame, token, round(nearest, 1) + 0.0 AS nearest FROM first", "first"))
def adts_first_pick(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_picks(derived_videos(spark, sf)).select("video_id", "frame", "token", F.round("nearest", 1).alias("nearest"))


def _counts(tokens: DataFrame, config: CompressionConfig = QUARTER) -> DataFrame:
    some = C.video_targets(tokens, config).withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames").cast("int") - 1)))
    return B.allocate(some.select("video_id", "frame", F.col("tpf").alias("capacity"), "diverse"), "diverse")


@query(O.chain("SELECT video_id, frame, token, pick FROM picks", "picks"))
def adts_select(spark: SparkSession, sf: str) -> DataFrame:
    tokens = derived_videos(spark, sf)
    return P.diverse_tokens(tokens, _counts(tokens))


def _available(spark: SparkSession, sf: str) -> DataFrame:
    tokens = derived_videos(spark, sf)
    marked = stored(P.marked_tokens(tokens, _counts(tokens)), "marked")
    return marked.filter("pick IS NULL").join(S.segments(S.frame_means(marked)), ["video_id", "frame"])


@query(O.chain("SELECT video_id, seg_id, frame, token, parent, round(sim, 6) + 0.0 AS sim FROM match", "match"))
def tstm_best_match(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_matches(_available(spark, sf)).withColumn("sim", six("sim"))


@query(O.chain("SELECT video_id, seg_id, frame, token, parent FROM edges", "edges"))
def tstm_edges(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge_edges(M.best_matches(_available(spark, sf))).drop("sim")


@query(O.chain("SELECT video_id, frame, token, rf AS root_frame, rt AS root_token FROM root", "root"))
def tstm_roots(spark: SparkSession, sf: str) -> DataFrame:
    rows = _available(spark, sf)
    return M.forest_roots(rows, M.merge_edges(M.best_matches(rows)))


@query(O.chain(f"SELECT video_id, frame, token, members, {O.DIGEST} FROM merged", "merged"))
def tstm_merge(spark: SparkSession, sf: str) -> DataFrame:
    return M.merged_tokens(_available(spark, sf)).select("video_id", "frame", "token", "members", *digest(F.col("vec")))


#: The clustering queries group each frame's tokens; points whose token is a multiple of 5 don't count in the masked one.
POINTS = "SELECT video_id, frame, token, vec, 4 AS n, 7 AS k, true AS valid FROM tok"
MASKED = "SELECT video_id, frame, token, vec, 4 AS n, 7 AS k, token % 5 <> 0 AS valid FROM tok"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return derived_tokens(spark, sf).withColumn("n", F.lit(4))


def _dpc(query_: str, *needs: str, pts: str = POINTS) -> str:
    return O.chain(query_, "tok", *needs, pts=pts)


@query(_dpc("SELECT video_id, frame, i AS token, (rk - 1)::INT AS rank, j AS neighbour, round(d, 6) AS dist FROM near WHERE rk <= 7", "near"))
def knn(spark: SparkSession, sf: str) -> DataFrame:
    return K.nearest_neighbours(_points(spark, sf)).withColumn("dist", six("dist"))


@query(_dpc("SELECT video_id, frame, token, round(rho, 6) AS density FROM rho", "rho"))
def dpc_density(spark: SparkSession, sf: str) -> DataFrame:
    return K.clustered_points(_points(spark, sf)).select("video_id", "frame", "token", six("density").alias("density"))


@query(_dpc("SELECT video_id, frame, token, round(delta, 6) AS delta, round(round(delta * rho, 9), 6) AS score FROM delta", "delta"))
def dpc_delta(spark: SparkSession, sf: str) -> DataFrame:
    return K.clustered_points(_points(spark, sf)).select("video_id", "frame", "token", six("delta").alias("delta"), six("score").alias("score"))


@query(_dpc("SELECT video_id, frame, token, cluster FROM centre", "centre"))
def dpc_centers(spark: SparkSession, sf: str) -> DataFrame:
    return K.clustered_points(_points(spark, sf)).filter("centre").select("video_id", "frame", "token", "cluster")


@query(_dpc("SELECT video_id, frame, token, cluster, centre FROM assign", "assign"))
def dpc_assign(spark: SparkSession, sf: str) -> DataFrame:
    return K.clustered_points(_points(spark, sf)).select("video_id", "frame", "token", "cluster", "centre")


@query(_dpc("SELECT video_id, frame, token, cluster, centre FROM assign", "assign", pts=MASKED))
def dpc_masked(spark: SparkSession, sf: str) -> DataFrame:
    masked = _points(spark, sf).withColumn("valid", F.col("token") % 5 != 0)
    return K.clustered_points(masked).select("video_id", "frame", "token", "cluster", "centre")


@query(_dpc(f"SELECT video_id, frame, token, {O.DIGEST} FROM means", "means", pts="SELECT video_id, frame, token, vec, 4 AS n, 4 AS k, true AS valid FROM tok"))
def cluster_mean(spark: SparkSession, sf: str) -> DataFrame:
    tokens = derived_tokens(spark, sf)
    counts = tokens.select("video_id", "frame").distinct().withColumn("n", F.lit(4))
    return K.cluster_means(tokens, counts).select("video_id", "frame", "token", *digest(F.col("vec")))


@query(O.chain("SELECT video_id, frame, capacity, n FROM counts", "counts"))
def budget_even(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(derived_videos(spark, sf))


CAPACITIES = "(SELECT o_custkey AS video_id, o_orderkey AS frame, l AS capacity, (sum(l) OVER (PARTITION BY o_custkey) * 3)::BIGINT // 5 AS budget FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL))"


@query("WITH alloc AS (" + O.alloc(CAPACITIES) + ") SELECT video_id, frame, capacity, n FROM alloc")
def budget_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("l"))
    rooms = orders.join(sizes, orders["o_orderkey"] == sizes["l_orderkey"], "left").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("frame"), F.coalesce("l", F.lit(0)).alias("capacity"))
    totals = rooms.groupBy("video_id").agg(F.floor(F.sum("capacity") * 3 / 5).alias("budget"))
    return B.allocate(rooms.join(totals, "video_id"), "budget")


RATIOS = "(SELECT unnest([0.1, 0.25, 0.5, 1.0]) AS ratio)"


def _ratios(table: DataFrame, f: Callable[[float], Column]) -> DataFrame:
    return table.select("*", F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), f(r).alias("target")) for r in (0.1, 0.25, 0.5, 1.0)))).alias("_r")).select("video_id", "_r.ratio", "_r.target")


@query(f"SELECT p_partkey AS video_id, ratio::DOUBLE AS ratio, ceil((p_partkey % 97 + 1)::DOUBLE * ratio::DOUBLE)::BIGINT AS target FROM part, {RATIOS}")
def target_library(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("video_id"))
    return _ratios(parts, lambda r: B.library_target(F.col("video_id") % 97 + 1, r))


@query(
    "SELECT p_partkey AS video_id, ratio::DOUBLE AS ratio, greatest(tpf, floor((frames * tpf)::DOUBLE * (1::DOUBLE - (1::DOUBLE - ratio::DOUBLE)))::BIGINT) AS target "
    f"FROM (SELECT p_partkey, p_partkey % 97 + 1 AS frames, p_partkey % 13 + 1 AS tpf FROM part), {RATIOS}"
)
def target_service(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("video_id"))
    return _ratios(parts, lambda r: B.service_target(F.col("video_id") % 97 + 1, F.col("video_id") % 13 + 1, r))


def _compressed(config: CompressionConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return C.compress(derived_videos(spark, sf), config).select("video_id", "anchor", "frame", "token", *digest(F.col("vec")))

    return run


for _name, _ratio, _alpha in (("r100", 1, 0.7), ("r50", 0.5, 0.7), ("r25", 0.25, 0.7), ("r10", 0.1, 0.7), ("alpha0", 0.25, 0.0), ("alpha1", 0.25, 1.0)):
    query(O.compressed(_ratio, _alpha), f"compress_{_name}")(_compressed(CompressionConfig(retention_ratio=_ratio, alpha=_alpha)))

SERVICE = f"""SELECT video_id, 20::BIGINT AS frames, 20::BIGINT AS tpf, 400::BIGINT AS total, target, least(target, ceil(target::DOUBLE * 0.7::DOUBLE)::BIGINT) AS diverse FROM (
  SELECT video_id, greatest(20, floor(400::DOUBLE * (1::DOUBLE - (1::DOUBLE - 0.1::DOUBLE)))::BIGINT) AS target FROM {O.VIDEOS})"""


@query(O.chain(f"SELECT video_id, (frame * 20 + token)::BIGINT AS anchor, frame, token, {O.DIGEST} FROM retained", "retained", targets=SERVICE))
def compress_service(spark: SparkSession, sf: str) -> DataFrame:
    target = B.service_target(F.col("frames"), F.col("tpf"), 0.1)
    result = C.compress(checked_tokens(derived_videos(spark, sf)), CompressionConfig(), target)
    return result.select("video_id", "anchor", "frame", "token", *digest(F.col("vec")))


FILLING = CompressionConfig(retention_ratio=0.9, alpha=0.3)


@query(O.compressed(0.9, 0.3))
def attention_fill(spark: SparkSession, sf: str) -> DataFrame:
    return _compressed(FILLING)(spark, sf)


def _result(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tokens = derived_videos(spark, sf)
    return tokens, C.compress(tokens, QUARTER)


KEPT = "SELECT v.video_id, v.frame, v.token, r.video_id IS NOT NULL AS kept FROM vid v LEFT JOIN retained r ON r.video_id = v.video_id AND r.frame = v.frame AND r.token = v.token"


@query(O.chain(KEPT, "retained"))
def retention_mask(spark: SparkSession, sf: str) -> DataFrame:
    return C.retention_mask(*_result(spark, sf))


@query(O.chain(f"SELECT video_id, frame, count(*) FILTER (kept) AS n FROM ({KEPT}) GROUP BY ALL", "retained"))
def tokens_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    return C.tokens_per_frame(C.retention_mask(*_result(spark, sf)))


@query(O.chain("SELECT video_id, t.total, t.target, count(*) AS retained FROM retained JOIN targets t USING (video_id) GROUP BY video_id, t.total, t.target", "retained"))
def compression_summary(spark: SparkSession, sf: str) -> DataFrame:
    tokens, result = _result(spark, sf)
    return C.asserted(C.anchored(result.drop("anchor"), C.video_targets(tokens, QUARTER)), C.video_targets(tokens, QUARTER))


@query(O.chain("SELECT video_id, (frame * 20 + token)::BIGINT AS anchor, frame, token, video_id * 1000 + frame * 0.5::DOUBLE AS ts FROM retained", "retained"))
def assembled(spark: SparkSession, sf: str) -> DataFrame:
    tokens, result = _result(spark, sf)
    times = tokens.select("video_id", "frame").distinct().withColumn("ts", F.col("video_id") * 1000 + F.col("frame") * 0.5)
    return C.with_timestamps(result, times).select("video_id", "anchor", "frame", "token", "ts")


REQUESTS = """(SELECT user_id % 4 AS run, event_id AS seq, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error,
  value AS latency_s, CASE WHEN event_type <> 'view' THEN value / 2 END AS ttft_s,
  coalesce(nullif(coalesce((props::JSON->>'k')::BIGINT, 0), 0), event_id % 7 + 1) AS output_tokens, event_id % 7 + 1 AS chunks FROM events)"""
ELAPSED = "(SELECT user_id % 4 AS run, round(sum(value) / 16, 6) AS elapsed_s FROM events GROUP BY ALL)"
REPORT = f"""(SELECT run, count(*) AS requests, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, 16 AS concurrency, any_value(elapsed_s) AS elapsed_s,
  round(count(*) FILTER (ok) / any_value(elapsed_s), 6) AS requests_per_s, round(sum(output_tokens) FILTER (ok) / any_value(elapsed_s), 6) AS output_tokens_per_s,
  round(avg(latency_s) FILTER (ok), 6) AS latency_mean_s, round(median(latency_s) FILTER (ok), 6) AS latency_p50_s,
  round(avg(ttft_s) FILTER (ok), 6) AS ttft_mean_s, round(median(ttft_s) FILTER (ok), 6) AS ttft_p50_s,
  array_to_string((list(error ORDER BY seq) FILTER (NOT ok))[1:10], ',') AS errors
FROM {REQUESTS} JOIN {ELAPSED} e USING (run) GROUP BY run)"""


def _report(spark: SparkSession, sf: str) -> DataFrame:
    elapsed = spark.read.parquet(f"{sf}/events.parquet").groupBy((F.col("user_id") % 4).alias("run")).agg(F.round(F.sum("value") / 16, 6).alias("elapsed_s"))
    report = R.request_report(Q.events_as_requests(spark, sf), elapsed)
    rounded = ("requests_per_s", "output_tokens_per_s", "latency_mean_s", "latency_p50_s", "ttft_mean_s", "ttft_p50_s")
    return report.withColumns({c: six(c) for c in rounded}).withColumn("errors", F.array_join("errors", ","))


@query(f"SELECT * FROM {REPORT}")
def request_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


#: Lines before a broken one count; usage is null for what is no data line.
LINES = """(SELECT *, usage IS NOT NULL AS data, usage IS NOT NULL AND seq < coalesce(bad, seq + 1) AS read FROM (
  SELECT *, min(seq) FILTER (seq % 46 = 0) OVER (PARTITION BY request) AS bad FROM (
    SELECT user_id AS request, event_id AS seq, ts, CASE WHEN event_id % 2 = 0 THEN event_id % 3 = 0 END AS usage, coalesce((props::JSON->>'k')::BIGINT, 0) AS k FROM events)))"""


@query(f"SELECT request, epoch_us(min(ts) FILTER (data)) AS first_us, count(*) FILTER (read) AS chunks FROM {LINES} GROUP BY ALL")
def ttft(spark: SparkSession, sf: str) -> DataFrame:
    out = R.responses(Q.events_as_lines(spark, sf))
    return out.select("request", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), "chunks")


@query(f"SELECT request, coalesce(nullif(max_by(k, seq) FILTER (usage AND read), 0), count(*) FILTER (read)) AS output_tokens FROM {LINES} GROUP BY ALL")
def token_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return R.responses(Q.events_as_lines(spark, sf)).select("request", "output_tokens")


@query(
    "SELECT request, bad IS NULL AS ok, CASE WHEN bad IS NOT NULL THEN 'no JSON object in line ' || bad END AS error, round((epoch_us(ended) - epoch_us(started)) / 1e6, 6) AS latency_s, "
    f"round((epoch_us(first) - epoch_us(started)) / 1e6, 6) AS ttft_s FROM (SELECT request, any_value(bad) AS bad, min(ts) AS started, max(ts) AS ended, min(ts) FILTER (data) AS first FROM {LINES} GROUP BY request)"
)
def request_log(spark: SparkSession, sf: str) -> DataFrame:
    lines = Q.events_as_lines(spark, sf)
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    times = lines.groupBy("request").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    timed = R.responses(lines).join(times, "request").select("request", second("started").alias("started"), second("first_ts").alias("first"), second("ended").alias("ended"), "error")
    return R.request_log(timed).withColumns({c: six(c) for c in ("latency_s", "ttft_s")})


@query(f"SELECT run, seq, error FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS rk FROM {REQUESTS} WHERE NOT ok) WHERE rk <= 10")
def first_errors(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_errors(Q.events_as_requests(spark, sf))


CONFIGS = """(SELECT (row_number() OVER (ORDER BY dp, max_num_seqs, max_num_batched_tokens) - 1)::INT AS run_no, printf('dp%d-seqs%d-tokens%d', dp, max_num_seqs, max_num_batched_tokens) AS name, *
FROM (SELECT unnest([1, 2, 4, 8]) AS dp), (SELECT unnest([16, 32, 64]) AS max_num_seqs), (SELECT unnest([16384, 32768]) AS max_num_batched_tokens))"""


@query(f"SELECT * FROM {CONFIGS}")
def config_grid(spark: SparkSession, sf: str) -> DataFrame:
    return R.config_grid(spark)


#: A run for each configuration; some orders' keys stand for failed requests, the dearest order for the rate.
RUNS = "(SELECT (o_orderkey % 24)::INT AS run_no, count(*) FILTER (o_orderkey % 9973 = 0) AS failed, max(o_totalprice) AS output_tokens_per_s FROM orders GROUP BY ALL)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    runs = orders.groupBy((F.col("o_orderkey") % 24).cast("int").alias("run_no"))
    return runs.agg(F.count_if(F.col("o_orderkey") % 9973 == 0).alias("failed"), F.max("o_totalprice").alias("output_tokens_per_s"))


@query(f"SELECT run_no, failed, output_tokens_per_s, dp, max_num_seqs, max_num_batched_tokens FROM {RUNS} JOIN {CONFIGS} USING (run_no) WHERE failed = 0 ORDER BY output_tokens_per_s DESC, run_no LIMIT 1")
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    return R.best_run(R.with_config(_runs(spark, sf), R.config_grid(spark))).select("run_no", "failed", "output_tokens_per_s", "config.*")


@query(f"SELECT run_no, failed, output_tokens_per_s FROM {RUNS}")
def stored_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that were stored as JSON, one to a file, and read back."""
    path = scratch(spark, "reports")
    _runs(spark, sf).repartition("run_no").write.partitionBy("run_no").json(path)
    return Q.reports(spark, path).select(F.col("run_no").cast("int"), F.col("failed").cast("long"), F.col("output_tokens_per_s").cast("double"))


PROMPTS = "(SELECT c_custkey AS request, 'Describe order ' || c_custkey AS prompt, c_custkey % 3 AS kind FROM customer)"


@query(
    "SELECT request, '{\"model\":\"m\",\"messages\":[{\"role\":\"user\",\"content\":[' || "
    "CASE kind WHEN 1 THEN '{\"type\":\"video_url\",\"video_url\":{\"url\":\"file:///v' || request || '\"}},' WHEN 2 THEN '{\"type\":\"image_url\",\"image_url\":{\"url\":\"file:///i' || request || '\"}},' ELSE '' END || "
    "'{\"type\":\"text\",\"text\":\"' || prompt || '\"}]}],\"temperature\":0,\"max_tokens\":64}' AS body FROM " + PROMPTS
)
def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    prompts = spark.read.parquet(f"{sf}/customer.parquet").select(
        key.alias("request"),
        F.concat(F.lit("Describe order "), key.cast("string")).alias("prompt"),
        F.when(key % 3 == 1, F.array(F.concat(F.lit("file:///v"), key.cast("string")))).alias("videos"),
        F.when(key % 3 == 2, F.concat(F.lit("file:///i"), key.cast("string"))).alias("image"),
    )
    return R.chat_requests(prompts, "m")
