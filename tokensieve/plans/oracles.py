"""DuckDB SQL that computes what the engine's queries compute, from common table expressions.

Every expression below has a name and what it needs; chain() puts together those that a query asks for.
"""

from __future__ import annotations

#: One video for each hundred embeddings, three at least.
VIDEOS = "(SELECT unnest(range(greatest(3, (SELECT (count(*) + 99) // 100 FROM embeddings)))) AS video_id)"

TOK = f"""SELECT v.video_id, f.frame, t.token,
  list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + 0.25::DOUBLE * b.embedding[i]::DOUBLE) AS vec
FROM {VIDEOS} v, (SELECT unnest(range(20))::INT AS frame) f, (SELECT unnest(range(20))::INT AS token) t,
  (SELECT count(*) AS m FROM embeddings) c
JOIN embeddings a ON a.vec_id = ((f.frame // 5) * 20 + t.token + 137 * v.video_id) % c.m
JOIN embeddings b ON b.vec_id = ((f.frame * 20 + t.token) * 7 + 3 + 137 * v.video_id) % c.m"""

LOGITS = """SELECT q.video_id, q.frame, q.token AS qt, k.token AS kt, list_dot_product(q.vec, k.vec) / sqrt(len(q.vec)::DOUBLE) AS l
FROM tok q JOIN tok k USING (video_id, frame)"""

SHIFTED = "SELECT *, exp(l - max(l) OVER (PARTITION BY video_id, frame, qt)) AS z FROM logits"

WEIGHTS = "SELECT video_id, frame, kt, z / sum(z) OVER (PARTITION BY video_id, frame, qt) AS p FROM shifted"

ATT = "SELECT video_id, frame, kt AS token, avg(p) AS attention FROM weights GROUP BY ALL"

VID = """SELECT tok.*, attention, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-6::DOUBLE)) AS u
FROM tok JOIN att USING (video_id, frame, token)"""

FM = """SELECT video_id, frame, list(a ORDER BY p) AS vec FROM (
  SELECT video_id, frame, p, avg(x) AS a FROM (SELECT video_id, frame, unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM vid) GROUP BY ALL
) GROUP BY ALL"""

FU = "SELECT video_id, frame, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-6::DOUBLE)) AS u FROM fm"

TR = """SELECT a.video_id, a.frame, round(list_dot_product(a.u, b.u), 9) AS sim
FROM fu a JOIN fu b ON a.video_id = b.video_id AND b.frame = a.frame + 1"""


def cut(threshold: float, least: int) -> str:
    return f"""SELECT video_id, frame, sim, below OR rk <= missing AS cut FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, below ORDER BY sim, frame) AS rk,
    least({least}, count(*) OVER (PARTITION BY video_id) + 1) - (count(*) FILTER (below) OVER (PARTITION BY video_id) + 1) AS missing
  FROM (SELECT *, sim < {threshold}::DOUBLE AS below FROM tr))"""


SEG = """SELECT f.video_id, f.frame, (sum(CASE WHEN c.cut THEN 1 ELSE 0 END) OVER (PARTITION BY f.video_id ORDER BY f.frame))::INT AS seg_id
FROM (SELECT DISTINCT video_id, frame FROM fm) f LEFT JOIN cuts c ON c.video_id = f.video_id AND c.frame = f.frame - 1"""

PAIRS = """SELECT a.video_id, a.frame, a.token AS i, b.token AS j, 1 - list_dot_product(a.u, b.u) AS dist, b.attention
FROM vid a JOIN vid b USING (video_id, frame)"""

CAL = "SELECT video_id, frame, i, j, round(dist * attention * 1e6::DOUBLE, 6) AS cal FROM pairs"

CALROW = "SELECT video_id, frame, i, list(cal ORDER BY j) AS r FROM cal GROUP BY ALL"

SECOND = """SELECT video_id, frame, j, cal FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame, j ORDER BY cal, i) AS rk FROM cal) WHERE rk = 2"""

FIRST = """SELECT video_id, frame, j AS token, cal AS nearest FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY cal DESC, j) AS rk FROM second) WHERE rk = 1"""

GREEDY = """SELECT f.video_id, f.frame, c.n, [f.token + 1] AS picks, r.r AS near
  FROM first f JOIN counts c USING (video_id, frame) JOIN calrow r ON r.video_id = f.video_id AND r.frame = f.frame AND r.i = f.token
  WHERE c.n > 0
  UNION ALL
  SELECT a.video_id, a.frame, a.n, list_append(a.picks, a.nxt), list_transform(a.near, lambda x, i: least(x, r.r[i]))
  FROM (SELECT *, list_position(m, list_max(m)) AS nxt FROM (
    SELECT *, list_transform(near, lambda x, i: CASE WHEN list_contains(picks, i) THEN -1::DOUBLE ELSE x END) AS m FROM greedy WHERE len(picks) < n)) a
  JOIN calrow r ON r.video_id = a.video_id AND r.frame = a.frame AND r.i = a.nxt - 1"""

PICKS = """SELECT video_id, frame, (unnest(picks) - 1)::INT AS token, generate_subscripts(picks, 1) - 1 AS pick FROM greedy WHERE len(picks) = n"""


def alloc(rows: str) -> str:
    """Largest remainders over rows(video_id, frame, capacity, budget)."""
    return f"""SELECT video_id, frame, capacity, n + CASE WHEN room > 0 AND rk <= left_over THEN 1 ELSE 0 END AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY room > 0 DESC, raw - n DESC, room DESC, frame) AS rk FROM (
    SELECT *, capacity - n AS room, budget - sum(n) OVER (PARTITION BY video_id) AS left_over FROM (
      SELECT *, least(capacity, floor(raw)::BIGINT) AS n FROM (
        SELECT *, CASE WHEN total > 0 THEN (budget * capacity)::DOUBLE / total ELSE 0 END AS raw FROM (
          SELECT video_id, frame, capacity::BIGINT AS capacity, budget::BIGINT AS budget, (sum(capacity) OVER (PARTITION BY video_id))::BIGINT AS total FROM {rows})))))"""


AVAIL = """SELECT v.video_id, s.seg_id, v.frame, v.token, v.vec, v.u, v.attention FROM vid v JOIN seg s USING (video_id, frame)
ANTI JOIN picks p ON p.video_id = v.video_id AND p.frame = v.frame AND p.token = v.token"""

MATCH = """SELECT video_id, seg_id, frame, token, parent, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame, token ORDER BY sim DESC, parent) AS rk FROM (
    SELECT c.video_id, c.seg_id, c.frame, c.token, p.token AS parent, round(list_dot_product(c.u, p.u), 9) AS sim
    FROM avail c JOIN avail p ON p.video_id = c.video_id AND p.seg_id = c.seg_id AND p.frame = c.frame - 1)) WHERE rk = 1"""


def edges(threshold: float) -> str:
    return f"SELECT * FROM match WHERE sim > {threshold}::DOUBLE"


ROOT = """SELECT a.video_id, a.frame, a.token, a.frame AS rf, a.token AS rt FROM avail a
  ANTI JOIN edges e ON e.video_id = a.video_id AND e.frame = a.frame AND e.token = a.token
  UNION ALL
  SELECT e.video_id, e.frame, e.token, r.rf, r.rt FROM root r JOIN edges e ON e.video_id = r.video_id AND e.frame = r.frame + 1 AND e.parent = r.token"""

MERGED = """SELECT video_id, frame, token, list(a ORDER BY p) AS vec, any_value(members) AS members FROM (
  SELECT video_id, frame, token, p, avg(x) AS a, count(*) AS members FROM (
    SELECT r.video_id, r.rf AS frame, r.rt AS token, unnest(a.vec) AS x, generate_subscripts(a.vec, 1) AS p
    FROM root r JOIN avail a ON a.video_id = r.video_id AND a.frame = r.frame AND a.token = r.token) GROUP BY ALL
) GROUP BY video_id, frame, token"""

#: Density peaks over pts(video_id, frame, token, vec, n, k, valid).
DIST0 = """SELECT a.video_id, a.frame, a.token AS i, b.token AS j, a.n, a.k, b.valid, round(list_distance(a.vec, b.vec) / sqrt(len(a.vec)::DOUBLE), 9) AS d0
FROM pts a JOIN pts b USING (video_id, frame)"""

DIST = "SELECT *, CASE WHEN valid THEN d0 ELSE (SELECT max(d0) FROM dist0) + 1 END AS d FROM dist0"

NEAR = "SELECT *, row_number() OVER (PARTITION BY video_id, frame, i ORDER BY d, j) AS rk FROM dist"

RHO = """SELECT r.video_id, r.frame, r.token, CASE WHEN p.valid THEN rho ELSE 0 END AS rho FROM (
  SELECT video_id, frame, i AS token, round(exp(avg(-d * d)), 9) AS rho FROM near WHERE rk <= k GROUP BY ALL) r
JOIN pts p USING (video_id, frame, token)"""

DELTA = """SELECT d.video_id, d.frame, d.i AS token, any_value(d.n) AS n, any_value(a.rho) AS rho,
  coalesce(min(CASE WHEN b.rho > a.rho THEN d.d END), any_value(m.most)) AS delta
FROM dist d JOIN rho a ON a.video_id = d.video_id AND a.frame = d.frame AND a.token = d.i
JOIN rho b ON b.video_id = d.video_id AND b.frame = d.frame AND b.token = d.j
JOIN (SELECT video_id, frame, max(d) AS most FROM dist GROUP BY ALL) m ON m.video_id = d.video_id AND m.frame = d.frame
GROUP BY d.video_id, d.frame, d.i"""

CENTRE = """SELECT video_id, frame, token, rk - 1 AS cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY round(delta * rho, 9) DESC, token) AS rk FROM delta) WHERE rk <= n"""

ASSIGN = """SELECT video_id, frame, token, coalesce(own, cluster) AS cluster, own IS NOT NULL AS centre FROM (
  SELECT d.video_id, d.frame, d.i AS token, c.cluster, o.cluster AS own, row_number() OVER (PARTITION BY d.video_id, d.frame, d.i ORDER BY d.d, c.cluster) AS rk
  FROM dist d JOIN centre c ON c.video_id = d.video_id AND c.frame = d.frame AND c.token = d.j
  LEFT JOIN centre o ON o.video_id = d.video_id AND o.frame = d.frame AND o.token = d.i) WHERE rk = 1"""

MEANS = """SELECT c.video_id, c.frame, c.token, g.vec FROM centre c JOIN (
  SELECT video_id, frame, cluster, list(a ORDER BY p) AS vec FROM (
    SELECT a.video_id, a.frame, a.cluster, p, avg(x) AS a FROM (
      SELECT a.video_id, a.frame, a.cluster, unnest(t.vec) AS x, generate_subscripts(t.vec, 1) AS p FROM assign a JOIN pts t USING (video_id, frame, token)) a GROUP BY ALL
  ) GROUP BY video_id, frame, cluster) g USING (video_id, frame, cluster)"""

CONTEXT = """SELECT video_id, frame, token, vec FROM (SELECT m.*, s.n, s.capacity FROM merged m JOIN shares s USING (video_id, frame)) WHERE n >= capacity AND n > 0
UNION ALL SELECT * FROM means"""

DIGEST = "round(list_sum(vec), 6) + 0.0 AS vec_sum, round(list_sum(list_transform(vec, lambda x, i: x * i)), 6) + 0.0 AS vec_ramp"

PARTS = {
    "tok": (TOK, ()),
    "logits": (LOGITS, ("tok",)),
    "shifted": (SHIFTED, ("logits",)),
    "weights": (WEIGHTS, ("shifted",)),
    "att": (ATT, ("weights",)),
    "vid": (VID, ("att",)),
    "fm": (FM, ("vid",)),
    "fu": (FU, ("fm",)),
    "tr": (TR, ("fu",)),
    "cuts": (cut(0.9, 4), ("tr",)),
    "seg": (SEG, ("cuts",)),
    "pairs": (PAIRS, ("vid",)),
    "cal": (CAL, ("pairs",)),
    "calrow": (CALROW, ("cal",)),
    "second": (SECOND, ("cal",)),
    "first": (FIRST, ("second",)),
    "targets": ("SELECT video_id, 20::BIGINT AS frames, 20::BIGINT AS tpf, 400::BIGINT AS total, 100::BIGINT AS target, 70::BIGINT AS diverse FROM " + VIDEOS, ()),
    "evenly": ("SELECT video_id, f.frame, tpf AS capacity, diverse AS budget FROM targets, (SELECT unnest(range(20))::INT AS frame) f", ("targets",)),
    "counts": (alloc("evenly"), ("evenly",)),
    "greedy": (GREEDY, ("first", "calrow", "counts")),
    "picks": (PICKS, ("greedy",)),
    "avail": (AVAIL, ("seg", "picks")),
    "match": (MATCH, ("avail",)),
    "edges": (edges(0.8), ("match",)),
    "root": (ROOT, ("edges",)),
    "merged": (MERGED, ("root",)),
    "rooms": ("SELECT video_id, frame, count(*) AS capacity FROM merged GROUP BY ALL", ("merged",)),
    "rest": ("SELECT video_id, frame, capacity, least(target - diverse, sum(capacity) OVER (PARTITION BY video_id)) AS budget FROM rooms JOIN targets USING (video_id)", ("rooms",)),
    "shares": (alloc("rest"), ("rest",)),
    "pts": ("SELECT video_id, frame, token, vec, n, least(7, n) AS k, true AS valid FROM merged JOIN shares USING (video_id, frame) WHERE n > 0 AND n < capacity", ("shares",)),
    "dist0": (DIST0, ("pts",)),
    "dist": (DIST, ("dist0",)),
    "near": (NEAR, ("dist",)),
    "rho": (RHO, ("near",)),
    "delta": (DELTA, ("rho",)),
    "centre": (CENTRE, ("delta",)),
    "assign": (ASSIGN, ("centre",)),
    "means": (MEANS, ("assign",)),
    "context": (CONTEXT, ("means",)),
    "output": ("SELECT v.video_id, v.frame, v.token, v.vec FROM picks p JOIN vid v USING (video_id, frame, token) UNION ALL SELECT video_id, frame, token, vec FROM context", ("context",)),
    "filling": (
        "SELECT video_id, frame, token, vec FROM (SELECT v.*, row_number() OVER (PARTITION BY v.video_id ORDER BY v.attention DESC, v.frame, v.token) AS rk "
        "FROM vid v ANTI JOIN output o ON o.video_id = v.video_id AND o.frame = v.frame AND o.token = v.token) x "
        "JOIN (SELECT video_id, t.target - count(*) AS missing FROM output JOIN targets t USING (video_id) GROUP BY video_id, t.target) g USING (video_id) WHERE rk <= missing",
        ("output",),
    ),
    "retained": ("SELECT * FROM output UNION ALL SELECT * FROM filling", ("filling",)),
}
RECURSIVE = {"greedy", "root"}


def chain(query: str, *needs: str, **other: str) -> str:
    """query over the expressions it needs; other replaces expressions by name."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in PARTS[name][1] if name not in other or name in ("cuts", "edges") else NEEDS.get(name, PARTS[name][1]):
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    body = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({other.get(n, PARTS[n][0])})" for n in order)
    return f"WITH RECURSIVE {body}\n{query}"


#: What replaced expressions need instead.
NEEDS = {"targets": (), "pts": ("vid",), "counts": ()}


def targets(ratio: float, alpha: float) -> str:
    return f"""SELECT video_id, 20::BIGINT AS frames, 20::BIGINT AS tpf, total, target, least(target, ceil(target::DOUBLE * {alpha}::DOUBLE)::BIGINT) AS diverse FROM (
  SELECT video_id, 400::BIGINT AS total, ceil(400::DOUBLE * {ratio}::DOUBLE)::BIGINT AS target FROM {VIDEOS})"""


def compressed(ratio: float, alpha: float = 0.7) -> str:
    query = f"SELECT video_id, (frame * 20 + token)::BIGINT AS anchor, frame, token, {DIGEST} FROM "
    if ratio == 1:
        return chain(query + "vid", "vid")
    return chain(query + "retained", "retained", targets=targets(ratio, alpha))
