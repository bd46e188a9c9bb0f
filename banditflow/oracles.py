"""DuckDB twins of the registered queries (``banditflow.plans.registry``).

Each string runs on DuckDB with the test tables registered as views.  Where a
query is sequential (the per-user UCB fold) the oracle is a recursive CTE
that advances every user by one round per recursion step, with rank-1
(Sherman-Morrison) inverse updates; connected components are a recursive
reachability closure.  Arithmetic expressions are generated for the fixture's
K = 5, d = 4 and written in the same association order as the Spark side.
"""

from __future__ import annotations

# The fixture rule, written out (FIXTURES.md section 3), not imported: a change on the Spark side shows.
K, D = 5, 4
ARM_STRIDE, ARM_OFFSET = 7, 101
QUARTER = 16
REWARD_CUT = 0.5
N_VECS = "(SELECT count(*) FROM embeddings)"

ALPHA, ALPHA2 = 0.03, 0.7
GRAPH_ALPHA2 = 0.2  # static graph fixture
SHARE_ALPHA2 = 0.45  # static sharing fixture
ACTIVE_MIN = 70
STAGE_L = 5000
CHUNK = 20
LIST_CHUNK = 25
R = 6


# ------------------------------------------------------------------ expression helpers
def _fold(terms: list[str]) -> str:
    """Left fold ((0.0 + t1) + t2) + ... -- the order Spark's ``aggregate`` uses."""
    acc = "0.0::DOUBLE"
    for t in terms:
        acc = f"({acc} + {t})"
    return acc


def _m(name: str, i: int, j: int, d: int = D) -> str:
    return f"{name}[{i * d + j + 1}]"


def _v(name: str, i: int) -> str:
    return f"{name}[{i + 1}]"


def _f(t: str) -> str:
    """f(t) = sqrt((1 + ln(1 + t)) / (1 + t))."""
    return f"sqrt((1.0 + ln(1.0 + ({t})::DOUBLE)) / (1.0 + ({t})::DOUBLE))"


def _cb(t1: str, t2: str, alpha2: float = ALPHA2) -> str:
    return f"({alpha2} * ({_f(t1)} + {_f(t2)}))"


def _l2(a: str, b: str, d: int = D) -> str:
    return "sqrt(" + _fold([f"(({_v(a, i)} - {_v(b, i)}) * ({_v(a, i)} - {_v(b, i)}))" for i in range(d)]) + ")"


def _dot(a: str, b: str, d: int = D) -> str:
    return _fold([f"({_v(a, i)} * {_v(b, i)})" for i in range(d)])


def _round_list(expr: str, digits: int = R) -> str:
    return f"list_transform({expr}, lambda v: round(v, {digits}))"


def _det3(m) -> str:
    return (
        f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]})"
        f" - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
        f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    )


def _solve4(a: str, b: str) -> list[str]:
    """theta = adj(A) b / det(A) for a row-major 4 x 4 ``a`` (cofactors by Laplace expansion)."""
    d = 4

    def cof(i, j):
        rows = [r for r in range(d) if r != i]
        cols = [c for c in range(d) if c != j]
        minor = [[_m(a, r, c, d) for c in cols] for r in rows]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"({sign}{_det3(minor)})"

    det = "(" + " + ".join(f"({_m(a, 0, j, d)} * {cof(0, j)})" for j in range(d)) + ")"
    # inverse[i][j] = cof(j, i) / det
    return ["((" + " + ".join(f"({cof(j, i)} * {_v(b, j)})" for j in range(d)) + f") / {det})" for i in range(d)]


def _identity(d: int = D) -> str:
    return "[" + ", ".join("1.0::DOUBLE" if i % (d + 1) == 0 else "0.0::DOUBLE" for i in range(d * d)) + "]"


def _zeros(d: int = D) -> str:
    return "[" + ", ".join(["0.0::DOUBLE"] * d) + "]"


def _mixed(key: str, seed: int = 0) -> str:
    """The seeded 31-bit hash, by lambda steps so that each value is written once."""
    p = 2147483647
    x = f"((({key}) % {p}) * 48271 + ((({key}) // {p}) % {p}) * 40014 + {seed * 69621 + 7919}) % {p}"
    for shift, times in ((15, 1664525), (13, 22695477)):
        x = f"list_transform([{x}], lambda h: (xor(h, h >> {shift}) * {times}) % {p})[1]"
    return f"list_transform([{x}], lambda h: xor(h, h >> 16))[1]"


def _random_arm(round_id: str, k: str | int = K, seed: int = 0) -> str:
    return f"CAST((({_mixed(round_id, seed)}) * {k}) >> 31 AS INTEGER)"


# ------------------------------------------------------------------ fixtures
def _vec_expr() -> str:
    quarters = [range(i * QUARTER + 1, (i + 1) * QUARTER + 1) for i in range(D)]
    return "[" + ", ".join(_fold([f"CAST(embedding[{j}] AS DOUBLE)" for j in q]) for q in quarters) + "]"


FIXTURES = f"""
vecs AS (SELECT vec_id, {_vec_expr()} AS vec FROM embeddings),
blog0 AS (
  SELECT e.event_id AS round_id, e.user_id AS user_id,
         [{", ".join(f"v{a}.vec" for a in range(K))}] AS arms
  FROM events e
  {" ".join(f"JOIN vecs v{a} ON v{a}.vec_id = (e.event_id * {ARM_STRIDE} + {a * ARM_OFFSET}) % {N_VECS}" for a in range(K))}
),
bandit_log AS (
  SELECT round_id, user_id, arms,
         list_transform(arms, lambda x: CASE WHEN x[(user_id % {D}) + 1] > {REWARD_CUT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rewards
  FROM blog0
),
n_rounds AS (SELECT count(*) AS n FROM events),
label_log AS (
  SELECT event_id AS round_id, user_id,
         [{", ".join(f"[CAST((event_id * {ARM_STRIDE} + {a * ARM_OFFSET}) % {N_VECS} AS DOUBLE)]" for a in range(K))}] AS arms,
         CAST((event_id * {ARM_STRIDE} + (user_id % {K}) * {ARM_OFFSET}) % {N_VECS} AS DOUBLE) AS label
  FROM events
),
replay_order AS (
  SELECT event_id AS pos, CAST(1 + (event_id * {ARM_STRIDE}) % (SELECT n FROM n_rounds) AS BIGINT) AS row_id FROM events
),
all_users AS (SELECT DISTINCT user_id FROM bandit_log),
user_vec AS (
  SELECT user_id,
         [{", ".join(f"sum(rewards[1] * arms[1][{i + 1}]) / count(*)" for i in range(D))}] AS theta,
         count(*) AS t
  FROM bandit_log GROUP BY user_id
),
arm0_state AS (
  SELECT user_id,
         [{", ".join(
             f"sum(arms[1][{min(i, j) + 1}] * arms[1][{max(i, j) + 1}])" + (" + 1.0" if i == j else "")
             for i in range(D) for j in range(D))}] AS A,
         [{", ".join(f"sum(rewards[1] * arms[1][{i + 1}])" for i in range(D))}] AS b,
         count(*) AS t
  FROM bandit_log GROUP BY user_id
),
arm_state1 AS (
  SELECT user_id,
         [{", ".join(
             f"sum(arms[2][{min(i, j) + 1}] * arms[2][{max(i, j) + 1}])" + (" + 1.0" if i == j else "")
             for i in range(D) for j in range(D))}] AS A,
         [{", ".join(f"sum(rewards[2] * arms[2][{i + 1}])" for i in range(D))}] AS b,
         count(*) AS t
  FROM bandit_log GROUP BY user_id
),
ridge_vec AS (SELECT user_id, [{", ".join(_solve4("A", "b"))}] AS theta, t FROM arm0_state),
ridge_vec1 AS (SELECT user_id, [{", ".join(_solve4("A", "b"))}] AS theta, t FROM arm_state1),
edges AS (
  SELECT a.user_id AS src, b.user_id AS dst
  FROM ridge_vec a JOIN ridge_vec b ON a.user_id < b.user_id
  WHERE {_l2("a.theta", "b.theta")} <= {_cb("a.t", "b.t", GRAPH_ALPHA2)}
),
und AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst AS a, src AS b FROM edges),
reach(node, lbl) AS (
  SELECT user_id, user_id FROM all_users
  UNION
  SELECT r.node, u.b FROM reach r JOIN und u ON r.lbl = u.a
),
labels AS (SELECT node AS user_id, min(lbl) AS label FROM reach GROUP BY node),
clusters AS (SELECT user_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS cluster_id FROM labels),
by_id AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS k FROM all_users),
by_key AS (
  SELECT user_id, row_number() OVER (ORDER BY {_mixed('user_id', 0)}, user_id) AS k
  FROM all_users
),
pairs AS (SELECT a.user_id AS src, b.user_id AS dst FROM by_id a JOIN by_key b USING (k)),
rand_policy AS (
  SELECT round_id, user_id, {_random_arm("round_id")} AS choice,
         rewards[{_random_arm("round_id")} + 1] AS reward,
         list_reduce(rewards, lambda a, b: a + b) / len(rewards) AS expected_reward
  FROM bandit_log
)"""


def _with(body: str, extra: str = "") -> str:
    ctes = FIXTURES + ("," + extra if extra else "")
    return f"WITH RECURSIVE {ctes}\n{body}"


# ------------------------------------------------------------------ F1 as a recursive CTE
def _f1_cte() -> str:
    """F1 over the whole log from the identity state: ``play`` (every step) and ``pol`` (decisions)."""
    return (
        f"s_init AS (SELECT user_id, {_identity()} AS ai, {_identity()} AS aa, {_zeros()} AS bb, 0::BIGINT AS t FROM all_users),"
        + _user_stage(99, "s_init", "0", "(SELECT n FROM n_rounds)")
        + """,
play AS (SELECT * FROM pu99),
pol AS (SELECT round_id, user_id, choice, reward FROM play WHERE seq > 0)"""
    )


def _curve_ctes() -> str:
    return _f1_cte() + """,
cj AS (SELECT p.round_id, p.reward AS r_policy, r.reward AS r_random FROM pol p JOIN rand_policy r USING (round_id)),
curve AS (
  SELECT round_id,
         sum(r_policy) OVER (ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_reward,
         sum(r_random) OVER (ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_random
  FROM cj
)"""


# ------------------------------------------------------------------ the oracles
def _ucb_sql() -> tuple[str, str]:
    """(scores list, frame) for the static-model UCB queries: A^-1 = I / (1 + t)."""
    d = D
    inv = [[f"(1.0 / (uv.t + 1.0))" if i == j else "(0.0 / (uv.t + 1.0))" for j in range(d)] for i in range(d)]
    scores = []
    for a in range(K):
        x = f"l.arms[{a + 1}]"
        mean = _fold([f"({x}[{i + 1}] * uv.theta[{i + 1}])" for i in range(d)])
        quad = _fold([f"({x}[{i + 1}] * {_fold([f'({inv[i][j]} * {x}[{j + 1}])' for j in range(d)])})" for i in range(d)])
        beta = f"sqrt({d}.0 * ln(1.0 + uv.t::DOUBLE) * sqrt(uv.t::DOUBLE) + 1.0)"
        scores.append(f"({mean} + ((sqrt(uv.t::DOUBLE) * {ALPHA}) * sqrt({beta} * {quad})))")
    return "[" + ", ".join(scores) + "]", "bandit_log l JOIN user_vec uv USING (user_id)"


def _static_agents() -> str:
    d = D

    def gram(arm):
        return "[" + ", ".join(
            f"sum(arms[{arm}][{min(i, j) + 1}] * arms[{arm}][{max(i, j) + 1}])" + (" + 1.0" if i == j else "")
            for i in range(d) for j in range(d)
        ) + "]"

    def mom(arm):
        return "[" + ", ".join(f"sum(rewards[{arm}] * arms[{arm}][{i + 1}])" for i in range(d)) + "]"

    th = _solve4("cov_loc", "b_loc")
    return f"""
ag0 AS (
  SELECT user_id, {gram(1)} AS cov, {mom(1)} AS b, {gram(2)} AS cov_loc, {mom(2)} AS b_loc, count(*) AS t
  FROM bandit_log GROUP BY user_id
),
agents AS (
  SELECT *, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS buf_len,
         [{", ".join(th)}] AS theta
  FROM ag0
),
cuts0 AS (
  SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
    SELECT src AS a, dst AS b FROM pairs WHERE src % 4 = 0 AND src <> dst
    UNION ALL SELECT user_id, user_id + 1 FROM all_users WHERE user_id % 5 = 0
  ) WHERE greatest(a, b) IN (SELECT user_id FROM all_users)
),
deg AS (
  SELECT u.user_id, (SELECT count(*) FROM all_users) - 1 - count(c.src) AS degree FROM all_users u
  LEFT JOIN cuts0 c ON u.user_id = c.src OR u.user_id = c.dst GROUP BY u.user_id
),
sj AS (
  SELECT x.user_id, x.cov, x.b, x.cov_loc, x.b_loc, x.buf_len, p.cov AS p_cov, p.b AS p_b, p.buf_len AS p_buf_len,
         (x.user_id <> p.user_id AND e.src IS NULL) AS has_edge,
         {_l2("x.theta", "p.theta")} >= {_cb("x.t", "p.t", SHARE_ALPHA2)} AS far,
         dx.degree = dp.degree AS same_deg
  FROM agents x JOIN pairs pr ON pr.src = x.user_id
  JOIN agents p ON p.user_id = pr.dst
  JOIN deg dx ON dx.user_id = x.user_id JOIN deg dp ON dp.user_id = p.user_id
  LEFT JOIN cuts0 e ON e.src = least(x.user_id, p.user_id) AND e.dst = greatest(x.user_id, p.user_id)
)"""


# ------------------------------------------------------------------ shared fold pieces
def _scores(ai: str, bb: str, t: str, arms: str, d: int = D) -> str:
    """UCB of the K arms from an inverse ``ai``, vector ``bb`` and count ``t`` (same order as F1)."""
    theta = [_fold([f"({_m(ai, i, j, d)} * {_v(bb, j)})" for j in range(d)]) for i in range(d)]
    out = []
    for a in range(K):
        x = f"{arms}[{a + 1}]"
        mean = _fold([f"({x}[{i + 1}] * {theta[i]})" for i in range(d)])
        quad = _fold([f"({x}[{i + 1}] * {_fold([f'({_m(ai, i, j, d)} * {x}[{j + 1}])' for j in range(d)])})" for i in range(d)])
        beta = f"sqrt({d}.0 * ln(1.0 + ({t})::DOUBLE) * sqrt(({t})::DOUBLE) + 1.0)"
        out.append(f"({mean} + sqrt(({t})::DOUBLE) * {ALPHA} * sqrt({beta} * {quad}))")
    return "[" + ", ".join(out) + "]"


def _sm(ai: str, x: str, d: int = D) -> str:
    """Sherman-Morrison: (A + x x^T)^-1 from A^-1 (symmetric)."""
    u = [_fold([f"({_m(ai, i, j, d)} * {x}[{j + 1}])" for j in range(d)]) for i in range(d)]
    den = "(1.0 + " + _fold([f"({x}[{i + 1}] * {u[i]})" for i in range(d)]) + ")"
    return "[" + ", ".join(f"({_m(ai, i, j, d)} - ({u[i]}) * ({u[j]}) / {den})" for i in range(d) for j in range(d)) + "]"


def _inverse(a: str, d: int) -> list[str]:
    return _inv4(a) if d == 4 else [f"(1.0 / {a}[1])"]  # the fixtures have 4 features or 1


def _inv4(a: str) -> list[str]:
    """Row-major inverse of a 4 x 4 ``a`` by cofactors."""
    d = 4

    def cof(i, j):
        rows = [r for r in range(d) if r != i]
        cols = [c for c in range(d) if c != j]
        minor = [[_m(a, r, c, d) for c in cols] for r in rows]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"({sign}{_det3(minor)})"

    det = "(" + " + ".join(f"({_m(a, 0, j, d)} * {cof(0, j)})" for j in range(d)) + ")"
    return [f"({cof(j, i)} / {det})" for i in range(d) for j in range(d)]


def _agent_cte() -> str:
    """F5 with persisted t and an empty start buffer; buffered blocks kept as (x, r)."""
    d = D
    blk = "STRUCT(x DOUBLE[], r DOUBLE)"
    return f"""
seqd5 AS (
  SELECT round_id, user_id, arms, rewards, row_number() OVER (PARTITION BY user_id ORDER BY round_id) AS seq FROM bandit_log
),
agent(user_id, seq, round_id, choice, reward, ai, bb, t, buf) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, {_identity()}, {_zeros()}, 0::BIGINT, []::{blk}[]
  FROM all_users
  UNION ALL
  SELECT y.user_id, y.seq, y.round_id, y.choice, y.rw,
         CASE WHEN y.pop THEN {_sm("y.ai", "y.nbuf[1].x")} ELSE y.ai END,
         CASE WHEN y.pop THEN list_transform(list_zip(y.bb, y.nbuf[1].x), lambda q: q[1] + y.nbuf[1].r * q[2]) ELSE y.bb END,
         y.t + 1,
         CASE WHEN y.pop THEN y.nbuf[2:] ELSE y.nbuf END
  FROM (
    SELECT w.*, list_append(w.buf, {{'x': w.x, 'r': w.rw}}::{blk}) AS nbuf,
           (len(w.buf) + 1) * {d} > 4.0 * ln(greatest(w.t::DOUBLE, 1.0)) AS pop
    FROM (
      SELECT p.*, p.arms[p.choice + 1] AS x, p.rewards[p.choice + 1] AS rw
      FROM (
        SELECT c.*, CAST(list_position(c.sc, list_max(c.sc)) - 1 AS INTEGER) AS choice
        FROM (
          SELECT r.user_id, s.seq, s.round_id, s.arms, s.rewards, r.ai, r.bb, r.t, r.buf,
                 {_scores("r.ai", "r.bb", "r.t", "s.arms")} AS sc
          FROM agent r JOIN seqd5 s ON s.user_id = r.user_id AND s.seq = r.seq + 1
        ) c
      ) p
    ) w
  ) y
)"""


def _cluster_policy_ctes() -> str:
    """One two-stage iteration over the whole log: F1 on the first half, graph, roll-up, F2 on the rest."""
    return _stage_one("bandit_log", "sum(s.t) / count(*)") + "," + _cluster_stage_two()


def _stage_one(src: str, ct_expr: str) -> str:
    """F1 over the first half of ``src``, user vectors, graph at alpha2, components, roll-up (ct_expr)."""
    d = D
    ident = [1.0 if i % (d + 1) == 0 else 0.0 for i in range(d * d)]
    half = "(SELECT n FROM n_rounds) // 2"
    theta = "[" + ", ".join(_fold([f"({_m('ai', i, j)} * {_v('bb', j)})" for j in range(d)]) for i in range(d)) + "]"
    return f"""
seq1 AS (
  SELECT round_id, user_id, arms, rewards, row_number() OVER (PARTITION BY user_id ORDER BY round_id) AS seq
  FROM {src} WHERE round_id < {half}
),
p1(user_id, seq, ai, aa, bb, t) AS (
  SELECT user_id, 0::BIGINT, {_identity()}, {_identity()}, {_zeros()}, 0::BIGINT FROM all_users
  UNION ALL
  SELECT q.user_id, q.seq, {_sm("q.ai", "q.x")},
         list_transform(list_zip(q.aa, {_outer("q.x")}), lambda v: v[1] + v[2]),
         list_transform(list_zip(q.bb, q.x), lambda v: v[1] + q.rw * v[2]), q.t + 1
  FROM (
    SELECT c.*, c.arms[CAST(list_position(c.sc, list_max(c.sc)) - 1 AS INTEGER) + 1] AS x,
           c.rewards[CAST(list_position(c.sc, list_max(c.sc)) - 1 AS INTEGER) + 1] AS rw
    FROM (
      SELECT r.user_id, s.seq, s.arms, s.rewards, r.ai, r.aa, r.bb, r.t, {_scores("r.ai", "r.bb", "r.t", "s.arms")} AS sc
      FROM p1 r JOIN seq1 s ON s.user_id = r.user_id AND s.seq = r.seq + 1
    ) c
  ) q
),
st1 AS (SELECT user_id, ai, aa, bb, t FROM p1 WHERE (user_id, seq) IN (SELECT user_id, max(seq) FROM p1 GROUP BY user_id)),
th1 AS (SELECT user_id, {theta} AS theta, t FROM st1),
e1 AS (
  SELECT a.user_id AS src, b.user_id AS dst FROM th1 a JOIN th1 b ON a.user_id < b.user_id
  WHERE {_l2("a.theta", "b.theta")} <= {_cb("a.t", "b.t")}
),
u1 AS (SELECT src AS a, dst AS b FROM e1 UNION ALL SELECT dst AS a, src AS b FROM e1),
reach1(node, lbl) AS (
  SELECT user_id, user_id FROM all_users
  UNION
  SELECT r.node, u.b FROM reach1 r JOIN u1 u ON r.lbl = u.a
),
cl1 AS (SELECT node AS user_id, min(lbl) AS cluster_id FROM reach1 GROUP BY node),
roll1 AS (
  SELECT c.cluster_id,
         [{", ".join(f"(sum(s.aa[{i + 1}] - {ident[i]}) + {ident[i]})" for i in range(d * d))}] AS ca,
         [{", ".join(f"sum(s.bb[{i + 1}])" for i in range(d))}] AS cb,
         {ct_expr} AS ct
  FROM st1 s JOIN cl1 c USING (user_id) GROUP BY c.cluster_id
)"""


def _cluster_stage_two() -> str:
    half = "(SELECT n FROM n_rounds) // 2"
    return f"""
cst AS (
  SELECT s.user_id, s.ai, s.bb, s.t, [{", ".join(_inv4("r.ca"))}] AS cai, r.cb AS cbb, r.ct
  FROM st1 s JOIN cl1 c USING (user_id) JOIN roll1 r USING (cluster_id)
),
seq2 AS (
  SELECT round_id, user_id, arms, rewards, row_number() OVER (PARTITION BY user_id ORDER BY round_id) AS seq
  FROM bandit_log WHERE round_id >= {half}
),
p2(user_id, seq, round_id, choice, reward, used, ai, bb, t, cai, cbb, ct) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, NULL::BOOLEAN, ai, bb, t, cai, cbb, ct FROM cst
  UNION ALL
  SELECT q.user_id, q.seq, q.round_id, q.choice, q.rw, q.used, {_sm("q.ai", "q.x")},
         list_transform(list_zip(q.bb, q.x), lambda v: v[1] + q.rw * v[2]), q.t + 1, q.cai, q.cbb, q.ct
  FROM (
    SELECT c.*, c.arms[c.choice + 1] AS x, c.rewards[c.choice + 1] AS rw
    FROM (
      SELECT g.*, CAST(list_position(g.sc, list_max(g.sc)) - 1 AS INTEGER) AS choice
      FROM (
        SELECT r.user_id, s.seq, s.round_id, s.arms, s.rewards, r.ai, r.bb, r.t, r.cai, r.cbb, r.ct,
               NOT (r.t::DOUBLE > r.ct) AS used,
               CASE WHEN r.t::DOUBLE > r.ct THEN {_scores("r.ai", "r.bb", "r.t", "s.arms")}
                    ELSE {_scores("r.cai", "r.cbb", "r.t", "s.arms")} END AS sc
        FROM p2 r JOIN seq2 s ON s.user_id = r.user_id AND s.seq = r.seq + 1
      ) g
    ) c
  ) q
)"""


def _lazy_ctes(chunk: int) -> str:
    """Lazy replay with one block: F1 warm-up on the first half (replay order), then F3 per (cluster, chunk)."""
    half = "(SELECT n FROM n_rounds) // 2"
    return f"""
rlog AS (
  SELECT o.pos AS round_id, l.user_id, l.arms, l.rewards FROM replay_order o JOIN bandit_log l ON l.round_id = o.row_id - 1
),""" + _stage_one("rlog", "CAST(sum(s.t) AS DOUBLE)") + f""",
blk AS (
  SELECT r.round_id, r.user_id, r.arms, r.rewards, c.cluster_id,
         (row_number() OVER (PARTITION BY c.cluster_id ORDER BY r.round_id) - 1) // {chunk} AS chunk
  FROM rlog r JOIN cl1 c USING (user_id) WHERE r.round_id >= {half}
),
bseq AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, chunk ORDER BY round_id) AS seq FROM blk),
p3(cluster_id, chunk, seq, round_id, user_id, choice, reward, ai, bb, t) AS (
  SELECT k.cluster_id, k.chunk, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE,
         [{", ".join(_inv4("r.ca"))}], r.cb, CAST(r.ct AS BIGINT)
  FROM (SELECT DISTINCT cluster_id, chunk FROM blk) k JOIN roll1 r USING (cluster_id)
  UNION ALL
  SELECT q.cluster_id, q.chunk, q.seq, q.round_id, q.user_id, q.choice, q.rw, {_sm("q.ai", "q.x")},
         list_transform(list_zip(q.bb, q.x), lambda v: v[1] + q.rw * v[2]), q.t + 1
  FROM (
    SELECT c.*, c.arms[c.choice + 1] AS x, c.rewards[c.choice + 1] AS rw
    FROM (
      SELECT g.*, CAST(list_position(g.sc, list_max(g.sc)) - 1 AS INTEGER) AS choice
      FROM (
        SELECT r.cluster_id, r.chunk, s.seq, s.round_id, s.user_id, s.arms, s.rewards, r.ai, r.bb, r.t,
               {_scores("r.ai", "r.bb", "r.t", "s.arms")} AS sc
        FROM p3 r JOIN bseq s ON s.cluster_id = r.cluster_id AND s.chunk = r.chunk AND s.seq = r.seq + 1
      ) g
    ) c
  ) q
)"""


def _user_stage(i: int, prev: str, lo: str, hi: str, src: str = "bandit_log", d: int = D) -> str:
    """F1 over rounds [lo, hi) of ``src`` starting from state table ``prev`` (user_id, ai, aa, bb, t)."""
    return f"""
us{i} AS (
  SELECT round_id, user_id, arms, rewards, row_number() OVER (PARTITION BY user_id ORDER BY round_id) AS seq
  FROM {src} WHERE round_id >= {lo} AND round_id < {hi}
),
pu{i}(user_id, seq, round_id, choice, reward, ai, aa, bb, t) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, ai, aa, bb, t FROM {prev}
  UNION ALL
  SELECT q.user_id, q.seq, q.round_id, q.choice, q.rw, {_sm("q.ai", "q.x", d)},
         list_transform(list_zip(q.aa, {_outer("q.x", d)}), lambda v: v[1] + v[2]),
         list_transform(list_zip(q.bb, q.x), lambda v: v[1] + q.rw * v[2]), q.t + 1
  FROM (
    SELECT c.*, c.arms[c.choice + 1] AS x, c.rewards[c.choice + 1] AS rw
    FROM (
      SELECT g.*, CAST(list_position(g.sc, list_max(g.sc)) - 1 AS INTEGER) AS choice
      FROM (
        SELECT r.user_id, s.seq, s.round_id, s.arms, s.rewards, r.ai, r.aa, r.bb, r.t,
               {_scores("r.ai", "r.bb", "r.t", "s.arms", d)} AS sc
        FROM pu{i} r JOIN us{i} s ON s.user_id = r.user_id AND s.seq = r.seq + 1
      ) g
    ) c
  ) q
),
su{i} AS (SELECT user_id, ai, aa, bb, t FROM pu{i} WHERE (user_id, seq) IN (SELECT user_id, max(seq) FROM pu{i} GROUP BY user_id))"""


def _graph_stage(i: int, users: str = "all_users", rounds: str | None = None, d: int = D) -> str:
    """theta, edges (J8 the first time, J9 after), components, roll-up, F2 inputs.

    The mean t of a cluster is over its members, or over its rounds among ``rounds`` (a FROM ... WHERE text).
    """
    mean = "sum(s.t) / count(*)"
    if rounds is not None:
        mean = f"sum(s.t) / (SELECT count(*) FROM {rounds} AND user_id IN (SELECT user_id FROM cl{i} k WHERE k.cluster_id = c.cluster_id))"
    ident = [1.0 if j % (d + 1) == 0 else 0.0 for j in range(d * d)]
    theta = "[" + ", ".join(_fold([f"({_m('ai', a, b, d)} * {_v('bb', b)})" for b in range(d)]) for a in range(d)) + "]"
    if i == 0:
        edges = f"""SELECT a.user_id AS src, b.user_id AS dst FROM th{i} a JOIN th{i} b ON a.user_id < b.user_id
  WHERE {_l2("a.theta", "b.theta", d)} <= {_cb("a.t", "b.t")}"""
    else:
        edges = f"""SELECT e.src, e.dst FROM ed{i - 1} e JOIN th{i} a ON a.user_id = e.src JOIN th{i} b ON b.user_id = e.dst
  WHERE {_l2("a.theta", "b.theta", d)} <= {_cb("a.t", "b.t")}"""
    return f"""
th{i} AS (SELECT user_id, {theta} AS theta, t FROM su{i}),
ed{i} AS ({edges}),
un{i} AS (SELECT src AS a, dst AS b FROM ed{i} UNION ALL SELECT dst AS a, src AS b FROM ed{i}),
rc{i}(node, lbl) AS (
  SELECT user_id, user_id FROM {users}
  UNION
  SELECT r.node, u.b FROM rc{i} r JOIN un{i} u ON r.lbl = u.a
),
cl{i} AS (SELECT node AS user_id, min(lbl) AS cluster_id FROM rc{i} GROUP BY node),
ro{i} AS (
  SELECT c.cluster_id,
         [{", ".join(f"(sum(s.aa[{j + 1}] - {ident[j]}) + {ident[j]})" for j in range(d * d))}] AS ca,
         [{", ".join(f"sum(s.bb[{j + 1}])" for j in range(d))}] AS cb,
         {mean} AS ct
  FROM su{i} s JOIN cl{i} c USING (user_id) GROUP BY c.cluster_id
),
ci{i} AS (
  SELECT s.user_id, s.ai, s.aa, s.bb, s.t, [{", ".join(_inverse("r.ca", d))}] AS cai, r.cb AS cbb, r.ct
  FROM su{i} s JOIN cl{i} c USING (user_id) JOIN ro{i} r USING (cluster_id)
)"""


def _cluster_stage(i: int, lo: str, hi: str, src: str = "bandit_log", d: int = D) -> str:
    """F2 over rounds [lo, hi) from ci{i}; the user's state keeps updating."""
    return f"""
cs{i} AS (
  SELECT round_id, user_id, arms, rewards, row_number() OVER (PARTITION BY user_id ORDER BY round_id) AS seq
  FROM {src} WHERE round_id >= {lo} AND round_id < {hi}
),
pc{i}(user_id, seq, round_id, choice, reward, ai, aa, bb, t, cai, cbb, ct) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, ai, aa, bb, t, cai, cbb, ct FROM ci{i}
  UNION ALL
  SELECT q.user_id, q.seq, q.round_id, q.choice, q.rw, {_sm("q.ai", "q.x", d)},
         list_transform(list_zip(q.aa, {_outer("q.x", d)}), lambda v: v[1] + v[2]),
         list_transform(list_zip(q.bb, q.x), lambda v: v[1] + q.rw * v[2]), q.t + 1, q.cai, q.cbb, q.ct
  FROM (
    SELECT c.*, c.arms[c.choice + 1] AS x, c.rewards[c.choice + 1] AS rw
    FROM (
      SELECT g.*, CAST(list_position(g.sc, list_max(g.sc)) - 1 AS INTEGER) AS choice
      FROM (
        SELECT r.user_id, s.seq, s.round_id, s.arms, s.rewards, r.ai, r.aa, r.bb, r.t, r.cai, r.cbb, r.ct,
               CASE WHEN r.t::DOUBLE > r.ct THEN {_scores("r.ai", "r.bb", "r.t", "s.arms", d)}
                    ELSE {_scores("r.cai", "r.cbb", "r.t", "s.arms", d)} END AS sc
        FROM pc{i} r JOIN cs{i} s ON s.user_id = r.user_id AND s.seq = r.seq + 1
      ) g
    ) c
  ) q
),
sc{i} AS (SELECT user_id, ai, aa, bb, t FROM pc{i} WHERE (user_id, seq) IN (SELECT user_id, max(seq) FROM pc{i} GROUP BY user_id))"""


def _two_stage_ctes(src: str = "bandit_log", mean_over: str = "members", d: int = D) -> str:
    """R1 with two iterations of L = ceil(N / 2) rounds of ``src``, control 0.5."""
    N = f"(SELECT count(*) FROM {src})"
    L = f"(({N} + 1) // 2)"
    parts = [
        f"players AS (SELECT DISTINCT user_id FROM {src})",
        f"s_init AS (SELECT user_id, {_identity(d)} AS ai, {_identity(d)} AS aa, {_zeros(d)} AS bb, 0::BIGINT AS t FROM players)",
    ]
    prev = "s_init"
    for i in range(2):
        lo, mid, hi = f"({i} * {L})", f"({i} * {L} + {L} // 2)", f"least(({i} + 1) * {L}, {N})"
        rounds = f"{src} WHERE round_id >= {mid} AND round_id < {hi}" if mean_over == "interactions" else None
        parts.append(_user_stage(i, prev, lo, mid, src, d))
        parts.append(_graph_stage(i, "players", rounds, d))
        parts.append(_cluster_stage(i, mid, hi, src, d))
        prev = f"sc{i}"
    return ",".join(parts)


def _two_stage_decisions(columns: str = "round_id, user_id, {i} AS block, '{st}' AS stage, choice, reward") -> str:
    return " UNION ALL ".join(
        f"SELECT {columns.format(i=i, st=st)} FROM {t}{i} WHERE seq > 0" for i in range(2) for t, st in (("pu", "user"), ("pc", "cluster"))
    )


def _curve_of(decisions: str, rounds: str) -> str:
    """Normalised curve of decisions (round_id, reward) over the log ``rounds``."""
    over = "OVER (ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    arm = _random_arm("l.round_id")
    return (
        f"SELECT round_id, cum_reward, cum_random, CASE WHEN cum_random <> 0 THEN round(cum_reward / cum_random, {R}) END AS ratio FROM ("
        f"SELECT round_id, sum(r_policy) {over} AS cum_reward, sum(r_random) {over} AS cum_random FROM ("
        f"SELECT l.round_id, p.reward AS r_policy, l.rewards[{arm} + 1] AS r_random FROM {rounds} l JOIN ({decisions}) p USING (round_id)))"
    )


def _lazy_graph(j: int, state: str, prev_edges: str | None) -> str:
    """theta from (aa, bb), J8 or J9, components, roll-up with the cluster's total t."""
    d = D
    ident = [1.0 if k % (d + 1) == 0 else 0.0 for k in range(d * d)]
    if prev_edges is None:
        edges = f"""SELECT a.user_id AS src, b.user_id AS dst FROM lth{j} a JOIN lth{j} b ON a.user_id < b.user_id
  WHERE {_l2("a.theta", "b.theta")} <= {_cb("a.t", "b.t")}"""
    else:
        edges = f"""SELECT e.src, e.dst FROM {prev_edges} e JOIN lth{j} a ON a.user_id = e.src JOIN lth{j} b ON b.user_id = e.dst
  WHERE {_l2("a.theta", "b.theta")} <= {_cb("a.t", "b.t")}"""
    return f"""
lth{j} AS (SELECT user_id, [{", ".join(_solve4("aa", "bb"))}] AS theta, t FROM {state}),
led{j} AS ({edges}),
lun{j} AS (SELECT src AS a, dst AS b FROM led{j} UNION ALL SELECT dst AS a, src AS b FROM led{j}),
lrc{j}(node, lbl) AS (
  SELECT user_id, user_id FROM all_users
  UNION
  SELECT r.node, u.b FROM lrc{j} r JOIN lun{j} u ON r.lbl = u.a
),
lcl{j} AS (SELECT node AS user_id, min(lbl) AS cluster_id FROM lrc{j} GROUP BY node),
lro{j} AS (
  SELECT c.cluster_id,
         [{", ".join(f"(sum(s.aa[{k + 1}] - {ident[k]}) + {ident[k]})" for k in range(d * d))}] AS ca,
         [{", ".join(f"sum(s.bb[{k + 1}])" for k in range(d))}] AS cb,
         CAST(sum(s.t) AS BIGINT) AS ct
  FROM {state} s JOIN lcl{j} c USING (user_id) GROUP BY c.cluster_id
)"""


def _lazy_block(j: int, lo: str, hi: str, chunk: int, state: str) -> str:
    """F3 over rlog rounds [lo, hi) per (cluster, chunk); deltas summed per user and merged into ``state``."""
    d = D
    return f"""
bk{j} AS (
  SELECT r.round_id, r.user_id, r.arms, r.rewards, c.cluster_id,
         (row_number() OVER (PARTITION BY c.cluster_id ORDER BY r.round_id) - 1) // {chunk} AS chunk
  FROM rlog r JOIN lcl{j} c USING (user_id) WHERE r.round_id >= {lo} AND r.round_id < {hi}
),
bq{j} AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, chunk ORDER BY round_id) AS seq FROM bk{j}),
f3{j}(cluster_id, chunk, seq, round_id, user_id, choice, reward, x, ai, bb, t) AS (
  SELECT k.cluster_id, k.chunk, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE[],
         [{", ".join(_inv4("r.ca"))}], r.cb, r.ct
  FROM (SELECT DISTINCT cluster_id, chunk FROM bk{j}) k JOIN lro{j} r USING (cluster_id)
  UNION ALL
  SELECT q.cluster_id, q.chunk, q.seq, q.round_id, q.user_id, q.choice, q.rw, q.x, {_sm("q.ai", "q.x")},
         list_transform(list_zip(q.bb, q.x), lambda v: v[1] + q.rw * v[2]), q.t + 1
  FROM (
    SELECT c.*, c.arms[c.choice + 1] AS x, c.rewards[c.choice + 1] AS rw
    FROM (
      SELECT g.*, CAST(list_position(g.sc, list_max(g.sc)) - 1 AS INTEGER) AS choice
      FROM (
        SELECT r.cluster_id, r.chunk, s.seq, s.round_id, s.user_id, s.arms, s.rewards, r.ai, r.bb, r.t,
               {_scores("r.ai", "r.bb", "r.t", "s.arms")} AS sc
        FROM f3{j} r JOIN bq{j} s ON s.cluster_id = r.cluster_id AND s.chunk = r.chunk AND s.seq = r.seq + 1
      ) g
    ) c
  ) q
),
dl{j} AS (
  SELECT user_id,
         [{", ".join(f"sum(x[{min(a, b) + 1}] * x[{max(a, b) + 1}])" for a in range(d) for b in range(d))}] AS da,
         [{", ".join(f"sum(reward * x[{a + 1}])" for a in range(d))}] AS db,
         count(*) AS dt
  FROM f3{j} WHERE seq > 0 GROUP BY user_id
),
ms{j} AS (
  SELECT s.user_id,
         CASE WHEN q.da IS NULL THEN s.aa ELSE list_transform(list_zip(s.aa, q.da), lambda v: v[1] + v[2]) END AS aa,
         CASE WHEN q.db IS NULL THEN s.bb ELSE list_transform(list_zip(s.bb, q.db), lambda v: v[1] + v[2]) END AS bb,
         s.t + coalesce(q.dt, 0) AS t
  FROM {state} s LEFT JOIN dl{j} q USING (user_id)
)"""


def _lazy_replay_ctes(chunk: int = 200) -> str:
    """R2: warm-up W = N // 3 rounds per user, then two blocks of (N - W + 1) // 2 rounds (replay order)."""
    N = "(SELECT n FROM n_rounds)"
    W = f"({N} // 3)"
    B = f"(({N} - {W} + 1) // 2)"
    parts = [
        """
rlog AS (
  SELECT o.pos AS round_id, l.user_id, l.arms, l.rewards FROM replay_order o JOIN bandit_log l ON l.round_id = o.row_id - 1
)""",
        f"s_init AS (SELECT user_id, {_identity()} AS ai, {_identity()} AS aa, {_zeros()} AS bb, 0::BIGINT AS t FROM all_users)",
        _user_stage(9, "s_init", "0", W, src="rlog"),
        _lazy_graph(0, "su9", None),
        _lazy_block(0, W, f"({W} + {B})", chunk, "su9"),
        _lazy_graph(1, "ms0", "led0"),
        _lazy_block(1, f"({W} + {B})", N, chunk, "ms0"),
    ]
    return ",".join(parts)


_BLK = "STRUCT(A DOUBLE[], b DOUBLE[])"


def _agent_block(j: int, prev: str, lo: str, hi: str, as_written: bool = False) -> str:
    """F5 over rlog rounds [lo, hi) from agent table ``prev`` (user_id, cov, b, cl, bl, t, buf); general inverse per round.

    ``as_written``: t starts again with the block, and at t = 0 the buffer's first block is dropped (Q9, Q10).
    """
    d = D
    t = "0::BIGINT" if as_written else "t"
    pushed = f"list_append(w.buf, {{'A': {_outer('w.x')}, 'b': list_transform(w.x, lambda v: w.rw * v)}}::{_BLK})"
    size = "(len(w.buf) + 1)"
    if as_written:
        pushed = f"CASE WHEN w.t = 0 THEN ({pushed})[2:] ELSE {pushed} END"
        size = "(len(w.buf) + CASE WHEN w.t = 0 THEN 0 ELSE 1 END)"
    return f"""
ga{j} AS (
  SELECT round_id, user_id, arms, rewards, row_number() OVER (PARTITION BY user_id ORDER BY round_id) AS seq
  FROM rlog WHERE round_id >= {lo} AND round_id < {hi}
),
gp{j}(user_id, seq, round_id, choice, reward, cov, b, cl, bl, t, buf) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, cov, b, cl, bl, {t}, buf FROM {prev}
  UNION ALL
  SELECT y.user_id, y.seq, y.round_id, y.choice, y.rw,
         CASE WHEN y.pop THEN list_transform(list_zip(y.cov, y.nbuf[1].A), lambda v: v[1] + v[2]) ELSE y.cov END,
         CASE WHEN y.pop THEN list_transform(list_zip(y.b, y.nbuf[1].b), lambda v: v[1] + v[2]) ELSE y.b END,
         list_transform(list_zip(y.cl, {_outer("y.x")}), lambda v: v[1] + v[2]),
         list_transform(list_zip(y.bl, y.x), lambda v: v[1] + y.rw * v[2]),
         y.t + 1,
         CASE WHEN y.pop THEN y.nbuf[2:] ELSE y.nbuf END
  FROM (
    SELECT w.*, {pushed} AS nbuf,
           {size} * {d} > 4.0 * ln(greatest(w.t::DOUBLE, 1.0)) AS pop
    FROM (
      SELECT p.*, p.arms[p.choice + 1] AS x, p.rewards[p.choice + 1] AS rw
      FROM (
        SELECT c.*, CAST(list_position(c.sc, list_max(c.sc)) - 1 AS INTEGER) AS choice
        FROM (
          SELECT v.*, {_scores("v.ai", "v.b", "v.t", "v.arms")} AS sc
          FROM (
            SELECT r.user_id, s.seq, s.round_id, s.arms, s.rewards, r.cov, r.b, r.cl, r.bl, r.t, r.buf,
                   [{", ".join(_inv4("r.cov"))}] AS ai
            FROM gp{j} r JOIN ga{j} s ON s.user_id = r.user_id AND s.seq = r.seq + 1
          ) v
        ) c
      ) p
    ) w
  ) y
),
gs{j} AS (SELECT user_id, cov, b, cl, bl, t, buf FROM gp{j} WHERE (user_id, seq) IN (SELECT user_id, max(seq) FROM gp{j} GROUP BY user_id))"""


def _share_ctes(i: int, agents: str, cuts: str | None, as_written: bool = False) -> str:
    """Sharing step ``i`` from ``agents``: gsh{i} (the new agents) and cut{i} (all pairs cut so far).

    ``as_written``: a far partner's local model is taken over, and every pair that met is cut (Q11).
    """
    local = "p" if as_written else "x"
    gone = "user_id <> p_id" if as_written else "edge AND far"
    avg = "list_transform(list_zip({a}, {b}), lambda v: (v[1] + v[2]) / 2.0)"
    avg_buf = (
        "list_transform(list_zip(x.buf, p.buf), lambda q: "
        "{'A': list_transform(list_zip(q[1].A, q[2].A), lambda v: (v[1] + v[2]) / 2.0), "
        "'b': list_transform(list_zip(q[1].b, q[2].b), lambda v: (v[1] + v[2]) / 2.0)})"
    )
    cut = "" if cuts is None else f"""
  AND NOT EXISTS (SELECT 1 FROM {cuts} c WHERE c.src = least(x.user_id, p.user_id) AND c.dst = greatest(x.user_id, p.user_id))"""
    deg = "0" if cuts is None else f"(SELECT count(*) FROM {cuts} c WHERE c.src = {{u}}.user_id OR c.dst = {{u}}.user_id)"
    earlier = "" if cuts is None else f" UNION SELECT src, dst FROM {cuts}"
    return f"""
by_key{i} AS (SELECT user_id, row_number() OVER (ORDER BY {_mixed('user_id', i)}, user_id) AS k FROM all_users),
met{i} AS (
  SELECT x.user_id, p.user_id AS p_id, x.user_id <> p.user_id{cut} AS edge,
         {_l2("tx.theta", "tp.theta")} >= {_cb("x.t", "p.t")} AS far, {deg.format(u="x")} = {deg.format(u="p")} AS equal
  FROM {agents} x JOIN by_id i ON i.user_id = x.user_id JOIN by_key{i} q ON q.k = i.k JOIN {agents} p ON p.user_id = q.user_id
  JOIN gth tx ON tx.user_id = x.user_id JOIN gth tp ON tp.user_id = p.user_id
),
gsh{i} AS (
  SELECT x.user_id,
         CASE WHEN m.edge AND m.far THEN {local}.cl WHEN m.edge AND m.equal THEN {avg.format(a="x.cov", b="p.cov")} ELSE x.cov END AS cov,
         CASE WHEN m.edge AND m.far THEN {local}.bl WHEN m.edge AND m.equal THEN {avg.format(a="x.b", b="p.b")} ELSE x.b END AS b,
         x.cl, x.bl, x.t,
         CASE WHEN m.edge AND m.far THEN []::{_BLK}[]
              WHEN m.edge AND m.equal AND len(x.buf) = len(p.buf) THEN {avg_buf} ELSE x.buf END AS buf
  FROM met{i} m JOIN {agents} x ON x.user_id = m.user_id JOIN {agents} p ON p.user_id = m.p_id
),
cut{i} AS (SELECT least(user_id, p_id) AS src, greatest(user_id, p_id) AS dst FROM met{i} WHERE {gone}{earlier})"""


def _gossip_ctes(n_shares: int = 1, as_written: bool = False) -> str:
    """R3 with two blocks of ceil(N / 2) rounds (replay order) and sharing steps between them (no cuts before)."""
    N = "(SELECT n FROM n_rounds)"
    B = f"(({N} + 1) // 2)"
    shares, agents, cuts = [], "gs0", None
    start = f"[{{'A': {_zeros(D * D)}, 'b': {_zeros()}}}]" if as_written else "[]"
    for i in range(n_shares):
        shares.append(_share_ctes(i, agents, cuts, as_written))
        agents, cuts = f"gsh{i}", f"cut{i}"
    return ",".join(
        [
            """
rlog AS (
  SELECT o.pos AS round_id, l.user_id, l.arms, l.rewards FROM replay_order o JOIN bandit_log l ON l.round_id = o.row_id - 1
)""",
            f"g_init AS (SELECT user_id, {_identity()} AS cov, {_zeros()} AS b, {_identity()} AS cl, {_zeros()} AS bl, "
            f"0::BIGINT AS t, {start}::{_BLK}[] AS buf FROM all_users)",
            _agent_block(0, "g_init", "0", B, as_written),
            f"gth AS (SELECT user_id, [{', '.join(_solve4('cl', 'bl'))}] AS theta, t FROM gs0)",
            *shares,
            _agent_block(1, agents, B, N, as_written),
        ]
    )


def _outer(x: str, d: int = D) -> str:
    return "[" + ", ".join(f"{x}[{i + 1}] * {x}[{j + 1}]" for i in range(d) for j in range(d)) + "]"


def _build() -> dict[str, str]:
    d, k = D, K
    o: dict[str, str] = {}
    flat = "flatten(arms)"
    reshaped = "[" + ", ".join(f"x[{a * d + 1}:{a * d + d}]" for a in range(k)) + "]"
    o["log_load"] = _with(
        f"SELECT f.row_id, u.user_id, {reshaped.replace('x[', 'f.x[')} AS arms, r.r AS rewards "
        "FROM feats f JOIN (SELECT round_id AS row_id, user_id FROM bandit_log) u USING (row_id) "
        "JOIN (SELECT round_id AS row_id, rewards AS r FROM bandit_log) r USING (row_id)",
        f"feats AS (SELECT round_id AS row_id, {flat} AS x FROM bandit_log)",
    )
    o["reshape_arms"] = _with(f"SELECT row_id, {reshaped} AS arms FROM (SELECT round_id AS row_id, {flat} AS x FROM bandit_log)")
    o["log_shape"] = _with(
        "SELECT CAST(min(len(arms)) AS INTEGER) AS k_min, CAST(max(len(arms)) AS INTEGER) AS k_max, "
        "CAST(min(len(arms[1])) AS INTEGER) AS d_min, CAST(max(len(arms[1])) AS INTEGER) AS d_max, count(*) AS rounds FROM bandit_log"
    )
    o["pick_reward"] = _with(
        f"SELECT round_id, CAST(round_id % {k} AS INTEGER) AS choice, arms[round_id % {k} + 1] AS x, "
        f"rewards[round_id % {k} + 1] AS reward FROM bandit_log"
    )
    hit = "CASE WHEN h[1] = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    o["label_match_reward"] = _with(
        f"SELECT round_id, {_random_arm('round_id')} AS choice, "
        f"CASE WHEN arms[{_random_arm('round_id')} + 1][1] = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, "
        f"list_reduce(list_transform(arms, lambda h: {hit}), lambda a, b: a + b) AS n_hits FROM label_log"
    )
    o["block_filter"] = _with(
        "SELECT round_id, user_id FROM bandit_log "
        "WHERE round_id >= (SELECT n FROM n_rounds) // 4 AND round_id < (SELECT n FROM n_rounds) // 2"
    )
    o["stage_assignment"] = _with(
        f"SELECT round_id, CAST(round_id // {STAGE_L} AS INTEGER) AS block, "
        f"CASE WHEN round_id % {STAGE_L} < {int(0.5 * STAGE_L)} THEN 'user' ELSE 'cluster' END AS stage FROM bandit_log"
    )
    o["round_cap"] = _with("SELECT round_id, user_id FROM bandit_log WHERE round_id < (SELECT n FROM n_rounds) * 4 // 5")
    o["active_users"] = _with(
        f"SELECT user_id, count(*) AS n_rounds FROM bandit_log GROUP BY user_id HAVING count(*) >= {ACTIVE_MIN}"
    )
    o["active_log"] = _with(
        "SELECT round_id AS orig_round, user_id, row_number() OVER (ORDER BY round_id) - 1 AS round_id "
        f"FROM bandit_log WHERE user_id IN (SELECT user_id FROM bandit_log GROUP BY user_id HAVING count(*) >= {ACTIVE_MIN})"
    )
    o["replay_order"] = _with(
        "SELECT o.pos AS round_id, o.row_id - 1 AS src_row, l.user_id FROM replay_order o JOIN bandit_log l ON l.round_id = o.row_id - 1"
    )
    o["user_index"] = _with(
        "SELECT l.round_id, i.user_idx FROM bandit_log l JOIN "
        "(SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM all_users) i USING (user_id)"
    )
    o["user_count"] = _with("SELECT count(DISTINCT user_id) AS n_users, count(*) AS n_rounds FROM bandit_log")
    o["user_seq"] = _with(
        "SELECT round_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY round_id) - 1 AS seq FROM bandit_log"
    )
    o["rounds_by_user"] = _with(
        "SELECT user_id, count(*) AS n_rounds, min(round_id) AS first_round, max(round_id) AS last_round FROM bandit_log GROUP BY user_id"
    )
    o["round_lists"] = _with(
        "SELECT user_id, chunk, list(round_id ORDER BY round_id) AS round_ids FROM ("
        f"SELECT round_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY round_id) - 1) // {LIST_CHUNK} AS chunk FROM bandit_log"
        ") GROUP BY user_id, chunk"
    )
    o["csv_log_load"] = _with(
        "SELECT row_number() OVER (ORDER BY round_id) - 1 AS round_id, user_id, arms, rewards "
        f"FROM bandit_log WHERE user_id IN (SELECT user_id FROM bandit_log GROUP BY user_id HAVING count(*) >= {ACTIVE_MIN})"
    )
    o["skew_split"] = _with(
        f"SELECT round_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY round_id) - 1) // {CHUNK} AS chunk FROM bandit_log"
    )
    o["cold_log"] = _with(
        "SELECT row_number() OVER (ORDER BY round_id) - 1 AS round_id, user_id FROM bandit_log "
        "WHERE user_id % 5 <> 0 OR round_id >= (SELECT n FROM n_rounds) * 3 // 4"
    )
    o["gram_matrix"] = _with(f"SELECT user_id, {_round_list('A')} AS A FROM arm0_state")
    o["reward_moment"] = _with(f"SELECT user_id, {_round_list('b')} AS b, t FROM arm0_state")

    def half_state(cond: str, ident: bool) -> str:
        a = ", ".join(
            f"sum(arms[1][{min(i, j) + 1}] * arms[1][{max(i, j) + 1}])" + (" + 1.0" if (i == j and ident) else "")
            for i in range(d) for j in range(d)
        )
        b = ", ".join(f"sum(rewards[1] * arms[1][{i + 1}])" for i in range(d))
        return f"SELECT user_id, [{a}] AS A, [{b}] AS b, count(*) AS t FROM bandit_log WHERE {cond} GROUP BY user_id"

    half = "(SELECT n FROM n_rounds) // 2"
    o["wide_state"] = _with(
        "SELECT a.user_id, a.A, b.b, b.t FROM (SELECT user_id, list(v ORDER BY i, j) AS A FROM ("
        "SELECT user_id, i, j, round(sum(x[i] * x[j]) + (CASE WHEN i = j THEN 1.0 ELSE 0.0 END), 4) AS v "
        "FROM wide, range(1, 65) p(i), range(1, 65) q(j) GROUP BY user_id, i, j) GROUP BY user_id) a JOIN ("
        "SELECT user_id, list(v ORDER BY i) AS b, any_value(t) AS t FROM ("
        "SELECT user_id, i, round(sum(r * x[i]), 4) AS v, count(*) AS t FROM wide, range(1, 65) p(i) GROUP BY user_id, i) GROUP BY user_id) b "
        "USING (user_id)",
        f"wide AS (SELECT l.user_id, l.rewards[1] AS r, list_transform(e.embedding, lambda v: v::DOUBLE) AS x "
        f"FROM bandit_log l JOIN embeddings e ON e.vec_id = (l.round_id * {ARM_STRIDE}) % {N_VECS})",
    )
    o["merge_state"] = _with(
        "SELECT coalesce(s.user_id, q.user_id) AS user_id, "
        f"{_round_list(f'CASE WHEN q.A IS NULL THEN coalesce(s.A, {_identity()}) ELSE list_transform(list_zip(coalesce(s.A, {_identity()}), q.A), lambda p: p[1] + p[2]) END')} AS A, "
        f"{_round_list(f'CASE WHEN q.b IS NULL THEN coalesce(s.b, {_zeros()}) ELSE list_transform(list_zip(coalesce(s.b, {_zeros()}), q.b), lambda p: p[1] + p[2]) END')} AS b, "
        "coalesce(s.t, 0) + coalesce(q.t, 0) AS t "
        "FROM s1 s FULL OUTER JOIN s2 q USING (user_id)",
        f"s1 AS ({half_state(f'round_id < {half}', True)}), s2 AS ({half_state(f'round_id >= {half}', False)})",
    )
    o["grouped_ridge"] = _with(f"SELECT user_id, {_round_list('[' + ', '.join(_solve4('A', 'b')) + ']')} AS theta FROM arm0_state")
    o["similar_users"] = _with("SELECT src, dst FROM edges")
    o["prune_edges"] = _with(
        "SELECT e.src, e.dst FROM edges e JOIN ridge_vec1 a ON a.user_id = e.src JOIN ridge_vec1 b ON b.user_id = e.dst "
        f"WHERE {_l2('a.theta', 'b.theta')} <= {_cb('a.t', 'b.t', GRAPH_ALPHA2)}"
    )
    o["user_clusters"] = _with("SELECT user_id, cluster_id FROM clusters")
    o["degree"] = _with(
        "SELECT u.user_id, CAST(coalesce(c.n, 0) AS BIGINT) AS degree FROM all_users u "
        "LEFT JOIN (SELECT a AS user_id, count(*) AS n FROM und GROUP BY a) c USING (user_id)"
    )
    o["cluster_counts"] = _with(
        "SELECT count(DISTINCT cluster_id) AS n_clusters, (SELECT count(*) FROM edges) AS n_edges FROM clusters"
    )
    o["round_cluster"] = _with("SELECT l.round_id, l.user_id, c.cluster_id FROM bandit_log l JOIN clusters c USING (user_id)")
    o["cluster_block_counts"] = _with(
        "SELECT c.cluster_id, count(*) AS block_rounds FROM bandit_log l JOIN clusters c USING (user_id) GROUP BY c.cluster_id"
    )
    ident = [1.0 if i % (d + 1) == 0 else 0.0 for i in range(d * d)]
    roll_a = "[" + ", ".join(f"(sum(s.A[{i + 1}] - {ident[i]}) + {ident[i]})" for i in range(d * d)) + "]"
    roll_b = "[" + ", ".join(f"sum(s.b[{i + 1}])" for i in range(d)) + "]"
    o["cluster_rollup"] = _with(
        f"SELECT r.cluster_id, {_round_list('r.A')} AS A, {_round_list('r.b')} AS b, r.t, r.members, "
        "round(r.t / bc.block_rounds, 6) AS mean_t FROM roll r JOIN bc USING (cluster_id)",
        f"roll AS (SELECT c.cluster_id, {roll_a} AS A, {roll_b} AS b, CAST(sum(s.t) AS BIGINT) AS t, count(*) AS members "
        "FROM arm0_state s JOIN clusters c USING (user_id) GROUP BY c.cluster_id), "
        "bc AS (SELECT c.cluster_id, count(*) AS block_rounds FROM bandit_log l JOIN clusters c USING (user_id) GROUP BY c.cluster_id)",
    )
    o["partner_pairs"] = _with("SELECT src, dst FROM pairs")
    o["cut_edges"] = _with(
        "SELECT e.src, e.dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM pairs p "
        "WHERE least(p.src, p.dst) = e.src AND greatest(p.src, p.dst) = e.dst)"
    )
    sc, frame = _ucb_sql()
    o["best_arm"] = _with(f"SELECT round_id, CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) AS choice FROM (SELECT l.round_id, {sc} AS sc FROM {frame})")
    o["ucb_scores"] = _with(f"SELECT l.round_id, {_round_list(sc)} AS scores FROM {frame}")
    o["dot_product"] = _with(f"SELECT l.round_id, round({_dot('l.arms[1]', 'uv.theta')}, {R}) AS dot FROM {frame}")
    o["outer_product"] = _with(
        "SELECT round_id, " + _round_list("[" + ", ".join(f"arms[1][{i + 1}] * arms[1][{j + 1}]" for i in range(d) for j in range(d)) + "]")
        + " AS xx FROM bandit_log"
    )
    o["l2_distance"] = _with(f"SELECT round_id, round({_l2('arms[1]', 'arms[2]')}, {R}) AS dist FROM bandit_log")
    o["cluster_bound"] = _with(
        f"SELECT p.src, p.dst, round({_cb('a.t', 'b.t')}, {R}) AS cb FROM pairs p "
        "JOIN user_vec a ON a.user_id = p.src JOIN user_vec b ON b.user_id = p.dst"
    )
    o["buffer_threshold"] = _with(
        f"SELECT round_id, round(4.0 * ln(greatest(CAST(seq AS DOUBLE), 1.0)), {R}) AS thresh FROM "
        "(SELECT round_id, row_number() OVER (PARTITION BY user_id ORDER BY round_id) - 1 AS seq FROM bandit_log)"
    )
    o["state_average"] = _with(
        "SELECT p.src, p.dst, "
        + _round_list("[" + ", ".join(f"(a.theta[{i + 1}] + b.theta[{i + 1}]) / 2.0" for i in range(d)) + "]")
        + " AS avg_theta FROM pairs p JOIN user_vec a ON a.user_id = p.src JOIN user_vec b ON b.user_id = p.dst"
    )
    o["fifo_buffer"] = _with(
        f"SELECT round_id, 2 AS size, {_round_list('arms[2]')} AS peek_b, {_round_list('arms[1]')} AS popped_b, 0 AS size_after FROM bandit_log"
    )
    o["random_policy"] = _with(f"SELECT round_id, user_id, choice, reward, round(expected_reward, {R}) AS expected_reward FROM rand_policy")
    o["cum_reward"] = _with(
        "SELECT round_id, sum(reward) OVER (ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_random FROM rand_policy"
    )
    o["user_policy"] = _with("SELECT round_id, user_id, choice, reward FROM pol", _f1_cte())
    o["user_state"] = _with(
        f"SELECT user_id, {_round_list('aa', 4)} AS A, {_round_list('bb', 4)} AS b, t FROM play "
        "WHERE seq > 0 AND (user_id, seq) IN (SELECT user_id, max(seq) FROM play GROUP BY user_id)",
        _f1_cte(),
    )
    o["normalised_curve"] = _with(
        f"SELECT round_id, cum_reward, cum_random, CASE WHEN cum_random <> 0 THEN round(cum_reward / cum_random, {R}) END AS ratio FROM curve",
        _curve_ctes(),
    )
    o["normalised_total"] = _with(
        "SELECT round(sum(CASE WHEN cum_random <> 0 THEN cum_reward / cum_random END), 4) AS normalised_total FROM curve",
        _curve_ctes(),
    )
    o["policy_totals"] = _with(
        f"SELECT stage, CAST(round_id // {STAGE_L} AS INTEGER) AS block, sum(reward) AS total_reward, count(*) AS rounds FROM "
        "(SELECT round_id, reward, 'user' AS stage FROM pol UNION ALL SELECT round_id, reward, 'random' AS stage FROM rand_policy) "
        "GROUP BY ALL",
        _f1_cte(),
    )
    o["share_step"] = _with(
        "SELECT user_id, "
        f"{_round_list(f'CASE WHEN has_edge AND far THEN cov_loc WHEN has_edge AND same_deg THEN list_transform(list_zip(cov, p_cov), lambda q: (q[1] + q[2]) / 2.0) ELSE cov END')} AS cov, "
        f"{_round_list(f'CASE WHEN has_edge AND far THEN b_loc WHEN has_edge AND same_deg THEN list_transform(list_zip(b, p_b), lambda q: (q[1] + q[2]) / 2.0) ELSE b END')} AS b, "
        "CAST(CASE WHEN has_edge AND far THEN 0 ELSE buf_len END AS INTEGER) AS buf_len, "
        "has_edge AND far AS reset, has_edge AND NOT far AND same_deg AS averaged FROM sj",
        _static_agents(),
    )
    o["long_chain_components"] = _with(
        "SELECT user_id, dense_rank() OVER (ORDER BY low) - 1 AS cluster_id FROM ("
        "SELECT user_id, min(user_id) OVER (PARTITION BY k // 70) AS low FROM ("
        f"SELECT user_id, row_number() OVER (ORDER BY {_mixed('user_id', 3)}, user_id) - 1 AS k FROM all_users))"
    )
    o["agent_policy"] = _with("SELECT round_id, user_id, choice, reward FROM agent WHERE seq > 0", _agent_cte())
    o["cluster_policy"] = _with(
        "SELECT round_id, user_id, choice, reward, used AS cluster_used FROM p2 WHERE seq > 0", _cluster_policy_ctes()
    )
    o["two_stage_replay"] = _with(_two_stage_decisions(), _two_stage_ctes())
    used = "round_id, user_id, {i} AS block, '{st}' AS stage, choice, reward"
    cold = (
        "cold AS (SELECT row_number() OVER (ORDER BY round_id) - 1 AS round_id, user_id, arms, rewards FROM bandit_log "
        "WHERE user_id % 5 <> 0 OR round_id >= (SELECT n FROM n_rounds) * 3 // 4),"
    )
    o["two_stage_interactions"] = _with(_two_stage_decisions(used), cold + _two_stage_ctes("cold", "interactions"))
    labelled = (
        "labelled AS (SELECT round_id, user_id, arms, list_transform(arms, lambda x: CASE WHEN x[1] = label THEN 1.0::DOUBLE "
        "ELSE 0.0::DOUBLE END) AS rewards FROM label_log),"
    )
    o["two_stage_label"] = _with(_two_stage_decisions(used), labelled + _two_stage_ctes("labelled", "members", 1))
    o["two_stage_curve"] = _with(_curve_of(_two_stage_decisions("round_id, reward"), "bandit_log"), _two_stage_ctes())
    lazy = " UNION ALL ".join(f"SELECT round_id, reward FROM {t} WHERE seq > 0" for t in ("pu9", "f30", "f31"))
    o["lazy_curve"] = _with(_curve_of(lazy, "rlog"), _lazy_replay_ctes(200))
    gossip = " UNION ALL ".join(f"SELECT round_id, reward FROM gp{i} WHERE seq > 0" for i in range(2))
    o["gossip_curve"] = _with(_curve_of(gossip, "rlog"), _gossip_ctes())
    o["gossip_two_shares"] = _with(
        "SELECT round_id, user_id, 0 AS block, choice, reward FROM gp0 WHERE seq > 0 UNION ALL "
        "SELECT round_id, user_id, 1 AS block, choice, reward FROM gp1 WHERE seq > 0",
        _gossip_ctes(2),
    )
    o["gossip_as_written"] = _with(
        "SELECT round_id, user_id, 0 AS block, choice, reward FROM gp0 WHERE seq > 0 UNION ALL "
        "SELECT round_id, user_id, 1 AS block, choice, reward FROM gp1 WHERE seq > 0",
        _gossip_ctes(2, True),
    )
    B, all_pairs = "((SELECT n FROM n_rounds) + 1) // 2", "((SELECT count(*) FROM all_users) * ((SELECT count(*) FROM all_users) - 1) // 2)"
    o["gossip_cluster_counts"] = _with(
        f"SELECT 0 AS block, 0::BIGINT AS from_round, CAST({B} AS BIGINT) AS to_round, 1::BIGINT AS n_clusters, CAST({all_pairs} AS BIGINT) AS n_edges "
        f"UNION ALL SELECT 1, CAST({B} AS BIGINT), (SELECT n FROM n_rounds), (SELECT count(DISTINCT label) FROM glab), "
        f"CAST({all_pairs} - (SELECT count(*) FROM cut1) AS BIGINT)",
        _gossip_ctes(2) + """,
gund AS (
  SELECT x.user_id AS a, y.user_id AS b FROM all_users x JOIN all_users y ON x.user_id <> y.user_id
  WHERE NOT EXISTS (SELECT 1 FROM cut1 c WHERE c.src = least(x.user_id, y.user_id) AND c.dst = greatest(x.user_id, y.user_id))
),
greach(node, lbl) AS (
  SELECT user_id, user_id FROM all_users UNION SELECT r.node, u.b FROM greach r JOIN gund u ON r.lbl = u.a
),
glab AS (SELECT node, min(lbl) AS label FROM greach GROUP BY node)""",
    )
    o["lazy_replay"] = _with(
        "SELECT round_id, user_id, 0 AS block, 'user' AS stage, choice, reward FROM pu9 WHERE seq > 0 UNION ALL "
        "SELECT round_id, user_id, 1 AS block, 'cluster' AS stage, choice, reward FROM f30 WHERE seq > 0 UNION ALL "
        "SELECT round_id, user_id, 2 AS block, 'cluster' AS stage, choice, reward FROM f31 WHERE seq > 0",
        _lazy_replay_ctes(200),
    )
    o["gossip_replay"] = _with(
        "SELECT round_id, user_id, 0 AS block, choice, reward FROM gp0 WHERE seq > 0 UNION ALL "
        "SELECT round_id, user_id, 1 AS block, choice, reward FROM gp1 WHERE seq > 0",
        _gossip_ctes(),
    )
    L = "((SELECT n FROM n_rounds) + 1) // 2"
    o["two_stage_cluster_counts"] = _with(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS block, CAST({i} * {L} AS BIGINT) AS from_round, "
            f"CAST(least(({i} + 1) * {L}, (SELECT n FROM n_rounds)) AS BIGINT) AS to_round, "
            f"(SELECT count(DISTINCT cluster_id) FROM cl{i}) AS n_clusters, (SELECT count(*) FROM ed{i}) AS n_edges"
            for i in range(2)
        ),
        _two_stage_ctes(),
    )
    o["two_stage_user_state"] = _with(
        f"SELECT user_id, {_round_list('aa', 4)} AS A, {_round_list('bb', 4)} AS b, t FROM sc1", _two_stage_ctes()
    )
    o["stream_replay"] = o["user_policy"]  # the streamed block loop equals the batch fold
    o["stream_two_stage"] = o["two_stage_replay"]  # the same two iterations, fed by a stream
    o["lazy_cluster_policy"] = _with("SELECT round_id, user_id, choice, reward FROM p3 WHERE seq > 0", _lazy_ctes(200))
    return o


ORACLES: dict[str, str] = _build()
