"""Plain numpy loops over collected small fixtures: the semantics, one round at a time."""

from __future__ import annotations

import numpy as np


def ucb_choice(A, b, t, X, alpha, d):
    a_inv = np.linalg.inv(A)
    theta = a_inv @ b
    beta = np.sqrt(d * np.log(1 + t) * np.sqrt(t) + 1)
    ucb = np.array([x @ theta + np.sqrt(t) * alpha * np.sqrt(beta * (x @ a_inv @ x)) for x in X])
    return int(np.argmax(ucb))


def user_policy(rows, d, alpha=0.03, state=None):
    """rows: iterable of (round_id, user_id, arms, rewards) -> {round_id: (choice, reward)}, state."""
    state = {} if state is None else state
    out = {}
    for rid, uid, arms, rewards in sorted(rows, key=lambda r: r[0]):
        A, b, t = state.get(uid, (np.eye(d), np.zeros(d), 0))
        X = np.asarray([np.asarray(a, dtype=float) for a in arms])
        c = ucb_choice(A, b, t, X, alpha, d)
        r = float(rewards[c])
        state[uid] = (A + np.outer(X[c], X[c]), b + r * X[c], t + 1)
        out[rid] = (c, r)
    return out, state


def buffered_agents(rows, d, alpha=0.03, as_written=False):
    """F5 with persisted t and an initially empty buffer; ``as_written``: one zero block to
    start with, dropped (with the buffer's first block) at t = 0."""
    st = {}
    out = {}
    start_buf = [(np.zeros((d, d)), np.zeros(d))] if as_written else []
    for rid, uid, arms, rewards in sorted(rows, key=lambda r: r[0]):
        cov, b, cl, bl, t, buf = st.get(uid, (np.eye(d), np.zeros(d), np.eye(d), np.zeros(d), 0, list(start_buf)))
        X = np.asarray([np.asarray(a, dtype=float) for a in arms])
        c = ucb_choice(cov, b, t, X, alpha, d)
        x, r = X[c], float(rewards[c])
        buf = buf + [(np.outer(x, x), r * x)]
        cl, bl = cl + np.outer(x, x), bl + r * x
        if as_written and t == 0:
            buf = buf[1:]
        if len(buf) * d > 4 * np.log(max(t, 1)):
            cov, b = cov + buf[0][0], b + buf[0][1]
            buf = buf[1:]
        st[uid] = (cov, b, cl, bl, t + 1, buf)
        out[rid] = (c, r)
    return out, st


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    label = {n: min((m for m in nodes if find(m) == find(n))) for n in nodes}
    order = sorted(set(label.values()))
    return {n: order.index(label[n]) for n in nodes}


def cb(t1, t2, alpha2):
    f = lambda t: np.sqrt((1 + np.log(1 + t)) / (1 + t))
    return alpha2 * (f(t1) + f(t2))
