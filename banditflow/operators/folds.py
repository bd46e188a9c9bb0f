"""Keyed sequential folds: ordered inside a key, parallel across keys.

Plan shape (a secondary sort, no grouped collect):

    state rows (_kind 0) UNION round rows (_kind 1)
      -> repartition(key)                     one hash shuffle on the key
      -> sortWithinPartitions(key, _kind, order)   external sort, spills
      -> mapInArrow(runner)                   streams Arrow batches

The runner keeps only the open key's state between batches, so memory is
bounded by the batch size whatever the size of a key; a key's rounds never
have to fit in memory at once.  Inside a batch all keys advance in lockstep
(round s of every key at once), so the per-round numpy work is vectorised
across keys (matrix products over keys x arms), not a Python loop per row.  A^-1
is solved when a state is loaded and then carried beside A by rank-1 updates
(O(d^2) a round); an error test and a periodic fresh solve keep it exact.

The fold emits decision rows (_kind 1) and the final state of every key that
appeared (_kind 0) in one output; ``run_fold`` writes it once and splits
it, so the fold never runs twice.  Keys with state but no rounds pass through
unchanged, so the output state is the merged (upserted) state table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.session import materialize

DOUBLE_ARRAY = T.ArrayType(T.DoubleType(), True)
BUF_TYPE = T.ArrayType(
    T.StructType([T.StructField("A", DOUBLE_ARRAY, True), T.StructField("b", DOUBLE_ARRAY, True)]), True
)


# ----------------------------------------------------------------------------- arrow helpers
def _np(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.to_numpy(zero_copy_only=False))


def _flat_values(arr: pa.Array, depth: int) -> np.ndarray:
    a = arr
    for _ in range(depth):
        a = a.flatten()
    return _np(a).astype(np.float64, copy=False)


def _list_array(values: np.ndarray, width: int) -> pa.Array:
    n = values.shape[0]
    flat = np.ascontiguousarray(values, dtype=np.float64).reshape(-1)
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.float64()))


# ----------------------------------------------------------------------------- kernels
#: Updates after which a carried inverse is tested, and after which it is solved afresh in any case.
TEST_EVERY, SOLVE_EVERY = 16, 512
#: Greatest residual of A (A^-1 x) - x, relative to x, that a carried inverse may show.
RESIDUAL = 1e-10


class FoldKernel:
    """One sequential policy.  Subclasses define state and one vectorised step."""

    #: state field -> trailing shape, e.g. {"A": (d, d), "b": (d,), "t": ()}
    state_shapes: dict[str, tuple[int, ...]] = {}
    #: read-only per-key fields joined onto the state row (not emitted)
    static_shapes: dict[str, tuple[int, ...]] = {}
    #: matrix field -> its inverse, kept in memory beside it and never emitted
    inverses: dict[str, str] = {}
    #: the inverse that rank-1 updates move along, and its matrix
    moving = ("A", "Ai")

    def __init__(self, d: int, k: int, alpha: float, reward: str = "matrix"):
        self.d, self.k, self.alpha, self.reward = d, k, alpha, reward

    # state <-> arrow ------------------------------------------------------
    def default_state(self, n: int) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def state_from_rows(self, batch: pa.RecordBatch, rows: np.ndarray, st: dict, dest: np.ndarray) -> None:
        """Fill st[*][dest] from the state rows ``rows`` of ``batch``."""
        for name, shape in {**self.state_shapes, **self.static_shapes}.items():
            if name not in batch.schema.names:
                continue
            col = batch.column(name).take(pa.array(rows))
            valid = ~np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            if not valid.any():
                continue  # NULL state fields keep their defaults
            col = col.filter(pa.array(valid))
            target = dest[valid]
            if shape == ():
                vals = _np(col)
                if vals.dtype.kind == "f":
                    vals = np.where(np.isnan(vals), st[name][target], vals)
                st[name][target] = vals
            else:
                st[name][target] = _flat_values(col, 1).reshape((len(target),) + shape)

    # inverses ---------------------------------------------------------------
    def with_inverses(self, st: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
        """Adds the inverses of a default state (identity matrices) and the age of the moving one."""
        for inverse in self.inverses.values():
            st[inverse] = np.repeat(np.eye(self.d)[None], n, axis=0)
        st["age"] = np.zeros(n, dtype=np.int64)
        return st

    def solve(self, st: dict, dest: np.ndarray) -> None:
        """Fresh inverses of the keys ``dest``: after their state was loaded."""
        for matrix, inverse in self.inverses.items():
            st[inverse][dest] = np.linalg.inv(st[matrix][dest])
        st["age"][dest] = 0

    def rank_one(self, st: dict, ki: np.ndarray, x: np.ndarray) -> None:
        """The moving matrix has gained x x^T: its inverse follows (Sherman-Morrison).

        Every ``TEST_EVERY`` updates the new inverse has to take A^-1 x back to x; keys that fail, and keys
        with ``SOLVE_EVERY`` updates since their last solve, are solved afresh.
        """
        matrix, inverse = self.moving
        inv = st[inverse][ki]
        u = np.matmul(inv, x[:, :, None])[:, :, 0]
        gain = 1.0 + np.einsum("ni,ni->n", x, u)
        inv = inv - u[:, :, None] * (u / gain[:, None])[:, None, :]
        st[inverse][ki] = inv
        age = st["age"][ki] + 1
        st["age"][ki] = age
        due = age % TEST_EVERY == 0
        if due.any():
            rows = np.flatnonzero(due)
            v = x[rows][:, :, None]
            left = np.matmul(st[matrix][ki[rows]], np.matmul(inv[rows], v)) - v
            size = np.abs(v).max(axis=(1, 2), initial=0.0)
            stale = (np.abs(left).max(axis=(1, 2)) > RESIDUAL * np.maximum(size, 1.0)) | (age[rows] >= SOLVE_EVERY)
            if stale.any():
                again = ki[rows[stale]]
                st[inverse][again] = np.linalg.inv(st[matrix][again])
                st["age"][again] = 0

    def state_columns(self, st: dict, idx: np.ndarray) -> dict[str, pa.Array]:
        out = {}
        for name, shape in self.state_shapes.items():
            v = st[name][idx]
            if shape == ():
                out[name] = pa.array(v.astype(np.int64) if name == "t" else v)
            else:
                out[name] = _list_array(v.reshape(len(idx), -1), int(np.prod(shape)))
        return out

    def state_spark_fields(self) -> list[T.StructField]:
        fields = []
        for name, shape in self.state_shapes.items():
            typ = T.LongType() if shape == () else DOUBLE_ARRAY
            fields.append(T.StructField(name, typ, True))
        return fields

    # decisions ------------------------------------------------------------
    def scores(self, a_inv: np.ndarray, b: np.ndarray, t: np.ndarray, X: np.ndarray) -> np.ndarray:
        """UCB of all K arms for n keys at once: x^T theta + sqrt(t) a sqrt(beta x^T A^-1 x)."""
        theta = np.matmul(a_inv, b[:, :, None])
        mean = np.matmul(X, theta)[:, :, 0]
        quad = (np.matmul(X, a_inv) * X).sum(axis=2)
        tf = t.astype(np.float64)
        beta = np.sqrt(self.d * np.log1p(tf) * np.sqrt(tf) + 1.0)
        width = (np.sqrt(tf) * self.alpha)[:, None] * np.sqrt(beta[:, None] * quad)
        return mean + width

    def choose(self, ucb: np.ndarray, X: np.ndarray, rows: dict, ri: np.ndarray):
        choice = np.argmax(ucb, axis=1)  # first maximum on ties
        n = len(choice)
        x = X[np.arange(n), choice]
        if self.reward == "label":
            reward = (x[:, 0] == rows["label"][ri]).astype(np.float64)
        else:
            reward = rows["rewards"][ri][np.arange(n), choice]
        return choice, reward, x

    def step(self, st: dict, ki: np.ndarray, X: np.ndarray, rows: dict, ri: np.ndarray):
        raise NotImplementedError


class UserUCB(FoldKernel):
    """per user, theta = A^-1 b, UCB over the K arms, pick, A += x x^T, b += r x, t += 1."""

    def __init__(self, d, k, alpha, reward="matrix"):
        super().__init__(d, k, alpha, reward)
        self.state_shapes = {"A": (d, d), "b": (d,), "t": ()}
        self.inverses = {"A": "Ai"}

    def default_state(self, n):
        return self.with_inverses({
            "A": np.repeat(np.eye(self.d)[None], n, axis=0),
            "b": np.zeros((n, self.d)),
            "t": np.zeros(n, dtype=np.int64),
        }, n)

    def learn(self, st, ki, reward, x):
        st["A"][ki] += x[:, :, None] * x[:, None, :]
        st["b"][ki] += reward[:, None] * x
        st["t"][ki] += 1
        self.rank_one(st, ki, x)

    def step(self, st, ki, X, rows, ri):
        choice, reward, x = self.choose(self.scores(st["Ai"][ki], st["b"][ki], st["t"][ki], X), X, rows, ri)
        self.learn(st, ki, reward, x)
        return choice, reward, x


class ClusterUCB(UserUCB):
    """like F1, but decide with the frozen cluster model while t_user <= cluster mean t.

    beta and the width use t_user either way; only the user's state is updated,
    so the switch may flip inside a block.
    """

    def __init__(self, d, k, alpha, reward="matrix"):
        super().__init__(d, k, alpha, reward)
        self.static_shapes = {"cA": (d, d), "cb": (d,), "ct": ()}
        self.inverses = {"A": "Ai", "cA": "cAi"}

    def default_state(self, n):
        st = super().default_state(n)
        st["cA"] = np.repeat(np.eye(self.d)[None], n, axis=0)
        st["cb"] = np.zeros((n, self.d))
        st["ct"] = np.full(n, -np.inf)  # no cluster row: always the user's own model
        return st

    def step(self, st, ki, X, rows, ri):
        t = st["t"][ki]
        own = t.astype(np.float64) > st["ct"][ki]
        inv = np.where(own[:, None, None], st["Ai"][ki], st["cAi"][ki])
        b = np.where(own[:, None], st["b"][ki], st["cb"][ki])
        choice, reward, x = self.choose(self.scores(inv, b, t, X), X, rows, ri)
        self.learn(st, ki, reward, x)
        self.last_used = ~own
        return choice, reward, x


class ClusterSequentialUCB(UserUCB):
    """one running cluster model per (cluster, chunk); every round updates it.

    The state row carries the cluster roll-up (A, b, t); decisions carry the
    chosen vector and reward, from which the per-user deltas are summed (A10).
    """


class BufferedAgent(FoldKernel):
    """decide on (cov, b); push (x x^T, r x) to a FIFO buffer; local model updated at once;
    move the oldest block into (cov, b) when d * len(buf) > 4 ln(max(t, 1)) (one per round).

    ``drop_first_at_t0`` restores the as-written form: the buffer starts with one
    zero block and, at t = 0, the first block is dropped.
    """

    def __init__(self, d, k, alpha, reward="matrix", drop_first_at_t0=False):
        super().__init__(d, k, alpha, reward)
        self.drop_first_at_t0 = drop_first_at_t0
        self.state_shapes = {"cov": (d, d), "b": (d,), "cov_loc": (d, d), "b_loc": (d,), "t": ()}
        self.inverses = {"cov": "covi"}
        self.moving = ("cov", "covi")

    def default_state(self, n):
        d = self.d
        cap = 4
        st = {
            "cov": np.repeat(np.eye(d)[None], n, axis=0),
            "b": np.zeros((n, d)),
            "cov_loc": np.repeat(np.eye(d)[None], n, axis=0),
            "b_loc": np.zeros((n, d)),
            "t": np.zeros(n, dtype=np.int64),
            "bufA": np.zeros((n, cap, d, d)),
            "bufb": np.zeros((n, cap, d)),
            "blen": np.zeros(n, dtype=np.int64),
        }
        if self.drop_first_at_t0:
            st["blen"][:] = 1  # one zero block to start with
        return self.with_inverses(st, n)

    def state_from_rows(self, batch, rows, st, dest):
        super().state_from_rows(batch, rows, st, dest)
        col = batch.column("buf").take(pa.array(rows))
        lens = _np(col.value_lengths()).astype(np.int64)
        lens = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, lens)
        self._ensure_cap(st, int(lens.max(initial=0)) + 1)
        d = self.d
        structs = col.flatten()
        a_vals = _flat_values(structs.field("A"), 1).reshape(-1, d, d)
        b_vals = _flat_values(structs.field("b"), 1).reshape(-1, d)
        pos = 0
        for j, n_blk in zip(dest, lens):
            st["blen"][j] = n_blk
            st["bufA"][j, :n_blk] = a_vals[pos : pos + n_blk]
            st["bufb"][j, :n_blk] = b_vals[pos : pos + n_blk]
            pos += n_blk

    def state_columns(self, st, idx):
        out = super().state_columns(st, idx)
        d = self.d
        lens = st["blen"][idx]
        a_blocks = np.concatenate([st["bufA"][j, : lens[i]] for i, j in enumerate(idx)] or [np.zeros((0, d, d))])
        b_blocks = np.concatenate([st["bufb"][j, : lens[i]] for i, j in enumerate(idx)] or [np.zeros((0, d))])
        structs = pa.StructArray.from_arrays(
            [_list_array(a_blocks.reshape(-1, d * d), d * d), _list_array(b_blocks, d)], names=["A", "b"]
        )
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        out["buf"] = pa.ListArray.from_arrays(pa.array(offsets), structs)
        return out

    def state_spark_fields(self):
        return super().state_spark_fields() + [T.StructField("buf", BUF_TYPE, True)]

    def _follow(self, st, sel, block):
        """The inverse follows a block that joins cov: a rank-1 update where the block is some x x^T, a solve
        where it is not (the average of two blocks)."""
        n = np.arange(len(sel))
        top = np.einsum("nii->ni", block).argmax(axis=1)
        size = np.sqrt(np.maximum(block[n, top, top], 0.0))
        x = np.where(size[:, None] > 0, block[n, top] / np.where(size > 0, size, 1.0)[:, None], 0.0)
        rest = np.abs(block - x[:, :, None] * x[:, None, :]).max(axis=(1, 2))
        plain = rest <= 1e-14 * np.maximum(size * size, 1e-300)
        if plain.any():
            self.rank_one(st, sel[plain], x[plain])
        if not plain.all():
            self.solve(st, sel[~plain])

    @staticmethod
    def _ensure_cap(st, need):
        cap = st["bufA"].shape[1]
        if need <= cap:
            return
        new = max(need, cap * 2)
        n, _, d, _ = st["bufA"].shape
        st["bufA"] = np.concatenate([st["bufA"], np.zeros((n, new - cap, d, d))], axis=1)
        st["bufb"] = np.concatenate([st["bufb"], np.zeros((n, new - cap, d))], axis=1)

    def step(self, st, ki, X, rows, ri):
        d = self.d
        t = st["t"][ki]
        choice, reward, x = self.choose(self.scores(st["covi"][ki], st["b"][ki], t, X), X, rows, ri)
        xx = x[:, :, None] * x[:, None, :]
        rx = reward[:, None] * x
        blen = st["blen"][ki]
        self._ensure_cap(st, int(blen.max(initial=0)) + 1)
        st["bufA"][ki, blen] = xx
        st["bufb"][ki, blen] = rx
        blen = blen + 1
        st["cov_loc"][ki] += xx
        st["b_loc"][ki] += rx
        if self.drop_first_at_t0:
            first = t == 0
            if first.any():
                sel = ki[first]
                st["bufA"][sel, :-1] = st["bufA"][sel, 1:]
                st["bufb"][sel, :-1] = st["bufb"][sel, 1:]
                blen = np.where(first, blen - 1, blen)
        thresh = 4.0 * np.log(np.maximum(t.astype(np.float64), 1.0))
        pop = blen * d > thresh
        if pop.any():
            sel = ki[pop]
            block = st["bufA"][sel, 0]
            st["cov"][sel] += block
            st["b"][sel] += st["bufb"][sel, 0]
            self._follow(st, sel, block)
            st["bufA"][sel, :-1] = st["bufA"][sel, 1:]
            st["bufb"][sel, :-1] = st["bufb"][sel, 1:]
            blen = np.where(pop, blen - 1, blen)
        st["blen"][ki] = blen
        st["t"][ki] = t + 1
        return choice, reward, x


# ----------------------------------------------------------------------------- runner
@dataclass
class _FoldSpec:
    keys: list[str]
    order: str
    payload: list[str]  # carried from round rows to decisions (e.g. user_id)
    kernel: FoldKernel
    track_used: bool = False
    emit_state: bool = True


def _runner(spec: _FoldSpec):
    kernel = spec.kernel
    d, k = kernel.d, kernel.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_key = None
        carry_state = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = _np(batch.column("_kind")).astype(np.int8)
            key_arrays = [_np(batch.column(c)) for c in spec.keys]
            n = batch.num_rows
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for ka in key_arrays:
                change[1:] |= ka[1:] != ka[:-1]
            run_id = np.cumsum(change) - 1
            n_runs = int(run_id[-1]) + 1
            starts = np.flatnonzero(change)
            run_keys = [tuple(ka[s] for ka in key_arrays) for s in starts]

            st = kernel.default_state(n_runs)
            if carry_key is not None and run_keys[0] == carry_key:
                for name, v in carry_state.items():
                    if name in ("bufA", "bufb"):
                        kernel._ensure_cap(st, v.shape[1])  # type: ignore[attr-defined]
                        st[name][0, : v.shape[1]] = v[0]
                    else:
                        st[name][0] = v[0]
            elif carry_key is not None and spec.emit_state:
                yield _state_batch(spec, [carry_key], carry_state, np.array([0]))
            carry_key = carry_state = None

            srows = np.flatnonzero(kind == 0)
            if len(srows):
                kernel.state_from_rows(batch, srows, st, run_id[srows])
                kernel.solve(st, run_id[srows])

            rrows = np.flatnonzero(kind == 1)
            if len(rrows):
                sub = batch.take(pa.array(rrows))
                X = _flat_values(sub.column("arms"), 2).reshape(len(rrows), k, d)
                rows = {}
                if kernel.reward == "label":
                    rows["label"] = _np(sub.column("label")).astype(np.float64)
                else:
                    rows["rewards"] = _flat_values(sub.column("rewards"), 1).reshape(len(rrows), k)
                rr = run_id[rrows]
                first = np.r_[True, rr[1:] != rr[:-1]]
                seq = np.arange(len(rr)) - np.maximum.accumulate(np.where(first, np.arange(len(rr)), 0))
                order = np.lexsort((rr, seq))
                counts = np.bincount(seq)
                choice = np.zeros(len(rr), dtype=np.int32)
                reward = np.zeros(len(rr))
                xs = np.zeros((len(rr), d))
                used = np.zeros(len(rr), dtype=bool)
                pos = 0
                for c in counts:
                    ri = order[pos : pos + c]
                    pos += c
                    ch, rw, x = kernel.step(st, rr[ri], X[ri], rows, ri)
                    choice[ri], reward[ri], xs[ri] = ch, rw, x
                    if spec.track_used:
                        used[ri] = kernel.last_used  # type: ignore[attr-defined]
                cols = {
                    "_kind": pa.array(np.ones(len(rr), dtype=np.int32)),
                    **{c: sub.column(c) for c in spec.keys},
                    spec.order: sub.column(spec.order),
                    **{c: sub.column(c) for c in spec.payload},
                    "choice": pa.array(choice),
                    "reward": pa.array(reward),
                    "x": _list_array(xs, d),
                }
                if spec.track_used:
                    cols["cluster_used"] = pa.array(used)
                yield _decision_batch(spec, cols)

            # every run but the last is complete in this batch
            if n_runs > 1 and spec.emit_state:
                yield _state_batch(spec, run_keys[:-1], st, np.arange(n_runs - 1))
            last = n_runs - 1
            carry_key = run_keys[last]
            carry_state = {name: v[last : last + 1].copy() for name, v in st.items()}
        if carry_key is not None and spec.emit_state:
            yield _state_batch(spec, [carry_key], carry_state, np.array([0]))

    return run


def _out_schema(spec: _FoldSpec, rounds_schema: T.StructType) -> T.StructType:
    fields = [T.StructField("_kind", T.IntegerType(), False)]
    for c in spec.keys + [spec.order] + spec.payload:
        fields.append(T.StructField(c, rounds_schema[c].dataType, True))
    fields += [
        T.StructField("choice", T.IntegerType(), True),
        T.StructField("reward", T.DoubleType(), True),
        T.StructField("x", DOUBLE_ARRAY, True),
    ]
    if spec.track_used:
        fields.append(T.StructField("cluster_used", T.BooleanType(), True))
    fields += spec.kernel.state_spark_fields()
    return T.StructType(fields)


def _arrow_schema(spec: _FoldSpec) -> pa.Schema:
    return spec._arrow_schema  # type: ignore[attr-defined]


def _decision_batch(spec: _FoldSpec, cols: dict) -> pa.RecordBatch:
    schema = _arrow_schema(spec)
    arrays = [cols[f.name] if f.name in cols else pa.nulls(len(cols["_kind"]), f.type) for f in schema]
    arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _state_batch(spec: _FoldSpec, keys: list[tuple], st: dict, idx: np.ndarray) -> pa.RecordBatch:
    schema = _arrow_schema(spec)
    n = len(idx)
    cols = {"_kind": pa.array(np.zeros(n, dtype=np.int32))}
    for j, c in enumerate(spec.keys):
        cols[c] = pa.array([kt[j] for kt in keys])
    cols.update(spec.kernel.state_columns(st, idx))
    arrays = [cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema]
    arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def sequential_fold(
    rounds: DataFrame,
    state: DataFrame | None,
    kernel: FoldKernel,
    keys: Sequence[str] = ("user_id",),
    order: str = "round_id",
    payload: Sequence[str] = (),
    track_used: bool = False,
    emit_state: bool = True,
) -> DataFrame:
    """Lazy fold output: decision rows (_kind 1) and, unless not wanted, final state rows (_kind 0)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = list(keys)
    payload = [p for p in payload if p not in keys and p != order]
    spec = _FoldSpec(keys, order, payload, kernel, track_used, emit_state)
    value_cols = ["arms", "label" if kernel.reward == "label" else "rewards"]
    state_cols = list(kernel.state_shapes) + list(kernel.static_shapes)
    if isinstance(kernel, BufferedAgent):
        state_cols.append("buf")

    r = rounds.select(*keys, order, *payload, *value_cols).withColumn("_kind", F.lit(1))
    parts = [r]
    if state is not None:
        s = state.select(*keys, *[c for c in state_cols if c in state.columns]).withColumn("_kind", F.lit(0))
        parts.append(s)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    u = u.repartition(*keys).sortWithinPartitions(*keys, "_kind", order)

    out_schema = _out_schema(spec, rounds.schema)
    spec._arrow_schema = to_arrow_schema(out_schema)  # type: ignore[attr-defined]
    return u.mapInArrow(_runner(spec), out_schema)


@dataclass
class FoldResult:
    decisions: DataFrame
    state: DataFrame


def run_fold(
    rounds: DataFrame,
    state: DataFrame | None,
    kernel: FoldKernel,
    keys: Sequence[str] = ("user_id",),
    order: str = "round_id",
    payload: Sequence[str] = (),
    track_used: bool = False,
    checkpoint: bool = True,
) -> FoldResult:
    """Run the fold once (written as a table) and split decisions from the new state."""
    out = sequential_fold(rounds, state, kernel, keys, order, payload, track_used)
    if checkpoint:
        out = materialize(out)
    return fold_parts(out, kernel, keys, order, payload, track_used)


def fold_parts(
    out: DataFrame,
    kernel: FoldKernel,
    keys: Sequence[str] = ("user_id",),
    order: str = "round_id",
    payload: Sequence[str] = (),
    track_used: bool = False,
) -> FoldResult:
    """Decisions and new state of a written fold output."""
    keys = list(keys)
    dec_cols = keys + [order] + [p for p in payload if p not in keys and p != order] + ["choice", "reward", "x"]
    if track_used:
        dec_cols.append("cluster_used")
    st_cols = keys + [f.name for f in kernel.state_spark_fields()]
    return FoldResult(out.where(F.col("_kind") == 1).select(*dec_cols), out.where(F.col("_kind") == 0).select(*st_cols))
