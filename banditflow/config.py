"""Parameters of the replays, collected in one place instead of globals."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values the results depend on (the published run settings):
#   exploration weight alpha = 0.03, cluster-bound weight alpha2 = 0.7,
#   skew chunk limit of the lazy replay = 5000 rounds,
#   minimum rounds per user (``load_log(min_rounds=...)``): 50 with a reward matrix, 100 with
#   logged labels, 15 in the lazy replay.
ALPHA = 0.03
ALPHA2 = 0.7
CHUNK_LIMIT = 5000


@dataclass(frozen=True)
class ReplayConfig:
    alpha: float = ALPHA
    alpha2: float = ALPHA2
    # two-stage replay
    iteration_length: int = 80000
    control: float = 0.5
    mean_over: str = "interactions"  # or "members" (see README, quirk Q1)
    list_edges: bool = False  # also count the graph's edges and give their list (a quadratic number in dense groups)
    # lazy replay (R2)
    warmup_rounds: int = 5000
    block_length: int = 5000
    chunk_limit: int = CHUNK_LIMIT
    # gossip comparator
    n_shares: int = 1
    reset_t_per_block: bool = False  # True = the agent count restarts each block
    as_written_share: bool = False  # True = every gossiped pair is cut, cut takes partner's local
    seed: int = 0
    # reward kind: "matrix" (reward per arm) or "label" (arm == logged label)
    reward: str = "matrix"

    def with_(self, **kw) -> "ReplayConfig":
        return replace(self, **kw)

    @property
    def user_rounds(self) -> int:
        return int(self.control * self.iteration_length)
