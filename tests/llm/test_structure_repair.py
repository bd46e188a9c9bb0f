"""op13: the run-length DP against every edit sequence, on conversations of any shape."""

import hashlib
import random
from functools import lru_cache

from pyspark.sql import functions as F

from banditflow.llm import structure_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(R.BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired rows), trying every edit; inserts never come three in a row in a cheapest answer."""
    faults, n = faults_of(rows), len(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == n and state in ("", "a") else []

        def go(cost, letter, row, rest):
            found.append((cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2]))

        if inserts < 3:
            for name in ("user", "assistant"):
                if (state, name[0]) in AFTER:
                    go(3, "I", (name, ""), best(i, AFTER[state, name[0]], inserts + 1))
        if i < n:
            _, role, text = rows[i]
            go(4, "D", None, best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in AFTER:
                    go(late, "K", (role, text), best(i + 1, AFTER[state, role[:1]], 0))
                for name in ("user", "assistant"):
                    if (state, name[0]) in AFTER:
                        go(3 + late, "R", (name, text), best(i + 1, AFTER[state, name[0]], 0))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 0)


def summary(rows):
    cost, audit, left = brute(tuple(rows))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    faults = faults_of(rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest(),
    )


def conversations(seed=5, n=150):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        rows, turn = [], rng.choice([None, 0, 3, -2])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            text = rng.choice(["Yes.", "No", "", " \n\t", "Why? ", "é!\n", "same words.", f"words {rng.random()}."])
            rows.append((turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "U"]), text))
            turn = (turn or 0) + rng.choice([1, 1, 1, 2, 4])
        out[c] = rows
    out[n] = [(i, "user", "Go on") for i in range(40)]  # one long run of truncated rows
    out[n + 1] = [(i, ("user", "assistant")[i % 2], f"{i}.") for i in range(60)]
    return out


def test_summaries_equal_every_edit_sequence(spark):
    given = conversations()
    rows = [(c, *r) for c, rs in given.items() for r in rs]
    random.Random(1).shuffle(rows)
    ids = spark.createDataFrame([(c,) for c in given], "conv_id long")
    R_piece, R.PIECE = R.PIECE, 7
    try:
        got = R.repair_summary(spark.createDataFrame(rows, SCHEMA).repartition(5), ids).collect()
    finally:
        R.PIECE = R_piece
    assert {r[0]: tuple(r[1:]) for r in got} == {c: summary(rs) for c, rs in given.items()}
    assert len(got) == len(given)


def test_repaired_turns_are_the_summary_row_by_row(spark):
    given = {c: rs for c, rs in conversations(8, 40).items() if rs}
    df = spark.createDataFrame([(c, *r) for c, rs in given.items() for r in rs], SCHEMA)
    edits = {}
    for r in sorted(R.repaired_turns(df).collect(), key=lambda r: (r.conv_id, r.seq)):
        edits.setdefault(r.conv_id, []).append(r)
    for c, rs in given.items():
        _, audit, left = brute(tuple(rs))
        assert "".join(e.edit for e in edits[c]) == audit
        assert tuple((e.role, e.text) for e in edits[c] if e.edit != "D") == left
        assert [e.fault or "" for e in edits[c] if e.edit != "I"] == faults_of(rs)


def test_nulls_ties_repeats_empty_and_other_columns(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."),  # a null id is one conversation
        (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."),  # a row given twice
        (2, 1, "user", None), (2, 2, None, "Hi."),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_c", F.lit("x")).withColumn("_symbol", F.lit(1))
    got = {r.conv_id: r for r in R.repair_summary(df).collect()}
    assert set(got) == {None, 1, 2}
    assert (got[None].blank, got[None].audit, got[None].cost) == (1, "DKK", 4)
    assert (got[1].duplicate, got[1].audit, got[1].gaps) == (1, "KDK", 0)
    assert tuple(got[2])[1:] == summary([(1, "user", " "), (2, " ", "Hi.")])
    none = df.where("false")
    assert R.repair_summary(none).count() == 0 and R.repaired_turns(none).count() == 0
    some = R.repair_summary(df, df.where("conv_id = 2")).collect()  # conversations that ids leave out come, too
    assert sorted(map(tuple, some), key=str) == sorted((tuple(r) for r in got.values()), key=str)
    alone = R.repair_summary(none, df).collect()
    assert len(alone) == 3 and all(tuple(r)[1:] == summary([]) for r in alone)


def test_long_texts_and_long_conversations(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(20_000)] + [(8, 0, "user", "x" * 2_000_000)]
    got = {r.conv_id: r for r in R.repair_summary(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[7].audit == "K" * 20_000 and got[7].cost == 0
    assert tuple(got[8])[1:] == summary([(0, "user", "x" * 2_000_000)])


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"Well {t}? No! Yes.") for c in (1, 2, None) for t in [*range(40), None]]
    got = {}
    for r in R.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = ("user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(e): None for e in ".!?"}) if kind == 2 else text)
        assert got.get((c, t), []) == {0: [], 3: [one, one]}.get(kind, [one])
