"""What a task holds beside its batch: bounded by fixed sizes, not by the texts of the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from banditflow.llm import bpe, lm, substring_dedup, texts
from banditflow.llm.registry import VOCABULARY


def _peak(run) -> tuple[object, float]:
    """Result and greatest MB of Python and numpy memory while it was made."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _texts(n: int, size: int) -> list[bytes]:
    rng = np.random.default_rng(3)
    return [rng.integers(97, 123, size, dtype=np.uint8).tobytes() for _ in range(n)]


def test_scan_and_windows_hold_little_beside_the_batch():
    texts = _texts(1500, 5000)
    key = pa.array(np.arange(len(texts)))
    b = pa.RecordBatch.from_arrays([key, pa.array(np.zeros(len(texts), np.int64)), pa.array(texts, pa.binary())], names=["_k", "_h", "body"])
    rows, mb = _peak(lambda: sum(x.num_rows for x in substring_dedup._scan(100)([b])))
    assert rows > 100_000
    assert mb < 60
    whole = [{"lo": 0, "hi": 4900, "anchor": 0}]
    rows_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("anchor", pa.int64())]))
    apart = b.append_column("open", pa.array([whole] * len(texts), rows_type)).slice(0, 400)
    rows, mb = _peak(lambda: sum(x.num_rows for x in substring_dedup._take_apart(100, substring_dedup._windows)([apart])))
    assert rows == 400 * 4901
    assert mb < 120


def test_every_name_stays_open_whatever_is_settled_at_once(monkeypatch):
    texts = _texts(4, 3000)
    texts += [texts[1][500:1500] + texts[0][:700], texts[0]]
    key = np.arange(len(texts))

    def first_names() -> set:
        got = list(substring_dedup._settle(substring_dedup._phrases(texts, 100), key, np.zeros(len(texts), np.int64)))
        t = pa.Table.from_batches(got).to_pylist()
        return {(r["g"], r["c"]) for r in t if not r["place"] & 1}

    monkeypatch.setattr(substring_dedup, "_CHUNK", 4096)  # about a text a chunk
    whole = first_names()
    monkeypatch.setattr(substring_dedup, "_ROWS", 1)
    assert first_names() == whole


def test_company_holds_one_table_and_a_window():
    rng = np.random.default_rng(5)
    size = 20_000
    text = rng.integers(0, size, 1 << 20)
    column = lm._columns(np.arange(size, 0, -1, dtype=float))
    column[:size] = np.arange(size) % lm.COMPANY  # every subword has company
    total, mb = _peak(lambda: lm._company([text], column))
    assert total.sum() == 2 * sum(len(text) - d for d in (1, 2, 3, 5, 8))
    assert mb < total.nbytes / 1e6 + 40
    again = np.ones_like(total)
    assert lm._company([text], column, total=again) is again
    assert (again == total + 1).all()


def test_runs_of_bytes_are_merged_in_bounded_shares():
    v = bpe.Vocabulary(VOCABULARY)
    rng = np.random.default_rng(2)
    runs = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in rng.integers(1, 25, 60_000)]
    runs += [b"a" * n for n in range(1, 25)] + [" \u00e4\u00e4 the".encode(), b"\x00\xff"]
    got, mb = _peak(lambda: bpe.merge_many(v, runs))
    assert mb < 40
    own = [*range(0, 60_000, 100), *range(60_000, len(runs))]
    assert [np.frombuffer(got[i], "<u4").tolist() for i in own] == [bpe.merge_bytes(v, runs[i]) for i in own]
    assert bpe.merge_many(v, runs[:50], chunk=7) == got[:50]


def test_a_worker_keeps_only_what_its_last_task_asked_for(monkeypatch):
    monkeypatch.setattr(texts, "_KEPT", {})
    monkeypatch.setattr(texts, "_USED", set())

    def task(batches):
        for b in batches:
            texts.kept("memo", object)
            yield b

    assert list(texts.tidied(task)([1, 2])) == [1, 2]
    first = texts._KEPT["memo"]
    list(texts.tidied(task)([1]))
    assert texts._KEPT == {"memo": first}  # the next task of the operator finds it
    list(texts.tidied(iter)([1]))  # a task of another operator
    assert not texts._KEPT


def test_large_batches_are_worked_on_in_parts(spark):
    n = 2 * texts.ROWS + 7

    def start():
        return lambda got: {"k": [len(got)] * len(got)}

    df = spark.range(n).coalesce(1).selectExpr("id", "if(id % 5 = 0, null, string(id)) as text")
    rows = texts.map_texts(df, start, [("k", "bigint")]).collect()
    assert sorted(r.id for r in rows) == list(range(n))
    assert max(r.k for r in rows) <= texts.ROWS
