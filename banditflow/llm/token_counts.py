"""Token counts by section: a document is encoded once as a whole, its tokens are shared out afterwards.

Every token has the span of bytes it stands for; an interval join of these spans with the sections'
gives every section its tokens.  A token that crosses a boundary goes, by ``rule``,
to the section that has most of its bytes, the earlier one if several do (``most``); to that of its
first byte (``first``); or in shares of its bytes (``share``, a fraction).  With each of them the
sections' counts add up to the document's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditflow.llm.bpe import Vocabulary, loaded
from banditflow.llm.texts import map_texts

RULES = ("most", "first", "share")


def token_ends(v: Vocabulary, ids: bytes) -> np.ndarray:
    """End of each token, in bytes of the text."""
    return np.cumsum(v.sizes[np.frombuffer(ids, "<u4")])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section i spans bytes bounds[i] to bounds[i + 1], the whole text in all."""
    n = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    a = np.searchsorted(bounds, starts, "right") - 1  # section of the first byte, empty sections skipped
    z = np.searchsorted(bounds, ends - 1, "right") - 1  # of the last
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float)
    inside = a == z
    out = np.bincount(a[inside], minlength=n).astype(float)
    for i in np.flatnonzero(~inside):  # only tokens that cross a boundary
        at = np.arange(a[i], z[i] + 1)
        part = np.minimum(bounds[at + 1], ends[i]) - np.maximum(bounds[at], starts[i])
        if rule == "most":
            out[at[part.argmax()]] += 1
        else:
            out[at] += part / (ends[i] - starts[i])
    return out


def paragraphs(text: bytes) -> list[tuple[str, int]]:
    """(kind, end) of the sections of a text: its paragraphs and the line ends between them.

    A paragraph is ``head`` (the first line), ``body`` or ``tail`` (the last of several); runs of line
    ends are ``break``.
    """
    out: list[tuple[str, int]] = []
    at = 0
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        if line:
            kind = "head" if i == 0 else "tail" if i == len(lines) - 1 else "body"
            at += len(line)
            out.append((kind, at))
        if i < len(lines) - 1:
            at += 1
            if out and out[-1][0] == "break":
                out[-1] = ("break", at)
            else:
                out.append(("break", at))
    return out


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    sections: Callable[[bytes], list[tuple[str, int]]] = paragraphs,
    rule: str = "most",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_tokens and sections (array of kind, start, end, tokens; bytes) to each row.

    ``sections`` cuts a text (UTF-8 bytes) into (kind, end) pieces that cover it in order.  Bytes that are
    no UTF-8 count as U+FFFD, in the tokens and in the places.  Null and
    empty texts have no token and no section.  Rows repeat as they come; columns of ``docs`` named like
    a new one are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64())]))

    def start() -> Callable[[list], dict]:
        v, encode = loaded(vocabulary)

        def rows(texts: list) -> Iterator[tuple[int, list]]:
            valid = [t.decode("utf-8", "replace") for t in texts]
            for t, ids in zip(valid, encode.many(valid)):
                cut = sections(t.encode())
                if not cut:
                    yield 0, []
                    continue
                bounds = np.array([0, *(end for _, end in cut)], np.int64)
                n = attribute(token_ends(v, ids), bounds, rule).tolist()
                at = bounds.tolist()
                yield len(ids) // 4, [
                    {"kind": k, "start": at[i], "end": at[i + 1], "tokens": n[i]} for i, (k, _) in enumerate(cut)
                ]

        def work(texts: list) -> dict:
            n, found = zip(*rows(texts)) if texts else ((), ())
            return {"n_tokens": list(n), "sections": pa.array(found, kind)}

        return work

    fields = [("n_tokens", "bigint"), ("sections", "array<struct<kind:string,start:bigint,end:bigint,tokens:double>>")]
    return map_texts(docs, start, fields, keep=keep)


def count_fields(docs: DataFrame, vocabulary: str, fields: list[str], separator: str = "\n", rule: str = "most") -> DataFrame:
    """Tokens of each of several text columns when they are encoded as one text, joined by ``separator``.

    doc_id, field (``separator`` counts as one, named "separator"), n_bytes, n_tokens: a row for each
    field of each row of ``docs``.  A null field is empty.
    """
    pieces = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    joined = docs.select("doc_id", F.concat_ws(separator, *pieces).alias("text"), *[
        F.octet_length(p).cast("long").alias(f"__{i}") for i, p in enumerate(pieces)
    ])
    gap = len(separator.encode())
    v_path = vocabulary
    lengths = [f"__{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encode = loaded(v_path)
        for b in batches:
            size = np.stack([b.column(c).to_numpy() for c in lengths], 1) if b.num_rows else np.zeros((0, len(fields)))
            out = []
            for s, ids in zip(size, encode.many(b.column("text").to_pylist())):
                cut = np.full(2 * len(s) - 1, gap, np.int64)
                cut[::2] = s
                out.append(attribute(token_ends(v, ids), np.concatenate(([0], np.cumsum(cut))), rule))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(list(size.astype(np.int64)), pa.list_(pa.int64())), pa.array(out, pa.list_(pa.float64()))],
                names=["doc_id", "size", "tokens"],
            )

    kind = joined.schema["doc_id"].dataType.simpleString()
    counted = joined.mapInArrow(run, f"doc_id {kind}, size array<long>, tokens array<double>")
    rows = [
        F.struct(F.lit(f).alias("field"), F.col("size")[i].alias("n_bytes"), F.col("tokens")[2 * i].alias("n_tokens"))
        for i, f in enumerate(fields)
    ]
    if len(fields) > 1:
        gaps = sum((F.col("tokens")[2 * i + 1] for i in range(len(fields) - 1)), F.lit(0.0))
        total = F.lit(gap * (len(fields) - 1)).cast("long")
        rows.append(F.struct(F.lit("separator").alias("field"), total.alias("n_bytes"), gaps.alias("n_tokens")))
    return counted.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


def section_digest(counted: DataFrame) -> DataFrame:
    """One row a document: its tokens in all and by kind of section, the largest section."""

    def of(kind: str):  # noqa: ANN202
        own = F.filter("sections", lambda s: s["kind"] == kind)
        return F.aggregate(own, F.lit(0.0), lambda n, s: n + s["tokens"]).alias(f"{kind}_tokens")

    return counted.select(
        "doc_id",
        "n_tokens",
        F.size("sections").alias("n_sections"),
        *[of(k) for k in ("head", "body", "tail", "break")],
        F.coalesce(F.array_max(F.transform("sections", lambda s: s["tokens"])), F.lit(0.0)).alias("largest"),
    )
