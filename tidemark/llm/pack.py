"""Filling containers of fixed capacity with texts measured in tokens.

Only the histogram of sizes reaches the driver: at most `capacity` numbers, whatever the data. There containers are
filled by minimum bin slack: the largest size left is put in, and a subset-sum dynamic program over a bit set picks
the multiset of remaining sizes that fills the rest closest; it is traced back to counts. Such a filling is repeated
as often as the counts allow, so that the number of fillings grows with the capacity and only as the logarithm of
the counts. Items then get their containers by their rank within their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import TOKENIZERS
from tidemark.llm.encode import token_counts
from tidemark.operators.asof import asof_known
from tidemark.operators.skew import ROWS
from tidemark.session import materialize

SEND = 64 << 20


def fill(room: int, sizes: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of sizes (in falling order, at most counts of each) whose sum is closest to room from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for z in sizes:
        if z > room:
            continue
        k, left = 1, min(counts[z], room // z)
        while left > 0:
            k = min(k, left)
            new = reach | (reach << (k * z)) & mask
            if new != reach:
                steps.append((z, k, reach))
                reach = new
            left -= k
            k *= 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, {}
    for z, k, before in reversed(steps):
        if not before >> at & 1:
            out[z] = out.get(z, 0) + k
            at -= k * z
    return out


def plan(hist: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (size, first rank, first container, items of the size in each container), and the number of containers."""
    left = {z: n for z, n in hist.items() if 0 < z <= capacity and n > 0}
    sizes, at, rank, rows = sorted(left, reverse=True), 0, dict.fromkeys(left, 0), []
    while sizes:
        top = sizes[0]
        left[top] -= 1
        got = fill(capacity - top, sizes, left)
        left[top] += 1
        got[top] = got.get(top, 0) + 1
        times = min(left[z] // k for z, k in got.items())
        for z, k in got.items():
            rows.append((z, rank[z], at, k))
            rank[z] += k * times
            left[z] -= k * times
        at += times
        sizes = [z for z in sizes if left[z]]
    return np.array(sorted(rows), np.int64).reshape(-1, 4), at


def _ranked(items: DataFrame, hist: dict[int, int], order: list[str]) -> DataFrame:
    """Adds rank, from 0, within n_tokens. A size that many items share is dealt out by hash over as many chunks as it
    needs; the chunks' counts give each its first rank."""
    spark = items.sparkSession
    hot = [(z, -(-n // ROWS)) for z, n in hist.items() if n > ROWS]
    if hot:  # no more rows than sizes
        many = F.broadcast(spark.createDataFrame(hot, "n_tokens bigint, _many bigint"))
        items = items.join(many, "n_tokens", "left").withColumn("_chunk", F.coalesce(F.pmod(F.xxhash64(*order), "_many"), F.lit(0))).drop("_many")
    else:
        items = items.withColumn("_chunk", F.lit(0).cast("long"))
    w = W.partitionBy("n_tokens").orderBy("_chunk")
    before = items.groupBy("n_tokens", "_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy("n_tokens", "_chunk").orderBy(*order)) - 1
    return items.withColumn("_own", own).join(before, ["n_tokens", "_chunk"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_chunk", "_own", "_before")


def pack(sized: DataFrame, id_col: str, capacity: int, send: int = SEND) -> DataFrame:
    """(container_id, id, piece_no, token_start, token_end, n_tokens) of each item of sized (id, n_tokens).

    No item is split unless it exceeds the capacity: then into full containers of its own and a rest, which is packed
    with the others. Items without tokens take no room; they are dealt over the containers in turn. Container numbers
    run from 0 without gaps. An id that comes twice is two items; a null size is 0. No items: no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sized.sparkSession
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    cut = sized.select(F.col(id_col), n.alias("_n")).withColumn(
        "piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((_n - 1) div {capacity} as int)"))))
    )
    items = materialize(cut.select(id_col, "piece_no", (F.col("piece_no") * F.lit(capacity).cast("long")).alias("token_start"), F.least("_n", (F.col("piece_no") + 1) * F.lit(capacity).cast("long")).alias("token_end")).withColumn("n_tokens", F.col("token_end") - F.col("token_start")))
    hist = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    rows, total = plan(hist, capacity)
    ranked = _ranked(items, hist, [id_col, "piece_no"])
    cols = [id_col, "piece_no", "token_start", "token_end", "n_tokens"]
    none = ranked.filter("n_tokens = 0").select(*cols, F.pmod("rank", F.lit(max(total, 1))).alias("container_id"))
    some = ranked.filter("n_tokens > 0")
    if rows.nbytes <= send:
        key = rows[:, 0] << 40 | rows[:, 1] if capacity < 1 << 22 else None
    if rows.nbytes > send or key is None:
        # too large to send to each task: looked up by an as-of join on rank
        p = spark.createDataFrame([tuple(map(int, r)) for r in rows], "n_tokens bigint, first bigint, base bigint, each bigint").withColumn("_k", F.lit(0))
        got = asof_known(some.withColumn("_k", F.lit(0)), p, ["n_tokens"], [*cols[:4], "n_tokens", "rank"], "rank", "_k", ["first"], "_k", ["base", "each"])
        return got.select(*cols, F.expr("match.base + (rank - match.first) div match.each").alias("container_id")).unionByName(none).select("container_id", *cols)
    sent = spark.sparkContext.broadcast((key, rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, r = sent.value
        for b in batches:
            z, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(k, z << 40 | rank, "right") - 1
            c = r[i, 2] + (rank - r[i, 1]) // np.maximum(r[i, 3], 1)
            yield pa.RecordBatch.from_arrays([pa.array(c), *[b.column(x) for x in cols]], ["container_id", *cols])

    out = T.StructType([T.StructField("container_id", T.LongType()), *[some.schema[c] for c in cols]])
    return some.select(*cols, "rank").mapInArrow(place, out).unionByName(none)


def pack_texts(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, folder: str = TOKENIZERS) -> DataFrame:
    """pack() of whole texts; null and empty texts have no tokens."""
    return pack(materialize(token_counts(df, [id_col], text_col, tokenizer, folder)), id_col, capacity)
