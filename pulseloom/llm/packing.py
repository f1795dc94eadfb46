"""Filling fixed-capacity containers with whole items while keeping a mixture of sources.

Items wait in one queue for each source. A deficit round-robin serves the queues window by window: each window adds
its share of the window's tokens to a source's credit, and an item is served in the first window whose credit covers
it; what is left over is carried to the next window. Served windows follow from running token totals of each queue
alone, so the work is a prefix sum in two levels (within a stretch of a queue, and over the stretches' totals, which
carry the credit from partition to partition). Each window is then packed by itself, largest item first into the
fullest container that still takes it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.functions.common import broadcast_if_small, cut, fresh, quoted

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Rows of a queue that are summed up in one task.
STRETCH_ROWS = 100_000


def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, n_tokens: str = "n_tokens", *, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Replace ``text`` by its number of tokens under a byte-level vocabulary file; null stays null, "" has 0.

    Strings that look like special tokens are ordinary text. Lone surrogates cannot occur in Spark strings.
    """
    keep = [c for c in df.columns if c != text]
    column = fresh("text", keep)
    name = fresh("n", keep)
    rows = df.select(*map(quoted, keep), quoted(text).alias(column))
    schema = T.StructType([*rows.drop(column).schema.fields, T.StructField(name, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for batch in batches:
            counts = [None if t is None else len(encode(t)) for t in batch.column(column).to_pylist()]
            columns = [batch.column(c) for c in keep] + [pa.array(counts, pa.int32())]
            yield pa.record_batch(columns, names=[*keep, name])

    return rows.mapInArrow(run, schema).withColumnRenamed(name, n_tokens)


def serve_windows(pieces: DataFrame, source: str, size: str, order: list[str], window_size: str, *, shares: dict | None = None, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Add ``window_no`` by deficit round-robin over the source queues, for each value of ``window_size`` apart.

    :param order: columns that name a row; queues are served in the order of their hash.
    :param shares: target share of each source; by default its share of all tokens, which empties all queues together.
        A source that is missing from ``shares`` is an error. When a queue is empty, later windows do without it.
    """
    rows = pieces.count()
    stretches = max(1, -(-rows // stretch_rows))
    place = F.xxhash64(*map(quoted, order))
    laid = pieces.withColumn("__place", place).withColumn("__stretch", F.shiftrightunsigned(F.col("__place"), 33) % stretches)
    totals = laid.groupBy(quoted(source).alias("__s"), quoted(window_size).alias("__w"), F.col("__stretch").alias("__t")).agg(F.sum(size).alias("tokens"))
    queue = Window.partitionBy("__s", "__w")
    every = F.sum("tokens").over(queue)
    carried = totals.select(
        "__s", "__w", "__t",
        (F.sum("tokens").over(queue.orderBy("__t")) - F.col("tokens")).alias("__carried"),
        every.alias("__all"),
    )
    if shares is None:
        grand = totals.groupBy(F.col("__w").alias("__w2")).agg(F.sum("tokens").alias("__grand"))
        carried = carried.join(F.broadcast(grand), F.col("__w") == F.col("__w2")).withColumn("__share", F.col("__all") / F.col("__grand")).drop("__w2", "__grand")
    else:
        literal = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
        wrong = F.raise_error(F.concat(F.lit("no share for source "), F.coalesce(F.col("__s").cast("string"), F.lit("null")))).cast("double")
        carried = carried.withColumn("__share", F.coalesce(literal[F.col("__s")].cast("double"), wrong))
    joined = laid.join(
        broadcast_if_small(carried),
        quoted(source).eqNullSafe(F.col("__s")) & (quoted(window_size) == F.col("__w")) & (F.col("__stretch") == F.col("__t")),
    )
    stretch = Window.partitionBy(quoted(source), quoted(window_size), "__stretch").orderBy("__place", *map(quoted, order))
    served = F.col("__carried") + F.sum(size).over(stretch)
    window = F.greatest(F.ceil(served / (F.col("__share") * quoted(window_size))) - 1, F.lit(0))
    return joined.withColumn("window_no", window.cast("bigint")).drop("__place", "__stretch", "__s", "__w", "__t", "__carried", "__all", "__share")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, each into the fullest container that still takes it."""
    where = np.empty(len(sizes), np.int64)
    room: list[tuple[int, int]] = []
    containers = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number, containers = capacity, containers, containers + 1
        where[i] = number
        if left > size:
            insort(room, (left - size, number))
    return where


def pack_items(items: DataFrame, item_id: str, source: str, size: str, capacities: list[int], *, containers_per_window: int = 256, shares: dict | None = None) -> DataFrame:
    """Put items into containers of each capacity.

    Returns rows (capacity_tokens, window_no, container_no, item_id, piece_no, start_token, n_tokens); a container is
    named by its capacity, window and number. Only an item larger than the capacity is cut, into full pieces and a
    rest; every other item has the single piece 0.

    Defined cases: a null size is no item; size 0 takes no room and comes out with null window and container; items of
    a null source form a queue of their own; repeated ids are items of their own; an empty table gives no rows. The
    number of containers of a window is about ``containers_per_window``, whatever the data; at most one container of
    a window is open when the next begins.
    """
    rows = items.select(quoted(item_id).alias("id"), quoted(source).alias("source"), quoted(size).cast("bigint").alias("size")).where("size is not null")
    twin = Window.partitionBy("id").orderBy("source", "size")
    rows = rows.withColumn("twin", F.row_number().over(twin))
    wide = rows.withColumn("capacity", F.explode(F.array(*(F.lit(int(c)) for c in capacities))))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / F.col("capacity")) - 1, F.lit(0)))
    pieces = (
        wide.withColumn("piece_no", F.explode(numbers))
        .withColumn("start_token", F.col("piece_no") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("capacity").cast("bigint"), F.col("size") - F.col("start_token")))
        .withColumn("window_size", F.col("capacity").cast("bigint") * containers_per_window)
        .drop("size")
    )
    pieces = cut(pieces)
    served = serve_windows(pieces.where("n_tokens > 0"), "source", "n_tokens", ["id", "twin", "piece_no"], "window_size", shares=shares)
    schema = served.select("capacity", "window_no", "id", "piece_no", "start_token", "n_tokens").schema.add("container_no", T.LongType())

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("twin", "ascending"), ("piece_no", "ascending")])
        container = best_fit(table["n_tokens"].to_numpy(), table["capacity"][0].as_py())
        return table.append_column("container_no", pa.array(container)).select(schema.names)

    packed = served.groupBy("capacity", "window_no").applyInArrow(pack, schema)
    empty = pieces.where("n_tokens = 0").select("capacity", F.lit(None).cast("bigint").alias("window_no"), F.lit(None).cast("bigint").alias("container_no"), "id", "piece_no", "start_token", "n_tokens")
    return packed.unionByName(empty).select(F.col("capacity").alias("capacity_tokens"), "window_no", "container_no", F.col("id").alias(item_id), F.col("piece_no").cast("int").alias("piece_no"), "start_token", "n_tokens")
