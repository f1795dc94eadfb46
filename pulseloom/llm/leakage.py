"""Finding evaluation passages that leaked, wholly or partly, into a corpus.

Words and n-grams are known by their hashes, so that no list of words is needed. The n-grams of the passages are a table;
a Bloom filter over them, of bounded size, goes to every task, and one pass over the corpus keeps the few positions of
each text that may have one of them. Joined with the table these give the (text, passage) candidates:

* for common runs of ``run_words`` words alone, every such stretch of a passage is represented by the rarest of its
  n-grams, counted over the whole corpus: a text that shares the stretch shares that seed;
* for edited copies, every n-gram of ``seed_words`` words is a seed, and so is every n-gram of ``rare_words`` words, weighed
  by its rarity: a text is a candidate if the shares of all texts that have the rare n-grams it has close together multiply
  to at most one text, so that less than one text would have them by chance.

Each candidate is scored by a Smith-Waterman alignment over words, which also yields the longest common run.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import broadcast_if_small, cut, quoted

WORD = re.compile(r"[^\W_]+")
#: Pairs that are aligned together.
TOGETHER = 128
#: Bits of the filter at most (32 MB); with more n-grams than it has room for, more positions reach the join, which is exact.
MOST_BITS = 2**28
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16
_PROBES = 4


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the NFKC-normalised, lower-cased text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


class WordHashes(dict):
    """The 63-bit hash of each word asked for."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        return value

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def gram_keys(words: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """A 64-bit key for each n-gram of word hashes, for each length n."""
    own, found = words.astype(np.uint64), {}
    key = np.full(len(own), 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(lengths)):
            key = (key[: max(len(own) - k, 0)] ^ own[k:]) * _MIX
            key ^= key >> np.uint64(29)
            if k + 1 in lengths:
                found[k + 1] = key * np.uint64(2 * k + 3)  # the same words make different keys as parts of longer ones
    return [found[n] for n in lengths]


def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's bits for each key, one probe after the other."""
    with np.errstate(over="ignore"):
        step = (keys >> np.uint64(32)) | np.uint64(1)
        for k in range(_PROBES):
            yield ((keys + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def _filter_of(grams: DataFrame, n_grams: int) -> np.ndarray:
    """A Bloom filter over the column ``gram`` as packed bits, about 32 bits an n-gram and at most ``MOST_BITS``."""
    bits = min(MOST_BITS, max(_BLOCK, 1 << int(np.ceil(np.log2(max(n_grams, 1) * 32)))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.concatenate([np.zeros(0, np.int64), *_slots(batch.column("gram").to_numpy().view(np.uint64), bits)])
            yield pa.record_batch([pa.array(np.unique(slots))], names=["slot"])

    def pack(table: pa.Table) -> pa.Table:
        slots = table["slot"].to_numpy()
        own = np.zeros(_BLOCK, bool)
        own[slots % _BLOCK] = True
        return pa.table({"block": [int(slots[0]) // _BLOCK], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    slots = grams.select("gram").mapInArrow(probe, "slot long").distinct()
    blocks = slots.groupBy(F.floor(F.col("slot") / _BLOCK)).applyInArrow(pack, "block long, bits binary")
    packed = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():  # at most MOST_BITS / 65,536 blocks of 8 KB
        packed[row["block"] * _BLOCK // 8 : (row["block"] + 1) * _BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return packed


def _maybe(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Positions of the keys that the filter may hold."""
    at = np.arange(len(keys))
    for k in range(_PROBES):
        slots = next(s for j, s in enumerate(_slots(keys[at], len(packed) * 8)) if j == k)
        at = at[(packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1]
        if not len(at):
            break
    return at


def align(pairs: list[tuple[np.ndarray, np.ndarray]], match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word sequences, and the length of its longest common run.

    Words are numbers from 0. All pairs advance together, row by row, so pass pairs of like lengths.
    """
    n = len(pairs)
    rows, columns = (max((len(p[k]) for p in pairs), default=0) for k in (0, 1))
    kind = np.int16 if match * (rows + columns) < 30_000 else np.int32
    a, b = np.full((rows, n), -2, np.int64), np.full((columns, n), -3, np.int64)  # a pair is a column, so that all steps run along pairs
    for k, (x, y) in enumerate(pairs):
        a[: len(x), k] = x
        b[: len(y), k] = y
    score, run = np.zeros((columns + 1, n), kind), np.zeros((columns + 1, n), kind)
    best, longest = score.copy(), run.copy()
    slope = (-gap * np.arange(columns + 1)).astype(kind)[:, None]
    win, step = kind(match - mismatch), kind(mismatch)
    for i in range(rows):
        same = b == a[i]
        row = np.zeros_like(score)
        row[1:] = np.maximum(score[:-1] + same * win + step, score[1:] + kind(gap))
        np.maximum(row, 0, out=row)
        run[1:] = (run[:-1] + kind(1)) * same
        row += slope
        score = np.maximum.accumulate(row, axis=0) - slope  # gaps along b
        np.maximum(best, score, out=best)
        np.maximum(longest, run, out=longest)
    return best.max(0).astype(np.int64), longest.max(0).astype(np.int64)


def _passages(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """Each passage (k, item, words) with the hashes of its words."""
    wanted = items.where(quoted(passage).isNotNull()).select(quoted(item_id).alias("item"), quoted(passage).alias("passage"))
    schema = wanted.select("item", F.array().cast("array<bigint>").alias("words")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words = [hashes.of(words_of(text)) for text in batch.column("passage").to_pylist()]
            yield pa.record_batch([batch.column("item"), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])

    return cut(wanted.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("k"), "item", "words"))


def _grams_of(passages: DataFrame, lengths: list[int]) -> DataFrame:
    """All n-grams of the passages: (gram, n, k, item_at, last_at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, words in zip(batch.column("k").to_pylist(), batch.column("words"), strict=True):
                for n, keys in zip(lengths, gram_keys(words.values.to_numpy(), lengths), strict=True):
                    size = len(keys)
                    columns = [keys.view(np.int64), np.full(size, n, np.int32), np.full(size, k), np.arange(size, dtype=np.int32), np.full(size, size - 1, np.int32)]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["gram", "n", "k", "item_at", "last_at"])

    return passages.select("k", "words").mapInArrow(run, "gram long, n int, k long, item_at int, last_at int")


def _hits(docs: DataFrame, packed: np.ndarray, lengths: list[int], margin: int) -> DataFrame:
    """For each text that may have n-grams of the filter: their positions and keys, and the words around them."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # at most MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), shared.value
        for batch in batches:
            ids, rows = batch.column("id"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                words = hashes.of(words_of(text))
                places, keys = [], []
                for every in gram_keys(words, lengths):
                    at = _maybe(every, own)
                    places.append(at)
                    keys.append(every[at])
                at = np.concatenate(places)
                if len(at):
                    low = max(0, int(at.min()) - margin)
                    rows.append((i, at - low, np.concatenate(keys).view(np.int64), words[low : int(at.max()) + max(lengths) + margin]))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch(
                    [ids.take(pa.array(columns[0])), pa.array(columns[1], pa.list_(pa.int32())), *(pa.array(c, pa.list_(pa.int64())) for c in columns[2:])],
                    names=["id", "at", "gram", "words"],
                )

    schema = docs.select("id", F.array().cast("array<int>").alias("at"), *(F.array().cast("array<bigint>").alias(c) for c in ("gram", "words"))).schema
    return docs.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str,
    text: str,
    item_id: str,
    passage: str,
    *,
    seed_words: int = 5,
    run_words: int = 10,
    edited: bool = True,
    rare_words: int = 3,
    least_score: float = 0.3,
) -> DataFrame:
    """Rows (doc_id, item_id, run_words, score): texts that share ``seed_words`` words in a row with a passage, and edited copies.

    ``run_words`` is the longest common run and ``score`` the share of the passage's best possible alignment score. Edited
    copies without such a run are candidates by their rare n-grams of ``rare_words`` words and come out if they score at
    least ``least_score``. With ``edited=False`` only the texts that share a stretch of ``run_words`` words are sure to be
    among the rows; others that share a rare seed come along.

    Defined cases: null or empty texts and passages match nothing; one shorter than ``seed_words`` is found by rare n-grams
    alone, one shorter than ``rare_words`` not at all; with ``edited=False`` a passage shorter than ``run_words`` is
    represented by its rarest n-gram; equal passages are reported for each item; repeated ids: one row for each pair of
    ids; null ids are ids; empty tables give no rows.
    """
    corpus = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    passages = _passages(items, item_id, passage)
    lengths = [seed_words, rare_words] if edited else [seed_words]
    grams = cut(_grams_of(passages, lengths))
    facts = passages.agg(F.max(F.size("words")).alias("longest")).first()
    margin = max(16, facts["longest"] or 0)
    packed = _filter_of(grams, grams.count())
    hits = cut(_hits(corpus, packed, lengths, margin).select(F.monotonically_increasing_id().alias("row"), "*"))

    places = hits.select("row", F.explode(F.arrays_zip("at", "gram")).alias("hit")).select("row", F.col("hit.at").alias("at"), F.col("hit.gram").alias("gram"))
    counts = hits.select(F.explode(F.array_distinct("gram")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_texts"))
    known = grams.join(counts, "gram")  # what no text has can seed nothing
    if edited:
        n_texts = max(corpus.count(), 1)
        seeds = known.withColumns({"sure": F.col("n") == seed_words, "weight": F.log2(n_texts / F.col("n_texts"))})
        pairs = _evidence(places.join(broadcast_if_small(cut(seeds.select("gram", "k", "item_at", "last_at", "sure", "weight"))), "gram"), float(np.log2(n_texts)))
    else:
        stretch = Window.partitionBy("k").orderBy("item_at").rangeBetween(0, run_words - seed_words)
        rarest = known.withColumn("best", F.min(F.struct("n_texts", "item_at", "gram")).over(stretch))
        rarest = rarest.select("k", F.col("best.gram").alias("gram"), F.col("best.item_at").alias("item_at")).distinct()
        pairs = places.join(broadcast_if_small(cut(rarest)), "gram").groupBy("row", "k").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))

    own = passages.select("k", "item", F.col("words").alias("wanted"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # aligning is work for many tasks, however few bytes the pairs have
    joined = pairs.repartition(tasks, "row").join(hits.select("row", "id", "words").repartition(tasks, "row"), "row").join(broadcast_if_small(own), "k")
    schema = joined.select("id", "item", F.lit(0).alias("run_words"), F.lit(0.0).alias("score")).schema
    scored = joined.select("id", "item", "shifts", "words", "wanted").mapInArrow(_score, schema)
    least = F.col("run_words") >= seed_words
    kept = scored.where(least | (F.col("score") >= least_score) if edited else least)
    return kept.groupBy("id", "item").agg(F.max("run_words").alias("run_words"), F.max("score").alias("score")).withColumnsRenamed({"id": doc_id, "item": item_id})


def _evidence(found: DataFrame, enough: float) -> DataFrame:
    """Candidates (row, k, shifts): a sure seed, or distinct rare ones whose weights add up to ``enough`` around one alignment.

    Shifts are taken in bands of twice the passage's length that overlap by half, so that what belongs together is in one.
    """
    width = F.col("last_at") + 16
    shift = F.col("at") - F.col("item_at")
    bands = F.explode(F.array(F.floor(shift / width), F.floor(shift / width) + 1))
    ends = lambda low, high: (F.min(low).alias("low"), F.max(high).alias("high"))
    each = found.select("row", "k", "gram", "sure", "weight", shift.alias("shift"), bands.alias("band"))
    once = each.groupBy("row", "k", "band", "gram").agg(F.max("sure").alias("sure"), F.max("weight").alias("weight"), *ends("shift", "shift"))
    by_band = once.groupBy("row", "k", "band").agg(F.max("sure").alias("sure"), F.sum(F.when(F.col("sure"), 0.0).otherwise(F.col("weight"))).alias("weight"), *ends("low", "high"))
    likely = by_band.where(F.col("sure") | (F.col("weight") >= enough - 1e-9))
    return likely.groupBy("row", "k").agg(F.array_distinct(F.flatten(F.collect_list(F.array("low", "high")))).alias("shifts"))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align each candidate's passage with the text around its shifts."""
    for batch in batches:
        owner: list[int] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        full = np.zeros(batch.num_rows)
        for i, (shifts, doc, wanted) in enumerate(zip(batch.column("shifts"), batch.column("words"), batch.column("wanted"), strict=True)):
            passage, text = wanted.values.to_numpy(), doc.values.to_numpy()
            full[i] = 2 * len(passage)
            order = np.sort(shifts.values.to_numpy())
            for part in np.split(order, np.flatnonzero(np.diff(order) > len(passage) + 16) + 1):  # places far apart
                owner.append(i)
                pairs.append((passage, text[max(0, int(part[0]) - 8) : max(0, int(part[-1]) + len(passage) + 8)]))
        best, longest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        order = np.argsort([len(a) * 100_000 + len(b) for a, b in pairs], kind="stable")
        for start in range(0, len(order), TOGETHER):
            some = order[start : start + TOGETHER]
            s, r = align([pairs[i] for i in some])
            np.maximum.at(best, np.asarray(owner)[some], s)
            np.maximum.at(longest, np.asarray(owner)[some], r)
        yield pa.record_batch([batch.column("id"), batch.column("item"), pa.array(longest, pa.int32()), pa.array(best / full)], names=["id", "item", "run_words", "score"])
