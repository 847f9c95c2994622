"""Benchmark decontamination with spaced seeds.

A mask is a fixed pattern of positions, some of which are ignored. Under each mask every
place of a text has the hash of its selected words, so a copied passage still shares hashes
when words between the selected ones were replaced. Hashes of the documents that may be
hashes of the benchmark (two bits in a table of ``2**FILTER_BITS`` bits, whose size does not
depend on the data) leave the scan as segments of words; their hashes are joined with those
of the benchmark. Every hit gives an alignment of document and item, and an alignment is a
leak if ``WINDOW`` words in a row (or all words of a shorter item) agree in at least
``AGREE`` of the places, words cut off by the end of the document counting as different.

Texts are never shuffled: what moves are segments of at most ``WINDOW`` words on both sides
of a hit, and hashes; a segment meets an item once, with all their alignments. One passage may stand in any share of the documents: hits are grouped
by document before they meet the items.

An alignment is seen if the selected words of one mask are intact in it. Items of at least
``SHORT_WORDS`` words have the seeds of ``MASKS``, shorter ones those of ``SHORT_MASKS``: either
way some mask is intact wherever the replaced places lie, for every number of them that
``AGREE`` allows. Items of fewer than ``FUZZY_WORDS`` words are sought whole: their mask selects
all words, and all have to agree. Masks that no item needs are not hashed.

Defined cases: null and empty texts hold no leak. Items without words are no evidence and are
skipped, and so are items of fewer than ``min_words`` words (default 1: every item is sought,
even one of a single word). Repeated documents are each reported per id:
the result has one row per (doc_id, item_id). Documents without id are reported as one
document with a null id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.tables import arrays, small_batches, stored
from failsift.llm.words import mix, multipliers, word_hashes

MASKS = ("111111", "1101001101", "101101101", "1110111")
SHORT_MASKS = ("1111", "110011")
SHORT_WORDS = 16  # shorter items have the seeds of SHORT_MASKS
FUZZY_WORDS = 6  # shorter items have to agree in all words
WINDOW = 20
AGREE = 0.8
FILTER_BITS = 24
# Seeds of so many places are some 30 MB; more of them are joined by a shuffle.
MAX_BROADCAST_SEEDS = 500_000


def seed_hashes(words: np.ndarray, number: int, mask: str) -> np.ndarray:
    """Hash of the selected words at each place where the whole mask fits."""
    places = len(words) - len(mask) + 1
    if places <= 0:
        return np.empty(0, np.uint64)
    total = np.full(places, number + 1, np.uint64)
    for k, i in enumerate(j for j, c in enumerate(mask) if c == "1"):
        total += words[i : i + places] * multipliers(16)[k]
    return mix(total)


def masks_for(length: int, masks=MASKS) -> list[tuple[int, str]]:
    """(number, mask) of the seeds of an item of ``length`` words."""
    if length < FUZZY_WORDS:
        return [(len(masks) + len(SHORT_MASKS) + length, "1" * length)]
    if length < SHORT_WORDS:
        return list(enumerate(SHORT_MASKS, len(masks)))
    return list(enumerate(masks))


def seeds_of(words: np.ndarray, numbered: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) per mask."""
    for number, mask in numbered:
        hashes = seed_hashes(words, number, mask)
        yield np.arange(len(hashes)), hashes


def filter_places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a table whose size is a power of 2."""
    low = np.uint64(size - 1)
    return (hashes & low).astype(np.intp), ((hashes >> np.uint64(32)) & low).astype(np.intp)


def benchmark_seeds(benchmark: DataFrame, masks=MASKS, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(item_id, words) and (hash, item_id, item_place) of the items."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, seeds = [], [], []
            for item, words in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist())):
                if item is None or len(words) < max(1, min_words):
                    continue
                ids.append(item)
                packed.append(words.tobytes())
                seeds.append([(int(h), int(p)) for places, hashes in seeds_of(words, masks_for(len(words), masks)) for p, h in zip(places, hashes.view(np.int64))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.array(
                        [[{"hash": h, "place": p} for h, p in s] for s in seeds],
                        pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32())])),
                    ),
                ],
                ["item_id", "item_words", "seeds"],
            )

    items = stored(
        benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
            read, "item_id long, item_words binary, seeds array<struct<hash:long,place:int>>"
        ),
        "leak-items",
    )
    seeds = items.select("item_id", F.explode("seeds").alias("s")).select(
        F.col("s.hash").alias("hash"), "item_id", F.col("s.place").alias("item_place")
    )
    return items.select("item_id", "item_words"), seeds


def filter_table(seeds: DataFrame, filter_bits: int) -> np.ndarray:
    """The table of bits, as bytes 0 and 1 of a fixed number of places."""
    low = F.lit((1 << filter_bits) - 1)
    first, second = F.col("hash").bitwiseAND(low), F.shiftrightunsigned("hash", 32).bitwiseAND(low)
    places = seeds.select(F.explode(F.array(first, second)).alias("place"))
    bits = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    found = arrays(bits)
    words = np.zeros(1 << (filter_bits - 6), np.uint64)
    words[found["word"]] = found["bits"].view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def used_masks(items: DataFrame, masks=MASKS) -> list[tuple[int, str]]:
    """(number, mask) of all masks that the items need, from the at most SHORT_WORDS kinds of length."""
    lengths = items.select(F.least(F.length("item_words") / 8, F.lit(SHORT_WORDS)).cast("int").alias("n")).distinct()
    return sorted({m for row in lengths.collect() for m in masks_for(row["n"], masks)})


def segments(docs: DataFrame, table, numbered: list[tuple[int, str]], wholes: int) -> DataFrame:
    """doc_id, start, words and hits (hash, place in the document) around possible hits.

    Masks numbered from ``wholes`` on select whole items, for which the first place is enough.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            per_doc = list(word_hashes(batch.column(1).to_pylist()))
            ends = np.cumsum([len(w) for w in per_doc], dtype=np.int64)
            joined = np.concatenate(per_doc) if per_doc else np.empty(0, np.uint64)
            places, hashes, last, whole = [], [], [], []
            for (at, seed), (number, mask) in zip(seeds_of(joined, numbered), numbered):
                one, two = filter_places(seed, len(bits))
                maybe = np.flatnonzero(bits[one] & bits[two])
                places.append(at[maybe])
                hashes.append(seed[maybe])
                last.append(at[maybe] + len(mask))
                whole.append(np.full(len(maybe), number >= wholes))
            places, hashes, last, whole = map(np.concatenate, (places, hashes, last, whole))
            doc = np.searchsorted(ends, places, side="right")
            inside = last <= ends[doc] if len(doc) else np.zeros(0, bool)
            places, hashes, last, whole, doc = (x[inside] for x in (places, hashes, last, whole, doc))
            order = np.lexsort((places, hashes, doc))
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(doc[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
            order = order[first | ~whole[order]]
            order = order[np.lexsort((places[order], doc[order]))]
            places, hashes, last, doc = (x[order] for x in (places, hashes, last, doc))
            # A segment ends where the next hit is too far away to share a window.
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(places) > 2 * WINDOW)) + 1 if len(doc) else []
            rows = {"doc_id": [], "start": [], "words": [], "hits": []}
            for part in np.split(np.arange(len(doc)), cuts) if len(doc) else []:
                d = doc[part[0]]
                begin = int(ends[d] - len(per_doc[d]))
                start = max(begin, int(places[part[0]]) - WINDOW)
                stop = min(int(ends[d]), int(last[part].max()) + WINDOW)
                rows["doc_id"].append(ids[d])
                rows["start"].append(start - begin)
                rows["words"].append(joined[start:stop].tobytes())
                rows["hits"].append(
                    [{"hash": int(h), "place": int(p) - begin} for h, p in zip(hashes[part].view(np.int64), places[part])]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"], pa.int64()),
                    pa.array(rows["start"], pa.int64()),
                    pa.array(rows["words"], pa.binary()),
                    pa.array(rows["hits"], pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int64())]))),
                ],
                ["doc_id", "start", "words", "hits"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, start long, words binary, hits array<struct<hash:long,place:long>>"
    )


def best_window(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(words that agree, words of the window) of the best window when item word i lies at doc[i + shift]."""
    places = np.arange(len(item)) + shift
    there = (places >= 0) & (places < len(doc))
    same = np.zeros(len(item), np.int64)
    same[there] = doc[places[there]] == item[there]
    width = min(WINDOW, len(item))
    sums = np.concatenate(([0], np.cumsum(same)))
    return int((sums[width:] - sums[:-width]).max()), width


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, filter_bits: int = FILTER_BITS, min_words: int = 1) -> DataFrame:
    """doc_id, item_id, agreeing, window: one row per document and item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    items, seeds = benchmark_seeds(benchmark, masks, min_words)
    numbered = used_masks(items, masks)
    table = spark.sparkContext.broadcast(filter_table(seeds, filter_bits))
    if not numbered:
        numbered = masks_for(SHORT_WORDS, masks)  # no item at all: an empty filter, so no hit
    found = stored(segments(docs, table, numbered, len(masks) + len(SHORT_MASKS)), "leak-segments")
    few = seeds.count() <= MAX_BROADCAST_SEEDS
    small = F.broadcast if few else lambda df: df
    hits = found.select("doc_id", "start", F.explode("hits").alias("hit")).select(
        "doc_id", "start", F.col("hit.hash").alias("hash"), F.col("hit.place").alias("place")
    )
    alignments = (
        hits.join(small(seeds), "hash")
        .groupBy("doc_id", "start", "item_id")
        .agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agreeing, width = [], []
            for row in batch.to_pylist():
                doc, item = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["item_words"], np.uint64)
                best, full = -1, min(WINDOW, len(item))
                for shift in row["shifts"]:
                    best = max(best, best_window(doc, item, shift - row["start"])[0])
                    if best == full:
                        break
                agreeing.append(best)
                width.append(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(agreeing, pa.int32()), pa.array(width, pa.int32())],
                ["doc_id", "item_id", "agreeing", "window"],
            )

    by_segment = found.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), "words")
    aligned = (
        alignments.join(by_segment, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")))
        .join(small(items), "item_id")
        .select("doc_id", "item_id", "start", "shifts", "words", "item_words")
    )
    checked = aligned.mapInArrow(verify, "doc_id long, item_id long, agreeing int, window int")
    return (
        checked.where(F.col("agreeing") >= F.when(F.col("window") < FUZZY_WORDS, F.col("window")).otherwise(F.col("window") * AGREE))
        .groupBy("doc_id", "item_id")
        .agg(F.max("agreeing").alias("agreeing"), F.max("window").alias("window"))
    )
