"""Near-duplicate classes by improved consistent weighted sampling.

A text is the multiset of its five-word shingles (one run of all its words if it has fewer).
The weight of a shingle is its frequency in the text times an inverse document frequency
between 1 and 1 + ``IDF_RANGE``: the range is narrow so that the weighted Jaccard similarity
of two texts stays close to the share of words they have in common even in a corpus where
most copies share their shingles.

1. Document frequencies are counted over all documents in a table of ``CELLS`` cells by the
   leading bits of the shingle id. Its size is fixed, so it may be sent to every task. A cell
   holds the sum of its shingles: frequencies below (shingles per document) / ``CELLS`` of
   the documents are not told apart, at any size of the corpus.
2. Every document gets ``BANDS * ROWS`` consistent weighted samples, whose random numbers
   come from a table of ``TABLE_ROWS`` rows chosen by the shingle id, and a key per band.
   Equal texts (by a 64-bit hash of their words) are one node from here on.
3. Nodes in one bucket are compared with one node of it, the pivot, by exact weighted
   Jaccard similarity; verified pairs make components.
4. Members of a bucket that still holds several components are written as their difference
   from the centre of the bucket, the weighted shingles that more than half of a sample of
   its members hold. Two texts are similar if their differences have enough weight in common
   to make up for their gaps: the gap of a text is the weight of its difference beyond
   (1 - t) / (1 + t) of its own weight, at threshold t. So all texts with small gaps are
   similar to the one of the smallest, at one comparison each. Any other similar pair shares
   an element among the first of both differences (in order of ids, until the weight left
   cannot suffice), and from the first shared one on both have enough weight left. Pairs are
   found by joining these elements, first with the nearest text of each element, then with
   all of other components, and compared. The centre decides how many pairs are proposed;
   that none is missed holds for any centre.

A pair of similarity 0.8 shares no bucket with probability 0.0002 at the given bands.

Defined cases: null text is empty, and all texts without words are one class. Null ids: such
rows get the class of their text (null if no row of the class has an id). Repeated rows and
ids: each row gets the class of its own text. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.components import components
from failsift.llm.tables import arrays, small_batches, stored
from failsift.llm.words import mix, multipliers, shingles, word_hashes

THRESHOLD = 0.8
BANDS = 16
ROWS = 4
IDF_RANGE = 0.25
CELL_BITS = 18
CELLS = 1 << CELL_BITS
TABLE_ROWS = 1 << 14
BLOCK = 1024
# A list of nodes this long is some 10 MB; a longer one is joined by a shuffle.
MAX_BROADCAST_NODES = 500_000
MEMBERS_PER_PIVOT_COPY = 256
CENTRE_SAMPLE = 9  # members of a bucket that make its centre, at most
MISSING = 1 << 32  # marks ids that the centre has more of
SLACK = 1e-3  # of a weight, for rounded sums


def cells_of(ids: np.ndarray) -> np.ndarray:
    return ids >> np.uint32(32 - CELL_BITS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per cell, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents, waiting, size = np.zeros(CELLS, np.int64), 0, [], 0
        for batch in batches:
            for words in word_hashes(batch.column(0).to_pylist()):
                documents += 1
                waiting.append(cells_of(np.unique(shingles(words))))
                size += len(waiting[-1])
                if size > 4 * CELLS:
                    total += np.bincount(np.concatenate(waiting), minlength=CELLS)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], documents), pa.int64())],
            ["cell", "n"],
        )

    counts = arrays(docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    total = np.zeros(CELLS + 1, np.int64)
    total[counts["cell"]] = counts["n"]  # cell -1, the number of documents, is the last
    return total[:CELLS], int(total[CELLS])


def idf_table(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Weight per cell, from 1 (in all documents) to 1 + IDF_RANGE (in one)."""
    rarity = np.log(np.maximum(documents, 1) / np.maximum(frequencies, 1)) / np.log(documents + 1.0001)
    return (1 + IDF_RANGE * np.clip(rarity, 0, 1)).astype(np.float32)


def weigh(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and their weights."""
    distinct, counts = np.unique(ids, return_counts=True)
    return distinct, counts * idf[cells_of(distinct)]


def weighted_jaccard(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    (x, u), (y, v) = weigh(a, idf), weigh(b, idf)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float(np.minimum(u[i], v[j]).sum())
    either = float(u.sum()) + float(v.sum()) - both
    return round(both / either, 9) if either else 1.0  # equality does not hang on the order of sums


@cache
def sampling_table(samples: int) -> np.ndarray:
    """1/r, beta, r and ln c - r(1 - beta) per row and sample."""
    rng = np.random.default_rng(20240501)
    r = rng.gamma(2.0, 1.0, (TABLE_ROWS, samples))
    log_c = np.log(rng.gamma(2.0, 1.0, (TABLE_ROWS, samples)))
    beta = rng.random((TABLE_ROWS, samples))
    return np.ascontiguousarray(np.stack([1 / r, beta, r, log_c - r * (1 - beta)], axis=1), dtype=np.float32)


def band_keys(ids: np.ndarray, weights: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Key per band of the weighted set of distinct ``ids``; none for an empty set."""
    if len(ids) == 0:
        return np.empty(0, np.int64)
    table, samples = sampling_table(bands * rows), bands * rows
    column = np.arange(samples)
    least = np.full(samples, np.inf, np.float32)
    chosen, level = np.zeros(samples, np.uint64), np.zeros(samples, np.float32)
    logs = np.log(weights).astype(np.float32)
    places = (ids & np.uint32(TABLE_ROWS - 1)).astype(np.intp)
    for start in range(0, len(ids), BLOCK):
        part = table[places[start : start + BLOCK]]
        steps = part[:, 0]
        steps *= logs[start : start + BLOCK, None]
        steps += part[:, 1]
        np.floor(steps, out=steps)
        score = part[:, 2]
        score *= steps
        np.subtract(part[:, 3], score, out=score)
        place = score.argmin(axis=0)
        lower = score[place, column]
        better = lower < least
        least[better] = lower[better]
        chosen[better] = ids[start + place[better]]
        level[better] = steps[place[better], column[better]]
    sample = mix(chosen * multipliers(3)[0] + level.astype(np.int64).astype(np.uint64) * multipliers(3)[1])
    keys = (sample.reshape(bands, rows) * multipliers(rows)).sum(axis=1) + np.arange(bands, dtype=np.uint64)
    return mix(keys).view(np.int64)


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, content (hash of the words), bands, ids (sorted shingle ids, packed)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, keys, packed = [], [], []
            for words in word_hashes(batch.column(1).to_pylist()):
                content.append(int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True))
                ids = np.sort(shingles(words))
                keys.append(band_keys(*weigh(ids, idf.value), bands, rows))
                packed.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(content, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["doc_id", "content", "bands", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id long, content long, bands array<long>, ids binary"
    )


def verified(pairs: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Many pairs may have the same ``b``.

    The set of a ``b`` with many partners is copied, so that they spread over tasks.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column("mine").to_pylist(), batch.column("theirs").to_pylist()
            good = [
                weighted_jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), idf.value) >= threshold
                for x, y in zip(mine, theirs)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = stored(pairs, "near-pairs")
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS_PER_PIVOT_COPY).cast("int").alias("copies"))
    pivots = (
        copies.join(sets.select(F.col("content").alias("b"), F.col("ids").alias("theirs")), "b")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .drop("copies")
    )
    members = (
        pairs.join(copies, "b")
        .withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
        .join(sets.select(F.col("content").alias("a"), F.col("ids").alias("mine")), "a")
    )
    joined = members.join(pivots, ["b", "copy"]).select("a", "b", "mine", "theirs")
    return joined.mapInArrow(keep, "a long, b long")


def with_alone(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(content, ids, alone): the set of each of the ``nodes`` and its shingles that no other of them has."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = [np.unique(np.frombuffer(x, np.uint32)).astype(np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(distinct, pa.list_(pa.int64()))], ["content", "id"])

    wanted = sets.join(nodes.select("content").distinct(), "content", "left_semi").select("content", "ids")
    alone = (
        wanted.mapInArrow(spell, "content long, id array<long>")
        .select("content", F.explode("id").alias("id"))
        .groupBy("id")
        .agg(F.count("*").alias("n"), F.min("content").alias("content"))
        .where("n = 1")
        .groupBy("content")
        .agg(F.collect_list("id").alias("alone"))
    )
    none = F.array().cast("array<long>")
    return wanted.join(alone, "content", "left").select("content", "ids", F.coalesce("alone", none).alias("alone"))


def centres(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, centre): the shingles that most of a sample of the members have, with their counts, packed like ``ids``.

    The sample has a member per hash slot, the one with the smallest part of shingles of its own.
    """

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for sample in batch.column("sample").to_pylist():
                counted = [np.unique(np.frombuffer(x, np.uint32), return_counts=True) for x in sample]
                each = np.concatenate([(i.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64) for i, n in counted])
                found, votes = np.unique(each, return_counts=True)
                found = found[2 * votes > len(sample)]
                packed.append(np.repeat(found >> np.uint64(32), (found & np.uint64(MISSING - 1)).astype(np.int64)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary())], ["key", "centre"])

    own = sets.select("content", (F.size("alone") / F.length("ids")).alias("own"))
    chosen = (
        rows.select("key", "content")
        .join(own, "content")
        .groupBy("key", F.pmod(F.xxhash64("content"), F.lit(CENTRE_SAMPLE)).alias("slot"))
        .agg(F.min(F.struct("own", "content")).alias("least"))
        .select("key", "least.content")
    )
    samples = chosen.join(sets.select("content", "ids"), "content").groupBy("key").agg(F.collect_list("ids").alias("sample"))
    return samples.mapInArrow(most, "key long, centre binary")


def differences(rows: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """(key, content, gap, element, ahead): the difference of each member from the centre of its bucket.

    ``element`` are ids in order, marked where the centre has more, without those that stand in
    no other text; ``ahead`` is the weight of the difference from each of them on.
    """
    allowed = (1 - threshold) / (1 + threshold)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps, elements, ahead = [], [], []
            for mine, alone, centre in zip(*[batch.column(c).to_pylist() for c in ("ids", "alone", "centre")]):
                (x, u), (y, v) = (weigh(np.frombuffer(s, np.uint32), idf.value) for s in (mine, centre))
                ids = np.union1d(x, y)
                more = np.zeros(len(ids))
                more[np.searchsorted(ids, x)] += u
                more[np.searchsorted(ids, y)] -= v
                gaps.append(float(np.abs(more).sum() - allowed * u.sum()))
                kept = (more < 0) | (more > 0) & ~np.isin(ids, np.array(alone, np.uint32))
                codes, weights = ids[kept].astype(np.int64) + MISSING * (more[kept] < 0), np.abs(more[kept])
                order = np.argsort(codes)
                elements.append(codes[order])
                ahead.append(np.cumsum(weights[order][::-1])[::-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("content"),
                    pa.array(gaps, pa.float64()),
                    pa.array(elements, pa.list_(pa.int64())),
                    pa.array(ahead, pa.list_(pa.float64())),
                ],
                ["key", "content", "gap", "element", "ahead"],
            )

    joined = rows.select("key", "content").join(sets, "content").join(centres(rows, sets), "key")
    return joined.select("key", "content", "ids", "alone", "centre").mapInArrow(
        differ, "key long, content long, gap double, element array<long>, ahead array<double>"
    )


def links(signed: DataFrame, nodes: DataFrame, idf, threshold: float) -> DataFrame:
    """(node, root) of the nodes that are similar to others."""
    keys = nodes.select("content", "rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("pivot")).where("n > 1")
    members = stored(keys.join(buckets, "key").drop("n"), "near-members")
    chosen = stored(members.select("content", "rep").distinct(), "near-chosen")
    few = chosen.count() <= MAX_BROADCAST_NODES
    wanted = chosen.select(F.col("content").alias("c"), F.col("rep").alias("r"))
    sets = stored(
        signed.select("doc_id", "content", "ids")
        .join(
            F.broadcast(wanted) if few else wanted,
            (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("r")),
            "left_semi",
        )
        .select("content", "ids"),
        "near-sets",
    )
    candidates = members.where("content != pivot").select(F.col("content").alias("a"), F.col("pivot").alias("b")).distinct()
    roots = components(stored(verified(candidates, sets, idf, threshold), "near-edges"))

    # Roots are known for some of the chosen nodes, and no others.
    sent = F.broadcast if few else lambda df: df

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(sent(roots.withColumnRenamed("node", "content")), "content", "left").withColumn(
            "root", F.coalesce("root", "content")
        )

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows in buckets that hold several components, with their root."""
        labelled = rooted(rows)
        several = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
        return labelled.join(several.select("key"), "key")

    def joined_by(pairs: DataFrame) -> DataFrame:
        """The roots after the similar ones of the pairs are connected, too."""
        found = stored(verified(pairs, sets, idf, threshold), "near-edges")
        if found.isEmpty():
            return roots
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    # The first pivot has met all of its bucket.
    rest = stored(mixed(members.where("content != pivot").select("key", "content")), "near-rest")
    if rest.isEmpty():
        return roots
    told = stored(differences(rest, stored(with_alone(rest, sets), "near-alone"), idf, threshold), "near-differences")
    nearest = stored(
        told.groupBy("key").agg(F.min(F.struct("gap", "content")).alias("least")).select(
            "key", F.col("least.gap").alias("least"), F.col("least.content").alias("nearest")
        ),
        "near-nearest",
    )
    close = mixed(told.select("key", "content", "gap")).join(nearest, "key")
    own_root = close.where("content = nearest").select("key", F.col("root").alias("b_root"))
    close = close.where(F.col("gap") + F.col("least") <= SLACK).join(own_root, "key").where("root != b_root")
    roots = joined_by(close.select(F.col("content").alias("a"), F.col("nearest").alias("b")).distinct())

    # What is left are pairs of a text that is not close enough for the nearest (``far``) with
    # one whose gap is less or equal. They need (gap + b_gap) / 2 of their differences in common.
    rows = stored(mixed(told).drop("root").join(nearest, "key"), "near-rest")

    def elements(rows: DataFrame, need) -> DataFrame:
        """The first elements of each difference, while at least ``need`` is ahead."""
        kept = F.filter(F.arrays_zip("element", "ahead"), lambda e: e["ahead"] >= need)
        return rows.select("key", "content", "gap", F.explode(kept).alias("e")).select("key", "content", "gap", "e.element", "e.ahead")

    gap, least = F.col("gap"), F.col("least")
    far = stored(elements(rows.where(gap + least > -SLACK), (gap + least) / 2 - SLACK), "near-far")
    near = elements(rows, (gap + F.greatest(gap, -least)) / 2 - SLACK)
    near = stored(near.join(far.select("key", "element").distinct(), ["key", "element"], "left_semi"), "near-near")

    def possible(near: DataFrame) -> DataFrame:
        """Pairs of ``far`` and ``near`` texts of other components that may be similar."""
        partner = rooted(near).select("key", "element", *[F.col(c).alias(f"b_{c}") for c in ("content", "gap", "ahead", "root")])
        before = (F.col("b_gap") < F.col("gap")) | ((F.col("b_gap") == F.col("gap")) & (F.col("b_content") < F.col("content")))
        enough = F.least("ahead", "b_ahead") >= (F.col("gap") + F.col("b_gap")) / 2 - SLACK
        return (
            rooted(far)
            .join(partner, ["key", "element"])
            .where((F.col("root") != F.col("b_root")) & before & enough)
            .select(F.col("content").alias("a"), F.col("b_content").alias("b"))
            .distinct()
        )

    first = near.groupBy("key", "element").agg(F.min(F.struct("gap", "content", "ahead")).alias("f"))
    roots = joined_by(possible(first.select("key", "element", "f.*")))
    return joined_by(possible(near))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id (least id of its class) for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(docs)))
    signed = stored(signatures(docs, idf, bands, rows), "near-signatures")
    nodes = stored(
        signed.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-nodes"
    )
    roots = links(signed, nodes, idf, threshold)
    rooted = nodes.select("content", "rep").join(roots.withColumnRenamed("node", "content"), "content", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "content"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = rooted.join(least, "root").select("content", "class_id")
    return signed.select("doc_id", "content").join(classes, "content").select("doc_id", "class_id")
