"""Substring dedup: words covered by a window of words that also starts elsewhere.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the run of ``GRAM``
words in it with the least hash, the leftmost of equal ones. Consecutive windows with the
minimiser at the same place form a super-k-mer, which travels as one packed string, its words
joined by blanks. Equal windows have equal minimisers, so they meet in one bucket.

1. ``minimisers``: each super-k-mer gives its minimiser and a digest of its string; counts and
   the least and largest digest per minimiser are summed before they move. A minimiser seen
   once holds no repeat. One with a single digest, seen more often, is repeated as a whole, so
   no text has to move for it. Only minimisers with different strings need to be compared.
2. ``pieces``: one row per super-k-mer whose minimiser is seen twice, with the packed string
   where strings differ. Bit tables of fixed size (``CELLS`` longs) tell a scan which these
   are; a false hit costs traffic, never a result.
3. ``sorted_buckets``: a bucket's windows are sorted by a hash of their words and neighbours
   are compared word by word. Buckets of more than ``WIDE`` super-k-mers (a very common line
   in many surroundings) would not fit one task: ``counted_windows`` deals their windows out
   one by one, counts them with partial sums and brings the counts back by a join.
4. ``without_repeats``: the repeated windows of a document meet its text again.

A word is a run of bytes that are no ASCII white space, unchanged. Digests of 128 bits (hash
of minimiser and of string) stand for strings; windows inside buckets are compared exactly,
those of wide buckets by MD5.

Defined cases: null text has no words. Fewer than ``WINDOW`` words are kept as they are.
Repeated rows and rows without id are documents like others: equal texts repeat each other.
A text of any length is cut into windows in parts that overlap. No rows give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failsift.llm.tables import arrays, stored
from failsift.llm.words import PIECE, _power_tables, mix, multipliers

WINDOW = 35
GRAM = 10
# Super-k-mers of one minimiser that one task compares; each is at most 60 words.
WIDE = 2_000
# 64-bit cells of a bit table, 16 MB.
CELLS = 1 << 21
# Words that are cut into super-k-mers at once, and the bits that hold a place among them.
PART_WORDS = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
# Super-k-mers that are sorted at once.
SORTED_ROWS = 8_192

BUCKET = "mini long, n long, low long, high long"
PIECES = "k1 long, k2 long, start long, windows int, mini long, d long, n int, wide boolean, packed string"
MASKS = "mini long, d long, mask int"


class Words:
    """Words of several texts in one buffer, each followed by one blank."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        kept = ~blank
        kept[1:] |= ~blank[:-1]
        self.buffer = raw[kept].copy()
        self.buffer[blank[kept]] = 32
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(np.flatnonzero(kept & blank), offsets)
        self.ends = np.flatnonzero(self.buffer == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64) if len(self.ends) else self.ends

    def hashes(self, first: int, last: int) -> np.ndarray:
        """Of the words ``first`` to ``last``, in pieces of bounded length."""
        found, at = [np.empty(0, np.uint64)], first
        while at < last:
            to = max(at + 1, min(last, int(np.searchsorted(self.ends, self.starts[at] + PIECE, "right"))))
            base = self.starts[at]
            part = self.buffer[base : self.ends[to - 1]].astype(np.uint64) + np.uint64(1)
            up, down = _power_tables(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            found.append(mix((sums[e] - sums[s]) * down[s]))
            at = to
        return np.concatenate(found)

    def packed(self, first: int, count: int) -> bytes:
        return self.buffer[self.starts[first] : self.ends[first + count - 1]].tobytes()


def super_kmers(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, windows, minimiser, digest) of the super-k-mers, a part of the words at a time."""
    total = len(words.ends)
    for first in range(0, max(total - WINDOW + 1, 0), PART_WORDS):
        last = min(total, first + PART_WORDS + WINDOW - 1)
        hashes = words.hashes(first, last)
        n = len(hashes) - WINDOW + 1
        text = np.searchsorted(words.bounds, np.arange(first, last), "right")
        inside = text[:n] == text[WINDOW - 1 :]
        grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
        for i, factor in enumerate(multipliers(GRAM)):
            grams += hashes[i : i + len(grams)] * factor
        grams = mix(grams)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span, wanted = 1, WINDOW - GRAM + 1
        while span < wanted:
            step = min(span, wanted - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        place = (least & _PLACE).astype(np.int64)
        place[~inside] = -1
        edges = np.flatnonzero(np.diff(place, prepend=-2))
        lengths = np.diff(edges, append=n)
        edges, lengths = edges[place[edges] >= 0], lengths[place[edges] >= 0]
        up, down = _power_tables(len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(1)) * up[: len(hashes)], out=sums[1:])
        digests = mix((sums[edges + lengths + WINDOW - 1] - sums[edges]) * down[edges])
        yield edges + first, lengths, grams[place[edges]], digests


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``PIECE`` bytes, each with the number of its first text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PIECE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _first_of_equal(mini: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (mini, d), and the places in that order where a new pair begins."""
    order = np.lexsort((d, mini))
    m, e = mini[order], d[order]
    return order, np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (e[1:] != e[:-1])])[: len(m)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, group in _groups(_texts(batch.column("text"))):
            for _, _, mini, d in super_kmers(Words(group)):
                if not len(mini):
                    continue
                order = np.argsort(mini, kind="stable")
                m, d = mini[order], _signed(d[order])
                new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_signed(m[new])),
                        pa.array(np.diff(new, append=len(m))),
                        pa.array(np.minimum.reduceat(d, new)),
                        pa.array(np.maximum.reduceat(d, new)),
                    ],
                    names=["mini", "n", "low", "high"],
                )


def minimisers(texts: DataFrame) -> DataFrame:
    """mini, n, low, high of the minimisers that are seen more than once."""
    return (
        texts.select("text")
        .mapInArrow(_counts, BUCKET)
        .groupBy("mini")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where("n > 1")
    )


def bit_tables(minis: DataFrame, wide: int) -> dict[str, np.ndarray]:
    """Bit tables of the minimisers seen twice (live), to be compared (mixed), or too many for a task (wide)."""
    bit = F.expr("shiftleft(1L, int(mini & 63))")
    mixed = F.col("low") != F.col("high")
    cells = minis.groupBy(F.expr(f"shiftrightunsigned(mini, {64 - CELLS.bit_length() + 1})").alias("cell")).agg(
        F.bit_or(bit).alias("live"),
        F.bit_or(F.when(mixed, bit).otherwise(F.lit(0).cast("long"))).alias("mixed"),
        F.bit_or(F.when(mixed & (F.col("n") > wide), bit).otherwise(F.lit(0).cast("long"))).alias("wide"),
    )
    found = arrays(cells)
    tables = {}
    for name in ("live", "mixed", "wide"):
        tables[name] = np.zeros(CELLS, np.uint64)
        tables[name][found["cell"]] = found[name].astype(np.int64).view(np.uint64)
    return tables


def _holds(bits: np.ndarray, mini: np.ndarray) -> np.ndarray:
    cell = bits[(mini >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)]
    return (cell >> (mini & np.uint64(63)) & np.uint64(1)).astype(bool)


def pieces(texts: DataFrame, tables: dict[str, np.ndarray]) -> DataFrame:
    """A row per super-k-mer whose minimiser is seen twice; the first of equal ones in a batch has the string."""
    sent = texts.sparkSession.sparkContext.broadcast(tables)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            for at, group in _groups(_texts(batch.column("text"))):
                words = Words(group)
                for first, windows, mini, d in super_kmers(words):
                    live = _holds(bits["live"], mini)
                    first, windows, mini, d = first[live], windows[live], mini[live], d[live]
                    if not len(mini):
                        continue
                    text = np.searchsorted(words.bounds, first, "right") - 1
                    order, new = _first_of_equal(mini, d)
                    n = np.zeros(len(mini), np.int32)
                    n[order[new]] = np.diff(new, append=len(mini))
                    wide = _holds(bits["wide"], mini)
                    strings: list[bytes | None] = [None] * len(mini)
                    for i in np.flatnonzero((n > 0) & (wide | _holds(bits["mixed"], mini))):
                        strings[i] = words.packed(first[i], windows[i] + WINDOW - 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k1[at + text]),
                            pa.array(k2[at + text]),
                            pa.array(first - words.bounds[text]),
                            pa.array(windows.astype(np.int32)),
                            pa.array(_signed(mini)),
                            pa.array(_signed(d)),
                            pa.array(n),
                            pa.array(wide),
                            pa.array(strings, pa.binary()).cast(pa.string()),
                        ],
                        names=["k1", "k2", "start", "windows", "mini", "d", "n", "wide", "packed"],
                    )

    return texts.select("k1", "k2", "text").mapInArrow(cut, PIECES)


def repeated_windows(strings: pa.Array, n: np.ndarray) -> np.ndarray:
    """For each packed string, seen ``n`` times, the bits of its windows that are seen twice in all."""
    lists = pc.split_pattern(strings.cast(pa.string()), " ")
    ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.uint64)
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    counts = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(lengths) - lengths)[owner] + bit
    up, down = _power_tables(len(ids))
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids + np.uint64(1)) * up[: len(ids)], out=sums[1:])
    key = (sums[start + WINDOW] - sums[start]) * down[start]
    order = np.argsort(key, kind="stable")
    equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    window = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    for i in range(0, len(equal), 1 << 16):
        some = equal[i : i + (1 << 16)]
        if (window[start[order[some]]] != window[start[order[some + 1]]]).any():
            order, same = _by_content(window[start])
            break
    else:
        same = np.zeros(len(order), bool)
        same[equal + 1] = True
    new = np.flatnonzero(~same)
    seen = np.add.reduceat(n[owner[order]], new)
    repeated = order[np.repeat(seen > 1, np.diff(new, append=len(order)))]
    masks = np.zeros(len(counts), np.int32)
    np.bitwise_or.at(masks, owner[repeated], np.left_shift(1, bit[repeated]).astype(np.int32))
    return masks


def _by_content(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by all their words, and whether each equals the one before it."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    return order, np.concatenate([[False], (ordered[1:] == ordered[:-1]).all(axis=1)])


def _distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """One row for each (mini, d), in that order, with summed ``n``; and the minimisers."""
    mini, d, n = (table.column(k).to_numpy() for k in ("mini", "d", "n"))
    order, new = _first_of_equal(mini, d)
    summed = np.add.reduceat(n[order].astype(np.int64), new)
    kept = table.take(pa.array(order[new])).set_column(2, "n", pa.array(summed))
    return kept.combine_chunks(), mini[order[new]]


def _masks(table: pa.Table) -> pa.RecordBatch:
    masks = repeated_windows(table.column("packed").combine_chunks(), table.column("n").to_numpy())
    some = np.flatnonzero(masks)
    return pa.RecordBatch.from_arrays(
        [table.column(k).take(pa.array(some)).combine_chunks() for k in ("mini", "d")] + [pa.array(masks[some])],
        names=["mini", "d", "mask"],
    )


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets at a time, from rows sorted by (mini, d)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < SORTED_ROWS:
            continue
        table, mini = _distinct(pa.Table.from_batches(held))
        whole = int(np.searchsorted(mini, mini[-1]))  # the last bucket may go on
        if whole:
            yield _masks(table.slice(0, whole))
        held = table.slice(whole).to_batches()
        held = [b.cast(batch.schema) for b in held]
        rows = table.num_rows - whole
    if rows:
        yield _masks(_distinct(pa.Table.from_batches(held))[0])


def sorted_buckets(strings: DataFrame) -> DataFrame:
    """mini, d, mask of the super-k-mers (mini, d, n, packed) that hold repeated windows."""
    dealt = strings.select("mini", "d", F.col("n").cast("long").alias("n"), "packed").repartition("mini")
    return dealt.sortWithinPartitions("mini", "d").mapInArrow(_sorted_buckets, MASKS)


def counted_windows(strings: DataFrame) -> DataFrame:
    """The same for buckets of any size: windows are counted one by one."""
    each = strings.groupBy("mini", "d").agg(F.sum("n").alias("n"), F.min("packed").alias("packed"))
    words = each.select("mini", "d", "n", F.split("packed", " ", -1).alias("words"))
    digest = lambda i: F.unhex(F.md5(F.array_join(F.slice("words", i + 1, WINDOW), " ")))
    windows = words.select(
        "mini", "d", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), digest)).alias("bit", "window")
    )
    windows = stored(windows, "repeat-windows")
    repeated = windows.groupBy("window").agg(F.sum("n").alias("seen")).where("seen > 1").select("window")
    return (
        windows.join(repeated, "window")
        .groupBy("mini", "d")
        .agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"))
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two keys that rows with equal id and text share."""
    text = F.col("text")
    without: Column = F.xxhash64(F.lit("without id"), text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text,
        F.coalesce(F.col("doc_id").cast("long"), without).alias("k1"),
        F.xxhash64(text).alias("k2"),
    )


def repeated_places(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """k1, k2, places: structs (start, windows, mask) of the repeated windows of a document."""
    texts = keyed(docs)
    minis = stored(minimisers(texts), "repeat-minimisers")
    tables = bit_tables(minis, wide)
    found = stored(pieces(texts, tables), "repeat-pieces")
    strings = found.where("packed IS NOT NULL").select("mini", "d", "n", "wide", "packed")
    masks = minis.where("low = high").select("mini", F.col("low").alias("d"), F.lit(-1).alias("mask"))
    if tables["mixed"].any():
        masks = masks.unionByName(sorted_buckets(strings.where("NOT wide")))
    if tables["wide"].any():
        masks = masks.unionByName(counted_windows(strings.where("wide")))
    return (
        found.select("k1", "k2", "start", "windows", "mini", "d")
        .join(masks, ["mini", "d"])
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "windows", "mask")).alias("places"))
    )


def removed_words(n: int, start: np.ndarray, windows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a window whose bit is set."""
    bits = np.arange(WINDOW - GRAM + 1)
    row, bit = np.nonzero((mask[:, None] >> bits & 1).astype(bool) & (bits < windows[:, None]))
    first = start[row] + bit
    depth = np.bincount(first, minlength=n + 1) - np.bincount(first + WINDOW, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        places = batch.column("places")
        for i, text in enumerate(_texts(batch.column("text"))):
            words = Words([text])
            n, buffer, removed = len(words.ends), words.buffer, 0
            if places[i].is_valid:
                items = places[i].values
                gone = removed_words(n, *(items.field(k).to_numpy() for k in ("start", "windows", "mask")))
                removed = int(gone.sum())
                buffer = buffer[np.repeat(~gone, np.diff(words.ends, prepend=-1))]
            rows.append((n, removed, hashlib.sha256(buffer[:-1].tobytes()).hexdigest() if n else hashlib.sha256().hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def without_repeats(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by blanks) per document."""
    met = keyed(docs).join(repeated_places(docs, wide), ["k1", "k2"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return met.select("doc_id", "text", "places").mapInArrow(_kept, schema)
