"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line with its line feed. Its pieces are runs of words (1, 1, 2, 2, 4, 4, 8,
8, then 16 in the first paragraph, so that short texts have several; 16 each in others),
cut from its start. A section ends after a blank paragraph and after one whose hash says
so, so sections find each other again after an edit. A node's hash covers the 128-bit
hashes below it and a tag of its level: root over sections, over paragraphs, over pieces. A
fingerprint is the root and the leaves in order, as ``hash.length`` (the first 32 bits of the
piece's hash) with ``~`` between the pieces of a paragraph, ``,`` between paragraphs and ``;``
between sections.

Equal roots are equal texts. Two fingerprints match in branches: equal sections first, then
equal paragraphs, then pieces. The likeness is the share of characters in branches that match;
those matched outside the heaviest sequence that stands in the same order in both texts were
moved and count ``MOVED``. It is 1 for equal roots only. ``differences`` gives the character
ranges of the branches without counterpart.

Every document is compared with its neighbour in descending order of ids. Documents are
dealt by ranges of (id, hash of the text) and walked in order, one text held at a time; the
last document of a part meets the first of the next by a join over parts, one row each.

Defined cases: null is the empty text, whose fingerprint has one empty leaf. Rows without id
come last. Rows with one id follow each other by hash of the text, then by text. The
neighbour of the last document is the first one; a single document is its own. No rows give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failsift.llm.tables import small_batches, stored

SECTION_EVERY = 4
MOVED = 0.5
LONGEST_WORD = 64
_PIECE = re.compile(rf"\s*(?:\S{{1,{LONGEST_WORD}}}\s*){{1,16}}|\s+")
_FIRST = [re.compile(rf"\s*(?:\S{{1,{LONGEST_WORD}}}\s*){{1,{n}}}|\s+") for n in (1, 1, 2, 2, 4, 4, 8, 8)]


def _hash(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(level + data, digest_size=16).digest()


def _pieces(paragraph: str, first: bool) -> list[str]:
    found, at = [], 0
    if first:
        for pattern in _FIRST:
            match = pattern.match(paragraph, at)
            if not match:
                break
            found.append(match.group())
            at = match.end()
    found += _PIECE.findall(paragraph, at)
    return found or [""]


def _paragraphs(text: str) -> Iterator[str]:
    at = 0
    while True:
        end = text.find("\n", at)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    if at < len(text) or at == 0:
        yield text[at:]


def fingerprint(text: str) -> str:
    sections, section, hashes, roots = [], [], [], []
    for i, paragraph in enumerate(_paragraphs(text)):
        pieces = _pieces(paragraph, i == 0)
        leaves = [_hash(b"leaf", piece.encode()) for piece in pieces]
        section.append("~".join(f"{leaf[:4].hex()}.{len(piece):x}" for leaf, piece in zip(leaves, pieces)))
        own = _hash(b"paragraph", b"".join(leaves))
        hashes.append(own)
        if not paragraph.strip() or own[0] % SECTION_EVERY == 0:
            sections.append(",".join(section))
            roots.append(_hash(b"section", b"".join(hashes)))
            section, hashes = [], []
    if section:
        sections.append(",".join(section))
        roots.append(_hash(b"section", b"".join(hashes)))
    return _hash(b"root", b"".join(roots)).hex() + ":" + ";".join(sections)


def _length(node: str) -> int:
    return sum(int(leaf.rpartition(".")[2], 16) for leaf in re.split("[;,~]", node))


Node = tuple[int, str]  # character the node begins at, and its part of the fingerprint


def _parts(nodes: list[Node], separator: str) -> list[Node]:
    found = []
    for at, node in nodes:
        for part in node.split(separator):
            found.append((at, part))
            at += _length(part)
    return found


def _paired(mine: list[Node], theirs: list[Node]) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """Equal nodes of both lists, first with first, and the rest of each list."""
    waiting = defaultdict(deque)
    for node in theirs:
        waiting[node[1]].append(node)
    pairs, rest = [], []
    for node in mine:
        if waiting[node[1]]:
            pairs.append((node, waiting[node[1]].popleft()))
        else:
            rest.append(node)
    return pairs, rest, sorted(node for nodes in waiting.values() for node in nodes)


def _in_order(pairs: list[tuple[Node, Node]]) -> int:
    """Characters of the heaviest choice of pairs that stand in one order in both texts."""
    rank = {at: i + 1 for i, at in enumerate(sorted({theirs[0] for _, theirs in pairs}))}
    best = [0] * (len(rank) + 1)  # a tree of prefix maxima over the places in the other text
    for (_, node), (at, _) in sorted(pairs, key=lambda pair: pair[0][0]):
        i, weight = rank[at] - 1, _length(node)
        before = 0
        while i > 0:
            before, i = max(before, best[i]), i & (i - 1)
        i = rank[at]
        while i < len(best):
            best[i] = max(best[i], before + weight)
            i += i & -i
    i, whole = len(best) - 1, 0
    while i > 0:
        whole, i = max(whole, best[i]), i & (i - 1)
    return whole


def likeness(a: str, b: str) -> float:
    """From 0 (nothing in common) to 1 (equal roots, and nothing else)."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    mine, theirs = _parts([(0, a.partition(":")[2])], ";"), _parts([(0, b.partition(":")[2])], ";")
    pairs, mine, theirs = _paired(mine, theirs)
    for separator in ",~":
        more, mine, theirs = _paired(_parts(mine, separator), _parts(theirs, separator))
        pairs += more
    total = _length(a.partition(":")[2]) + _length(b.partition(":")[2])
    if not total:
        return 0.0
    matched, kept = sum(_length(node) for (_, node), _ in pairs), _in_order(pairs)
    share = 2 * (kept + MOVED * (matched - kept)) / total
    return min(share, 1 - 1 / (total + 1))  # leaves show 32 bits of their hash


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Character ranges of the text of ``a`` whose branches have no equal in ``b``."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    other = Counter(re.split("[;,~]", b.partition(":")[2]))
    ranges, at = [], 0
    for leaf in re.split("[;,~]", a.partition(":")[2]):
        size = _length(leaf)
        if other[leaf] > 0:
            other[leaf] -= 1
        elif ranges and ranges[-1][1] == at:
            ranges[-1] = (ranges[-1][0], at + size)
        else:
            ranges.append((at, at + size))
        at += size
    return ranges


ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _compared(doc_id: int | None, text: str, print_: str, next_text: str, next_print: str) -> tuple:
    third = len(text) // 3
    edited = text[: len(text) - third] + next_text[:third]
    edited_print = fingerprint(edited)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        print_,
        edited_print,
        likeness(print_, edited_print),
        likeness(print_, next_print),
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order: finished ones, its first text (head) and its last one (tail)."""
    part, waiting = TaskContext.get().partitionId(), None
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*_COLUMNS, "part", "kind", "text"])

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = fingerprint(text)
            if waiting is None:
                rows.append((doc_id, None, None, own, None, None, None, part, "head", text))
            else:
                rows.append((*_compared(*waiting, text, own), part, "done", None))
            waiting = (doc_id, text, own)
        yield batch_of(rows)
    if waiting is not None:
        yield batch_of([(waiting[0], None, None, waiting[2], None, None, None, part, "tail", waiting[1])])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            _compared(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_print"]) for r in batch.to_pylist()
        ]
        columns = list(zip(*rows)) or [()] * len(_COLUMNS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()])], _COLUMNS
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited form, and likeness to that and to the next text."""
    small_batches(docs.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.col("mixed")]
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (
        given.withColumn("mixed", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "text")
        .select("doc_id", "text")
    )
    walked = stored(ordered.mapInArrow(_walk, ROW + ", part int, kind string, text string"), "merkle")
    heads = walked.where("kind = 'head'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")
    )
    tails = walked.where("kind = 'tail'")
    following = tails.select(
        F.col("part").alias("p"),
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"),
    )
    closed = (
        tails.join(following, F.col("part") == F.col("p"))
        .join(heads, "next_part")
        .select("doc_id", "text", "fingerprint", "next_text", "next_print")
        .mapInArrow(_finish, ROW)
    )
    return walked.where("kind = 'done'").select(*_COLUMNS).unionByName(closed)
