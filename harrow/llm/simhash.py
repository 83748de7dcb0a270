"""SimHash near-deduplication by meet-in-the-middle ball hashing.

A fingerprint is cut into blocks.  Fingerprints at most ``radius`` bits apart have a block in which
they differ by at most ``reach = radius // blocks`` bits, so every fingerprint emits, for each block,
the block's variants within half of that reach; two blocks within reach always have a variant in
common.  An odd reach is met halfway by parity: blocks of an odd number of ones emit the larger ball,
those of an even number the smaller, and blocks an odd distance apart differ in parity.  Rows are
shuffled on variants, and pairs that collide are verified on the whole fingerprints.

For 64 bits and radius 3 that is 2 blocks of 32 bits and reach 1: 34 variants on average, where a
ball around the whole fingerprint would take 2,081.

Equal fingerprints are one row from the start, and a task turns the verified pairs of its variants
into the links of a forest before it writes them, so a large group of near copies costs as many
links as it has members, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import scratch
from harrow.llm.components import components, named
from harrow.llm.memory import released

SLICE_WORDS = 100_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows that one row is compared with at once.
TILE = 65_536


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased: what ``bytes.split`` splits at."""
    return text.translate(LOWER).split()


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of a hash: splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, shingle: int = 3, lanes: int = 1, seed: int = 42) -> np.ndarray:
    """``lanes`` 64-bit words; bit b is 1 if set in over half of the shingles' hashes."""
    words = words_of(text)
    votes, total = np.zeros((lanes, 64), dtype=np.int64), max(len(words) - shingle + 1, 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for a in range(0, total, SLICE_WORDS):
        part = words[a : a + SLICE_WORDS + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(len(part) - shingle + 1, 1)
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[min(shingle, len(part)) - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
        for k in range(lanes):
            h = hashes if k == 0 else _mix(hashes, k)
            for b in range(0, n, 4096):  # bytes of counts stay in cache
                votes[k] += np.unpackbits(h[b : b + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = votes * 2 > total
    return np.packbits(bits.reshape(-1), bitorder="little").view("<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, lanes: int = 1) -> DataFrame:
    """``(id, fp array<long>, key)`` of every whole text, lane 0 first; a text without words has zeros.

    ``key`` is a hash of the text, which tells rows of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle, lanes) for t in texts], dtype=np.uint64).reshape(-1)
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(fps.view(np.int64))), batch.column(2)], names=["id", "fp", "key"])

    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("key"))
    return rows.mapInArrow(released(run), f"id {kind}, fp array<long>, key long")


def masks(bits: int, radius: int) -> np.ndarray:
    """Every set of at most ``radius`` of ``bits`` bits, as integers; the empty one first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], dtype=np.uint64)


def _cut(fp: np.ndarray, start: int, bits: int) -> np.ndarray:
    """Bits ``start`` to ``start + bits`` of each row's lanes; at most 64."""
    lane, shift = divmod(start, 64)
    out = fp[:, lane] >> np.uint64(shift)
    if shift and shift + bits > 64:
        out = out | (fp[:, lane + 1] << np.uint64(64 - shift))
    return out & np.uint64((1 << bits) - 1)


def variants(fp: np.ndarray, blocks: list[tuple[int, int]], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the variants that rows of fingerprints emit; a key also holds its block's number, above its bits."""
    rows, keys, width = [], [], max(bits for _, bits in blocks)
    if width + len(blocks).bit_length() > 63:
        raise ValueError("blocks and their numbers take 63 bits at most")
    for number, (start, bits) in enumerate(blocks):
        value = _cut(fp, start, bits)
        odd = np.bitwise_count(value) % 2 == 1
        for chosen, ball in ((~odd, reach // 2), (odd, (reach + 1) // 2)):
            at = np.flatnonzero(chosen)
            near = masks(bits, ball)
            rows.append(np.repeat(at, len(near)))
            keys.append((value[at][:, None] ^ near[None, :]).reshape(-1) | np.uint64(number << width))
    # A row's variants one after the other: shuffled, they then compress well.
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate(keys)[order]


class Forest:
    """Union-find over the rows of one task; remembers only the links that joined something."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _within(nodes: np.ndarray, fp: np.ndarray, radius: int, forest: Forest) -> None:
    """Connect the rows of one variant that are within ``radius``.

    Rows are reached from one another breadth first, and only what is not reached yet is compared
    to, so a group of near copies costs its size times the rows that are not in it, not its square.
    """
    left = np.arange(len(nodes))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.zeros(len(left), dtype=bool)
            for a in range(0, len(left), TILE):
                near[a : a + TILE] = np.bitwise_count(fp[left[a : a + TILE]] ^ fp[at]).sum(axis=1) <= radius
            if near.any():
                found = left[near]
                for node in nodes[found].tolist():
                    forest.join(int(nodes[at]), node)
                queue.extend(found.tolist())
                left = left[~near]


def link(nodes: np.ndarray, fp: np.ndarray, cuts: np.ndarray, radius: int, forest: Forest) -> None:
    """Rows sorted by variant; ``cuts`` are the first rows of each.  Pairs of small groups are checked all at once."""
    size = np.diff(np.append(cuts, len(nodes)))
    for n in np.unique(size[(size > 1) & (size <= 64)]).tolist():
        at = cuts[size == n]
        i, j = np.triu_indices(n, 1)
        for part in np.array_split(at, max(1, len(at) * len(i) // 500_000)):
            x, y = (part[:, None] + i).reshape(-1), (part[:, None] + j).reshape(-1)
            near = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= radius
            near &= nodes[x] != nodes[y]
            pairs = np.unique(np.c_[nodes[x[near]], nodes[y[near]]], axis=0) if near.any() else np.empty((0, 2), dtype=np.int64)
            for p, q in pairs.tolist():
                forest.join(p, q)
    for k in np.flatnonzero(size > 64).tolist():
        rows = slice(cuts[k], cuts[k] + size[k])
        own, first = np.unique(nodes[rows], return_index=True)
        _within(own, fp[rows][first], radius, forest)


def near_links(unique: DataFrame, radius: int, blocks: list[tuple[int, int]], reach: int) -> DataFrame:
    """Links ``(a, b)`` that connect what ``unique(node long, fp array<long>)`` has within ``radius``."""
    lanes = max((start + bits - 1) // 64 for start, bits in blocks) + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            for a in range(0, len(node), 2000):
                row, key = variants(fp[a : a + 2000], blocks, reach)
                width = fp.shape[1]
                held = fp[a : a + 2000][row]
                for s in range(0, len(row), 100_000):
                    e = min(s + 100_000, len(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[s:e].view(np.int64)), pa.array(node[a : a + 2000][row[s:e]]), *(pa.array(np.ascontiguousarray(held[s:e, k]).view(np.int64)) for k in range(width))],
                        names=["key", "node", *(f"f{k}" for k in range(width))],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by variant; the last group of a batch waits, in pieces, for its rest."""
        forest, held = Forest(), []

        def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp = np.stack([batch.column(2 + k).to_numpy().view(np.uint64) for k in range(batch.num_columns - 2)], axis=1)
            held.append((key, node, fp))
            if key[0] == key[-1] == held[0][0][-1]:  # nothing has ended yet
                continue
            key, node, fp = whole()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = cuts[-1]
            held = [(key[end:], node[end:], fp[end:])]
            link(node[:end], fp[:end], cuts[:-1], radius, forest)
        if held:
            key, node, fp = whole()
            link(node, fp, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), radius, forest)
        for s in range(0, len(forest.links), 50_000):
            pairs = np.array(forest.links[s : s + 50_000], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    fields = ", ".join(f"f{k} long" for k in range(lanes))
    keyed = unique.mapInArrow(released(emit), f"key long, node long, {fields}")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(released(meet), "a long, b long")


def group_near(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    lanes: int = 1,
    blocks: list[tuple[int, int]] | None = None,
    reach: int | None = None,
    link_empty: bool = True,
) -> DataFrame:
    """``(id, fp, key, component)`` of every row: component is the smallest id reachable through fingerprints within ``radius``.

    With the default blocks every link is found (``blocks`` of equal width, ``reach`` what the pigeonhole
    principle asks for); fewer or narrower ones find those links that differ by ``reach`` or less in a block.
    Null and empty texts have the fingerprint zero and link like any other, or only with each other
    where ``link_empty`` is off; rows whose id is null are given back with a null component and link
    nothing; ids must be whole numbers, and rows that share one are rows of their own (``key`` hashes
    the text).  Equal texts, repeated rows and ties have equal fingerprints.  Other columns, whatever
    their names, are ignored; an empty table gives an empty table.  A very long text is taken in slices.
    """
    if blocks is None:
        width = 32
        blocks = [(s, width) for s in range(0, 64 * lanes, width)]
        reach = radius // len(blocks)
    rows = scratch.materialize(fingerprints(docs, id_col, text_col, shingle, lanes), "simhash")
    # A fingerprint is a node of its own; its number is fixed as the table is written.
    unique = rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").cast("long").alias("least")).withColumn("node", F.monotonically_increasing_id())
    unique = scratch.materialize(unique, "simhash")
    linked = unique if link_empty else unique.where(F.exists("fp", lambda x: x != 0))
    found = components(near_links(linked.select("node", "fp"), radius, blocks, reach))
    roots = named(unique, found).select("fp", "component")
    return rows.join(roots, "fp", "left").select(F.col("id").alias(id_col), "fp", "key", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group the smallest id, of its rows the one with the smallest ``key``.

    Rows are told apart by id and text, so a row that only shares its id with a near copy stays, and
    rows that repeat both stay or go together; rows without id stay.  Null and empty texts, long
    texts and empty tables are as in ``group_near``.
    """
    found = group_near(docs, id_col, text_col, **settings).select(F.col(id_col).alias("id"), "key", "component").where("id IS NOT NULL")
    first = found.where("id = component").groupBy("id").agg(F.min("key").alias("least"))
    others = found.where("id = component").join(first, "id").where("key <> least").select("id", "key")
    gone = found.where("id <> component").select("id", "key").unionAll(others).distinct()
    # The columns go along as one, so that no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))
    return rows.join(gone, ["id", "key"], "left_anti").select("row.*")
