"""Substring deduplication with suffix automata of reference shards.

A window of ``window`` words is repeated if its word sequence starts in a document with a smaller
identifier too; every word that a repeated window covers is removed.

Matching every document against every shard of the corpus would be quadratic, so text is routed
first.  Each window has an anchor, the smallest hash among its runs of ``GRAM`` words, and equal
windows have equal anchors.  Anchors that only one document has are dropped; the passages around the
others go, by anchor, to the shards.  A shard reads its passages in order of document: it streams one
through the suffix automaton of the words it has read from smaller documents, which gives the length
of the longest match ending at every word (the matching statistics); spans of ``window`` words or
more are reported, and then the passage itself enters the automaton.  An automaton starts afresh at
an anchor once it holds ``SHARD_WORDS`` words; nothing is lost by that, as windows of different
anchors differ.  Words are compared as bytes: the result is exact.

A passage that very many documents repeat would be one shard's work.  So of the equal passages that
a task reads it sends on only those of its smallest identifier; the others are known to be repeated
whole, and their spans go past the automata, dealt by document.  Of an anchor's rows, too, a task sends
on the first and the last document, and tells of those between that they share the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.memory import released

GRAM = 4
SHARD_WORDS, CACHE_WORDS = 60_000, 200_000
#: Rows of anchors and bytes of passages among which a task looks for equal ones before it sends them on.
HELD_ROWS, HELD_BYTES = 400_000, 24 << 20


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.words = [-1], [0], 0

    def insert(self, words: list[bytes]) -> None:
        nexts, links, lengths = self.next, self.link, self.length
        self.words += len(words)
        last = 0
        for w in words:
            at = nexts[last].get(w)
            if at is not None:
                last = at if lengths[at] == lengths[last] + 1 else self._copy(last, w, at)
                continue
            new = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            state = last
            while state >= 0 and w not in nexts[state]:
                nexts[state][w] = new
                state = links[state]
            if state >= 0:
                at = nexts[state][w]
                links[new] = at if lengths[at] == lengths[state] + 1 else self._copy(state, w, at)
            last = new

    def _copy(self, state: int, w: bytes, at: int) -> int:
        nexts, links, lengths = self.next, self.link, self.length
        new = len(nexts)
        nexts.append(dict(nexts[at]))
        lengths.append(lengths[state] + 1)
        links.append(links[at])
        links[at] = new
        while state >= 0 and nexts[state].get(w) == at:
            nexts[state][w] = new
            state = links[state]
        return new

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal ranges of ``words`` that matches of ``least`` words or more cover."""
        nexts, links, lengths = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = length = 0
        for end, w in enumerate(words, 1):
            while state and w not in nexts[state]:
                state = links[state]
                length = lengths[state]
            if (to := nexts[state].get(w)) is not None:
                state = to
                length += 1
                if length >= least:
                    start = end - least
                    if out and out[-1][1] >= start:
                        out[-1] = (out[-1][0], end)
                    else:
                        out.append((start, end))
        return out


_hashes: dict[bytes, int] = {}


def _hashed(words: list[bytes]) -> np.ndarray:
    fresh = set(words).difference(_hashes)
    if len(_hashes) + len(fresh) > CACHE_WORDS:
        _hashes.clear()
        fresh = set(words)
    digest = xxhash.xxh3_64_intdigest
    for w in fresh:
        _hashes[w] = digest(w)
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def anchors(words: list[bytes], window: int, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window of ``words``; as many as there are windows."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = _hashed(words)
    with np.errstate(over="ignore"):
        g = np.zeros(len(words) - gram + 1, dtype=np.uint64)
        for j in range(gram):
            g = g * np.uint64(0x9FB21C651E98DF25) + h[j : j + len(g)]
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(29)
    # The minimum over `window - gram + 1` grams, by doubling.
    width, reach = window - gram + 1, 1
    while reach * 2 <= width:
        g = np.minimum(g[:-reach], g[reach:])
        reach *= 2
    return np.minimum(g[:n], g[width - reach : width - reach + n]) if width > reach else g[:n]


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """A row is known by its id and, as ids may repeat, its text's hash; columns to carry along are numbered."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry))
    )


def _dealt(ids: np.ndarray) -> np.ndarray:
    """Where rows go that no shard has to see: spread by id."""
    with np.errstate(over="ignore"):
        return (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _known_shared(anchor: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which rows need not meet others: an anchor's rows between its first and its last, if those differ in id.

    Rows come in order of anchor and id.
    """
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.append(new[1:], len(anchor)) - 1
    known = np.repeat(ids[new] != ids[end], end - new + 1)
    known[new] = known[end] = False
    return known


def _anchor_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def flush(found: list[np.ndarray], ids: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, ids, keys = (np.concatenate(x) for x in (found, ids, keys))
        order, known = np.lexsort((ids, anchor)), np.empty(len(anchor), dtype=bool)
        known[order] = _known_shared(anchor[order], ids[order])
        for s in range(0, len(anchor), 100_000):  # a document's rows one after the other: shuffled, they then compress well
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in (anchor, ids, keys, known)], names=["anchor", "id", "key", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, owner, keys, size = [], [], [], 0
        for batch in batches:
            ids, key = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for k, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if t and len(own := np.unique(anchors(t.split(), window, gram))):
                    found.append(own.view(np.int64))
                    owner.append(np.full(len(own), ids[k]))
                    keys.append(np.full(len(own), key[k]))
                    size += len(own)
                    if size > HELD_ROWS:
                        yield from flush(found, owner, keys)
                        found, owner, keys, size = [], [], [], 0
        if size:
            yield from flush(found, owner, keys)

    return rows.where("id IS NOT NULL").select("id", "t", "key").mapInArrow(released(run, "harrow.llm.substring._hashes"), "anchor long, id long, key long, known boolean")


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and id, those whose anchor is known to be shared, or that several ids have."""
    held = None  # the last anchor's only row so far, or the anchor once it is known to be shared
    for batch in batches:
        known = batch.column(3).to_numpy(zero_copy_only=False)
        if known.any():
            yield batch.filter(batch.column(3)).select(["anchor", "id", "key"])
        batch = batch.filter(pa.array(~known)).select(["anchor", "id", "key"])
        if not batch.num_rows:
            continue
        if held is not None and held[1] is not None and batch.column(0)[0].as_py() == held[0]:
            batch = pa.concat_batches([held[1], batch])
        anchor, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        ends = np.append(starts[1:], len(anchor))
        several = ids[starts] != ids[ends - 1]
        if held is not None and held[1] is None and anchor[0] == held[0]:
            several[0] = True
        keep = np.repeat(several, ends - starts)
        held = anchor[-1], None if several[-1] else batch.slice(int(starts[-1]))
        yield batch.filter(pa.array(keep))


class _Passages:
    """Passages on their way to the shards: of equal ones those of the smallest id, and where the others are."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        self.whole: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, anchor: int, row: int, key: int, start: int, words: bytes, n: int) -> None:
        held = self.first.get((anchor, words))
        if held is None:
            self.first[anchor, words] = [(row, key, start)]
            self.size += len(words) + 200
        elif row == held[0][0]:  # a document does not count against itself
            held.append((row, key, start))
        elif row > held[0][0]:
            self.whole.append((row, key, start, n))
        else:
            self.whole += [(*h, n) for h in held]
            held[:] = [(row, key, start)]
        self.size += 80

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [(a, *h, w) for (a, w), held in self.first.items() for h in held]
        names = ["deal", "id", "key", "start", "words", "n"]
        for s in range(0, len(rows), 20_000):
            deal, ids, keys, starts, words = zip(*rows[s : s + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (deal, ids, keys, starts)), pa.array(words, pa.binary()), pa.nulls(len(ids), pa.int64())], names=names)
        for s in range(0, len(self.whole), 100_000):
            ids, keys, starts, n = (np.array(x, dtype=np.int64) for x in zip(*self.whole[s : s + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (_dealt(ids), ids, keys, starts)), pa.nulls(len(ids), pa.binary()), pa.array(n)], names=names)
        self.__init__()


def _passages(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Passages ``(deal, id, key, start, words)`` around the anchors a row has in ``anchors``, and spans ``(.., start, null, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Passages()
        for batch in batches:
            for i, key, t, known in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "t")), batch.column("anchors"), strict=True):
                if not known.is_valid:
                    continue
                words = t.encode().split()
                found = anchors(words, window, gram)
                hit = np.isin(found, known.values.to_numpy().view(np.uint64))
                starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                ends = np.append(starts[1:], len(found))
                chosen = hit[starts]
                for anchor, a, b in zip(found[starts[chosen]].view(np.int64).tolist(), starts[chosen].tolist(), ends[chosen].tolist(), strict=True):
                    out.add(anchor, i, key, a, b" ".join(words[a : b + window - 1]), b + window - 1 - a)
                if out.size > HELD_BYTES:
                    yield from out.flush()
        yield from out.flush()

    return rows.mapInArrow(released(run, "harrow.llm.substring._hashes"), "deal long, id long, key long, start long, words binary, n long")


def _match(window: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held, now, anchor = Automaton(), set(), None, None
        waiting: list[list[bytes]] = []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for a, i, key, start, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:  # known to be repeated whole
                    out.append((i, key, start, start + n))
                    continue
                if (a, i) != (anchor, now):
                    for words in waiting:  # what a document has itself does not count against it
                        automaton.insert(words)
                    waiting.clear()
                    if a != anchor and automaton.words > shard_words:
                        automaton, held = Automaton(), set()
                    anchor, now = a, i
                words = text.split()
                out += [(i, key, start + s, start + e) for s, e in automaton.spans(words, window)]
                if text not in held:
                    held.add(text)
                    waiting.append(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "key", "a", "b"])

    return run


def repeated_spans(rows: DataFrame, window: int, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Spans ``(id, key, a, b)`` of words that a smaller id has too; spans of a row may overlap."""
    met = _anchor_rows(rows, window, gram).repartition(F.when(F.col("known"), F.xxhash64("id")).otherwise(F.col("anchor")))
    hits = met.sortWithinPartitions("anchor", "id").mapInArrow(shared, "anchor long, id long, key long")
    by_row = hits.groupBy("id", "key").agg(F.collect_list("anchor").alias("anchors"))
    # The same left join as the last step's, so that Spark deals the texts out once and reads them twice.
    met = rows.join(by_row, ["id", "key"], "left").withColumn("t", F.when(F.col("anchors").isNotNull(), F.col("t")))
    passages = _passages(met, window, gram)
    return passages.repartition("deal").sortWithinPartitions("deal", "id").mapInArrow(released(_match(window, shard_words)), "id long, key long, a long, b long")


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, carry: list[str] | None = None, verbatim: bool = False) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of every row; ``kept`` is the words left, joined by one space.

    The columns named in ``carry`` follow as ``c0``, ``c1`` and so on.  With ``verbatim`` a text that
    loses nothing is given as it is.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  A null text has no words, and a text of
    fewer words than the window keeps all.  Rows that share an id do not count against each other;
    rows with a null id keep all words and count against none.  Ids must be whole numbers.
    """
    rows = _rows(docs, id_col, text_col, carry or [])
    carried = [c for c in rows.columns if c not in ("id", "key", "t")]
    spans = repeated_spans(rows, window, gram).groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for t, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                words = (t or b"").split()
                counts.append(len(words))
                if own.is_valid:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, own.values.field("a").to_numpy(), 1)
                    np.subtract.at(change, own.values.field("b").to_numpy(), 1)
                    stay = np.cumsum(change)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                removed.append(counts[-1] - len(words))
                kept.append(t if verbatim and removed[-1] == 0 else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *(batch.column(c) for c in carried)], names=["id", "n_words", "n_removed", "kept", *carried])

    marked = rows.join(spans, ["id", "key"], "left").select("id", "t", "spans", *carried)
    types = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return marked.mapInArrow(released(run), f"id long, n_words long, n_removed long, kept string{types}").withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated words removed from their texts; texts without any stay as they are.

    ``size_col``, where there is one, holds the new text's characters for the texts that changed.
    """
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    done = remove_repeats(docs, window, id_col, text_col, carry=carry, verbatim=True)
    now = {id_col: F.col(id_col), text_col: F.col("kept")} | {c: F.col(f"c{k}") for k, c in enumerate(carry)}
    if size_col in carry:
        now[size_col] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(now[size_col])
    return done.select(*(now[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
