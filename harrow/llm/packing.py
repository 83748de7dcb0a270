"""Packing by deficit round-robin over source queues, each window filled to target proportions.

A source is a queue of tokens.  In every window of ``length`` tokens source ``s`` is due its share of
the window plus what it was left owed (its deficit) by the windows before.  The whole tokens of that
are served, and the few places left go to the largest deficits, lower queue first.  As a queue's due
tokens up to window ``w`` are ``share * length * w``, its deficit at any window has a closed form:
a task starts in the middle with the very deficits that the windows before it would have carried
there, and no task waits for another.  Every source that is due a token a window has a queue (at most
``length`` of them); the smaller ones share one more, which serves them in order of task, then source.

Texts are tokenised once, the ids written with their place in their task's queues; only the counts
a task and queue are gathered, and where a document's ids fall follows from them.  Ids never shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm import scratch
from harrow.llm.memory import released

LENGTH, END_ID = 4096, 2
SLICE_CHARS, CACHE_WORDS = 2_000_000, 350_000
COMBINING = re.compile("[\u0300-\u036f]")
#: Classes of bytes: white space, ASCII letters and digits, other ASCII but the apostrophe (control characters included), the rest.
BLANK, PLAIN, MARK, OTHER = 0, 1, 2, 3
CLASS = np.array([BLANK if c in b"\t\n\v\f\r " else OTHER if c >= 128 or c == 39 else PLAIN if chr(c).isalnum() else MARK for c in range(256)], dtype=np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
# How a tokenizer has to cut text for its words to be encoded one by one.
NORMALIZERS, PATTERN = ["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordTokenizer:
    """Ids as the tokenizers library gives them without special tokens, each distinct word encoded once.

    The vocabulary's words never span white space, and letters are cut from marks.  So a text is cut
    at ASCII white space and around every run of ASCII marks between a letter or digit and what is
    no mark; A-Z are lower-cased.  Where a combining mark could join a letter, words stay as they
    are, and a text that may hold special tokens is encoded whole, as is every text if the tokenizer
    is of another kind.
    """

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (
            steps == NORMALIZERS and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": PATTERN} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
            and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and rules["truncation"] is None
        )
        # The byte alphabet: printable bytes stand for themselves, the others in order from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in set(printable)]
        self.alphabet = {c: 256 + k for k, c in enumerate(hidden)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        cut, whole, apart = [], [], []
        for i, t in enumerate(texts):
            special = not self.by_word or any(m in t for m in self.specials)
            (whole if special else apart if not t.isascii() and COMBINING.search(t) else cut).append(i)
        for i in whole:
            out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        split = {i: texts[i].encode().split() for i in apart}
        self._learn(list(set().union(*split.values())))
        for i, words in split.items():
            out[i] = b"".join(map(self.known.__getitem__, words))
        if cut:
            for i, ids in zip(cut, self._encode_cut([texts[i].encode() for i in cut]), strict=True):
                out[i] = ids
        return out

    def _encode_cut(self, texts: list[bytes]) -> list[bytes]:
        starts, ends, data = self._cut(b"\n".join(texts))
        # The words without the white space between them, each distinct one once.
        lengths = ends - starts
        edges = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[CLASS[data] != BLANK])]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self._learn(distinct)
        coded = [self.known[w] for w in distinct]
        flat, sizes = np.frombuffer(b"".join(coded), dtype="<u4"), np.array([len(c) // 4 for c in coded], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        which = words.indices.to_numpy()
        many = sizes[which]
        stops = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.arange(stops[-1]) + np.repeat(at[which] - stops[:-1], many)].astype("<u4", copy=False).tobytes()
        # A text's words are those that start before its end.
        bounds = np.cumsum([len(t) + 1 for t in texts])
        last = (stops[np.searchsorted(starts, bounds)] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]

    @staticmethod
    def _cut(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words start and end, and the text in lower case."""
        data = LOWER[np.frombuffer(text, dtype=np.uint8)]
        kind = np.concatenate([[BLANK], CLASS[data], [BLANK]]).astype(np.uint8)  # shifted by one
        mark = kind == MARK
        first, after = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1, np.flatnonzero(mark[:-1] & ~mark[1:]) + 1
        alone = (kind[first - 1] == PLAIN) & (kind[after] != OTHER)
        edge = np.zeros(len(kind), dtype=bool)
        edge[first[alone]] = edge[after[alone]] = True
        ink = kind != BLANK
        edge[1:] |= ink[1:] != ink[:-1]
        begins = np.flatnonzero(edge & ink) - 1
        ends = np.flatnonzero(edge[1:] & ink[:-1])
        return begins, ends, data

    def _learn(self, words: list[bytes]) -> None:
        known = self.known
        if len(known) > CACHE_WORDS:  # what was not learned lately goes first
            kept = {w: known[w] for w in words if w in known} | dict(list(known.items())[-CACHE_WORDS // 2 :])
            known.clear()
            known.update(kept)
        other = []
        to_ids, alphabet = self.tokenizer.model.tokenize, self.alphabet
        for w in [w for w in words if w not in known]:
            t = w.decode()
            if t.isascii():
                if not (t.isalpha() and t.islower()):
                    other.append(w)
                    continue
            elif t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t):
                t = w.decode("latin-1").translate(alphabet)
            else:
                other.append(w)
                continue
            # One run of letters that nothing changes: the model alone gives its ids.
            known[w] = array("I", [x.id for x in to_ids(t)]).tobytes()
        for a in range(0, len(other), 20_000):
            part = other[a : a + 20_000]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update(zip(part, [array("I", e.ids).tobytes() for e in coded], strict=True))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenize(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text, little-endian 32-bit; a worker keeps its tokenizers."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path].encode(texts)


def token_rows(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, source, ids binary, n_tokens, task, before)``; ``before`` counts the source's tokens earlier in the task.

    Each document's ids end with ``END_ID``; a null text is empty and has that id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from harrow.llm.sentencepiece_codec import slices

        task, end, ahead = TaskContext.get().partitionId(), np.array([END_ID], dtype="<u4").tobytes(), {}
        for batch in batches:
            texts, sources = [t or "" for t in batch.column(2).to_pylist()], batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                ids = [x + end for x in tokenize(tokenizer_path, texts[a:b])]
                counts, before = [len(x) // 4 for x in ids], []
                for s, n in zip(sources[a:b], counts, strict=True):
                    before.append(ahead.get(s, 0))
                    ahead[s] = before[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sources[a:b], pa.string()), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([task] * (b - a), pa.int32()), pa.array(before, pa.int64())],
                    names=["id", "source", "ids", "n_tokens", "task", "before"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(released(run), f"id {kind}, source string, ids binary, n_tokens long, task int, before long")


class Schedule:
    """How many tokens of each queue the windows up to any window hold.

    Every queue has to be due a token a window at least, so that what it is served never shrinks.

    ``totals`` are the queues' tokens.  Without ``weights`` the target is the corpus's own mixture.
    With them the windows follow the weights until a queue is empty, and the weights of the rest
    from there on: a phase ends where a queue does, so there are at most as many as queues.
    """

    def __init__(self, totals: list[int], length: int = LENGTH, weights: list[float] | None = None) -> None:
        self.totals, self.length, self.all = [int(t) for t in totals], length, int(sum(totals))
        share = [Fraction(t) for t in self.totals] if weights is None else [Fraction(w).limit_denominator(10**6) for w in weights]
        if any(w <= 0 for w, t in zip(share, self.totals, strict=True) if t):
            raise ValueError("a queue that has tokens needs a weight above zero")
        #: From token ``at`` on a queue is due ``(base + rate * tokens) / unit``, all whole numbers; it is open where ``rate`` is above 0.
        self.phases: list[tuple[Fraction, list[int], list[int], int]] = []
        at, given, open_ = Fraction(0), [Fraction(0)] * len(totals), {i for i, t in enumerate(self.totals) if t}
        while open_:
            whole = sum(share[i] for i in open_)
            rate = [share[i] / whole if i in open_ else Fraction(0) for i in range(len(totals))]
            base = [g - r * at for g, r in zip(given, rate, strict=True)]
            unit = lcm(*(x.denominator for x in (*base, *rate)))
            self.phases.append((at, [int(b * unit) for b in base], [int(r * unit) for r in rate], unit))
            step = min((self.totals[i] - given[i]) / rate[i] for i in open_)
            given = [g + r * step for g, r in zip(given, rate, strict=True)]
            at, open_ = at + step, {i for i in open_ if given[i] < self.totals[i]}
        self._known: dict[int, tuple[list[int], list[int]]] = {}

    def served(self, window: int) -> tuple[list[int], list[int]]:
        """Tokens of each queue in the windows before ``window``, and of all queues before each."""
        if window not in self._known:
            if len(self._known) * len(self.totals) > 2_000_000:
                self._known.clear()
            tokens = min(window * self.length, self.all)
            out, left = [0] * len(self.totals), [0] * len(self.totals)
            if self.phases:
                _, base, rate, unit = next(p for p in reversed(self.phases) if p[0] <= tokens)
                due = [b + r * tokens for b, r in zip(base, rate, strict=True)]
                out, left = [d // unit for d in due], [d % unit for d in due]
            for i in sorted(range(len(out)), key=lambda i: (-left[i], i))[: tokens - sum(out)]:
                out[i] += 1
            self._known[window] = out, list(accumulate(out, initial=0))
        return self._known[window]

    def window_of(self, queue: int, token: int) -> int:
        """The window that holds the queue's token."""
        high = -(-self.all // self.length)
        at, base, rate, unit = next(p for p in reversed(self.phases) if p[2][queue] and p[1][queue] + p[2][queue] * p[0] <= token * p[3])
        guess = (token * unit - base[queue]) // rate[queue] // self.length
        low, high = max(0, guess - 2), min(high, guess + 3)
        while self.served(low)[0][queue] > token:
            low -= 1
        while low + 1 < high and self.served(low + 1)[0][queue] <= token:
            low += 1
        return low


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces ``(id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    Every id lies in one piece; sequences are full but for the last.  A null source is the source
    ``''``; repeated rows are packed each; an empty table gives no pieces.  With ``weights`` every
    source needs one.
    """
    rows = scratch.materialize(token_rows(docs, tokenizer_path, id_col, text_col, source_col), "packing")
    counts = rows.groupBy("source", "task").agg(F.sum("n_tokens").alias("n"))
    by_source = counts.groupBy("source").agg(F.sum("n").alias("n"))
    everything = by_source.agg(F.sum("n")).first()[0] or 0
    if weights is None:  # a source that is due a token a window has a queue: at most ``length`` sources
        mine = by_source.where(F.col("n") * length >= everything)
    else:
        mine = by_source.where(F.col("source").isin(list(weights)))
    top = [(r["source"], r["n"]) for r in mine.orderBy(F.desc("n"), "source").collect()]
    totals = [n for _, n in top] + [everything - sum(n for _, n in top)]
    if weights is not None:
        whole = sum(weights[s] for s, _ in top)
        if totals[-1] or any(weights[s] * length < whole for s, _ in top):
            raise ValueError(f"{totals[-1]} tokens of sources without a weight, or a weight of less than a token a window")
    elif top and 0 < totals[-1] * length < everything:  # the common queue is due a token a window, too
        totals[-1] += top.pop()[1]
        totals.pop(-2)
    schedule = Schedule(totals, length, None if weights is None else [weights[s] for s, _ in top] + [1.0])
    queues = docs.sparkSession.createDataFrame([(s, k) for k, (s, _) in enumerate(top)], "source string, queue int")
    counts = counts.join(F.broadcast(queues), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(top))))
    # Where a task's part of a queue starts, then where each of its sources does: no window holds more than a row a task or a task's sources.
    by_task = counts.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    by_task = by_task.select("queue", "task", (F.sum("n").over(Window.partitionBy("queue").orderBy("task")) - F.col("n")).alias("task_at"))
    within = F.sum("n").over(Window.partitionBy("queue", "task").orderBy("source")) - F.col("n")
    starts = counts.withColumn("within", within).join(by_task, ["queue", "task"]).select("source", "task", "queue", (F.col("task_at") + F.col("within")).alias("start_at"))
    # Written, so that its size is known when the join is planned: small, it is broadcast, and ids do not move.
    starts = scratch.materialize(starts, "packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"row": [], "start": [], "length": [], "crc": [], "sequence": [], "offset": [], "ids": []}
            for k, (ids, n, q, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids", "n_tokens", "queue", "at")), strict=True)):
                window, start = schedule.window_of(q, at), 0
                while start < n:
                    (before, lower), (after, upper) = schedule.served(window), schedule.served(window + 1)
                    take = min(n - start, after[q] - at - start)
                    if take > 0:
                        piece = ids[4 * start : 4 * (start + take)]
                        offset = upper[q] - lower[q] + at + start - before[q]
                        for key, value in zip(out, (k, start, take, zlib.crc32(piece), window, offset, piece if with_ids else None), strict=True):
                            out[key].append(value)
                        start += take
                    window += 1
            take_rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take_rows), batch.column("source").take(take_rows), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc")), batch.column("n_tokens").take(take_rows), *(pa.array(out[c], pa.int64()) for c in ("sequence", "offset")), *([pa.array(out["ids"], pa.binary())] if with_ids else [])],
                names=["id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])],
            )

    placed = rows.join(starts, ["source", "task"]).select("id", "source", "ids", "n_tokens", "queue", (F.col("start_at") + F.col("before")).alias("at"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return placed.mapInArrow(released(run), schema).withColumnRenamed("id", id_col)
