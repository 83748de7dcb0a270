"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array.  A round finds each word's best pair rank by a
segmented minimum, merges that pair's leftmost occurrences in all words at once, compacts the
arrays and drops words without pairs; it ends when no word has one left.  Where merging one
occurrence could make a pair that ranks as well or better, only a word's leftmost occurrence is
merged in that round, so the result is the one-at-a-time result exactly.

No piece holds a space after another character, nor a line end, so texts are split there and each
distinct word is encoded once for a slice of documents.  Decoding gathers piece bytes by id.

A word of very many characters would take nearly as many rounds as it has distinct pairs, each over the
whole word, so words over ``LONG_WORD`` characters take their merges one at a time from a heap instead.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Characters of text handled at once, and words whose ids a worker remembers.
SLICE_CHARS, CACHE_WORDS = 2_000_000, 300_000
#: Words of more characters are merged by a heap.
LONG_WORD = 256


class Codec:
    """The vocabulary of a BPE model with byte fallback, as arrays."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        self.size = n = sp.vocab_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        normal = np.zeros(n, dtype=bool)
        texts = [b""] * n
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                texts[i] = bytes([int(piece[1:-1], 16)])
            elif sp.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif sp.is_unknown(i):
                texts[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                normal[i] = True
                texts[i] = piece.replace(SPACE, " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        # a b: neither merged spaces nor folded letters, and one space is put before the text
        sample = "  ﬁ ＡÅ² a  "
        if sp.decode(sp.encode(sample)) != sample:
            raise ValueError("models that normalise text are not supported")
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for i, p in enumerate(pieces) if normal[i]):
            raise ValueError("pieces that span words are not supported")

        # Symbols: the pieces, then characters that only occur within pieces, then all other characters by code point.
        symbol = {p: i for i, p in enumerate(pieces) if normal[i]}
        for c in sorted({c for p in symbol for c in p} - symbol.keys()):
            symbol[c] = len(symbol) + n
        self.other = max([n, *symbol.values()]) + 1
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(self.other)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32] = self.char[ord(SPACE)]
        self.codepoint = np.full(self.other, -1, dtype=np.int32)
        for p, i in symbol.items():
            if i >= n:
                self.codepoint[i] = ord(p)
        rank = np.full(self.other, NONE, dtype=np.int32)
        rank[:n][normal] = np.unique(-scores[normal], return_inverse=True)[1]
        self.base = np.int64(self.other)
        keys, made = [], []
        for p, i in symbol.items():
            for cut in range(1, len(p)):
                if (left := symbol.get(p[:cut])) is not None and (right := symbol.get(p[cut:])) is not None:
                    keys.append(left * int(self.base) + right)
                    made.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int32)[order]
        self.rank = rank
        self.one_by_one = np.zeros(self.other, dtype=bool)
        for part in (self.keys // self.base, self.keys % self.base):
            risky = rank[self.made] <= rank[part]
            self.one_by_one[part[risky]] = True
        run = max((len(p) for p in symbol if set(p) == {SPACE}), default=1)
        # Long runs of spaces come apart in full pieces from the left.
        self.words = re.compile(f" {{{run}}}(?= {{{2 * run}}})| *[^ \n]+|\n| +")
        self.text_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.text_len = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(self.text_len)[:-1]])
        self.merges = dict(zip(self.keys.tolist(), zip(rank[self.made].tolist(), self.made.tolist(), strict=True), strict=True))
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.starts_with_space = np.array([t[:1] == b" " for t in texts])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; NONE where it is no piece."""
        key = left.astype(np.int64) * self.base + right
        key[(left >= self.other) | (right >= self.other)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = np.where(self.keys[at] == key, self.made[at], -1)
        return np.where(piece >= 0, self.rank[piece], NONE), piece

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The symbols that are left of one word; a pair's cost grows with the logarithm of the word's length."""
        syms, n = sym.tolist(), len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, pieces = self._pairs(sym[:-1], sym[1:])
        at = np.flatnonzero(ranks != NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist(), pieces[at].tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if syms[i] != left or j >= n or syms[j] != right:
                continue
            syms[i], syms[j], after[i] = piece, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and syms[a] < self.other and syms[b] < self.other and (made := self.merges.get(syms[a] * int(self.base) + syms[b])):
                    heapq.heappush(heap, (made[0], a, syms[a], syms[b], made[1]))
        return np.array([s for s in syms if s >= 0], dtype=np.int32)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers; a word is not empty."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, ids in zip(short, self._encode_short([words[i] for i in short]), strict=True):
            out[i] = ids
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                left = self._merge_long(self._symbols(w))
                out[i] = self._with_bytes(np.zeros(len(left), dtype=np.int32), left)[1].astype("<i4").tobytes()
        return out

    def _symbols(self, text: str) -> np.ndarray:
        return self.char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def _encode_short(self, words: list[str]) -> list[bytes]:
        """Ids of each word by merge rounds over all words at once."""
        if not words:
            return []
        sym = self._symbols("".join(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        last = np.empty(len(sym), dtype=bool)
        last[:-1], last[-1] = word[1:] != word[:-1], True
        rank, piece = np.full(len(sym), NONE, dtype=np.int32), np.full(len(sym), -1, dtype=np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], piece[inner] = self._pairs(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == NONE, length)
            if over.any():
                done.append((word[over], sym[over]))
                keep = ~over
                sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
                best, length = best[best != NONE], length[best != NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, length))
            place = np.arange(len(at))
            new_word = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            new_run = new_word | np.concatenate([[True], at[1:] != at[:-1] + 1])
            in_run = place - np.maximum.accumulate(np.where(new_run, place, 0))
            at = at[np.where(self.one_by_one[piece[at]], new_word, in_run % 2 == 0)]
            sym[at] = piece[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            rank[at], piece[at] = NONE, -1
            fresh = (np.cumsum(keep) - 1)[at]
            sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
            touched = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
            touched = touched[touched < len(sym) - 1]
            inside = word[touched] == word[touched + 1]
            rank[touched], piece[touched] = NONE, -1
            touched = touched[inside]
            rank[touched], piece[touched] = self._pairs(sym[touched], sym[touched + 1])
        words_of, syms = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words_of, kind="stable")
        words_of, syms = words_of[order], syms[order]
        words_of, ids = self._with_bytes(words_of, syms)
        cuts = np.searchsorted(words_of, np.arange(len(words) + 1)) * 4
        flat = ids.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _with_bytes(self, words_of: np.ndarray, syms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(syms >= self.size)
        if not len(odd):
            return words_of, syms
        points = np.where(syms[odd] >= self.other, syms[odd] - self.other, self.codepoint[np.minimum(syms[odd], self.other - 1)])
        parts = [chr(c).encode("utf-8", "surrogatepass") for c in points.tolist()]
        times = np.ones(len(syms), dtype=np.int64)
        times[odd] = [len(p) for p in parts]
        out, words_of = np.repeat(syms, times), np.repeat(words_of, times)
        out[np.repeat(syms >= self.size, times)] = self.byte_ids[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        return words_of, out

    def split(self, text: str) -> list[str]:
        return self.words.findall(" " + text.replace(SPACE, " ")) if text else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: pieces joined, bytes put together, the space before the text taken off."""
        if not len(ids):
            return ""
        lengths = self.text_len[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.text_at[ids] - (ends - lengths), lengths)
        data = self.text_bytes[at].tobytes()
        data = data[1:] if self.starts_with_space[ids[0]] and not self.is_byte[ids[0]] else data
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Bytes that form no character each give U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            left = bytes(run)
            while left:
                try:
                    out.append(left.decode("utf-8"))
                    break
                except UnicodeDecodeError as e:
                    out.append(left[: e.start].decode("utf-8") + "�")
                    left = left[e.start + 1 :]
            run.clear()

        for k, i in enumerate(ids.tolist()):
            piece = self.text_bytes[self.text_at[i] : self.text_at[i] + self.text_len[i]].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                flush()
                out.append(piece.decode("utf-8")[1 if k == 0 and self.starts_with_space[i] else 0 :])
        flush()
        return "".join(out)


_codecs: dict[str, tuple[Codec, dict[str, bytes]]] = {}


def _codec(model_path: str) -> tuple[Codec, dict[str, bytes]]:
    if model_path not in _codecs:
        _codecs[model_path] = (Codec(model_path), {})
    return _codecs[model_path]


def encode_texts(model_path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    codec, known = _codec(model_path)
    split = [codec.split(t) for t in texts]
    seen = set().union(*split)
    fresh = [w for w in seen if w not in known]
    if len(known) + len(fresh) > CACHE_WORDS:
        kept = {w: known[w] for w in seen if w in known}
        known.clear()
        known.update(kept)
    known.update(zip(fresh, codec.encode_words(fresh), strict=True))
    return [b"".join([known[w] for w in words]) for words in split]


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every row's whole text.

    A null text is empty and has no ids; repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)[0]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = encode_texts(model_path, texts[a:b])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                back = [codec.decode(flat[i:j]) if decoded else None for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(back, pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
