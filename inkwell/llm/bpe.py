"""Token ids of whole corpora by a public byte-level BPE vocabulary (problem 8).

Method: speculate and verify. For the words of a batch that were not met before

1. greedy longest match over a byte trie proposes tokens, for all words at once;
2. every adjacent pair of proposed tokens is tested at once for compatibility: two tokens
   are compatible if the merges of their joined bytes never cross the border. A word whose
   tokens are pairwise compatible is encoded, since merging acts only on neighbours;
3. only words with an incompatible pair are merged exactly, in rank order.

Texts are cut into words with array operations on code points (no regular expression in
the hot path), so the cost is a few array passes per character and one dictionary probe
per word. There is no shuffle: each row is encoded where it is read.

Defined results: null and empty texts give an empty list; equal texts give equal lists;
strings that look like special tokens are ordinary text; any length is encoded whole;
other columns are ignored, so clashing names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of this machine lie; a parameter of encode_corpus.
TOKENIZERS = os.environ.get("INKWELL_TOKENIZERS", "/opt/tokenizers")
#: Code points handled at once, and words remembered by one Python worker.
SLICE_CHARS, REMEMBERED_WORDS = 2_000_000, 1_000_000
#: Exact merging: bytes of a word up to which words are merged side by side, and how many at once.
WIDE, ROUND_WORDS = 300, 4096

LETTER, NUMBER, SIGN, SPACE, BORDER = range(5)
#: Stands between the texts of a slice; a lone surrogate occurs in no text.
CUT = "\ud800"
NEVER = np.iinfo(np.int64).max


def _byte_alphabet() -> dict[str, int]:
    """The printable character by which vocabulary files of this kind write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, SIGN, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[0xD800] = BORDER
    return out


class ByteBpe:
    """A byte-level BPE vocabulary with vectorised encoding of word lists."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of_char = _byte_alphabet()
        raw = lambda s: bytes(of_char[c] for c in s)
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(ids.values()) + 1
        self.size = size
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)  # -1: a single byte
        self.byte_id = np.zeros(256, np.int64)
        spelled = {raw(t): i for t, i in ids.items() if all(c in of_char for c in t)}
        for b in range(256):
            self.byte_id[b] = spelled[bytes([b])]
        merged = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        left, right, made = (np.array(x, np.int64) for x in zip(*merged))
        self.merge = {}
        for r, (a, b, m) in enumerate(merged):
            self.merge.setdefault((a, b), (r, m))
        order = np.arange(len(made))[::-1]  # of several ways to make a token, the first stays
        self.left[made[order]], self.right[made[order]], self.rank[made[order]] = left[order], right[order], order
        self.pair_keys, first = np.unique(left * size + right, return_index=True)
        self.pair_ranks, self.pair_made = first.astype(np.int64), made[first]
        # Trie over the bytes of all tokens that merging can make; row n of step holds the
        # child of node n by byte, and own[n] the token that ends there.
        child: dict[int, int] = {}
        own = [-1]
        built = set(made.tolist()) | set(self.byte_id.tolist())
        for token, i in spelled.items():
            if i not in built:
                continue
            node = 0
            for b in token:
                key = node << 8 | b
                node = child.get(key, 0)
                if not node:
                    node = child[key] = len(own)
                    own.append(-1)
            own[node] = i
        keys = np.fromiter(child.keys(), np.int64, len(child))
        inner = np.unique(keys >> 8)
        self.row = np.full(len(own), -1, np.int32)
        self.row[inner] = np.arange(len(inner))
        self.own = np.array(own, np.int32)
        self.step = np.zeros(len(inner) * 256, np.int32)
        self.step[self.row[keys >> 8].astype(np.int64) * 256 + (keys & 255)] = np.fromiter(child.values(), np.int32, len(child))

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def _pair_both(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER), self.pair_made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of tokens, whether the border between them outlives all merges.

        Looks back in time from the finished tokens: the younger of the two pieces that
        touch the border is taken apart until both are bytes. A merge across the border
        happens if its rank comes before the rank at which either piece was built into the
        next larger one; of equal ranks the left one acts first.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        fine = np.ones(len(x), bool)
        until_x = np.full(len(x), NEVER)
        until_y = np.full(len(x), NEVER)
        at = np.arange(len(x))
        while len(at):
            r = self._pair_rank(x, y)
            crossed = (r < until_x) & (r <= until_y) & (r != NEVER)
            fine[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            left_younger = rx > ry
            until_x = np.where(left_younger, rx, until_x)
            until_y = np.where(left_younger, until_y, ry)
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            x = np.where(left_younger, self.right[x], x)[go]
            y = np.where(left_younger, y, self.left[y])[go]
            until_x, until_y, at = until_x[go], until_y[go], at[go]
        return fine

    def _greedy(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of every word, as (word, token) in the order of the text."""
        words, tokens = [], []
        pos, stop, who = begin.copy(), end, np.arange(len(begin))
        while len(who):
            node = np.zeros(len(who), np.int32)
            best = np.full(len(who), -1, np.int32)
            length = np.zeros(len(who), np.int64)
            live = np.arange(len(who))
            depth = 0
            while len(live):
                child = self.step[self.row[node[live]].astype(np.int64) * 256 + buf[pos[live] + depth]]
                ok = child > 0
                live, child = live[ok], child[ok]
                depth += 1
                node[live] = child
                token = self.own[child]
                hit = token >= 0
                best[live[hit]] = token[hit]
                length[live[hit]] = depth
                live = live[(self.row[child] >= 0) & (pos[live] + depth < stop[live])]
            words.append(who)
            tokens.append(best)
            pos = pos + length
            go = pos < stop
            pos, stop, who = pos[go], stop[go], who[go]
        w = np.concatenate(words)
        order = np.argsort(w, kind="stable")
        return w[order], np.concatenate(tokens)[order].astype(np.int64)

    def exact(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first; n log n for a word of n bytes."""
        part = [int(self.byte_id[b]) for b in word]
        n = len(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        merge = self.merge
        for i in range(n - 1):
            m = merge.get((part[i], part[i + 1]))
            if m:
                heap.append((m[0], i, part[i], part[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if part[i] != a:
                continue
            j = nxt[i]
            if j >= n or part[j] != b:
                continue
            part[i], part[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q < n:
                    m = merge.get((part[p], part[q]))
                    if m:
                        heapq.heappush(heap, (m[0], p, part[p], part[q], m[1]))
        return [p for p in part if p >= 0]

    def exact_many(self, raw: list[bytes]) -> list[np.ndarray]:
        """exact() for many words at once: in each round every word does its next merge."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        long = [k for k, w in enumerate(raw) if len(w) > WIDE]
        for k in long:
            out[k] = np.array(self.exact(raw[k]), np.int64)
        rest = sorted((k for k, w in enumerate(raw) if len(w) <= WIDE), key=lambda k: len(raw[k]))
        for first in range(0, len(rest), ROUND_WORDS):
            some = rest[first : first + ROUND_WORDS]
            wide = len(raw[some[-1]]) + 1  # a last column that nothing merges with
            text = np.frombuffer(b"".join(raw[k].ljust(wide, b"\0") for k in some), np.uint8).reshape(len(some), wide)
            size = np.array([len(raw[k]) for k in some])
            part = self.byte_id[text]
            there = np.arange(wide) < size[:, None]
            part[~there] = -1
            rank, made = self._pair_both(part[:, :-1], part[:, 1:])
            rank[~there[:, 1:]] = NEVER
            nxt = np.tile(np.arange(1, wide + 1), (len(some), 1))
            prv = nxt - 2
            live = np.arange(len(some))
            while len(live):
                i = rank[live].argmin(1)
                go = rank[live, i] != NEVER
                live, i = live[go], i[go]
                if not len(live):
                    break
                j = nxt[live, i]
                k = nxt[live, j]
                part[live, i] = made[live, i]
                part[live, j] = -1
                nxt[live, i] = k
                prv[live, np.minimum(k, wide - 1)] = i
                inner = j < wide - 1
                rank[live[inner], j[inner]] = NEVER
                for w, x, y in ((live, i, k), (live, prv[live, i], i)):
                    ok = (x >= 0) & (y < size[w])
                    rank[w[~ok & (x >= 0)], x[~ok & (x >= 0)]] = NEVER
                    w, x, y = w[ok], x[ok], y[ok]
                    rank[w, x], made[w, x] = self._pair_both(part[w, x], part[w, y])
            for k, row in zip(some, part):
                out[k] = row[row >= 0]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(tokens of each word, ids of all words in a row, words that needed exact merging)."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(lengths)
        word, token = self._greedy(np.frombuffer(b"".join(raw), np.uint8), end - lengths, end)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(token[inside] * self.size + token[inside + 1], return_inverse=True)
        wrong = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(word[inside[wrong]])
        counts = np.bincount(word, minlength=len(words))
        if not len(failing):
            return counts, token, 0
        first = np.cumsum(counts) - counts
        pieces, done = [], 0
        for k, ids in zip(failing.tolist(), self.exact_many([raw[k] for k in failing.tolist()])):
            pieces.append(token[done : first[k]])
            pieces.append(ids)
            done = first[k] + counts[k]
            counts[k] = len(ids)
        pieces.append(token[done:])
        return counts, np.concatenate(pieces), len(failing)


class _Numbering(dict):
    """Gives unknown words the next number and lists them."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Texts to ids, with the words met so far kept for the life of the worker."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.kind = _classes()
        self.exact_words = 0
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbering()
        self.count = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self) -> None:
        if not (new := self.number.new):
            return
        counts, ids, exact = self.bpe.encode_words(new)
        self.exact_words += exact
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.number.new = []

    def words(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts joined by CUT, and the text each is in."""
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[cp]
        n = len(kind)
        starts = np.empty(n, bool)
        starts[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        # Adjacent borders are separate: an empty text lies between them.
        border = kind == BORDER
        starts |= border
        # Before a visible run the last white space stands alone, or joins it if it is " ".
        run = np.flatnonzero(starts[1:] & (kind[:-1] == SPACE) & ~border[1:]) + 1
        starts[run - 1] = True
        starts[run[cp[run - 1] == 0x20]] = False
        # Contractions: an apostrophe that begins a word takes these letters with it.
        q = np.flatnonzero(starts & (cp == 0x27))
        if len(q):
            at = lambda k: cp[np.minimum(q + k, n - 1)] * (q + k < n)
            a, b = at(1), at(2)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = np.zeros(len(q), bool)
            for x, y in ("re", "ve", "ll"):
                two |= (a == ord(x)) & (b == ord(y))
            for hit, length in ((one, 2), (two, 3)):
                h = q[hit]
                starts[h + 1] = False
                inside = h + length < n
                starts[h[inside] + length] = True
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], n)
        text = np.cumsum(border)[begin] if n else begin
        keep = ~border[begin]
        return begin[keep], end[keep], text[keep]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, as a list array has them."""
        if len(self.number) > REMEMBERED_WORDS:
            self._forget()
        joined = CUT.join(texts)
        begin, end, text = self.words(joined)
        found = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        w = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        self._learn()
        length = self.count[w]
        total = int(length.sum())
        shift = self.first[w] - (np.cumsum(length) - length)
        ids = self.flat[np.repeat(shift, length) + np.arange(total)]
        per_text = np.bincount(text, weights=length, minlength=len(texts)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(per_text)]), ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` code points; a longer text is a range of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>): the token ids of each row's text, in one pass without shuffle.

    vocabulary: path of a byte-level BPE file in the `tokenizers` JSON format, readable by
    all executors. One row comes out per row; see the module for nulls and other cases.
    """
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.json"
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                offsets, ids = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([StructField(id_col, id_type), StructField("ids", ArrayType(IntegerType()))])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
