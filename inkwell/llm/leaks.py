"""Evaluation passages inside a training corpus (problem 9).

Method: template canonicalisation. Words of the held-out items and of the documents are
brought to one form (see `Words`); numbers, units and names become typed placeholders (names
and units are learned from the whole held-out set, see `Lexicon`), and
the hash of every ten (for Japanese and Chinese: sixteen characters) in a row is a template
window. Windows of documents are joined by hash with those of the items; then the slots of
each matched window are compared: all slots equal is a verbatim window, slots that are
replaced one for one all through the document are a re-parameterised one, others are none.

A document leaks an item verbatim if its verbatim windows cover at least half of the
item's words (characters): just the words in runs of ten or more consecutive words of the
item. It leaks it re-parameterised if that holds for both kinds of windows together.

The items' windows are sent to all tasks, in blocks of a checked size (a held-out set is
small by nature; a larger one takes more passes). A document's windows are made with array
operations over whole batches, of whole texts, and nothing of the corpus is shuffled but
the pairs found.

Defined results: null and empty texts leak nothing; an item with fewer words than a window
has no windows and is never found; repeated rows of a document or item count once; equal
passages in several items count for each; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import CUT, slices

WORDS, CHARS = 10, 16
MOST_SENT = 2_000_000
#: Items whose words are looked at together.
LEARNED_AT_ONCE = 5_000
ODD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = np.uint64(11), np.uint64(13), np.uint64(17)
#: A unit is a word that follows a number at least so often, and in such a share of its uses.
UNIT_TIMES, UNIT_SHARE = 2, 0.5

#: Number signs that are no digits (superscripts, fractions, enclosed numbers) only separate.
SIGNS = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u209f\u2150-\u218f\u2460-\u24ff\u2776-\u2793]")

DROP, OTHER, LATIN, CJK, DIGIT, EDGE = range(6)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: what it is, its lower case, whether it is a capital."""
    kind = np.full(0x110000, OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    capital = np.zeros(0x110000, bool)
    for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x32000)]:
        s = chr(c)
        cat = unicodedata.category(s)
        if cat[0] == "L":
            cjk = 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0xFF66 <= c <= 0xFF9D or c >= 0x20000
            kind[c] = CJK if cjk else LATIN
            if cat in ("Lu", "Lt"):
                capital[c] = True
                if len(small := s.lower()) == 1:
                    lower[c] = ord(small)
        elif cat == "Nd":
            kind[c] = DIGIT
        elif cat in ("Mn", "Me", "Cf"):
            kind[c] = DROP
    kind[ord(CUT)] = EDGE
    return kind, lower, capital


_TABLES: list = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_tables())
    return _TABLES[0]


#: From this many characters on a target or tag must look like one, or be left as words.
LONG = 200
LONG_TARGET = re.compile(r"\S+(?:[ \t]+[\"'(][^\n]*)?")


def _without_targets(text: str) -> str:
    """Text without link targets; one ends in its paragraph, and a long one is a word, and a title."""
    parts = text.split("](")
    out = [parts[0]]
    for p in parts[1:]:
        j = p.find(")")
        target = j >= 0 and ("\n\n" not in p[:j] if j < LONG else LONG_TARGET.fullmatch(p, 0, j))
        out.append(p[j + 1 :] if target else "](" + p)
    return "".join(out)


def plain(text: str) -> str:
    """Text with markup that holds words of its own (link targets, tags, task boxes) removed."""
    if "](" in text:
        text = _without_targets(text)
    if "<" in text:
        parts = text.split("<")
        out = [parts[0]]
        for p in parts[1:]:
            j = p.find(">")
            tag = j > 0 and (p[0].isalpha() or p[0] in "/!")
            if tag and j >= LONG:  # attributes, or a comment
                tag = "\n\n" not in p[:j] and (p[0] == "!" or "=" in p[:j])
            out.append(p[j + 1 :] if tag else " " + p)
        text = "".join(out)
    for box in ("- [x]", "- [X]", "* [x]", "+ [x]", "- [ ]"):
        if box in text:
            text = text.replace(box, " ")
    return text


class Words:
    """The words and characters of some texts as arrays.

    One form: compatibility decomposition, marks and invisible characters dropped, lower
    case; a word is a run of letters and digits, a CJK letter never joins a word; all else,
    markup signs included, only separates. Hashes are polynomial in 64 bits.
    """

    def __init__(self, texts: list[str]):
        kind_of, lower_of, capital_of = tables()
        joined = CUT.join(t if t.isascii() else unicodedata.normalize("NFKD", SIGNS.sub(" ", t)) for t in map(plain, texts))
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kind_of[cp]
        keep = kind != DROP
        cp, kind = cp[keep], kind[keep]
        self.capital = capital_of[cp]
        cp = lower_of[cp]
        text = np.cumsum(kind == EDGE)
        # Characters: letters and digits only.
        letter = np.flatnonzero((kind == CJK) | (kind == LATIN) | (kind == DIGIT))
        self.char, self.char_kind, self.char_text = cp[letter], kind[letter], text[letter]
        # Words: Latin letters and digits.
        inside = (kind == LATIN) | (kind == DIGIT)
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.text = text[begin] if len(begin) else begin
        n = len(cp)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int((end - begin).max(initial=1)) - 1), ODD, np.uint64)]))
        # Within a word the last letter has power 0; sums over words by differences of prefixes.
        back = np.repeat(end, end - begin) - 1 - np.flatnonzero(inside)
        weighted = (cp[inside].astype(np.uint64) + np.uint64(7)) * power[back]
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(weighted, dtype=np.uint64)])
        size = end - begin
        last = np.cumsum(size)
        self.word = prefix[last] - prefix[last - size]
        digits = np.concatenate([[0], np.cumsum((kind[inside] == DIGIT))])
        self.digit = digits[last] - digits[last - size] > 0
        self.big = self.capital[begin] if len(begin) else np.zeros(0, bool)
        self.count = n


def windows(code: np.ndarray, text: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of `width` codes that begin at the positions `at`."""
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * BASE + code[at + k]
    return h ^ (h >> np.uint64(29))


def starts(text: np.ndarray, width: int, known: np.ndarray | None = None) -> np.ndarray:
    """Positions where a window lies within one text and holds known codes only."""
    n = len(text) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = text[:n] == text[width - 1 :]
    if known is not None:
        bad = np.concatenate([[0], np.cumsum(~known)])
        ok &= bad[width:] == bad[:n]
    return np.flatnonzero(ok)


def mostly_cjk(w: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether most letters and digits of each text are CJK, their number)."""
    cjk = np.bincount(w.char_text[w.char_kind == CJK], minlength=texts)
    every = np.bincount(w.char_text, minlength=texts)
    return cjk * 2 > every, every


class Lexicon:
    """What the whole held-out set tells about words, whatever blocks it is compared in: names
    (words that have a capital wherever they are used, and not only where a text begins), units
    (words that mostly follow a number), all words, and all characters of CJK items."""

    def __init__(self):
        none = np.zeros(0, np.uint64)
        self.known, self.lower, self.inner = none, none, none
        self.after, self.total = Counter(), Counter()
        self.known_chars = np.zeros(0, np.uint32)

    def add(self, texts: list[str]) -> None:
        w = Words(texts)
        by_char, _ = mostly_cjk(w, len(texts))
        first = np.concatenate([[True], w.text[1:] != w.text[:-1]]) if len(w.text) else np.zeros(0, bool)
        behind = np.concatenate([[False], w.digit[:-1] & ~first[1:]]) if len(w.text) else first
        plain_word = ~w.digit
        self.total.update(dict(zip(*(v.tolist() for v in np.unique(w.word[plain_word], return_counts=True)))))
        self.after.update(dict(zip(*(v.tolist() for v in np.unique(w.word[plain_word & behind], return_counts=True)))))
        self.known = np.union1d(self.known, w.word)
        self.lower = np.union1d(self.lower, w.word[~w.big])
        self.inner = np.union1d(self.inner, w.word[w.big & ~first])
        self.known_chars = np.union1d(self.known_chars, w.char[np.isin(w.char_text, np.flatnonzero(by_char))])

    @property
    def names(self) -> np.ndarray:
        return np.setdiff1d(self.inner, self.lower)

    @property
    def units(self) -> np.ndarray:
        some = [h for h, n in self.after.items() if n >= UNIT_TIMES and n >= UNIT_SHARE * self.total[h]]
        return np.array(sorted(some), np.uint64)


class Items:
    """The held-out items of a block: their words, slots and windows. Built on the driver."""

    def __init__(self, rows: list[tuple[int, str]], lexicon: Lexicon | None = None):
        rows = sorted({(i, t) for i, t in rows if i is not None and t})
        if lexicon is None:
            lexicon = Lexicon()
            lexicon.add([t for _, t in rows])
        self.ids = np.array([i for i, _ in rows], np.int64)
        w = Words([t for _, t in rows])
        self.by_char, every = mostly_cjk(w, len(rows))
        self.units, self.names, self.known, self.known_chars = lexicon.units, lexicon.names, lexicon.known, lexicon.known_chars
        self.lengths = np.where(self.by_char, every, np.bincount(w.text, minlength=len(rows)))
        self.parts = {}
        code = self.codes(w)
        use = ~self.by_char[w.text] if len(w.text) else np.zeros(0, bool)
        self.parts["word"] = self._side(code[use], w.word[use], w.text[use], WORDS)
        use = self.by_char[w.char_text] if len(w.char_text) else np.zeros(0, bool)
        c, k = w.char[use].astype(np.uint64), w.char_kind[use]
        self.parts["char"] = self._side(self.char_codes(c, k), c, w.char_text[use], CHARS)

    def _side(self, code: np.ndarray, real: np.ndarray, text: np.ndarray, width: int) -> dict:
        at = starts(text, width)
        h = windows(code, text, width, at)
        begin = np.searchsorted(text, text[at]) if len(at) else at
        order = np.argsort(h, kind="stable")
        at = at[order]
        return {"hash": h[order], "at": at, "item": text[at] if len(at) else at, "place": at - begin[order] if len(at) else at, "real": real, "code": code, "width": width}

    def codes(self, w: Words) -> np.ndarray:
        """The template: slots of a type instead of numbers, units and names."""
        name = np.isin(w.word, self.names) | (w.big & ~_member(w.word, self.known))
        code = np.where(name, NAME_SLOT, w.word)
        code = np.where(_member(w.word, self.units), UNIT_SLOT, code)
        return np.where(w.digit, NUMBER_SLOT, code)

    @staticmethod
    def char_codes(char: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.where(kind == DIGIT, NUMBER_SLOT, np.where(kind == LATIN, NAME_SLOT, char.astype(np.uint64)))


def _member(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def doc_windows(items: Items, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(side, template hash, text, position, codes, real codes) of the documents' windows that
    hold nothing which no item holds."""
    w = Words(texts)
    code = items.codes(w)
    known = _member(w.word, items.known) | (code == NAME_SLOT) | (code == NUMBER_SLOT) | (code == UNIT_SLOT)
    at = starts(w.text, WORDS, known)
    yield "word", windows(code, w.text, WORDS, at), w.text[at] if len(at) else at, at, code, w.word
    char = w.char.astype(np.uint64)
    code = items.char_codes(char, w.char_kind)
    known = _member(w.char, items.known_chars) | (code == NAME_SLOT) | (code == NUMBER_SLOT)
    cjk = np.concatenate([[0], np.cumsum(w.char_kind == CJK)])
    at = starts(w.char_text, CHARS, known)
    at = at[cjk[at + CHARS] > cjk[at]]
    yield "char", windows(code, w.char_text, CHARS, at), w.char_text[at] if len(at) else at, at, code, char


def matched(items: Items, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, covered words verbatim, covered in all) of texts that share windows."""
    for side, h, text, at, code, real in doc_windows(items, texts):
        part = items.parts[side]
        if not len(part["hash"]) or not len(h):
            continue
        lo = np.searchsorted(part["hash"], h)
        hit = part["hash"][np.minimum(lo, len(part["hash"]) - 1)] == h
        text, at, lo, h = text[hit], at[hit], lo[hit], h[hit]
        if not len(h):
            continue
        n = np.searchsorted(part["hash"], h, side="right") - lo
        which = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        text, at = np.repeat(text, n), np.repeat(at, n)
        yield cover(part, text, at, which, code, real)


def cover(part: dict, text: np.ndarray, at: np.ndarray, which: np.ndarray, code: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Checks the slots of matched windows and counts what they cover of the items."""
    width = part["width"]
    source = part["at"][which]
    step = np.arange(width)
    mine, theirs = real[at[:, None] + step], part["real"][source[:, None] + step]
    same_code = (code[at[:, None] + step] == part["code"][source[:, None] + step]).all(1)
    verbatim = (mine == theirs).all(1)
    item, place = part["item"][which], part["place"][which]
    # A slot value of the item must stand for one value in the whole document.
    pair = text.astype(np.int64) * (int(item.max()) + 1) + item
    p = np.repeat(pair, width)
    differs = mine.ravel() != theirs.ravel()
    triple = np.unique(np.stack([p[differs].astype(np.uint64), theirs.ravel()[differs], mine.ravel()[differs]], 1), axis=0)
    first = np.ones(len(triple), bool)
    first[1:] = (triple[1:, :2] != triple[:-1, :2]).any(1)
    unclear = np.unique(triple[~first, 0]).astype(np.int64)
    consistent = same_code & (verbatim | ~_member(pair, unclear))

    def covered(ok: np.ndarray) -> dict[int, int]:
        key = (pair[ok][:, None] << 24) + place[ok][:, None] + step
        pairs, n = np.unique(np.unique(key) >> 24, return_counts=True)
        return dict(zip(pairs.tolist(), n.tolist()))

    whole, loose = covered(verbatim), covered(consistent | verbatim)
    pairs = np.array(sorted(loose), np.int64)
    base = int(item.max()) + 1
    return pairs // base, pairs % base, np.array([whole.get(x, 0) for x in pairs.tolist()], np.int64), np.array([loose[x] for x in pairs.tolist()], np.int64)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """(doc_id, item_id, words, verbatim, covered) of documents that share a window with an item.

    words: words (characters) of the item; verbatim: those in verbatim windows; covered:
    those in verbatim or re-parameterised windows. `items` is the held-out set; its size is
    checked, and beyond 8 * most_sent characters it is taken in blocks, with a pass for each.
    """
    size = items.select(F.sum(F.length(text_col).cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (8 * most_sent)))
    wanted = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    source = docs.select(F.col(doc_id).cast("bigint"), F.col(text_col).cast("string")).where(F.col(doc_id).isNotNull() & F.col(text_col).isNotNull())
    lexicon, held = Lexicon(), []
    for r in wanted.toLocalIterator():
        held.append(r.t)
        if len(held) == LEARNED_AT_ONCE:
            lexicon.add(held)
            held = []
    lexicon.add(held)
    found = None
    for block in range(blocks):
        part = _block(source, wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block) if blocks > 1 else wanted, lexicon)
        found = part if found is None else found.unionByName(part)
    # Repeated rows of a document, and two texts of one item, count once: the larger cover.
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("verbatim").alias("verbatim"), F.max("covered").alias("covered"))


def _block(source: DataFrame, wanted: DataFrame, lexicon: Lexicon) -> DataFrame:
    held = source.sparkSession.sparkContext.broadcast(Items([(r.i, r.t) for r in wanted.collect()], lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                for text, item, verbatim, covered in matched(it, texts[a:b]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + text]), pa.array(it.ids[item]), pa.array(it.lengths[item].astype(np.int64)), pa.array(verbatim), pa.array(covered)],
                        names=["doc_id", "item_id", "words", "verbatim", "covered"],
                    )

    return source.mapInArrow(run, "doc_id bigint, item_id bigint, words bigint, verbatim bigint, covered bigint")


def leaked(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of verbatim leaks: half of the item's words or more."""
    return found.where(F.col("verbatim") * 2 >= F.col("words")).select("doc_id", "item_id")
