"""Sentence units of documents in many languages and scripts (problem 10).

Method: abbreviations, collocations and sentence starters are learned without supervision,
for each language, by log-likelihood ratios over the whole corpus (`learn`); then each stop
is classified with these statistics (`split`). What is learned:

- abbreviations: short types that a full stop follows far more often than its share
  (Dunning's ratio, scaled by length, inner stops and the share of occurrences without stop);
- of these, the ones that may end a sentence (`etc.`): they occur at ends of paragraphs,
  which a title or `p.` never does;
- collocations: words that follow a number with stop (`3. Oktober`) more often than they
  begin sentences;
- starters in lower case: words that begin sentences more often than they occur elsewhere.

A language without evidence of its own for a type uses that of all languages.

The first pass counts per batch and aggregates by key, so hot words are combined before the
shuffle; only the thresholded lists come to the driver (a few entries for each language).
The second pass is a map over the documents. Whole texts are read in both.

Defined results: null, empty and blank texts have no units; fenced code, front matter and
rules hold none; a heading is one unit, a list item ends with its item; offsets are code
points of the raw text; repeated rows give repeated units; further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.tables import shared_dir

#: Longest abbreviation in letters; least ratio of an abbreviation; least ratio of
#: starters and collocations (chi square, one degree of freedom, 0.5 %).
LONGEST, ABBREVIATION, ASSOCIATED = 8, 0.3, 7.88
#: Occurrences up to which those without stop weigh by their number, and up to which a ratio
#: grows; from there on shares alone decide, so that more text at the same rates changes nothing.
WEIGHED, ENOUGH = 20, 1000
#: Share of an abbreviation's stops that end paragraphs from which on it may end a sentence.
FINAL_SHARE = 0.004
#: Occurrences from which on a language's own evidence stands above that of all languages.
OWN = 20

STRIP = "\"“”„«»()[]{}*_`‘’¿¡>（）「」『』<~"
INVISIBLE = "​‌‍⁠﻿­"
TYPE = re.compile(r"[^\W\d_](?:[^\W_]|[̀-ͯा-्.\-'’])*")
INTEGER = re.compile(r"\d{1,4}")


def language(lang: str | None) -> str:
    """`EN`, `en-x` and `en` are one language; null is `und`."""
    return (lang or "und").strip().lower().partition("-")[0] or "und"


def count(texts: list[tuple[str, str]]) -> dict[tuple[str, str, str], int]:
    """Counts of some (language, text): key is (language, kind, type or word).

    kinds: w occurrences of a short type; p those before a full stop; e those before a stop
    that ends a paragraph; n all tokens and q all with stop; a words after a number with
    stop; s words after another stop; l lower-case words in all.
    """
    out: Counter = Counter()
    by_lang: dict[str, list[str]] = {}
    for lang, text in texts:
        by_lang.setdefault(lang, []).append(text)
    for lang, some in by_lang.items():
        words: Counter = Counter()
        after: Counter = Counter()
        last: Counter = Counter()
        for text in some:
            for para in text.replace("\r\n", "\n").split("\n\n"):
                if para.lstrip()[:3] in ("```", "~~~"):
                    continue
                tokens = para.split()
                if not tokens:
                    continue
                words.update(tokens)
                last[tokens[-1]] += 1
                after.update([(a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] == "."])
        total = stops = 0
        for raw, n in words.items():
            total += n
            token = raw.strip(STRIP).rstrip(",;:!?…")
            stop = token.endswith(".") and not token.endswith("..")
            stops += n * stop
            kind = token[:-1] if stop else token
            if 0 < len(kind) <= 2 * LONGEST and TYPE.fullmatch(kind) and sum(c != "." for c in kind) <= LONGEST:
                low = kind.lower()
                out[lang, "w", low] += n
                if stop:
                    out[lang, "p", low] += n
                    out[lang, "e", low] += last.get(raw, 0)
            if token and token[0].islower() and token.isalpha():
                out[lang, "l", token] += n
        for (a, b), n in after.items():
            a, b = a.strip(STRIP)[:-1], b.strip(STRIP).rstrip(",;:.!?…")
            if not b:
                continue
            if INTEGER.fullmatch(a):
                out[lang, "a", b.lower()] += n
            elif len(a) > LONGEST // 2 and a[-4:].isalpha():
                out[lang, "s", b.lower()] += n
                if b[0].islower() and b.isalpha():
                    out[lang, "b", b] += n
        out[lang, "n", ""] += total
        out[lang, "q", ""] += stops
    return out


def _log_binomial(k: float, n: float, p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return k * math.log(p) + (n - k) * math.log(1 - p)


def associated(k1: float, n1: float, k2: float, n2: float) -> float:
    """Dunning's log-likelihood ratio of k1 of n1 against k2 of n2; 0 if the first share is smaller."""
    if not n1 or not n2 or k1 / n1 <= k2 / n2:
        return 0.0
    p = (k1 + k2) / (n1 + n2)
    return 2 * (_log_binomial(k1, n1, k1 / n1) + _log_binomial(k2, n2, k2 / n2) - _log_binomial(k1, n1, p) - _log_binomial(k2, n2, p))


@dataclass
class Model:
    """By language ("*": all): abbreviations and whether they may end a sentence, short types
    known to be none, words after numbers, and lower-case starters."""

    abbreviations: dict[str, dict[str, bool]] = field(default_factory=dict)
    ordinary: dict[str, set[str]] = field(default_factory=dict)
    collocations: dict[str, set[str]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)

    def abbreviation(self, lang: str, kind: str) -> bool | None:
        """None: no abbreviation; else whether it may end a sentence."""
        own = self.abbreviations.get(lang, {}).get(kind)
        if own is None and kind not in self.ordinary.get(lang, ()):
            own = self.abbreviations.get("*", {}).get(kind)
        return own


COUNTS = "lang string, kind string, term string, n bigint"


def learn(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> Model:
    """The model of a corpus; counts over all of its documents."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count([(language(a), b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
            if got:
                a, b, c = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(list(got.values()), pa.int64())], names=["lang", "kind", "term", "n"])

    counts = docs.select(lang, F.col(text_col).cast("string").alias("t")).where("t is not null").mapInArrow(run, COUNTS)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    # Counted once and laid down: languages, evidence and ordinary words are read from there.
    counts.groupBy("lang", "term").agg(*(of(k) for k in "wpenqaslb")).write.parquet(f"{folder}/types")
    types = spark.read.schema("lang string, term string, " + ", ".join(f"{k} bigint" for k in "wpenqaslb")).parquet(f"{folder}/types")
    sums = {r.lang: r.asDict() for r in types.groupBy("lang").agg(*(F.sum(k).alias(k) for k in "nqasb")).collect()}

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(abbreviating(r, sums[r["lang"]]) or collocated(r, sums[r["lang"]]) or starting(r, sums[r["lang"]])) for r in batch.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # What comes to the driver passed the likelihood thresholds: the abbreviations, collocations
    # and starters themselves, whose number depends on the languages and not on the corpus.
    found = types.where("(p >= 2 and 2 * p >= w) or a >= 2 or b >= 2").mapInArrow(telling, types.schema)
    rows = [r.asDict() for r in found.toLocalIterator()]
    short = sorted({r["term"] for r in rows if abbreviating(r, sums[r["lang"]])})
    if short:
        names = spark.createDataFrame([(t,) for t in short], "term string")
        rows += [r.asDict() for r in types.where("w >= 5 and 2 * p < w").join(F.broadcast(names), "term", "left_semi").toLocalIterator()]
    return _model(rows, sums)


def abbreviating(r: dict, s: dict) -> bool:
    """Whether a full stop follows a type so much more often than its share that it must be an
    abbreviation."""
    if r["p"] < 2 or 2 * r["p"] < r["w"] or s["q"] >= s["n"]:
        return False
    n = min(r["w"], ENOUGH)
    k = r["p"] * n / r["w"]
    ratio = 2 * (_log_binomial(k, n, 0.99) - _log_binomial(k, n, s["q"] / s["n"]))
    letters = sum(c != "." for c in r["term"])
    bare = (r["w"] - r["p"]) * min(1.0, WEIGHED / r["w"])
    return ratio * math.exp(-letters) * (r["term"].count(".") + 1) * letters**-bare >= ABBREVIATION


def collocated(r: dict, s: dict) -> bool:
    return r["a"] >= 2 and associated(r["a"], s["a"], r["s"], s["s"]) >= ASSOCIATED


def starting(r: dict, s: dict) -> bool:
    return r["b"] >= 2 and associated(r["b"], s["q"], r["l"] - r["b"], s["n"]) >= ASSOCIATED and 2 * r["b"] >= r["l"] * 0.1


def _model(rows: list[dict], sums: dict[str, dict]) -> Model:
    m = Model()
    by_type: dict[str, list[dict]] = {}
    for r in rows:
        lang, term, s = r["lang"], r["term"], sums[r["lang"]]
        if abbreviating(r, s):
            if r["p"] >= OWN:
                m.abbreviations.setdefault(lang, {})[term] = r["e"] >= 2 and r["e"] >= FINAL_SHARE * r["p"]
            by_type.setdefault(term, []).append(r)
        if collocated(r, s):
            m.collocations.setdefault(lang, set()).add(term)
        if starting(r, s):
            m.starters.setdefault(lang, set()).add(term)
    for term, some in by_type.items():
        e, p = sum(r["e"] for r in some), sum(r["p"] for r in some)
        m.abbreviations.setdefault("*", {})[term] = e >= 2 and e >= FINAL_SHARE * p
    for r in rows:
        if r["w"] >= 5 and 2 * r["p"] < r["w"] and r["term"] in by_type:
            m.ordinary.setdefault(r["lang"], set()).add(r["term"])
    for part in (m.collocations, m.starters):
        part["*"] = set().union(*part.values()) if part else set()
    return m


OPEN = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", "‘": "’", '"': '"', "`": "`"}
CLOSERS = set(")）]」』”»’\"")
BRACKETS, CODE = "(（", "[`"
NESTING = "(（[「『"
NESTED = {OPEN[c]: c for c in NESTING}
STOPS = ".!?…。！？．｡।॥؟۔"
STRONG = set("。！？．｡।॥؟۔")
EVENT = re.compile("[" + re.escape(STOPS + "".join(OPEN) + "".join(CLOSERS)) + "]")
BREAK = re.compile(r"[\s\"“„«(\[（「『‘`*_>」』」。、，：]")
HEAD = re.compile(r"[\s*_`\"“„«(\[‘>]*([^\s]*)")
SPACES = re.compile(rf"[\s{INVISIBLE}]*")
THAI = re.compile("[ก-๛]")
THAI_GAP = re.compile("(?<=[ก-๛”»’)\"])\\s+(?=[ก-๛“«‘(\"A-Z])")
OPENING = set("“„«‘\"(（「『[¿¡`*")


class Splitter:
    """Sentence units of texts by a model."""

    def __init__(self, model: Model):
        self.model = model

    def units(self, text: str, lang: str) -> list[tuple[int, int]]:
        """(start, end) of the units, offsets in code points."""
        out: list[tuple[int, int]] = []
        parts: list[tuple[int, int]] = []
        quoted = item = False
        fence = ""
        pos = 0
        lines = text.split("\n")
        first = 0
        if lines[0].rstrip() == "---":
            for k in range(1, len(lines)):
                if lines[k].rstrip() == "---":
                    pos = sum(len(x) + 1 for x in lines[: k + 1])
                    first = k + 1
                    break
        for line in lines[first:] if first else lines:
            begin = pos
            pos += len(line) + 1
            body = line.strip()
            if fence:
                if body.startswith(fence):
                    fence = ""
                continue
            if not body:
                if parts:
                    self._flush(text, parts, lang, out)
                quoted = item = False
                continue
            c = body[0]
            if c.isalpha():
                if parts and quoted:  # a line without > after quoted lines goes on lazily
                    quoted = False
                at = begin + line.find(body)
                parts.append((at, at + len(body)))
                continue
            at = begin + line.find(body)
            end = at + len(body)
            if c == ">":
                if parts and not quoted:
                    self._flush(text, parts, lang, out)
                quoted = True
                while at < end and (text[at] == ">" or text[at].isspace()):
                    at += 1
                body = text[at:end]
                if not body:
                    if parts:
                        self._flush(text, parts, lang, out)
                    continue
                c = body[0]
            if c in "`~" and body[:3] in ("```", "~~~"):
                if parts:
                    self._flush(text, parts, lang, out)
                fence = body[:3]
                continue
            if c == "#":
                n = len(body) - len(body.lstrip("#"))
                if n <= 6 and (len(body) == n or body[n].isspace()):
                    if parts:
                        self._flush(text, parts, lang, out)
                    inner = body[n:].strip()
                    if inner:
                        s = end - len(body[n:].lstrip())
                        out.append((s, s + len(inner)))
                    continue
            if c in "-*_=" and len(body) > 2 and not body.replace(c, "").strip():
                if parts:
                    self._flush(text, parts, lang, out)
                continue
            mark = MARK.match(body)
            if mark:
                if parts:
                    self._flush(text, parts, lang, out)
                at += mark.end()
                if at >= end:
                    continue
            parts.append((at, end))
        if parts:
            self._flush(text, parts, lang, out)
        return out

    def _flush(self, text: str, parts: list[tuple[int, int]], lang: str, out: list[tuple[int, int]]) -> None:
        if len(parts) == 1:
            a, b = parts[0]
            for s, e in self._split(text[a:b], lang):
                out.append((a + s, a + e))
        else:
            joined = "\n".join(text[a:b] for a, b in parts)
            places, p = [], 0
            for a, b in parts:
                places.append(p)
                p += b - a + 1
            for s, e in self._split(joined, lang):
                i, j = bisect.bisect_right(places, s) - 1, bisect.bisect_right(places, e - 1) - 1
                out.append((parts[i][0] + s - places[i], parts[j][0] + e - places[j]))
        parts.clear()

    def _split(self, p: str, lang: str) -> list[tuple[int, int]]:
        cuts = self._cuts(p, lang)
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(p)]):
            piece = p[a:b]
            n = len(piece.rstrip())
            if n:
                out.append((a, a + n))
        return out

    def _cuts(self, p: str, lang: str) -> list[int]:
        n = len(p)
        start = SPACES.match(p).end()
        cuts = [start]
        events = [(m.start(), m.group()) for m in EVENT.finditer(p)]
        thai = THAI.search(p) is not None
        inside: list[tuple[int, int]] = []
        k, m = 0, len(events)
        closings = self._closings(p, events) if any(c in OPEN for _, c in events) else []
        self._breaks = [b.start() for b in BREAK.finditer(p)] if "." in p else []
        while k < m:
            pos, c = events[k]
            if c in OPEN:
                j = closings[k]
                if j is not None:
                    end = events[j][0]
                    if thai:
                        inside.append((pos, end))
                    cut = self._after_group(p, pos, end, c, cuts[-1], lang)
                    if cut:
                        cuts.append(cut)
                    k = j + 1
                    continue
            if c not in STOPS:
                k += 1
                continue
            end = pos + 1
            k += 1
            while k < m and events[k][0] == end and events[k][1] in STOPS:
                end += 1
                k += 1
            cut = self._after_stop(p, pos, end, lang)
            if cut and cut < n:
                cuts.append(cut)
        if thai:
            for g in THAI_GAP.finditer(p):
                a, b = g.start(), g.end()
                if (THAI.match(p[a - 1]) or THAI.match(p[b])) and not any(x < a < y for x, y in inside):
                    cuts.append(b)
            cuts = sorted(set(cuts))
        return cuts

    @staticmethod
    def _closings(p: str, events: list[tuple[int, str]]) -> list[int | None]:
        """For every event the one that closes the group it opens, in the same paragraph; one
        pass from the left for what nests and one from the right for the rest."""
        out: list[int | None] = [None] * len(events)
        open_ones: dict[str, list[int]] = {c: [] for c in NESTING}
        for j, (_, d) in enumerate(events):
            if d in open_ones:
                open_ones[d].append(j)
            elif d in NESTED and open_ones[NESTED[d]]:
                out[open_ones[NESTED[d]].pop()] = j
        following: dict[str, int] = {}
        for k in range(len(events) - 1, -1, -1):
            pos, c = events[k]
            if c in OPEN and c not in NESTING and not (c == '"' and pos + 1 < len(p) and p[pos + 1].isspace()):
                out[k] = min((following[d] for d in OPEN[c] if d in following), default=None)
            apostrophe = c == "’" and pos + 1 < len(p) and p[pos + 1].isalpha() and p[pos - 1].isalpha()
            if not apostrophe:  # which closes nothing
                following[c] = k
        return out

    def _starts(self, p: str, at: int, lang: str) -> bool:
        """Whether what stands at `at` can begin a sentence: not a lower-case word, unless it
        is known to begin sentences."""
        c = p[at]
        if c.islower() or c in "*_`[(":
            word = HEAD.match(p, at).group(1).rstrip(",;:.!?…)]*_`")
            if word[:1].islower():
                known = self.model.starters
                return word in known.get(lang, ()) or word in known.get("*", ())
        return c not in ",;:，、；：)）]」』»”"

    def _after_group(self, p: str, a: int, b: int, c: str, start: int, lang: str) -> int:
        """Where the next unit begins if the quotation or bracket p[a..b] ends one; else 0."""
        if c in CODE:
            return 0
        inner = p[a + 1 : b].rstrip()
        if not inner or inner[-1] not in STOPS:
            return 0
        nxt = SPACES.match(p, b + 1).end()
        if nxt >= len(p) or p[nxt] in STOPS:
            return 0
        if c in BRACKETS:
            return nxt if a == start else 0
        if not self._starts(p, nxt, lang):
            return 0
        before = p[:a].rstrip()
        if before and before[-1] in ":：":
            return nxt
        if inner[-1] in STRONG or nxt == b + 1:
            return 0
        d = p[nxt]
        return nxt if d.isupper() or d in OPENING else 0

    def _after_stop(self, p: str, pos: int, end: int, lang: str) -> int:
        """Where the next unit begins if the stop p[pos:end] ends one; else 0."""
        n = len(p)
        k = end
        while k < n and p[k] in CLOSERS and p[k] != '"':
            k += 1
        nxt = SPACES.match(p, k).end()
        if nxt >= n:
            return 0
        c = p[nxt]
        gap = any(x.isspace() for x in p[k:nxt])
        run = p[pos:end]
        if any(x in STRONG for x in run):
            return nxt if c not in ",;:，、；：)）]」』»”" else 0
        if run == ".":
            return self._after_full_stop(p, pos, nxt, gap, lang)
        if "…" in run or run.startswith(".."):
            if pos and p[pos - 1].isspace():
                return 0
            if not gap and not (c.isalpha() and not c.islower() or c in OPENING):
                return 0
            return nxt if self._starts(p, nxt, lang) else 0
        if not gap:
            return nxt if c.isalpha() and not c.islower() or c in "“„«‘「『¿¡（" else 0
        return nxt if self._starts(p, nxt, lang) else 0

    def _after_full_stop(self, p: str, pos: int, nxt: int, gap: bool, lang: str) -> int:
        at = bisect.bisect_left(self._breaks, pos) - 1
        begin = self._breaks[at] + 1 if at >= 0 else 0
        # Of a token longer than any abbreviation or number only the end matters.
        dotted = p.rfind(".", begin, pos) >= 0
        token = p[max(begin, pos - 8 * LONGEST) : pos]
        if not token:
            # The stop stands after a bracket or quotation: it ends the sentence around it.
            return nxt if gap and self._starts(p, nxt, lang) else 0
        c = p[nxt]
        kind = token.strip(INVISIBLE).lower()
        known = self.model.abbreviation(lang, kind)
        if not gap:
            # A missing space: a word, a stop, and a capital or another script.
            plain = len(token) > 2 and token[-2:].isalpha() and known is not False
            if c.isupper():
                return nxt if plain and token[-1].islower() and not dotted and nxt + 1 < len(p) and not p[nxt + 1].isupper() else 0
            return nxt if plain and (c.isalpha() and not c.islower() and not "฀" <= c <= "๿" or c in "“„«‘「『¿¡（") else 0
        if INTEGER.fullmatch(kind):
            word = HEAD.match(p, nxt).group(1).rstrip(",;:.!?…)]*_`").lower()
            known_words = self.model.collocations
            if word in known_words.get(lang, ()) or (not known_words.get(lang) and word in known_words.get("*", ())):
                return 0
            return nxt if self._starts(p, nxt, lang) else 0
        if len(kind) == 1 and token[-1].isupper():
            return 0
        if known is False:
            return 0
        return nxt if self._starts(p, nxt, lang) else 0


MARK = re.compile(r"(?:[-*+•]|\d{1,9}[.)])(?:\s+|$)(?:\[[ xX]\](?:\s+|$))?")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", model: Model | None = None, with_text: bool = False) -> DataFrame:
    """(id, start_at, end_at[, sentence]): the sentence units of every document, in one pass
    after the model is learned; without `model` it is learned from these documents."""
    model = model or learn(docs, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        split = Splitter(sent.value)
        for batch in batches:
            ids = batch.column(0)
            rows, starts, ends, pieces = [], [], [], []
            for k, (a, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for s, e in split.units(text, language(a)):
                    rows.append(k)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        pieces.append(text[s:e])
            columns = [ids.take(pa.array(np.array(rows, np.int64))), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            names = [id_col, "start_at", "end_at"]
            if with_text:
                columns.append(pa.array(pieces, pa.string()))
                names.append("sentence")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    fields = [StructField(id_col, docs.schema[id_col].dataType), StructField("start_at", LongType()), StructField("end_at", LongType())]
    source = docs.select(F.col(id_col), lang, F.col(text_col).cast("string").alias("t")).where("t is not null")
    return source.mapInArrow(run, StructType(fields + [StructField("sentence", StringType())] * with_text))
