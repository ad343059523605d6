"""Text analysis as Column expressions: everything here stays in the JVM and in codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ranges whose characters are indexed as overlapping pairs (fixed values).
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ"
RUNS = rf"[{CJK}]+|(?:[\p{{L}}\p{{N}}&&[^{CJK}]]\p{{M}}*)+"
#: Most distinct tokens of a relaxed query, and the least that make one (fixed values).
RELAXED_MOST, RELAXED_LEAST = 32, 2


def _folding() -> tuple[str, str]:
    """Latin letters with diacritics and their base letters, from Unicode decompositions."""
    pairs = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and base.isascii():
            pairs[chr(c)] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def folded(c: Column) -> Column:
    """Diacritics removed from Latin letters, composed or not; other scripts stay."""
    return F.translate(F.regexp_replace(c, r"(?<=\p{IsLatin})[̀-ͯ]+", ""), FOLD_FROM, FOLD_TO)


def tokens(c: Column, fold: bool = True) -> Column:
    """array<string>: lower-case words and overlapping CJK pairs, in order of the text (a
    lone CJK character is a token). Null gives an empty array."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # Folded once for the whole text, not for each word.
    runs = F.regexp_extract_all(folded(low) if fold else low, F.lit(RUNS), F.lit(0))

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]") & (F.length(run) > 1), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, pieces))


def index_string(c: Column) -> Column:
    return F.concat_ws(" ", tokens(c))


def relaxed_tokens(c: Column, most: int | None = RELAXED_MOST) -> Column:
    """The distinct tokens of a relaxed query, the first `most` (None: all); null if that would
    be no query."""
    own = F.array_distinct(tokens(c))
    own = own if most is None else F.slice(own, 1, most)
    return F.when(F.size(own) >= RELAXED_LEAST, own)


def slug(c: Column) -> Column:
    """Lower-case letters, digits, "_" and "-"; a run of spaces or hyphens becomes one "-"."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}_\- ]+", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[ \-]+", "-"), r"^-+|-+$", "")


def without_inline_marks(c: Column) -> Column:
    """Markdown links to their text; emphasis, code and strike marks removed."""
    out = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(out, r"[*_`]|~~", ""))


def flat(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))


def snippet(text: Column, terms: list[str], window: int = 120) -> Column:
    """Half a window on both sides of the first occurrence of the first term that occurs, with
    "…" where text is left out; else the first `window` characters."""
    line = flat(text)
    low = F.lower(line)
    at = F.coalesce(*(F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in terms if t), F.lit(0)) if any(terms) else F.lit(0)
    half = window // 2
    begin = F.greatest(at - half, F.lit(1))
    end = F.least(at - 1 + half, F.length(line))  # characters up to here, from the start
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(line, begin, end - begin + 1), F.when(end < F.length(line), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(line, 1, window))


def landing_phrase(passage: Column, least: int = 8, most: int = 28) -> Column:
    """The longest part of a passage without inline marks, cut; null if it is too short."""
    parts = F.split(passage, r"[`*_\[\]()#|<>\n]")
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    clean = F.trim(longest)
    return F.when(F.length(clean) >= least, F.substring(clean, 1, most))


def highlighted(text: Column, terms: list[str]) -> Column:
    """Every occurrence of terms of two characters or more in <mark>, longer terms first."""
    import re

    some = sorted({t for t in terms if len(t) >= 2}, key=lambda t: (-len(t), t))
    if not some:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in some) + ")", "<mark>$1</mark>")


def occurrences(text: Column, term: str, most: int = 5000) -> Column:
    """How often a term occurs, case aside, without overlaps; counting ends at `most`."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = (F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)
    return F.least(n.cast("int"), F.lit(most))


def positions(text: Column, term: str, most: int = 5000) -> Column:
    """Places (from 0) where a term stands, case aside, without overlaps, `most` at most."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\Q" + term.lower().replace("\\E", "") + r"\E")
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    ends = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) + i * len(term))
    return F.slice(ends, 1, most)


def stepped(positions: Column, current: Column, forward: bool = True) -> Column:
    """The number (from 0) of the next or previous occurrence, around the ends; null for none."""
    n = F.size(positions)
    return F.when(n > 0, F.pmod(current + (1 if forward else -1), n))


def landing(section: Column, terms: list[str], phrase: Column | None = None) -> Column:
    """Where to land in a section whose first line is its heading: struct(by, line, at, length).

    The first line below the heading that holds a term (case aside), and there the term that
    stands first; else the same with `phrase`; else the heading. A section of its heading
    alone is searched itself; lines and places count from 0.
    """
    lines = F.split(F.coalesce(section, F.lit("")), "\n")
    alone = F.size(lines) < 2
    body = F.when(alone, lines).otherwise(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1))))
    first = F.when(alone, 0).otherwise(1)

    def found(by: str, wanted: list[Column]) -> Column:
        def place(line: Column, n: Column) -> Column:
            at = [F.struct(F.nullif(F.instr(F.lower(line), w), F.lit(0)).alias("at"), F.length(w).alias("length")) for w in wanted]
            best = F.array_min(F.filter(F.array(*at), lambda x: x["at"].isNotNull()))
            return F.struct(F.lit(by).alias("by"), (n + first).cast("int").alias("line"), (best["at"] - 1).alias("at"), best["length"].alias("length"))

        return F.get(F.filter(F.transform(body, place), lambda x: x["at"].isNotNull()), F.lit(0))

    heading = F.struct(F.lit("heading").alias("by"), F.lit(0).alias("line"), F.lit(0).alias("at"), F.length(lines[0]).alias("length"))
    some = [F.lit(t.lower()) for t in terms if t]
    tries = [found("term", some)] if some else []
    if phrase is not None:
        own = F.lower(phrase)
        tries.append(F.when(F.coalesce(F.length(own) > 0, F.lit(False)), found("phrase", [own])))
    return F.coalesce(*tries, heading)


def alerts(text: Column) -> Column:
    """Kinds of the alert blocks (`> [!NOTE]` and the like) of a Markdown text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^[ \t]*>[ \t]*\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]"), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(vec: Column, dim: int = 64) -> Column:
    """Vectors of `dim` finite numbers that are not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & finite & (norm(vec) > 0), F.lit(False))


def unit(vec: Column) -> Column:
    """array<double> of length one; vectors shorter than 1e-9 stay as they are."""
    # The norm stands in an array of its own, so that it is computed once and not per number.
    n = F.array_repeat(F.greatest(norm(vec), F.lit(0.0)), F.size(vec))
    return F.zip_with(vec, n, lambda x, l: F.when(l < 1e-9, x.cast("double")).otherwise(x.cast("double") / l))
