"""Clean text from texts with HTML, Markdown, wiki or LaTeX residue (problem 2).

Method: tree scoring. A text becomes a tree of containers (HTML elements) and leaves
(paragraphs, headings, list items, table rows, code, formulas; the marks of all four
languages make leaves). A paragraph passes points for its length and commas to its
ancestors, less with every level, discounted by the share of its text that is link text;
the container with most points is kept, and with it every sibling branch that has a fair
share of the points or is no mere list of links. Where no container holds more than one
branch, as in most residue, everything is kept.

What is kept of structure: a heading stands alone, list items begin with "• ", table cells
are parted by tabs, code is indented by four blanks, formulas keep their source. The same
blocks come out as `blocks`.

Marks are recognised strictly, so that signs used as plain characters stay as they are
(`2 * 3`, `list[0]`, `n < 3`, `read_only_flag`, `$5 to $9`, `C:\\temp`, `*.md`, `Q&A`).

Defined results: null text gives null and no pieces; a text without marks comes back
unchanged; unclosed marks are left as they are, an unclosed fence is code to the end;
texts of any length are read whole, each where it lies, without shuffle; rows that are
exact copies (same id) are one row; clashing further columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML, and of wiki text in the same form (fixed values).
BLOCKS = """address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html iframe li link main menu meta nav noscript ol option p pre section select svg summary
table tbody td template tfoot th thead title tr ul""".split()
INLINE = """a abbr b big bdi bdo br button cite code data del dfn em font gallery i img input ins kbd label mark math nowiki
q ref references s samp script small source span strike strong style sub sup textarea time tt u var video wbr""".split()
#: What ends where another element of its kind begins: (elements that end, those it doesn't end beyond).
_ROW, _PART = {"tr", "td", "th"}, {"thead", "tbody", "tfoot"}
_LIST = {*BLOCKS} - {"li", "dt", "dd", "p", "div", "address"}
ENDS = (
    {"li": ({"li"}, _LIST | {"dt", "dd"}), "option": ({"option"}, {"select"}), "tr": (_ROW, {"table"})}
    | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, _LIST | {"li"}))
    | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"}))
    | dict.fromkeys(_PART, (_ROW | _PART, {"table"}))
)
TAG = re.compile(rf"</?({'|'.join(sorted(BLOCKS + INLINE, key=len, reverse=True))})(?=[\s/>])(?:\s[^<>]*|\s*)/?>", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
COMMENT = re.compile("<!--"), re.compile("-->")
DROPPED = [(re.compile(rf"<{x}\b[^<>]*>", re.I), re.compile(rf"</{x}\s*>", re.I)) for x in ("script", "style")]
PRE = re.compile(r"<pre\b[^<>]*>", re.I), re.compile(r"</pre\s*>", re.I)
FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]*\1[ \t]*\r?$|\Z)", re.S | re.M)
CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
DISPLAY = re.compile(r"\\\["), re.compile(r"\\\]")
DOLLARS = re.compile(r"\$\$([^$]+)\$\$")
FORMULA = re.compile(r"\\\("), re.compile(r"\\\)")
DOLLAR, MATHS = re.compile(r"\$"), re.compile(r"\\[A-Za-z]+|[\^_]\{?\w")
TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
IMAGE = re.compile(r"!\["), re.compile(r"\]\([^()\n]*\)")
LINK = re.compile(r"\[([^\]\[\n]+(?:\[[^\]\[\n]*\])?)\]\([^()\n]*\)")
REFERENCE = re.compile(r"\[([^\]\[\n]+)\]\[[^\]\[\n]*\]")
DEFINITION = re.compile(r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]*\S+[^\n]*$", re.M)
FOOTNOTE = re.compile(r"\[\^[^\]\s]+\](?::[ \t]*)?")
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]")
OUTSIDE = re.compile(r"\[https?://[^\s\]]+(?: ([^\]\n]*))?\]")
WIKI_STRONG, WIKI_EM = re.compile(r"'''([^'\n]+)'''"), re.compile(r"(?<!')''([^'\n]+)''(?!')")
STRONG = re.compile(r"(?<!\*)(\*\*\*?)(?=\S)([^*\n]*?\S)\1(?!\*)|(?<![\w_])(__)(?=\S)([^\n]*?\S)\3(?![\w_])")
EM = re.compile(r"(?<![*\w\\])\*(?=[^\s*])([^*\n]*?(?<=[^\s*]))\*(?![*\w])|(?<![\w_])_(?=[^\s_])([^_\n]*?(?<=[^\s_]))_(?![\w_])")
STRUCK = re.compile(r"~~(?=\S)([^~\n]*?\S)~~")
BRACED = r"\{((?:[^{}\n]|\{[^{}\n]*\})*)\}"
TEX_HEAD = re.compile(rf"\\(part|chapter|section|subsection|subsubsection|paragraph|title)\*?{BRACED}")
TEX_NOTE = re.compile(r"\\(?:label|cite[a-z]*|ref|eqref|pageref|index|vspace|hspace|bibliography|usepackage|documentclass)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
TEX_RANGE = re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
TEX_ITEM = re.compile(r"^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", re.M)
TEX_COMMAND = re.compile(rf"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?{BRACED}")
HEADING = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$")
WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*(?!=)(\S[^\n]*?)[ \t]*\1[ \t]*$")
TRAILING = re.compile(r"^(.*\S)[ \t]+#{2,6}[ \t]*$")
RULE = re.compile(r"^[ \t]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDERLINE = re.compile(r"^[ \t]{0,3}(={3,}|-{3,})[ \t]*$")
QUOTE = re.compile(r"^[ \t]{0,3}>[ \t]?(?=\S)")
ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(\[[ xX]\][ \t]+)?(?=\S)")
DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$")
WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\||\|\}|\|-)")
#: A text without any of these holds no mark.
SUSPECT = re.compile(r"[<&`*_~#=\[{\\$|]|'{2}|^[ \t]*(?:>|[-+][ \t]|\d{1,9}[.)][ \t]|-{3,})", re.M)

#: Control characters that stand for marks here; a text that has marks loses its own.
OWN = {c: None for c in (2, 3, 4, 5, 14, 15)}
HELD = re.compile("\x02(\\d+)\x03")
LINKED = re.compile("[\x0e\x0f]")


class Element:
    """A container of the tree; parts are texts and elements in order."""

    def __init__(self, name: str, parent: Element | None):
        self.name, self.parent = name, parent
        self.parts: list[str | Element | Leaf] = []
        self.points = 0.0


class Leaf:
    """A paragraph, heading, list item, table row, code block or formula."""

    def __init__(self, kind: str, text: str, level: int = 0):
        self.kind, self.text, self.level = kind, text, level


class Converter:
    """One text: marks are taken off step by step, and counted."""

    def __init__(self, text: str):
        self.pieces: Counter = Counter()
        self.held: list[tuple[str, str]] = []
        self.text = text.translate(OWN)

    def _hold(self, kind: str, body: str) -> str:
        self.held.append((kind, HELD.sub(lambda m: self.held[int(m.group(1))][1], body)))
        mark = f"\x02{len(self.held) - 1}\x03"
        return f"\n\n{mark}\n\n" if kind in ("code", "formula") else mark

    def _swap(self, name: str, pattern: re.Pattern, by) -> None:
        def one(m: re.Match) -> str:
            self.pieces[name] += 1
            return by(m)

        self.text = pattern.sub(one, self.text)

    def _swap_all(self, name: str, pattern: re.Pattern, by) -> None:
        """_swap() until nothing is left; every round must shorten the text."""
        before = -1
        while self.pieces[name] != before:
            before = self.pieces[name]
            self._swap(name, pattern, by)

    def _swap_between(self, name: str, ends: tuple[re.Pattern, re.Pattern], by, line: bool = False, least: int = 0) -> None:
        """Swaps what stands from an opener to the next closer (on its line); each sign is looked
        at once, so openers without closer cost nothing. by: what the inner text becomes."""
        text = self.text
        closers = [(m.start(), m.end()) for m in ends[1].finditer(text)]
        if not closers:
            return
        begins = [a for a, _ in closers]
        breaks = [m.start() for m in re.finditer("\n", text)] if line else []
        out, done = [], 0
        for m in ends[0].finditer(text):
            if m.start() < done:
                continue
            at = bisect.bisect_left(begins, m.end() + least)
            if at == len(closers):
                break
            if line and bisect.bisect_left(breaks, m.end()) != bisect.bisect_left(breaks, begins[at]):
                continue
            self.pieces[name] += 1
            out += [text[done : m.start()], by(text[m.end() : begins[at]])]
            done = closers[at][1]
        self.text = "".join(out) + text[done:]

    def _dollars(self) -> None:
        """$formula$: two signs on a line with signs of mathematics between them."""
        text = self.text
        out, done, last = [], 0, -1
        for m in DOLLAR.finditer(text):
            at = m.start()
            if last >= 0 and text.find("\n", last + 1, at) < 0 and MATHS.search(text, last + 1, at):
                self.pieces["latex"] += 1
                out += [text[done:last], self._hold("inline", text[last + 1 : at].strip())]
                done, last = at + 1, -1
            else:
                last = at
        self.text = "".join(out) + text[done:]

    def run(self) -> list[Leaf]:
        linked = lambda m: f"\x0e{m.group(1) or ''}\x0f"
        t = self.text
        if "<!--" in t:
            self._swap_between("html", COMMENT, lambda inner: "")
        if "```" in t or "~~~" in t:
            self._swap("markdown", FENCE, lambda m: self._hold("code", m.group(2).rstrip("\r\n")))
        if "<" in t:
            for ends in DROPPED:
                self._swap_between("html", ends, lambda inner: "")
            self._swap_between("html", PRE, lambda inner: self._hold("code", html.unescape(TAG.sub("", inner)).strip("\r\n")))
        if "`" in t:
            self._swap("markdown", CODE, lambda m: self._hold("inline", m.group(1)))
        if "\\[" in t or "$$" in t:
            self._swap_between("latex", DISPLAY, lambda inner: self._hold("formula", inner.strip()), least=1)
            self._swap("latex", DOLLARS, lambda m: self._hold("formula", m.group(1).strip()))
        if "\\" in t or "$" in t:
            self._swap_between("latex", FORMULA, lambda inner: self._hold("inline", inner.strip()), line=True, least=1)
            self._dollars()
            self._swap("latex", TEX_NOTE, lambda m: "")
            self._swap("latex", TEX_RANGE, lambda m: "\n\n")
            self._swap("latex", TEX_ITEM, lambda m: "\x05")
            self._swap("latex", TEX_HEAD, lambda m: f"\n\n\x04{m.group(2)}\n\n")
            self._swap_all("latex", TEX_COMMAND, lambda m: m.group(1))  # commands within commands
        if "[" in t:
            self._swap_between("markdown", IMAGE, lambda inner: inner, line=True)
            self._swap("wiki", WIKI_LINK, linked)
            self._swap("wiki", OUTSIDE, linked)
            self._swap("markdown", LINK, linked)
            self._swap("markdown", DEFINITION, lambda m: "")
            self._swap("markdown", REFERENCE, linked)
            self._swap("markdown", FOOTNOTE, lambda m: "")
        if "{{" in t:
            self._swap_all("wiki", TEMPLATE, self._template)
        root = self._tree()
        self._lay_out(root)
        return [leaf for leaf in self._kept(root)]

    @staticmethod
    def _template(m: re.Match) -> str:
        name, *rest = m.group(1).split("|")
        if "\n" in m.group(1) or not rest or name.strip().lower().startswith(("anchor", "infobox")):
            return ""
        return "" if "=" in rest[-1] else rest[-1].strip()

    def _inline(self, s: str) -> str:
        """Marks within a line."""
        self.text = s
        if "'''" in s or "''" in s:
            self._swap("wiki", WIKI_STRONG, lambda m: m.group(1))
            self._swap("wiki", WIKI_EM, lambda m: m.group(1))
        for sign, pattern in (("*_", STRONG), ("*_", EM), ("~", STRUCK)):
            if any(c in s for c in sign):
                self._swap("markdown", pattern, lambda m: next(g for g in reversed(m.groups()) if g is not None))
        if "&" in s:
            had = "<" in s
            self._swap("html", ENTITY, lambda m: html.unescape(m.group()).replace("\xa0", " "))
            if not had and "<" in self.text:  # elements whose brackets were escaped once more
                self._swap("html", TAG, lambda m: "")
        return self.text

    def _tree(self) -> Element:
        root = here = Element("#root", None)
        done = 0
        opened: Counter = Counter()

        def leave(e: Element) -> Element:
            """Ends e and all that is open in it."""
            at = here
            while at is not e:
                opened[at.name] -= 1
                at = at.parent
            opened[e.name] -= 1
            return e.parent

        for m in TAG.finditer(self.text):
            self.pieces["html"] += 1
            here.parts.append(self.text[done : m.start()])
            done = m.end()
            name = m.group(1).lower()
            closing = m.group().startswith("</")
            if name == "br":
                here.parts.append("\n")
            elif name == "hr":
                here.parts.append("\n\n")
            elif name == "a":
                here.parts.append("\x0f" if closing else "\x0e")
            elif name == "img":
                alt = re.search(r"\balt=[\"']([^\"'<>]*)", m.group())
                here.parts.append(alt.group(1) if alt else "")
            elif name not in BLOCKS or name in ("link", "meta") or m.group().endswith("/>"):
                continue
            elif not closing:
                if name == "p" and here.name == name:
                    here = leave(here)
                ending, beyond = ENDS.get(name, ((), ()))
                if any(opened[x] for x in ending):
                    last, at = None, here
                    while at.parent and at.name not in beyond:
                        last = at if at.name in ending else last
                        at = at.parent
                    here = leave(last) if last else here
                child = Element(name, here)
                opened[name] += 1
                here.parts.append(child)
                here = child
            else:
                if opened[name]:
                    at = here
                    while at.name != name:
                        at = at.parent
                    here = leave(at)
                else:
                    here.parts.append("\n\n")
        here.parts.append(self.text[done:])
        return root

    def _lay_out(self, root: Element) -> None:
        """Texts between elements become leaves; the tree may be of any depth."""
        stack: list[tuple[Element, Iterator, list[str | Element | Leaf], list[str]]] = []

        def enter(e: Element) -> None:
            if e.name == "tr":
                cells = ["".join(p for p in x.parts if isinstance(p, str)) if isinstance(x, Element) else "" for x in e.parts if isinstance(x, Element)]
                nested = any(isinstance(p, Element) for x in e.parts if isinstance(x, Element) for p in x.parts)
                if not nested:
                    e.parts = [Leaf("row", "\t".join(self._inline(" ".join(c.split())) for c in cells))]
                    return
            stack.append((e, iter(e.parts), [], []))

        def flush(e: Element, out: list[str | Element | Leaf], run: list[str]) -> None:
            if run:
                out.extend(self._leaves("".join(run), e.name))
                run.clear()

        enter(root)
        while stack:
            e, parts, out, run = stack[-1]
            for p in parts:
                if isinstance(p, str):
                    run.append(p)
                else:
                    flush(e, out, run)
                    out.append(p)
                    enter(p)
                    break
            else:
                flush(e, out, run)
                e.parts = out
                stack.pop()

    def _leaves(self, text: str, container: str) -> Iterator[Leaf]:
        if container in ("h1", "h2", "h3", "h4", "h5", "h6", "title"):
            if text.strip():
                yield Leaf("heading", self._inline(" ".join(text.split())), int(container[1]) if container != "title" else 1)
            return
        kind = "item" if container in ("li", "dt", "dd") else "p"
        para: list[str] = []
        table = False

        def end() -> Iterator[Leaf]:
            nonlocal kind
            if body := "\n".join(para).strip():
                yield Leaf(kind, self._inline(body))
            para.clear()
            kind = "item" if container in ("li", "dt", "dd") else "p"

        lines = text.replace("\r\n", "\n").split("\n")
        for k, line in enumerate(lines):
            bare = line.strip()
            if not bare:
                yield from end()
                if kind == "p":
                    table = table and any(x.strip().startswith(("|", "!")) for x in lines[k + 1 : k + 2])
                continue
            held = HELD.fullmatch(bare)
            if held and self.held[int(held.group(1))][0] != "inline":
                yield from end()
                form, body = self.held[int(held.group(1))]
                yield Leaf(form, body)
                continue
            if bare[0] == "\x04":
                yield from end()
                yield Leaf("heading", self._inline(bare[1:].strip()), 2)
                continue
            if bare[0] == "\x05":
                yield from end()
                kind = "item"
                para.append(bare[1:].strip())
                continue
            if WIKI_TABLE.match(line):
                self.pieces["wiki"] += 1
                yield from end()
                table = not bare.startswith("|}")
                continue
            if DELIMITER.match(line):
                self.pieces["markdown"] += 1
                if para:  # the line before is the head of the table
                    head = para.pop()
                    yield from end()
                    yield self._row(head)
                table = True
                continue
            if table and bare[0] in "|!":
                yield from end()
                yield self._row(bare)
                continue
            quote = QUOTE.match(line)
            if quote:
                self.pieces["markdown"] += 1
                line = line[quote.end() :]
                bare = line.strip()
            head = HEADING.match(line)
            if head or (wiki := WIKI_HEADING.match(line)):
                self.pieces["markdown" if head else "wiki"] += 1
                yield from end()
                m = head or wiki
                yield Leaf("heading", self._inline(m.group(2)), len(m.group(1)))
                continue
            under = UNDERLINE.match(line)
            if under and para:
                self.pieces["markdown"] += 1
                last = para.pop()
                yield from end()
                yield Leaf("heading", self._inline(last.strip()), 1 if bare[0] == "=" else 2)
                continue
            if RULE.match(line):
                self.pieces["markdown"] += 1
                yield from end()
                continue
            item = ITEM.match(line)
            if item and (bare[0] in "-*+" or kind == "item" or not para):
                self.pieces["markdown"] += 1
                yield from end()
                kind = "item"
                para.append(line[item.end() :])
                continue
            if trailing := TRAILING.match(line):
                self.pieces["markdown"] += 1
                line = trailing.group(1)
            para.append(line)
        yield from end()

    def _row(self, line: str) -> Leaf:
        cells = [c.strip() for c in re.split(r"\|\|?|!!", line.strip().strip("|!"))]
        return Leaf("row", "\t".join(self._inline(c) for c in cells))

    def _kept(self, root: Element) -> Iterator[Leaf]:
        """Scores the tree and gives the leaves of the best container and its siblings."""
        spans: dict[int, tuple[int, int]] = {}

        weighed: list[list] = [[root, iter(root.parts), 0, 0]]
        while weighed:
            e, parts, size, links = weighed[-1]
            for p in parts:
                if not isinstance(p, Leaf):
                    weighed[-1][2:] = size, links
                    weighed.append([p, iter(p.parts), 0, 0])
                    break
                depth, n = 0, 0
                for piece in re.split("([\x0e\x0f])", p.text):
                    if piece in ("\x0e", "\x0f"):
                        depth = int(piece == "\x0e")
                    elif depth:
                        n += len(piece)
                full = len(LINKED.sub("", p.text))
                size, links = size + full, links + n
                if p.kind in ("p", "item") and full:
                    points = (1 + p.text.count(",") + p.text.count("、") + p.text.count("，") + min(full // 100, 3)) * (1 - n / full)
                    up, level = e, 0
                    while up:
                        up.points += points / (1, 2)[level] if level < 2 else points / (level * 3)
                        up, level = up.parent, level + 1
            else:
                spans[id(e)] = (size, links)
                weighed.pop()
                if weighed:
                    weighed[-1][2] += size
                    weighed[-1][3] += links

        dense = lambda e: spans[id(e)][1] / max(1, spans[id(e)][0])
        best = root
        stack = [root]
        while stack:
            e = stack.pop()
            if e.points * (1 - dense(e)) > best.points * (1 - dense(best)) and e.name not in ("nav", "footer", "aside", "menu"):
                best = e
            stack.extend(p for p in e.parts if isinstance(p, Element))
        # The branch of the best container stays whole; of the other branches along the way
        # to the root those that are menus or little but links go.
        least = max(10.0, best.points * 0.2)

        def stays(e: Element) -> bool:
            return e.points >= least or not (dense(e) > 0.5 or (e.name in ("nav", "footer", "aside", "menu") and dense(e) > 0.25))

        path = set()
        up: Element | None = best
        while up:
            path.add(id(up))
            up = up.parent

        def walk() -> Iterator[Leaf]:
            at = [(iter(root.parts), False)]
            while at:
                parts, inside = at[-1]
                for p in parts:
                    if isinstance(p, Leaf):
                        yield p
                    elif inside or id(p) in path or stays(p):
                        at.append((iter(p.parts), inside or p is best and p is not root))
                        break
                else:
                    at.pop()

        for leaf in walk():
            leaf.text = LINKED.sub("", HELD.sub(lambda m: self.held[int(m.group(1))][1], leaf.text))
            if leaf.text.strip():
                yield leaf


def convert(text: str) -> tuple[str, list[tuple[str, int, str]], dict[str, int]]:
    """(clean text, blocks as (kind, level, text), pieces of markup by language)."""
    if not SUSPECT.search(text):
        return text, [("p", 0, p) for p in re.split(r"\n[ \t\r]*\n", text) if p.strip()], {}
    c = Converter(text)
    leaves = c.run()
    pieces = {k: n for k, n in c.pieces.items() if n}
    blocks = [(x.kind, x.level, x.text) for x in leaves]
    if not pieces:
        return text, blocks, pieces
    out = []
    for n, (kind, _, body) in enumerate(blocks):
        near = n and kind == blocks[n - 1][0] and kind in ("item", "row")
        out.append("" if not n else "\n" if near else "\n\n")
        out.append("• " + body if kind == "item" else "\n".join("    " + x for x in body.split("\n")) if kind == "code" else body)
    return "".join(out), blocks, pieces


CLEAN = "row_id bigint, clean string, blocks array<struct<kind: string, level: int, text: string>>, pieces map<string, int>"


def clean(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(row_id, clean, blocks, pieces): the clean text of every row, and how many pieces of
    markup of each language were taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            got = [convert(t) if t is not None else (None, [], {}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([[{"kind": a, "level": b, "text": c} for a, b, c in g[1]] for g in got], kind),
                    pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.int32())),
                ],
                names=["row_id", "clean", "blocks", "pieces"],
            )

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, CLEAN)
