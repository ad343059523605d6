import pytest

from inkwell.llm.markup import clean, convert

PLAIN = [
    "2 * 3 * 4 gives 24", "The mask *.md matches *.txt", "list[0] and [3] (4)", "When n < 3 and a <- b -> c", "read_only_flag and a_b_c",
    "It costs $5 to $9", "C:\\temp\\new\\items", "R&D and Q&A; so", "Step #3 and C# basics", "{name} fields", "Set A | B = C", "~/notes and The ~ sign",
    "Scores of -5 or 50%", "One paragraph.\n\nAnother.", "it's and 'so'", "3.5 is > 2", "",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_signs_stay(text):
    assert convert(text)[0] == text and convert(text)[2] == {}


@pytest.mark.parametrize(
    "text, out, language",
    [
        ("## How it *works* ##", "How it works", "markdown"),
        ("Title\n=====\n\nBody **bold** and __b__ and _e_ ~~y~~", "Title\n\nBody bold and b and e y", "markdown"),
        ("- [x] one\n- two\n\n> said", "• one\n• two\n\nsaid", "markdown"),
        ("See [the text](a/b.md), ![List[0]](x.png \"t\"), [it][r1] and[^2].\n\n[r1]: http://x.y", "See the text, List[0], it and.", "markdown"),
        ("Run `a_b_c` now\n\n```py\nx = 1\n  y\n```", "Run a_b_c now\n\n    x = 1\n      y", "markdown"),
        ("| a | b |\n| --- | :-: |\n| 1 | 2 |", "a\tb\n1\t2", "markdown"),
        ("== Head = a ==\nThe '''bold''' and ''it'' [[page|label]] [[x]]{{anchor|top}} {{note|N}}", "Head = a\n\nThe bold and it label x N", "wiki"),
        ("{| class=\"w\"\n|-\n| one\n| two\n|}\n{{Infobox\n| a = b\n}}\nEnd", "one\ntwo\n\nEnd", "wiki"),
        ("\\section{{name} f}\\label{x}\n\\begin{itemize}\n\\item A \\textbf{b}\n\\item C\\cite{k}\n\\end{itemize}", "{name} f\n\n• A b\n• C", "latex"),
        ("Let $x_{0}^2 + y$ be \\(a \\leq b\\).\n\\[ \\frac{a}{b} \\]", "Let x_{0}^2 + y be a \\leq b.\n\n\\frac{a}{b}", "latex"),
        ("<ul><li>One<li>Two &amp; x</ul><p>Text<br/>more&nbsp;now</p><!-- c --><script>var n;</script>", "• One\n• Two & x\n\nText\nmore now", "html"),
        ("<TABLE><TR><TD>a</TD><TD>b</TD></TR></TABLE><pre><code>l &gt; o\n x</code></pre>", "a\tb\n\n    l > o\n     x", "html"),
        ("Escaped &lt;i&gt;word&lt;/i&gt; &#8220;q&#8221; a<sup>2</sup>", "Escaped word “q” a2", "html"),
        ("<div class=\"note\"\n id='x'>Inside</div> after", "Inside\n\nafter", "html"),
    ],
)
def test_markup(text, out, language):
    got, _, pieces = convert(text)
    assert got == out and pieces.get(language, 0) > 0
    assert convert(text.replace("\n", "\r\n"))[0].replace("\r", "") == out


def test_tree_scoring_drops_menus_and_keeps_siblings():
    menu = "<nav><ul>" + "".join(f'<li><a href="{i}">Page {i}</a></li>' for i in range(20)) + "</ul></nav>"
    body = "<div><h2>Head</h2><p>" + "A long paragraph, with commas, and more words. " * 6 + "</p><ul><li>kept item</li></ul></div>"
    tail = "<div><p>" + "Another part, of fair length, that belongs here. " * 6 + "</p></div>"
    got, blocks, _ = convert(f"<html><body>{menu}{body}{tail}</body></html>")
    assert "Page 3" not in got and "kept item" in got and "Another part" in got and ("heading", 2, "Head") in blocks


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, "a **b**", "x"), (4, "a **b**", "x"), (5, "word " * 20000 + "`c`", "x"), (6, "```\nopen", "x")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, clean string")
    got = {r.row_id: r for r in clean(df, "chunk_id").collect()}
    assert got[1].clean is None and got[2].clean == "" and got[3].clean == "plain" and got[4].clean == "a b"
    assert got[5].clean == "word " * 20000 + "c" and got[6].clean == "    open"
    assert not got[3].pieces and got[4].pieces == {"markdown": 1}
    assert clean(df.limit(0), "chunk_id").count() == 0


def test_omitted_end_tags_and_any_depth():
    rows = "".join(f"<tr><td>a{i}<td>b{i}" for i in range(5000))
    assert convert(f"<table>{rows}</table>")[0] == "\n".join(f"a{i}\tb{i}" for i in range(5000))
    terms = "".join(f"<dt>t{i}<dd><p>d{i}" for i in range(5000))
    assert convert(f"<dl>{terms}</dl>")[0] == "\n\n".join(f"• t{i}\n\nd{i}" for i in range(5000))
    options = "".join(f"<option>o{i}" for i in range(2000))
    assert convert(f"<form><select>{options}</select></form>")[0] == "\n\n".join(f"o{i}" for i in range(2000))
    assert convert("".join(f"<div>x{i}" for i in range(3000)))[0] == "\n\n".join(f"x{i}" for i in range(3000))
    inner = "<table><tr><td>c<td>d<tr><td>e</table>"
    assert convert(f"<table><tbody><tr><td>a<td>{inner}<tbody><tr><td>f</table>")[0] == "a\n\nc\td\ne\nf"
    assert convert("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")[0] == "• a\n• b\n• c\n• d"


def test_nesting_of_any_depth_leaves_no_residue():
    for depth in (4, 7, 300):
        assert convert("A " + "\\emph{" * depth + "x" + "}" * depth + " b")[0] == "A x b"
        assert convert("A " + "{{t|" * depth + "v" + "}}" * depth + " b")[0] == "A v b"


@pytest.mark.parametrize("opener", ["![a ", "<!-- ", "\\[a ", "\\(a ", "$a ", "$x_1 ", "<pre>", "<script>", "[a](", "**a ", "_a ", "{{a ", "\\a{b ", "~~a "])
def test_a_hundred_thousand_openers_take_linear_time(opener):
    import time

    began = time.perf_counter()
    convert(opener * 100_000)
    assert time.perf_counter() - began < 20


def test_marks_within_marks_leave_nothing_behind():
    assert convert("\\(a `b` c\\)")[0] == "a b c" and convert("1234. item\n56789. more")[0] == "• item\n• more"
    for text in ("$`x`_1$", "\\[ `a` \\]", "<pre>`x`</pre>"):
        assert not any(ord(c) < 9 for c in convert(text)[0])


PAGE = """<html><body><header><a href="/">Home</a> <a href="/b">Blog</a></header>
<div id="side"><ul>{links}</ul></div>
<div id="main">{parts}</div>
<footer><a href="/i">Imprint</a> <a href="/p">Privacy</a></footer></body></html>"""


def test_the_main_part_of_pages_is_kept_and_menus_are_not():
    """Twenty pages of other makes: words of the articles kept, words of menus dropped."""
    kept = dropped = articles = menus = 0
    for n in range(20):
        links = "".join(f'<li><a href="{i}">menu{n}x{i} entry</a></li>' for i in range(6 + n))
        parts = "".join(f"<{'p' if n % 2 else 'section'}>part{n}x{i}, " + "plain words of an article, with commas, " * (2 + (n + i) % 4) + f"</{'p' if n % 2 else 'section'}>" for i in range(2 + n % 5))
        got = convert(PAGE.format(links=links, parts=parts))[0]
        articles += 2 + n % 5
        menus += 6 + n
        kept += sum(f"part{n}x{i}," in got for i in range(2 + n % 5))
        dropped += sum(f"menu{n}x{i} " not in got for i in range(6 + n))
    assert kept == articles and dropped >= 0.9 * menus, (kept / articles, dropped / menus)
