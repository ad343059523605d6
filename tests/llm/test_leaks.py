import collections
import re
import unicodedata

import numpy as np

from inkwell.llm.leaks import leaked, leaks, plain

ITEM = "The narrow queue of Tobilosia grew by 12 percent and the team of the archive kept every short note before the weekly review was over"
CJK = "文書のうち九件は控えに含まれ静かに文書として比較した新しい画面と索引を先に読み会議の前に更新した"


def brute(docs, items):
    def words(t, cjk):
        t = unicodedata.normalize("NFKD", plain(t))
        t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Me", "Cf")).lower()
        return [c for c in t if c.isalnum()] if cjk else re.findall(r"[^\W_]+", t)

    out = set()
    for i, t, cjk in items:
        w, k = words(t, cjk), 16 if cjk else 10
        index = collections.defaultdict(list)
        for p in range(len(w) - k + 1):
            index[tuple(w[p : p + k])].append(p)
        for d, x in docs:
            v, cover = words(x, cjk), set()
            for p in range(len(v) - k + 1):
                for q in index.get(tuple(v[p : p + k]), ()):
                    cover.update(range(q, q + k))
            if w and 2 * len(cover) >= len(w) and cover:
                out.add((d, i))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([x[:2] for x in items], "item_id long, text string")
    return {tuple(r) for r in leaked(leaks(d, i)).collect()}


def test_planted_passages(spark):
    w = ITEM.split()
    docs = [
        (1, "Before. " + ITEM.upper() + " After."),
        (2, "x **" + "** ".join(w[:13]) + " y"),
        (3, " ".join(w[:9]) + " gap " + " ".join(w[9:18])),  # runs of nine only
        (4, " ".join(w[:5]) + " [" + w[5] + "](../notes/page.md) " + "\n> ".join(w[6:])),
        (5, "前に" + CJK[:30] + "。" + CJK[30:]),
        (6, CJK[:15] + "あ" + CJK[15:30]),
        (7, None), (8, ""), (9, "word " * 5000 + ITEM),
    ]
    items = [(1, ITEM, False), (2, CJK, True), (3, ITEM, False)]
    got = found(spark, docs, items)
    assert got == brute([d for d in docs if d[1]], items)
    assert {(1, 1), (1, 3), (2, 1), (4, 1), (5, 2), (9, 1)} <= got and not {(3, 1), (6, 2)} & got


def test_random_texts_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["a", "b", "12", "Name", "percent", "é"]
    items = [(i, " ".join(rng.choice(vocabulary, 24)), False) for i in range(6)]
    docs = []
    for d in range(150):
        w = list(rng.choice(vocabulary, 20))
        a = int(rng.integers(0, 14))
        docs.append((d, " ".join(w + items[d % 6][1].split()[a : a + int(rng.integers(8, 20))] + w)))
    assert found(spark, docs, items) == brute(docs, items)


def test_reparameterised_question(spark):
    other = ITEM.replace("12", "57").replace("Tobilosia", "Krabroxamoa")
    mixed = ITEM.replace("narrow", "broad")
    d = spark.createDataFrame([(1, "So. " + other), (2, mixed), (2, mixed)], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in leaks(d, i).collect()}
    assert got[1].covered == got[1].words and got[1].verbatim < got[1].words
    assert got[2].covered < got[2].words
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
    assert leaks(d, i, most_sent=4).count() == 2  # in blocks


def test_long_targets_and_tags_hold_no_words():
    from inkwell.llm.leaks import plain

    url, tag = "https://host/" + "part/" * 200, "<a " + " ".join(f'data-x{i}="value {i}"' for i in range(60)) + ">"
    assert plain(f"see [the page]({url}) now") == "see [the page now"
    assert plain(f'see [the page]({url} "A title") now') == "see [the page now"
    assert plain(f"see {tag}the page</a> now") == "see the page now"
    prose = "some words that go on " * 20
    assert plain(f"open [x]({prose}) end").split() == f"open [x]({prose}) end".split()
    assert plain(f"a <b {prose}\n\nc=1> end").split() == f"a b {prose} c=1> end".split()


def test_units_and_names_are_learned_from_the_whole_set():
    from inkwell.llm.leaks import Lexicon

    hashes = lambda text: Lexicon_of(text).known

    def Lexicon_of(*texts):  # noqa: N802
        x = Lexicon()
        for t in texts:
            x.add([t])
        return x

    x = Lexicon_of("grew by 12 percent when Kalo saw 3 kg of it", "and 40 percent less than 9 kg here", "The word of 5 words", "word by word")
    y = Lexicon()
    y.add(["word by word", "The word of 5 words", "and 40 percent less than 9 kg here", "grew by 12 percent when Kalo saw 3 kg of it"])
    assert set(x.units) == set(y.units) == set(hashes("percent kg")) and set(x.names) == set(y.names) == set(hashes("Kalo"))


def test_reparameterised_passages_are_told_from_others(spark):
    """Forty questions, each with other numbers, units and names, and with other words."""
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    items, docs, truth = [], [], {}
    for n in range(40):
        w = list(rng.choice(words, 24, replace=False))
        for at, value in ((4, f"{n + 3}"), (5, "percent" if n % 2 else "kg"), (12, f"Name{chr(97 + n % 26)}{chr(97 + n // 26)}")):
            w[at] = value
        items.append((n, " ".join(w)))
        new = list(w)
        if n % 4 == 0:
            new[4], new[5], new[12] = f"{n + 50}", "kg" if n % 2 else "percent", "Other" + w[12][4:]
            truth[n] = "template"
        elif n % 4 == 1:
            truth[n] = "verbatim"
        elif n % 4 == 2:
            for at in range(2, 24, 5):
                new[at] = words[int(rng.integers(400))] + "x"
            truth[n] = "other"
        else:
            new = list(rng.permutation(w))
            truth[n] = "other"
        docs.append((n, "So it began. " + " ".join(new) + " and so on."))
    got = {}
    for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        if r.doc_id == r.item_id:
            got[r.doc_id] = "verbatim" if 2 * r.verbatim >= r.words else "template" if 2 * r.covered >= r.words else "other"
    assert {n: got.get(n, "other") for n in truth} == truth
