import pytest

from inkwell.llm.sentences import Model, Splitter, _model, associated, learn, sentences

MODEL = Model(
    abbreviations={"*": {"dr": False, "p": False, "e.g": False, "etc": True, "p.m": True, "vgl": False}},
    collocations={"de": {"oktober"}, "*": {"oktober"}},
    starters={"*": {"vaultctl"}},
)


def pieces(text, lang="en"):
    return [text[a:b] for a, b in Splitter(MODEL).units(text, lang)]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("We met Dr. Smith on p. 12 today. It went well.", ["We met Dr. Smith on p. 12 today.", "It went well."]),
        ("It has pens, etc. for all. It has pens, etc. Then it ends.", ["It has pens, etc. for all.", "It has pens, etc.", "Then it ends."]),
        ("At 9 p.m. 6 notes came.", ["At 9 p.m.", "6 notes came."]),
        ("Done?! vaultctl ran. vaultctl ended… Next", ["Done?!", "vaultctl ran.", "vaultctl ended…", "Next"]),
        ("Even so ... the end. It took 3.5 s.", ["Even so ... the end.", "It took 3.5 s."]),
        ('She asked "is it open?" and left. He wrote: "It is. Go." Then rain.', ['She asked "is it open?" and left.', 'He wrote: "It is. Go."', "Then rain."]),
        ("Open. (It rained, see p. 91.) Next one (see i.e. this. And that) ends.", ["Open.", "(It rained, see p. 91.)", "Next one (see i.e. this. And that) ends."]),
        ("First ended.Second began. See index.toml now.", ["First ended.", "Second began.", "See index.toml now."]),
        ("A line\nthat goes on. New\r\none.", ["A line\nthat goes on.", "New\r\none."]),
        ("# A heading. Whole\nText here\n\n- item one\n- [x] item two. More\n\n> quoted\n> on. Next", ["A heading. Whole", "Text here", "item one", "item two.", "More", "quoted\n> on.", "Next"]),
        ("---\ntitle: x. Y\n---\nBody. End\n```py\na. B\n```\n***\nLast", ["Body.", "End", "Last"]),
        ("", []), ("  \n　\n", []), ("```\nnever closed. Text", []),
    ],
)
def test_english(text, parts):
    assert pieces(text) == parts


@pytest.mark.parametrize(
    "text, lang, parts",
    [
        ("担当者は「文書は古い。見てほしい。」と書いた。次は何か！？（静かに読んだ。）終わり……また", "ja", ["担当者は「文書は古い。見てほしい。」と書いた。", "次は何か！？", "（静かに読んだ。）", "終わり……", "また"]),
        ("“已经处理。”他这样写。他写道：“已经处理。”后来没有。", "zh", ["“已经处理。”他这样写。", "他写道：“已经处理。”", "后来没有。"]),
        ("यह पहला है। डॉ. राम आए। क्या?", "hi", ["यह पहला है।", "डॉ. राम आए।", "क्या?"]),
        ("ทีมงานแก้ไขเอกสาร ผู้อ่านพบว่า“ดัชนี ใหม่”ดี จบ", "th", ["ทีมงานแก้ไขเอกสาร", "ผู้อ่านพบว่า“ดัชนี ใหม่”ดี", "จบ"]),
        ("هل قرأ الفريق؟ نعم. انتهى.", "ar", ["هل قرأ الفريق؟", "نعم.", "انتهى."]),
        ("Am 3. Oktober kam er. Es waren 12. Weil es regnete.", "de", ["Am 3. Oktober kam er.", "Es waren 12.", "Weil es regnete."]),
        ("¿Quién fue? ¡Nadie! «Uno. Dos», anotó.", "es", ["¿Quién fue?", "¡Nadie!", "«Uno. Dos», anotó."]),
    ],
)
def test_other_scripts(text, lang, parts):
    model = Model(**{**MODEL.__dict__, "abbreviations": {"*": MODEL.abbreviations["*"] | {"डॉ": False}}})
    assert [text[a:b] for a, b in Splitter(model).units(text, lang)] == parts


def test_learning_and_nulls(spark):
    names = "Anna Boris Clara Dmitri Edgar Fiona Greta".split()
    rows = []
    for i in range(300):
        a, b = names[i % 7], names[(i * 3 + 1) % 7]
        gap = " " if i % 3 == 0 else "\n\n"
        rows.append((i, f"We saw Dr. {a} there, notes, pens, etc. in the hall.{gap}{b} left on 3. Oktober.{gap}They had ink, rope, etc.\n\nSee p. {i} again.{gap}We read it.", ["de", "DE", "de-x"][i % 3], 0))
    rows += [(1000, None, "de", 0), (1001, "", None, 0), (1002, "A. B", None, 0), (5, "One. Two.", "de", 0), (5, "One. Two.", "de", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, start_at long")
    m = learn(df)
    assert m.abbreviations["de"]["dr"] is False and m.abbreviations["de"]["etc"] is True and m.abbreviations["de"]["p"] is False
    assert m.collocations["de"] == {"oktober"}
    got = sentences(df, model=m, with_text=True).where("doc_id = 0").orderBy("start_at").collect()
    assert [r.sentence for r in got] == ["We saw Dr. Anna there, notes, pens, etc. in the hall.", "Boris left on 3. Oktober.", "They had ink, rope, etc.", "See p. 0 again.", "We read it."]
    out = sentences(df)
    assert out.columns == ["doc_id", "start_at", "end_at"] and out.where("doc_id in (1000, 1001)").count() == 0
    assert out.where("doc_id = 5 and start_at = 0").count() == 3
    assert sentences(df.limit(0)).count() == 0


def test_ratio_is_one_sided():
    assert associated(9, 10, 1, 100) > 7.88 and associated(1, 100, 9, 10) == 0 and associated(0, 0, 1, 2) == 0


def test_same_abbreviations_in_more_text():
    counts = {"etc": (4170, 4165, 379), "prof": (673, 672, 0), "incl": (582, 581, 0), "no": (887, 885, 0), "p": (1242, 1242, 0), "end": (900, 400, 90), "hall": (800, 500, 120)}

    def learned(times):
        none = dict.fromkeys("nqasbl", 0)
        rows = [{"lang": "en", "term": t, **none, "w": w * times, "p": p * times, "e": e * times} for t, (w, p, e) in counts.items()]
        return _model(rows, {"en": none | {"n": 1_000_000 * times, "q": 60_000 * times}}).abbreviations

    expected = {"etc": True, "prof": False, "incl": False, "no": False, "p": False}
    assert all(learned(times) == {"en": expected, "*": expected} for times in (1, 10, 100, 10_000))
