import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinspar.llm.sentences import sentences, split_sentences

CASES = [
    ["Mr. Tolvane kept it in a.so.6, Dr. Ormsk moved it.", "See Fig. 3 and Sec. 4.2 for it.", "We tried adc, nop, etc.", "The job starts at 6 a.m.", "It fails at 4 a.m. on the host, i.e. early."],
    ["The retry counter of J. R. Brask et al. is shared.", "The value is 31.5.", "parse_it returns early.", "Use e.g. read_it, not vs. it.", "The U.S. mirror holds it."],
    ['He asked: "Is 0x79 a list?"', "The sample came from X Inc. and was pinned.", 'Did he ask "Which?" or "Why?" that day?', '"It is hot. Leave it," said the comment.', 'The tool printed "Done!" after 10.7 s.'],
    ["(The parser is padded in both builds.)", "The callback (see the note on b.o. It is short.) stays.", "What remains is a match... and a loop.", "It never runs...", "Why on earth?!", "Fine."],
    ["Das ist der 2. Lauf mit Version 0.1.7.", "Am 3. Mai wurde x.c neu übersetzt.", "Vgl. dazu Nr. 7 der Liste, d. h. den Stand.", "„Der Wert ist falsch. Bitte prüfen!“, stand im Protokoll.", "Der Prüfer schrieb: „Das ist tot.“", "Prof. Gellwig ging."],
    ["M. Vaudrel a noté : « Ce code est mort. »", "Cette boucle ne se termine jamais !", "On compare p. ex. wim.o et bren.c.", "« Rien. Tout va bien », dit le journal.", "Il appelle x deux fois, cf. p. 693 du rapport."],
    ["El Sr. Almorel anotó: «Está muerto.»", "¡El bucle no termina nunca!", "¿Por qué no cambia?", "Véase la pág. 3 y la fig. 2.", 'El aviso decía "Falta. Repita." y nada más.'],
    ["На рис. 7 показан переход, т. е. к началу.", "«Всё в порядке. Ошибок нет», — сообщил сервер.", "См. стр. 2 и табл. 4.", "Код мёртв."],
    ["Γιατί δεν αλλάζει ο καταχωρητής στο 0x4b60;", "Ο βρόχος δεν τελειώνει ποτέ!", "Δύο τμήματα, π.χ. το α και το β."],
    ["यह लूप कभी समाप्त नहीं होता!", 'लॉग में लिखा था, "सब ठीक है। आगे बढ़ें।" और कुछ नहीं।', "डॉ. वेलमार ने कहा।"],
    ['كتب المراجع: "هذا الرمز ميت."', "هذه الحلقة لا تنتهي أبدا!", "لماذا لا يتغير السجل عند 0x1؟", "بلا رموز، يصعب العثور؛ لذا تنخفض الدرجة."],
    ["ไม่พบสัญลักษณ์ในไฟล์นี้", "กราฟนี้มีเส้นเชื่อมหลายเส้น"],
]
UNSPACED = [
    ["审阅者写道：“这段代码已经失效。请删除。”", "“结果正确。”日志里这样写。", "阈值为20.8，召回率上升……但精度下降。", "为什么没有变化？"],
    ["「このコードは使われていない。」という注釈が残る。", "記録には「異常なし。続行する。」と書かれていた。", "このループは終わらない！", "サイズは37.19MBである。"],
]


def pieces(t):
    return [t[a:b] for a, b in split_sentences(t)]


@pytest.mark.parametrize("want", CASES, ids=range(len(CASES)))
def test_languages(want):
    assert pieces(" ".join(want)) == want
    wrapped = " ".join(want).replace(" ", "\n")
    assert [p.replace("\n", " ") for p in pieces(wrapped)] == want


@pytest.mark.parametrize("want", UNSPACED, ids=["zh", "ja"])
def test_scripts_without_spaces(want):
    assert pieces("".join(want)) == want


def test_layout():
    t = "Title 1.2\r\n\r\n1. One. thing\r\n2. Two\r\n\r\n    28ee84: mul r12, 0x62a\r\n    28ee88: jmp rax\r\n\r\n// A b\r\n// c. D e\r\n// f.\r\n\r\n * Gg hh.\r\n * Ii jj.\r\n\r\n* item a\r\n* item b.\r\n\r\n> Q.\r\n\r\nruns.The end  "
    assert pieces(t) == ["Title 1.2", "1. One. thing", "2. Two", "28ee84: mul r12, 0x62a", "28ee88: jmp rax", "A b\r\n// c.", "D e\r\n// f.", "Gg hh.", "Ii jj.", "* item a", "* item b.", "Q.", "runs.", "The end"]
    assert pieces("M. Vaudrel x.\n\nJ. R. Brask y.") == ["M. Vaudrel x.", "J. R. Brask y."]
    assert pieces("Das ist der\n2. Lauf mit x.") == ["Das ist der\n2. Lauf mit x."]


def test_empty_and_odd(spark):
    for t in (None, "", " \n\t\n", "​" * 0, "//\n>\n"):
        assert split_sentences(t) == []
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "A b. C d.", 5), (4, "A b. C d.", 5), (5, "x" * 1_000_000, 5)], "doc_id bigint, text string, start_char int")
    got = [tuple(r) for r in sentences(df, "doc_id", "text").collect()]
    assert sorted(got) == [(3, 0, 4), (3, 5, 9), (4, 0, 4), (4, 5, 9), (5, 0, 1_000_000)]
    assert sentences(df.limit(0), "doc_id", "text").count() == 0
    assert [r["sentence"] for r in sentences(df.where("doc_id = 3"), "doc_id", "text", True).collect()] == ["A b.", "C d."]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB. \n!?\"“”«»()。…;>*-1#/\t'&ไα中"), max_size=80))
def test_spans_are_in_order_and_cover_all_text(t):
    at = 0
    for a, b in split_sentences(t):
        assert at <= a < b <= len(t) and not t[a].isspace() and not t[b - 1].isspace()
        assert not any(c.isalnum() for c in t[at:a])
        at = b
    assert not any(c.isalnum() for c in t[at:])


def test_best_sequence_against_all_starts(spark, sf):
    """The search that leaves starts out finds what a search over all starts at every node finds, and more than a threshold on nodes does."""
    from twinspar.llm import sentences as S
    from twinspar.session import table

    r = random.Random(3)
    parts = ["He said", "no.", "No. 5", "e.g. this", '"What?"', "she asked.", "(It is.", "Really!)", "A.", "3.", "...", "«Да.»", "「はい。」", "と言った。", "x", "!", "?", "J. R. Smith", "Dr. No", "ends;", ".", "4.5"]
    texts = [" ".join(r.choices(parts, k=r.randint(1, 25))) for _ in range(1500)]
    texts += [line for x in table(spark, sf, "documents").collect() for line in (x["text"] or "").split("\n") if line.strip()]
    other = 0
    for t in (x.strip() for x in texts):
        nodes = S._nodes(t)
        total, spans = S._best(t, nodes)
        full, wide = S._best(t, nodes, every=True)
        assert abs(total - full) < 1e-9 and (spans == wide or abs(total - full) < 1e-9)
        other += [b for _, b in spans] != [n[0] for n in nodes if n[2] > 0]
    assert other > 100
