import random
import re
import unicodedata

import pytest

from quarry.llm import leakage as L

PROMPT = "The facility cost of Kerquiulm was halved 584 times until Linta opened exactly 296 centres. How large is the share of Penpenulm after step 584?"
ANSWER = "Only Quiulmdra remains idle while Rimrimzel handles 322 of 155 messages and Tivquisul takes over the final 365."
PART = "facility cost of Kerquiulm was halved 584 times until Linta opened exactly"  # 12 words


def screen():
    return L.Screen([(1, [PROMPT, ANSWER]), (2, ["too short to leak", None])], 12)


CASES = {
    "plain": f"Before {PART} after.",
    "case": PART.upper(),
    "quoted": "> " + PART.replace("halved ", "halved\n> "),
    "comment": "// " + PART.replace("until ", "until\r\n//  "),
    "bold": PART.replace("Linta", "**Linta**"),
    "tags": "<p>" + PART.replace("was", "<b>was</b>").replace("times", "ti<i>mes</i>") + "</p>",
    "entities": PART.replace(" ", "&nbsp;").replace("L", "&#76;"),
    "soft": PART.replace("exactly", "ex­act​ly"),
    "wide": "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PART),
    "commas": PART.replace(" ", ", "),
    "hyphen": PART.replace("facility", "faci-\nlity"),
    "long tag": PART.replace("Linta", '<a href="https://example.org/' + "x" * 1000 + '">Linta</a>'),
    "odd tag": PART.replace("Linta", "<a href=https://example.org/?a=b&c='" + "y" * 1000 + ">Linta</a>"),
    "long comment": PART.replace("was", "was <!-- " + "left out > here " * 100 + " -->"),
    "less than": "if a <b then " + PART + " and c> d",
    "escaped tags": PART.replace("Linta", "&lt;b&gt;Linta&lt;/b&gt;"),
    "escaped twice": PART.replace(" ", "&amp;nbsp;"),
    "link": PART.replace("Linta", "[Linta](https://example.org/a_(b)?q=1)"),
    "footnote": PART.replace("halved", "halved[12]"),
    "numbered": "\n".join(f"{k}: {w}" for k, w in enumerate(PART.split(), 118)),
    "joiner": PART.replace("Kerquiulm", "Ker\u200dqu\ufe0fiulm"),
    "long": "filler words here. " * 20000 + PART + " more." * 10,
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_forms(name):
    text = CASES[name]
    got = screen().search(text)
    assert [(i, f) for i, f, *_ in got] == [(1, 0)] and got[0][2] == 12
    _, _, _, a, b = got[0]
    found = L.squash(text[a:b])
    if name in ("link", "footnote", "numbered"):
        found = L.squash(text[a:b], True, True)
    assert found in L.squash(PROMPT) and len(found) >= len(L.squash(PART)) - 2


@pytest.mark.parametrize(
    "text",
    [
        PART.rsplit(" ", 1)[0],  # eleven words
        PART.replace("was halved", "was or so halved"),
        "x" + PART,  # the first word is another one
        PART + "ness",
        "exactly opened Linta until times 584 halved was Kerquiulm of cost facility",
        "",
        "   ",
    ],
)
def test_not_leaks(text):
    assert screen().search(text) == []


FRENCH = "L'élève dépêché près du café reçut à Noël un très bel arrêté signé par le maître d'hôtel"


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
@pytest.mark.parametrize("item_form", ["NFC", "NFD"])
def test_decomposed_letters(form, item_form):
    s = L.Screen([(1, [unicodedata.normalize(item_form, FRENCH)])], 12)
    text = "Avant. " + unicodedata.normalize(form, FRENCH) + " Après."
    (_, _, n, a, b), = s.search(text)
    assert unicodedata.normalize("NFC", text[a:b]) == FRENCH and n == len(L.words(FRENCH))
    assert L.squash(text) == L.Origin(text).letters


def test_hangul_and_marks_without_composed_form():
    for item in ("각 나라의 사람들이 모여서 함께 노래를 부르고 춤을 추며 밤을 새웠다 그리고 헤어졌다", " ".join(f"q\u0303x\u0301{k} w\u0308y" for k in range(8))):
        s = L.Screen([(1, [item])], 12)
        for form in ("NFC", "NFD"):
            assert len(s.search(unicodedata.normalize(form, item))) == 1


def test_folding_is_one_function():
    rng = random.Random(5)
    marks = ["é", "e\u0301", "ﬁ", "Ａ", "ǰ", "İ", "ß", "&eacute;", "<b>", "</b>", "<p class='x y'>", " ", "-", "a", "Z", "9", "ᄀ", "ᅡ", "ᆨ", "\u00ad", "&lt;", "&gt;", "<!-- a -->", "[1]", "\n12: "]
    for _ in range(400):
        text = "".join(rng.choice(marks) for _ in range(12))
        for loose, light in ((True, False), (True, True), (False, False)):
            assert L.squash(text, loose, light) == L.Origin(text, loose, light).letters, text


def test_whole_items_and_both_fields():
    got = {(f, n) for _, f, n, *_ in screen().search(f"{PROMPT} Solution. {ANSWER}")}
    assert got == {(0, len(re.findall(r"\w+", PROMPT))), (1, len(re.findall(r"\w+", ANSWER)))}


def test_frame(spark):
    docs = spark.createDataFrame([(1, PROMPT, "a"), (1, PROMPT, "a"), (2, None, "b"), (None, PROMPT, "c"), (3, "", "d"), (4, ANSWER.upper(), "e")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, PROMPT, ANSWER), (8, None, ANSWER), (None, PROMPT, None)], "item_id long, prompt string, answer string")
    got = {(r["doc_id"], r["item_id"], r["field"]) for r in L.leaked_passages(docs, items, "doc_id", "text", "item_id", ["prompt", "answer"]).collect()}
    assert got == {(1, 7, "prompt"), (4, 7, "answer"), (4, 8, "answer")}
    assert L.leaked_passages(docs, items.limit(0), "doc_id", "text", "item_id", ["prompt", "answer"]).count() == 0


def test_several_passes(spark):
    docs = spark.createDataFrame([(1, PROMPT + ANSWER)], "doc_id long, text string")
    items = spark.createDataFrame([(7, PROMPT), (8, ANSWER), (9, ANSWER)], "item_id long, prompt string")
    assert {r["item_id"] for r in L.leaked_passages(docs, items, "doc_id", "text", "item_id", ["prompt"], pass_letters=100).collect()} == {7, 8, 9}


def test_brute_force_agrees():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(9)]
    item = [rng.choice(vocab) for _ in range(40)]
    s = L.Screen([(1, [" ".join(item)])], 6)
    windows = {tuple(item[i : i + 6]) for i in range(35)}
    for _ in range(300):
        a = rng.randrange(34)
        doc = [rng.choice(vocab) for _ in range(rng.randrange(10))] + item[a : a + rng.randrange(3, 9)] + [rng.choice(vocab) for _ in range(10)]
        want = any(tuple(doc[i : i + 6]) in windows for i in range(len(doc) - 5))
        assert bool(s.search(" ".join(doc))) == want
