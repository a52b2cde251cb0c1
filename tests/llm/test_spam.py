import random

import pytest

from deponent.llm import spam
from deponent.llm.spam import Shape, dominating, drop_quoted, is_spam, shape_profile, shapes, spam_documents

WORDS = "kettle washer cable mixer hinge battery".split()
POST = "Has anyone here tested a loose pump without removing the spindle? We paid 16.21 for the shuttle, and nobody told us about the roof panel. I'd rather wait until somebody has soaked theirs."


def links(n, form="https://shop-{0}.example.com/p/{0}"):
    return [form.format(i) for i in range(n)]


SPAM = [
    "; ".join(random.Random(1).choice(WORDS) for _ in range(40)),
    "kettle " * 40,
    "buy kettle cheap kettle buy cheap " * 8,
    "\n".join(["Ventil Angebot billig", "VENTIL ANGEBOT BILLIG", "Ｖｅｎｔｉｌ Ａｎｇｅｂｏｔ ｂｉｌｌｉｇ", "V3ntil Ang3b0t billig"] * 4),
    " ".join(f"#{w}{s}" for w in WORDS for s in ("", "Sale", "Cheap")),
    "アンテナ購入; ケーブル購入; 敷金激安; " * 8,
    "купить клапан ★ КЛАПАН КУПИТЬ ★ " * 10,
    "\n".join(f"{w} top {u}" for w, u in zip(WORDS * 2, links(12))),
    " | ".join(links(9)),
    "\n".join(links(9, "hxxp://m[.]shop-{0}[.]example[.]org/p")),
    ", ".join(links(9, "shop-{0} dot example dot com")),
    "<br>".join(links(8, '<a href="http://x{0}.test/p">buy kettle</a>')),
    " | ".join(f"{w} ({i}), KV-{i}" for i, w in enumerate(WORDS * 3)),
    "k e t t l e ! Kettle ! k3ttle ! kettle ! KETTLE ! " * 6,
    POST.split(". We")[0] + "\n\n" + "best kettle - free washer - cheap cable - " * 10,
    "> quoted text here, which is not spam at all.\n" + "; ".join(WORDS * 6),
    "free shipping kettle Anna. free shipping kettle Berta. free shipping kettle Carla. free shipping kettle Dora. free shipping kettle Emil. free shipping kettle Fritz.",
]
SPAM += [
    "kettle • • (744) 40mm box KL-361 drain 178,99 used set tile 85,99 • meter sieve 12V radiator 16x9 hose XL mixer 2-pack (12) • • lamp 33,10 valve used adapter 40mm washer 99,00 cable 5m • hinge",
    " | ".join(f"[url=http://x{i}.test/p]buy kettle" for i in range(6)),
    "h3at3r p free HEATER s FREE heater n fr33 h FREE h3at3r e free heater t FREE heater r FREE free heater p h3at3r s free HEATER n FREE g heater",
    " ".join(WORDS * 2 + [f"{a}{b}" for a in WORDS for b in ("box", "cap", "set")]) + ". " + " ".join(f"{b} {a}" for a in WORDS for b in ("cheap", "discount", "online")),
]
HAM = [
    POST,
    POST.lower().replace(".", "").replace(",", "").replace("?", ""),
    POST.upper(),
    "Thanks!",
    "kettle",
    "\n".join(f"{s}. {u}" for s, u in zip(["It took me two hours to find the valve", "My sister never looked at the cable", "The clerk still owes us a new boiler", "We moved the lamp after the storm"], links(4))),
    POST + "\n\n#kettle #washer #cable",
    POST + "\n\n- 7 x kettle\n- 3 x cable\n- 2 x hinge\n- 1 x mixer\n\n" + POST,
    "[quote]" + "; ".join(WORDS * 9) + "[/quote]\nWhy does this rubbish keep coming back? Please remove it, it is the third copy today.",
    "<blockquote><cite>a</cite><blockquote>" + "kettle " * 50 + "</blockquote>x</blockquote>\nReported, this is the same junk as last week.",
    "On 1.2.2020, a wrote:\n> " + "kettle " * 50 + "\n> more\nWhy does this rubbish keep coming back? I have reported it again.",
    POST + "\n-- \n" + " | ".join(links(9)),
    "def settle(t, k):\n    for i in range(k):\n        t = t - 2 * (t - 10)\n    return t\n\n" + POST,
    "It fails like this, what can I do about it?\n[code]\n" + "11:07:15 INFO ctl[0] valve=0 temp=48.1 retry\n" * 20 + "[/code]",
    "11:07:15 INFO ctl[0] valve=0 temp=48.1 retry\n" * 20,
    "| kettle | noisy |\n|---|---|\n| 92 | 87 |\n| 67 | 72 |\n\n" + POST,
    "敷金を交換した方はいますか？写真を見せてもらえますか。昨日、地下室のポンプを掃除しましたが、まだ音がします。",
    "If you look for one of these, we have 4 in the shop and ship them within 30 days. Write to us, and we tell you the price. https://shop.example.com/p",
    "", "   ", None,
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert is_spam(text)


@pytest.mark.parametrize("text", HAM)
def test_ham(text):
    assert not is_spam(text)


@pytest.mark.parametrize("unit", [" ", "a", "a ", "a.", "<a>", "[", "[url]", "<pre ", "<blockquote ", "[quote ", "&gt;", ", ", ";\t", "www.", "#", "-", "    (", "http://", "A wrote:\n", "[code", "\n", "敷", "a-", "dot ", "a.b", "ab.cd.", "-- \n", "<a href=", "<a>x</a", "[url=x]", "[url]x[/url", "[a](", "(a){", "[size=1]", "\n[size=1]x", "11:07:15 a=1 ", "\t\t"])
def test_long_texts_take_linear_time(unit):
    import time

    began = time.process_time()
    is_spam("x" + unit * (400_000 // len(unit)) + "x")
    assert time.process_time() - began < 8


def test_own_words():
    text = "[QUOTE=a]x [quote]y[/quote][/QUOTE]own\r\n&gt; z\r\n\r\nA wrote:\r\n>> w\r\nwords\r\n__________\r\nme"
    assert drop_quoted(text).split() == ["own", "words"]
    assert drop_quoted("[quote]open\n\nown").split() == ["[quote]open", "own"]


def test_table(spark):
    data = [(1, SPAM[0]), (1, SPAM[0]), (2, POST), (3, None), (4, ""), (None, SPAM[0]), (5, "kettle " * 60_000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("text AS words", "doc_id", "text", "1 AS spam")
    assert sorted(r[0] for r in spam_documents(df).collect()) == [1, 5]
    assert spam_documents(df.limit(0)).count() == 0


CUT = "[code]\n11:42:03 ERROR ctl[4] valve=1 temp=32.5 retry\n00:09:59 INFO ctl[4]"
STUFFED = "BESTELLEN ANTENNE ! b e s t e l l e n A n t e n n e ! b3st3ll3n Ant3nn3 ! bestellen_Antenne ! " * 12


@pytest.mark.parametrize("code", [CUT, CUT.replace("[code]", "```"), CUT.replace("[code]", "<pre>"), CUT.replace("[code]", "<pre><code>")])
@pytest.mark.parametrize("form", ["[quote=a][quote]x[/quote]y\n{}[/quote]\n", "[quote author=a]\ny\n{}\n[/quote]\n", "<blockquote>y\n{} […]</blockquote>\n", "A wrote:\n> y\n> {}\n"])
def test_code_cut_in_a_quote_leaves_the_own_words(form, code):
    quote = form.format(code.replace("\n", "\n> ") if "> {" in form else code)
    assert is_spam(quote + STUFFED)
    assert not is_spam(quote + POST)
    assert drop_quoted(quote + POST).strip() == POST
    assert drop_quoted(quote + POST + "\n[code]x = 1[/code] ```y``` <pre>z</pre>").split() == POST.split()


@pytest.mark.parametrize(
    "text",
    [
        "own\n[code]\nx [quote] y\n\n<blockquote>\n[/code]\nwords",
        "[quote]look: [code]<blockquote>[/code] x[/quote]own words",
        "[code]\n>>> x[/code]\nown words",
        "own\n[quote]q\n\n[code]cut q[/quote]words",
        "> [quote]cut\nown words",
        "> [quote]a\nb[/quote]own [code]x[/code]words",
    ],
)
def test_blocks_end_where_they_should(text):
    assert drop_quoted(text).split() == ["own", "words"]


LIST = "\n".join(f"buy {w} {u}" for w, u in zip(WORDS * 2, links(12)))


@pytest.mark.parametrize(
    "form",
    [
        "---\n{}",
        "word\n---\n{}",
        "{}\n-- \nme",
        "[quote]\n{}",
        "<pre>\n{}",
        "<pre><code>{}",
        "```\n{}",
        "[code]\n\n{}",
        "[quote]a[/quote][quote]{}",
        "<blockquote class='" + "x" * 900 + "'>q</blockquote>{}",
    ],
)
def test_marks_that_close_nothing_hide_nothing(form):
    assert is_spam(form.format(LIST))


@pytest.mark.parametrize("line", ["    [buy {w}]({u})", "11:07:15 {w} {u}", "\t{w}(cheap) {u}", "for {w} {u};", "[{w}=1] {u}", "11:07:15 cheap {w}, best {w}"])
def test_lines_dressed_as_code_or_logs(line):
    assert is_spam("\n".join(line.format(w=w, u=u) for w, u in zip(WORDS * 2, links(12))))


def test_long_attributes_and_links_are_read_whole():
    long = "a" * 3000
    assert not is_spam(f"<blockquote data-x='{long}'>" + LIST + "</blockquote>\nWhy does this rubbish keep coming back? I have reported it again.")
    assert is_spam("\n".join(f'<a href="http://x.test/{long}{i}">buy kettle {long}</a>' for i in range(8)))
    assert spam.plain(f"[url=http://x.test/{long}]{long}[/url]").split() == [spam.LINK]


def test_a_signature_is_short_and_last():
    assert drop_quoted("own\n-- \nme\nyou").split() == ["own"]
    assert drop_quoted("-- \nme").split() == ["--", "me"]
    assert drop_quoted("own\n---\nwords\n---\nme").split() == ["own", "---", "words"]
    assert drop_quoted("own\n---\n" + "x\n" * 7).split()[1:3] == ["---", "x"]
    assert drop_quoted("own\n\n[size=1][i]me[/i][/size]").split() == ["own"]
    assert drop_quoted("[size=1]me[/size]").split() == ["[size=1]me[/size]"]


def test_sentence_shapes():
    assert Shape(5, True, True, "some", ".", 0).sentence and not Shape(1, True, True, "low", ".", 0).sentence
    assert Shape(5, True, True, "low", "line", 0).sentence and not Shape(5, True, True, "title", "line", 0).sentence  # capitals decide
    assert not Shape(5, True, True, "low", "|", 0).sentence and Shape(9, True, True, "low", "|", 0).sentence  # the separator does
    assert not Shape(16, False, True, "low", "line", 0).sentence and not Shape(16, True, False, "low", "line", 0).sentence  # word counts do
    assert is_spam("\n".join(f"Super {w.title()} Von {v.title()} Kaufen" for w in WORDS for v in WORDS[:2]))


def test_few_shapes_dominate():
    heavy, light = [4, 20], [4, 4]
    caps, kinds = ("low", "all", "title", "some", "none"), ("line", "-", "|")
    many = {Shape(1, True, True, c, k, 0): list(light) for c in caps for k in kinds}
    held, total = dominating(many)
    assert held == spam.FEW_SHAPES * 4 and total == 60 and not spam.flagged(many)
    few = {Shape(1, True, True, "low", "line", 0): heavy, Shape(5, True, True, "some", ".", 0): [1, 15]}
    assert dominating(few) == (20, 35) and spam.flagged(few)
    assert not spam.flagged({Shape(1, True, True, "low", "line", 0): [spam.LIST_PIECES - 1, 20]})


def test_repeated_sentences_are_sentences():
    again = "Could you post a picture of the pump, please? " * 3
    assert not is_spam(again) and is_spam("Pump cheap free shipping online now. " * 40)
    assert is_spam(" ".join(f"Buy your {w} online cheap now." for w in WORDS[:3] for _ in range(5)))
    assert is_spam("Valve! Quartz sample cheap free shipping! Heater! " * 5)


def test_profile_counts_shapes_over_all_posts(spark):
    texts = [t for t in SPAM + HAM] + SPAM[:2]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, words string").repartition(3)
    want = {}
    for t in texts:
        for s, (n, weight) in shapes(t).items():
            g = want.setdefault((*s, s.sentence), [0, 0, 0, 0])
            for i, x in enumerate((1, int(is_spam(t)), n, weight)):
                g[i] += x
    got = {tuple(r)[:7]: list(r)[7:] for r in shape_profile(df).collect()}
    assert got == want
    assert shape_profile(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["[quote]", "[code]", "[/quote]", "```", "<pre>", "[quote]```", "[quote]\n\n", "[code]\n\n", "> [code]\n", "[code]x[/quote][/code]", "<code><pre>"])
def test_long_texts_of_blocks_take_linear_time(unit):
    import time

    began = time.process_time()
    is_spam("x" + unit * (400_000 // len(unit)) + "x")
    assert time.process_time() - began < 8
