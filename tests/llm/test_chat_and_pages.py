"""Conversations and web pages: exact round trips, folding rules, page shapes."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from flowtide.llm import chat_events, html_regions
from flowtide.llm.queries import op7_chat_formatting

TURNS = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["\\### Assistant: </turn> ok", "</turn>\n<turn>assistant<text>x", "&lt; &amp;lt; <", "", None, "\n", "漢字 🙂", "<text>", "a\\<b"]


def test_round_trip_of_any_text(spark):
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["user", "assistant", "sys<tem", None]), rng.choice(TRICKY)) for c in range(60) for t in range(c % 7)]
    df = spark.createDataFrame(turns, TURNS).withColumn("message_id", F.lit("clash")).withColumn("seq", F.lit("clash"))
    got = {r.conv_id: r for r in chat_events.read_back(chat_events.format_conversations(df)).collect()}
    for c in {t[0] for t in turns}:
        own = [(r or "", x or "") for k, _, r, x in turns if k == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert list(got[c].loss) == [x for r, x in own if r == "assistant"]


def test_odd_turn_tables(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 3, "assistant", "b"), (None, 1, None, None)]
    got = {r.conv_id: r for r in chat_events.read_back(chat_events.format_conversations(spark.createDataFrame(turns, TURNS))).collect()}
    assert [t.text for t in got[1].turns] == ["first", "a", "a"]
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("assistant", "b")]
    assert chat_events.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <é> " * 20) for k in range(900)]
    row = chat_events.read_back(chat_events.format_conversations(spark.createDataFrame(turns, TURNS))).first()
    assert "".join(row.loss) == "".join(t for _, _, r, t in turns if r == "assistant") and len(row.turns) == 900


def test_events_fold(spark):
    events = [
        (1, 1, 10, "delta", "user", "Hel"), (1, 2, 10, "delta", None, "lo"), (1, 2, 10, "delta", None, "lo"),
        (1, 3, 11, "delta", "assistant", "bad"), (1, 4, 11, "regenerate", "assistant", None), (1, 5, 11, "delta", None, "go"),
        (1, 6, 11, None, None, "od"), (1, 7, 12, "delta", "user", "typo"), (1, 8, 12, "edit", None, "fixed"), (1, 9, 12, "delta", None, "!"),
        (1, 10, 13, "delta", "user", "gone"), (1, 11, 13, "delete", None, None), (1, 12, 14, "regenerate", "assistant", None),
        (1, 13, 15, "delete", None, None), (1, 14, 15, "delta", "user", "back"),
    ]
    df = spark.createDataFrame(events, "conv_id int, seq int, message_id int, kind string, role string, text string")
    got = chat_events.read_back(chat_events.render(chat_events.fold_events(df.orderBy(F.rand(3))))).first()
    assert [(t.role, t.text) for t in got.turns] == [
        ("user", "Hello"), ("assistant", "good"), ("user", "fixed!"), ("assistant", ""), ("user", "back")]


def test_query_digests(spark):
    folder = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    turns += [(-7, k, r, TRICKY[0]) for k, r in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in op7_chat_formatting(spark, folder).collect()}
    assert set(got) == {t[0] for t in turns}
    for c, r in got.items():
        own = [(x[2], x[3] or "") for x in turns if x[0] == c]
        loss = "".join(x for role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), brute.sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))


ARTICLE = "<article><h1>Title &amp; more</h1><p>First  paragraph\n of the text, long enough.<p>Short.</p><p><b>Bold<br>line.</article>"
WANT = "Title & more\n\nFirst paragraph of the text, long enough.\n\nShort.\n\nBold line."
PARTS = ("<nav><ul><li><a href=/>Home</a></ul></nav>", "<header>Site name</header>", "<div class='ad box'>Buy now, it is cheap</div>",
         "<aside><p>Side bar text that is long as well</p></aside>", "<div id=cookie-notice><p>We use cookies</p></div>",
         "<form><label>Mail</label><input><button>Send</button></form>", "<section class=comments><article class='comment'><p>Nice one, "
         "I like this article very much indeed</p></article></section>", "<footer>&copy; 2020</footer>",
         "<script>var t='</p>'; if (a<b) {}</script>", "<style>p{}</style>", "<!-- <p>no</p> -->")


def test_marked_article_among_other_parts():
    rng = random.Random(1)
    for _ in range(200):
        parts = [ARTICLE, *rng.sample(PARTS, rng.randint(0, len(PARTS)))]
        rng.shuffle(parts)
        assert html_regions.main_text("<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(parts)) == WANT, parts


LONG = "A sentence of the article that says something worth to keep. " * 7
CARD = "<article><h3><a href=/x>Teaser</a></h3><p>Read on</p></article>"
PLAIN = "\n\n".join(["Title", *[LONG.strip()] * 4, "Short."])
TEXT = "<h1>Title</h1>" + f"<p>{LONG}</p>" * 4 + "<p>Short.</p>"
LIST = "<ul>" + "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(12)) + "</ul>"


def test_region_is_never_one_paragraph():
    page = f"<html><body><div><h1>Title</h1><p>{'x' * 450}</p><p>{'y' * 50}</p></div></body></html>"
    assert html_regions.main_text(page) == f"Title\n\n{'x' * 450}\n\n{'y' * 50}"


def test_sibling_sections_stay():
    page = f"<body><div><section><h2>One</h2><p>{LONG * 2}</p><p>{LONG * 2}</p></section><section><h2>Two</h2><p>{LONG}</p></section></div></body>"
    long = (LONG * 2).strip()
    assert html_regions.main_text(page) == "\n\n".join(["One", long, long, "Two", LONG.strip()])


@pytest.mark.parametrize("label", ["post comments-open", "has-sidebar", "menu"])
def test_an_aside_word_never_hides_the_article(label):
    assert html_regions.main_text(f"<body><article class='{label}'>{TEXT}</article></body>") == PLAIN
    assert html_regions.main_text(f"<body><div class='{label}'><article>{TEXT}</article></div></body>") == PLAIN
    assert html_regions.main_text(f"<body><form><main>{TEXT}</main></form></body>") == PLAIN


def test_text_beside_a_teaser_card():
    assert html_regions.main_text(f"<body><div class=text>{TEXT}</div>{CARD}</body>") == PLAIN
    assert html_regions.main_text(f"<body>{CARD}<div class=text>{TEXT}</div></body>") == PLAIN


def test_cards_and_link_lists_in_main_go():
    for page in (f"<main><article>{TEXT}</article>{CARD * 3}</main>", f"<main>{TEXT}{LIST}</main>", f"<main>{LIST}<div>{TEXT}</div>{CARD * 2}</main>",
                 f"<main>{CARD}<article>{TEXT}</article>{LIST}</main>"):
        assert html_regions.main_text(f"<body>{page}</body>") == PLAIN


def test_several_articles_with_text_stay():
    assert html_regions.main_text(f"<body><main><article>{TEXT}</article><article>{TEXT}</article>{LIST}</main></body>") == f"{PLAIN}\n\n{PLAIN}"
    kept = html_regions.main_text(f"<body><article>{TEXT}{LIST}</article></body>")
    assert kept.startswith(PLAIN) and "entry 11" in kept


def test_parts_inside_the_article_go_too():
    inner = ARTICLE.replace("<p>Short.</p>", PARTS[2] + PARTS[5] + "<p>Short.</p>" + PARTS[1].replace("header", "footer"))
    assert html_regions.main_text(f"<body>{inner}</body>") == WANT


def test_page_without_article():
    body = "".join(f"<p>Paragraph {i} " + "with plenty of words to read in it " * 6 + "</p>" for i in range(8)) + "<p>Last one, short.</p>"
    links = "<div class=links>" + "".join(f"<a href=/{i}>link {i}</a><br>" for i in range(30)) + "</div>"
    for page in (links + f"<div class=text>{body}</div>" + links, f"<div>{body}</div>{links}"):
        text = html_regions.main_text(f"<html><body>{page}</body></html>")
        assert len(text.split("\n\n")) == 9 and text.endswith("Last one, short.") and "link 3" not in text


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   ", ""), ("<article></article>", ""), ("plain words only", "plain words only"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut off</p", "cut off"), ("<article><p>a < b and c</p></article>", "a < b and c"),
    ("<article><p>x&lt;y&#33;&#x21;&nbsp;z</p></article>", "x<y!! z"), ("<nav>only a menu</nav>", ""), ("<article><p>one<p>one</article>", "one\n\none"),
])
def test_small_pages(html, want):
    assert html_regions.main_text(html) == want


def test_pages_table(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (2, "v", "<p>" + "long text " * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))
    got = html_regions.extract_pages(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got][:3] == [(1, WANT, len(WANT))] * 2 + [(None, "", 0)]
    assert got[3].n_chars == 999_999
    assert html_regions.extract_pages(df.limit(0)).count() == 0


def test_ratio_steps():
    flat = html_regions.smooth([4.0] * 9)
    assert all(abs(v - 4) < 1e-9 for v in flat)
    assert 1 < html_regions.threshold([1, 1, 1, 9, 9]) < 9 and html_regions.threshold([3.0]) == 3.0
