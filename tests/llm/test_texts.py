"""Personal data, pages, the quality model and chats."""

import hashlib
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import DATA
from tallyframe.llm import chat, html_text, pii, quality_model
from tallyframe.llm.queries import QUERIES
from llm.conftest import got


def plain_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
        if 14 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_personal_data(spark, cases):
    frame, rows = cases
    more = [(60 + k, f"write to account{k}@mail{k}.example.org é 4539 5787 6362 148{k}") for k in range(10)]
    more += [(80, "please write to agent-77x41 now"), (81, "nothing near agent-77x41 here")]
    frame = frame.select("doc_id", "text", "words").unionByName(spark.createDataFrame([(*r, "") for r in more], "doc_id bigint, text string, words string"))
    found = {(r["doc_id"], r["base_sha256"]): r for r in pii.personal_data(frame).collect()}
    for i, t in rows + more:
        base = plain_base(t)
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = found[(i, hashlib.sha256(listed.encode()).hexdigest())]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert {x for x in listed.split(",") if x} <= set(r["spans"].split(","))
    assert [r["spans"] for (i, _), r in found.items() if i == 80] == ["id:16:27"]
    assert [r["spans"] for (i, _), r in found.items() if i == 81] == [""]
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(frame).collect()}
    assert hidden[80] == "please write to [id] now" and hidden[60].startswith("write to [email] é ") and hidden[3] is None


def test_long_digit_runs_and_any_column_names(spark):
    long = "9" * 5000
    text = f"{long}.1.1.1 and {'0' * 5000}7.1.1.1 and 10.0.0.1"
    assert pii.base_spans(text) == [(1, 5011, 10018), (1, 10023, 10031)]
    names = ["spans", "met", "found", "copy_", "copy", "row", "row_number_", "added", "a.b", "kind"]
    frame = spark.createDataFrame(
        [(1, text, *names, 0), (2, None, *names, 3), (1, "at 10.0.0.1", *names, 0)],
        "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names) + ", n_chars int",
    )
    masked = pii.masked(frame)
    assert masked.columns == frame.columns
    first = f"{long}.1.1.1 and [ip] and [ip]"
    want = [(1, first, *names, len(first)), (2, None, *names, 3), (1, "at [ip]", *names, 7)]
    assert got(masked) == sorted(want, key=repr)
    assert [r["n_ip"] for r in pii.personal_data(frame).orderBy("n_ip").collect()] == [0, 1, 2]


def test_personal_data_of_nothing(nothing):
    assert pii.personal_data(nothing).count() == 0 and pii.masked(nothing).columns == nothing.columns


PAGE = """<html><head><title>t</title><script>if (a<b) document.write("<p>x</p>")</script></head><body class="with-sidebar">
<header><p>Head</p></header><nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies</div>
<article><h1>Ti&amp;tle&nbsp;one</h1><p>First <b>bold</b>,<br>next <i>it
 em</i>.<p>Second &lt;p&gt; has text enough to count here.<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>
<aside>aside</aside><form><input value="x"><button>Go</button></form><!-- <p>no</p> -->
<div class="ad">Buy</div><section class="comments"><p>I disagree at some length, as readers do.</p></section></article>
<footer>&copy; foot</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "Ti&tle one", "First bold, next it em.", "Second <p> has text enough to count here.", "one", "two", "a", "b",
    ]
    div = "<div><a href=a>x</a> <a href=b>y</a></div><div class=x><div>" + "".join(f"<p>Sentence {i} with words in it.</p>" for i in range(9)) + "</div></div>"
    assert html_text.main_text(div).count("Sentence") == 9 and "x" not in html_text.main_text(div).split("\n\n")


@pytest.mark.parametrize("mark", [
    'style="overflow:hidden"', 'title="the hidden valley"', 'data-role="navigation"', "data-id=sidebar", 'class="layout has-sidebar"',
    'class="no-sidebar"', "class='with-comments'", 'id="content-side"', 'class="page-with-sidebar wide"', 'class="sidebar"', "hidden",
])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_around_the_article_stay(mark, inner):
    if inner == "div" and mark in ('class="sidebar"', "hidden"):
        pytest.skip("cut where no article is inside")
    text = [f"Sentence {i} of the article, with words enough." for i in range(6)]
    page = f"<body><div {mark}><{inner}>{''.join(f'<p>{t}</p>' for t in text)}</{inner}></div></body>"
    assert html_text.main_text(page).split("\n\n") == text


def long_p(i):
    return f"{i} {'Words of this part of the article, in one piece. ' * 6}".strip()


def test_parts_beside_the_densest_element():
    """Pages without article or main: a split container, a heading and a lead
    outside it, a short paragraph between, loose text; lists of links go."""
    half = lambda a, b: "<div>" + "".join(f"<p>{long_p(i)}</p>" for i in range(a, b)) + "</div>"
    want = [long_p(i) for i in range(10)]
    assert html_text.main_text(f"<body><div>{half(0, 5)}{half(5, 10)}</div></body>").split("\n\n") == want
    links = "<ul>" + "".join(f"<li><a href=/{i}>Place {i}</a></li>" for i in range(12)) + "</ul>"
    page = f"<body>{links}<h1>The heading</h1><div><p>{long_p('lead')}</p>{half(0, 5)}<p>Short.</p>{links}{half(5, 10)}</div>{long_p('loose')}{links}</body>"
    found = html_text.main_text(page).split("\n\n")
    assert found == ["The heading", long_p("lead"), *want[:5], "Short.", *want[5:], long_p("loose")]


@pytest.mark.parametrize("mark", ["hidden", 'HIDDEN=""', "aria-hidden=true", 'role="navigation"', 'class="left-sidebar"', 'id="ad-slot"', 'class="x comments"', 'class="widget-2"', 'class="side"'])
def test_marked_elements_are_cut(mark):
    page = f"<body><div><p>{'Some words of text. ' * 9}</p><div {mark}><p>{'Cut these words. ' * 9}</p><article class=comment><p>No.</p></article></div></div></body>"
    assert html_text.main_text(page).split("\n\n") == [("Some words of text. " * 9).strip()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("<>/ap\"'=!-& ;\n") + ["<p>", "</div>", "<div", "<!--", "<script>", "<table><tr><td>"]), max_size=40).map("".join))
def test_any_markup_is_read(page):
    html_text.main_text(page)


def test_pages(spark, cases):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 3000 + "deep"), (4, "x", "<p>" + "long " * 50_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    want = [(p, u, html_text.main_text(h), len(html_text.main_text(h))) for p, u, h in rows]
    assert got(html_text.extracted(frame)) == sorted(want, key=repr)
    assert want[4][2] == "deep" and want[5][3] == 249_999 and html_text.extracted(frame.where("false")).count() == 0


def test_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()
    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        shown = re.sub(r"<[^>]*>", " ", inner)
        assert re.sub(r"\s+", "", __import__("html").unescape(shown)) == re.sub(r"\s+", "", html_text.main_text(r["html"]))


def test_quality_model_on_held_out_rows(spark, cases):
    folder = f"{DATA}/sf0.01"
    found = QUERIES["op8_ftrl_quality_model"](spark, folder).collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [(r["predicted"], quality[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in quality]
    right = sum(a == b for a, b in held) / len(held)
    assert len(held) > 50 and right > 0.9, right
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_quality_model_cases(spark, cases, nothing):
    frame, rows = cases
    labels = spark.createDataFrame([(1, 1), (1, 0), (16, 1), (None, 1), (11, None), (12, 0)], "doc_id bigint, quality int")
    found = quality_model.quality_scores(frame, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    none = quality_model.quality_scores(frame, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_model.quality_scores(nothing, labels).count() == 0


SAID = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "|", "a", " ", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(SAID, SAID), max_size=4))
def test_chat_round_trip(turns):
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def test_chat_refuses_what_is_no_chat():
    for wrong in ("x", "<|turn|>user", "<|turn|>a\n<|says|>b<|end|>", "<|end|>"):
        with pytest.raises(ValueError):
            chat.parse(wrong)


def test_chat_rows(spark, cases):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s> [INST]"), (1, None, None, None), (None, 0, "assistant", "é"), (None, 0, "assistant", "é"), (2, 0, "assistant", "\\<|end|>")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k} <|turn|>") for k in range(400)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, loss string").repartition(3)
    want = []
    for conv in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        size = sum(len(chat.render(r or "", t or "")) for _, _, r, t in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((conv, len(own), sha(told), len(loss), sha(loss), size))
    formatted = chat.formatted_turns(frame)
    assert got(chat.read_back(formatted)) == sorted(want, key=repr)
    assert chat.read_back(chat.formatted_turns(frame.where("false"))).count() == 0


def test_chat_ties_follow_the_text_and_not_its_escaped_form(spark):
    texts = ["A", "</s>x", "\\</s>x", "A\t", "A\n", "", None, "[INST]", "\\\\[INST]", "Z", "é", "A"]
    frame = spark.createDataFrame([(1, 0, "user", x) for x in texts], "conv_id bigint, turn bigint, role string, text string")
    told = "".join(f"user\n{x}\n" for x in sorted(x or "" for x in texts))
    row = chat.read_back(chat.formatted_turns(frame.repartition(3))).collect()[0]
    assert row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and row["n_turns"] == len(texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@", ".", "_", "-", "1", "22", "1.2.3.4", "+1", " ", "é", "(", "%"]), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [(s, k, e) for k, s, e in pii.base_spans(text)] == plain_base(text)


@pytest.mark.parametrize("text", [
    "x" * 1_000_000, "汉" * 1_000_000, "7" * 1_000_000, "1." * 500_000, "a." * 500_000, "a@" * 500_000, "a@b." * 250_000, "+1(" * 330_000,
    "+1" + "(" * 1_000_000, "a1," * 330_000, "1 " * 500_000, "9-" * 500_000, "q" * 999_990 + "@a.example",
])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    spans = pii.base_spans(text)
    near = list(pii.identifiers(text, spans, 6))
    words = pii.Words(text)
    for s, e, _ in near[:20_000]:
        words.contexts(s, e)
    assert time.process_time() - began < 4


def test_context_words_are_whole():
    text = "a" * 30 + " my number " + "b" * 81 + " is " + " " * 200 + "x1234567  ok"
    words, at = pii.Words(text), text.index("x1234567")
    assert words.contexts(at, at + 8) == ["1 is", "3 is | ok"]  # the word before "is" is too long, none is cut
    at = text.index("number")
    assert words.contexts(at, at + 6) == ["1 my", "2 " + "a" * 30 + " my"]
    assert pii.Words("to:x1").contexts(3, 5) == ["1 to:"] and pii.Words("x1 y").contexts(0, 2) == []
