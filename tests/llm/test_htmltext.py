import re
import statistics
import time

import pytest

from archivist.llm import htmltext

TALK = "The first of many sentences, told at length, and with commas. Another one follows it, and it goes on"
SHORT = "I like it, thanks"


def _paragraphs(text, n=5):
    return "".join(f"<p>{text} {k}.</p>" for k in range(n)), " ".join(f"{text} {k}." for k in range(n))


@pytest.mark.parametrize("names", [("a", "b"), ("x1", "y2"), ("text", "more")])
def test_comments_without_telling_names_are_dropped(names):
    (article, want), (comments, _) = _paragraphs(TALK), _paragraphs(SHORT, 20)
    assert htmltext.main_text(f"<body><div class={names[0]}>{article}</div><div class={names[1]}>{comments}</div></body>") == want


def test_a_name_that_only_sounds_like_another_stays():
    article, want = _paragraphs(TALK, 2)
    page = f'<body><article>{article}<section id="subscription-models">{article}</section><div class="share-price related-work">{article}</div></article></body>'
    assert htmltext.main_text(page) == " ".join([want] * 3)


@pytest.mark.parametrize("name", ["ad", "comments", "cookie-notice", "sidebar", "newsletter box"])
def test_marked_elements_are_dropped(name):
    article, want = _paragraphs(TALK, 3)
    assert htmltext.main_text(f"<body><div>{article}<div class='{name}'><p>{SHORT}</p></div></div></body>") == want


def test_the_threshold_decides(monkeypatch):
    (article, want), (comments, more) = _paragraphs(TALK), _paragraphs(SHORT, 20)
    page = f"<body><div class=a>{article}</div><div class=b>{comments}</div></body>"
    monkeypatch.setattr(htmltext, "threshold", lambda smooth: 0.0)
    assert htmltext.main_text(page) == f"{want} {more}"
    monkeypatch.setattr(htmltext, "threshold", statistics.pstdev)
    assert htmltext.main_text(page) == want


def test_ratios_are_those_of_all_blocks_by_path():
    page = "<body><div class=a><p>One, two.</p><p>Three and four; five!</p></div><div class=a><p>Six</p></div><ul id=m1><li><a href=x>Link</a> y</li><li>z</li></ul><div class=ad>Buy, now!</div></body>"
    groups = {"p": ["One, two.", "Three and four; five!", "Six"], "li": ["Link y", "z"], "ad": ["Buy, now!"]}
    want = []
    for name, texts in groups.items():
        size, marks = [len(t) for t in texts], [len(re.findall(r"[.,;:!?]", t)) for t in texts]
        linked = 4 / 7 if name == "li" else 0
        want.append((statistics.mean(size) + statistics.pstdev(size)) * (1 + statistics.mean(marks) + statistics.pstdev(marks)) * (1 - linked) * (0.02 if name == "ad" else 1))
    assert sorted(htmltext.ratios(htmltext.blocks_of(page)).values()) == pytest.approx(sorted(want))


@pytest.mark.parametrize("page", ["<a" + ' x="1"' * 10_000, '<a b=">" ' * 10_000 + '"', "<div>" * 10_000 + "</section>" * 10_000 + "x", "<b>" * 10_000 + "<p>x</p>" * 10_000, "<" * 200_000, "<a '" * 30_000, "<!--" * 10_000, "<p " * 50_000])
def test_odd_pages_take_linear_time(page):
    start = time.time()
    htmltext.main_text(page)
    assert time.time() - start < 1


@pytest.mark.parametrize(("attributes", "text"), [(' title="5 > 3"', "x"), (" title='a <b> c'", "x"), (" data-x='", "x"), (' a="1"b="2"', "x"), (" a=1/", "x")])
def test_quotes_in_tags(attributes, text):
    assert htmltext.main_text(f"<p{attributes}>x</p>") == text


def test_empty_table_and_clashing_names(spark):
    kind = "page_id long, url string, html string, text string, n_chars string, x string"
    assert htmltext.html_text(spark.createDataFrame([], kind)).count() == 0
    found = htmltext.html_text(spark.createDataFrame([(1, "u", "<p>a b</p>", "t", "n", "x")] * 2, kind)).collect()
    assert [tuple(r) for r in found] == [(1, "u", "a b", 3)] * 2


@pytest.mark.parametrize(("reference", "text"), [("&#" + "9" * 5000 + ";", "�"), ("&#x" + "f" * 5000 + ";", "�"), ("&#" + "0" * 5000 + "65;", "A"), ("&#X" + "0" * 5000 + "41", "A"), ("&#000000038;lt;", "&lt;"), ("&#99999999", "�"), ("&#" + "0" * 9 + ";", "�")])
def test_long_character_references(reference, text):
    assert htmltext.main_text(f"<article><p>One {reference} two, three and four.</p></article>") == f"One {text} two, three and four."


def test_a_comment_beside_a_short_article_goes():
    article = "A short article, that says two or three things, and ends. " * 4
    page = f"<body><div><article><h1>Title</h1><p>{article}</p></article><div><p>Great, thanks for this, I read it twice, and will come again; bye.</p></div></div></body>"
    assert htmltext.main_text(page) == f"Title {article.strip()}"


def test_hidden_text_stays():
    """Nothing is dropped but what the list of what isn't the article names."""
    page = "<article><p>One sentence, and another.</p><p hidden>Two sentences, and more.</p><p style='display:none' aria-hidden=true>Three, and four.</p></article>"
    assert htmltext.main_text(page) == "One sentence, and another. Two sentences, and more. Three, and four."
