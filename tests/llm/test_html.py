import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from ledgerlake.llm import html_text
from ledgerlake.llm.html_text import extract_pages, main_text

WITHIN = re.compile(r"<article\b[^>]*>(.*)</article>", re.S | re.I)

BODY = "<h1>Big &amp; small</h1><p>First   para, with <b>bo</b>ld &lt;text&gt;.</p>\n<p>Second one,&nbsp;a bit longer; it ends.<ul><li>item one<li>item two</ul><p><b>Open tag.<br><p>Last."
WANT = "Big & small First para, with bold <text>. Second one, a bit longer; it ends. item one item two Open tag. Last."


@pytest.mark.parametrize("page", [
    f'<!DOCTYPE html><html><head><title>T, t. t.</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Menu, one.</a></ul></nav><!-- x > y --><div class="ad">Buy now, it is cheap. Really, do.</div><article>{BODY}</article><footer>&copy; a, b. c.</footer></body></html>',
    f'<body class="has-sidebar"><header><h1>Site, name.</h1></header><main><section>{BODY}</section><section class="comments"><p>A comment, quite long, with many words. And more, and more.</p></section></main><aside><p>Side, notes. Are here, too.</p></aside></body>',
    f'<body><div id="wrap"><div class="post-body">{BODY}</div><div id="sidebar"><p>Side, notes.</p></div><form><p>Name, please. Mail, too.</p><input></form></div><script>var a = "</p><p>no, no.";</script></body>',
    f'<BODY><DIV class="cookieNotice"><p>We use cookies, sorry. Accept, please.</p></DIV><ARTICLE>{BODY}<div class="share">Share, now.</div></ARTICLE><article class="comment">I liked it, a lot. Thanks, much.</article>',
    f'<body><ul class="commentlist"><li>Ha, ha. Very, very good. Thanks, all.</ul><div class="entry-header"><p hidden>No, never.</p></div>{BODY}<div style="display: none">Hidden, text.</div></body>',
    f'<body><div class="c">{BODY.split("<ul>")[0]}<section><ul>{BODY.split("<ul>")[1]}</section></div><div class="x"><a href="/">One, link.</a> <a href="/b">Two.</a></div></body>',
])
def test_article_alone(page):
    assert main_text(page) == WANT


@pytest.mark.parametrize("page", [
    f"<body><div class='content has-sidebar'>{BODY}</div><div class='sidebar'><p>Side, notes.</p></div></body>",
    f"<body><div class='no-sidebar'>{BODY}</div></body>",
    f"<body><div class='post comments-open'><article>{BODY}</article></div><div class='comments'><p>Ha, ha.</p></div></body>",
    f"<body><div class='search'>{BODY}</div></body>",
    f"<article data-title='A hidden cost of war'>{BODY}</article>", f"<article title='the hidden truth'>{BODY}</article>",
    f"<html><head><title>T</title><meta charset=utf-8><article>{BODY}</article>", f"<article><button>{BODY}</article>",
])
def test_names_on_a_wrapper_keep_the_article(page):
    assert main_text(page) == WANT


def plain_page(rng, paragraphs):
    """A page without article elements and without telling names, and its main text."""
    words = "harbour morning letter window garden river quiet answer bridge table winter market story paper".split()

    def sentence(n):
        return " ".join(rng.choices(words, k=n)).capitalize() + rng.choice([", and so on.", ".", "; it was.", "!"])

    def links(n):
        return "".join(f'<li><a href="/{i}">{" ".join(rng.choices(words, k=2))}</a></li>' for i in range(n))

    text = [" ".join(sentence(rng.randint(8, 16)) for _ in range(rng.randint(2, 4))) for _ in range(paragraphs)]
    bits = "".join(f"<div><span>{w}</span></div>" for w in rng.choices(words, k=12))
    body = "".join(f"<p>{t}</p>" for t in text)
    return f"<body><div><ul>{links(9)}</ul></div><div><div>{body}</div></div><div>{bits}</div><div><ul>{links(6)}</ul></div></body>", " ".join(text)


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    same = sum((a & b).values())
    return 2 * same / max(sum(a.values()) + sum(b.values()), 1)


def test_ratios_decide_where_no_name_does(monkeypatch):
    rng = random.Random(4)
    pages = [plain_page(rng, rng.randint(2, 7)) for _ in range(60)]
    assert all(main_text(page) == want for page, want in pages)
    monkeypatch.setattr(html_text, "_ratio", lambda path: 1.0)
    assert sum(main_text(page) == want for page, want in pages) == 0


def test_ratios_decide_on_pages(monkeypatch):
    """Main text against the pages' own article element, with and without the ratios, and with article elements renamed."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    want = [WITHIN.search(h) for h in pages]
    known = [(h, m) for h, m in zip(pages, want, strict=True) if m]
    assert len(known) > 50
    scores = [f1(main_text(h), main_text("<article>" + m[1] + "</article>")) for h, m in known]
    assert sum(scores) / len(scores) > 0.97
    bare = [re.sub(r"(</?)(?:article|main)\b", r"\1div", h) for h, _ in known]
    scores = [f1(main_text(h), main_text("<article>" + m[1] + "</article>")) for h, (_, m) in zip(bare, known, strict=True)]
    assert sum(scores) / len(scores) > 0.9


def test_odd_pages():
    assert main_text("") == "" and main_text("<nav>menu</nav>") == "" and main_text("<p") == ""
    assert main_text("just text") == "just text" and main_text("<p>a<!-- unclosed") == "a"
    assert main_text('<article><p title="a > b">x<script>"</p>"</script>y</p></article>') == "xy"
    assert main_text("<article><p>" + "long words, and more. " * 50_000).count("words") == 50_000


def test_frame(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "old"), (2, None, None, "x"), (3, "v", "", "y"), (1, "u", f"<article>{BODY}</article>", "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_pages(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, WANT, len(WANT))] * 2 + [(2, "", 0), (3, "", 0)]
    assert extract_pages(pages.limit(0)).count() == 0
