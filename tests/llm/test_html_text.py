import html
import re

from ledgerspark.llm.common import table
from ledgerspark.llm.html_text import main_text, parse
from ledgerspark.llm.queries import LLM_QUERIES


def article(page):
    """What stands between the article tags of the generated pages."""
    start = page.find("<article>")
    if start < 0:
        return ""
    inside = page[start + 9 :].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", inside))
    clean = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def test_query_against_the_article_tags(spark, small):
    pages = {r.page_id: r for r in table(spark, small, "pages").collect()}
    got = LLM_QUERIES["op5_html"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html or "") and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PARTS = {
    "nav": "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>",
    "header": "<header><h2>Site name</h2></header>",
    "cookie": '<div id="cookie-notice"><p>We use cookies, do you agree to that or not?</p></div>',
    "aside": "<aside><p>Read also this other long text that is not of the article.</p></aside>",
    "form": "<form action=/x><label>Mail</label><input name=q><button>Send</button></form>",
    "ad": '<div class="ad banner"><p>Buy now and save a lot of money on many things.</p></div>',
    "comments": '<section class="comments"><p>First! I do not agree with any of this, and here is why.</p></section>',
    "script": '<script>if (a < b) { document.write("<p>no</p>"); }</script><style>p > a { color: red }</style>',
    "footer": "<footer><p>&copy; 2020 Someone</p></footer>",
}
BODY = "<h1>The  title</h1><p>One &amp; two,\n three.<p>Four <b>five</b> <a href=/c>six</a>.<ul><li>seven</li><li>eight</li></ul>"
TEXT = "The title\nOne & two, three.\nFour five six.\nseven\neight"


def test_layouts():
    around = "".join(PARTS[k] for k in ("nav", "header", "cookie", "ad", "script"))
    after = "".join(PARTS[k] for k in ("aside", "form", "comments", "footer"))
    for tag in ("article", "main", 'div class="content"', "div"):
        name = tag.split()[0]
        assert main_text(f"<html><body>{around}<{tag}>{BODY}</{name}>{after}</body></html>") == TEXT, tag
    assert main_text(f"<html><body>{around}<article>{BODY}{PARTS['comments']}{PARTS['ad']}</article>{after}</body></html>") == TEXT
    assert main_text(f"<article><header><h1>The  title</h1></header>{BODY.split('</h1>')[1]}</article>") == TEXT


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<nav>x</nav>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<article><p>cut off &am") == "cut off &am"
    assert main_text("<article><p>cut <b>off</b> <a hr") == "cut off"
    assert main_text("</div></p><article></b><p>a</i>b</article>") == "ab"
    assert main_text("<article><p>x<!-- <p>y --> z</p></article>") == "x z"
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    assert main_text(deep) == "deep"
    assert main_text("<article>" + "<p>word word</p>" * 5000 + "</article>") == "\n".join(["word word"] * 5000)
    assert parse("<p>a<p>b").children[1].tag == "p"


def test_names_of_layout_do_not_take_the_article_away():
    around, after = PARTS["nav"] + PARTS["ad"] + PARTS["cookie"], PARTS["comments"] + PARTS["footer"]
    for name in ("content with-sidebar", "no-sidebar", "overflow-hidden", "has-banner", "page has-cookies", "sidebar-layout", "header-fixed content"):
        for inside in (BODY, f"<article>{BODY}</article>"):
            assert main_text(f'<html><body>{around}<div class="{name}">{inside}</div>{after}</body></html>') == TEXT, name
            assert main_text(f'<html><body><div id="{name}">{around}{inside}{after}</div></body></html>') == TEXT, name
    head, rest = BODY.split("</h1>")
    assert main_text(f'<body>{around}<article><div class="article-header">{head}</h1></div>{rest}</article>{after}</body>') == TEXT
    assert main_text(f'<div class="banner-wrap"><div class="header-wrap">{BODY}</div></div>') == TEXT
    long = '<div class="comments">' + "<p>I do not agree with any of this, and here is why.</p>" * 40 + "</div>"
    assert main_text(f"<html><body><div>{BODY}</div>{long}</body></html>") == TEXT
    assert main_text(f'<html><body><div class="sidebar-layout">{BODY}{long}</div></body></html>') == TEXT
    assert main_text('<div class="menu">' * 3000 + "<p>deep</p>" + "</div>" * 3000) == "deep"


def test_forms_field_sets_and_labels():
    around = "".join(PARTS[k] for k in ("nav", "header", "cookie", "ad", "form"))
    after = "".join(PARTS[k] for k in ("aside", "comments", "footer"))
    state = "<input type=hidden name=__STATE value=abc>"
    for inside in (BODY, f"<article>{BODY}</article>", f"<div>{BODY}</div>"):
        assert main_text(f"<html><body><form method=post action=/>{state}{around}{inside}{after}</form></body></html>") == TEXT, inside
        assert main_text(f"<html><body>{around}<fieldset><legend></legend>{inside}</fieldset>{after}</body></html>") == TEXT, inside
    assert main_text("<article><p>Press <label>Start</label> now.</p><p><label for=a>Name</label><input id=a></p></article>") == "Press Start now."
    assert main_text("<article><p>Text.</p><div><label>Mail <input></label></div><form><p>Comment</p><textarea></textarea></form></article>") == "Text."
    assert main_text("<article><fieldset><legend>Note</legend><p>Part of it.</p></fieldset><p>More.</p></article>") == "Note\nPart of it.\nMore."
    assert main_text("<body><form><p>Log in</p><input name=a><input name=b><button>Go</button></form></body>") == ""


def test_blocks_beside_the_container_of_the_paragraphs():
    part = "".join(f"<p>Paragraph {i} has a good many words in it, as they have.</p>" for i in range(4))
    text = "\n".join(f"Paragraph {i} has a good many words in it, as they have." for i in range(4))
    whole = f"Title\n{text}\nClosing words."
    notes = PARTS["footer"] + "<p>&copy; 2020 Someone</p><p><a href=/x>Terms of use and so on</a></p><h2>Read also</h2><ul><li><a href=/y>This</a></li></ul>"
    assert main_text(f"<body><h1>Title</h1><div>{part}</div><p>Closing words.</p></body>") == whole
    assert main_text(f"<body>{PARTS['nav']}<div><h1>Title</h1><div>{part}</div><p>Closing words.</p></div>{notes}</body>") == whole
    assert main_text(f"<body><header><h1>Title</h1></header><div>{part}<p>Closing words.</p></div>{notes}</body>") == whole
    assert main_text(f"<body><header><h1>Title</h1></header><article>{part}<p>Closing words.</p></article></body>") == whole
    for head in ("<header><h1>Site</h1><nav><a href=/>Home</a></nav></header>", "<header><h1><a href=/>Site</a></h1></header>", "<header><h1>Site</h1></header>"):
        assert main_text(f"<body>{head}<div><h2>Title</h2>{part}<p>Closing words.</p></div></body>") == whole, head
    assert main_text(f"<body><p>Outside.</p><article>{part}</article><p>Outside.</p></body>") == text
    assert main_text("<label>" * 50_000 + "text") == "text"
