import html
import re

import pyarrow.parquet as pq

from photonframe.llm import html_main as hm

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{color:red}</style></head><body>
<header class="site-header"><a href="/">Brand</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies to improve the service for all of our readers.</div>
<main><article><h1>A title &amp; more</h1><p>First   paragraph with <b>bold</b> text&nbsp;and a <a href="/x">link</a>.<p>Second one,
unclosed.<ul><li>item one<li>item two</ul><div class="ad">Buy this thing now for a very small price.</div>
<aside>See also another story that we like.</aside><form><label>Mail</label><input><button>Send</button></form>
<!-- <p>hidden</p> --><script>var x = "<p>no</p>";</script><blockquote>Quoted words here.</blockquote><p>Last &lt;words&gt; &eacute;.</p></article>
<section class="comments"><h3>Comments</h3><p>I did not like this at all, sorry to say.</p><p>Me neither.</p></section></main>
<aside class="sidebar"><p>Popular stories of the week for you.</p></aside><footer>&copy; 2024 Brand. All rights reserved.</footer></body></html>"""


def test_page_by_hand():
    want = "A title & more First paragraph with bold text and a link. Second one, unclosed. item one item two Quoted words here. Last <words> é."
    assert hm.extract(PAGE, hm.default_chain()) == want


def test_other_layouts():
    chain = hm.default_chain()
    long = "These words tell the story at some length, with commas, and then they go on."
    cases = [
        f'<body><div class="top-bar">Menu | Home</div><div class="story"><h1>Head</h1><p>{long}</p><p class="ad">Buy it today, it is very cheap.</p><p>{long}</p><section id="reader-comments"><p>{long}</p></section></div></body>',
        f'<body><header><h2>Site</h2></header><main><h1>Head</h1><p>{long}</p><aside><p>{long}</p></aside><p>{long}</p></main><div id="cookie-banner"><p>{long}</p></div></body>',
        f'<body><article><h1>Head</h1><p>{long}</p><div class="newsletter-signup"><form><p>{long}</p></form></div><p>{long}</p><div class="comments"><div class="comment"><p>{long}</p></div></div><footer>{long}</footer></article></body>',
    ]
    for page in cases:
        assert hm.extract(page, chain) == f"Head {long} {long}"


def test_blocks_of_odd_pages():
    chain = hm.default_chain()
    for page in (None, "", "<p", "</p>", "<!-- x", "<script>a", "<div><p></p></div>", "&nbsp;", "<br><br>"):
        assert hm.extract(page, chain) == ""
    assert [t for t, _ in hm.leaf_blocks("a<b>b</b>c <i>d</i><p>1 < 2 &amp;amp; x<td>y")] == ["abc d", "1 < 2 &amp; x", "y"]
    assert [t for t, _ in hm.leaf_blocks('<p title="a>b">c</p>')] == ["c"]


def test_names_that_say_nothing_or_mislead():
    chain = hm.default_chain()
    long = "These words tell the story at some length, with commas, and then they go on."
    nav = "<nav>" + "".join(f'<a href="/{i}">Go {i}</a>' for i in range(5)) + "</nav>"
    for name in ("article-comments-wrapper story", "col-8 k2", "x9z", "story header-x"):
        page = f'<body>{nav}<div class="{name}"><h1>Head</h1><p>{long}</p><p>{long}</p><p>{long}</p></div><footer>{long}</footer></body>'
        assert hm.extract(page, chain) == f"Head {long} {long} {long}"
    page = f'<body>{nav}<article><h1>Head</h1><p>{long}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <object>be so</object>.</p><noscript><p>{long}</p></noscript></article></body>'
    assert hm.extract(page, chain) == f"Head {long} Let x=1 be so. {long}"


def test_hostile_pages_take_linear_time():
    import time

    chain = hm.default_chain()
    pages = ['<a "' * 10**6, "<a b " * 10**6, "<div>x" * 10**5, "<div>" * 10**5 + "<td>y</td>" * 10**5, "<b>" * 10**5 + "x</i>" * 10**5, "<p><b>x" * 10**5, '<a ="' * 10**6, "<!--" * 10**6, "<ul><li><b>" * 10**5 + "z", "<" * 10**6, "&" * 10**6]
    for page in pages:
        began = time.process_time()
        hm.extract(page, chain)
        assert time.process_time() - began < 20


def test_blocks_by_plain_version():
    """Blocks and their open tags against a walk over the whole stack."""
    import random
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out, self.held = [], [], []

        def flush(self):
            if text := " ".join("".join(self.held).split()):
                self.out.append((text, next((t for t in reversed(self.stack) if t in hm.BLOCK), "body")))
            self.held = []

        def handle_starttag(self, tag, attrs):
            if tag in hm.BLOCK:
                self.flush()
                if "p" in self.stack:
                    at = len(self.stack) - 1 - self.stack[::-1].index("p")
                    if not any(t in hm.BLOCK for t in self.stack[at + 1 :]):
                        del self.stack[at:]
                if tag == "li":
                    for k in range(len(self.stack) - 1, -1, -1):
                        if self.stack[k] == "li":
                            del self.stack[k:]
                        if k >= len(self.stack) or self.stack[k] == "ul":
                            break
            self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag in hm.BLOCK:
                self.flush()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k] == tag:
                    del self.stack[k:]
                    break
                if tag not in hm.BLOCK and self.stack[k] in hm.BLOCK:
                    break

        def handle_data(self, data):
            self.held.append(data)

    rng = random.Random(12)
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<ul>", "</ul>", "<li>", "</li>", "<b>", "</b>", "<a href='x>'>", "</a>", "word ", "é &amp; ", "<h2>", "</h2>"]) for _ in range(rng.randint(0, 60)))
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.flush()
        got = [(t, next(f[3:] for f in names if f.startswith("in:"))) for t, names in hm.leaf_blocks(page)]
        # An item inside an item without a list between them ends the outer one, whatever lies between.
        want = [(t, "h" if h == "h2" else h) for t, h in plain.out]
        assert [t for t, _ in got] == [t for t, _ in want] and got == want


def test_held_out_pages():
    chain, wrong, total = hm.default_chain(), 0, 0
    for page in hm.labelled_pages(150, seed=4242):
        blocks = hm.leaf_blocks(page)
        got = chain.decode([f for _, f in blocks])
        wrong += sum(g != ("qz" in t) for g, (t, _) in zip(got, blocks, strict=True))
        total += len(blocks)
    assert wrong < 0.03 * total


def test_frames(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (4, "v", "<article><p>" + "long words " * 50000 + "</article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(hm.main_texts(df, ["page_id", "url"]).collect(), key=lambda r: r.page_id)
    assert [r.n_chars for r in got[:2]] == [0, 0] and got[2] == got[3] and got[4].n_chars == 50000 * 11 - 1
    assert hm.main_texts(df.limit(0), ["page_id"]).count() == 0


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    pages = {p["page_id"]: p["html"] for p in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()}
    got = QUERIES["op10_html_main_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if re.fullmatch(r"</?(b|a|i)>", m[0]) else " ", inside)).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_figures_and_fallbacks_stay_and_forms_go():
    chain = hm.default_chain()
    one = "The harbour was quiet before dawn, and the boats that had come in the night lay side by side along the long stone wall, their lamps still lit."
    two = "By noon the market had filled with people from the hills, who brought cheese, wool and news of the road that the flood had taken in spring."
    inside = f"<article><h1>Harbour life</h1><p>{one}</p><figure><svg><text>Chart of boats by month</text></svg></figure><p>{two} <canvas>drawn here</canvas><video>no film</video></p></article>"
    assert hm.extract(f"<body>{inside}</body>", chain) == f"Harbour life {one} Chart of boats by month {two} drawn hereno film"
    form = f"<article><p>{one}</p><button>Send it</button><p>{two}</p><label>Your name</label></article>"
    assert hm.extract(f"<body>{form}</body>", chain) == f"{one} {two}"
