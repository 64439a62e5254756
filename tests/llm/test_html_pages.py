"""Pages whose names and frames mislead, and a plain second extractor over all given pages."""

import re
from html.parser import HTMLParser

import duckdb
import pytest

from quillspark.llm import html_extract
from quillspark.llm.html_extract import extract

SAID = "A sentence with some words, a comma, and an end that is long enough to count as text of the page."
LONG = f"<p>{SAID}</p>" * 4
WANT = " ".join([SAID] * 4)
MENU = "<ul>" + "".join(f"<li><a href=/{k}/>Home {k}</a></li>" for k in range(8)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><nav>x</nav><div class="content with-sidebar"><article>{LONG}</article></div></body>', WANT),
        (f'<body><div class="no-ads layout-sidebar">{LONG}</div></body>', WANT),
        (f"<body><form>{LONG}<input><select><option>one</select><button>Go</button></form></body>", WANT),
        (f"<body><main><h1>Head</h1><form>{LONG}</form></main></body>", f"Head {WANT}"),
        (f"<body><article><h1>Head</h1>{LONG}<form><label>Your mail</label><button>Send</button></form></article></body>", f"Head {WANT}"),
        (f'<body><article>{LONG}<div id="related-work" class="section"><h2>Related work</h2>{LONG}</div></article></body>', f"{WANT} Related work {WANT}"),
        (f'<body><article>{LONG}<section class="discussion"><h2>Discussion</h2><p>It is so.</p></section></article></body>', f"{WANT} Discussion It is so."),
        (f'<body><article>{LONG}<p class="legal">The law says so.</p></article></body>', f"{WANT} The law says so."),
        (f'<body><article>{LONG}<div class="legal"><a href=/a>Terms</a> <a href=/b>Privacy</a></div></article></body>', WANT),
        (f"<body><div>A teaser of another story</div><article>{LONG}</article></body>", WANT),
        (f"<body>Bare text, before it.<div>{LONG}</div>and after</body>", f"Bare text, before it. {WANT} and after"),
        (f"<body><div>{MENU}</div><div>{LONG}</div></body>", WANT),
        (f'<body><div class="menu">{MENU}</div><article>{LONG}</article></body>', WANT),
        (f'<body><article>{LONG}</article><div class="comments"><article class="comment">{LONG * 3}</article></div></body>', WANT),
        (f'<body><article>{LONG}<section id="comments"><h3>2 replies</h3>{LONG * 2}</section></article></body>', WANT),
        (f'<body><div class="ad">Buy now, and here.</div><article>{LONG}<div class="advert">Buy, buy</div></article></body>', WANT),
        (f'<body><div class="cookie-notice">We use cookies, all of them.</div><div class="main">{LONG}</div></body>', WANT),
        (f'<body><article>{LONG}<aside>More, elsewhere</aside><div class="share">Tell all</div><footer>by me</footer></article></body>', WANT),
        (f"<body><div/>{LONG}<div/></body>", WANT),
        (f'<body><div hidden>{LONG}</div><article>{LONG}<p aria-hidden="true">x</p></article></body>', WANT),
        ('<body><div class="comments"><p>Only readers wrote here.</p></div></body>', "Only readers wrote here."),
        (f"<body><h1>Head</h1><div>{LONG}</div><h2>Part</h2><p>Short.</p></body>", f"Head {WANT} Part Short."),
        ("", ""), (None, ""), ("<script>x</script><nav>y</nav>", ""), ("plain &amp; bare", "plain & bare"),
    ],
)
def test_pages(page, want):
    assert extract(page) == want


class Plain(HTMLParser):
    """Text of article or main elements, else of the body, without what tags and the names of adverts tell."""

    SKIP = {"script", "style", "nav", "footer", "aside", "form", "head", "button", "select", "textarea", "noscript"}
    BLOCKS = set("p div h1 h2 h3 h4 h5 h6 li ul ol br td th tr table section article main pre blockquote header".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.out, self.all = [], 0, [], []

    def handle_starttag(self, tag, attrs):
        names = re.findall("[a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")))
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            pass
        elif self.skip:
            self.skip += [tag] if tag == self.skip[0] else []
        elif tag in self.SKIP or (tag == "header" and not self.inside) or {"ad", "comments", "sidebar", "notice", "menu"} & set(names):
            self.skip.append(tag)
        elif tag in ("article", "main"):
            self.inside += 1
        self.add("\n" if tag in self.BLOCKS else "")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag in ("article", "main"):
            self.inside -= 1
        self.add("\n" if tag in self.BLOCKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.add(re.sub(r"\s", " ", data))

    def add(self, text):
        self.all.append(text)
        if self.inside:
            self.out.append(text)

    def text(self):
        said = "".join(self.out) if "".join(self.out).strip() else "".join(self.all)
        return " ".join(" ".join(line.split()) for line in said.split("\n") if line.strip())


def test_given_pages_equal_a_plain_version(sf_dir):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()
    wrong = []
    for page_id, html in pages:
        plain = Plain()
        plain.feed(html or "")
        plain.close()
        if extract(html) != plain.text():
            wrong.append(page_id)
    assert pages and wrong == []


def test_query_gives_the_function(spark, sf_dir):
    from quillspark.llm import queries

    html = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall())
    rows = queries.op5_html_extract(spark, sf_dir).collect()
    assert len(rows) == len(html) and all(r["text"] == html_extract.extract(html[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)
