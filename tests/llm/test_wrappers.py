import random

from bidscope.llm import wrappers

FRAME = (
    '<!DOCTYPE html><html><head><title>t</title><script>var a = "</p><article>";</script><style>p{{}}</style></head><body>'
    '<header><a href="/">Site</a></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div>{notice}'
    '<{main}><h1>{title}</h1>{body}<section class="comments"><p>A reader says no</p></section></{main}>'
    '<aside><p>More</p></aside><form><p>Mail</p><input name=q></form><footer>&copy; Site</footer>'
)


def page(rng, main="article"):
    blocks = [f"Text {rng.random()} &amp; more  \n words&lt;{k}&gt;" for k in range(rng.randint(1, 5))]
    menu = "".join(f"<li><a href=/{k}>{k}</a>" for k in range(rng.randint(1, 4)))
    inner = "".join(rng.choice([f"<p>{b}</p>", f"<p>{b}", f"<blockquote>{b}</blockquote>", f"<p><b>{b.replace('more', '<i>more</i>')}<br>"]) for b in blocks)
    notice = rng.choice(["", '<div id="notice-12">Sale!</div>'])
    html = FRAME.format(menu=menu, title="A title", body=inner, notice=notice, main=main)
    text = "\n".join(["A title", *[" ".join(b.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").split()) for b in blocks]])
    return html + rng.choice(["", "</body></html>"]), text


def test_main_text_of_many_hosts(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(120):
        html, text = page(rng)
        rows.append((i, f"https://h{i % 3}.example/{i}?x", html, 1))
        want[i] = text
    rows += [(200, None, page(rng)[0], 1), (201, "no url", None, 1), (202, "http://h0.example/", "", 1), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int").repartition(4)
    got = wrappers.main_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in want:
            assert r["text"] == want[r["page_id"]]
    assert {r["text"] for r in got if r["page_id"] in (201, 202)} == {""}
    assert wrappers.main_text(pages.filter("false")).count() == 0


def test_wrappers_are_union_free_and_do_not_depend_on_order():
    rng = random.Random(9)
    pages = [wrappers.wrapper_of(wrappers.parse(page(rng)[0])) for _ in range(30)]
    whole = None
    for w in pages:
        whole = wrappers.merge_wrappers(whole, w)
    text = wrappers.expression(whole)
    assert "|" not in text and "(<li>#</>)+" in text and "(<div.notice>#</>)?" in text
    parts = [None, None]
    for k, w in enumerate(pages):
        parts[k % 2] = wrappers.merge_wrappers(parts[k % 2], w)
    assert wrappers.judge(wrappers.merge_wrappers(*parts)) == wrappers.judge(whole)


def test_pages_without_an_article_fall_back_on_running_text():
    texts = ["one long story about a river", "two short stories about hills", "three tales", "four"]
    htmls = [f"<body><div class=top><a href=/>Home</a></div><div class=text><p>{t}</p></div><div class=foot>Always the same</div>" for t in texts]
    whole = None
    for h in htmls:
        whole = wrappers.merge_wrappers(whole, wrappers.wrapper_of(wrappers.parse(h)))
    assert [wrappers.extract(h, wrappers.judge(whole)) for h in htmls] == texts


def test_repeated_groups_and_broken_markup():
    tree = wrappers.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x<p>y</i></b></zzz><!-- <p>no --> z <p title='>'>w <script>if (a < b) '<p>'</script")
    assert wrappers.expression(wrappers.wrapper_of(tree)) == "(<>(<dl>((<dt>#</>)(<dd>#</>))+</>)(<p>#</>)+</>)"
    assert wrappers.extract("a < b &amp;&nbsp;c <p", {}) == "a < b & c <p"


def texts_of(htmls):
    whole = None
    for h in htmls:
        whole = wrappers.merge_wrappers(whole, wrappers.wrapper_of(wrappers.parse(h)))
    return [wrappers.extract(h, wrappers.judge(whole)) for h in htmls]


def test_texts_do_not_depend_on_the_number_of_copies(spark):
    short = "<body><div class=text><h1>T</h1><p>One paragraph</p></div></body>"
    longer = "<body><div class=text><h1>A title</h1><p>One</p><p>Two</p><blockquote>Said so</blockquote></div><div class=seen>Seen {} times</div></body>"
    for copies in (1, 2, 3, 7):
        assert set(texts_of([short] * copies)) == {"T\nOne paragraph"}
        for k, text in enumerate(texts_of([longer.format(k) for k in range(copies)])):
            assert text == f"A title\nOne\nTwo\nSaid so\nSeen {k} times"
    pages = spark.createDataFrame([(k, None, short) for k in range(6)], "page_id bigint, url string, html string").repartition(3)
    assert {r["text"] for r in wrappers.main_text(pages).collect()} == {"T\nOne paragraph"}


def test_what_a_host_repeats_goes_unless_a_page_has_nothing_else():
    stories = ["a story about a river", "another about hills", "a tale of two towns"]
    htmls = [f"<body><div class=text><p>{t}</p></div><div class=foot>Always the same</div></body>" for t in stories]
    assert texts_of([*htmls, htmls[0], htmls[0]]) == [*stories, stories[0], stories[0]]
    assert texts_of([*htmls, "<body><div class=foot>Always the same</div></body>"])[-1] == "Always the same"
    named = [h.replace("div class=text", "article").replace("</p></div>", "</p></article>") for h in htmls]
    assert texts_of([*named, "<body><article></article><div class=foot>Always the same</div></body>"]) == [*stories, ""]


DEEP = [
    ("<html><body>" + "<div>" * 50_000 + "hello", "hello"),
    ("<html><body>" + "<div>" * 5_000 + "a<p>b</p>c" + "</div>" * 5_000 + "d", "a\nb\nc\nd"),
    ("<body>" + "<section><p>x</p><p>y</p>" * 900 + "<nav>menu</nav><p>end</p>", "\n".join(["x", "y"] * 900 + ["end"])),
    ("<body>" + "<div>" * 300 + "<nav><ul><li><p>menu</p></ul></nav><p>text</p>", "text"),
    ("<body>" + "<p>one</p><h2>two</h2>" * 3_000, "\n".join(["one", "two"] * 3_000)),
    ("<body><article>" + "<p>long " * 20_000 + "</article>", "\n".join(["long"] * 20_000)),
]


def test_deep_and_long_pages(spark):
    rows = [(i, f"http://h{i}.example/{i}", html) for i, (html, _) in enumerate(DEEP)]
    rows += [(100 + i, f"http://h{i}.example/b{i}", html.replace("<body>", "<body><h1>T</h1>")) for i, (html, _) in enumerate(DEEP)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i, (_, text) in enumerate(DEEP):
        assert got[i] == text
        assert got[100 + i] == (text if "<article>" in DEEP[i][0] else "T\n" + text)


def test_siblings_are_aligned_some_at_a_time(monkeypatch):
    rng = random.Random(6)
    pages = ["<body>" + "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c</ul>"]) for _ in range(60)) for _ in range(4)]
    monkeypatch.setattr(wrappers, "ALIGNED", 7)
    whole = None
    for html in pages:
        whole = wrappers.merge_wrappers(whole, wrappers.wrapper_of(wrappers.parse(html)))
    labels = set(wrappers._labels(whole))
    assert {"body", "p", "h2", "ul", "li"} <= labels
