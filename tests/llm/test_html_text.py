import random
import time

from halyard.llm.html_text import covered_tokens, extract_main_text, page_blocks, repeated_tokens, MAIN

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; line</h1></header><p><b>Bold&amp;quot;<br>next
  line<p>A <i>B</i>C &copy; &#233; 1 < 2 &am<div class="ad">Buy</div><aside>side</aside><form>f <p>x</form>
<table><tr><td>c1<td>c2</table><script>x</script>end</article><section class="comments"><p>nice</p></section></main>
<footer>&copy; foot</footer></body></html>"""


def test_blocks():
    text = " ".join(t for k, t in page_blocks(PAGE) if k == MAIN)
    assert text == 'Head & line Bold&quot; next line A BC © é 1 < 2 &am c1 c2 end'
    assert page_blocks("") == page_blocks(None) == [] and page_blocks("<p>a<p>b</div>c") == [(0, "a"), (0, "b"), (0, "c")]


def test_articles_inside_furniture_are_kept():
    main = lambda h: " ".join(t for k, t in page_blocks(h) if k == MAIN)
    free = lambda h: " ".join(t for k, t in page_blocks(h) if k == 0)
    body = "<article><p>Whole text</p><div class='share-buttons'>Tell</div></article>"
    for wrap in ("div class='no-sidebar'", "div class='has-comments x'", "div class='top'", "div id='header'",
                 "div class='sidebar'", "form id='aspnetForm'", "section class='notice'", "div role='form'"):
        page = f"<body><{wrap}><nav>Menu</nav>{body}</{wrap.split()[0]}><footer>foot</footer></body>"
        assert main(page) == "Whole text", wrap
    assert main("<main class='top'><p>Text</p></main>") == "Text"
    assert main("<main><form><p>Most of the text of it</p></form><p>end</p></main>") == "Most of the text of it end"
    # comments and teasers that are articles of their own stay out
    own = "<section class='comments'><article>nice</article></section><aside><article>teaser</article></aside>"
    assert main(f"<main><p>Text</p>{own}</main>") == main(f"<article>Text</article>{own}") == "Text"
    assert main(f"<form><article>Text</article>{own}</form>") == "Text"
    # without an article, what holds most of the text is a plain container
    assert free("<form><p>All the text of the page</p></form><p>foot</p>") == "All the text of the page foot"
    assert free("<p>All the text of the page</p><form><label>Your name</label></form>") == "All the text of the page"
    assert main("<article>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>TeX</annotation></math></article>") == "so x=1"


def test_head_ends_without_its_end_tag():
    main = lambda h: " ".join(t for k, t in page_blocks(h) if k == MAIN)
    free = lambda h: " ".join(t for k, t in page_blocks(h) if k == 0)
    assert main("<html><head><title>t</title><body><article><p>hello world</p></article>") == "hello world"
    assert main("<head><meta charset=x><link rel=y><article>hello</article>") == "hello"
    assert free("<head><title>t</title>bare words<p>more") == "bare words more"
    assert free("<head><noscript><img src=x></noscript><style>p{}</style></head><p>more") == "more"
    assert free("<html><head>\n<title>t</title>\n</head>\n<body>x</body>") == "x"


def test_furniture_by_name():
    main = lambda h: " ".join(t for k, t in page_blocks(h) if k == MAIN)
    free = lambda h: " ".join(t for k, t in page_blocks(h) if k == 0)
    for furniture in ("class='post-comments'", "id=comment-12", "class='comment-body'", "class='x comments-area'",
                      "class='ad-container'", "class='advert-wrapper'", "class='widget-content'", "class='cookie-message'",
                      "style='display:none'", "style='color:red; visibility : hidden'", "class='site-footer'",
                      "class='main-navigation'", "class='left-sidebar'", "class='teaser'"):
        assert main(f"<article><p>Text</p><div {furniture}>Not</div></article>") == "Text", furniture
        assert free(f"<p>Text of the page</p><div {furniture}>Not</div>") == "Text of the page", furniture
    for plain in ("class='no-sidebar'", "class='footer-style'", "class='post-content'", "class='main-content'",
                  "class='admin adverb'", "style='display:block'"):
        assert main(f"<article><p>Text</p><div {plain}>too</div></article>") == "Text too", plain
    assert main("<article>Text</article><article class='teaser'>Other</article>") == "Text"
    assert main("<article><header>Head</header>Text<aside>side</aside><footer>by</footer></article><article>Second</article>") \
        == "Head Text Second"


def test_unclosed_tags_take_linear_time():
    def seconds(n, piece):
        start = time.perf_counter()
        page_blocks(piece * n)
        return time.perf_counter() - start

    for piece in ("<div><font>", "<font>", "<p><b>", "<li><i>x", "</b>", "<td><a>", "<font><p></p>", "<head><noscript><div>"):
        seconds(1000, piece)
        small, large = seconds(10_000, piece), seconds(80_000, piece)
        assert large < 30 * max(small, 0.01), (piece, small, large)
    assert seconds(200_000, "<div><font>x") < 30


def naive(pages, depth, least=2):
    grams = {}
    for i, p in enumerate(pages):
        for k in range(len(p) - depth + 1):
            grams.setdefault(tuple(p[k:k + depth]), set()).add(i)
    out = []
    for p in pages:
        mask = [False] * len(p)
        for k in range(len(p) - depth + 1):
            if len(grams[tuple(p[k:k + depth])]) >= least:
                mask[k:k + depth] = [True] * depth
        out.append(mask)
    return out


def test_suffix_array_against_all_substrings():
    r = random.Random(8)
    for depth in (1, 3, 6):
        run = [r.randrange(1000) for _ in range(15)]
        pages = [[r.randrange(4) for _ in range(r.randint(0, 40))] + run * (k % 3 == 0) + [r.randrange(900, 999)]
                 for k in range(12)] + [[], [5]]
        for least in (2, 3, 4):
            assert [m.tolist() for m in repeated_tokens(pages, depth, least)] == naive(pages, depth, least)


def test_parts_of_a_host_find_what_one_array_finds(spark):
    r = random.Random(9)
    menu = [f"m{i}" for i in range(9)]
    rows = [(k, "h" if k % 3 else f"other{k}", " ".join([f"u{k}_{i}" for i in range(r.randint(0, 30))]
             + menu * (k % 4 == 0) + [f"v{k % 5}_{i}" for i in range(7)])) for k in range(120)]
    frame = spark.createDataFrame(rows, "row long, host string, stream string")
    words = {k: s.split() for k, h, s in rows if h == "h"}
    for least in (2, 3, 18):
        found = lambda n: {x.row: sorted(x.covered) for x in covered_tokens(frame, 6, n, least).collect() if x.covered}
        whole = found(10 ** 6)
        assert whole and whole == found(100)
        want = dict(zip(words, naive(list(words.values()), 6, least)))
        assert all(whole.get(k, []) == [i for i, x in enumerate(m) if x] for k, m in want.items())


def test_copies_and_quotations_stay(spark):
    """Of pages without an article: copies keep their text, so does a page that
    quotes another; blocks that three distinct pages have go."""
    menu = "<div>All our topics from politics to sports and weather</div>"
    one = "<p>It was the best of times it was the worst of times he wrote</p>"
    pages = [(1, menu + one), (2, menu + one), (3, f"{menu}<p>He said it was the best of times it was the worst to us</p>"),
             (4, f"{menu}<blockquote>it was the best of times it was the worst</blockquote><p>end</p>"), (5, f"{menu}<p>other</p>")]
    rows = [(k, f"http://h/{k}", h) for k, h in pages]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "It was the best of times it was the worst of times he wrote"
    assert got == {1: text, 2: text, 3: "He said it was the best of times it was the worst to us",
                   4: "it was the best of times it was the worst end", 5: "other"}


def test_pages(spark):
    bare = lambda k: f"<div>Subscribe to our letter for more news today</div><div>W{k} own text of this page</div>"
    rows = [(k, f"https://H.example.org/{k}", bare(k), "x") for k in range(4)]
    rows += [(10, "https://a.example.org/", PAGE, "x"), (11, "https://a.example.org/2", PAGE, "x"), (12, None, None, None),
             (13, "not a url", "", None), (None, "https://h.example.org/0", bare(0), None), (10, "https://a.example.org/", PAGE, "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].text == "W1 own text of this page" and by[1][0].n_chars == 24
    assert by[0][0].text == by[None][0].text == "W0 own text of this page"  # copies count as one page
    assert len(by[10]) == 2 and by[11][0].text == by[10][0].text and by[10][0].text.startswith("Head & line")
    assert by[12][0].text == by[13][0].text == ""
    assert extract_main_text(got.selectExpr("page_id", "url", "text html").filter("false")).count() == 0
