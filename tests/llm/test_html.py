import random
import re
import time

import numpy as np
import pytest

from archgraph.llm import html_extract
from archgraph.llm.html_extract import extract_pages, main_text

BODY = "".join(f"<p>Sentence number {i} of the article has enough words to look like text, and then some more.</p>" for i in range(6))


def expected():
    return "\n".join(f"Sentence number {i} of the article has enough words to look like text, and then some more." for i in range(6))


def test_article_without_boilerplate():
    html = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href="/">Site</a><h2>Big site name</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site to make it work well for all of our readers.</div>
    <article><header><h1>The  title</h1><div>By someone</div></header>{BODY}<p>Short.</p><form><label>Mail</label><input><button>Go</button></form>
    <aside>Also read this long piece about other things that are in no way part of it.</aside></article>
    <section id="comments"><article class="comment"><p>First! This is a long reader comment that is not the article at all.</p></article></section>
    <div class="sidebar">Popular today: many things, with a lot of words to read here and there.</div>
    <footer>&copy; All rights</footer></body></html>"""
    assert main_text(html) == "The title\n" + expected() + "\nShort."


def test_without_article_element():
    html = f"<body><div id=menu><a href=x>Home</a> <a href=y>News</a></div><div id=main-text><h1>Title</h1>{BODY}<ul><li>one</li><li>two</ul></div><div class=footer>Imprint and more</div></body>"
    assert main_text(html) == "Title\n" + expected() + "\none\ntwo"


def test_references_spaces_and_cuts():
    assert main_text("<article><p>a &lt;b&gt; &amp; c\n\t d&nbsp;e<br>f</p></article>") == "a <b> & c d e f"
    assert main_text(f"<article>{BODY}<p>cut he") == expected() + "\ncut he"
    assert main_text(f"<article>{BODY}<p>cut he</artic") == expected() + "\ncut he"
    assert main_text(f"<article>{BODY}<!-- open <b") == expected()
    assert main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert main_text("<article><p>one<p>two<b>bold<p>three</b></article>") == "one\ntwobold\nthree"


def test_degenerate_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x</script>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<nav>only a menu</nav>") == ""
    assert main_text("<![if x]><article><p>kept</p></article>").endswith("kept")
    deep = "<div>" * 3000 + "deep text here" + "</div>" * 3000
    assert main_text(deep) == "deep text here"


def test_table(spark):
    rows = [(1, "u", "<article><p>é</p></article>", "x"), (2, None, None, "y"), (2, None, "", "y"), (None, "v", "<p>z", "n")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "z", 1), (1, "é", 1), (2, "", 0), (2, "", 0)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def paragraphs(name, count):
    return "".join(f"<p>Paragraph {i} of {name} has enough words to look like text, and then some more.</p>" for i in range(count))


def test_sibling_articles_all_stay():
    for first, second in ((5, 5), (8, 2), (2, 8)):
        for wrap in ("<main>{}</main>", "<body><div>{}</div></body>", "<main><section>{}</section></main>"):
            got = main_text(wrap.format(f"<article>{paragraphs('one', first)}</article><article>{paragraphs('two', second)}</article>"))
            assert got.count("of one") == first and got.count("of two") == second
    got = main_text(f"<main><section><article>{paragraphs('one', 9)}</article></section><section><article>{paragraphs('two', 1)}</article></section></main>")
    assert got.count("of one") == 9 and got.count("of two") == 1


def test_teaser_article_does_not_take_the_page():
    for text, teaser in ((9, 1), (8, 2), (15, 5), (7, 3), (6, 4)):
        got = main_text(f"<body><div><h1>Title</h1>{paragraphs('text', text)}</div><article>{paragraphs('teaser', teaser)}</article></body>")
        assert got.count("of text") == text
    got = main_text(f"<main><h1>Title</h1><div>{paragraphs('text', 8)}</div><article>{paragraphs('teaser', 2)}</article></main>")
    assert got.startswith("Title") and got.count("of text") == 8


def test_layout_wrappers_are_no_boilerplate():
    menu = "<div class=sidebar>Popular today: many things to read.</div>"
    for mark in ("content has-sidebar", "no-sidebar", "with-menu", "hidden-print", "elementor-widget-container", "widget"):
        for text in (BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>"):
            assert main_text(f"<body><div class='{mark}'>{text}</div>{menu}</body>") == expected(), mark
            assert main_text(f"<body><div id='page' class='{mark}'><div>{text}</div>{menu}</div></body>") == expected(), mark
    blocks = "".join(f"<div class='elementor-widget'><div class='elementor-widget-container'>{paragraphs(x, 2)}</div></div>" for x in ("one", "two", "three", "four"))
    for tag in ("div", "article", "main"):
        assert main_text(f"<body><{tag}>{blocks}</{tag}></body>").count("Paragraph") == 8


def test_marked_elements_beside_the_text_go():
    thread = f"<div id=comments>{paragraphs('a comment', 20)}</div>"
    assert main_text(f"<body><article>{BODY}</article>{thread}</body>") == expected()
    assert main_text(f"<body><div>{BODY}</div>{thread}</body>") == expected()
    cards = "".join(f"<article><p>{x} is a card of some words that leads elsewhere.</p></article>" for x in ("One", "Two"))
    assert main_text(f"<body><article>{BODY}</article><div class=related-posts>{cards}</div></body>") == expected()
    ad = "<div class=ad>Buy this thing, which has a text that is longer than the article.</div>"
    assert main_text(f"<body>{ad}<article><h1>A title.</h1><p>A short text.</p></article></body>") == "A title.\nA short text."


def test_wrapped_page_with_a_teaser_article_outside():
    got = main_text(f"<body><article>{paragraphs('teaser', 1)}</article><div class='content widget'><div>{paragraphs('text', 9)}</div></div></body>")
    assert got.count("of text") == 9


def test_declarations_and_comments_do_not_cut_the_page():
    article = f"<article>{BODY}</article>"
    for odd in ("<![foo[x]]>", "<![ x ]>", "<![>", "<![]>", "<![if !IE]>", "<![endif]>", "<![CDATA[a > b]]>", "<!-->", "<!--->", "<!---->", "<!-- a -- >", "<!-- a --!>", "<!-- a -->", "<!x>", "<!>"):
        assert main_text(f"<body>{odd}{article}</body>") == expected(), odd
        assert main_text(f"<body><div>{odd}{BODY}</div></body>") == expected(), odd
    assert main_text(f"<body><script>var a = '<!--';</script>{article}</body>") == expected()
    assert main_text(f"<body><div title='<!-- x'>{article}</div></body>") == expected()
    assert main_text(f"<body>{article}<!-- <p>open comment") == expected()
    assert main_text(f"<body>{article}<!-- <p>open</p> comment with <b>tags</b> in it") == expected()


def test_linked_headings_and_lines_between_content_stay():
    link = "<p><a href=x>A paragraph of the text that is a link from its start to its end</a></p>"
    items = "<ul><li><a href=x>first item</a></li><li><a href=y>second item</a></li></ul>"
    text = f"<div class=entry><h2 class='entry-title'><a href=x>The title</a></h2>{BODY}{link}{items}{BODY}</div>"
    got = main_text(f"<body><div class=site><a href=/>Site</a></div>{text}</body>")
    assert got == "The title\n" + expected() + "\nA paragraph of the text that is a link from its start to its end\nfirst item\nsecond item\n" + expected()
    got = main_text(f"<body><div class=entry><header><h1>The title</h1><div>By someone</div></header>{BODY}</div></body>")
    assert got == "The title\n" + expected()
    assert main_text(f"<body><div><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><h1>Title</h1>{BODY}</div></body>") == "Title\n" + expected()


def slow_lines(nodes, lines, voters):
    """Which lines are in a content region, by walking each line's ancestors."""
    up = lambda node: [node, *(up(node.parent) if node.parent is not None else [])]
    chains = [up(x[3]) for x in lines]
    regions, at = [], 0
    while at < len(lines):
        run = []
        while at < len(lines) and voters[at]:
            run.append(chains[at])
            at += 1
        at += 1
        if not run:
            continue
        around = [n for n in run[0] if all(any(m is n for m in c) for c in run)]
        region = next(n for n in around if n.tag in html_extract.REGION or n.parent is None)
        outermost = lambda n, tag: ([x for x in up(n) if x.tag == tag] or [None])[-1]
        if (article := outermost(region, "article")) is not None:
            regions.append(article)
            scope = outermost(article, "main") or article.parent
            found = [outermost(x[3], "article") for x in lines]
            regions += [a for a in found if a is not None and any(m is scope for m in up(a))]
        else:
            regions.append(outermost(region, "main") or region)
    return [any(n is r for n in c for r in regions) for c in chains]


def random_page(rnd):
    out, open_ = [], []
    for _ in range(rnd.randint(5, 60)):
        kind = rnd.random()
        if kind < 0.4:
            tag = rnd.choice(["div", "section", "article", "main", "ul", "li", "table", "td", "header", "a"])
            out.append(f"<{tag}{rnd.choice(['', '', ' class=widget', ' id=comments', ' class=ad', ' class=has-sidebar'])}>")
            open_.append(tag)
        elif kind < 0.6 and open_:
            out.append(f"</{open_.pop(rnd.randrange(len(open_)) if rnd.random() < 0.2 else -1)}>")
        else:
            out.append(f"<{rnd.choice(['p', 'h2', 'div', 'p'])}>{'word ' * rnd.choice([1, 3, 20, 60])}")
    return "".join(out)


def test_region_by_brute_force():
    rnd = random.Random(6)
    for _ in range(400):
        parser = html_extract._Lines()
        parser.feed(random_page(rnd))
        parser.close()
        parser.flush()
        lines = [x for x in parser.lines if not x[3].noise]
        if not lines:
            continue
        voters = np.array([rnd.random() < 0.3 for _ in lines])
        voters[rnd.randrange(len(lines))] = True
        chosen = {id(x) for x in html_extract._regions(parser.nodes, lines, voters)}
        inside = []
        for x in lines:
            at = x[3]
            while at is not None and id(at) not in chosen:
                at = at.parent
            inside.append(at is not None)
        assert inside == slow_lines(parser.nodes, lines, voters)
        # What elements hold, and which marks reach a line.
        own = [0] * len(parser.nodes)
        for x in lines:
            own[x[3].order] += 1
        held = html_extract._held(parser.nodes, own)
        for node in parser.nodes:
            inside = 0
            for x in lines:
                at = x[3]
                while at is not None:
                    inside += at is node
                    at = at.parent
            assert held[node.order] == inside


def test_clusters_decide_the_region(monkeypatch):
    """A page whose text is less than half of its characters: without the clusters, the tags would win."""
    tags = "".join(f"<span>tag number {i}</span><br><i>x</i><div>{i} posts</div>" for i in range(90))
    page = f"<body><div><div>{tags}</div></div><div><div><h1>Title</h1>{BODY}</div></div></body>"
    assert main_text(page) == "Title\n" + expected()
    monkeypatch.setattr(html_extract, "_voters", lambda every, kept, sigma, share: np.ones(len(every), dtype=bool))
    assert main_text(page) != "Title\n" + expected()


def words(*counts):
    return "".join("<p>" + " ".join(["word"] * n) + "</p>" for n in counts)


def test_no_share_of_the_text_decides_that_the_rest_goes():
    assert main_text(f"<body><div>{words(60, 60)}</div><div>{words(20)}</div></body>").count("word") == 140
    assert main_text(f"<body>{''.join(f'<section>{words(n)}</section>' for n in (200, 20, 20))}</body>").count("word") == 240
    assert main_text(f"<body><div class=top><h1>Title</h1></div><div>{words(30)}</div></body>").startswith("Title\nword")
    assert main_text("<body><div class=top><h1>Title</h1></div><div>text</div></body>") == "Title\ntext"
    assert main_text(f"<body><form action=x><input name=state>{words(60, 20)}<button>Go</button></form></body>").count("word") == 80
    assert main_text(f"<body><div>{words(60, 40)}</div><form><p>Write to us</p><input></form></body>") == "\n".join(" ".join(["word"] * n) for n in (60, 40))


def test_clusters_alone_find_the_article_of_given_pages(sf_dir, monkeypatch):
    """Given pages whose elements and classes say nothing: the clusters keep the whole article, and take away nearly all of the rest."""
    pq = pytest.importorskip("pyarrow.parquet")
    pages = pq.read_table(f"{sf_dir.replace('sf0.001', 'sf0.1')}/pages.parquet").column("html").to_pylist()[:500]
    want = [main_text(x) for x in pages]
    bare = [re.sub(r"(?<=[</])(article|main)\b", "div", re.sub(r' class="[^"]*"', "", x)) for x in pages]
    got = [main_text(x) for x in bare]
    assert all(a in b for a, b in zip(want, got))
    same = sum(a == b for a, b in zip(want, got))
    assert same >= 0.95 * len(pages)
    # Without the Gaussian, or with each line in a cluster, these pages come out otherwise.
    monkeypatch.setattr(html_extract, "smooth", lambda ratios, sigma: ratios)
    assert sum(main_text(x) == a for x, a in zip(bare, want)) < same - 10
    monkeypatch.setattr(html_extract, "_voters", lambda every, kept, sigma, share: np.ones(len(every), dtype=bool))
    assert sum(main_text(x) == a for x, a in zip(bare, want)) < 0.1 * len(pages)


def test_deep_pages_take_linear_time():
    for piece in ("<div><p>w</p>", "<div class=ad><p>w", "<li><div>w", "<article><p>w</p>"):
        began = time.process_time()
        main_text("<body>" + piece * 10_000)
        assert time.process_time() - began < 6
