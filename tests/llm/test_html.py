"""Main text of pages."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from codeloom.llm import html

LONG = "A paragraph of the article, long enough to count, with commas, and more words to be sure of it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>{LONG}<p>{LONG}<aside>no</aside></article><footer>f</footer>", f"T {LONG} {LONG}"),
        (f"<div id=header>x</div><div class='post'><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></div><div class=sidebar><p>{LONG}</p></div>", LONG),
        (f"<div class=cookie-notice><p>{LONG}</p></div><main><p>{LONG}</p><form><p>{LONG}</p></form></main>", LONG),
        ("<p>a<b>b</b>c <i>d</i><script>if (a<b) x('</p>')</script> e&eacute;&#33;<!-- no --></p>", "abc d eé!"),
        ("<p>cut off &amp", "cut off &"),
        ("<div><ul><li>one<li>two</ul></div>", "one two"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("</p></div><p>x</p></div></p>", "x"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_siblings_that_read_like_the_best_are_kept():
    page = f"<body><div><div><p>{LONG} {LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><div><a href=1>{LONG}</a></div></div></body>"
    text = html.main_text(page)
    assert text.count(LONG) == 5


def naive(nodes, blocks):
    """Points and characters by walking up from every block."""
    points, chars = {}, {}
    for owner, text, linked in blocks:
        own = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text)) if len(text) >= 25 else 0
        up, shares = owner, [1, 1 / 2, 1 / 3, 1 / 4]
        while up is not None:
            whole, links = chars.get(up, (0, 0))
            chars[up] = whole + len(text), links + linked
            if up.tag not in html.INLINE and not (up is owner and owner.tag in html.PARAGRAPHS) and shares:
                points[up] = points.get(up, 0) + own * shares.pop(0)
            up = up.parent
    return points, chars


@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "<section>", "</section>", LONG, "short, text", "<li>", "<td>"]), max_size=40))
def test_points_equal_those_of_a_plain_walk(parts):
    nodes, _ = html.parse(" ".join(parts))
    blocks = html._blocks(nodes[0])
    points, chars = naive(nodes, blocks)
    html.weigh(nodes, blocks)
    assert all(abs(n.points - points.get(n, 0)) < 1e-9 and (n.chars, n.linked) == chars.get(n, (0, 0)) for n in nodes)


def test_stray_quotes_end_with_their_tag():
    assert html.main_text(f"<p class=don't>{LONG}</p><p>{LONG}") == f"{LONG} {LONG}"
    assert html.main_text(f"<a title=\"5\" tall\">x</a><p title='a>b' id=q>{LONG}</p>").endswith(LONG)


@pytest.mark.parametrize("part", ["<div>x", "<b><p>x, y", "<nav><b></i>", "<li><span>x"])
def test_deep_pages_take_linear_time(part):
    began = time.process_time()
    html.main_text(part * 100_000)
    assert time.process_time() - began < 20


def test_weak_words_do_not_drop_the_article():
    page = f"<div class=social-history><p>{LONG}</p><p>{LONG}</p></div>"
    assert html.main_text(page) == f"{LONG} {LONG}"
    assert html.main_text(f"<div><p>{LONG}</p></div>" + page) == LONG


WRAPPERS = ["content has-sidebar", "post hentry comments-open", "page no-comments", "with-ads", "modal-open", "menu-open", "layout-sidebar", "no-footer page", "wrap banner-top", "site header-fixed", "page share-left", "entry related", "main_menu-closed", "search results"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_keep_their_article(name):
    body = f"<p>{LONG}</p><p>{LONG}</p><div class=comments><p>{LONG}</p></div><div class=adbox><p>{LONG}</p></div>"
    assert html.main_text(f'<body><div class="{name}"><div>{body}</div></div></body>') == f"{LONG} {LONG}"
    assert html.main_text(f'<body><div class="sidebar-left"><article><h1>T</h1>{body}</article></div></body>') == f"T {LONG} {LONG}"


def test_reader_comments_alone_are_no_article():
    assert html.main_text(f"<div class=comments><p>{LONG}</p><p>{LONG}</p></div>") == ""
    assert html.main_text(f"<p>{LONG}</p><div class=comments>{f'<p>{LONG}</p>' * 9}</div>") == LONG


def test_articles_beside_each_other_are_kept():
    two = f"<article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p></article>"
    assert html.main_text(f"<body>{two}</body>") == f"A {LONG} B {LONG}"
    assert html.main_text(f"<body><main><h1>T</h1>{two}</main></body>") == f"T A {LONG} B {LONG}"


def test_a_short_lead_of_its_own_is_kept():
    page = f"<div><div class=lead><p>Short lead here.</p></div><div><p>{LONG}</p><p>{LONG}</p></div></div>"
    assert html.main_text(page) == f"Short lead here. {LONG} {LONG}"


TAGS = ["<div>", "</div>", "<p>", "</p>", "<section>", "</section>", "<article>", "</article>", LONG, f"{LONG} {LONG}", "short, text", "<a href=x>", "</a>", "<h2>", "</h2>", "<main>", "</main>"]


@given(st.lists(st.sampled_from(TAGS), max_size=40))
def test_choice_equals_that_of_a_plain_walk(parts):
    """The best container and its siblings, chosen again from a walk up from every block."""
    page = "<body>" + " ".join(parts)
    nodes, _ = html.parse(page)
    blocks = html._blocks(nodes[0])
    points, chars = naive(nodes, blocks)
    score = lambda n: points.get(n, 0) * (1 - chars[n][1] / chars[n][0]) if n in chars and chars[n][0] else 0
    scored = [n for n in nodes if points.get(n, 0)]
    text, _ = html.article(html.parse(page)[0])
    if not scored:
        assert text == " ".join(t for _, t, _ in blocks)
        return
    top = max(score(n) for n in scored)
    best = next(n for n in scored if abs(score(n) - top) < 1e-12)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    around = []
    up = best
    while up is not None:
        around.append(up)
        up = up.parent
    under = lambda n, kept: any(a in kept for a in chain_up(n))
    marked, kept, own = best.tag in ("article", "main"), {best}, None
    links = lambda n: chars[n][1] / chars[n][0]
    page_level = ("body", "html", "#root")
    if best.parent is not None and best.tag not in page_level:
        for n in nodes:
            if n.parent is best.parent and n is not best and chars.get(n, (0, 0))[0]:
                text_like = n.tag in ("p", "h2") and links(n) < 0.25 and not (marked and best.parent.tag in page_level)
                strong = score(n) >= 0.2 * score(best) and (not marked or n.tag in ("article", "main", "section"))
                if text_like or strong:
                    kept.add(n)
                    own = None if marked else best.parent
        if not marked:
            for inner, outer in zip(around[1:], around[2:], strict=False):
                if inner.tag in page_level:
                    break
                kept |= {n for n in nodes if n.parent is outer and n is not inner and n.tag in ("section", "div") and score(n) >= 0.2 * score(best) and n in chars and chars[n][1] < 0.25 * chars[n][0]}
    assert text == " ".join(t for o, t, linked in blocks if under(o, kept) or o is own and linked < 0.25 * len(t))


def chain_up(node):
    while node is not None:
        yield node
        node = node.parent


def test_sections_beside_the_best_ones_parent_are_kept():
    page = f"<body><div><section><div><p>{LONG} {LONG}</p><p>{LONG}</p></div></section><section><p>{LONG}</p><p>{LONG}</p></section></div></body>"
    assert html.main_text(page).count(LONG) == 5


def test_query(spark, folder):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t"), (2, None, None, "t"), (None, "u", "<p>x", "t"), (1, "u", f"<article><p>{LONG}</p></article>", "t")]
    out = html.op3_html_text(spark, folder(pages=(rows, "page_id long, url string, html string, text string"))).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "x", 1), (1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "", 0)]


def test_empty(spark, empty_folder):
    assert html.op3_html_text(spark, empty_folder).collect() == []
