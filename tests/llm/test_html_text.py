"""Main text of pages with known article text."""

import html
import math
import random
import time

import pytest

from ledgerlens.llm import html_text as H


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\nonly", "plain text only"),
        ("<p>a</p><p>b", "a\nb"),
        ("<div><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></div>", "x\ny\n1\n2"),
        ("<body><script>var a='</p><p>no</p>';</script><style>p{}</style><p>yes &amp; &eacute;&nbsp;&#x41;</p></body>", "yes & é A"),
        ("<body><!-- <p>no</p> --><p>one<br>two <b>three</p></body>", "one two three"),
        ("<body><p>unclosed <a href='x>y'>link</a> text goes on here", "unclosed link text goes on here"),
        ("<nav>menu</nav>", ""),
        ("<div hidden>no</div><p>yes</p>", "yes"),
    ],
)
def test_small_pages(page, text):
    assert H.main_text(page) == text


def make_page(rng):
    words = [f"word{k}" for k in range(50)] + ["&amp;", "é"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    blocks = [sentence(rng.randint(2, 8))] + [sentence(rng.randint(1, 120)) for _ in range(rng.randint(1, 9))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" if rng.random() < 0.8 else f"<p><b>{b}<br>" for b in blocks[1:])
    clutter = [
        "<nav><ul>" + "".join(f"<li><a href='/{k}'>{sentence(2)}</a></li>" for k in range(6)) + "</ul></nav>",
        f"<div class='ad'>{sentence(20)}</div>",
        f"<header><p>{sentence(12)}</p></header>",
        f"<aside class=sidebar><p>{sentence(40)}</p></aside>",
        f"<div id='cookie-notice'>{sentence(15)}</div>",
        f"<form><label>{sentence(3)}</label><input><button>go</button></form>",
    ]
    rng.shuffle(clutter)
    end = f"<section class='comments'><div class='comment'><p>{sentence(60)}</p></div></section><footer>{sentence(9)}</footer>"
    page = f"<!DOCTYPE html><html><head><title>{sentence(3)}</title></head><body>{''.join(clutter[:4])}<article>{body}</article>{''.join(clutter[4:])}{end}</body></html>"
    return page, "\n".join(" ".join(html.unescape(b).split()) for b in blocks)


def test_generated_pages():
    rng = random.Random(7)
    for _ in range(200):
        page, text = make_page(rng)
        assert H.main_text(page) == text
        # The name of the element decides nothing.
        assert H.main_text(page.replace("article>", "div>")) == text
        assert H.main_text(page.replace("<article>", "<section class=q><div>").replace("</article>", "</div></section>")) == text


def test_density_finds_the_main_part_without_article():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    long = ["".join(f"{rng.choice(words)} " for _ in range(80)).strip() for _ in range(5)]
    links = "".join(f"<a href='#'>{w}</a> " for w in words)
    page = f"<body><div class=x>{links}</div><div class=y>{''.join(f'<p>{p}</p>' for p in long)}</div><div class=z>{links}</div></body>"
    assert H.main_text(page) == "\n".join(long)


def grow(rng, depth=0):
    """A random tree of (tag, children); a child is a text or a tree."""
    kind = rng.choice(["p", "p", "links", "div", "div", "section", "ul", "h2"]) if depth < 4 else rng.choice(["p", "links", "h2"])
    words = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    if kind in ("p", "h2"):
        return kind, [words(rng.randint(1, 60 if kind == "p" else 6))] + ([("a", [words(2)])] if rng.random() < 0.2 else [])
    if kind == "links":
        return "div", [("a", [words(rng.randint(1, 3))]) for _ in range(rng.randint(1, 8))]
    if kind == "ul":
        return "ul", [("li", [words(rng.randint(1, 20))]) for _ in range(rng.randint(1, 5))]
    return kind, [grow(rng, depth + 1) for _ in range(rng.randint(1, 4))]


def render(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(render, tree[1]))}</{tree[0]}>"


def plain_density(body):
    """The densest part and the parts beside it, by recursion over the tree, as the definitions say."""
    size = lambda t: len("".join(t.split())) if isinstance(t, str) else sum(map(size, t[1]))
    linked = lambda t: 0 if isinstance(t, str) else size(t) if t[0] == "a" else sum(map(linked, t[1]))
    count = lambda t, tag=None: 0 if isinstance(t, str) else sum(count(x, tag) + (not isinstance(x, str) and tag in (None, x[0])) for x in t[1])
    share = linked(body) / max(1, size(body))

    def density(t):
        c, lc = size(t), linked(t)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        tags = max(1, count(t))
        return c / tags * math.log(c / max(1, lc) * tags / max(1, count(t, "a")) + 1) / max(0.1, math.log(base + 0.1))

    inner = lambda t: [x for x in t[1] if not isinstance(x, str)]
    total = lambda t: sum(map(density, inner(t))) or density(t)
    below = lambda t: [t, *(y for x in inner(t) for y in below(x))]
    best = max(below(body), key=total)  # the first of equals
    path = [t for t in below(body) if any(x is best for x in below(t))]  # from the body down
    threshold = min(map(density, path))
    top = next((t for t in path[1:] if density(t) >= density(body)), best)
    on_path = lambda t: any(x is t for x in path)
    blocks, line = [], []

    def end():
        blocks.append("".join(line))
        line.clear()

    def visit(t, kept, dense):
        if isinstance(t, str):
            if kept:
                line.append(t)
            return
        if t is top:
            kept = True
        elif kept:
            kept, dense = on_path(t) or t[0] == "a" or density(t) >= threshold or 2 * linked(t) < size(t), False
        else:
            dense = t is body or dense and density(t) >= threshold > 0
            kept = dense and not on_path(t) and total(t) >= max(*map(total, below(t)), H.BESIDE * total(best))
        if t[0] != "a":
            end()
        for x in t[1]:
            visit(x, kept, dense)
        if t[0] != "a":
            end()

    visit(body, False, False)
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_equals_plain_density():
    rng = random.Random(9)
    for _ in range(400):
        body = ("body", [grow(rng) for _ in range(rng.randint(1, 5))])
        assert H.main_text(render(body)) == plain_density(body)


@pytest.mark.parametrize("names", ['class="has-comments"', 'class="page no-sidebar"', 'class="wrapper with-sidebar"', 'class="market-share"', 'id="research-search"', 'class="overflow hidden lg:block"', 'class="widget"', 'data-comments="12"'])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_wrappers_keep_their_article(names, tag):
    text = "<h1>Title</h1><p title='the hidden truth'>some text of the article</p><p>Let <math><mi>x</mi></math> be.</p>"
    page = f"<body><nav>a b</nav><{tag} {names}>{text}<p class='sidebar-left'>no</p></{tag}><div class='site-footer'>no</div><div class='post-comments'><p>no</p></div></body>"
    assert H.main_text(page) == "Title\nsome text of the article\nLet x be."


@pytest.mark.parametrize("names", ["hidden", "aria-hidden='true'", "style='color: red; display : none'", "class=sidebar", "id='left-sidebar'", "class='cookie-notice'", "class='ad-slot'", "class=siteFooter", "role=complementary", "class='main-nav'"])
def test_names_of_clutter(names):
    assert H.main_text(f"<body><div {names}><p>no</p></div><div><h1>Title</h1><p>some text</p></div></body>") == "Title\nsome text"


def test_a_form_around_the_page_is_no_clutter():
    assert H.main_text("<form><h1>Title</h1><p>some text</p><form><p>mail</p></form></form>") == "Title\nsome text"


def test_density_leaves_out_clutter_without_names():
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    right = size = whole = 0
    for _ in range(100):
        own = [sentence(rng.randint(30, 90)) for _ in range(rng.randint(3, 8))]
        page = f"<body><div>{''.join(f'<a href=#>{sentence(2)}</a>' for _ in range(8))}</div><div>{sentence(8)}</div><div>{''.join(f'<p>{p}</p>' for p in own)}</div><div>{sentence(9)}</div></body>"
        found = H.main_text(page).split("\n")
        right += sum(len(x) for x in found if x in own)
        size += sum(map(len, found))
        whole += sum(map(len, own))
    assert right >= 0.97 * size and right >= 0.98 * whole


@pytest.mark.parametrize("unit", ["<a ", "<!a ", "<a b='", '<a "> " ', "<a ' > \" ", "<", "<p hidden   "])
def test_broken_tags_take_linear_time(unit):
    start = time.process_time()
    H.main_text(unit * (1_000_000 // len(unit)))
    H.main_text(unit * (1_000_000 // len(unit)) + ">")
    assert time.process_time() - start < 12


def test_nested_blocks_take_linear_time():
    start = time.process_time()
    assert H.main_text("<div>" * 20_000 + "<p>deep text" + "</div>" * 20_000) == "deep text"
    assert H.main_text("<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"
    assert time.process_time() - start < 3


def test_deep_and_long():
    assert H.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert len(H.main_text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "clash"), (1, "u", None, "clash"), (2, None, "", "clash")], "page_id bigint, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.extract_text(pages).collect()) == [(1, "", 0), (1, "a", 1), (2, "", 0)]
    assert H.extract_text(pages.limit(0)).count() == 0
