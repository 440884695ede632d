"""Articles over several containers, and names that have a mark among other words."""

import pytest

from millrace.llm import html_text

A, B = "a" * 299 + ".", "b" * 279 + "."


def test_less_dense_siblings_and_loose_text_stay():
    long, short = f"<section>{f'<p>{A}</p>' * 5}</section>", f"<section>{f'<p>{B}</p>' * 3}</section>"
    source = f"<body><ul><li><a href=x>menu</a></li></ul><div>loose <b>text</b> here{long}between{short}<a href=y>more</a></div></body>"
    assert html_text.main_text(source) == "\n".join(["loose text here", *[A] * 5, "between", *[B] * 3])


@pytest.mark.parametrize("part", ['<section id="related-work"><p>x y</p></section>', '<h2 id="social">x y</h2>', '<p class="notice">x y</p>', '<div id="market-share">x y</div>'])
def test_names_with_other_words_stay(part):
    assert html_text.main_text(f"<article><p>one</p>{part}</article>") == "one\nx y"


@pytest.mark.parametrize("part", ['<div class="related-reading"><a href=x>x y</a></div>', '<div class="share-buttons">x y</div>', '<div class="ad">x y</div>', '<p class="hidden">x</p>', '<ul class="comment-list"><li>x y</ul>'])
def test_marks_alone_and_links_go(part):
    assert html_text.main_text(f"<article><p>one</p>{part}</article>") == "one"


@pytest.mark.parametrize("name", ["post share-count", "article-content related-fix", "story alert", "hidden-gem-post", "responsive ad", "entry comment-enabled", "comments"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_no_name_empties_a_page(name, tag):
    source = f'<body><nav><a href=x>menu</a></nav><{tag} class="{name}"><h1>T</h1><p>{A}</p><p>{B}</p></{tag}><div class="ad">buy</div></body>'
    assert html_text.main_text(source) == f"T\n{A}\n{B}"


def test_density_decides_between_marked_parts():
    teasers = "".join(f"<article><a href=x>teaser {k}</a></article>" for k in range(6))
    assert html_text.main_text(f"<body><div>{teasers}</div><div><p>{A}</p><p>{B}</p></div></body>") == f"{A}\n{B}"
    both = f"<article><p>{A}</p></article><article><p>{B}</p></article>"
    assert html_text.main_text(f"<body><div>{both}</div><footer>f</footer></body>") == f"{A}\n{B}"
    comments = f'<div class="comments"><article><p>{B * 3}</p></article></div>'
    assert html_text.main_text(f"<body><article><p>{A}</p></article>{comments}</body>") == A


def test_deep_nesting_takes_linear_time():
    import time

    began = time.perf_counter()
    html_text.main_text("<div>" + "<span>x" * 40_000 + "<p>y</p></i>" * 2000)
    html_text.main_text("<ul>" + "<b>x" * 20_000 + "<li>y" * 2000)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("tag", ["article", "div", "li"])
@pytest.mark.parametrize("n", [1, 4, 40])
def test_comments_go_whatever_their_tag_and_size(tag, n):
    said = "".join(f'<{tag} class="comment" id="comment-{k}"><p>{B}</p></{tag}>' for k in range(n))
    text = f"<p>{A}</p><p>{B}</p>" * 2
    want = "\n".join([A, B] * 2)
    for page in (
        f'<div class="content">{text}</div><section class="comments">{said}</section>', f'<article>{text}<section id="comments"><h3>Said</h3>{said}</section></article>',
        f"<article>{text}</article>{said}", f'<main>{text}<div class="comment-list">{said}</div></main>', f'<div class="sidebar-right">{text}</div><div class="comments">{said}</div>' if n < 4 else f"<div>{text}</div>{said}",
    ):
        assert html_text.main_text(f"<body><nav><a href=x>m</a></nav>{page}</body>") == want


def test_articles_within_an_article_are_no_extent_of_their_own():
    inner = "".join(f"<article><p>{B}</p></article>" for _ in range(5))
    assert html_text.main_text(f"<body><article><p>{A}</p>{inner}</article></body>") == "\n".join([A, *[B] * 5])


def test_layout_names_do_not_take_the_article():
    side = "<ul>" + "".join(f"<li>short {k}</li>" for k in range(60)) + "</ul>"
    page = f'<body><div class="sidebar-right"><div><p>{A}</p><p>{B}</p><p>{A}</p></div></div><div class="widget">{side}</div><p>Imprint</p></body>'
    assert html_text.main_text(page).startswith(f"{A}\n{B}\n{A}") and "short" not in html_text.main_text(page)


def test_short_blocks_between_dense_ones_stay():
    dense, other = f"<div>{f'<p>{A}</p>' * 4}</div>", f"<div>{f'<p>{B}</p>' * 4}</div>"
    page = f"<body><div>{dense}<p>short TAILA.</p><div>x</div><ul><li><a href=x>link</a></li></ul>{other}</div></body>"
    assert html_text.main_text(page) == "\n".join([*[A] * 4, "short TAILA.", "x", *[B] * 4])


def test_open_elements_take_linear_time():
    import time

    for item in ("<dl><dt>x", "<table><tr><td>x", "<ul><li>x"):
        for wrap in ("<div>", "<p>", "<span>"):
            began = time.perf_counter()
            html_text.main_text(item[: item.index(">") + 1] + f"{wrap}{item[item.index('>') + 1 :]}" * 20_000)
            assert time.perf_counter() - began < 5


def test_articles_are_found_without_their_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = sum(html_text.main_text(r.html) == html_text.main_text(r.html.replace("<article", "<div").replace("</article", "</div")) for r in pages if r.html)
    assert same >= 0.99 * len(pages)
