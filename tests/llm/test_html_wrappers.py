"""Pages on which the host's wrapper, and not names or elements, decides."""

import pytest

from lexiloom.llm.html_extract import extract_main_text, main_text


def texts(spark, rows, parts=3):
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return {r["page_id"]: r["text"] for r in extract_main_text(table).collect()}


def words(i, j, n=12):
    return " ".join("".join(chr(97 + int(d)) for d in str((i * 31 + j * 17 + k * 7) % 997)) for k in range(n))


@pytest.mark.parametrize("pages", [1, 2, 4, 20])
def test_sections_with_telling_names_stay(spark, pages):
    """Prose of an article's own, at any number of pages."""
    page = (
        '<body><article><h1>T{i}</h1><p>{a}</p><section class="comments-on-policy"><p>{b}</p></section><div class="share-price">{c}</div>'
        '<div id="notice-period"><p>{d}</p></div><div class="related">{e}</div></article></body>'
    )
    rows = [(i, "http://law.example/", page.format(i=i, **{k: words(i, n) for n, k in enumerate("abcde")})) for i in range(pages)]
    got = texts(spark, rows)
    assert got == {i: "\n\n".join([f"T{i}", *(words(i, n) for n in range(5))]) for i in range(pages)}


def test_furniture_with_telling_parts_goes(spark):
    """Link lists, texts the same but for digits, and repeated blocks, where the host's pages have them."""
    page = (
        '<body><article><h1>T{i}</h1><p>{a}</p><div class="share-bar"><a href="/x">to {b}</a> <a href="/y">and {c}</a></div>'
        '<div class="cookie-note">We use {i} cookies</div><div class="thread">{items}</div>'
        '<div class="related"><a href="/r">{d}</a></div></article></body>'
    )
    rows = []
    for i in range(12):
        items = "".join(f'<div class="comment-item"><b>u{j}</b><p>{words(i, 50 + j)}</p></div>' for j in range(4))
        rows.append((i, "http://furniture.example/", page.format(i=i, items=items, **{k: words(i, n) for n, k in enumerate("abcd")})))
    assert texts(spark, rows) == {i: f"T{i}\n\n{words(i, 0)}" for i in range(12)}


STORY = (
    '<body><div class="top"><ul>{menu}</ul></div><div class="story"><h1>Title {i}</h1>{story}</div><div class="discussion">{items}</div>'
    '<div class="foot"><p>Made by the house, in the town</p></div></body>'
)
MENU = "".join(f'<li><a href="/{k}">Part {k}</a></li>' for k in "abcdef")


def story(i):
    return [words(i, j, 20) for j in range(5)]


@pytest.mark.parametrize("pages", [1, 2, 4, 20])
@pytest.mark.parametrize("comments", [2, 12])
@pytest.mark.parametrize("form", ['<div class="entry"><p>{}</p></div>', '<div><b>who</b> wrote<p>{}</p></div>', "<li>{}</li>"])
def test_threads_beside_the_story_go(spark, pages, comments, form):
    rows = []
    for i in range(pages):
        items = "".join(form.format(words(i, 100 + j, 20)) for j in range(comments))
        rows.append((i, "http://story.example/", STORY.format(i=i, menu=MENU, story="".join(f"<p>{p}</p>" for p in story(i)), items=items)))
    assert texts(spark, rows) == {i: "\n\n".join([f"Title {i}", *story(i)]) for i in range(pages)}


def test_sections_beside_an_introduction_stay(spark):
    """Repeated sections with titles of their own, and a title in a block of its own, are the article's."""
    page = '<body><div class="a"><h1>Title {i}</h1><p>{lead}</p></div>{sections}</body>'
    rows, want = [], {}
    for i in range(8):
        parts = [(f"Head {i} {j}", words(i, j, 30)) for j in range(4)]
        sections = "".join(f'<div class="s"><h2>{h}</h2><p>{p}</p></div>' for h, p in parts)
        rows.append((i, "http://parts.example/", page.format(i=i, lead=words(i, 9), sections=sections)))
        want[i] = "\n\n".join([f"Title {i}", words(i, 9), *(x for part in parts for x in part)])
        body = "".join(f"<p>{p}</p>" for p in story(i))
        rows.append((100 + i, "http://split.example/", f'<body><div class="t"><h1>Title {i}</h1></div><div class="m">{body}</div></body>'))
        want[100 + i] = "\n\n".join([f"Title {i}", *story(i)])
    assert texts(spark, rows) == want


@pytest.mark.parametrize("pages", [2, 3, 4])
def test_shared_blocks_of_few_pages(spark, pages):
    """Without a container and beside headings of its own, the page's menu and foot are what all pages share."""
    page = '<body><div><ul>{menu}</ul></div><h1>Title {i}</h1><p>By one writer</p>{story}<div>Made by the house</div></body>'
    rows = [(i, "http://few.example/", page.format(i=i, menu=MENU, story="".join(f"<p>{p}</p>" for p in story(i)))) for i in range(pages)]
    assert texts(spark, rows) == {i: "\n\n".join([f"Title {i}", "By one writer", *story(i)]) for i in range(pages)}


@pytest.mark.parametrize("own", [60, 400])
def test_shared_texts_of_long_pages(spark, own):
    """A text of every page is found however many others the pages hold."""
    shared = [f"Line {k} of the house" for k in "abcde"]
    rows, want = [], {}
    for i in range(40):
        mine = [f"{i}x{j} own" for j in range(own)]
        rows.append((i, "http://long.example/", "<body><article><h1>T" + f"{i}</h1>" + "".join(f"<p>{p}</p>" for p in [*mine, *shared]) + "</article></body>"))
        want[i] = "\n\n".join([f"T{i}", *mine])
    assert texts(spark, rows) == want


def test_the_wrapper_changes_most_pages(spark):
    """The given pages' articles in plain blocks: with what the host's pages share the text is the article, and without it is not."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    pages["host"] = pages["url"].str.extract(r"://([^/]+)")[0]
    rows, want, alone = [], {}, {}
    for r in pages[pages.groupby("host")["host"].transform("size") >= 5].itertuples():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        plain = (
            f'<body><div class="u"><p>House of {r.host}, since long ago and for all of its readers</p></div><div class="v">{article}'
            f'<p>All that is here is of {r.host}</p><div>Read our paper</div></div></body>'
        )
        rows.append((r.page_id, r.url, plain))
        want[r.page_id] = main_text(f"<article>{article}</article>")
        alone[r.page_id] = main_text(plain)
    got = texts(spark, rows)
    assert got == want and len(rows) > 50
    assert sum(alone[i] != want[i] for i in want) > 0.5 * len(want)
