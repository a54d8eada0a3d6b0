"""The derived schema of constructed pages: stable fields, lists, types, keys and labels."""

import random

from harrow.functions.capture import Capture
from harrow.functions.html import Page
from harrow.operators import pages
from harrow.plans import registry


def profile(k: int, extra: str = "") -> str:
    items = "".join(
        f'<div class="card"><a href="/v/{700000 + 10 * k + i}">open</a><img src="/c{k}{i}.png"><span>{i}.{k}K</span><span>by {k}</span>{"<em>new</em>" if k == 1 else ""}</div>' for i in range(4)
    )
    return (
        f"<html><head><title>{k}</title></head><body><header><h1>Site {k}</h1></header><nav><ul><li><a href=/a{k}>a</a></li><li><a href=/b>b</a></li><li><a href=/c>c</a></li></ul></nav>"
        f'<div><h1 data-e2e="user-title">User {k} &amp; co</h1><img class="avatar" src="/me.png"><b data-e2e="likes-count">{k}.5K</b><b data-e2e="likes">Likes</b><i data-e2e="fans-count">many {k}</i><i data-e2e="fans">Fans</i>'
        f'<p class="bio" hidden>{k}</p><div class="wrap">around <h2>Part <small>{k}</small></h2></div>{extra}</div><div>{"".join(f"<{t}><a class=hash href=/t>#{k}{t}</a></{t}>" for t in ("p", "div", "em"))}</div>'
        f'<section id="grid">{items}</section><p>plain {k}</p><footer>foot {k}</footer></body></html>'
    )


def rows_of(spark, tmp_path, given):
    spark.createDataFrame(given, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = registry.QUERIES["derived_schema"](spark, str(tmp_path)).collect()
    return {(r["view"], r["list"], r["selector"], r["type"]): r for r in found}, found


def test_fields_lists_types_keys_labels(spark, tmp_path):
    given = [(k, f"https://h/en/{k}", profile(k, '<span id="only">x</span>' if k == 2 else "")) for k in (1, 2, 3)]
    given += [(9, "https://h/de/9", profile(9)), (10, "https://h/es/1", profile(1)), (11, "https://h/es/2", ""), (12, None, "<h2>a</h2>"), (13, None, None)]
    by, found = rows_of(spark, tmp_path, given)
    en = {k[1:]: r for k, r in by.items() if k[0] == "en"}
    assert [(r["selector"], r["type"], r["varies"], r["label_text"]) for r in sorted((r for r in en.values() if r["list"] is None), key=lambda r: r["place"])] == [
        ('h1[data-e2e="user-title"]', "string", True, None),
        ("img.avatar", "url", False, None),  # an image stays a field where it is the same everywhere
        ('b[data-e2e="likes-count"]', "count", True, "Likes"),
        ('i[data-e2e="fans-count"]', "string", True, None),  # no count, no label
        ("small", "count", True, None),  # the innermost of large texts
        ("a.hash", "list", True, None),
    ]
    assert {(r["selector"], r["kind"], r["type"], r["json_type"], r["key"]) for r in en.values() if r["list"] == "div.card"} == {
        ("", "item", "list", "array", "id"),
        ("a", "link", "id", "string|null", "id"),
        ("a", "link", "url", "string|null", "id"),
        ("img", "image", "url", "string|null", None),
        ("span:nth-of-type(1)", "text", "count", "integer|null", None),
        ("span:nth-of-type(2)", "text", "string", "string|null", None),
    }  # em is in no item of pages 2 and 3
    assert {(r["list"], r["selector"], r["key"]) for r in en.values() if r["list"] not in (None, "div.card")} == {("ul > li", "", "url"), ("ul > li", "a", "url")}
    assert all(r["varies"] for r in found if r["view"] == "de" and r["list"] is None)  # one sample varies by itself
    assert by["de", None, 'b[data-e2e="likes"]', "string"]["label_text"] is None
    assert not [r for r in found if r["view"] in ("es", "")]  # a page without elements is a sample, too
    assert len(found) == len(by)


def test_all_items_and_whole_texts(spark, tmp_path):
    long = "word " * 200
    page = lambda k: f'<body><div class="text">{long}{k}</div><ul>' + "".join(f"<li><a href=/x/{'name' if k == 1 and i == 40 else 123456}>y</a><b>{'no' if k == 0 and i == 41 else 7}</b></li>" for i in range(45)) + "</ul></body>"
    rows, _ = rows_of(spark, tmp_path, [(k, f"http://h/en/{k}", page(k)) for k in range(3)])
    assert rows["en", None, "div.text", "string"]["varies"]
    assert rows["en", "ul > li", "a", "url"]["key"] == "url" and ("en", "ul > li", "b", "string") in rows


def test_pages_without_id_or_with_one_id(spark, tmp_path):
    rows, _ = rows_of(spark, tmp_path, [(None, "http://h/en/1", "<h1>a</h1><h2>x</h2>"), (None, "http://h/en/2", "<h1>b</h1>"), (1, "http://h/de/1", "<h1>a</h1>"), (1, "http://h/de/2", "<h1>b</h1><h2>x</h2>")])
    assert {k: r["varies"] for k, r in rows.items()} == {("en", None, "h1", "string"): True, ("de", None, "h1", "string"): True}


def test_shared_leaves_are_counted_by_item():
    item = lambda n: "<li>" + ("<div>" * 7 + "<a href=/x>x</a>" + "</div>" * 7) * n + "<a href=/y>y</a></li>"
    ((name, _, leaves),) = Capture(Page("<ul>" + item(4) + item(0) * 4 + "</ul>")).lists("http://h/")
    assert name == "ul > li" and {(k, s, len(v)) for (k, s), (_, v) in leaves.items()} == {("link", "a", 5)}  # four alike in one item are no shared leaf


def test_lasting_selectors():
    """What a selector is counted to meet is what the selector engine finds by it; most meet their element alone."""
    draw = random.Random(5)

    def tree(depth: int) -> str:
        name = draw.choice(("div", "p", "b", "h1", "section"))
        own = draw.choice(("", ' class="a b"', ' class="b"', ' id="x1"', ' role="main"', ' data-test="q"', ' class="k9x7z1 c"'))
        return f"<{name}{own}>" + "".join(tree(depth - 1) if depth and draw.random() < 0.7 else "t" for _ in range(draw.randint(1, 4))) + f"</{name}>"

    alone = 0
    for _ in range(60):
        page = Page("<body>" + tree(5) + "</body>")
        found = Capture(page)
        for e in page.all:
            s = found.selectors.stable(e)
            met = page.select(s)
            assert e in met
            alone += len(met) == 1
            assert found.selectors.along(tuple(s.split(" > "))) == met
    assert alone > 500


def test_lists_within_items_and_pages_without_lists(spark):
    inner = "".join(f"<div class=card><h1>c{i}</h1><p><i><a href=/{i}>1</a></i><i><a href=/{i}>2</a></i><i><a href=/{i}>3</a></i></p></div>" for i in range(3))
    p = spark.createDataFrame([(1, "http://h/", f"<main>{inner}<h1>out</h1></main>"), (2, "http://h/", "<ul><li>a</li><li>b</li><li>c</li></ul>"), (3, "http://h/", "<div>" * 3000 + "<h1>x</h1>")], "page_id long, url string, html string")
    got = {(r["page_id"], r["list"], r["selector"]) for r in pages.candidates(p).collect()}
    inside = {"", "h1", "i:nth-of-type(1) > a", "i:nth-of-type(2) > a", "i:nth-of-type(3) > a"}
    assert got == {(1, "div.card", s) for s in inside} | {(1, None, "main > h1"), (3, None, "h1")}
