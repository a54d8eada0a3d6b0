import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.functions import casts, expr, jsonops
from harrow.functions.html import Page, stable_selector, structure


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_casts(spark):
    lit = F.lit
    row = one(spark, casts.count(lit("about 38.2K likes")), casts.count(lit(".")), casts.display_count(lit("38.2K likes")), casts.display_count(lit("1,234")), casts.as_int(lit("12.5")), casts.as_float(lit("3.5x")),
        casts.as_seconds(lit("1:02:03")), casts.as_seconds(lit("1:x")), casts.as_bool(lit("false")), casts.as_bool(lit("0")), casts.capture(lit("v=12;"), r"v=(\d+)"), casts.capture(lit("none"), r"v=(\d+)"), casts.capture(lit("abc"), "b"))
    assert tuple(row) == (38200, None, None, 1234.0, 125, 3.5, 3723.0, None, False, True, "12", None, "b")


def test_urls_and_names(spark):
    base = F.lit("https://www.some-site.example.com/a/b?x=1")
    row = one(spark, casts.as_url(F.lit("/c"), base), casts.as_url(F.lit("../d?e#f"), base), casts.as_url(F.lit("//h/x"), base), casts.site_slug(base), casts.brand(base), casts.view_of_surface(F.lit("interrupt:login-12")), casts.facet_path(F.lit("/videos/3/x")), casts.field_name(F.lit('[data-e2e="video-count"]')), casts.epoch_iso(F.lit(0)))
    assert tuple(row) == ("https://www.some-site.example.com/c", "https://www.some-site.example.com/d?e#f", "https://h/x", "some-site-example-com", "some-site", "login", "/videos/*/x", "videoCount", "1970-01-01T00:00:00.000Z")


def test_pseudonym_is_fnv(spark):
    def short(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 % 2**32
        digits = ""
        while h:
            h, r = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        return digits[:5]

    for text in ("", "creator", "a much longer name"):
        assert one(spark, casts.pseudonym(F.lit(text)))[0] == short(text)


@pytest.mark.parametrize("a,b,same", [("38.2K", "38224", True), ("38.2K", "41000", False), ("#fyp", "fyp", True), (None, "x", True), ("x", None, False), ("abcd", "xx abcd yy", True), ("abc", "xabcx", False)])
def test_values_match(spark, a, b, same):
    assert one(spark, casts.values_match(F.lit(a).cast("string"), F.lit(b).cast("string")))[0] is same


def test_templates_and_conditions(spark):
    scope, model = {"user": F.lit("@Ann B"), "n": F.lit(5)}, {"/n": F.lit(None).cast("string"), "/list": F.array(F.lit(1), F.lit(2)), "/empty": F.lit("")}
    row = one(spark, expr.template("u/{{ user | trimAt | lower | url }}", scope), expr.template("{{n}}", scope), expr.condition({"gte": ["/n", 0]}, scope, model), expr.condition({"lt": ["/missing", 1]}, scope, model),
        expr.condition({"gte": [{"count": "/list"}, 2]}, scope, model), expr.condition({"exists": "/empty"}, scope, model), expr.condition({"eq": ["{{n}}", "5"]}, scope, model), expr.condition({"stalled": 2}, scope, model, stalled=F.lit(2)))
    assert tuple(row) == ("u/ann%20b", 5, True, False, True, False, True, True)
    with pytest.raises(ValueError):
        expr.template("{{ user | shout }}", scope)


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab/~", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab/~", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab/~", min_size=1, max_size=2), values, max_size=3), st.dictionaries(st.text("ab/~", min_size=1, max_size=2), values, max_size=3))
def test_patches_reproduce_the_target(a, b):
    out = json.loads(json.dumps(a))
    for path, value in jsonops.patches(a, b):
        out = jsonops.set_at(out, path, json.loads(json.dumps(value)) if value is not jsonops.ABSENT else value)
    assert jsonops.same(out, b)


def test_appends_give_one_patch_each():
    found = jsonops.patches({"videos": [{"id": 1}], "n": 1}, {"videos": [{"id": 1}, {"id": 2}, {"id": 3}], "n": 2})
    assert sorted(p for p, _ in found) == ["/n", "/videos/1", "/videos/2"]


def test_sanitised():
    out = jsonops.sanitised({"d": "data:image/png;base64," + "A" * 4000, "b": "aB3" * 60, "h": "0f" * 80, "t": "plain text", "l": "x" * 2000, "a": [{"i": k} for k in range(100)], "fingerprint": {"x": 1}})
    assert out["d"].startswith("<image/png data URL, ") and out["b"].endswith("chars omitted>") and out["h"].endswith("chars omitted>")
    assert out["t"] == "plain text" and out["l"].endswith("<+1400 chars>") and len(out["a"]) == 26 and out["fingerprint"] == "<omitted>"


def test_selectors():
    page = Page('<div id=a class="x y"><p>one<p data-k="v1">two</p><ul><li>1<li class=z>2</ul><script id="__d">{"a":{"b":[5]}}</script></div>')
    texts = lambda s: [e.text() for e in page.select(s)]
    assert texts("#a > p") == ["one", "two"] and texts("p[data-k^=v]") == ["two"] and texts("li:nth-of-type(2), li.z") == ["2"] and texts("div.x li:last-child") == ["2"]
    with pytest.raises(ValueError):
        page.select("p::before")
    assert stable_selector(page, page.first("li.z")) == "li.z"
    assert structure(page.root)[0] == "0:div"


def test_page_casts_are_the_column_casts(spark):
    """Both forms of a cast on the same texts; an unknown kind is an error, not a text."""
    rng = random.Random(2)
    texts = ["", "false", "False", "1:02:03", "43", " 01:08 ", "1::2", ":", "1:x", "12.5", "-3 pts", "38.2K", "1,234", "7 b", ".", ",", "..5", "1e3", "nan", "+.5x", "0.5M likes", "x12,3k4", "--5", "5-", "é9"]
    texts += ["".join(rng.choice("0123456789.,:-+ KMBkx") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    rows = df.select("k", *[f(F.col("t")).alias(n) for n, f in casts.CASTS.items()]).orderBy("k").collect()
    for name in casts.CASTS:
        if name == "int":  # more digits than a long holds are null in Spark alone
            continue
        assert [r[name] for r in rows] == [casts.plain(t, name) for t in texts], name
    with pytest.raises(ValueError):
        casts.plain("x", "duration")
    assert casts.plain(None, "seconds") is None and casts.plain("../b", "url", "https://x.example/a/c") == "https://x.example/b"
