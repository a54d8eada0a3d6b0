"""The registered queries of the harvest library over the given tables, and their oracle SQL.

``events`` stands in for snapshots, units of work, runs and telemetry; ``orders`` and ``lineitem`` for nested records; ``pages``,
``documents`` and ``conversations`` for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import casts, expr, jsonops
from harrow.operators import harvest, monitor, pages, quality, records, stream
from harrow.sources import readers
from harrow.streaming import live

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Fixed value: tasks that the rows of a table go to before costly columns.
SPREAD = 48


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt to tasks by a key, before costly columns: a compressed table of millions of rows is one split, and so one task."""
    return rows.repartition(SPREAD, *key)


def events(spark, d) -> DataFrame:
    e = load(spark, d, "events")
    return e.withColumns({"seq": F.col("event_id"), "ms": F.unix_millis(F.col("ts").cast("timestamp"))})


HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)"

# --- pages ---


@query(rf"""WITH p AS (SELECT page_id, {HOST} AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  len(regexp_extract_all(html, '<li><a href="[^"]*">'))::BIGINT AS links FROM pages),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY host, title ORDER BY page_id) = 1)
SELECT host, count(*)::BIGINT AS n_articles, sum(links)::BIGINT AS n_links FROM f GROUP BY host""")
def harvest_per_host(spark, d):
    """Distinct articles and their links per host."""
    a = pages.articles(load(spark, d, "pages"))
    first = records.first_wins(a, F.concat_ws("\n", "host", "title"), ["page_id"])
    return first.groupBy("host").agg(F.count("*").alias("n_articles"), F.sum(F.size("links")).cast("long").alias("n_links"))


VIEWS = {
    "anchor": {"match": {"path": r"^/en/\d+", "selector": "article h1"}, "model": {"/title": {"sel": "title"}, "/nav": {"each": "nav li", "key": "href", "fields": {"href": {"sel": "a", "get": "attr:href"}, "label": {"sel": "a"}}}}},
    "foreign": {"match": {"path": "^/(fr|de|es)/"}, "model": {"/title": {"sel": "h1"}}},
    "consent": {"interrupt": True, "match": {"selector": "div.ad"}, "model": {"/text": {"sel": "div.ad"}}},
}


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]*/en/[0-9]+') THEN 'anchor' WHEN regexp_matches(url, '^[a-z]+://[^/]*/(fr|de|es)/') THEN 'foreign' END AS view,
  (CASE WHEN contains(html, '<div class="ad">') THEN 1 ELSE 0 END)::INTEGER AS n_interrupts FROM pages""")
def page_snapshots(spark, d):
    """Views by path and selector, interrupts apart."""
    s = pages.snapshots(load(spark, d, "pages"), VIEWS)
    return s.select("page_id", "view", F.size("interrupts").alias("n_interrupts"))


@query(r"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), 1) AS i FROM pages),
f AS (SELECT page_id, href, min(i) AS i FROM x GROUP BY ALL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS pos, href FROM f""")
def page_lists(spark, d):
    """Items of a list with duplicate keys dropped (E5)."""
    return pages.list_rows(load(spark, d, "pages"), "nav", VIEWS["anchor"]["model"]["/nav"]).select("page_id", "pos", "href")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS li, len(regexp_extract_all(html, '<p>'))::BIGINT AS p, len(regexp_extract_all(html, '<a '))::BIGINT AS a,
  len(regexp_extract_all(html, '<article>'))::BIGINT AS article FROM pages""")
def page_elements(spark, d):
    """The element table, counted by tag."""
    e = pages.elements(load(spark, d, "pages"))
    return e.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in ("li", "p", "a", "article")])


@query(r"""WITH p AS (SELECT html, regexp_matches(url, '^[a-z]+://[^/]*/en/[0-9]+') AS en, regexp_matches(url, '^[a-z]+://[^/]*/(fr|de|es)/') AS other FROM pages),
x AS (SELECT 'anchor' AS view, '/nav' AS pointer, 'list' AS kind, len(regexp_extract_all(html, '<li>')) AS hits FROM p WHERE en OR NOT other UNION ALL SELECT 'anchor', '/title', 'field', 1 FROM p WHERE en OR NOT other UNION ALL SELECT 'foreign', '/title', 'field', len(regexp_extract_all(html, '<h1')) FROM p WHERE other)
SELECT view, pointer, kind, count(*) AS pages, sum(hits)::BIGINT AS hits FROM x GROUP BY ALL""")
def page_facets(spark, d):
    """Coverage of each pointer of a page's view."""
    return pages.facets(load(spark, d, "pages"), VIEWS).groupBy("view", "pointer", "kind").agg(F.count("*").alias("pages"), F.sum("hits").alias("hits"))


@query(r"""SELECT page_id, 'anchor' AS view, (2 + 2)::BIGINT AS total, 4::BIGINT AS resolved, 0::BIGINT AS broken FROM pages WHERE contains(html, '<li>')
UNION ALL SELECT page_id, 'anchor', 4, 1, 0 FROM pages WHERE NOT contains(html, '<li>')
UNION ALL SELECT page_id, 'missing', 1, 0, 1 FROM pages""")
def selector_hits(spark, d):
    """Fields that resolve, and broken ones; lists and items of empty lists are not broken."""
    views = {"anchor": VIEWS["anchor"], "missing": {"model": {"/x": {"sel": "section.none"}}}}
    return pages.broken(pages.selector_hits(load(spark, d, "pages"), views))


@query(r"""SELECT page_id, CASE WHEN contains(html, '<table') THEN 'table' WHEN contains(html, '&copy; m.') THEN '© m\.' END AS hit FROM pages""")
def blocked_pages(spark, d):
    """The first blocking selector or text of each page."""
    return pages.blocked(load(spark, d, "pages"), ["table"], [r"© m\."])


@query("""SELECT 'cookie-banner' AS kind, count(DISTINCT contains(html, '<div class="ad">')) AS n FROM pages WHERE contains(html, '<div class="ad">') HAVING count(*) > 0""")
def page_overlays(spark, d):
    """Dialogs over pages, made from each page's advert."""
    p = load(spark, d, "pages").withColumn("html", F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="ad" role="dialog"><button>Close</button> Accept cookies ')))
    found = pages.overlays(p)
    return records.first_wins(found, F.concat_ws("|", "kind", "selector"), ["page_id"]).groupBy("kind").agg(F.count("*").alias("n"))


@query()
def page_structures(spark, d):
    """Structure tokens, their SimHash, thresholds per view and drifted pages."""
    p = load(spark, d, "pages")
    s = pages.structures(p).join(p.select("page_id", "url"), "page_id").withColumn("view", F.concat(F.lit("v"), F.regexp_extract("url", r"//[^/]*/([a-z]+)/", 1)))
    samples = s.select("view", F.col("page_id").alias("sample"), "shape")
    least = monitor.thresholds(samples, monitor.least_similarity(samples))
    reference = samples.groupBy("view").agg(F.min_by("shape", "sample").alias("shape")).join(least, "view")
    checks = monitor.drift_checks(s.select("view", "url", "shape", F.col("page_id").alias("seq")), reference)
    return checks.select("view", "url", F.round("similarity", 6).alias("similarity"), "min_similarity", "drifted")


@query()
def page_simhash(spark, d):
    s = pages.structures(load(spark, d, "pages"))
    return s.select("page_id", monitor.simhash(casts.normalised_shape(F.col("shape"))).alias("simhash"), F.size("shape").alias("tokens"))


@query()
def repeated_groups(spark, d):
    """Repeated siblings and the leaves that most of them share."""
    p = load(spark, d, "pages")
    top = harvest.repeated_groups(pages.elements(p))
    return top.join(pages.group_fields(p).groupBy("page_id", "parent", "sig").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields")), ["page_id", "parent", "sig"], "left").select("page_id", "parent", "sig", F.col("n").alias("items"), "place", "fields")


@query(r"""WITH x AS (SELECT regexp_extract(url, '//[^/]*/([a-z]+)/', 1) AS view, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS ps FROM pages),
y AS (SELECT view, list_filter(ps, lambda s: s <> '') AS ps FROM x), z AS (SELECT view, len(ps) AS depth, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS pos FROM y),
s AS (SELECT view, depth, pos, CASE WHEN min(part) = max(part) AND NOT regexp_matches(min(part), '[0-9]{5,}') THEN regexp_replace(min(part), '([.*+?^${}()|\[\]\\])', '\\\1', 'g') WHEN bool_and(starts_with(part, '@')) THEN '@[^/]+' WHEN bool_and(regexp_full_match(part, '[0-9]+')) THEN '\d+' ELSE '[^/]+' END AS t FROM z GROUP BY ALL)
SELECT view, depth::INTEGER AS depth, '^/' || string_agg(t, '/' ORDER BY pos) || '/?$' AS pattern FROM s GROUP BY view, depth""")
def path_patterns(spark, d):
    """Path pattern of each view."""
    p = load(spark, d, "pages").select("url", F.regexp_extract("url", r"//[^/]*/([a-z]+)/", 1).alias("view"))
    return harvest.path_patterns(p)


@query()
def derived_schema(spark, d):
    """Stable fields with types and labels, and stable lists with keys and typed fields, across all pages of a language.
    A page is told by its id and address, so that one without an id is a sample, too."""
    p = load(spark, d, "pages").withColumn("url", F.coalesce("url", F.lit("")))
    of_page = [F.regexp_extract("url", r"//[^/]*/([a-z]+)/", 1).alias("view"), F.struct("page_id", "url").alias("sample")]
    found = records.cut(pages.candidates(p).select(*of_page, "list", "selector", "kind", "attr", "many", "value", "i"), "candidates")
    schema = harvest.derived_schemas(found, p.select(*of_page))
    return schema.select("view", "list", "place", "selector", "kind", "varies", "type", F.array_join("json_type", "|").alias("json_type"), "key", "label_text")


@query(r"""WITH x AS (SELECT page_id, len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS links FROM pages) SELECT page_id, round((1 + links)::DOUBLE / (2 + links), 6) AS share, (2 + links)::BIGINT AS n FROM x""")
def grounding(spark, d):
    """Share of extracted values that are visible on their page."""
    p = load(spark, d, "pages")
    e = pages.elements(p).select("page_id", "i", "text", F.col("attrs")["src"].alias("src"), F.col("attrs")["href"].alias("href"))
    a = pages.articles(p)
    values = a.select("page_id", F.explode(F.array(F.struct(F.col("heading").alias("value"), F.lit("string").alias("kind")), F.struct(F.lit("no such text").alias("value"), F.lit("string").alias("kind")))).alias("v")).select("page_id", "v.*")
    links = a.select("page_id", F.explode("links").alias("value"), F.lit("url").alias("kind"))
    return quality.grounded_share(values.unionByName(links), quality.percepts(e), ["page_id"]).select("page_id", F.round("share", 6).alias("share"), "n")


# --- casts and expressions ---


@query(r"""SELECT o_orderkey, (floor(((o_orderkey % 1000) + (o_orderkey % 10) / 10.0) * 1000 + 0.5))::BIGINT AS n, (floor(((o_orderkey % 1000) + (o_orderkey % 10) / 10.0) * 1000 + 0.5))::DOUBLE AS shown,
  ((o_orderkey % 1000) * 10 + o_orderkey % 10)::BIGINT AS digits, (o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 59)::DOUBLE AS seconds, o_orderstatus <> 'F' AS flag,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'ORD' || o_orderkey % 7 END AS captured FROM orders""")
def scalar_casts(spark, d):
    """count, display count, int, seconds, bool and capture."""
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    text = F.concat((k % 1000).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("K"))
    clock = F.concat_ws(":", (k % 24).cast("string"), (k % 60).cast("string"), (k % 59).cast("string"))
    code = F.when(k % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("<ORD"), (k % 7).cast("string"), F.lit(">")))
    return o.select("o_orderkey", casts.count(text).alias("n"), casts.display_count(text).alias("shown"), casts.as_int(text).alias("digits"), casts.as_seconds(clock).alias("seconds"),
        casts.as_bool(F.when(F.col("o_orderstatus") == "F", "false").otherwise(F.col("o_orderstatus"))).alias("flag"), casts.capture(code, r"<(ORD\d)>").alias("captured"))


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(lower({HOST}), '^www\.', ''), '[^a-z0-9]+', '-', 'g') AS slug, {HOST} || '/x?y=' || page_id AS link,
  regexp_replace('/videos/' || page_id || '/x', '/[0-9]+(/|$)', '/*\1') AS facet, 'login' AS view FROM pages""")
def names_from_urls(spark, d):
    """Slugs, resolved links, facet paths and surface views."""
    p = load(spark, d, "pages")
    link = casts.as_url(F.concat(F.lit("/x?y="), F.col("page_id").cast("string")), F.col("url"))
    return p.select("page_id", casts.site_slug(F.col("url")).alias("slug"), F.regexp_replace(link, "^[a-z]+://", "").alias("link"), casts.facet_path(F.concat(F.lit("/videos/"), F.col("page_id").cast("string"), F.lit("/x"))).alias("facet"),
        casts.view_of_surface(F.concat(F.lit("interrupt:login-"), F.col("page_id").cast("string"))).alias("view"))


@query(r"""SELECT c_custkey, 'c/' || lower(c_name) || '?s=' || c_mktsegment AS url, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS label, c_nationkey::BIGINT AS nation FROM customer""")
def template_routes(spark, d):
    """Templates, filters and fallback chains to nested fields."""
    scope = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}
    model = {"/shown": F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))}
    route = expr.map_route({"link.url": "c/{{ name | lower }}?s={{segment}}", "label": "/shown || {{ segment }}", "nation": "{{ nation }}"}, scope, model)
    return load(spark, d, "customer").select("c_custkey", route.alias("r")).select("c_custkey", F.col("r.link.url").alias("url"), F.col("r.label").alias("label"), F.col("r.nation").cast("long").alias("nation"))


@query(r"""SELECT o_orderkey, (o_totalprice >= 100000 AND o_orderstatus <> 'F') OR o_orderpriority = '1-URGENT' AS rule, FALSE AS missing FROM orders""")
def conditions(spark, d):
    """Conditions over a model; a missing pointer never compares."""
    model = {"/price": F.col("o_totalprice"), "/status": F.col("o_orderstatus")}
    scope = {"priority": F.col("o_orderpriority")}
    rule = {"or": [{"and": [{"gte": ["/price", 100000]}, {"not": {"eq": ["/status", "F"]}}]}, {"eq": ["{{priority}}", "1-URGENT"]}]}
    return load(spark, d, "orders").select("o_orderkey", expr.condition(rule, scope, model).alias("rule"), expr.condition({"lt": ["/none", 5]}, scope, model).alias("missing"))


SCHEMA = {"type": "object", "required": ["c_name"], "properties": {"c_name": {"type": "string"}, "c_acctbal": {"type": ["number", "null"], "minimum": 0, "maximum": 9000}, "c_mktsegment": {"type": "string", "enum": ["BUILDING", "MACHINERY"]}}}


@query(r"""SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'data/c_acctbal must be >= 0' END, CASE WHEN c_acctbal > 9000 THEN 'data/c_acctbal must be <= 9000' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'data/c_mktsegment must be one of the allowed values' END) AS warnings FROM customer""")
def record_validation(spark, d):
    """Records against a JSON Schema: warned of and kept."""
    c = load(spark, d, "customer")
    return c.select("c_custkey", F.array_join(expr.violations(SCHEMA, F.struct("c_name", "c_acctbal", "c_mktsegment")), "; ").alias("warnings"))


@query(r"""SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, event_type || '' AS kind FROM events""")
def json_pointers(spark, d):
    """Pointer reads of JSON bodies."""
    return load(spark, d, "events").select("event_id", jsonops.pointer_get(F.col("props"), "/k", "long").alias("k"), F.col("event_type").alias("kind"))


@query(r"""SELECT o_orderkey, '{"b":{"x":' || o_orderkey || '},"l":[1,2]}' AS canonical, (o_orderkey::VARCHAR) AS flat_x, '1 2' AS flat_l, '{"a":' || o_orderkey || '}' AS found FROM orders""")
def json_forms(spark, d):
    """Canonical and flat forms, and JSON in free text."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit('{ "l": [1, 2], "b": {"x": '), k, F.lit("} }"))
    flat = jsonops.flatten(text)
    return load(spark, d, "orders").select("o_orderkey", jsonops.canonical(text).alias("canonical"), flat["b.x"].alias("flat_x"), flat["l"].alias("flat_l"), jsonops.first_json(F.concat(F.lit('Sure: ```json\n{"a": '), k, F.lit("}\n``` ok"))).alias("found"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || '… <+' || (length(text) - 600) || ' chars>' ELSE text END AS shown FROM documents
WHERE NOT regexp_matches(text, '^[A-Za-z0-9+/_-]{160,}={0,2}$')""")
def sanitised_texts(spark, d):
    """Texts for a model's eyes: long ones cut with their remainder."""
    return load(spark, d, "documents").where(~F.col("text").rlike("^[A-Za-z0-9+/_-]{160,}={0,2}$")).select("doc_id", jsonops.sanitised_text(F.col("text")).alias("shown"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\b(\d{4})\d{8,}(\d{3})\b', '\1…\2', 'g'), 'https?://[^\s)]+', 'https://example.invalid/…', 'g') AS shown FROM conversations WHERE NOT contains(text, '@')""")
def scrubbed_texts(spark, d):
    """Free text without long ids and addresses."""
    c = load(spark, d, "conversations").where(~F.col("text").contains("@"))
    return c.select("conv_id", "turn", harvest.scrubbed(F.col("text")).alias("shown"))


def fnv_sql(text: str) -> str:
    """FNV-1a over an ASCII text in SQL."""
    return f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::HUGEINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


def base36_sql(number: str) -> str:
    """The first five digits of a number to the base 36 in SQL."""
    return f"left(ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ({number} // (36 ** i)::HUGEINT % 36 + 1)::INT, 1)), ''), '0'), 5)"


@query(f"""WITH h AS (SELECT c_custkey, c_mktsegment, {fnv_sql("c_name")} AS a, {fnv_sql("'https://site.example/u/' || c_custkey")} AS b FROM customer)
SELECT c_custkey, 'creator_' || {base36_sql("a")} AS who, 'https://example.invalid/' || {base36_sql("b")} AS link, c_mktsegment AS count FROM h""")
def redacted_records(spark, d):
    """Records by key: names, addresses and ids as pseudonyms, numbers as they are."""
    c = load(spark, d, "customer")
    return c.select("c_custkey", harvest.redacted(F.col("c_name"), F.lit("authorName")).alias("who"), harvest.redacted(F.concat(F.lit("https://site.example/u/"), F.col("c_custkey").cast("string")), F.lit("link")).alias("link"), harvest.redacted(F.col("c_mktsegment"), F.lit("playCount")).alias("count"))


@query(r"""SELECT event_id, least(15000, 1000 * pow(2, event_id % 6))::BIGINT AS delay_ms, floor(least(15000, 1000 * pow(2, event_id % 6)) * 0.7 + 0.5)::BIGINT AS least_ms, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM events""")
def delays_and_times(spark, d):
    """Backoff delays and ISO times."""
    b = casts.backoff(F.col("event_id") % 6 + 1)
    return events(spark, d).select("event_id", b["delay_ms"].alias("delay_ms"), b["least_ms"].alias("least_ms"), casts.epoch_iso(F.floor(F.col("ms") / 1000)).alias("iso"))


@query(r"""SELECT vec_id, bit_count(xor(vec_id::BIGINT * 7919, vec_id::BIGINT * 104729))::INTEGER AS bits FROM embeddings""")
def hamming_bits(spark, d):
    return load(spark, d, "embeddings").select("vec_id", casts.hamming(F.col("vec_id").cast("long") * 7919, F.col("vec_id").cast("long") * 104729).cast("int").alias("bits"))


# --- records and ledger ---


@query(r"""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def first_wins_records(spark, d):
    """First record of each key."""
    e = load(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    halves = records.union_routes([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])
    return records.first_wins(halves, F.concat_ws("|", "user_id", "event_type"), ["event_id", "route_no"]).drop("route_no")


@query(r"""SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 3 = 1 AND value > 50""")
def resumed_records(spark, d):
    """Keys of a second run that an earlier one has not stored."""
    e = load(spark, d, "events")
    return records.not_stored(e.where("event_id % 3 = 0").select("user_id", "event_type").distinct(), e.where("event_id % 3 = 1 AND value > 50"), ["user_id", "event_type"])


@query(r"""WITH a AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 1)
SELECT side, user_id, event_type, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL""")
def dataset_differences(spark, d):
    """What one dataset has more often than another."""
    e = load(spark, d, "events")
    half = lambda k: e.where(f"event_id % 2 = {k}").select("user_id", "event_type")
    return records.datasets_equal(half(0), half(1)).groupBy("side", "user_id", "event_type").agg(F.count("*").alias("n"))


STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'running' END"
LATEST_SQL = f"""u AS (SELECT user_id::VARCHAR AS id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS type, arg_max({STATUS_SQL}, event_id) AS s, arg_max((epoch_us(ts) // 1000), event_id) AS at_ms FROM events GROUP BY user_id),
v AS (SELECT id, type, CASE s WHEN 'running' THEN 'failed' ELSE s END AS status, CASE WHEN s = 'running' THEN 'interrupted' END AS error, at_ms::BIGINT AS at_ms FROM u)"""


def ledger(spark, d) -> DataFrame:
    status = F.expr(STATUS_SQL)
    return events(spark, d).select(F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("type"), status.alias("status"), F.lit(None).cast("string").alias("error"), F.col("ms").alias("at_ms"), "seq")


@query(f"WITH {LATEST_SQL} SELECT * FROM v")
def ledger_latest(spark, d):
    """Latest state of each unit, interrupted ones failed."""
    return records.latest_units(ledger(spark, d)).select("id", "type", "status", "error", "at_ms")


@query(f"WITH {LATEST_SQL} SELECT type, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM v GROUP BY type")
def ledger_totals(spark, d):
    """Units per type and status (A1)."""
    return records.totals(records.latest_units(ledger(spark, d)))


@query(f"WITH {LATEST_SQL} SELECT id, status, at_ms FROM v ORDER BY at_ms DESC, id LIMIT 15")
def ledger_recent(spark, d):
    """The most recent units."""
    u = records.latest_units(ledger(spark, d)).withColumns({"finishedAt": F.col("at_ms"), "startedAt": F.lit(None).cast("long")})
    return records.recent(u).select("id", "status", "at_ms")


@query(f"WITH {LATEST_SQL} SELECT DISTINCT user_id::VARCHAR AS id FROM events WHERE user_id::VARCHAR NOT IN (SELECT id FROM v WHERE status IN ('done', 'skipped'))")
def planned_not_done(spark, d):
    """Planned units without a completed one."""
    own = ledger(spark, d)
    return records.planned_not_done(own.select("id").distinct(), records.latest_units(own))


@query(f"SELECT event_id AS seq, user_id::VARCHAR AS id, count(*) FILTER ({STATUS_SQL} = 'running') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM events")
def unit_attempts(spark, d):
    """Attempt numbers."""
    return records.attempts(ledger(spark, d)).select("seq", "id", "attempt")


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 1 + user_id % 3""")
def capped_records(spark, d):
    """Per-run caps from inputs."""
    return records.capped(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.lit(1) + F.col("user_id") % 3)


# --- stream ---


def snapshots(spark, d) -> DataFrame:
    """Each user is a run, each event a snapshot: its type the view, an eighth of its key the path."""
    path = F.concat(F.lit("/"), (F.get_json_object("props", "$.k").cast("long") % 2).cast("string"))
    return events(spark, d).select(F.col("user_id").alias("run_id"), "seq", F.col("ms").alias("ts"), F.col("event_type").alias("view"), path.alias("path"), path.alias("url"), F.col("props").alias("model"))


SNAP_SQL = "s AS (SELECT user_id AS run_id, event_id AS seq, (epoch_us(ts) // 1000) AS ts, event_type AS view, '/' || (json_extract(props, '$.k')::BIGINT % 2) AS path, props AS model FROM events)"
SURF_SQL = f"""{SNAP_SQL}, t AS (SELECT *, lag(view) OVER w AS pv, lag(path) OVER w AS pp, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
o AS (SELECT *, CASE WHEN n = 1 OR pv <> view OR pp <> path THEN 1 ELSE 0 END AS opens FROM t),
f AS (SELECT *, view || '-' || sum(opens) OVER (PARTITION BY run_id ORDER BY seq) AS surface_id FROM o)"""


@query(f"WITH {SURF_SQL} SELECT run_id, surface_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM f GROUP BY ALL")
def surface_segments(spark, d):
    """Surfaces of each run."""
    return stream.surfaces(snapshots(spark, d)).groupBy("run_id", "surface_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


@query(f"""WITH {SNAP_SQL}, a AS (SELECT *, max(ts) OVER (PARTITION BY run_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
b AS (SELECT * FROM a WHERE m IS NULL OR ts >= m), c AS (SELECT *, lag(path || view || model) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM b)
SELECT run_id, seq FROM c WHERE before IS NULL OR before <> path || view || model""")
def fresh_snapshots(spark, d):
    """Stale and unchanged snapshots dropped."""
    return stream.fresh_snapshots(snapshots(spark, d)).select("run_id", "seq")


@query(f"""WITH {SURF_SQL}, l AS (SELECT *, lag(model) OVER (PARTITION BY run_id, surface_id ORDER BY seq) AS before, lead(opens) OVER (PARTITION BY run_id ORDER BY seq) AS nx FROM f)
SELECT kind, count(*) AS n FROM (SELECT 'createSurface' AS kind FROM l WHERE opens = 1 UNION ALL SELECT 'updateDataModel' FROM l WHERE opens = 1 UNION ALL SELECT 'updateDataModel' FROM l WHERE opens = 0 AND before <> model UNION ALL SELECT 'deleteSurface' FROM l WHERE nx = 1) GROUP BY kind""")
def surface_messages(spark, d):
    """Messages that the snapshots of all runs give."""
    return stream.surface_messages(snapshots(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {SURF_SQL} SELECT run_id, surface_id, replace(arg_max(model, seq), ' ', '') AS model FROM f GROUP BY ALL")
def folded_surfaces(spark, d):
    """Messages folded back to the final state of each surface."""
    folded = stream.fold_surfaces(stream.surface_messages(snapshots(spark, d)))
    return folded.select("run_id", "surface_id", "model")


@query("""SELECT user_id AS run_id, '/' || event_type AS path, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def folded_pointers(spark, d):
    """The last write of each pointer."""
    w = events(spark, d).select(F.col("user_id").alias("run_id"), "seq", F.concat(F.lit("/"), "event_type").alias("path"), "value")
    return stream.fold_flat(w, ["run_id"])


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS last_view, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def as_of_views(spark, d):
    """The newest value of each view at every event."""
    return stream.last_of_each(events(spark, d), "user_id", "event_type", ["view", "purchase"], "value", ["seq"]).select("event_id", "user_id", "last_view", "last_purchase")


@query("""WITH m AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'purchase')
SELECT m.event_id AS mark_id, (SELECT max((epoch_us(e.ts) // 1000)) FROM events e WHERE e.user_id = m.user_id AND e.event_type = 'click' AND (epoch_us(e.ts) // 1000) <= m.t)::BIGINT AS last_click FROM m""")
def newest_before(spark, d):
    """The newest click at or before each purchase."""
    e = events(spark, d).select("user_id", F.col("ms").alias("t"), F.col("event_type").alias("lane"), F.col("ms").alias("payload"))
    marks = events(spark, d).where("event_type = 'purchase'").select("user_id", F.col("ms").alias("t"), F.col("event_id").alias("mark_id"))
    return monitor.newest_before(e, marks, ["user_id"], "lane", ["click"], "payload").select("mark_id", "last_click")


@query("""WITH x AS (SELECT o_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS item_no FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey AS run_id, item_no::INTEGER AS item_no, l_partkey AS part FROM x WHERE item_no < 2""")
def item_records(spark, d):
    """Items of nested records, the head of each list (P5)."""
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("order-1").alias("surface_id")).join(lines, "run_id")
    return stream.item_records(o, F.col("items"), F.lit(2)).select("run_id", "item_no", F.col("item.l_partkey").alias("part"))


@query("""WITH x AS (SELECT user_id AS run_id, event_id AS seq, value > 50 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
y AS (SELECT *, n - row_number() OVER (PARTITION BY run_id ORDER BY n) AS g FROM x WHERE hit)
SELECT run_id, min(seq) AS from_seq, max(seq) AS to_seq FROM y GROUP BY run_id, g""")
def interrupt_intervals(spark, d):
    """Stretches of snapshots that show an interrupt."""
    p = events(spark, d).select(F.col("user_id").alias("run_id"), "seq", F.when(F.col("value") > 50, F.array(F.lit("banner"))).otherwise(F.array().cast("array<string>")).alias("interrupts"))
    return stream.interrupt_intervals(p).select("run_id", "from_seq", "to_seq")


@query("""WITH x AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
y AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM x)
SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1)::INTEGER AS repeat FROM y""")
def stalls(spark, d):
    """How often a value has repeated in a row."""
    return stream.islands(events(spark, d), ["user_id"], ["event_type"], ["seq"]).select("user_id", "event_id", "repeat")


@query("""SELECT user_id AS run_id, event_id AS seq, greatest(0, coalesce(lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 60000 - (epoch_us(ts) // 1000), 0))::BIGINT AS wait_ms FROM events""")
def spacing_audit(spark, d):
    """Waits that a least distance would have needed."""
    ops = events(spark, d).select(F.col("user_id").alias("run_id"), "seq", F.col("ms").alias("at"))
    return monitor.waits(ops, 60_000).select("run_id", "seq", F.col("wait_ms").cast("long").alias("wait_ms"))


@query("""WITH RECURSIVE x AS (SELECT user_id, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, n, [s] AS states, [1] AS visits FROM x WHERE n = 1
  UNION ALL SELECT x.user_id, x.n, CASE WHEN list_contains(states, s) THEN states[1:list_position(states, s)] ELSE list_append(states, s) END,
    CASE WHEN list_contains(states, s) THEN list_append(visits[1:list_position(states, s) - 1], visits[list_position(states, s)] + 1) ELSE list_append(visits, 1) END
  FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1)
SELECT user_id AS run_id, array_to_string(list_transform(range(1, len(states) + 1), lambda k: states[k] || ':' || visits[k]), '>') AS crumbs FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def breadcrumbs(spark, d):
    """States in order, cut back on re-entry."""
    return stream.breadcrumb(events(spark, d).select(F.col("user_id").alias("run_id"), "seq", F.col("event_type").alias("state")))


@query("""WITH x AS (SELECT user_id, event_id, length(props) AS bytes, row_number() OVER w AS n, sum(length(props)) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id FROM x WHERE (n <= 30 AND s <= 200) OR n = 1""")
def newest_within(spark, d):
    """The newest rows within a number and a budget of bytes."""
    e = load(spark, d, "events").select("user_id", "event_id", F.length("props").alias("bytes"))
    return monitor.newest_within(e, ["user_id"], "event_id", 30, "bytes", 200).select("user_id", "event_id")


@query(r"""SELECT event_id, 'updateDataModel' AS kind, CASE WHEN event_type = 'error' THEN 'interrupt' ELSE 'page' END AS "group", '/k' AS path, (json_extract(props, '$.k'))::VARCHAR AS preview, '' AS errors FROM events""")
def classified_messages(spark, d):
    """Kind, group and preview of messages, and their envelope checks."""
    sid = F.concat(F.when(F.col("event_type") == "error", "interrupt:").otherwise(""), "event_type", F.lit("-1"))
    raw = F.concat(F.lit('{"version":"0.9","updateDataModel":{"surfaceId":"'), sid, F.lit('","path":"/k","value":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    m = stream.classified(raw)
    e = spread(load(spark, d, "events").select("event_id", "event_type", "props"), "event_id")
    return e.select("event_id", m["kind"].alias("kind"), m["group"].alias("group"), m["path"].alias("path"), m["preview"].alias("preview"), F.array_join(stream.message_errors(raw), ";").alias("errors"))


# --- responses ---


@query(r"""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS source_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events WHERE event_type IN ('view', 'click', 'purchase')""")
def routed_items(spark, d):
    """Responses to sources by address and method, and their items."""
    e = load(spark, d, "events").select("event_id", F.concat(F.lit("https://x.example/api/"), "event_type").alias("url"), F.lit("GET").alias("method"), F.concat(F.lit('{"list":['), "props", F.lit("]}")).alias("body"))
    sources = spark.createDataFrame([("browse", "/api/(view|click)$", "get"), ("act", "/api/purchase$", None), ("never", "/api/", "POST")], "source_id string, url_re string, method string")
    hit = harvest.routed(e, sources)
    return harvest.selected_items(hit.select("event_id", "source_id", "body"), "body", "list array<struct<k:long>>", "list", {"k": "k"}).select("event_id", "source_id", "k")


@query(r"""WITH x AS (SELECT user_id, event_type, (json_extract(props, '$.k'))::BIGINT AS k, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT user_id, event_type, string_agg(k::VARCHAR, ',' ORDER BY first_id) AS ks FROM x GROUP BY user_id, event_type""")
def accumulated_items(spark, d):
    """New keys in order of arrival."""
    e = load(spark, d, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    out = harvest.accumulated(e, ["user_id", "event_type"], F.col("k"), ["event_id"])
    return out.select("user_id", "event_type", F.array_join(F.transform("items", lambda x: x["k"].cast("string")), ",").alias("ks"))


@query("""SELECT event_id AS seq, user_id AS run_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM events QUALIFY event_type <> 'signup'""")
def document_epochs(spark, d):
    """Loads of each document."""
    e = events(spark, d).select(F.col("user_id").alias("run_id"), F.lit("/").alias("path"), "seq", "event_type")
    return harvest.document_epochs(e.where("event_type <> 'signup'").drop("event_type"), e.where("event_type = 'signup'")).select("seq", "run_id", "epoch")


@query("""SELECT count(*) AS matched, count(*) FILTER (event_type <> 'error') AS parsed, count(*) FILTER (event_type = 'error') AS failed FROM events""")
def capture_stats(spark, d):
    """Matched, parsed and failed bodies."""
    return harvest.capture_stats(load(spark, d, "events").select(F.when(F.col("event_type") == "error", "{torn").otherwise(F.col("props")).alias("body")))


@query("""SELECT 'itemList' AS list, f AS field, t AS type, count(*) AS n FROM orders, (VALUES ('o_orderkey', 'number'), ('o_orderstatus', 'string'), ('stats.o_totalprice', 'number')) AS v(f, t) GROUP BY f, t""")
def payload_fields(spark, d):
    """Lists, fields and types of payloads."""
    o = load(spark, d, "orders").select(F.to_json(F.struct(F.lit(True).alias("hasMore"), F.array(F.struct("o_orderkey", "o_orderstatus", F.struct("o_totalprice").alias("stats"))).alias("itemList"))).alias("body"))
    each = o.select(F.explode(jsonops.payload_fields(F.col("body"))).alias("f"))
    return each.groupBy(F.col("f.list").alias("list"), F.col("f.field").alias("field"), F.col("f.type").alias("type")).agg(F.count("*").alias("n"))


# --- quality ---


def expected_produced(spark, d):
    o = spread(load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey")
    shown = F.concat(F.format_string("%.2f", F.col("o_totalprice") / 1000), F.lit("K"))
    e = o.select(F.lit("orders").alias("route"), F.col("o_orderkey").alias("seq"), F.struct(F.col("o_orderkey").cast("string").alias("id"), shown.alias("price"), F.col("o_orderstatus").alias("status")).alias("record"))
    p = o.where("o_orderkey % 5 <> 0").select(F.lit("orders").alias("route"), F.col("o_orderkey").alias("seq"), F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status")).alias("record"))
    return quality.fields_of(e).drop("record"), quality.fields_of(p).drop("record")


@query("""WITH f AS (SELECT *, o_orderkey % 5 <> 0 AS hit, o_orderkey % 7 = 0 AND o_orderstatus <> 'X' AS miss FROM orders)
SELECT count(*) AS expected, count(*) FILTER (hit) AS found, 3 * count(*) FILTER (hit) AS fields, count(*) FILTER (hit AND miss) AS mismatches,
  count(*) FILTER (hit)::DOUBLE / count(*) AS coverage, (3 * count(*) FILTER (hit) - count(*) FILTER (hit AND miss))::DOUBLE / (3 * count(*) FILTER (hit)) AS score FROM f""")
def parity(spark, d):
    """Expected against produced records by key, with abbreviated counts."""
    pairs = quality.pair_by_key(*expected_produced(spark, d))
    return quality.parity_report(pairs, quality.judged_fields(pairs))


@query("""SELECT 'orders' AS route, 'status' AS field, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS expected, 'X' AS got FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0""")
def parity_mismatches(spark, d):
    """Mismatches by field with the first example (A4)."""
    return quality.mismatches(quality.judged_fields(quality.pair_by_key(*expected_produced(spark, d))))


@query("""SELECT 'n' || c_nationkey AS route, c_custkey::BIGINT AS seq, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::BIGINT END AS produced_seq FROM customer""")
def parity_keyless(spark, d):
    """Keyless records by best overlap."""
    c = load(spark, d, "customer")
    rec = lambda df, *cols: quality.fields_of(df.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("route"), F.col("c_custkey").cast("long").alias("seq"), F.to_json(F.struct(*cols)).alias("record"))).drop("record")
    pairs = quality.pair_by_overlap(rec(c, F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("zz").alias("other")), rec(c.where("c_custkey % 4 <> 0"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    return pairs.select("route", "seq", "produced_seq")


@query("""WITH c AS (SELECT user_id, event_type, value FROM events)
SELECT user_id AS run_id, coalesce(avg(CASE WHEN event_type = 'click' THEN (value >= 20)::INT END), 1.0) AS list_parity_rate, coalesce(avg(CASE WHEN event_type = 'view' THEN value / 100 END), 1.0) AS render_equivalence_mean, count(*) FILTER (event_type IN ('view', 'click') AND NOT value >= 20) AS failed FROM c GROUP BY user_id""")
def run_gates(spark, d):
    """Rates and means of checks per run (A5)."""
    kind = F.when(F.col("event_type") == "view", "render-equivalence").when(F.col("event_type") == "click", "list-parity").otherwise("other")
    c = load(spark, d, "events").select(F.col("user_id").alias("run_id"), kind.alias("kind"), (kind == "other").__or__(F.col("value") >= 20).alias("pass"), (F.col("value") / 100).alias("score"))
    return quality.run_gate(c).select("run_id", "list_parity_rate", "render_equivalence_mean", "failed")


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_partkey AS v FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber AS pos, CASE WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN -1 ELSE l_partkey END AS v FROM lineitem WHERE l_linenumber <= 4)
SELECT a.k AS list, count(*) AS left_n, count(b.k) AS right_n, count(*) FILTER (b.v <> a.v) AS mismatched, count(*) FILTER (b.v <> a.v) = 0 AS is_prefix FROM a LEFT JOIN b ON a.k = b.k AND a.pos = b.pos GROUP BY a.k""")
def list_parity(spark, d):
    """Lists of two sides: the shorter one as a prefix."""
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("value"))
    y = x.where("pos <= 4").withColumn("value", F.when((F.col("pos") == 3) & (F.col("list") % 2 == 0), -1).otherwise(F.col("value")))
    return quality.list_parity(x, y, ["list"]).select("list", "left_n", "right_n", "mismatched", "is_prefix")


# --- faults, telemetry, timelines ---


@query(r"""SELECT event_id, CASE event_type WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'crash' WHEN 'purchase' THEN 'network' WHEN 'error' THEN 'missing' ELSE 'unknown' END AS cls,
  CASE WHEN event_id % 4 = 0 THEN 'ok' WHEN event_id % 4 = 1 THEN 'explained' WHEN event_id % 4 = 2 THEN 'fatal' ELSE 'retry' END AS nav FROM events""")
def error_classes(spark, d):
    """Errors by message, navigations by status."""
    t = F.col("event_type")
    message = F.when(t == "view", "Timeout 30ms exceeded").when(t == "click", "Target page, context or browser has been closed").when(t == "purchase", "net::ERR_FAILED").when(t == "error", "element not visible").otherwise("odd")
    k = F.col("event_id") % 4
    status = F.when(k == 0, 200).when(k == 2, 404).otherwise(503)
    return load(spark, d, "events").select("event_id", monitor.error_class(message).alias("cls"), monitor.navigation_class(status, F.when(k == 1, "down")).alias("nav"))


@query(r"""SELECT event_id AS fault_id, CASE WHEN event_type = 'error' THEN 'blocked' WHEN event_id % 3 = 0 THEN 'unhandled-state' WHEN value < 30 THEN 'site-changed' WHEN event_type = 'view' THEN 'false-positive-drift' WHEN event_type = 'click' THEN 'transient' ELSE 'unknown' END AS classification FROM events""")
def diagnoses(spark, d):
    """Faults by their evidence."""
    t = F.col("event_type")
    e = load(spark, d, "events").select(
        F.col("event_id").alias("fault_id"), F.when(t == "error", "captcha").alias("blocked_hit"), F.when(F.col("event_id") % 3 == 0, "other").otherwise("list").alias("matched"), F.lit("list").alias("expected"), F.lit(True).alias("expected_matches"),
        (F.col("value") / 100).alias("similarity"), F.lit(0.3).alias("least_similarity"), F.lit(0).alias("broken"), F.lit(4).alias("fields"), F.when(t == "view", "drift").otherwise("error").alias("reason"), F.when(t == "click", 2).otherwise(0).alias("failed"), F.lit("odd").alias("error"),
    )
    return monitor.diagnosed(e).select("fault_id", "classification")


@query(r"""SELECT user_id AS fault_id, count(*) AS requests, count(*) FILTER (event_type = 'error' OR value > 90) AS failed FROM events GROUP BY user_id""")
def network_logs(spark, d):
    """Network logs flattened, and failed requests."""
    entry = F.struct(F.lit("2024-01-01T00:00:00Z").alias("startedDateTime"), F.col("value").alias("time"), F.struct(F.lit("GET").alias("method"), F.col("event_type").alias("url")).alias("request"),
        F.struct(F.when(F.col("value") > 90, 500).otherwise(200).alias("status"), F.lit("").alias("statusText")).alias("response"), F.lit("xhr").alias("_resourceType"), F.when(F.col("event_type") == "error", "reset").alias("_error"))
    har = load(spark, d, "events").groupBy(F.col("user_id").alias("fault_id")).agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entries")).alias("log"))).alias("har"))
    e = readers.har_entries(har)
    return e.groupBy("fault_id").agg(F.count("*").alias("requests"), F.count_if(F.col("error").isNotNull() | (F.col("status") >= 400)).alias("failed"))


@query(r"""SELECT event_id::VARCHAR AS span_id, event_type AS name, (json_extract(props, '$.k'))::VARCHAR AS k, event_type = 'error' AS is_open FROM events""")
def trace_spans(spark, d):
    """Spans flattened: typed attributes, open spans."""
    attr = F.array(F.struct(F.lit("k").alias("key"), F.struct(F.get_json_object("props", "$.k").alias("intValue")).alias("value")))
    span = F.struct(F.lit("t").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("").alias("parentSpanId"), F.col("event_type").alias("name"), F.lit("1700000000000000000").alias("startTimeUnixNano"),
        F.when(F.col("event_type") == "error", "0").otherwise("1700000001000000000").alias("endTimeUnixNano"), attr.alias("attributes"))
    otlp = load(spark, d, "events").select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))).alias("otlp"))
    return readers.trace_spans(otlp).select("span_id", "name", F.col("attributes")["k"].alias("k"), F.col("ended").isNull().alias("is_open"))


@query(r"""SELECT conv_id, turn, role, 'text' AS kind, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND NOT starts_with(text, '[')""")
def transcript_items(spark, d):
    """Texts of agent transcripts."""
    c = load(spark, d, "conversations").where("role IN ('user', 'assistant') AND NOT startswith(text, '[')")
    user = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    own = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    lines = c.select("conv_id", "turn", F.when(F.col("role") == "user", user).otherwise(own).alias("raw"))
    return readers.transcript_items(lines).where("trim(text) <> ''").select("conv_id", "turn", "role", "kind", "text")


@query(r"""SELECT user_id AS run_id, event_type AS state, count(*) AS visits, max(c) AS current FROM (SELECT *, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM events) GROUP BY user_id, event_type""")
def state_visits(spark, d):
    """Visits of states and the current one."""
    lines = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("seq").alias("n"), F.concat(F.lit("state main."), "event_type").alias("line"))
    return monitor.state_visits(lines)


@query(r"""SELECT event_id, CASE event_type WHEN 'view' THEN 'navigate' WHEN 'click' THEN 'await' WHEN 'error' THEN 'fault' ELSE 'other' END AS kind, CASE WHEN event_type = 'click' THEN event_id END AS ms FROM events""")
def parsed_logs(spark, d):
    """Run-log lines by rule."""
    t, k = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(t == "view", F.concat(F.lit("· navigate https://x.example/"), k)).when(t == "click", F.concat(F.lit("warn: await attempt 1/3 failed [timeout], next in "), k, F.lit("ms"))).when(t == "error", "fault drift: shape").otherwise("hello")
    p = monitor.parsed_log(line)
    return load(spark, d, "events").select("event_id", p["kind"].alias("kind"), p["ms"].alias("ms"))


@query(r"""SELECT user_id AS scene_id, count(*) AS frames, max((epoch_us(ts) // 1000))::BIGINT AS duration, count(*) FILTER (event_type = 'purchase') AS marks FROM events GROUP BY user_id""")
def scene_summaries(spark, d):
    """Frames, duration and marks of scenes."""
    f = events(spark, d).select(F.col("user_id").alias("scene_id"), F.col("ms").alias("t"), "event_type")
    return monitor.scene_summary(f, f.where("event_type = 'purchase'"))


@query(r"""WITH s AS (SELECT user_id AS session_id, min((epoch_us(ts) // 1000)) AS a, min((epoch_us(ts) // 1000)) + CASE WHEN user_id % 9 = 0 THEN 315360000000 ELSE 86400000 * (1 + user_id % 3) END AS b FROM events GROUP BY user_id), t AS (SELECT 'f' || user_id AS file, min((epoch_us(ts) // 1000)) AS a, min((epoch_us(ts) // 1000)) + CASE WHEN user_id % 2 = 0 THEN 60000 * (user_id % 11 + 1) ELSE 43200000 END AS b FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
o AS (SELECT session_id, file, least(s.b, t.b) - greatest(s.a, t.a) AS ms FROM s JOIN t ON s.a < t.b AND t.a < s.b)
SELECT session_id, arg_max(file, struct_pack(ms := ms, file := file)) AS file, max(ms)::BIGINT AS overlap_ms FROM o GROUP BY session_id""")
def largest_overlaps(spark, d):
    """The transcript that overlaps each session longest."""
    first = events(spark, d).groupBy("user_id").agg(F.min("ms").alias("a"))
    s = first.select(F.col("user_id").alias("session_id"), F.col("a").alias("start"), (F.col("a") + F.when(F.col("user_id") % 9 == 0, 315_360_000_000).otherwise(86_400_000 * (1 + F.col("user_id") % 3))).alias("end"))
    t = first.where("user_id % 5 <> 0").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("a").alias("start"), (F.col("a") + F.when(F.col("user_id") % 2 == 0, 60_000 * (F.col("user_id") % 11 + 1)).otherwise(43_200_000)).alias("end"))
    return monitor.largest_overlap(s, t)


@query(r"""SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'miss' WHEN event_id % 4 = 0 THEN 'hit' ELSE 'visual-drift' END AS outcome FROM events""")
def cache_lookups(spark, d):
    """Cache hits, misses and visual drift."""
    e = load(spark, d, "events").select("event_id", casts.request_key(F.lit("model"), F.col("event_id")).alias("key"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(65535).cast("long").alias("dhash"))
    stored = load(spark, d, "events").where("event_id % 2 = 0").select(casts.request_key(F.lit("model"), F.col("event_id")).alias("key"), F.lit(0).cast("long").alias("dhash"))
    return monitor.cache_lookup(e, stored).select("event_id", "outcome")


@query(r"""SELECT user_id AS run_id, ((epoch_us(ts) // 1000) // 3600000 * 3600000)::BIGINT AS tick, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY ALL""")
def throttled_frames(spark, d):
    """The first row of each tick."""
    e = events(spark, d).select(F.col("user_id").alias("scene_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("payload"))
    return live.throttled(e, "1 hour").select(F.col("scene_id").alias("run_id"), F.unix_millis("start").alias("tick"), F.col("payload").alias("event_id"))


BURST_SQL = """x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, ms, ms AS begun, 1 AS changes FROM x WHERE n = 1
  UNION ALL SELECT x.user_id, x.n, x.event_id, x.ms, CASE WHEN x.ms - r.ms < 21600000 AND x.ms - begun < 43200000 THEN begun ELSE x.ms END, CASE WHEN x.ms - r.ms < 21600000 AND x.ms - begun < 43200000 THEN changes + 1 ELSE 1 END
  FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1)"""


@query(f"""WITH RECURSIVE {BURST_SQL} SELECT user_id AS run_id, begun, max(ms) AS last, max(changes)::BIGINT AS changes, arg_max(event_id, n) AS payload FROM r GROUP BY user_id, begun""")
def debounced_changes(spark, d):
    """The last row of each burst of changes; a burst of half a day is told though no quiet time came."""
    e = events(spark, d).select(F.col("user_id").alias("run_id"), "ms", "seq", F.col("event_id").alias("payload"))
    return stream.bursts(e, 6 * 3_600_000, 12 * 3_600_000)


# --- costs ---


@query(r"""WITH b AS (SELECT user_id, count(*) AS records, sum(value) * 100 AS wall FROM events GROUP BY user_id)
SELECT user_id AS run_id, v AS volume, (wall / greatest(records, 1) / 1000 * 0.09 / 3600) * v AS usd FROM b, (SELECT unnest([1, 1000, 100000, 1000000])::BIGINT AS v)""")
def cost_table(spark, d):
    """Costs of runs by platform and volume."""
    b = load(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("records"), (F.sum("value") * 100).alias("wallMs"), F.lit(1.0).alias("nodeCpuMs"), F.lit(2.0).alias("browserCpuMs"), F.sum("value").alias("bytes"), F.lit(2000.0).alias("cpuMHz"))
    t = harvest.cost_table(harvest.per_item(b)).where("platform = 'Cloudflare Browser Rendering'")
    return t.select("run_id", "volume", "usd")


@query(r"""SELECT event_type AS purpose, count(*) AS calls, count(*) FILTER (event_id % 2 = 0) AS cached FROM events GROUP BY event_type""")
def call_accounting(spark, d):
    """Model calls, cached and live (A10)."""
    c = load(spark, d, "events").select(F.col("event_type").alias("purpose"), (F.col("event_id") % 2 == 0).alias("cached"), F.col("value").alias("ms"), (F.col("value") / 1000).alias("costUsd"))
    return harvest.call_accounting(c).select("purpose", "calls", "cached")


@query(r"""SELECT p_partkey AS line, v AS volume, (p_retailprice / 1000) * v + 0.5 * greatest(1, ceil(v / 1000.0)) AS usd FROM part, (SELECT unnest([1, 1000, 100000, 1000000])::BIGINT AS v)""")
def listing_costs(spark, d):
    """Listing prices by model and volume."""
    price = F.concat(F.lit('{"pricingModel":"PAY_PER_EVENT","pricingPerEvent":{"actorChargeEvents":{"item":{"eventTitle":"result","isPrimaryEvent":true,"eventPriceUsd":'), (F.col("p_retailprice") / 1000).cast("string"), F.lit('},"start":{"isOneTimeEvent":true,"eventPriceUsd":0.5}}}}'))
    p = load(spark, d, "part").select(F.col("p_partkey").alias("line"), F.explode(F.array(harvest.listing_price(price))).alias("p")).select("line", "p.*")
    return harvest.listing_costs(p).select("line", "volume", "usd")


# --- further joins and set operations ---


@query(r"""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'word-' || event_type ELSE event_type END AS value FROM events""")
def restored_words(spark, d):
    """Redacted words set back from a vocabulary, in known columns only."""
    e = load(spark, d, "events")
    tokens = e.select("event_id", F.col("event_type").alias("token"), F.when(F.col("event_type") == "purchase", "other").otherwise("title").alias("column"))
    words = e.where("event_type IN ('view', 'click', 'purchase')").select(F.col("event_type").alias("token"), F.concat(F.lit("word-"), "event_type").alias("word")).distinct()
    return harvest.restored(tokens, words, ("title",)).select("event_id", "value")


@query(r"""WITH x AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem)
SELECT l_orderkey::VARCHAR AS surface_id, '/lines/' || i AS scope, l_partkey::VARCHAR AS value FROM x""")
def bound_components(spark, d):
    """Template lists bound to a surface's data: one row per item with its scope."""
    items = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    models = items.select(F.col("l_orderkey").cast("string").alias("surface_id"), F.to_json(F.struct("lines")).alias("model"))
    return quality.bound_rows(None, models, {"line": ("/lines", "l_partkey")}).select("surface_id", "scope", "value")


@query(r"""SELECT event_type AS kind, bool_or(value > 99) AS seen, event_type <> 'error' AS declared, event_type = 'view' AS handled, bool_or(value > 99) AND NOT (event_type = 'view') AS gap FROM events GROUP BY event_type""")
def interrupt_coverage(spark, d):
    """Overlays seen against those declared and handled."""
    e = load(spark, d, "events").select(F.col("event_type").alias("kind"), "value")
    known = e.select("kind").distinct()
    out = known.join(quality.interrupt_coverage(e.where("value > 99"), known.where("kind <> 'error'"), known.where("kind = 'view'")), "kind", "left").fillna(False)
    return out.select("kind", "seen", "declared", "handled", "gap")


@query(r"""SELECT user_id AS scene_id, max(event_id) AS version, arg_max(value, event_id) AS t0 FROM events GROUP BY user_id""")
def merged_scenes(spark, d):
    """The newest version of each summary (U4)."""
    e = load(spark, d, "events").select(F.col("user_id").alias("scene_id"), F.col("event_id").alias("version"), F.col("value").alias("t0"))
    return monitor.merged_scenes(e.where("version % 2 = 0"), e.where("version % 2 = 1"))


@query(r"""WITH e AS (SELECT p_partkey AS i, lower(p_name) AS hay, 5 + p_partkey % 7 AS w, 5 + p_partkey % 5 AS h, p_partkey % 3 AS page FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 8 = 0),
q AS (SELECT page, query_id, token FROM range(3) p(page), (VALUES ('a', 'a'), ('two', 'bo'), ('long', 'gizmo'), ('any', 'ring'), ('any', 'blue'), ('none', 'qqq'), ('end', 'e')) v(query_id, token))
SELECT q.page, query_id, arg_min(i, struct_pack(a := w * h, b := i)) AS i FROM e JOIN q ON e.page = q.page AND contains(hay, token) GROUP BY ALL""")
def action_targets(spark, d):
    """The smallest element of a page whose label holds a token, or any of the words where there is none."""
    asked = [("a", ["A"], ["metal"]), ("two", ["bO"], []), ("long", ["GIZMO"], None), ("any", [], ["ring", "blue"]), ("none", ["qqq"], ["a"]), ("end", None, ["e"])]
    tokens = spark.createDataFrame([(p, *q) for p in range(3) for q in asked], "page long, query_id string, tokens array<string>, words array<string>")
    k = F.col("p_partkey")
    tag = F.when(k % 4 == 0, F.when(k % 8 == 0, "div").otherwise("span")).when(k % 4 == 1, "a").otherwise("BUTTON")
    e = load(spark, d, "part").select((k % 3).alias("page"), k.alias("i"), F.col("p_name").alias("hay"), (5 + k % 7).alias("w"), (5 + k % 5).alias("h"), tag.alias("tag"), F.when(k % 8 == 0, "button").alias("role"))
    return quality.targets(tokens, quality.clickable(e), ["page"])


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) || rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS place FROM pages)
SELECT a.page_id, b.page_id AS other, a.place = b.place AS same FROM p a JOIN p b ON b.page_id = a.page_id OR b.page_id = a.page_id + 1""")
def same_pages(spark, d):
    """Addresses of one page, trailing slashes, queries and the case of hosts aside."""
    p = load(spark, d, "pages").select("page_id", "url")
    other = p.select(F.col("page_id").alias("other"), F.concat(F.upper(F.substring("url", 1, 12)), F.expr("substring(url, 13)"), F.when(F.col("url").rlike("[?#]"), "").otherwise("/")).alias("there"))
    both = p.select("*", F.explode(F.array(F.col("page_id"), F.col("page_id") + 1)).alias("other")).join(other, "other")
    return both.select("page_id", "other", quality.same_page(F.col("url"), F.col("there")).alias("same"))


@query(r"""SELECT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, max(page_id) AS newest, min(page_id) AS first_seen FROM pages GROUP BY 1 ORDER BY 3 DESC LIMIT 5""")
def newest_paths(spark, d):
    """The newest response of the last paths seen."""
    return harvest.newest_paths(load(spark, d, "pages").select("url", F.col("page_id").alias("seq")))


@query(r"""SELECT event_id, event_type AS type, CASE WHEN event_type = 'view' THEN text ELSE regexp_replace(text, 'https?://[^\s)]+', 'https://example.invalid/…', 'g') END AS payload
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'scene' ELSE event_type END AS event_type, 'see https://x.example/' || event_id AS text FROM events WHERE event_type <> 'error')""".replace("event_type = 'view' THEN text", "event_type = 'scene' THEN text"))
def published_events(spark, d):
    """Structural events verbatim, the others scrubbed, interface messages left out."""
    t = F.when(F.col("event_type") == "view", "scene").when(F.col("event_type") == "error", "a2ui").otherwise(F.col("event_type"))
    e = load(spark, d, "events").select("event_id", t.alias("type"), F.concat(F.lit("see https://x.example/"), F.col("event_id").cast("string")).alias("payload"))
    return harvest.published(e)
