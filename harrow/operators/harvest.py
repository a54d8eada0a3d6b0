"""Captured responses, derived schemas, publication and costs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import casts, jsonops

# --- responses ---


def routed(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """Responses with each source (source_id, url_re, method or null) that takes them. Sources are a declared list."""
    s = sources.select("source_id", "url_re", F.upper("method").alias("source_method"))
    return responses.join(s, F.expr("url RLIKE url_re AND (source_method IS NULL OR source_method = upper(method))"))


def selected_items(responses: DataFrame, body: str, schema: str, items: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per item of a body: a list gives its items, a single value one; fields by dotted path."""
    parsed = responses.withColumn("__b", F.from_json(body, schema))
    return parsed.select(*[c for c in responses.columns if c != body], F.posexplode(f"__b.{items}").alias("item_no", "item")).select(
        *[c for c in responses.columns if c != body], "item_no", *[F.col(f"item.{p}").alias(k) for k, p in fields.items()]
    )


def document_epochs(rows: DataFrame, navigations: DataFrame) -> DataFrame:
    """Number the loads of each (run_id, path); rows belong to the load before them."""
    a = rows.withColumn("__nav", F.lit(0))
    b = navigations.select("run_id", "path", "seq").withColumn("__nav", F.lit(1))
    w = Window.partitionBy("run_id", "path").orderBy("seq", F.desc("__nav")).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn("epoch", F.sum("__nav").over(w)).where("__nav = 0").drop("__nav")


def accumulated(items: DataFrame, group: list[str], key: Column, order: list[str]) -> DataFrame:
    """Append mode: the first item of each key, in order of arrival, as one list per group."""
    whole = F.struct(*[F.col(c) for c in items.columns if c not in group])
    first = items.groupBy(*group, F.coalesce(key.cast("string"), F.lit("null")).alias("__key")).agg(F.min_by(whole, F.struct(*order)).alias("item"), F.min(F.struct(*order)).alias("at"))
    return first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("items"))


def replaced(payloads: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Replace mode: the last payload of each group."""
    return payloads.groupBy(*group).agg(F.max_by(value, order).alias(value))


def capture_stats(responses: DataFrame) -> DataFrame:
    """Matched, parsed and failed responses."""
    ok = F.try_parse_json("body").isNotNull()
    return responses.agg(F.count("*").alias("matched"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("failed"))


def newest_paths(responses: DataFrame, n: int = 5) -> DataFrame:
    """The newest response of each path; the last n paths by when they were first seen."""
    p = casts.path_of(F.col("url"))
    own = responses.groupBy(p.alias("path")).agg(F.max_by("seq", "seq").alias("newest"), F.min("seq").alias("first_seen"))
    return own.orderBy(F.desc("first_seen")).limit(n)


def preview(items: DataFrame, most: int = 5) -> DataFrame:
    """The first items of each source, in order of arrival, each with the number of all its items: they become expected records."""
    w = Window.partitionBy("source_id").orderBy("seq", "item_no")
    n = items.groupBy("source_id").agg(F.count("*").alias("items"))
    return items.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n").join(n, "source_id")


def paging_hints(responses: DataFrame) -> DataFrame:
    """(source_id, seq, paging): the paging keys of the last response of each source."""
    last = responses.groupBy("source_id").agg(F.max("seq").alias("seq"), F.max_by("body", "seq").alias("body"))
    return last.select("source_id", "seq", jsonops.paging_keys(F.col("body")).alias("paging"))


# --- derived schemas ---


def path_patterns(urls: DataFrame) -> DataFrame:
    """One pattern per view: each segment a constant, ``@name``, a number or anything. URLs of another depth than most are kept as a depth of their own."""
    parts = F.filter(F.split(casts.path_of(F.col("url")), "/"), lambda x: x != "")
    own = urls.select("view", F.size(parts).alias("depth"), F.posexplode(parts).alias("pos", "part"))
    seg = own.groupBy("view", "depth", "pos").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.bool_and(F.col("part").rlike("^@")).alias("handles"), F.bool_and(F.col("part").rlike(r"^\d+$")).alias("numbers"))
    escaped = F.regexp_replace("a", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    # a constant with five digits in a row is an id that the samples happen to share
    text = F.when((F.col("a") == F.col("b")) & ~F.col("a").rlike(r"\d{5,}"), escaped).when(F.col("handles"), "@[^/]+").when(F.col("numbers"), r"\d+").otherwise("[^/]+")
    return seg.groupBy("view", "depth").agg(F.concat(F.lit("^/"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "/"), F.lit("/?$")).alias("pattern"))


def stable_fields(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Selectors found in every sample of a view, from (view, sample, selector, value, i): those whose value varies are fields,
    the others labels; in the order of the first sample. One sample varies by itself."""
    n = samples.groupBy("view").agg(F.count_distinct("sample").alias("n"))
    own = values.groupBy("view", "selector").agg(F.count_distinct("sample").alias("found"), F.count_distinct("value").alias("different"), F.min_by("i", F.struct("sample", "i")).alias("i"), F.min("value").alias("value"))
    kept = own.join(n, "view").where("found = n")
    varies = (F.col("different") > 1) | (F.col("n") == 1)
    return kept.select("view", "selector", "i", varies.alias("varies"), F.when(~varies, F.col("value")).alias("label"))


def stable_lists(items: DataFrame, samples: DataFrame) -> DataFrame:
    """Lists in all samples of a view with the field keys that all of them share, from (view, sample, list, field)."""
    n = samples.groupBy("view").agg(F.count_distinct("sample").alias("n"))
    in_all = items.groupBy("view", "list").agg(F.count_distinct("sample").alias("found")).join(n, "view").where("found = n").select("view", "list", "n")
    keys = items.groupBy("view", "list", "field").agg(F.count_distinct("sample").alias("found"))
    return keys.join(in_all, ["view", "list"]).where("found = n").groupBy("view", "list").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def inferred_types(values: DataFrame, by: tuple[str, ...] = ("view", "selector")) -> DataFrame:
    """count where all samples of a field look like counts, else string."""
    return values.groupBy(*by).agg(F.when(F.bool_and(F.col("value").rlike(r"(?i)^[\d.,]+\s*[KMB]?$")), "count").otherwise("string").alias("type"))


def inferred_keys(links: DataFrame, by: tuple[str, ...] = ("view", "list")) -> DataFrame:
    """id where all links of a list, or of a field of it, hold six digits or more, else url."""
    return links.groupBy(*by).agg(F.when(F.bool_and(F.col("value").rlike(r"\d{6,}")), "id").otherwise("url").alias("key"))


def item_schema(fields: DataFrame) -> DataFrame:
    """Fields with nullable JSON types; lists are arrays."""
    null = F.array(F.when(F.col("type") == "count", "integer").otherwise("string"), F.lit("null"))
    return fields.withColumn("json_type", F.when(F.col("type") == "list", F.array(F.lit("array"))).otherwise(null))


def static_labels(fields: DataFrame, by: str = "selector") -> DataFrame:
    """Fields ``x-count`` take the constant text of ``x`` as their label; of several the last one."""
    last = F.max_by("label", "i" if "i" in fields.columns else "label").alias("label_text")
    labels = fields.where("NOT varies").groupBy("view", F.col(by).alias("__of")).agg(last)
    return fields.where("varies").withColumn("__of", F.regexp_replace(by, "-count$", "")).join(labels, ["view", "__of"], "left").drop("__of")


def derived_schemas(found: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per property of a view: its stable fields, lists and fields of lists, typed, from the (view, sample, list, selector, kind, attr,
    many, value, i) of its pages. ``found`` is read several times. What an element is, and its place, are those of the first sample."""
    single, of_list = found.where("list IS NULL"), ["view", "list", "field"]
    items = found.where("list IS NOT NULL").withColumn("field", F.concat_ws("|", "kind", "selector"))
    first = single.groupBy("view", "selector").agg(F.min_by(F.struct("kind", "attr", "many"), "sample").alias("f")).select("view", "selector", "f.*")
    fields = stable_fields(single, samples).join(first, ["view", "selector"]).join(inferred_types(single), ["view", "selector"])
    fields = fields.withColumn("type", F.when(F.col("many"), "list").when(F.col("kind") == "image", "url").when(F.col("kind") == "canvas", "string").otherwise(F.col("type")))
    texts, others = fields.where("kind = 'text'"), fields.where("kind <> 'text'").withColumn("label_text", F.lit(None).cast("string"))
    told = static_labels(texts, "attr").withColumn("label_text", F.when(F.col("type") == "count", F.col("label_text"))).unionByName(others)
    page = told.select("view", F.lit(None).cast("string").alias("list"), "selector", "kind", "i", "varies", "type", F.lit(None).cast("string").alias("key"), "label_text")

    kept = stable_lists(items, samples).select("view", "list", F.explode("fields").alias("field"))
    begun = items.groupBy(*of_list).agg(F.min_by(F.struct("selector", "kind", "i"), F.struct("sample", "i")).alias("f")).select(*of_list, "f.*")
    keys = inferred_keys(items.where("kind = 'link'"), tuple(of_list))
    own = kept.join(begun, of_list).join(inferred_types(items, tuple(of_list)), of_list).join(keys, of_list, "left")
    own = own.withColumn("key", F.when(F.col("kind") == "item", F.min("key").over(Window.partitionBy("view", "list"))).otherwise(F.col("key")))
    types = F.when(F.col("kind") == "item", F.array(F.lit("list"))).when(F.col("kind") == "image", F.array(F.lit("url"))).when(F.col("key") == "id", F.array(F.lit("id"), F.lit("url"))).when(F.col("kind") == "link", F.array(F.lit("url"))).otherwise(F.array("type"))
    lists = own.withColumn("type", F.explode(types)).select("view", "list", "selector", "kind", "i", F.lit(None).cast("boolean").alias("varies"), "type", "key", F.lit(None).cast("string").alias("label_text"))
    return item_schema(page.unionByName(lists)).withColumn("place", F.row_number().over(Window.partitionBy("view", "list").orderBy("i", F.col("kind") != "item", "kind", "selector", "type"))).drop("i")


def repeated_groups(elements: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """Siblings with one signature, at least ``least`` of them; the largest groups of each page, by count times text."""
    own = elements.groupBy("page_id", "parent", "sig").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("i").alias("first")).where(F.col("n") >= least)
    w = Window.partitionBy("page_id").orderBy(F.desc(F.col("n") * F.greatest("chars", F.lit(1))), "first", "parent", "sig")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def refined(df: DataFrame, renames: Mapping[str, str], drops: list[str]) -> DataFrame:
    """A refinement patch on an extracted table."""
    return df.drop(*drops).withColumnsRenamed(dict(renames))


# --- publication ---

#: Keys whose texts identify people, and keys that never do.
SENSITIVE = r"(?i)author|creator|user|name|nick|unique|handle|text|desc|caption|signature|title|url|cover|avatar|music|sound|hashtag|challenge|comment|bio|link|href|src|image|video(url|id)?$"
SAFE = r"(?i)count|stats|plays|likes|digg|share|collect|duration|width|height|time|at$|^t$|ms$|ratio|score|coverage|records|total|n$|^id$|key|route|kind|type|view|path|state|phase|status"


def redacted(value: Column, key: Column) -> Column:
    """A text without what identifies people, by its key: addresses, long ids, sensitive keys, @handles."""
    tag = casts.pseudonym(value)
    named = key.rlike(SENSITIVE) & ~key.rlike(SAFE)
    shown = F.when(key.rlike("(?i)cover|avatar|image|thumb"), "‹image›").when(key.rlike("(?i)text|desc|caption|bio|signature"), "‹caption›").otherwise(F.concat(F.lit("creator_"), tag))
    return (
        F.when(value.rlike("^https?://"), F.concat(F.lit("https://example.invalid/"), tag))
        .when(value.rlike(r"^\d{15,}$"), F.concat(F.lit("7"), F.rpad(tag, 5, "0"), F.lit("…"), F.substring(value, -3, 3)))
        .when(named, shown)
        .otherwise(scrubbed_handles(value))
    )


def redacted_json(record: Column) -> Column:
    """A record of any depth, as JSON text, without what identifies people: each text by its own key, items of a list by the list's.
    Numbers, flags and keys stay. The rules are those of ``redacted`` and run as Columns; Python only takes the texts out and puts them back."""
    found = jsonops.texts(record)
    return jsonops.with_texts(record, F.transform(found, lambda x: redacted(x["value"], x["key"])))


def scrubbed_handles(value: Column) -> Column:
    """@handles as pseudonyms; the text is cut at them, so each is hashed once."""
    handles = F.regexp_extract_all(value, F.lit(r"@[\w.]{2,}"), F.lit(0))
    gaps = F.split(value, r"@[\w.]{2,}", -1)
    parts = F.zip_with(gaps, handles, lambda g, h: F.concat(g, F.when(h.isNotNull(), F.concat(F.lit("@creator_"), casts.pseudonym(h))).otherwise("")))
    return F.when(value.contains("@"), F.array_join(parts, "")).otherwise(value)


def scrubbed(text: Column) -> Column:
    """Free text without handles, long ids and addresses."""
    out = scrubbed_handles(text)
    out = F.regexp_replace(out, r"\b(\d{4})\d{8,}(\d{3})\b", "$1…$2")
    return F.regexp_replace(out, r"https?://[^\s)]+", "https://example.invalid/…")


def without_names(text: Column, names: list[str]) -> Column:
    """Free text without the names of a declared deny list: whole words, longest first, any case."""
    import re

    if not names:
        return text
    return F.regexp_replace(text, r"(?i)\b(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b", "creator")


def redacted_values(values: Column, path: Column) -> Column:
    """Display values: counts stay, those of sensitive paths go."""
    leaf = F.element_at(F.split(path, "/"), -1)
    keep = path.rlike("(?i)count|plays|digg|likes")
    return F.transform(values, lambda x: F.when(x.isNull() | x.rlike("(?i)^[\\d.,KMB%]+$") | keep, x).when(leaf.rlike(SENSITIVE), "‹›").otherwise(F.regexp_replace(x, r"@[\w.]{2,}", "@creator")))


#: Events that carry structure only and are published as they are.
STRUCTURAL = ("schema", "artifact", "bench", "phase", "parity", "breadcrumb", "machine", "timeline", "scene", "records-reset", "a2ui-reset", "research")


def published(events: DataFrame) -> DataFrame:
    """Events for publication: structural ones verbatim, the others scrubbed, interface messages left out."""
    return events.where("type <> 'a2ui'").withColumn("payload", F.when(F.col("type").isin(*STRUCTURAL), F.col("payload")).otherwise(scrubbed(F.col("payload"))))


def restored(tokens: DataFrame, vocabulary: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Redacted words set back from (token, word), in known columns only. The join's form follows the vocabulary's size."""
    both = tokens.join(vocabulary, "token", "left")
    return both.withColumn("value", F.when(F.col("column").isin(*columns), F.coalesce("word", "token")).otherwise(F.col("token"))).drop("word")


# --- costs ---

#: Fixed values: (platform, what runs, dollars per wall second, per extraction CPU second, per invocation of 100 items).
PLATFORMS = (
    ("AWS Lambda (x86, 2 GB + Chromium layer)", "browser", 2 * 0.0000166667, 0.0, 0.2e-6),
    ("Google Cloud Run (2 vCPU, 2 GiB, request-billed)", "browser", 2 * 0.000024 + 2 * 0.0000025, 0.0, 0.4e-6),
    ("Cloudflare Browser Rendering", "browser", 0.09 / 3600, 0.0, 0.0),
    ("Browserbase (usage)", "browser", 0.1 / 3600, 0.0, 0.0),
    ("Cloudflare Workers / WASM (extraction only)", "extract-only", 0.0, 0.02 / 1e3, 0.3e-6),
    ("WasmEdge / Spin on a VM (extraction only)", "extract-only", 0.0, 0.0416 / 3600, 0.0),
)
VOLUMES = (1, 1_000, 100_000, 1_000_000)


def per_item(bench: DataFrame) -> DataFrame:
    """Wall and CPU milliseconds, cycles and bytes per record of each run."""
    n = F.greatest(F.col("records"), F.lit(1))
    cpu = (F.col("nodeCpuMs") + F.col("browserCpuMs")) / n
    return bench.select("*", (F.col("wallMs") / n).alias("wall_ms"), cpu.alias("cpu_ms"), (F.col("nodeCpuMs") / n).alias("extract_cpu_ms"), F.floor(cpu * 1e3 * F.col("cpuMHz") + 0.5).alias("cycles"), F.floor(F.col("bytes") / n + 0.5).alias("bytes_item"))


def cost_table(items: DataFrame) -> DataFrame:
    """Each run's items by platform and volume: the two short lists are exploded, so rows are runs x 6 x 4."""
    platforms = F.array(*[F.struct(F.lit(a).alias("platform"), F.lit(b).alias("runs"), F.lit(c).alias("wall_usd"), F.lit(d).alias("cpu_usd"), F.lit(e).alias("call_usd")) for a, b, c, d, e in PLATFORMS])
    wide = items.select("*", F.explode(platforms).alias("p")).select("*", "p.*").drop("p")
    unit = F.col("wall_ms") / 1000 * F.col("wall_usd") + F.col("extract_cpu_ms") / 1000 * F.col("cpu_usd") + F.col("call_usd") / 100
    return wide.withColumn("unit_usd", unit).select("*", F.explode(F.array(*[F.lit(v).cast("long") for v in VOLUMES])).alias("volume")).withColumn("usd", F.col("unit_usd") * F.col("volume"))


def listing_price(pricing: Column) -> Column:
    """Price per item, at its best tier, per run and per month, from a listing's pricing as a JSON text."""
    model = F.coalesce(F.get_json_object(pricing, "$.pricingModel"), F.lit("PAY_PER_USAGE"))
    event = "struct<eventTitle:string,isPrimaryEvent:boolean,isOneTimeEvent:boolean,eventPriceUsd:double,eventTieredPricingUsd:map<string,struct<tieredEventPriceUsd:double>>>"
    events = F.map_values(F.coalesce(F.from_json(F.get_json_object(pricing, "$.pricingPerEvent.actorChargeEvents"), f"map<string,{event}>"), F.create_map().cast(f"map<string,{event}>")))
    primary = F.coalesce(F.get(F.filter(events, lambda e: e["isPrimaryEvent"]), 0), F.get(F.filter(events, lambda e: ~F.coalesce(e["isOneTimeEvent"], F.lit(False))), 0))
    start = F.get(F.filter(events, lambda e: e["isOneTimeEvent"]), 0)
    tiers = lambda e: F.transform(F.coalesce(F.map_values(e["eventTieredPricingUsd"]), F.array()), lambda t: t["tieredEventPriceUsd"])
    flat = F.get_json_object(pricing, "$.pricePerUnitUsd").cast("double")
    unit = F.coalesce(F.get_json_object(pricing, "$.unitName"), F.lit(""))
    per = F.coalesce(flat, F.lit(0.0)) / F.when(unit.rlike("1000"), 1000).otherwise(1)
    by_event, by_item = model == "PAY_PER_EVENT", model == "PRICE_PER_DATASET_ITEM"
    return F.struct(
        model.alias("model"),
        F.when(by_event, F.coalesce(F.get(tiers(primary), 0), primary["eventPriceUsd"])).when(by_item, per).alias("per_item"),
        F.when(by_event, F.coalesce(F.array_min(tiers(primary)), primary["eventPriceUsd"])).when(by_item, per).alias("per_item_best"),
        F.when(by_event, F.coalesce(F.get(tiers(start), 0), start["eventPriceUsd"], F.lit(0.0))).otherwise(0.0).alias("per_run"),
        F.when(model == "FLAT_PRICE_PER_MONTH", flat).alias("monthly"),
    )


def top_listings(listings: DataFrame, most: int = 5) -> DataFrame:
    """The most used listings that have a price."""
    return listings.where("per_item IS NOT NULL OR monthly IS NOT NULL").orderBy(F.desc("users"), "actor").limit(most)


def listing_costs(listings: DataFrame) -> DataFrame:
    """Dollars of each priced listing by volume; the start fee once per thousand items."""
    at = listings.where("per_item IS NOT NULL").select("*", F.explode(F.array(*[F.lit(v).cast("long") for v in VOLUMES])).alias("volume"))
    return at.withColumn("usd", F.col("per_item") * F.col("volume") + F.col("per_run") * F.greatest(F.lit(1), F.ceil(F.col("volume") / 1000)))


def call_accounting(calls: DataFrame) -> DataFrame:
    """Calls, cached ones, and seconds and cost of the live ones, per purpose."""
    live = ~F.col("cached")
    return calls.groupBy("purpose").agg(F.count("*").alias("calls"), F.count_if("cached").alias("cached"), F.round(F.coalesce(F.sum(F.when(live, F.col("ms"))), F.lit(0)) / 1000, 1).alias("seconds"), F.round(F.coalesce(F.sum(F.when(live, F.col("costUsd"))), F.lit(0.0)), 4).alias("usd"))
