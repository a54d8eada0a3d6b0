"""Expected against produced records, and whether records are grounded in their pages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.functions import casts, jsonops
from harrow.operators import records

ID_FIELDS = ("id", "videoId", "itemId", "webVideoUrl", "url")


def fields_of(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``fields``: the dotted paths and texts of a record, typed or as JSON text."""
    kind = records.schema[record].dataType
    return records.withColumn("fields", jsonops.flatten_struct(F.col(record), kind) if isinstance(kind, StructType) else jsonops.flatten(F.col(record)))


def key_field(fields: Column, route_key: Column | None = None) -> Column:
    """The field that identifies a record: the route's key where it has a value, else the first id-like one."""
    named = [F.when(fields[f].isNotNull() & (fields[f] != ""), F.lit(f)) for f in ID_FIELDS]
    own = [] if route_key is None else [F.when(F.element_at(F.map_filter(fields, lambda k, v: (k == route_key) & v.isNotNull()), route_key).isNotNull(), route_key)]
    return F.coalesce(*own, *named)


def pair_by_key(expected: DataFrame, produced: DataFrame, route_keys: DataFrame | None = None) -> DataFrame:
    """One-to-one pairs (route, seq, key, expected, produced or null) of expected records with a key field.

    The n-th expected record of a key takes the n-th produced one: the greedy pairing where a route keeps to one key field.
    """
    e = expected if route_keys is None else expected.join(route_keys, "route", "left")
    e = e.withColumn("key_field", key_field(F.col("fields"), None if route_keys is None else F.col("route_key"))).where("key_field IS NOT NULL")
    e = e.withColumn("key", F.coalesce(F.element_at("fields", F.col("key_field")), F.lit("")))
    used = e.select("route", "key_field").distinct()
    p = produced.join(used, "route").withColumn("key", F.coalesce(F.try_element_at("fields", F.col("key_field")), F.lit("")))
    by = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("route", "key_field", "key").orderBy("seq")))
    p = by(p).select("route", "key_field", "key", "rank", F.col("seq").alias("produced_seq"), F.col("fields").alias("produced"))
    return by(e).join(p, ["route", "key_field", "key", "rank"], "left").select("route", "seq", "key", F.col("fields").alias("expected"), "produced_seq", "produced")


def rarer_values(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """(route, seq, produced_seq): pairs that share one of the expected record's rarer values.

    A pair with half of its values equal shares one of any half and one more; the rarest are taken, so that a value which all
    records share lists no pairs unless a record has nothing else.
    """
    filled = lambda m: F.explode(F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull() & (v != "")))).alias("f")
    plain = F.lower(F.regexp_replace("f.value", "[#@]", "")).alias("value")
    words = lambda df: df.select("route", "seq", filled(F.col("fields"))).select("route", "seq", F.col("f.key").alias("field"), plain)
    own, theirs = words(expected), words(produced)
    often = theirs.groupBy("route", "field", "value").agg(F.count("*").alias("n"))
    ranked = own.hint("merge").join(often, ["route", "field", "value"], "left").withColumn("place", F.row_number().over(Window.partitionBy("route", "seq").orderBy(F.coalesce("n", F.lit(0)), "field")))
    need = Window.partitionBy("route", "seq")
    rare = ranked.withColumn("need", F.count("*").over(need)).where(F.col("place") <= F.col("need") - F.ceil(F.col("need") / 2) + 1).where("n IS NOT NULL")
    return rare.select("route", "field", "value", "seq").hint("merge").join(theirs.withColumnRenamed("seq", "produced_seq"), ["route", "field", "value"]).select("route", "seq", "produced_seq").distinct()


def pair_by_overlap(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Pairs of keyless expected records. Candidates are told by their rarer values, scores count matching fields, and each route takes the
    best unused candidate in expected order (of equal ones the first produced), if it holds at least half of the fields.

    A fixed number of jobs. Records of equal fields are one class, so that copies list no pairs. Classes are compared, and the
    greedy picks are one pass over the expected records, in order and group by group: groups are stretches of a route's order that
    no produced class spans, so that no group can take a record of another. A task holds the numbers of a group's produced records.
    Both sides of each join are as long as the records, so none is broadcast, however small the files behind it.
    """
    digest = lambda df: df.withColumn("cls", F.sha2(F.to_json(F.array_sort(F.map_entries("fields"))), 256))
    e, p = digest(expected), digest(produced)
    classes = lambda df: df.groupBy("route", "cls").agg(F.first("fields").alias("fields"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    ec, pc = classes(e), classes(p)
    near = rarer_values(ec.withColumnRenamed("cls", "seq"), pc.withColumnRenamed("cls", "seq"))
    filled = lambda m: F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    both = near.hint("merge").join(ec.select("route", F.col("cls").alias("seq"), F.col("fields").alias("expected"), "first", "last"), ["route", "seq"])
    both = both.hint("merge").join(pc.select("route", F.col("cls").alias("produced_seq"), F.col("fields").alias("produced")), ["route", "produced_seq"])
    need = F.size(filled(F.col("expected")))
    hits = F.size(F.filter(F.map_entries(filled(F.col("expected"))), lambda f: casts.values_match(f["value"], F.try_element_at("produced", f["key"]))))
    edges = records.cut(both.select("route", F.col("seq").alias("cls"), F.col("produced_seq").alias("want"), hits.alias("hits"), need.alias("need"), "first", "last").where("hits >= greatest(1, need / 2)").drop("need"), "candidates")
    # produced classes as stretches of the route's order; where none is open a new group begins
    spans = edges.groupBy("route", "want").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    order = Window.partitionBy("route").orderBy("lo", "want")
    open_to = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = records.cut(spans.withColumn("grp", F.sum((F.col("lo") > F.coalesce(open_to, F.col("lo") - 1)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("route", "want", "grp"), "groups")
    members = p.select("route", F.col("cls").alias("want"), F.col("seq").alias("produced_seq")).hint("merge").join(groups, ["route", "want"])
    wanted = edges.hint("merge").join(groups, ["route", "want"]).groupBy("route", "cls", "grp").agg(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("a"), F.col("want").alias("want")))).alias("wants"))
    asks = e.select("route", "seq", "cls").hint("merge").join(wanted, ["route", "cls"])
    kind = expected.schema["seq"].dataType.simpleString()
    none = F.array().cast("array<struct<a:int,want:string>>")
    rows = members.select("route", "grp", F.lit(0).alias("asks"), F.col("produced_seq").cast(kind).alias("seq"), "want", none.alias("wants")).unionByName(
        asks.select("route", "grp", F.lit(1).alias("asks"), "seq", F.lit(None).cast("string").alias("want"), F.col("wants").cast("array<struct<a:int,want:string>>").alias("wants"))
    )

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left = None, {}
        for pdf in batches:
            out = []
            for route, grp, asking, seq, want, wants in zip(*[pdf[c] for c in ("route", "grp", "asks", "seq", "want", "wants")]):
                if (route, grp) != now:
                    now, left = (route, grp), {}
                if not asking:
                    left.setdefault(want, deque()).append(seq)
                    continue
                best = min(((w["a"], left[w["want"]][0], w["want"]) for w in wants if left[w["want"]]), default=None)
                if best:
                    out.append((route, seq, left[best[2]].popleft()))
            yield pd.DataFrame(out, columns=["route", "seq", "produced_seq"])

    dealt = rows.repartition("route", "grp").sortWithinPartitions("route", "grp", "asks", "seq")
    pairs = dealt.mapInPandas(pick, f"route string, seq {kind}, produced_seq {kind}")
    return expected.select("route", "seq", F.lit("?").alias("key"), F.col("fields").alias("expected")).hint("merge").join(
        pairs.hint("merge").join(produced.select("route", F.col("seq").alias("produced_seq"), F.col("fields").alias("produced")), ["route", "produced_seq"]), ["route", "seq"], "left"
    ).select("route", "seq", "key", "expected", "produced_seq", "produced")


def judged_fields(pairs: DataFrame) -> DataFrame:
    """One row per judged field of the found pairs, with whether it matches."""
    found = pairs.where("produced IS NOT NULL")
    each = found.select("route", "seq", "key", "produced", F.explode(F.map_entries("expected")).alias("f")).where("f.value IS NOT NULL AND f.value <> ''")
    got = F.try_element_at("produced", F.col("f.key"))
    return each.select("route", "seq", "key", F.col("f.key").alias("field"), F.col("f.value").alias("expected"), got.alias("got"), casts.values_match(F.col("f.value"), got).alias("ok"))


def parity_report(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: score, coverage, expected, found, fields judged and mismatches."""
    a = pairs.agg(F.count("*").alias("expected"), F.count_if(F.col("produced").isNotNull()).alias("found"))
    b = judged.agg(F.count("*").alias("fields"), F.count_if("ok").alias("ok"))
    score = F.when(F.col("fields") > 0, F.col("ok") / F.col("fields")).otherwise((F.col("found") > 0).cast("double"))
    coverage = F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0)
    # each side is one row
    return a.join(b).select(score.alias("score"), coverage.alias("coverage"), "expected", "found", "fields", (F.col("fields") - F.col("ok")).alias("mismatches"))


def mismatches(judged: DataFrame) -> DataFrame:
    """Mismatches by route and field: how many, and the first example."""
    return judged.where("NOT ok").groupBy("route", "field").agg(F.count("*").alias("n"), F.min_by(F.struct("expected", "got"), F.struct("seq", "expected")).alias("first")).select("route", "field", "n", "first.expected", "first.got")


def path_key(url: Column) -> Column:
    """Path and query of an address."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")


def percepts(elements: DataFrame) -> DataFrame:
    """What can be seen of each page, from (page_id, i, text, src, href): text in order, numbers, image and link keys."""
    return elements.groupBy("page_id").agg(
        casts.normalised_lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("i", "text")))), lambda x: x["text"]), " ")).alias("corpus"),
        F.collect_set(casts.display_count(F.col("text"))).alias("numbers"),
        F.collect_set(path_key(F.col("src"))).alias("images"),
        F.collect_set(path_key(F.col("href"))).alias("hrefs"),
    )


def sees(value: Column, kind: Column, corpus: Column, numbers: Column, images: Column, hrefs: Column) -> Column:
    """Whether a value is visible: numbers as such or in the text, addresses as images or links, the rest in the text."""
    number = kind == "number"
    return (
        F.when(value.isNull() | (value == ""), True)
        .when(number, F.array_contains(numbers, value.try_cast("double")) | corpus.contains(value))
        .when(value.rlike("^(https?:|/)"), F.array_contains(images, path_key(value)) | F.array_contains(hrefs, path_key(value)))
        .when(value.rlike("^data:image/"), True)
        .otherwise(corpus.contains(casts.normalised_lower(value)))
    )


def grounded_share(values: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Share of (page_id, value, kind) rows that are visible on their page."""
    seen = values.join(pages, "page_id").withColumn("seen", sees(F.col("value"), F.col("kind"), F.col("corpus"), F.col("numbers"), F.col("images"), F.col("hrefs")))
    return seen.groupBy(*by).agg(F.avg(F.col("seen").cast("int")).alias("share"), F.count("*").alias("n"))


def render_equivalence(values: DataFrame, window: Column, least: float = 0.9, by: str = "step") -> DataFrame:
    """Per step, from bound values (step, item_no or null, seen): how many were judged, the visible share and whether it holds. Items beyond
    the compared window of a list are left out and counted."""
    judged = F.col("item_no").isNull() | (F.col("item_no") <= window)
    share = F.coalesce(F.avg(F.when(judged, F.col("seen").cast("int"))), F.lit(1.0))
    return values.groupBy(by).agg(F.count_if(judged).alias("judged"), F.count_if(~judged).alias("left_out"), share.alias("share")).withColumn("passed", F.col("share") >= least)


#: Least rate of each kind of check for a run to pass.
GATES = {"render-equivalence": 0.9, "emit-grounding": 0.75, "list-parity": 0.9, "url-sync": 1.0}


def run_gate(checks: DataFrame) -> DataFrame:
    """One row per run from (run_id, kind, pass, score): rate and mean per kind, failures, and whether all gates hold."""
    names = {k: k.replace("-", "_") for k in GATES}
    rate = lambda k: F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("pass").cast("int"))), F.lit(1.0))
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("score"))), F.lit(1.0))
    out = checks.groupBy("run_id").agg(*[rate(k).alias(f"{v}_rate") for k, v in names.items()], *[mean(k).alias(f"{v}_mean") for k, v in names.items()], F.count_if(~F.col("pass")).alias("failed"))
    held = F.lit(True)
    for k, v in names.items():
        held = held & ((F.col(f"{v}_rate") if k in ("list-parity", "url-sync") else F.col(f"{v}_mean")) >= GATES[k])
    return out.withColumn("passed", held)


def list_parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per list, from rows (keys, pos, value) of both sides: sizes, mismatches over the shorter one, and whether it is an exact prefix."""
    both = left.select(*keys, "pos", F.col("value").alias("a"), F.lit(1).alias("in_a")).join(right.select(*keys, "pos", F.col("value").alias("b"), F.lit(1).alias("in_b")), [*keys, "pos"], "full")
    met = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    out = both.groupBy(*keys).agg(
        F.count("in_a").alias("left_n"), F.count("in_b").alias("right_n"), F.count_if(met & ~F.col("a").eqNullSafe(F.col("b"))).alias("mismatched"), F.count_if(met).alias("compared")
    )
    return out.withColumn("is_prefix", F.col("mismatched") == 0).withColumn("score", F.when(F.col("compared") > 0, 1 - F.col("mismatched") / F.col("compared")).otherwise(1.0))


def same_page(a: Column, b: Column) -> Column:
    """Host and path equal but for a trailing slash."""
    plain = lambda c: F.concat(F.lower(casts.host(c)), F.regexp_replace(casts.path_of(c), "/+$", ""))
    return plain(a) == plain(b)


GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text; a shorter text has none."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda k: F.substring(text, k, GRAM)))


def clickable(elements: DataFrame) -> DataFrame:
    """Links, buttons and what acts as one, of more than four pixels either way, from (tag, role, w, h)."""
    return elements.where((F.lower("tag").isin("a", "button") | F.col("role").eqNullSafe("button")) & (F.col("w") > 4) & (F.col("h") > 4))


def targets(queries: DataFrame, elements: DataFrame, page: list[str] | None = None) -> DataFrame:
    """The smallest element whose label holds one of a query's tokens or, for a query without tokens, one of its words.

    Queries are (query_id, token) or (query_id, tokens, words); elements (i, hay, w, h); ``page`` names columns that both have, so
    that a query meets the elements of its own page only. Returns (page, query_id, i).

    Needles meet labels by page and one run of three characters, of a needle the one that fewest labels hold; needles of fewer characters
    by a list of the labels that hold them. No needle is held against every label. Of both lists only runs that a needle asks for go on, and
    they are never a join's broadcast side: they are far larger than the files that Spark tells their size by.
    """
    page = page or []
    if "token" in queries.columns:
        queries = queries.withColumn("tokens", F.array("token")).withColumn("words", F.array().cast("array<string>"))
    filled = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    needle = F.explode(F.array_distinct(F.when(F.size(filled("tokens")) > 0, F.transform(filled("tokens"), F.lower)).otherwise(filled("words"))))
    asked = queries.select(*page, "query_id", needle.alias("needle"))
    labels = elements.select(*page, "i", F.lower("hay").alias("hay"), (F.col("w") * F.col("h")).alias("area")).where("hay IS NOT NULL")
    needles = asked.select(*page, "needle").distinct()
    long = needles.where(F.length("needle") >= GRAM).select(*page, "needle", F.explode(grams(F.col("needle"))).alias("gram"))
    posted = labels.select(*page, "i", "hay", "area", F.explode(grams(F.col("hay"))).alias("gram")).join(long, [*page, "gram"], "left_semi")
    often = posted.groupBy(*page, "gram").agg(F.count("*").alias("n"))
    rare = long.join(often, [*page, "gram"]).groupBy(*page, "needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("__met"))
    rare = rare.where(F.col("__met") == F.size(grams(F.col("needle")))).drop("__met")  # a needle with a run that no label has isn't there
    found = posted.hint("merge").join(rare, [*page, "gram"]).where(F.col("hay").contains(F.col("needle")))
    short = needles.where(F.length("needle") < GRAM)
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.length("hay") + 1 - k), lambda at: F.substring(F.col("hay"), at, k))
    lengths = F.explode(F.array_distinct(F.concat(*[runs(k) for k in range(1, GRAM)], F.array(F.lit("")))))
    small = labels.where(F.length("hay") >= GRAM - 1).select(*page, "i", "area", lengths.alias("needle")).unionByName(labels.where(F.length("hay") < GRAM - 1).select(*page, "i", "area", F.explode(F.array_distinct(F.array(F.lit(""), "hay"))).alias("needle")))
    met = found.select(*page, "needle", "i", "area").unionByName(small.join(short, [*page, "needle"], "left_semi").select(*page, "needle", "i", "area"))
    best = met.groupBy(*page, "needle").agg(F.min_by("i", F.struct("area", "i")).alias("i"), F.min(F.struct("area", "i")).alias("place"))
    return asked.join(best, [*page, "needle"]).groupBy(*page, "query_id").agg(F.min_by("i", "place").alias("i"))


def bound_rows(components: DataFrame, models: DataFrame, bindings: dict[str, tuple[str, str]]) -> DataFrame:
    """Components bound to data: name -> (list pointer, field). One row per item, with the scope ``/list/i``."""
    out = None
    for name, (pointer, field) in bindings.items():
        items = F.try_variant_get(F.try_parse_json("model"), jsonops.pointer_path(pointer), "array<variant>")
        rows = models.select("surface_id", F.posexplode(items).alias("i", "item")).select(
            "surface_id", F.lit(name).alias("component"), F.concat(F.lit(pointer + "/"), F.col("i").cast("string")).alias("scope"), F.try_variant_get("item", f"$['{field}']", "string").alias("value")
        )
        out = rows if out is None else out.unionAll(rows)
    return out.join(components, "component", "left_semi") if components is not None else out


def interrupt_coverage(seen: DataFrame, declared: DataFrame, handled: DataFrame) -> DataFrame:
    """Overlays by kind: whether seen, declared and handled; a gap is one seen but not both."""
    names = seen.select("kind").unionAll(declared.select("kind")).distinct()
    mark = lambda df, c: df.select("kind").distinct().withColumn(c, F.lit(True))
    out = names.join(mark(seen, "seen"), "kind", "left").join(mark(declared, "declared"), "kind", "left").join(mark(handled, "handled"), "kind", "left").fillna(False)
    return out.withColumn("gap", F.col("seen") & ~(F.col("declared") & F.col("handled")))
