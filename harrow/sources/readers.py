"""Recorded inputs as tables: pages, responses, logs, telemetry, transcripts, listings and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Frozen pages without scripts and http-equiv metas."""
    from harrow.operators.pages import stripped

    return spark.read.parquet(path).withColumn("html", stripped(F.col("html")))


#: Fixed value: media types whose bodies are JSON.
JSON_MEDIA = r"(?i)^(application|text)/([\w.+-]*\+)?json"


def json_responses(df: DataFrame) -> DataFrame:
    """XHR and fetch responses of JSON media types, with ``parsed`` telling which bodies can be read."""
    kind = F.col("mime").rlike(JSON_MEDIA) & F.col("resource_type").isin("xhr", "fetch", "XHR", "Fetch")
    return df.where(kind).withColumn("parsed", F.try_parse_json("body").isNotNull())


def messages(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """JSON Lines of stream messages, each line ``{run_id, seq, ...}``; lines that are no JSON are left out."""
    text = (spark.readStream if live else spark.read).schema("value string").text(path)
    v = F.try_parse_json("value")
    return text.where(v.isNotNull()).select(F.try_variant_get(v, "$.run_id", "string").alias("run_id"), F.try_variant_get(v, "$.seq", "long").alias("seq"), F.col("value").alias("raw"))


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log: blank and torn lines are left out."""
    text = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return text.where(F.try_parse_json("value").isNotNull()).select(row.alias("r")).select("r.*")


HAR = "struct<log:struct<entries:array<struct<startedDateTime:string,time:double,request:struct<method:string,url:string>,response:struct<status:int,statusText:string>,_resourceType:string,_error:string>>>>"


def har_entries(df: DataFrame, har: str = "har") -> DataFrame:
    """One row per request of a network log held as JSON text."""
    keys = [c for c in df.columns if c != har]
    return df.select(*keys, F.posexplode(F.from_json(har, HAR)["log"]["entries"]).alias("entry_no", "e")).select(
        *keys, "entry_no", F.try_to_timestamp("e.startedDateTime").alias("started"), F.col("e.time").alias("ms"), F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"),
        F.col("e.response.status").alias("status"), F.col("e._resourceType").alias("resource_type"), F.col("e._error").alias("error"),
    )


def console_entries(df: DataFrame, console: str = "console") -> DataFrame:
    keys = [c for c in df.columns if c != console]
    return df.select(*keys, F.posexplode(F.from_json(console, "array<struct<at:string,level:string,text:string>>")).alias("n", "c")).select(*keys, "n", "c.*")


VALUE = "struct<intValue:string,doubleValue:double,boolValue:boolean,stringValue:string>"
SPANS = f"struct<resourceSpans:array<struct<scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<struct<key:string,value:{VALUE}>>,events:array<struct<name:string,timeUnixNano:string>>,status:struct<code:int,message:string>>>>>>>>"


def _nanos(c: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", c.try_cast("long"), F.lit(1000)))  # whole numbers: a double can't hold so many digits


def trace_spans(df: DataFrame, otlp: str = "otlp") -> DataFrame:
    """One row per span: attributes as a map of texts, times as timestamps; an open span has no end."""
    keys = [c for c in df.columns if c != otlp]
    flat = df.select(*keys, F.explode(F.from_json(otlp, SPANS)["resourceSpans"]).alias("r")).select(*keys, F.explode("r.scopeSpans").alias("s")).select(*keys, F.explode("s.spans").alias("x"))
    typed = F.transform("x.attributes", lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value")))
    end = F.col("x.endTimeUnixNano")
    return flat.select(
        *keys, F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_id"), F.col("x.name").alias("name"),
        _nanos(F.col("x.startTimeUnixNano")).alias("started"), F.when(end != "0", _nanos(end)).alias("ended"), F.map_from_entries(typed).alias("attributes"), F.col("x.events").alias("events"), F.col("x.status.code").alias("status"),
    )


def span_events(spans: DataFrame) -> DataFrame:
    return spans.select("span_id", F.explode("events").alias("e")).select("span_id", F.col("e.name").alias("name"), _nanos(F.col("e.timeUnixNano")).alias("at"))


CONTENT = "array<struct<type:string,text:string,thinking:string,name:string,input:map<string,string>>>"
#: Input fields that tell what a tool call is about, first present one.
TOLD = ("url", "urlContains", "site", "viewId", "times", "inputs")


def transcript_items(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """User texts, assistant texts, thinking (600 characters) and tool calls (80 characters) of agent transcripts."""
    keys = [c for c in lines.columns if c != raw]
    v = F.try_parse_json(raw)
    get = lambda p: F.try_variant_get(v, p, "string")
    base = lines.where(v.isNotNull()).select(*keys, get("$.type").alias("who"), get("$.timestamp").alias("at"), get("$.message.content").alias("content"))
    user = base.where("who = 'user' AND NOT startswith(content, '[')").select(*keys, "at", F.lit("user").alias("role"), F.lit("text").alias("kind"), F.col("content").alias("text"), F.lit(None).cast("string").alias("name"))
    own = base.where("who = 'assistant'").select(*keys, "at", F.explode(F.from_json("content", CONTENT)).alias("c"))
    i = F.col("c.input")
    told = F.coalesce(*[F.when(i[k].isNotNull(), F.concat(F.lit("×"), i[k]) if k == "times" else i[k]) for k in TOLD], F.lit(""))
    text = F.when(F.col("c.type") == "tool_use", F.substring(told, 1, 80)).when(F.col("c.type") == "thinking", F.substring("c.thinking", 1, 600)).otherwise(F.col("c.text"))
    kind = F.when(F.col("c.type") == "tool_use", "tool").otherwise(F.col("c.type"))
    calls = own.select(*keys, "at", F.lit("assistant").alias("role"), kind.alias("kind"), text.alias("text"), F.regexp_replace("c.name", "^mcp__[a-z0-9]+__", "").alias("name"))
    return user.unionAll(calls.where("kind = 'tool' OR (kind IN ('text', 'thinking') AND trim(text) <> '')"))


def listings(lines: DataFrame, word: str, raw: str = "value") -> DataFrame:
    """Marketplace listings that name a brand: first line per actor."""
    from harrow.operators.harvest import listing_price
    from harrow.operators.records import first_wins

    v = F.try_parse_json(raw)
    get = lambda p, k="string": F.try_variant_get(v, p, k)
    pattern = rf"(?i)\b{word}\b"
    rows = lines.where(F.substring(raw, 1, 1500).rlike(pattern) & v.isNotNull()).select(
        F.concat_ws("/", get("$.actor.username"), get("$.actor.name")).alias("actor"), F.concat_ws(" ", get("$.actor.name"), get("$.actor.title")).alias("named"), F.coalesce(get("$.actor.stats.totalUsers", "long"), F.lit(0)).alias("users"), get("$.actor.currentPricingInfo").alias("pricing"), "line",
    )
    one = first_wins(rows.where(F.col("named").rlike(pattern)), F.col("actor"), ["line"])
    return one.select("actor", "users", F.explode(F.array(listing_price(F.col("pricing")))).alias("p")).select("actor", "users", "p.*")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Screenshots as rows of Spark's image source."""
    return spark.read.format("image").option("dropInvalid", True).load(path)
