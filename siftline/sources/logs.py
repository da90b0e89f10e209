"""Access logs: text lines in combined format or NDJSON, one row per line. Built-in expressions only.

A line is trimmed; an empty one, broken JSON, JSON without a path or numeric status, and anything else that is not in
combined format are rejects with a reason. Of each JSON field's alias paths the first that is present counts, even if its value
is null or unusable. Source addresses are never kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.agents import classify_user_agent
from siftline.functions.shared import contained

#: White space between fields; a request's version begins after it.
BLANKS, VERSION = r"\s+", r"\s+HTTP/"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Alias paths in order of preference.
ALIASES = {
    "method": ["method", "httpMethod", "request.method"],
    "path": ["path", "uri", "url", "request.path", "request.uri", "request.url"],
    "status": ["status", "statusCode", "response.status"],
    "user_agent": ["userAgent", "user_agent", "ua", "http_user_agent", "request.userAgent", "request.headers.user-agent"],
    "time": ["timestamp", "time", "date", "@timestamp"],
    "bytes": ["bytes", "bodyBytesSent", "response.bytes"],
    "referrer": ["referrer", "referer", "http_referer"],
}
# Reasons for rejecting a line.
EMPTY = "Line is empty."
BROKEN_JSON = "Invalid JSON log line."
INCOMPLETE_JSON = "JSON log line must include a request path and numeric status."
UNKNOWN_FORMAT = "Line is neither supported JSON nor Apache/Nginx combined format."


def _field(name: str) -> Column:
    """The first alias that is present, as a variant."""
    paths = ["$" + "".join(f"['{part}']" for part in alias.split(".")) for alias in ALIASES[name]]
    return F.coalesce(*[F.expr(f"""try_variant_get(_json, "{p}", 'variant')""") for p in paths])


def _text(v: Column) -> Column:
    """A non-empty string, or null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))


def _number(v: Column) -> Column:
    """A finite number, or a string that spells one, or null."""
    text = F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    as_number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    as_text = F.when((kind == "STRING") & text.rlike(NUMBER), F.trim(text).try_cast("double")).when((kind == "STRING") & (text != "") & (F.trim(text) == ""), 0.0)
    value = F.coalesce(as_number, as_text)
    return F.when(F.abs(value) < float("inf"), value)


def _combined_time(raw: Column) -> Column:
    return F.try_to_timestamp(raw, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def _closing(quoted: Column) -> Column:
    """A line cut at its quotes -> which part ends the request, from 1; null if none can.

    It holds the version; behind it come status and size, the referrer, blanks, the agent, and then nothing or a blank. The first such part counts, so a target may hold
    quotes of its own.
    """

    def ends(e: Column) -> Column:
        numbers, between, rest = F.get(quoted, e + 1), F.get(quoted, e + 3), F.get(quoted, e + 5)
        sized = F.split(numbers, BLANKS)  # between two empty ends
        placed = (F.size(sized) == 4) & (F.get(sized, F.lit(0)) == "") & (F.get(sized, F.lit(3)) == "") & (F.length(F.get(sized, F.lit(1))) == 3) & F.get(sized, F.lit(1)).rlike(r"^[0-9]+$")
        closed = F.when(rest == "", F.size(quoted) == e + 6).otherwise(F.btrim(F.left(rest, F.lit(1)), F.lit(" \t\r\n\x0b\x0c")) == "")
        return F.coalesce(F.get(quoted, e).rlike(VERSION) & placed & (between != "") & (F.btrim(between, F.lit(" \t\r\n\x0b\x0c")) == "") & closed, F.lit(False))

    first = F.lit(1)
    later = F.when(F.size(quoted) > 7, F.get(F.filter(F.sequence(F.lit(2), F.greatest(F.size(quoted) - 6, F.lit(2))), ends), F.lit(0)))
    return F.when(ends(first), first).otherwise(later)


def _combined_fields(quoted: Column, e: Column) -> dict[str, Column]:
    """The texts of a combined line's fields, by their place; null for all that a broken line can't give."""
    # address, identity and user, which aren't kept, then the time in brackets and a blank
    head = F.split(F.get(quoted, F.lit(0)), BLANKS, 4)
    stamp = F.get(head, F.lit(3))
    bare = F.rtrim(F.translate(stamp, "\t\r\n\x0b\x0c", "     "))
    inner = F.substring(stamp, F.lit(2), F.length(bare) - 2)
    timed = F.startswith(stamp, F.lit("[")) & F.endswith(bare, F.lit("]")) & (F.length(bare) < F.length(stamp)) & (F.length(bare) > 2) & ~F.contains(inner, F.lit("]"))
    version = F.split(F.get(quoted, e), VERSION, 2)
    opened = F.array_join(F.concat(F.slice(quoted, F.lit(2), e - 1), F.array(F.get(version, F.lit(0)))), '"')
    request = F.split(opened, BLANKS, 2)
    method, target = F.get(request, F.lit(0)), F.get(request, F.lit(1))
    asked = (method != "") & ~F.contains(method, F.lit('"')) & (target != "") & (F.get(version, F.lit(1)) != "")
    numbers = F.split(F.get(quoted, e + 1), BLANKS)
    fine = F.coalesce(timed & asked, F.lit(False))
    found = {"ts_raw": inner, "method": method, "path": target, "status": F.get(numbers, F.lit(1)), "bytes": F.get(numbers, F.lit(2)), "referrer": F.get(quoted, e + 2), "user_agent": F.get(quoted, e + 4)}
    return {k: F.when(fine, v) for k, v in found.items()}


#: Fields of an observation; time and agent cost most.
FIELDS = ("method", "path", "status", "bytes", "referrer", "user_agent", "ts", "ts_raw", "agent")


def parse_lines(lines: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """line_number and value -> ok, reason, observation (of FIELDS those that are asked for; what isn't is not computed)."""
    own = [c for c in lines.columns if c != "value"]
    raw = lines.select(*own, F.coalesce(F.btrim(F.col("value"), F.lit(" \t\r\n\x0b\x0c")), F.lit("")).alias("_line"))
    trimmed = once(raw, own, "_line")
    is_json = F.startswith("_line", F.lit("{"))
    texts = ["ts_raw", "method", "path", "status", "bytes", "referrer", "user_agent"]
    wanted = {"path", "status", *fields, *(["ts_raw"] if "ts" in fields else []), *(["user_agent"] if "agent" in fields else [])} & set(texts)
    names = [c for c in texts if c in wanted]
    aliases = {"ts_raw": "time"}
    kept = [*own, "_line", "_is_json"]
    shaped = once(trimmed.withColumns({"_is_json": is_json, "_json": F.when(is_json, F.try_parse_json("_line")), "_quoted": F.when(~is_json, F.split("_line", '"'))}), [*own, "_line"], "_is_json", "_json", "_quoted")
    ended = once(shaped.withColumn("_end", _closing(F.col("_quoted"))), [*kept, "_json", "_quoted"], "_end")
    combined = _combined_fields(F.col("_quoted"), F.col("_end"))
    cells = {f"_{k}": _field(aliases.get(k, k)) for k in names} | {f"_c_{k}": combined[k] for k in names}
    found = once(ended.withColumns(cells), [*kept, "_json"], *cells)
    part = lambda k: F.col(f"_c_{k}")
    json, is_json = (lambda k, f: f(F.col(f"_{k}"))), F.col("_is_json")
    chosen = {
        "method": lambda: F.when(is_json, F.coalesce(json("method", _text), F.lit("GET"))).otherwise(part("method")),
        "path": lambda: F.when(is_json, json("path", _text)).otherwise(part("path")),
        "status": lambda: F.when(is_json, json("status", _number)).otherwise(part("status").try_cast("double")),
        "bytes": lambda: F.when(is_json, json("bytes", _number)).when(part("bytes").rlike(NUMBER), part("bytes").try_cast("double")),
        "referrer": lambda: F.nullif(F.when(is_json, json("referrer", _text)).otherwise(part("referrer")), F.lit("-")),
        "user_agent": lambda: F.when(is_json, F.coalesce(json("user_agent", _text), F.lit(""))).otherwise(part("user_agent")),
        "ts_raw": lambda: F.when(is_json, json("ts_raw", _text)).otherwise(F.nullif(part("ts_raw"), F.lit(""))),
    }
    reason = (
        F.when(F.col("_line") == "", EMPTY)
        .when(is_json & F.col("_json").isNull(), BROKEN_JSON)
        .when(is_json & (F.col("path").isNull() | F.col("status").isNull()), INCOMPLETE_JSON)
        .when(~is_json & F.col("path").isNull(), UNKNOWN_FORMAT)
    )
    read = once(found.withColumns({k: chosen[k]() for k in names}), [*kept, "_json"], *names)
    judged = once(read.withColumn("reason", reason), [*own, "_is_json", *names], "reason")
    last = {}
    if "ts" in fields:
        last["ts"] = F.when(is_json, F.try_to_timestamp("ts_raw")).otherwise(_combined_time(F.col("ts_raw")))
    if "agent" in fields:
        last["agent"] = classify_user_agent(F.col("user_agent"))
    seen = once(judged.withColumns(last), [*own, "reason", *names], *last) if last else judged
    ok = F.col("reason").isNull()
    return seen.select(*own, ok.alias("ok"), "reason", F.when(ok, F.struct(*[f for f in FIELDS if f in fields])).alias("observation"))


def once(df: DataFrame, keep: list[str], *computed: str) -> DataFrame:
    """The computed columns pass through a generator of one row.

    The optimizer writes a projection's expressions into every filter and column above it, however often they are used; it doesn't
    do so through a generator. Long chains of expressions stay small, and each is computed once.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def read_log(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """file, line_number (from 1 in each file) and value. With a root, a local folder, a path that leads out of it is an error.

    Files are split over tasks; a line's number is its place in its split plus the lines of the file's splits before. The splits'
    counts are one row each, so no line is shuffled.
    """
    path = path if root is None else f"file://{contained(root, path)}"
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("_at")
    )
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("_at") - F.col("first") + F.col("before") + 1).alias("line_number"), "value")
