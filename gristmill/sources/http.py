"""Raw HTTP responses, command lines and JSON bodies as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 262_144


def headers_of(block: Column) -> Column:
    """Lower-cased names to values; the last of a repeated name holds."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.locate(":", x) > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(…, status, headers, body, final_url, content_type) of header blocks, body, and the trailing status and url lines."""
    lines = F.split(F.col(raw), "\n", -1)
    n = F.size(lines)
    df = df.withColumn("_status", F.get(lines, n - 2).try_cast("int")).withColumn("final_url", F.get(lines, n - 1)).withColumn("_head", F.array_join(F.slice(lines, 1, F.greatest(n - 2, F.lit(0))), "\n"))
    # blocks follow each other as long as one starts with a status line: redirects; the last counts
    blocks = F.regexp_extract("_head", r"(?s)^((?:HTTP/[\d.]+ \d+.*?\r?\n\r?\n)+)", 1)
    df = df.withColumn("_blocks", blocks).withColumn("body", F.substring(F.col("_head"), F.length("_blocks") + 1, F.length("_head")))
    parts = F.filter(F.split(F.col("_blocks"), "\r?\n\r?\n"), lambda x: x != "")
    df = df.withColumn("_last", F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))).withColumn("headers", headers_of(F.col("_last")))
    line = F.regexp_extract("_last", r"^HTTP/[\d.]+ (\d+)", 1).try_cast("int")
    return df.withColumn("status", F.coalesce("_status", line)).withColumn("content_type", F.try_element_at("headers", F.lit("content-type"))).drop("_status", "_head", "_blocks", "_last")


def landed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, return_code, status, headers, body, final_url, content_type) of files that each hold one raw response as a fetcher has
    written it, on any file system that Spark reads. Bytes that are no UTF-8 are replaced; a file without a header block is a failed
    fetch with return code -1; Spark passes over empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = responses(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw")))
    return rows.select("path", F.when(F.col("raw").rlike(r"^HTTP/[\d.]+ \d+"), 0).otherwise(-1).alias("return_code"), "status", "headers", "body", "final_url", "content_type")


def parse_command(args: Column) -> Column:
    """(url, method, headers, body) of an argument list, as one fold.

    Unknown flags are passed over one token at a time, so a flag's value can be taken for a host.
    """
    start = F.struct(F.lit(None).cast("string").alias("url"), F.lit("GET").alias("method"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("body"), F.lit("").alias("pending"))

    def with_(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, s[k]).alias(k) for k in ("url", "method", "headers", "body", "pending")])

    def step(s: Column, a: Column) -> Column:
        none = F.lit("")
        pending = s["pending"]
        header = F.create_map(F.trim(F.substring_index(a, ":", 1)), F.trim(F.regexp_replace(a, "^[^:]*:", "")))
        rest = F.coalesce(F.map_filter(s["headers"], lambda k, _: k != F.trim(F.substring_index(a, ":", 1))), F.create_map().cast("map<string,string>"))
        host = ~a.startswith("-") & (a.contains(".") | a.startswith("localhost")) & s["url"].isNull()
        return (
            F.when(pending == "method", with_(s, method=F.upper(a), pending=none))
            .when(pending == "header", with_(s, headers=F.when(F.locate(":", a) > 0, F.map_concat(rest, header)).otherwise(s["headers"]), pending=none))
            .when(pending == "data", with_(s, body=a, method=F.when(s["method"] == "GET", "POST").otherwise(s["method"]), pending=none))
            .when(pending == "url", with_(s, url=a, pending=none))
            .when(a.isin("-X", "--request"), with_(s, pending=F.lit("method")))
            .when(a.isin("-H", "--header"), with_(s, pending=F.lit("header")))
            .when(a.isin("-d", "--data", "--data-raw", "--data-binary"), with_(s, pending=F.lit("data")))
            .when(a == "--url", with_(s, pending=F.lit("url")))
            .when(a.startswith("http://") | a.startswith("https://"), with_(s, url=a))
            .when(host, with_(s, url=a))
            .otherwise(s)
        )

    return F.aggregate(args, start, step, lambda s: F.struct(s["url"].alias("url"), s["method"].alias("method"), s["headers"].alias("headers"), s["body"].alias("body")))


def line_ended(body: Column) -> Column:
    """A line end after a body that is not empty and has none."""
    return F.when((body != "") & ~body.endswith("\n"), F.concat(body, F.lit("\n"))).otherwise(body)


def api_status(text: Column, url_valid: Column | None = None) -> Column:
    """413 beyond the size limit in UTF-8 bytes, 400 without text or with a bad url, else 200."""
    bad = text.isNull() | (text == "")
    if url_valid is not None:
        bad = bad | ~url_valid
    return F.when(F.octet_length(text) > MAX_BYTES, 413).when(bad, 400).otherwise(200)


def api_reply(markdown: Column, error: Column, injection: Column) -> Column:
    """The reply as JSON; what does not apply is null."""
    return F.to_json(F.struct(markdown.alias("markdown"), error.alias("error"), injection.alias("injection")), {"ignoreNullFields": "false"})
