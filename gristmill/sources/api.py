"""The JSON interface as rows: request bodies in, status and reply out; one bad row never stops the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as ht
from ..functions.rules import CATEGORIES
from ..operators import actions
from .http import MAX_BYTES, api_reply

#: A text beyond the parser's own bound of 20 million characters is too large, not broken JSON.
_LONGEST = 2147483647
_BODY = "html string, text string, url string, render boolean, action string, threshold string, _broken string"


def requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``request`` (the fields of the JSON body), ``action``, ``threshold``, ``status`` and ``error``; the two last are null
    for rows that may go on. A threshold that is no number is an error of the server, as it always was."""
    r = F.from_json(F.col(body), _BODY, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE", "maxStringLen": str(_LONGEST)})
    df = df.withColumn("request", F.when(F.trim(F.col(body)).startswith("{"), r))
    broken = F.col("request").isNull() | F.col("request._broken").isNotNull()
    given = F.col("request.threshold")
    number = given.try_cast("double")
    bad_number = given.isNotNull() & number.isNull()
    status = F.when(broken, 400).when(bad_number, 500)
    error = F.when(broken, "Invalid JSON").when(bad_number, F.concat(F.lit("could not convert string to float: '"), given, F.lit("'")))
    return df.withColumns({"action": F.coalesce("request.action", F.lit("redact")), "threshold": F.coalesce(number, F.lit(0.3)), "status": status, "error": error})


def _stopped(df: DataFrame, condition: Column, status: int, error: Column) -> DataFrame:
    """Ends rows that are still going on and for which ``condition`` holds."""
    now = F.col("status").isNull() & F.coalesce(condition, F.lit(False))
    return df.withColumns({"error": F.when(now, error).otherwise(F.col("error")), "status": F.when(now, status).otherwise(F.col("status"))})


def _replied(df: DataFrame, text: Column) -> DataFrame:
    """Detection and the action of each row on ``text``, where no error stands; then the reply."""
    df = df.withColumn("_text", F.when(F.col("status").isNull(), text)).withColumnRenamed("action", "_action").withColumnRenamed("threshold", "_threshold")
    found = actions.acted(actions.detect(df, "_text", F.col("_threshold")), "_text", F.col("_action"), F.col("_threshold"))
    names = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    taken = F.when(F.col("flagged"), F.col("_action")).otherwise("none")
    fine = F.col("status").isNull()
    reply = api_reply(F.when(fine, F.col("output")), F.col("error"), F.when(fine, F.struct(F.round("score", 4).alias("score"), "flagged", F.col("_threshold").alias("threshold"), taken.alias("action_taken"), names.alias("signals"))))
    return found.withColumn("reply", reply).withColumn("status", F.coalesce("status", F.lit(200)))


def convert(df: DataFrame, body: str = "body") -> DataFrame:
    """(…, status, error, reply) of bodies with ``html`` or ``text``: cleaned, judged and rewritten. 400 for bad JSON and missing
    texts, 413 beyond the size limit in bytes, 500 for a threshold that is no number."""
    columns = df.columns
    df = requests(df, body)
    given = F.coalesce(F.nullif("request.html", F.lit("")), F.nullif("request.text", F.lit("")))
    df = df.withColumn("_given", given)
    df = _stopped(df, F.col("_given").isNull(), 400, F.lit("Missing 'html' or 'text' field"))
    size = F.octet_length("_given")
    df = _stopped(df, size > MAX_BYTES, 413, F.concat(F.lit("Input too large ("), F.floor(size / 1024).cast("string"), F.lit(" KB). Maximum is 256 KB.")))
    df = ht.to_text(df.withColumn("_given", F.when(F.col("status").isNull(), F.col("_given"))), "_given", "_clean")
    return _replied(df, F.col("_clean")).select(*columns, "status", "error", "reply")


def fetched(df: DataFrame, body: str = "body", content: str = "content", failure: str = "failure", timed_out: str = "timed_out") -> DataFrame:
    """(…, status, error, reply) of bodies with a ``url`` whose content a fetcher has put beside them, with what went wrong: 400 for
    bad JSON and a missing url, 504 for time-outs, 500 for failures."""
    columns = df.columns
    df = requests(df, body)
    df = _stopped(df, F.coalesce("request.url", F.lit("")) == "", 400, F.lit("Missing 'url' field"))
    df = _stopped(df, F.col(timed_out), 504, F.lit("Request timed out"))
    df = _stopped(df, F.col(failure).isNotNull() | F.col(content).isNull(), 500, F.coalesce(F.nullif(F.trim(F.col(failure)), F.lit("")), F.lit("fetching failed")))
    return _replied(df, F.col(content)).select(*columns, "status", "error", "reply")
