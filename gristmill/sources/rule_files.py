"""Rule files by path: YAML with language, name, version, settings, patterns and motifs per category."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "lang string, priority int, category string, kind string, expr string"


def _rows(text: bytes) -> tuple[list[tuple[str, str, str]], str | None]:
    """(category, kind, expr) of a file, and why it cannot be read."""
    import yaml

    try:
        spec = yaml.safe_load(text.decode())
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        return [], f"{type(e).__name__}: {e}"[:500]
    if spec is None:
        return [], None
    if not isinstance(spec, dict):
        return [], "no mapping"
    out, wrong = [], None
    for kind, part in (("regex", "patterns"), ("motif", "motifs")):
        for category, exprs in (spec[part].items() if isinstance(spec.get(part), dict) else ()):
            if isinstance(exprs, list):
                out += [(str(category), kind, str(e)) for e in exprs]
            elif exprs is not None:
                wrong = f"{part}.{category}: no list"
    return out, wrong


def read(spark: SparkSession, folders: list[str], languages: list[str]) -> DataFrame:
    """(lang, priority, category, kind, expr, path, error) of the files ``<lang>.yaml`` in ``folders``, in order of priority, on any file
    system that Spark reads. A file that cannot be read, or not wholly, has a row with its error; missing folders and files have none."""
    wanted = {x.lower() for x in languages}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, priority in frame.itertuples(index=False):
                lang = path.rsplit("/", 1)[-1].removesuffix(".yaml").lower()
                if lang in wanted:
                    rows, wrong = _rows(content)
                    out += [(lang, priority, *r, path, None) for r in rows]
                    out += [(lang, priority, None, None, None, path, wrong)] if wrong else []
            yield pd.DataFrame(out, columns=["lang", "priority", "category", "kind", "expr", "path", "error"])

    schema = f"{SCHEMA}, path string, error string"
    out = spark.createDataFrame([], schema)
    for priority, folder in enumerate(folders):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder)
            out = out.unionByName(files.select("path", "content", F.lit(priority).alias("priority")).mapInPandas(parse, schema))
    return out


def load(spark: SparkSession, folders: list[str], languages: list[str]) -> DataFrame:
    """The rules that ``read`` finds, without the errors."""
    return read(spark, folders, languages).filter("error is null").select("lang", "priority", "category", "kind", "expr")
