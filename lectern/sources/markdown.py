"""Folders of Markdown files with headers: read, profiled by path, written."""

from __future__ import annotations

import datetime
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # the whole of YAML where its parser is there; block style by the small parser below where it isn't
    import yaml
except ImportError:
    yaml = None
#: The parser in C where YAML was built with it.
_LOADER = yaml and getattr(yaml, "CSafeLoader", yaml.SafeLoader)

_HEADER = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)(?:\r?\n)?^(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", re.S | re.M)
PARSED = T.StructType([T.StructField("header", T.MapType(T.StringType(), T.StringType())), T.StructField("kinds", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1].replace('\\"', '"')
    if text in ("", "~", "null"):
        return None
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", text[1:-1]) if x.strip()]
    return text


def parse_header(block: str) -> dict:
    """The mapping of a header's block style: scalars, quoted ones, flow and block lists, folded lines.

    Raises ValueError for what is neither; deeper nesting is kept as its text.
    """
    out: dict = {}
    key, items = None, []
    for line in block.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] not in " \t-":
            m = re.match(r"^([^:\s][^:]*):(?:\s+(.*)|)$", line)
            if not m:
                raise ValueError(f"no mapping: {line[:60]}")
            key, items = m[1].strip().strip("\"'"), []
            out[key] = _scalar(re.sub(r"\s+#.*$", "", m[2])) if m[2] else None
        elif key is None:
            raise ValueError(f"no mapping: {line[:60]}")
        elif line.strip().startswith("- ") or line.strip() == "-":
            items.append(_scalar(line.strip()[1:]))
            out[key] = items
        elif isinstance(out[key], str):
            out[key] += " " + line.strip()
        else:
            out[key] = line.strip() if out[key] is None else out[key]
    return out


_TEXTS = pa.map_(pa.string(), pa.string())
_ARROW_PARSED = [("header", _TEXTS), ("kinds", _TEXTS), ("body", pa.string()), ("error", pa.string())]


@F.arrow_udf(PARSED)
def split_header(text: pa.Array) -> pa.Array:
    """struct(header, kinds, body, error): missing_header for none, malformed for one that is no mapping.

    Values that aren't text are given as JSON, dates as ISO; `kinds` says what they were: str, int, float, bool, list, map, date, null.
    """
    rows = []
    for t in text.to_pylist():
        fields, body, error = parsed(t)
        if fields is None:
            rows.append((None, None, body, error))
        else:
            rows.append(([(k, as_text(v)) for k, v in fields.items()], [(k, kind_of_value(v)) for k, v in fields.items()], body, None))
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ARROW_PARSED, strict=True)], [n for n, _ in _ARROW_PARSED])


def parsed(text: str | None) -> tuple[dict | None, str | None, str | None]:
    """(header, body, error) of a file's text; the header's values as YAML has them."""
    m = _HEADER.match(text or "")
    if m is None:
        return None, text, "missing_header"
    try:
        fields = yaml.load(m[1], _LOADER) if yaml else parse_header(m[1])
    except (ValueError, *([yaml.YAMLError] if yaml else [])):
        fields = None
    if not isinstance(fields, dict):
        return None, text[m.end() :], "malformed"
    return {str(k): v for k, v in fields.items()}, text[m.end() :], None


def header_end(text: str) -> int:
    """Where the body begins."""
    m = _HEADER.match(text)
    return m.end() if m else 0


def as_text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else json.dumps(v, ensure_ascii=False, default=str)


def kind_of_value(v) -> str:
    for kind, types in (("null", type(None)), ("str", str), ("bool", bool), ("int", int), ("float", float), ("list", list), ("map", dict)):
        if isinstance(v, types):
            return kind
    return "date"


_PLAIN = re.compile(r"[A-Za-z\u00c0-\uffff][^:#\[\]{}\"'&*!|>%@`\n]*\Z")
_WORDS = {"true", "false", "yes", "no", "on", "off", "null"}


def dumped(header: dict) -> str:
    """A header in block style, its fields in the order given, long values on one line."""
    if yaml:
        return yaml.safe_dump(header, allow_unicode=True, sort_keys=False, default_flow_style=False, width=1 << 20).strip()
    one = lambda v: v if isinstance(v, str) and _PLAIN.match(v) and v == v.strip() and v.lower() not in _WORDS else json.dumps(v, ensure_ascii=False, default=str)
    return "\n".join("\n".join([f"{k}:", *[f"- {one(x)}" for x in v]]) if isinstance(v, list) and v else f"{k}: {one(v)}" for k, v in header.items())


def read_markdown(spark: SparkSession, folder: str, names: str = "*.md") -> DataFrame:
    """(path, header, body, error) of all files below a folder but those in hidden folders."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(folder, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike("/\\.[^/]"))
    return raw.withColumn("p", split_header(F.col("text"))).select("path", "p.header", "p.kinds", "p.body", "p.error")


def header_text(fields: Column) -> Column:
    """A header of the fields in alphabetical order, without empty ones; text in double quotes where it needs them."""
    quoted = lambda v: F.when(v.rlike("^\\[.*\\]$") | v.rlike("^[0-9A-Za-z][-/._ 0-9A-Za-z]*$"), v).otherwise(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"')))
    entries = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: v.isNotNull() & (v != "") & (v != "[]"))))
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def write_markdown(files: DataFrame, folder: str) -> None:
    """Files (header, body, ...) as text, one row a file's text; Spark's commit protocol makes the folder appear whole."""
    files.select(F.concat(header_text(F.col("header")), F.coalesce("body", F.lit(""))).alias("value")).write.text(folder, lineSep="\x1e")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, bytes): the files (path below the folder, text), each a file of its own.

    Executors write below `folder`, which they share: first to a name of their own, then renamed, so a file
    appears whole, and one that a lost task wrote is written over. The result is to be read to run it; paths
    that are null, absolute or hold .. are an error, a null text is an empty file.
    """
    from pyarrow import fs

    def run(batches):
        import uuid

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for pdf in batches:
            sizes = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"no path below the folder: {path!r}")
                at, data = f"{root}/{path}", (text or "").encode()
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, at)
                sizes.append(len(data))
            yield pdf[["path"]].assign(bytes=sizes)

    return files.select("path", "text").mapInPandas(run, "path string, bytes long")
