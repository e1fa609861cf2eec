"""Scans of seed files: CSV, JSON and JSON Lines, one file per row of a binary scan.

A file that breaks its own form gives an issue row, never an exception; records and issues come from one pass. Files
are small by contract (``max_bytes``), so a file is parsed by one task; many files run side by side.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import as_frame

# The columns of a seed file in their order.
HEADER = ("expected_entity_kind", "display_name", "website", "osm_id", "reference_urls", "note", "provenance")
REQUIRED = ("expected_entity_kind", "display_name", "provenance")
OPTIONAL = ("website", "osm_id", "note")
MAX_BYTES, MAX_RECORDS = 16 * 1024 * 1024, 100_000

SCHEMA = (
    "path string, kind string, locator string, row_number int, expected_entity_kind string, display_name string, website string, osm_id string, reference_urls array<string>, note string, provenance string, "
    "code string, detail string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Bad(ValueError):
    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(detail)
        self.code, self.detail = code, detail[:300]


def strict_json(text: str):
    """JSON without repeated keys and without numbers that aren't finite; ValueError otherwise."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key is repeated")
        return out

    def refuse(name):
        raise ValueError(f"{name} is no number")

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)


def _csv_rows(text: str) -> Iterator[tuple[int, object]]:
    """Line number and record (or issue) of every CSV row; the line is the last one a row reaches."""
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    try:
        head = next(reader, [])
        if not head or "" in head or len(set(head)) < len(head):
            raise _Bad("CSV_HEADER_INVALID", ",".join(head))
        if tuple(head) != HEADER:
            raise _Bad("CSV_HEADER_MISMATCH", ",".join(head))
        rows = []
        for row in reader:
            if not row:
                continue
            at = max(2, reader.line_num)
            rows.append((at, dict(zip(head, row, strict=True)) if len(row) == len(head) else _Bad("CSV_ROW_SHAPE_INVALID", f"{len(row)} of {len(head)} columns")))
    except csv.Error as e:
        raise _Bad("CSV_MALFORMED", str(e)) from e
    yield from rows


def _json_rows(text: str) -> Iterator[tuple[int, object]]:
    try:
        doc = strict_json(text)
    except ValueError as e:
        raise _Bad("JSON_MALFORMED", str(e)) from e
    if isinstance(doc, dict):
        yield 1, doc
    elif isinstance(doc, list):
        for k, item in enumerate(doc, 1):
            yield k, item if isinstance(item, dict) else _Bad("JSON_RECORD_INVALID", type(item).__name__)
    else:
        raise _Bad("JSON_ROOT_INVALID", type(doc).__name__)


def _line_rows(text: str) -> Iterator[tuple[int, object]]:
    for k, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                item = strict_json(line)
                yield k, item if isinstance(item, dict) else _Bad("JSONL_RECORD_INVALID", type(item).__name__)
            except ValueError as e:
                yield k, _Bad("JSONL_MALFORMED", str(e))


def _record(item: dict, is_csv: bool) -> dict:
    """The fields of a record in their types; _Bad if a field is missing, unknown or of another type."""
    missing, unknown = sorted(set(HEADER) - set(item)), sorted(set(item) - set(HEADER))
    if missing or unknown:
        raise _Bad("RECORD_INVALID", f"missing {missing}, unknown {unknown}")
    out = {}
    for name in (*REQUIRED, *OPTIONAL):
        value = item[name]
        if not isinstance(value, str) and (name in REQUIRED or is_csv or value is not None):
            raise _Bad("RECORD_INVALID", f"{name} is no text")
        out[name] = value.strip() or None if is_csv and name in OPTIONAL else value
    urls = item["reference_urls"]
    if is_csv:
        urls = [u.strip() for u in urls.split("|") if u.strip()]
    elif not isinstance(urls, list) or not all(isinstance(u, str) for u in urls):
        raise _Bad("RECORD_INVALID", "reference_urls is no list of texts")
    return out | {"reference_urls": urls}


def read_seed_file(path: str, content: bytes, kind: str, max_bytes: int = MAX_BYTES, max_records: int = MAX_RECORDS) -> list[dict]:
    """Records and issues of one file; kind is csv, json or jsonl."""
    shape = {"csv": _csv_rows, "json": _json_rows, "jsonl": _line_rows}
    pointer = {"csv": "line:{}", "json": "$[{}]", "jsonl": "line:{}"}
    base = {"path": path, "kind": kind}
    try:
        if not content:
            raise _Bad("FILE_EMPTY")
        if len(content) > max_bytes:
            raise _Bad("FILE_TOO_LARGE", f"{len(content)} of {max_bytes} bytes")
        if kind not in shape:
            raise _Bad("FORMAT_UNSUPPORTED", kind)
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError as e:
            raise _Bad("ENCODING_INVALID", f"byte {e.start}") from e
        rows = list(shape[kind](text))
        if len(rows) > max_records:
            raise _Bad("RECORD_LIMIT_EXCEEDED", f"{len(rows)} of {max_records}")
    except _Bad as e:
        return [base | {"code": e.code, "detail": e.detail}]
    out = []
    for at, item in rows:
        where = base | {"row_number": at, "locator": pointer[kind].format(at - (kind == "json"))}
        try:
            if isinstance(item, _Bad):
                raise item
            out.append(where | _record(item, kind == "csv"))
        except _Bad as e:
            out.append(where | {"code": e.code, "detail": e.detail})
    return out


def parse_seed_files(files: DataFrame, max_bytes: int = MAX_BYTES, max_records: int = MAX_RECORDS) -> DataFrame:
    """Records (``code`` null) and issues of files given as ``path`` and ``content``; the format is the path's ending."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[dict] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows += read_seed_file(path, bytes(content or b""), path.rsplit(".", 1)[-1].lower(), max_bytes, max_records)
                if len(rows) > 50_000:
                    yield as_frame(rows, _COLUMNS)
                    rows = []
            if rows:
                yield as_frame(rows, _COLUMNS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def scan_seed_files(spark: SparkSession, path: str, pattern: str = "*.{csv,json,jsonl}") -> DataFrame:
    """Records and issues of all seed files below a path."""
    return parse_seed_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))


def import_summary(parsed: DataFrame, atomic: bool = True) -> DataFrame:
    """Per file: valid records, issues and whether it is accepted, accepted in part or rejected."""
    by = parsed.groupBy("path").agg(F.count_if(F.col("code").isNull()).alias("valid"), F.count_if(F.col("code").isNotNull()).alias("issues"))
    partial = F.when(F.col("valid") > 0, "partial").otherwise("rejected") if not atomic else F.lit("rejected")
    return by.withColumn("outcome", F.when(F.col("issues") == 0, F.when(F.col("valid") > 0, "accepted").otherwise("rejected")).otherwise(partial))
