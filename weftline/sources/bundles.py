"""Scans of configuration bundles: a tree of small YAML and JSON documents, checked against each other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import identity
from weftline.runtime import as_frame
from weftline.sources.seeds import strict_json

MAX_DOCUMENT = 1024 * 1024


def read_document(path: str, content: bytes) -> dict:
    """A YAML or JSON document as canonical JSON and its digest, or the code of what is wrong; repeated keys are refused."""
    import hashlib
    import json

    if len(content) > MAX_DOCUMENT:
        return {"issue": "DOCUMENT_TOO_LARGE"}
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return {"issue": "ENCODING_INVALID"}
    try:
        value = strict_json(text) if path.endswith(".json") else _yaml(text)
        body = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False, default=str)
    except (ValueError, TypeError) as e:
        return {"issue": "DOCUMENT_INVALID", "detail": str(e)[:300]}
    return {"document": body, "digest": "sha256:" + hashlib.sha256(body.encode()).hexdigest()}


def _yaml(text: str):
    """YAML by the safe loader, with repeated keys refused."""
    try:
        import yaml
    except ImportError:
        raise ValueError("no YAML reader is installed") from None

    class Once(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, deep=True) for k, _ in node.value]
            if len(set(map(str, keys))) < len(keys):
                raise ValueError("a key is repeated")
            return super().construct_mapping(node, deep)

    try:
        return yaml.load(text, Loader=Once)  # noqa: S506 (a safe loader)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def scan_bundle(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``document`` (canonical JSON), ``digest``, ``issue`` and ``detail`` of every document below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,yml,json}").load(path)
    columns = ["path", "document", "digest", "issue", "detail"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"path": p} | read_document(p, bytes(c or b"")) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            if rows:
                yield as_frame(rows, columns)

    return files.select("path", "content").mapInPandas(run, "path string, document string, digest string, issue string, detail string")


def bundle_digest(documents: DataFrame) -> DataFrame:
    """One row: the digest over all documents' names and digests in order, and their number."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = identity.json_object(digest=identity.json_text(F.col("digest")), name=identity.json_text(name))
    listed = F.array_sort(F.collect_list(F.struct(name.alias("name"), part.alias("part"))))
    return documents.filter("issue is null").agg(identity.digest(identity.json_array(F.transform(listed, lambda x: x["part"]))).alias("bundle_digest"), F.count(F.lit(1)).alias("documents"))
