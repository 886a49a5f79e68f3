"""Bundles of Markdown files with YAML front matter.

Files are listed first, by Spark's own file reader for trees without hidden names or by a walk for shared folders, and then read
and parsed by tasks in Arrow batches. Files that fail to parse become rows with parse_error.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.model import CONCEPTS, fields
from quarrylake.storage import ship

MAX_BYTES = 10 * 1024 * 1024
RESERVED = ("index.md", "log.md")
FILES = 256  # parsed at once
_PARSED = CONCEPTS


class _Loader(yaml.SafeLoader):
    """Dates and YAML 1.1 booleans stay text, and a repeated key is an error."""


class _FastLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """As _Loader, by libyaml where it is there."""


def _mapping(loader, node, deep=False):
    out = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in out:
            raise yaml.constructor.ConstructorError(None, None, f"key {key!r} is already defined", k.start_mark)
        out[key] = loader.construct_object(v, deep=True)
    return out


for _loader in (_Loader, _FastLoader):
    _loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    _loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    _loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def _loaded(text: str):
    """What libyaml reads; where it fails, what the slower parser reads or its message."""
    try:
        return yaml.load(text, Loader=_FastLoader)  # noqa: S506  a safe loader
    except yaml.YAMLError:
        return yaml.load(text, Loader=_Loader)  # noqa: S506  a safe loader


def split_front_matter(text: str) -> tuple[str | None, str]:
    """(front matter or None, body). A first line '---' opens it and the next one closes it; unclosed, all is front matter.

    Carriage returns at line ends and the last line end go, and so do blank lines before the body.
    """
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if lines and lines[-1] == "":
        lines.pop()
    if not lines or lines[0].strip() != "---":
        return None, _body(lines)
    for i, x in enumerate(lines[1:], 1):
        if x.strip() == "---":
            return "\n".join(lines[1:i]), _body(lines[i + 1 :])
    return "\n".join(lines[1:]), ""


def _body(lines: list[str]) -> str:
    start = next((i for i, x in enumerate(lines) if x != ""), len(lines))
    return "\n".join(lines[start:])


def _scalar(x, name: str) -> str | None:
    if x is None:
        return None
    if isinstance(x, (dict, list)):
        raise ValueError(f"{name}: a single value is expected")
    return json.dumps(x) if isinstance(x, bool) else str(x)


def _record(x, names: dict[str, str], name: str) -> dict | None:
    if x is None:
        return None
    if not isinstance(x, dict):
        raise ValueError(f"{name}: a mapping is expected")
    return {n: int(x[n]) if k == "int" and x.get(n) is not None else _scalar(x.get(n), f"{name}.{n}") for n, k in names.items()}


def _list(x, name: str) -> list | None:
    if x is not None and not isinstance(x, list):
        raise ValueError(f"{name}: a list is expected")
    return x


_ACTOR = {"by": "string", "at": "string", "tier": "string"}
_SOURCE = {"uri": "string", "title": "string", "author": "string", "usage_count": "int", "last_modified": "string"}
_TEXT = ("type", "title", "description", "resource", "timestamp", "stale_after", "status")


def parse_metadata(text: str) -> dict:
    """Typed fields of YAML front matter; other keys go to `extra` as JSON. A key that ends in _version is the format's version."""
    data = _loaded(text)
    if data is None:
        data = {}
    if not isinstance(data, dict):
        raise ValueError("front matter is not a mapping")
    out = {n: _scalar(data.pop(n, None), n) for n in _TEXT}
    tags = _list(data.pop("tags", None), "tags")
    out["tags"] = None if tags is None else [_scalar(t, "tags") for t in tags]
    sources = _list(data.pop("sources", None), "sources")
    out["sources"] = None if sources is None else [_record(s, _SOURCE, "sources") for s in sources]
    out["generated"] = _record(data.pop("generated", None), _ACTOR, "generated")
    verified = _list(data.pop("verified", None), "verified")
    out["verified"] = None if verified is None else [_record(v, _ACTOR, "verified") for v in verified]
    out["attestation"] = _record(data.pop("attestation", None), {"query": "string", "executor": "string", "attester": "string"}, "attestation")
    version = next((k for k in data if isinstance(k, str) and k.endswith("_version")), None)
    out["format_version"] = _scalar(data.pop(version), "version") if version else None
    out["extra"] = {str(k): json.dumps(v, sort_keys=True, ensure_ascii=False, default=str) for k, v in data.items()} or None
    return out


_CITATION = re.compile(r"^\s*(?:[-*]\s+)?\[(\d+)\]:?\s*(?:\[([^\]]*)\]\(([^)]*)\)|(\S+))")


def parse_citations(body: str) -> list[dict]:
    """Citations of the sections headed `Citations`: [n] [title](uri), or [n] uri, which is its own title."""
    out, inside = [], False
    for line in body.split("\n"):
        s = line.strip()
        if s.startswith("#"):
            inside = s.lstrip("#").strip().lower() == "citations"
        elif inside and (m := _CITATION.match(line)):
            uri = m[3] if m[3] is not None else m[4]
            out.append({"number": int(m[1]), "title": m[2] if m[3] is not None else uri, "uri": uri})
    return out


def parse_concept(path: str, text: str) -> dict:
    """A concept of a file's path and text; if its front matter fails, only id, path and parse_error."""
    base = dict.fromkeys(fields()) | {"id": path.removesuffix(".md"), "path": path}
    front, body = split_front_matter(text)
    try:
        return base | (parse_metadata(front) if front is not None else {}) | {"body": body, "citations": parse_citations(body)}
    except (yaml.YAMLError, ValueError) as e:
        return base | {"parse_error": f"failed to parse frontmatter: {' '.join(str(e).split())}"}


def is_concept_file(name: str) -> bool:
    return name.endswith(".md") and name not in RESERVED


def too_large(size: int, most: int) -> str:
    return f"file size {size} exceeds the limit of {most} bytes"


def list_files(root: str) -> list[tuple[str, int]]:
    """(relative path, bytes) of the files below root that end in .md and are not reserved, hidden folders included."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    out = []
    for folder, _, names in os.walk(root):
        for n in names:
            full = os.path.join(folder, n)
            if is_concept_file(n) and os.path.isfile(full):
                out.append((os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)))
    return sorted(out)


def file_ids(files: DataFrame) -> DataFrame:
    """(id) of the concepts of files(path, ...), by their paths alone: no file is read or parsed."""
    return files.select(F.regexp_replace("path", r"\.md\z", "").alias("id"))


def sliced(batches):
    """Record batches in slices of FILES rows at most, so that what is parsed at once doesn't grow with what Spark hands over."""
    for b in batches:
        yield from (b.slice(i, FILES) for i in range(0, b.num_rows, FILES))


def parse_files(files: DataFrame) -> DataFrame:
    """Concepts of files(path, content), content null and parse_error given where a file was not read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = ship(files.sparkSession)
    schema = spark.createDataFrame([], CONCEPTS).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in sliced(batches):
            rows = []
            for path, content, error in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if error is not None:
                    rows.append(dict.fromkeys(fields()) | {"id": path.removesuffix(".md"), "path": path, "parse_error": error})
                else:
                    try:
                        rows.append(parse_concept(path, content.decode("utf-8")))
                    except UnicodeDecodeError as e:
                        rows.append(dict.fromkeys(fields()) | {"id": path.removesuffix(".md"), "path": path, "parse_error": f"not UTF-8: {e.reason}"})
            for r in rows:
                if r["extra"] is not None:
                    r["extra"] = list(r["extra"].items())
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return files.select("path", "content", "parse_error").mapInArrow(run, schema)


def read_bundle(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Concepts of the bundle in a folder that driver and executors share. Larger files than max_bytes (10 MiB if not above 0) are
    rows with parse_error and are not read."""
    most = max_bytes if max_bytes > 0 else MAX_BYTES
    listed = list_files(root)
    n = max(1, min(len(listed) // 64 + 1, spark.sparkContext.defaultParallelism * 4))
    paths = spark.createDataFrame(listed, "path string, size bigint").repartition(n)

    def run(batches):
        for b in batches:
            paths, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            content, errors = [], []
            for p, s in zip(paths, sizes, strict=True):
                if s > most:
                    content.append(None), errors.append(too_large(s, most))
                else:
                    with open(os.path.join(root, p), "rb") as f:
                        content.append(f.read())
                    errors.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "parse_error"])

    return parse_files(paths.mapInArrow(run, "path string, content binary, parse_error string"))


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """As read_bundle, by Spark's binary file source, for any store that Spark reads; names that start with '_' or '.' are not seen."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    path = F.expr("parse_url(path, 'PATH')") if "://" in root else F.regexp_replace("path", "^file:/+", "/")
    f = f.select(F.substring(path, F.length(base) + 1, F.length(path)).alias("path"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"), F.when(F.col("length") > max_bytes, F.concat(F.lit("file size "), F.col("length").cast("string"), F.lit(f" exceeds the limit of {max_bytes} bytes"))).alias("parse_error"))
    return parse_files(f.where(~F.regexp_extract("path", "([^/]*)$", 1).isin(*RESERVED)))


def version_of(text: str) -> str | None:
    """The format's version in the front matter of an index file; nothing if it has none or can't be read."""
    front, _ = split_front_matter(text)
    try:
        return parse_metadata(front)["format_version"] if front else None
    except (yaml.YAMLError, ValueError):
        return None


def versions(files: DataFrame) -> DataFrame:
    """(path, version) of files(path, content), the index files of bundles."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            found = [None if x is None else version_of(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["path", "version"])

    return files.select("path", "content").mapInArrow(run, "path string, version string")


def bundle_version(root: str) -> str | None:
    """The format's version in the front matter of the root's index.md."""
    path = os.path.join(root, "index.md")
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        return version_of(f.read())
