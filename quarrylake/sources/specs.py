"""Specifications read by tasks, which give the operations of each OpenAPI text or the definitions of each protobuf file, and
names that one file takes from another are resolved by joins."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrylake.sources.bundle import sliced
from quarrylake.sources.harvest import DEFINITION, OPERATION, parse_proto, spec_operations
from quarrylake.storage import checkpointed, ship, shuffled


def _read(files: DataFrame, parse: Callable[[str], list[tuple]], failures: tuple, schema: str) -> DataFrame:
    """file, the columns of `schema` for each row that parse gives of a text, error; a failure is one row with its error. Texts are parsed in
    Arrow batches, a few at a time."""
    spark = ship(files.sparkSession)
    own = [files.schema["file"], *spark.createDataFrame([], f"{schema}, error string").schema]
    arrow = to_arrow_schema(StructType(own))
    empty = (None,) * (len(own) - 2)

    def run(batches):
        for b in sliced(batches):
            rows = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(file, *r, None) for r in parse(text)]
                except failures as e:
                    rows.append((file, *empty, f"{type(e).__name__}: {' '.join(str(e).split())}"[:300]))
            columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.where("text is not null").select("file", "text").mapInArrow(run, StructType(own))


def operations(files: DataFrame) -> DataFrame:
    """(file, the columns of an operation, error) of files(file, text), OpenAPI in YAML or JSON, version 2 or 3; a text that can't be read
    is one row with its error."""
    return _read(files, spec_operations, (yaml.YAMLError, AttributeError, TypeError, KeyError, ValueError), OPERATION)


def definitions(files: DataFrame) -> DataFrame:
    """(file, the columns of a definition, error) of files(file, text), protobuf files; names are resolved within each file."""
    return _read(files, parse_proto, (IndexError, KeyError, ValueError), DEFINITION)


def methods(defs: DataFrame) -> DataFrame:
    """(file, fqn, pos, method) of the methods of definitions(), one row each, their message names resolved over all files: a name is looked for
    in the package of its service, then in the packages around it, and stays as it is if it isn't there. An equi join with a row for each
    place to look in. defs is read more than once."""
    known = defs.where("kind = 'message'").select(F.col("fqn").alias("full")).distinct()
    scopes = F.when(F.col("package") == "", F.array().cast("array<string>")).otherwise(F.split("package", r"\."))
    each = defs.where("kind = 'service'").select("file", "fqn", scopes.alias("scopes"), F.posexplode("methods").alias("pos", "m"))
    ends = each.select("file", "fqn", "pos", "m", "scopes", F.explode(F.array(F.struct(F.lit("request").alias("role"), F.col("m.request").alias("name")), F.struct(F.lit("response").alias("role"), F.col("m.response").alias("name")))).alias("e"))
    tries = F.transform(F.sequence(F.size("scopes"), F.lit(0), F.lit(-1)), lambda n: F.concat_ws(".", F.slice("scopes", F.lit(1), n), F.col("e.name")))
    found = ends.select("file", "fqn", "pos", "e.role", F.posexplode(tries).alias("rank", "full")).join(shuffled(known), "full").groupBy("file", "fqn", "pos").agg(
        F.min(F.when(F.col("role") == "request", F.struct("rank", "full")))["full"].alias("request"), F.min(F.when(F.col("role") == "response", F.struct("rank", "full")))["full"].alias("response")
    )
    full = each.join(shuffled(found), ["file", "fqn", "pos"], "left")
    method = F.struct(F.col("m.name").alias("name"), F.coalesce("request", "m.request").alias("request"), F.coalesce("response", "m.response").alias("response"), F.col("m.comment").alias("comment"))
    return full.select("file", "fqn", "pos", method.alias("method"))


def resolved(defs: DataFrame) -> DataFrame:
    """definitions() with the message names of methods resolved, as in methods(). What was read of the files is stored, so each is parsed
    once; messages take no part in the joins."""
    defs = checkpointed(defs)
    lists = methods(defs).groupBy("file", "fqn").agg(F.array_sort(F.collect_list(F.struct("pos", "method"))).alias("ms"))
    lists = lists.select("file", "fqn", F.col("ms.method").alias("_methods"))
    services = defs.where("kind = 'service'").join(shuffled(lists), ["file", "fqn"], "left")
    services = services.select(*[F.coalesce("_methods", "methods").alias("methods") if c == "methods" else F.col(c) for c in defs.columns])
    return defs.where("kind is null or kind != 'service'").unionByName(services)
