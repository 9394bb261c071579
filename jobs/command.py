"""What the jobs' command lines share: arguments, config files, logging, and one session a run."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

log = logging.getLogger("lipika.jobs")
C = TypeVar("C")


def read_config(kind: type[C], path: str | None) -> C:
    """The config that a JSON file describes; names that kind doesn't have are errors, lists become tuples. Without a file, the defaults."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {x.name for x in dataclasses.fields(kind)}
    if wrong := set(given) - known:
        raise ValueError(f"{path}: unknown {', '.join(sorted(wrong))}; known are {', '.join(sorted(known))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def rows_at(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The rows that a job has written under path, none if it has written nothing yet."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def main(name: str, inputs: list[str], kind: type, run: Callable[..., dict], argv: list[str] | None = None) -> None:
    """Runs a job from the command line: one --option for each input, --out and --config. Creates the session and stops it."""
    p = argparse.ArgumentParser(prog=name, description=(run.__doc__ or "").splitlines()[0])
    for x in [*inputs, "out"]:
        p.add_argument(f"--{x}", required=True, help=f"path of {x}")
    p.add_argument("--config", help="JSON file; the defaults without it")
    p.add_argument("--master", help="Spark master; that of the environment without it")
    a = p.parse_args(argv)
    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)  # a folder that is not there yet is no error
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(name)
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        run(spark, *[getattr(a, x) for x in inputs], a.out, read_config(kind, a.config))
    finally:
        spark.stop()
