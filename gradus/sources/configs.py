"""Configurations of tasks: read from folders, merged, and made into tables.

They are small, written by people, and read on the driver; from there on they are
rows. YAML needs the yaml package, JSON none.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = re.compile(r"\$\{([^{}]+)\}")
CONFIG = "task string, alias string, config string, languages array<string>"


def parsed(path: str, text: str) -> dict:
    if path.endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as missing:
        raise ImportError(f"reading {path} needs the yaml package") from missing
    return yaml.safe_load(text) or {}


def merged(a: dict, b: dict) -> dict:
    """b over a: dicts key by key, lists as a union in order, all else replaced."""
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + [x for x in v if x not in out[k]]
        else:
            out[k] = v
    return out


def lookup(tree: dict, dotted: str):
    for name in dotted.split("."):
        tree = tree[name]
    return tree


def resolved(tree: dict, value=None, seen: tuple[str, ...] = ()):
    """``tree`` with every ``${a.b}`` replaced by what is found there; a text that is nothing else takes its type."""
    value = tree if value is None and not seen else value
    if isinstance(value, dict):
        return {k: resolved(tree, v, seen or ("",)) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved(tree, v, seen or ("",)) for v in value]
    if not isinstance(value, str):
        return value

    def found(name: str):
        if name in seen:
            raise ValueError(f"${{{name}}} refers to itself")
        return resolved(tree, lookup(tree, name), (*seen, name))

    whole = REFERENCE.fullmatch(value)
    return found(whole[1]) if whole else REFERENCE.sub(lambda m: str(found(m[1])), value)


def read_configs(spark: SparkSession, folder: str) -> dict:
    """All JSON and YAML files under a folder, in order of their paths, merged and with references resolved."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,yaml,yml}").text(folder, wholetext=True)
    tree: dict = {}
    for r in sorted(rows.select(F.col("_metadata.file_path").alias("path"), "value").collect()):
        tree = merged(tree, parsed(r.path, r.value))
    return resolved(tree)


def task_table(spark: SparkSession, tree: dict) -> DataFrame:
    """(task, alias, config, languages) of a tree ``{tasks: {name: {languages, aggregation_group, ...}}}``."""
    rows = [(name, c.get("aggregation_group"), json.dumps(c, sort_keys=True), list(c.get("languages") or [])) for name, c in sorted((tree.get("tasks") or {}).items())]
    return spark.createDataFrame(rows, CONFIG)
