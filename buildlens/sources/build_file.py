"""YAML build files: client, tools, targets, default, nodes and commands, in this order.

One file is parsed at a time, in the executors; its entities come out as rows, so that
all the rest is joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import reach_workers

SECTIONS = ("client", "tools", "targets", "default", "nodes", "commands")
ENTITY = "file string, section string, name string, attrs map<string,string>, list_attrs map<string,array<string>>, error string"


def entities(files: DataFrame) -> DataFrame:
    """One row for each entity of files (file, content), or error, in ENTITY's columns."""
    import pandas as pd

    reach_workers(files.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.file, batch.content):
                yield pd.DataFrame(list(parsed(file, content)), columns=["file", "section", "name", "attrs", "list_attrs", "error"])

    return files.select("file", "content").mapInPandas(rows, ENTITY)


def parsed(file: str, content: str | None):
    """The rows of one file."""
    import yaml

    bad = lambda message: (file, None, None, {}, {}, message)
    try:
        top = yaml.compose(content or "", Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        yield bad(f"no YAML: {getattr(e, 'problem', e)}")
        return
    if not isinstance(top, yaml.MappingNode):
        yield bad("no map at the top")
        return
    last = -1
    for key, value in top.value:
        if key.value not in SECTIONS:
            yield bad(f"unknown section {key.value}")
            continue
        if SECTIONS.index(key.value) <= last:
            yield bad(f"section {key.value} out of order")
        last = max(last, SECTIONS.index(key.value))
        if key.value == "default":
            yield (file, "default", value.value, {}, {}, None)
        elif not isinstance(value, yaml.MappingNode):
            yield bad(f"section {key.value} is no map")
        elif key.value == "client":
            yield (file, "client", None, {k.value: v.value for k, v in value.value}, {}, None)
        else:
            seen = set()
            for name, body in value.value:
                if name.value in seen:
                    yield bad(f"duplicate {key.value} {name.value}")
                    continue
                seen.add(name.value)
                if isinstance(body, yaml.SequenceNode):
                    yield (file, key.value, name.value, {}, {"nodes": [x.value for x in body.value]}, None)
                elif isinstance(body, yaml.MappingNode):
                    if key.value == "commands" and (not body.value or body.value[0][0].value != "tool"):
                        yield bad(f"command {name.value} doesn't begin with its tool")
                        continue
                    lists = {k.value: [x.value for x in v.value] for k, v in body.value if isinstance(v, yaml.SequenceNode)}
                    yield (file, key.value, name.value, {k.value: v.value for k, v in body.value if isinstance(v, yaml.ScalarNode)}, lists, None)
                else:
                    yield bad(f"{key.value} {name.value} has a wrong type")


def commands(rows: DataFrame) -> DataFrame:
    """schema.COMMANDS of a file's entities."""
    empty = F.array().cast("array<string>")
    one = lambda n: F.coalesce(F.element_at("list_attrs", n), empty)
    rest = lambda m, *names: F.map_filter(m, lambda k, _: ~k.isin(*names))
    return rows.where("section = 'commands'").select("name", F.element_at("attrs", "tool").alias("tool"), one("inputs").alias("inputs"), one("outputs").alias("outputs"), rest("attrs", "tool").alias("attrs"), rest("list_attrs", "inputs", "outputs").alias("list_attrs"))


def targets(rows: DataFrame) -> DataFrame:
    """(target, node, ordinal)"""
    return rows.where("section = 'targets'").select(F.col("name").alias("target"), F.posexplode(F.element_at("list_attrs", "nodes")).alias("ordinal", "node")).select("target", "node", "ordinal")


def nodes(rows: DataFrame) -> DataFrame:
    """schema.NODES of the declared nodes."""
    from ..functions.text import node_kind

    declared = F.element_at("attrs", "type")
    flag = lambda n: F.coalesce(F.element_at("attrs", n) == "true", F.lit(False))
    lists = lambda n: F.coalesce(F.element_at("list_attrs", n), F.array().cast("array<string>"))
    kind = F.when((declared == "directory") | flag("is-directory"), "directory").when((declared == "directory-structure") | flag("is-directory-structure"), "structure").when((declared == "virtual") | flag("is-virtual"), "virtual").when(declared == "plain", "plain").otherwise(node_kind(F.col("name")))
    return rows.where("section = 'nodes'").select("name", kind.alias("kind"), flag("is-mutated").alias("mutated"), flag("is-command-timestamp").alias("command_timestamp"), lists("content-exclusion-patterns").alias("exclusion_patterns"), lists("must-scan-after-paths").alias("must_scan_after"))


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("file", "error")
