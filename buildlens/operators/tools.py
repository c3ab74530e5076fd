"""The tools that a command may name: how its stored result is judged, where what it
discovers comes from, and what enters its signature beside the command itself.

Running processes is a side effect without rows; outcomes come in as tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_hash
from ..sources import text_files
from . import validity


class Tool(NamedTuple):
    validity: str  # outputs, directory, link, always or never
    discovers: tuple[str, ...] = ()  # styles of dependency files
    signed: tuple[str, ...] = ()  # attributes that enter the signature, in order


#: The tools' names and attributes.
TOOLS = {
    "shell": Tool("outputs", ("makefile", "dependency-info", "makefile-ignoring-subsequent-outputs"), ("args", "env", "deps", "deps-style", "inherit-env", "can-safely-interrupt", "working-directory", "control-enabled")),
    "phony": Tool("always"),
    "clang": Tool("outputs", ("makefile",), ("args", "deps")),
    "mkdir": Tool("directory"),
    "symlink": Tool("link", (), ("contents",)),
    "archive": Tool("outputs"),
    "shared-library": Tool("outputs", (), ("executable", "compiler-style", "other-args")),
    "stale-file-removal": Tool("never", (), ("expectedOutputs", "roots")),
    "swift-compiler": Tool("outputs", ("makefile",), ("executable", "module-name", "module-aliases", "module-output-path", "sources", "objects", "import-paths", "temps-path", "other-args", "is-library")),
}


def signature(commands: DataFrame) -> Column:
    """A command's signature: the declared one, else its tool, inputs, outputs and the
    attributes that its tool signs, in the tool's order."""
    attr = lambda a: F.concat_ws("=", F.lit(a), F.coalesce(F.element_at("attrs", a), F.array_join(F.element_at("list_attrs", a), "\0"), F.lit("")))
    parts = F.array().cast("array<string>")
    for name, tool in TOOLS.items():
        if tool.signed:
            parts = F.when(F.col("tool") == name, F.array(*map(attr, tool.signed))).otherwise(parts)
    whole = F.concat(F.array("tool"), F.col("inputs"), F.array(F.lit("|")), F.col("outputs"), F.array(F.lit("|")), parts)
    return F.coalesce(F.element_at("attrs", "signature"), fold_hash(whole))


def holds(tool: Column, kind: Column, stored: Column, now: Column, virtual: Column, mutated: Column) -> Column:
    """Whether a stored result holds, by the tool's own rule. stored, now: arrays of file infos."""
    by = {
        "outputs": validity.external_command(kind, F.lit(False), stored, now, virtual, mutated),
        "directory": validity.make_directory(kind, F.get(now, F.lit(0))),
        "link": validity.make_link(kind, F.get(stored, F.lit(0)), F.get(now, F.lit(0))),
        "always": kind == "SuccessfulCommand",
        "never": validity.never(),
    }
    out = F.lit(False)
    for name, t in TOOLS.items():
        out = F.when(tool == name, by[t.validity]).otherwise(out)
    return out


def discovered(files: DataFrame, style: str) -> DataFrame:
    """(file, dep) that dependency files of one style name. files: (file, content)."""
    if style == "dependency-info":
        return text_files.dependency_info(files).where("event = 'input'").select("file", F.col("operand").alias("dep"))
    if style not in ("makefile", "makefile-ignoring-subsequent-outputs"):
        raise ValueError(f"no such style: {style}")
    return text_files.make_dependencies(files, style != "makefile").select("file", "dep")
