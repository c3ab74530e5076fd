"""Whether stored results still hold: one boolean expression for each kind of rule.

File infos are STRUCTs as `schema.FILE_INFO` has them, without the path. All zeros mean
that the file is missing. Two infos are equal if all but the mode are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File-type bits of a mode, and those of a directory.
TYPE_BITS, DIRECTORY = 0o170000, 0o040000
COMPARED = ("device", "inode", "size", "mtime_s", "mtime_ns", "checksum")
KINDS = (
    "Invalid", "VirtualInput", "ExistingInput", "MissingInput", "DirectoryContents", "DirectoryTreeSignature",
    "DirectoryTreeStructureSignature", "StaleFileRemoval", "MissingOutput", "FailedInput", "SuccessfulCommand",
    "FailedCommand", "PropagatedFailureCommand", "CancelledCommand", "SkippedCommand", "Target",
    "FilteredDirectoryContents", "SuccessfulCommandWithOutputSignature",
)


def is_missing(info: Column) -> Column:
    zero = [F.coalesce(info[c], F.lit(0)) == 0 for c in ("device", "inode", "mode", "size", "mtime_s", "mtime_ns")]
    out = info.isNull()
    every = zero[0]
    for x in zero[1:]:
        every = every & x
    return out | every


def is_directory(info: Column) -> Column:
    return info["mode"].bitwiseAND(F.lit(TYPE_BITS)) == DIRECTORY


def same_file(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for c in COMPARED:
        out = out & a[c].eqNullSafe(b[c])
    return out


def is_kind(kind: Column, *names: str) -> Column:
    unknown = set(names) - set(KINDS)
    if unknown:
        raise ValueError(f"no such kind: {sorted(unknown)}")
    return kind.isin(*names)


def file_input(kind: Column, stored: Column, now: Column) -> Column:
    """A file without a producer: it is missing as before, or is there unchanged."""
    return F.when(is_missing(now), kind == "MissingInput").otherwise((kind == "ExistingInput") & same_file(stored, now))


def produced_node(kind: Column) -> Column:
    return ~kind.isin("FailedInput", "MissingInput")


def virtual_input(kind: Column) -> Column:
    return kind == "VirtualInput"


def directory_contents(kind: Column, stored_names: Column, stored: Column, now_names: Column, now: Column) -> Column:
    """The path is as much a directory as before, and lists the same names."""
    gone = F.when(is_missing(now), kind == "MissingInput")
    plain = gone.when(~is_directory(now), (kind == "ExistingInput") & same_file(stored, now))
    return plain.otherwise((kind == "DirectoryContents") & stored_names.eqNullSafe(now_names))


def never() -> Column:
    """Stats, targets and the removal of stale files are done anew in each build."""
    return F.lit(False)


def external_command(kind: Column, always: Column, stored: Column, now: Column, virtual: Column, mutated: Column) -> Column:
    """A command's outputs, given as arrays in one order: those that it changes in place
    need only be there as before, virtual ones count for nothing."""
    rows = F.arrays_zip(stored.alias("a"), now.alias("b"), virtual.alias("v"), mutated.alias("m"))
    one = lambda x: x["v"] | F.when(x["m"], is_missing(x["a"]) == is_missing(x["b"])).otherwise(same_file(x["a"], x["b"]))
    return ~always & kind.isin("SuccessfulCommand", "SuccessfulCommandWithOutputSignature") & (F.size(stored) == F.size(now)) & F.forall(rows, one)


def make_directory(kind: Column, now: Column) -> Column:
    return (kind == "SuccessfulCommand") & ~is_missing(now) & is_directory(now)


def make_link(kind: Column, stored_link: Column, now_link: Column) -> Column:
    return (kind == "SuccessfulCommand") & same_file(stored_link, now_link)


def ninja_command(kind: Column, stored_hash: Column, now_hash: Column, generator: Column, stored: Column, now: Column) -> Column:
    """As a command, and its text is the same unless it regenerates the manifest."""
    pairs = F.zip_with(stored, now, lambda a, b: same_file(a, b) & ~is_missing(b))
    return (kind == "SuccessfulCommand") & (generator | stored_hash.eqNullSafe(now_hash)) & (F.size(stored) == F.size(now)) & F.forall(pairs, lambda x: x)


def modified_outputs_allowed(kind: Column, now: Column) -> Column:
    """The stored result stands as long as all outputs are there."""
    return (kind == "SuccessfulCommand") & F.forall(now, lambda x: ~is_missing(x))


def newest(infos: Column) -> Column:
    """The greatest (seconds, nanoseconds) of the files."""
    return F.array_max(F.transform(infos, lambda x: F.struct(x["mtime_s"].alias("s"), x["mtime_ns"].alias("ns"))))


def updated_if_newer(outputs: Column, newest_input: Column, same_text: Column, strict: Column | bool = False) -> Column:
    """All outputs are there and none is older than the newest input (strict: all newer)."""
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    time = lambda x: F.struct(x["mtime_s"].alias("s"), x["mtime_ns"].alias("ns"))
    fresh = lambda x: F.when(strict, time(x) > newest_input).otherwise(time(x) >= newest_input)
    return same_text & F.forall(outputs, lambda x: ~is_missing(x) & F.coalesce(fresh(x), F.lit(True)))


def device_agnostic(info: Column) -> Column:
    """An info without what differs between copies of one disk."""
    return info.withField("device", F.lit(0).cast("decimal(20,0)")).withField("inode", F.lit(0).cast("decimal(20,0)"))


def checksum_only(info: Column, checksum: Column) -> Column:
    """An info that compares by content."""
    return device_agnostic(info).withField("mtime_s", F.lit(0).cast("long")).withField("mtime_ns", F.lit(0)).withField("checksum", checksum)
