"""Column functions on paths, globs, shell words, manifest strings, labels and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column, cwd: Column | str = "/") -> Column:
    """Absolute, without `//`, `.` and `..`; a slash at the end stays."""
    base = F.lit(cwd) if isinstance(cwd, str) else cwd
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path))
    parts = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(none)
    kept = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    out = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.endswith("/") & (F.size(kept) > 0), F.concat(out, F.lit("/"))).otherwise(out)


def trimmed(path: Column) -> Column:
    """Without slashes at the end, but for the root."""
    return F.when(path.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))


def under(path: Column, root: Column) -> Column:
    """Whether path is root or lies below it, by whole components."""
    p, r = trimmed(path), trimmed(root)
    return (p == r) | F.when(r == "/", p.startswith("/")).otherwise(p.startswith(F.concat(r, F.lit("/"))))


def ancestors(path: Column) -> Column:
    """The path itself and all paths above it, so that prefix joins become equi-joins."""
    parts = F.split(trimmed(path), "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.transform(made, lambda x: F.when((x == "") & path.startswith("/"), F.lit("/")).otherwise(x)))


def parent(path: Column) -> Column:
    cut = F.regexp_replace(trimmed(path), "/?[^/]*$", "")
    return F.when((cut == "") & path.startswith("/"), F.lit("/")).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.regexp_extract(trimmed(path), "[^/]*$", 0)


def node_kind(name: Column) -> Column:
    """Virtual names stand in angle brackets, directories end in a slash."""
    return F.when(name.rlike("^<.*>$"), "virtual").when(name.endswith("/"), "directory").otherwise("plain")


def glob_regex(pattern: Column) -> Column:
    """A shell pattern as a regular expression over the whole name; * crosses slashes."""
    out = F.regexp_replace(pattern, r"([\\.+^$(){}|])", r"\\$1")
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("^(?s)"), out, F.lit("$"))


def glob_match(name: Column, pattern: Column) -> Column:
    return F.regexp_like(name, glob_regex(pattern))


#: Characters that the shell takes as they are.
SAFE = r"^[A-Za-z0-9_@%+=:,./-]+$"


def shell_escape(word: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.regexp_replace(word, "'", "'\\\\''"), F.lit("'"))
    return F.when(word.rlike(SAFE), word).otherwise(quoted)


_PIECES = r"\$\{[A-Za-z0-9_.-]+\}|\$[A-Za-z0-9_-]+|\$\n[ \t]*|\$[\s\S]|[^$]+|\$"


def expand(value: Column, names: Column | Callable[[Column], Column]) -> Column:
    """A manifest string with `$name` and `${name}` looked up (unknown: empty), `$$`,
    `$:` and `$ ` unescaped and continued lines joined. names: MAP<STRING,STRING>, or
    a function from name to value."""
    find = names if callable(names) else lambda n: F.element_at(names, n)

    def one(p):
        return (
            F.when(~p.startswith("$"), p)
            .when(p.startswith("${"), F.coalesce(find(F.regexp_extract(p, r"^\$\{(.*)\}$", 1)), F.lit("")))
            .when(p.rlike(r"^\$[A-Za-z0-9_-]"), F.coalesce(find(F.substring(p, F.lit(2), F.length(p))), F.lit("")))
            .when(p.rlike(r"^\$\n"), F.lit(""))
            .otherwise(F.substring(p, F.lit(2), F.length(p)))
        )

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_PIECES), F.lit(0)), one), "")


def bad_escape(value: Column) -> Column:
    """Whether the string has a `$` that starts nothing known."""
    return value.rlike(r"(?<!\$)(?:\$\$)*\$(?:$|[^A-Za-z0-9_{$: \n-]|\{(?![A-Za-z0-9_.-]+\}))")


def fold_hash(values: Column, seed: Column | str = "") -> Column:
    """A hash of a list that depends on its order and on where its elements end."""
    start = F.md5(F.lit(seed).cast("binary")) if isinstance(seed, str) else F.md5(seed.cast("binary"))
    return F.aggregate(values, start, lambda acc, v: F.md5(F.concat_ws("|", acc, F.coalesce(F.length(v).cast("string"), F.lit("null")), F.coalesce(v, F.lit(""))).cast("binary")))


def content_id(data: Column, refs: Column | None = None) -> Column:
    """The id of an object: SHA-256 over its references' ids and its bytes."""
    data = data.cast("binary")
    return F.sha2(data if refs is None else F.concat(F.array_join(refs, "").cast("binary"), data), 256)


def canonical_id(hex_id: Column) -> Column:
    """The readable form of an id: 0~ and unpadded URL-safe Base64."""
    return F.concat(F.lit("0~"), F.rtrim(F.translate(F.base64(F.unhex(hex_id)), "+/=", "-_ ")))


def label_text(components: Column, name: Column) -> Column:
    """//a/b:c"""
    return F.concat(F.lit("//"), F.array_join(components, "/"), F.lit(":"), name)


def parse_label(text: Column) -> Column:
    """STRUCT<components, name>; null where the text is no label. Without a name after
    a colon the last component is the name."""
    path, name = F.regexp_extract(text, r"^//([^:]*)(?::([^:/]+))?$", 1), F.regexp_extract(text, r"^//([^:]*)(?::([^:/]+))?$", 2)
    components = F.filter(F.split(path, "/"), lambda p: p != "")
    label = F.struct(components.alias("components"), F.when(name != "", name).otherwise(F.element_at(components, -1)).alias("name"))
    return F.when(text.rlike(r"^//([^:]*)(:[^:/]+)?$") & ((name != "") | (F.size(components) > 0)), label)


def stable_id(tag: str, text: Column) -> Column:
    """A 16-digit hex id of a request."""
    return F.substring(F.sha2(F.concat(F.lit(tag + "\0"), text), 256), 1, 16)


def merge_last_wins(*maps: Column) -> Column:
    """The maps as one; later ones win."""
    entries = F.concat(*[F.map_entries(m) for m in maps])
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def merge_first_wins(*maps: Column) -> Column:
    """Environment blocks: a name that is set is not set again."""
    return merge_last_wins(*reversed(maps))
