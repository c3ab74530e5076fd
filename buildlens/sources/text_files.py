"""Dependency files, traces, snapshots and manifests as DataFrames.

All of them are read with Spark's text and binary readers, and taken apart by column
functions, so a folder of very many files is read in parallel and nothing is opened on
the driver. A file is one row, so what is bounded is one file, not a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import expand
from ..shared import written


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


# Make-style dependency files

# Repeated alternatives are possessive: Java walks them in a loop, where it would go one
# call deeper for each character of a long word or line otherwise.
_MAKE_WORD = r"(?:\\[\s\S]|\$\$|[^\s\\])++"


def _unescaped(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"\\([ #\\])", "$1"), r"\$\$", r"\$")


def make_dependencies(files: DataFrame, first_rule_only: bool = False) -> DataFrame:
    """(file, rule, dep, ordinal) of files (file, content): each rule's dependencies in
    order. A name may hold colons; the one before white space ends a rule's names."""
    joined = F.regexp_replace("content", r"\\\r?\n", " ")
    lines = files.select("file", F.posexplode(F.split(joined, r"\r?\n")).alias("line", "text")).where(~F.col("text").rlike(r"^\s*(#.*)?$"))
    words = F.regexp_extract_all("text", F.lit(_MAKE_WORD), F.lit(0))
    # a colon may stand alone or end a name
    words = F.filter(F.flatten(F.transform(words, lambda w: F.when((F.length(w) > 1) & w.endswith(":"), F.array(w.substr(F.lit(1), F.length(w) - 1), F.lit(":"))).otherwise(F.array(w)))), lambda w: w != "")
    rows = lines.select("file", "line", words.alias("words")).withColumn("colon", F.array_position("words", ":").cast("int"))
    if first_rule_only:
        first = rows.where("colon > 0").groupBy("file").agg(F.min("line").alias("line"))
        rows = rows.join(first, ["file", "line"], "left_semi")
    rules = rows.where("colon > 1").select("file", "line", F.explode(F.slice("words", F.lit(1), F.col("colon") - 1)).alias("rule"), F.slice("words", F.col("colon") + 1, F.size("words")).alias("deps"))
    return rules.select("file", "line", _unescaped(F.col("rule")).alias("rule"), F.posexplode("deps").alias("ordinal", "dep")).select("file", "line", "rule", _unescaped(F.col("dep")).alias("dep"), "ordinal")


def make_errors(files: DataFrame) -> DataFrame:
    """(file, line, message) of lines that are no rule."""
    joined = F.regexp_replace("content", r"\\\r?\n", " ")
    lines = files.select("file", F.posexplode(F.split(joined, r"\r?\n")).alias("line", "text")).where(~F.col("text").rlike(r"^\s*(#.*)?$"))
    return lines.where(~F.col("text").rlike(r"\S\s*:(\s|$)")).select("file", "line", F.when(F.col("text").rlike(r"^\s*:"), "missing rule name").otherwise("missing ':'").alias("message"))


# Dependency information of linkers: records of an operation code and a NUL-ended string

OPERATIONS = {0x00: "version", 0x10: "input", 0x11: "missing", 0x40: "output"}


def dependency_info(files: DataFrame) -> DataFrame:
    """(file, ordinal, offset, event, operand) of files (file, content: BINARY). Bad files
    have an event `error`, whose operand says what is wrong."""
    text = F.decode("content", "ISO-8859-1")
    # a record's code may itself be NUL, so records are taken by pattern, not by splitting
    records = F.regexp_extract_all(text, F.lit(r"[\s\S][^\x00]*\x00"), F.lit(0))
    rows = files.select("file", text.alias("text"), records.alias("records"))
    length = F.aggregate("records", F.lit(0), lambda acc, r: acc + F.length(r))
    cut = rows.select("file", "text", "records", (length < F.length("text")).alias("open"), length.alias("length"))
    each = cut.select("file", "records", F.posexplode("records").alias("ordinal", "record"))
    each = each.withColumn("offset", F.aggregate(F.slice("records", F.lit(1), F.col("ordinal")), F.lit(0), lambda acc, r: acc + F.length(r)))
    code, operand = F.ascii(F.substring("record", 1, 1)), F.expr("substring(record, 2, length(record) - 2)")
    names = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    event = F.element_at(names, code)
    bad = (
        F.when((F.col("ordinal") == 0) & ~event.eqNullSafe(F.lit("version")), "missing version")
        .when((F.col("ordinal") > 0) & (event == "version"), "duplicate version")
        .when(event.isNull(), "unknown operation")
        .when(operand == "", "empty operand")
    )
    good = each.select("file", "ordinal", "offset", F.when(bad.isNotNull(), "error").otherwise(event).alias("event"), F.coalesce(bad, F.decode(F.encode(operand, "ISO-8859-1"), "UTF-8")).alias("operand"))
    ends = cut.where("open").select("file", F.size("records").alias("ordinal"), F.length("text").alias("offset"), F.lit("error").alias("event"), F.lit("missing terminator").alias("operand"))
    none = cut.where("length = 0 AND NOT open").select("file", F.lit(0).alias("ordinal"), F.lit(0).alias("offset"), F.lit("error").alias("event"), F.lit("missing version").alias("operand"))
    return good.unionByName(ends).unionByName(none)


# Traces: lines of { "tag", "a1", "a2", "a3" },


def trace_events(lines: DataFrame) -> DataFrame:
    """schema.TRACE_EVENTS of lines (seq, value); other lines are left out."""
    args = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1))
    clean = F.transform(args, lambda a: F.regexp_replace(a, r"\\(.)", "$1"))
    rows = lines.where(F.col("value").rlike(r'^\s*\{\s*"')).select("seq", clean.alias("a"))
    return rows.select("seq", F.get("a", F.lit(0)).alias("tag"), *[F.get("a", F.lit(i)).alias(f"a{i}") for i in (1, 2, 3)])


def named(events: DataFrame) -> DataFrame:
    """Rule events with the key that their short name R<n> stands for, from `new-rule` rows."""
    names = events.where("tag = 'new-rule'").select(F.col("a1").alias("__r"), F.col("a2").alias("key"))
    return events.join(names, F.col("a1") == F.col("__r"), "left").drop("__r")


# Snapshots of files


def snapshot(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """schema.FILE_INFO of the files below path. Where the store has no devices and inodes,
    they are 0; content is read only for checksums."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    zero = F.lit(0).cast("decimal(20,0)")
    seconds = F.unix_micros("modificationTime")
    checksum = F.unhex(F.sha2("content", 256)) if checksums else F.unhex(F.lit("00" * 32))
    return files.select(
        "path", zero.alias("device"), zero.alias("inode"), F.lit(0o100644).cast("long").alias("mode"), F.col("length").alias("size"),
        F.floor(seconds / 1_000_000).alias("mtime_s"), (F.pmod(seconds, F.lit(1_000_000)) * 1000).cast("int").alias("mtime_ns"), checksum.alias("checksum"),
    )


# Manifests of build, rule, pool, default and include lines with indented bindings

_PATH = r"(?:\$[\s\S]|[^\s$:|])++"
_BINDING = r"^([A-Za-z0-9_.-]+)\s*=\s*([\s\S]*)$"


def manifest_lines(files: DataFrame) -> DataFrame:
    """(file, line, statement, word, text): each statement of files (file, content) and its
    indented bindings, which have the same statement number. Continued lines are joined."""
    joined = F.regexp_replace("content", r"(?<!\$)((?:\$\$)*)\$\r?\n[ \t]*", "$1")
    lines = files.select("file", F.posexplode(F.split(joined, r"\r?\n")).alias("line", "text")).where(~F.col("text").rlike(r"^\s*(#.*)?$"))
    top = ~F.col("text").rlike(r"^[ \t]")
    place = Window.partitionBy("file").orderBy("line")
    word = F.when(~top, "binding").when(F.col("text").rlike(r"^(build|rule|pool|default|include|subninja)(\s|$)"), F.regexp_extract("text", r"^\w+", 0)).when(F.col("text").rlike(r"^[A-Za-z0-9_.-]+\s*="), "variable").otherwise("error")
    return lines.select("file", "line", F.sum(top.cast("int")).over(place).alias("statement"), word.alias("word"), F.trim("text").alias("text"))


def joined_files(lines: DataFrame, root: str, most_rounds: int = 64) -> DataFrame:
    """manifest_lines() of all files as one for the root and one for each `subninja`: an
    included file's lines stand where it is included, and a child scope begins with the
    variables and rules that its parent had set before. `file` names the scope: the files
    and lines that lead to it. Names are those of `file`; a file that includes itself, or
    is missing, is an error."""
    top = lines.where("word <> 'binding'").select("file", "statement", F.col("word").alias("owner"))
    all_ = written(lines.join(top, ["file", "statement"], "left").select(F.col("file").alias("source"), "line", "word", "owner", F.col("text").alias("said")))
    placed = all_.where(F.col("source") == root).select(F.lit(root).alias("unit"), F.array("line").alias("order"), "word", "owner", "said")
    for _ in range(most_rounds):
        placed = written(placed)
        asked = placed.where("word IN ('include', 'subninja')").withColumn("source", F.regexp_replace("said", r"^\w+\s+", ""))
        if asked.isEmpty():
            own = Window.partitionBy("unit").orderBy("order")
            rows = placed.withColumn("line", F.row_number().over(own))
            statement = F.sum((F.col("word") != "binding").cast("int")).over(own)
            return rows.select(F.col("unit").alias("file"), "line", statement.alias("statement"), "word", F.col("said").alias("text"))
        if missing := [r["source"] for r in asked.select("source").join(all_, "source", "left_anti").distinct().limit(20).collect()]:
            raise ValueError(f"no such file: {', '.join(missing)}")
        # includes first: what a child inherits is complete then
        now = asked.where("word = 'include'")
        if now.isEmpty():
            now = asked.withColumn("child", F.concat_ws(" ", "unit", "source", F.array_join(F.transform("order", lambda i: i.cast("string")), ".")))
            before = placed.where("owner IN ('variable', 'rule')").alias("p").join(now.select("unit", F.col("order").alias("at"), "child"), "unit").where("order < at")
            inherited = before.select(F.col("child").alias("unit"), "order", "word", "owner", "said")
        else:
            now, inherited = now.withColumn("child", F.col("unit")), placed.where("false")
        added = all_.join(now.select("source", "child", F.col("order").alias("at")), "source").select(F.col("child").alias("unit"), F.concat("at", F.array("line")).alias("order"), "word", "owner", "said")
        done = now.select("unit", "order")
        placed = placed.join(done, ["unit", "order"], "left_anti").unionByName(inherited).unionByName(added)
    raise ValueError(f"files include each other more than {most_rounds} times")


def bindings(lines: DataFrame) -> DataFrame:
    """(file, statement, line, word, name, value) of variables and indented bindings."""
    rows = lines.where(F.col("word").isin("variable", "binding") & F.col("text").rlike(_BINDING))
    return rows.select("file", "statement", "line", "word", F.regexp_extract("text", _BINDING, 1).alias("name"), F.regexp_extract("text", _BINDING, 2).alias("value"))


def scopes(lines: DataFrame) -> DataFrame:
    """(file, scope, steps): a file's variables at its end, and after each of its lines
    that sets one (ARRAY<STRUCT<line, name, value>>), expanded with those before it."""
    rows = bindings(lines).where("word = 'variable'")
    lists = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "name", "value"))).alias("vars"))
    empty, steps = F.create_map().cast("map<string,string>"), "array<struct<line:int,name:string,value:string>>"

    def add(acc, v):
        value = expand(v["value"], acc["scope"])
        rest = F.map_filter(acc["scope"], lambda k, _: k != v["name"])
        step = F.struct(v["line"].alias("line"), v["name"].alias("name"), value.alias("value"))
        return F.struct(F.map_concat(rest, F.create_map(v["name"], value)).alias("scope"), F.concat(acc["steps"], F.array(step)).cast(steps).alias("steps"))

    first = F.struct(empty.alias("scope"), F.array().cast(steps).alias("steps"))
    return lists.select("file", F.aggregate("vars", first, add).alias("all")).select("file", "all.scope", "all.steps")


def scope_at(steps: Column, line: Column) -> Column:
    """The variables that are set before a line: of each name the last value."""
    before = F.reverse(F.filter(steps, lambda s: s["line"] < line))
    names = F.transform(before, lambda s: s["name"])
    last = F.filter(before, lambda s, i: F.array_position(names, s["name"]) == i + 1)
    return F.map_from_arrays(F.transform(last, lambda s: s["name"]), F.transform(last, lambda s: s["value"]))


def build_statements(lines: DataFrame) -> DataFrame:
    """(file, statement, rule, outputs, inputs, implicit, order_only, attrs, scope): paths
    and bindings are expanded with what the file has set before the statement. Lines come
    dealt by file, and all that is grouped and joined here stays in a file's place."""
    one = F.col("word") == "build"
    entry = F.when((F.col("word") == "binding") & F.col("text").rlike(_BINDING), F.struct(F.regexp_extract("text", _BINDING, 1).alias("name"), F.regexp_extract("text", _BINDING, 2).alias("value")))
    both = lines.where("word IN ('build', 'binding')").groupBy("file", "statement").agg(F.max(F.when(one, F.struct("line", "text"))).alias("head"), F.array_sort(F.collect_list(entry)).alias("entries"))
    head = both.where("head IS NOT NULL").select("file", "statement", "head.line", "head.text", "entries")
    parts = r"^build\s+((?:\$[\s\S]|[^:$])++):\s*([A-Za-z0-9_.-]+)([\s\S]*)$"
    rows = head.select("file", "statement", "line", F.regexp_extract("text", parts, 1).alias("outs"), F.regexp_extract("text", parts, 2).alias("rule"), F.regexp_extract("text", parts, 3).alias("ins"), "entries")
    rows = rows.join(scopes(lines).select("file", "steps").hint("merge"), "file", "left")
    rows = rows.withColumn("scope", F.coalesce(scope_at(F.col("steps"), F.col("line")), F.create_map().cast("map<string,string>")))
    paths = lambda c: F.transform(F.regexp_extract_all(c, F.lit(_PATH), F.lit(0)), lambda p: expand(p, F.col("scope")))
    section = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    plain, piped, ordered = r"^((?:\$[\s\S]|[^|$])*+)", r"^(?:\$[\s\S]|[^|$])*+\|((?:\$[\s\S]|[^|$])++)", r"\|\|([\s\S]*)$"
    attrs = F.transform_values(F.map_from_entries("entries"), lambda _, v: expand(v, F.col("scope")))
    return rows.select(
        "file", "statement", "rule",
        F.concat(paths(section("outs", plain)), paths(section("outs", piped))).alias("outputs"),
        paths(section("ins", plain)).alias("inputs"), paths(section("ins", piped)).alias("implicit"), paths(section("ins", ordered)).alias("order_only"),
        attrs.alias("attrs"), "scope",
    )


def rules(lines: DataFrame) -> DataFrame:
    """(file, rule, attrs) of rule statements; their values are expanded at each use."""
    heads = lines.where("word = 'rule'").select("file", "statement", F.regexp_extract("text", r"^rule\s+(\S+)", 1).alias("rule"))
    own = bindings(lines).where("word = 'binding'").groupBy("file", "statement").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attrs"))
    return heads.join(own, ["file", "statement"], "left").select("file", "rule", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))


def command_lines(lines: DataFrame) -> DataFrame:
    """(file, statement, rule, outputs, command): each build's command; a name is looked up
    among in, out, the build's bindings, the rule's (expanded in turn) and the file's."""
    builds = build_statements(lines).join(rules(lines).withColumnRenamed("attrs", "of_rule"), ["file", "rule"], "left")
    plain = lambda n: F.when(n == "in", F.array_join("inputs", " ")).when(n == "in_newline", F.array_join("inputs", "\n")).when(n == "out", F.array_join("outputs", " ")).otherwise(F.coalesce(F.element_at("attrs", n), F.element_at("scope", n)))
    full = lambda n: F.coalesce(plain(n), expand(F.element_at("of_rule", n), plain))
    return builds.select("file", "statement", "rule", "outputs", expand(F.element_at("of_rule", "command"), full).alias("command"))


def manifest_edges(builds: DataFrame) -> DataFrame:
    """(key, ordinal, dep, order_only): what each output depends on, in order."""
    marked = lambda c, only: F.transform(c, lambda p: F.named_struct(F.lit("dep"), p, F.lit("order_only"), F.lit(only)))
    deps = F.concat(marked("inputs", False), marked("implicit", False), marked("order_only", True))
    # outer, and rows without elements dropped behind it: explode() asks for the array's size
    # first, and that question is moved into the lambdas that make the array
    keyed = builds.select(F.explode_outer("outputs").alias("key"), deps.alias("deps")).where("key IS NOT NULL")
    return keyed.select("key", F.posexplode_outer("deps").alias("ordinal", "d")).where("ordinal IS NOT NULL").select("key", "ordinal", "d.dep", "d.order_only")


def manifest_errors(lines: DataFrame) -> DataFrame:
    """(file, line, message): what is no statement, and builds of unknown rules."""
    odd = lines.where("word = 'error'").select("file", "line", F.lit("no statement").alias("message"))
    named = build_statements(lines).select("file", "statement", "rule").where("rule <> 'phony'")
    unknown = named.join(rules(lines).select("file", "rule"), ["file", "rule"], "left_anti").join(lines.where("word = 'build'").select("file", "statement", "line"), ["file", "statement"]).select("file", "line", F.concat(F.lit("unknown rule "), "rule").alias("message"))
    return odd.unionByName(unknown)
