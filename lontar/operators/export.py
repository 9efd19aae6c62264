"""Translation files for applications, fonts for pages, and reports to read.

Files are made in parts, a row for each key, of all projects and locales at once: which row opens and closes which
braces follows from the first and last key below each node, which are aggregated, so no group holds a project's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R

FORMATS = ("json", "csv", "android", "ios")


def value_for(locale: str, register: str) -> Column:
    """A stored key's text: the register's, else neutral, formal, casual, even if empty; else empty."""
    return F.coalesce(*[F.col("values")[locale][r] for r in (register, "neutral", "formal", "casual")], F.lit(""))


def _cell(text: Column) -> Column:
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _csv(keys: DataFrame, locales: list[str], register: str) -> DataFrame:
    header = ",".join(["key", "description", *locales])
    line = F.concat_ws(",", _cell(F.col("name")), _cell(F.coalesce("description", F.lit(""))), *(_cell(value_for(c, register)) for c in locales))
    # The header is a key that comes before all others, so that it stands in files without keys, too.
    rows = keys.select("project_id", F.lit(None).cast("string").alias("locale"), "name", line.alias("body"))
    first = keys.select("project_id").distinct().select("project_id", F.lit(None).cast("string").alias("locale"), F.lit("").alias("name"), F.lit(header).alias("body"))
    return first.unionByName(rows)


def _texts(keys: DataFrame, locales: list[str], register: str) -> DataFrame:
    """(project_id, name, description, locale, value) of keys that have a text in a locale."""
    held = F.explode(F.array(*(F.struct(F.lit(c).alias("locale"), value_for(c, register).alias("value")) for c in locales)))
    return keys.select("project_id", "name", "description", held.alias("t")).select("project_id", "name", "description", "t.*").where("value != ''")


def _android(texts: DataFrame) -> DataFrame:
    escaped = F.col("value")
    for mark, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "\\'"), ('"', '\\"')):
        escaped = F.replace(escaped, F.lit(mark), F.lit(written))
    escaped = F.regexp_replace(escaped, r"%(?![\dsd$])", "%%")
    line = F.concat(F.lit('    <string name="'), F.regexp_replace("name", "[^A-Za-z0-9_]", "_"), F.lit('">'), escaped, F.lit("</string>"))
    return texts.select("project_id", "locale", "name", line.alias("body"))


def _ios(texts: DataFrame) -> DataFrame:
    def escaped(text: Column) -> Column:
        for mark, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            text = F.replace(text, F.lit(mark), F.lit(written))
        return text

    note = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("/* "), F.replace("description", F.lit("*/"), F.lit("")), F.lit(" */\n"))).otherwise("")
    line = F.concat(note, F.lit('"'), escaped(F.col("name")), F.lit('" = "'), escaped(F.col("value")), F.lit('";'))
    return texts.select("project_id", "locale", "name", line.alias("body"))


_FILE = ["project_id", "locale"]


def placed(texts: DataFrame, rounds: int = 50) -> DataFrame:
    """texts (project_id, locale, name, value) with the path at which each stands in its file's tree; what is overwritten is left out.

    Keys are set in order of their names, part by part. Where a text stands in a branch's way, the key's last part goes
    beside it; a text set where a branch or another text stands takes its place. Such conflicts may give others, so
    places are found again until none changes; without any, once. Keys are shuffled and never broadcast, however small
    their file: compressed, a table of millions of keys looks small.
    """
    rows = texts.select(*_FILE, "name", "value", F.split("name", r"\.").alias("parts")).withColumn("path", F.col("parts"))
    inner = F.sequence(F.lit(1), F.size("parts") - 1)
    for _ in range(rounds):
        ways = rows.where(F.size("parts") > 1).select(*_FILE, "name", F.explode(inner).alias("depth"), "parts").withColumn("branch", F.slice("parts", F.lit(1), F.col("depth")))
        # Texts that stand where the branch of a later key does; mostly there is none, and no key has to be held against them.
        both = rows.select(*_FILE, F.col("path").alias("branch"), F.col("name").alias("first"), F.lit(None).cast("string").alias("last")).unionByName(ways.select(*_FILE, "branch", F.lit(None).cast("string").alias("first"), F.col("name").alias("last")))
        leaves = both.groupBy(*_FILE, "branch").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").drop("last")
        hit = ways.join(leaves.hint("merge"), [*_FILE, "branch"]).where(F.col("first") < F.col("name")).groupBy(*_FILE, "name").agg(F.min("depth").alias("stop"))
        if leaves.isEmpty() and rows.where("path != parts").isEmpty():
            return rows.drop("parts")
        beside = F.concat(F.slice("parts", F.lit(1), F.col("stop") - 1), F.slice("parts", F.lit(-1), F.lit(1)))
        after = rows.drop("path").join(hit.hint("merge"), [*_FILE, "name"], "left").withColumn("path", F.when(F.col("stop").isNull(), F.col("parts")).otherwise(beside)).drop("stop")
        same = rows.select(*_FILE, "name", F.col("path").alias("was")).join(after.hint("merge"), [*_FILE, "name"]).where("was != path").isEmpty()
        rows = after.select(*rows.columns)
        if same:
            break
    else:
        raise ValueError(f"places of keys still change after {rounds} rounds")
    last = rows.groupBy(*_FILE, "path").agg(F.max("name").alias("name"), F.max_by("value", "name").alias("value"))
    over = last.select(*_FILE, F.col("path").alias("branch"), F.col("name").alias("by"))
    ways = last.select(*_FILE, "name", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth")).where(F.col("depth") < F.size("path"))
    gone = ways.withColumn("branch", F.slice("path", F.lit(1), F.col("depth"))).join(over.hint("merge"), [*_FILE, "branch"]).where("by > name").select(*_FILE, "path").distinct()
    return last.join(gone.hint("merge"), [*_FILE, "path"], "left_anti").select(*_FILE, "name", "value", "path")


def edges(rows: DataFrame) -> DataFrame:
    """rows (project_id, locale, path, ...) with n_open and n_close: how many nodes above a row's leaf begin and end with it.

    Rows of a file stand by their paths. A node begins with the first path below it; the file's own node is one, too.
    """
    nodes = rows.select(*_FILE, "path", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("depth")).withColumn("node", F.slice("path", F.lit(1), F.col("depth")))
    ends = nodes.groupBy(*_FILE, "node").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    both = ends.select(*_FILE, F.col("first").alias("path"), F.lit(1).alias("open"), F.lit(0).alias("close")).unionByName(ends.select(*_FILE, F.col("last").alias("path"), F.lit(0).alias("open"), F.lit(1).alias("close")))
    own = [F.col(c).alias(f"at_{c}") for c in (*_FILE, "path")]
    counted = both.groupBy(*_FILE, "path").agg(F.sum("open").cast("int").alias("n_open"), F.sum("close").cast("int").alias("n_close")).select(*own, "n_open", "n_close")
    same = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in (*_FILE, "path")]
    return rows.join(counted, same, "left").select(*rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_open", "n_close")))


def _quoted(text: Column) -> Column:
    written = F.to_json(F.array(text))
    return F.substr(written, F.lit(2), F.length(written) - 2)


def _nested(texts: DataFrame) -> DataFrame:
    """Parts of nested JSON: what a key opens, its line, and what it closes."""
    rows = edges(placed(texts))
    depth = F.size("path") - 1
    indent = lambda n: F.repeat(F.lit("  "), n)
    numbers = lambda a, b: F.filter(F.sequence(F.least(a, b), F.greatest(a, b)), lambda j: (j >= a) & (j <= b))
    opened = F.transform(numbers(F.greatest(F.lit(1), depth - F.col("n_open") + 1), depth), lambda j: F.concat(indent(j), _quoted(F.get(F.col("path"), j - 1)), F.lit(": {\n")))
    closed = F.transform(F.reverse(numbers(depth - F.col("n_close") + 1, depth)), lambda j: F.concat(F.lit("\n"), indent(j), F.lit("}")))
    head = F.when(F.col("n_open") > depth, "{\n").otherwise(",\n")
    line = F.concat(indent(depth + 1), _quoted(F.element_at("path", -1)), F.lit(": "), _quoted(F.col("value")))
    return rows.select(*_FILE, F.array_join("path", "\0").alias("pos"), F.concat(head, F.array_join(opened, ""), line, F.array_join(closed, "")).alias("text"))


#: How files begin and end, by format, and what stands between their lines.
AROUND = {"csv": ("", "\n", ""), "android": ('<?xml version="1.0" encoding="utf-8"?>\n<resources>\n', "\n", "\n</resources>\n"), "ios": ("", "\n", "\n")}
#: Files without a key.
EMPTY = {"json": "{}", "android": '<?xml version="1.0" encoding="utf-8"?>\n<resources>\n</resources>\n', "ios": "\n"}


def export_parts(file_format: str, keys: DataFrame, locales: list[str], register: str = "neutral") -> DataFrame:
    """(project_id, locale, file, pos, text) for files of all projects of keys: a file is its rows' texts by pos (in nested JSON, the parts of the path with U+0000 between).

    csv holds all locales (locale is null); the others have a file for each locale in which a project has a text.
    """
    if file_format == "json":
        rows = _nested(_texts(keys, locales, register))
    else:
        made = _csv(keys, locales, register) if file_format == "csv" else {"android": _android, "ios": _ios}[file_format](_texts(keys, locales, register))
        before, between, after = AROUND[file_format]
        flat = edges(made.withColumn("path", F.array("name")))
        rows = flat.select(*_FILE, F.col("name").alias("pos"), F.concat(F.when(F.col("n_open") > 0, before).otherwise(between), "body", F.when(F.col("n_close") > 0, after).otherwise("")).alias("text"))
    return rows.select(*_FILE, F.concat("project_id", F.lit("/"), _filename(file_format, F.col("locale"), register)).alias("file"), "pos", "text")


def _filename(file_format: str, locale: Column, register: str) -> Column:
    if file_format == "csv":
        return F.lit(f"translations-{register}.csv")
    before, after = {"android": ("strings-", ".xml"), "ios": ("Localizable-", ".strings")}.get(file_format, ("", ".json"))
    return F.concat(F.lit(before), locale, F.lit(after))


def write_exports(parts: DataFrame, folder: str) -> None:
    """Write the files of export_parts() under a folder that all machines share, a project's in a folder of its own."""
    from ..sources.bundle_files import register

    register(parts.sparkSession)
    rows = parts.select("file", "pos", "text")
    rows.repartitionByRange("file", "pos").sortWithinPartitions("file", "pos").write.format("lontar_files").mode("append").save(folder)


def export_keys(file_format: str, keys: DataFrame, locales: list[str], register: str = "neutral") -> DataFrame:
    """(body, content_type, filename) of one project's file, in one cell: for projects that are small; else see write_exports().

    csv holds all locales, the others the first.
    """
    file_format = file_format if file_format in FORMATS else "json"
    own = locales if file_format == "csv" else locales[:1]
    parts = export_parts(file_format, keys, own, register)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "")
    empty = ",".join(["key", "description", *locales]) if file_format == "csv" else EMPTY[file_format]
    kind = {"csv": "text/csv; charset=utf-8", "android": "application/xml; charset=utf-8", "ios": "text/plain; charset=utf-8", "json": "application/json; charset=utf-8"}[file_format]
    shown = parts.agg(body.alias("body"))
    return shown.select(F.when(F.col("body") == "", empty).otherwise(F.col("body")).alias("body"), F.lit(kind).alias("content_type"), _filename(file_format, F.lit(locales[0]), register).alias("filename"))


def font_link(locales: list[str], display: str = "swap") -> str:
    """One address for the web fonts of the locales, each with all the weights that they need."""
    families: dict[str, set[int]] = {}
    for found in filter(None, map(R.resolve, locales)):
        families.setdefault(found.font_web, set()).update(found.font_weights)
    query = "&".join(f"family={name.replace(' ', '+')}:wght@{';'.join(map(str, sorted(w)))}" for name, w in families.items())
    return f"https://fonts.googleapis.com/css2?{query}&display={display}"


def font_css(locales: list[str]) -> str:
    blocks = []
    for found in filter(None, map(R.resolve, locales)):
        lines = [f':lang({found.code}), [lang="{found.code}"] {{', f"  font-family: {found.font_family};", f"  line-height: {found.line_height:g};"]
        lines += ["  direction: rtl;"] * (found.direction == "rtl") + ["  word-break: auto-phrase;\n  line-break: normal;"] * (not found.word_spaced)
        blocks.append("\n".join([*lines, "}"]))
    return "\n\n".join(blocks)


def bar(score: Column, cells: int = 20) -> Column:
    """A bar of # for the score out of 100."""
    full = F.floor(score * cells / 100 + 0.5).cast("int")
    return F.rpad(F.repeat(F.lit("#"), full), cells, ".")


def readiness_report(locales: DataFrame, threshold: int = 75) -> DataFrame:
    """A line for each scored locale, and whether it blocks a release."""
    line = F.concat(F.rpad("locale", 12, " "), bar(F.col("score")), F.lit(" "), F.lpad(F.col("score").cast("string"), 3, " "), F.lit(" "), "grade")
    return locales.select("locale", line.alias("line"), (F.col("score") < threshold).alias("blocking"))
