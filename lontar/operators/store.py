"""Translation keys as tables: imports, edits and their history, translation memory, access."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry as R

KEYS = "project_id string, name string, description string, values map<string,map<string,string>>, draft array<string>, regulated boolean"


class Store(Protocol):
    """Where tables of keys, revisions, projects and users are kept."""

    def table(self, name: str) -> DataFrame: ...

    def put(self, name: str, rows: DataFrame) -> None: ...

    def exists(self, name: str) -> bool: ...


class SessionStore:
    """Tables of one session, gone with it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def table(self, name: str) -> DataFrame:
        return self.held[name]

    def put(self, name: str, rows: DataFrame) -> None:
        self.held[name] = rows

    def exists(self, name: str) -> bool:
        return name in self.held


def _files(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and its path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class FolderStore:
    """Tables as Parquet in versions under a folder that all machines share; the latest that is whole counts.

    A version's number is claimed by making a file, which one writer alone can do, and is whole once its _SUCCESS is there;
    so writers don't clash and readers see no half of a version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str, mark: str) -> list[int]:
        system, path = _files(self.spark, f"{self.folder}/{name}")
        if not system.exists(path):
            return []
        found = [f.getPath().getName() for f in system.listStatus(path)]
        numbers = [int(n.removeprefix(mark)) for n in found if n.startswith(mark)]
        if mark != "store_version=":
            return numbers
        whole = lambda n: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{mark}{n}/_SUCCESS"))
        return [n for n in numbers if whole(n)]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/store_version={max(self._versions(name, 'store_version='))}")

    def put(self, name: str, rows: DataFrame) -> None:
        system, _ = _files(self.spark, f"{self.folder}/{name}")
        number = max(self._versions(name, "_claimed-"), default=-1) + 1
        while not system.createNewFile(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_claimed-{number}")):
            number += 1
        rows.write.mode("errorifexists").parquet(f"{self.folder}/{name}/store_version={number}")

    def exists(self, name: str) -> bool:
        return bool(self._versions(name, "store_version="))


class Buckets:
    """A table in buckets of its key, folders of a shared one; a change rewrites the buckets it touches and no others.

    Take so many buckets that one is a task's work. Keys that are deleted stay, marked, so that no bucket falls empty.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = ("project_id", "name"), buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), list(key), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def create(self, rows: DataFrame) -> None:
        """Store rows, each key once, in a new folder."""
        self._write(rows.withColumn("deleted", F.lit(False)).withColumn("bucket", self._bucket()))

    def _held(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def table(self) -> DataFrame:
        return self._held().where("NOT deleted").drop("deleted", "bucket")

    def touched(self, changes: DataFrame) -> tuple[list[int], DataFrame]:
        """The buckets of the keys of changes, and the stored rows with these keys; no other bucket is read."""
        own = [r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # numbers of buckets
        rows = self._held().where(F.col("bucket").isin(own)).where("NOT deleted").drop("deleted", "bucket")
        return own, rows.join(changes.select(*self.key).distinct(), self.key, "left_semi").select(*rows.columns)

    def upsert(self, changes: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Put rows of changes, each key once, in place of those with their keys; delete the keys of gone. Gives the buckets that were rewritten."""
        columns = self._held().drop("bucket").columns
        fresh = changes.withColumn("deleted", F.lit(False)).select(*columns)
        if gone is not None:
            held = self.touched(gone)[1]
            fresh = fresh.unionByName(held.withColumn("deleted", F.lit(True)).select(*columns))
        own = [r[0] for r in fresh.select(self._bucket().alias("b")).distinct().collect()]  # numbers of buckets
        old = self._held().where(F.col("bucket").isin(own)).select(*columns)
        kept = old.join(fresh.select(*self.key), self.key, "left_anti").select(*columns)
        self._write(kept.unionByName(fresh).withColumn("bucket", self._bucket()))
        return sorted(own)


def import_into(buckets: Buckets, entries: DataFrame, project: str, locale: str, register: str = "neutral", source: str = "human") -> list[int]:
    """import_entries() that reads and writes the buckets of the entries' names only. Gives the buckets that were rewritten.

    buckets: of keys by project and name.
    """
    named = entries.select(F.lit(project).alias("project_id"), "name")
    _, before = buckets.touched(named)
    done = import_entries(before, entries, project, locale, register, source)
    return buckets.upsert(done.where(F.col("action").isin("created", "updated")).drop("action"))


def open_store(spark: SparkSession, folder: str | None = None) -> Store:
    """A store in the folder, if one is named, else in the session."""
    return FolderStore(spark, folder) if folder else SessionStore(spark)


def count_keys(keys: DataFrame, project: str) -> int:
    return keys.where(F.col("project_id") == project).count()


def list_keys(keys: DataFrame, project: str) -> DataFrame:
    """Keys of a project by name, as people sort."""
    return keys.where(F.col("project_id") == project).orderBy(F.collate("name", "UNICODE"))


def _put(table: Column, name: Column, value: Column) -> Column:
    """A map with one entry set."""
    return F.map_concat(F.map_filter(table, lambda k, _: k != name), F.create_map(name, value))


def import_entries(keys: DataFrame, entries: DataFrame, project: str, locale: str, register: str = "neutral", source: str = "human", limit: int = 0) -> DataFrame:
    """The keys after entries (name, value) were imported into a locale and register, with what was done to each.

    action: created, updated, skipped (regulated keys) or kept. Entries of source ai leave a draft,
    others end one. Of repeated names the last by position, if entries have one, wins. A limit counts
    entries of known names too, and fails beyond.
    """
    if source not in ("human", "ai", "import"):
        raise ValueError(f"unknown source {source!r}")
    own, others = keys.where(F.col("project_id") == project), keys.where(F.col("project_id") != project)
    last = F.max_by("value", "pos") if "pos" in entries.columns else F.last("value")
    new = entries.groupBy("name").agg(last.alias("__new"))
    if limit and own.count() + new.count() > limit:
        raise ValueError(f"import would exceed the key limit ({limit})")
    both = own.withColumn("__old", F.lit(True)).join(new, "name", "full")
    frozen = F.coalesce("regulated", F.lit(False))
    fresh, touched = F.col("__old").isNull(), F.col("__new").isNotNull() & ~frozen
    empty = F.create_map().cast("map<string,map<string,string>>")
    table = F.coalesce("values", empty)
    inner = F.coalesce(table[locale], F.create_map().cast("map<string,string>"))
    drafts = F.coalesce("draft", F.array().cast("array<string>"))
    after = F.array_union(drafts, F.array(F.lit(locale))) if source == "ai" else F.array_remove(drafts, locale)
    out = both.select(
        F.lit(project).alias("project_id"), "name", "description",
        F.when(touched, _put(table, F.lit(locale), _put(inner, F.lit(register), F.col("__new")))).otherwise(table).alias("values"),
        F.when(touched, after).otherwise(drafts).alias("draft"), frozen.alias("regulated"),
        F.when(fresh, "created").when(touched, "updated").when(F.col("__new").isNotNull(), "skipped").otherwise("kept").alias("action"),
    )
    return out.unionByName(others.withColumn("action", F.lit("kept")).select(*out.columns))


def import_summary(imported: DataFrame) -> DataFrame:
    return imported.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "skipped")))


def create_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """keys with those of new (of the same columns) whose project and name aren't taken."""
    return keys.unionByName(new.join(keys.select("project_id", "name"), ["project_id", "name"], "left_anti").select(*keys.columns))


def delete_keys(keys: DataFrame, gone: DataFrame) -> DataFrame:
    """keys without those (project_id, name)."""
    return keys.join(gone.select("project_id", "name").distinct(), ["project_id", "name"], "left_anti").select(*keys.columns)


def apply_edits(values: DataFrame, edits: DataFrame, regulated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, revisions) after edits; both tables have (key, locale, register, value) and edits also at, user, source.

    A revision holds the value before and after. Edits of regulated keys (key) by ai are refused.
    """
    slot = ["key", "locale", "register"]
    if regulated is not None:
        by_ai = edits.where(F.col("source") == "ai").join(regulated.select("key"), "key", "left_anti")
        edits = edits.where(F.col("source") != "ai").unionByName(by_ai.select(*edits.columns))
    earlier = F.lag("value").over(Window.partitionBy(*slot).orderBy("at"))
    old = values.select(*slot, F.col("value").alias("stored"))
    revisions = edits.withColumn("earlier", earlier).join(old, slot, "left").select(*slot, F.coalesce("earlier", "stored").alias("before"), F.col("value").alias("after"), "user", "source", "at")
    newest = edits.groupBy(*slot).agg(F.max_by("value", "at").alias("new"))
    now = old.join(newest, slot, "full").select(*slot, F.coalesce("new", "stored").alias("value"))
    return now, revisions


def newest_revisions(revisions: DataFrame, key: str | None = None, most: int = 500) -> DataFrame:
    rows = revisions if key is None else revisions.where(F.col("key") == key)
    return rows.orderBy(F.desc("at")).limit(most)


def translation_memory(values: DataFrame, source: str, target: str, register: str = "neutral", drafts: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(key, source, target) of keys approved in both locales, by key."""
    side = lambda code, name: values.where((F.col("locale") == code) & (F.col("register") == register) & (F.trim("value") != "")).select("key", F.col("value").alias(name))
    out = side(source, "source").join(side(target, "target"), "key")
    if drafts is not None:
        out = out.join(drafts.where(F.col("locale") == target).select("key"), "key", "left_anti")
    return out.orderBy("key").limit(most)


RANKS = {"viewer": 0, "translator": 1, "owner": 2}


def can_edit(members: DataFrame) -> DataFrame:
    """members (role, locales, locale) with whether each may edit the locale: owners all, viewers none, translators theirs, or all if they have no list."""
    listed = (F.size("locales") == 0) | F.array_contains("locales", F.col("locale"))
    return members.withColumn("can_edit", F.when(F.col("role") == "owner", True).when(F.col("role") == "viewer", False).otherwise(F.coalesce(listed, F.lit(True))))


def has_role(role: Column, least: str) -> Column:
    return R.literal_map(RANKS)[role] >= RANKS[least]


def projects_of(projects: DataFrame, user: str) -> DataFrame:
    """Projects that the user is a member of."""
    return projects.where(F.exists("members", lambda m: m["user_id"] == user))


def projects_with(projects: DataFrame, members: DataFrame) -> DataFrame:
    """Projects that have a row in a table of memberships (project_id)."""
    return projects.join(members.select("project_id").distinct(), "project_id", "left_semi")


def safe_users(users: DataFrame) -> DataFrame:
    return users.select("id", "email", "name")


def draft_prompt(text: Column, source: str, target: str, register: str, gender: str = "neutral", glossary: dict[str, str] | None = None, memory: list[tuple[str, str]] | None = None) -> Column:
    """A translation job as a numbered brief, with what the registry knows of the target."""
    a, b = R.resolve(source), R.resolve(target)
    own = R.particles().get(b.base_locale or b.code)
    brief = {"from": a.name, "to": f"{b.name} / {b.native_name}", "tone": f"{register} (one of {', '.join(b.registers)})"}
    if b.count_order != "num-noun":
        shown = "N + number + CL" if b.count_order == "noun-num-clf" else "number + CL + N"
        people, things = (R.classifier(target, c) or "-" for c in ("person", "thing"))
        brief["counting"] = f"{shown}; CL for people {people}, for things {things}"
    if own and own["male"][0] != own["female"][0]:
        brief["particle"] = "none, it is added when shown" if gender == "neutral" else f"{own[gender][0]} ({gender} speaker), sparingly"
    if not b.word_spaced:
        brief["spacing"] = "no spaces or invisible breaks between words"
    encodings = {"my": "Unicode, not Zawgyi", "vi": "composed letters (NFC)"}
    if b.code in encodings:
        brief["encoding"] = encodings[b.code]
    brief["placeholders"] = "copy {names} in braces letter by letter"
    brief["answer"] = "the translation alone"
    lines = [f"- {k}: {v}" for k, v in brief.items()]
    for title, pairs in (("terms", list((glossary or {}).items())), ("earlier", (memory or [])[:20])):
        lines += [f"- {title}: {x} => {y}" for x, y in pairs]
    return F.concat(F.lit("\n".join(["Translation job", *lines, "- text: "])), text)
