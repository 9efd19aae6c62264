"""A Merkle manifest of a dataset: a tree of hashes for each source, and one over the sources.

Rows are dealt out by ranges of (source, doc_id, leaf), so that a row's place in its source is its place
in its range and what earlier ranges hold: no task gets a whole source. Trees are built from below: each
level is a table of runs, of FANOUT children each, with the digest of the run, and is written to the
manifest's folder. Proofs are pushed from above: a level's runs meet their own proofs, by number, and each
child of a run puts its step, the siblings before and after it, in front of the proof of its run. Leaves
are the last level, so that their long proofs are made where they are used and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import spread
from .cluster import cut, prepare, shared_folder

FANOUT = 16
#: Pieces of sources in ranges are broadcast up to so many bytes; more are joined by a shuffle.
SMALL = 16 << 20
#: The fields of a leaf, in order; what tampering lower-cases; which rows it touches.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPERED = 5


def digest(*parts: F.Column) -> F.Column:
    """Lowercase hex sha256 of strings, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: F.Column) -> F.Column:
    """The digest of a row: each value is `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _all(children: F.Column) -> F.Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def ranges(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, materialised in order of (group, order), with their place `at` in it; and (part, *group, first, start, n) for each piece of a group.

    at is the row's place in its range and, above bit 33, the range; first the piece's smallest place and
    start the rows of the group in earlier ranges.
    """
    dealt = cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("at", F.monotonically_increasing_id()))
    pieces = dealt.groupBy(F.shiftright("at", 33).alias("part"), *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range at most
    return dealt, pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


@dataclass(frozen=True)
class Tree:
    """Levels of trees, one for each group, as tables under a folder: (group, n, run, children, digest).

    n: how many nodes the group has on the level; children: (idx, digest, ...) of a run in order. A group of one
    node is done: its node is the root, and there is no step above it.
    """

    spark: SparkSession
    path: str
    levels: int
    fanout: int

    def level(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={k}")

    @staticmethod
    def build(nodes: DataFrame, path: str, fanout: int = FANOUT) -> Tree:
        """Trees over nodes (group, n, idx, digest, ...); other columns stay with the children of the lowest level."""
        tree, k = Tree(nodes.sparkSession, path, 0, fanout), 0
        most = 0
        while True:
            more = [c for c in nodes.columns if c not in ("group", "n", "idx", "digest")]
            runs = nodes.groupBy("group", "n", F.expr(f"idx div {fanout}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *more))).alias("children"))
            alone = F.element_at("children", 1)["digest"]
            runs.withColumn("digest", F.when(F.col("n") == 1, alone).otherwise(digest(_all(F.col("children"))))).write.parquet(f"{path}/level={k}")
            below, k = tree.level(k), k + 1
            most = (below.agg(F.max("n")).first()[0] or 0) if k == 1 else most
            most = -(-most // fanout)
            if most <= 1:
                return Tree(tree.spark, path, k, fanout)
            up = F.expr(f"(n + {fanout - 1}) div {fanout}")
            nodes = below.where(f"n > {fanout}").select("group", up.alias("n"), F.col("run").alias("idx"), "digest")

    def roots(self) -> DataFrame:
        """(group, level, digest): the root of each tree, and the level above which it is."""
        done = [self.level(k).where(f"n <= {self.fanout}").select("group", F.lit(k).alias("level"), "digest") for k in range(self.levels)]
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    def proofs(self, tops: DataFrame) -> DataFrame:
        """A row for each node of the lowest level: its columns and those of tops (group, level, proof, ...), with its own proof.

        A proof is the steps from a node to the root, (before, after): what stands around its digest in its run.
        """
        carried = [c for c in tops.columns if c not in ("group", "level", "proof")]
        held = None
        for k in reversed(range(self.levels)):
            own = tops.where(F.col("level") == k).select("group", F.lit(0).cast("long").alias("run"), "proof", *carried)
            held = own if held is None else own.unionByName(held)
            runs = self.level(k).drop("digest").join(held, ["group", "run"])
            each = runs.select("*", F.posexplode("children").alias("place", "child"))
            step = F.struct(_all(F.slice("children", F.lit(1), F.col("place"))).alias("before"), _all(F.slice("children", F.col("place") + 2, F.lit(self.fanout))).alias("after"))
            proof = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("proof"))).otherwise(F.col("proof"))
            if k:
                held = each.select("group", F.col("child.idx").alias("run"), proof.alias("proof"), *carried)
        return each.select("group", "child.*", proof.alias("proof"), *carried)


STEPS = "array<struct<before:string,after:string>>"


def folded(leaf: F.Column, proof: F.Column) -> F.Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda acc, step: digest(step["before"], acc, step["after"]))


def proof_digest(proof: F.Column) -> F.Column:
    """The digest of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """The trees of a dataset's sources and the tree over them."""

    sources: Tree
    top: Tree
    root: str | None

    @staticmethod
    def build(leaves: DataFrame, path: str, fanout: int = FANOUT) -> Manifest:
        """The manifest of leaves (source, doc_id, digest, ...) in a new folder; other columns stay with their leaves.

        Leaves of a source stand by doc_id, null first, and digest, sources by their bytes, null first.
        """
        dealt, pieces = ranges(cut(leaves), ["source"], ["doc_id", "digest"])
        pieces = cut(pieces)
        named = cut(pieces.groupBy("source").agg(F.sum("n").alias("total")))
        ordered, parts = ranges(named, [], ["source"])
        rank = F.col("at") - F.col("first") + F.col("start")
        ordered = ordered.join(F.broadcast(parts), F.shiftright("at", 33) == F.col("part")).select(F.col("source").alias("named"), "total", rank.alias("group"))  # a row for each range
        own = pieces.join(ordered, F.col("source").eqNullSafe(F.col("named"))).select("part", "named", "first", "start", "total", "group")
        own = cut(own)
        size = own.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("named"), F.lit(0)) + 64), F.lit(0))).first()[0]
        met = dealt.join(F.broadcast(own) if size <= SMALL else own, (F.shiftright("at", 33) == F.col("part")) & F.col("source").eqNullSafe(F.col("named")))
        nodes = met.select("group", F.col("total").alias("n"), rank.alias("idx"), *(c for c in leaves.columns if c != "source"))
        sources = Tree.build(nodes, f"{path}/sources", fanout)
        many = named.count()
        tops = sources.roots().select(F.lit(0).cast("long").alias("group"), F.lit(many).cast("long").alias("n"), F.col("group").alias("idx"), "digest")
        top = Tree.build(tops, f"{path}/top", fanout)
        root = top.roots().select("digest").first()  # one row
        return Manifest(sources, top, root and root[0])

    def proofs(self) -> DataFrame:
        """A row for each leaf: doc_id, digest and the columns beside them, subroot and proof, the steps from the leaf to the root."""
        roots = self.sources.roots().withColumnRenamed("digest", "subroot")
        high = self.top.proofs(self.top.roots().select("group", "level", F.array().cast(STEPS).alias("proof")))
        tops = roots.join(high.select(F.col("idx").alias("group"), "proof"), "group")
        return self.sources.proofs(tops).drop("group", "idx")


def proved_documents(docs: DataFrame, path: str | None = None, fanout: int = FANOUT) -> DataFrame:
    """A row for each row of docs (doc_id, source, lang, n_chars, text, ...): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is written to path, a new folder in the shared one unless given. Where TAMPERED divides
    the unsigned crc32 of the decimal doc_id, folded_root is that of a leaf whose text has lost its capitals;
    else, and for rows without a doc_id, that of the leaf itself. Nulls are leaves' `-`, an empty text is `0:`.
    Rows without a source are a source of their own; rows with one doc_id stand by their leaves, so that the
    result does not depend on the order of rows; repeated rows are leaves each. An empty table gives no rows.
    Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    own = [F.col(c).cast(kinds[c]) for c in FIELDS]
    lower = F.translate(own[-1], UPPER, LOWER)
    hit = F.crc32(F.encode(own[0].cast("string"), "UTF-8")) % TAMPERED == 0
    altered = F.when(hit & (lower != own[-1]), leaf_digest(*own[:-1], lower))
    leaves = docs.select(own[1].alias("source"), own[0].alias("doc_id"), leaf_digest(*own).alias("digest"), altered.alias("altered"))
    manifest = Manifest.build(leaves, path or shared_folder(spark, "manifest"), fanout)
    root, proved = F.lit(manifest.root), manifest.proofs()
    found = folded(F.coalesce("altered", "digest"), F.col("proof"))
    out = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.cast("string").alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents against one root, a fifth of them tampered with."""
    return proved_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)))


#: Levels that the SQL goes through: a source of 16 ** 6 rows, and as many sources.
_DEPTH = 6


def _sql_levels(name: str, group: str, start: str) -> str:
    """CTEs name_k (group, idx, digest, n, before, after) for the levels above start (group, idx, digest)."""
    out, nodes = [], start
    for k in range(_DEPTH + 1):
        run = f"PARTITION BY {group}, idx // 16 ORDER BY idx ROWS BETWEEN"
        around = f"coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT {group}, idx, digest, count(*) OVER (PARTITION BY {group}) AS n, {around} FROM ({nodes}))")
        nodes = f"SELECT {group}, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest FROM {name}_{k} GROUP BY {group}, idx // 16"
    return ",\n".join(out)


def _sql_fold(name: str, group: str, at: str, rows: str, prefix: str) -> str:
    """CTEs prefix_k that take rows through the levels: f is the folded digest, proof what stands around it."""
    out = []
    for k in range(_DEPTH + 1):
        step = f"CASE WHEN l.n = 1 THEN r.f ELSE sha256(l.before || r.f || l.after) END AS f, r.proof || l.before || l.after AS proof"
        out.append(f"{prefix}_{k} AS (SELECT r.* EXCLUDE (f, proof), {step} FROM {rows} r JOIN {name}_{k} l ON l.{group} = r.{group} AND l.idx = r.{at} // {16**k})")
        rows = f"{prefix}_{k}"
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""

ORACLE = f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, 0 AS one,
         sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
         CASE WHEN {_CRC} % 5 = 0
              THEN sha256({" || ".join(map(_field, FIELDS[:-1]))} || {_field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS altered
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, coalesce(altered, leaf) AS f, '' AS proof FROM leaves
), {_sql_levels("s", "g", "SELECT g, place AS idx, leaf AS digest FROM placed")},
subroots AS MATERIALIZED (SELECT g, digest AS subroot FROM s_{_DEPTH}),
{_sql_levels("t", "one", "SELECT 0 AS one, g AS idx, subroot AS digest FROM subroots")},
{_sql_fold("s", "g", "place", "placed", "up")},
{_sql_fold("t", "one", "g", f"up_{_DEPTH}", "top")}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = digest AS verified
FROM top_{_DEPTH} JOIN subroots USING (g), (SELECT digest FROM t_{_DEPTH})
"""
