"""Merkle manifest of a table: content-addressed records, and inclusion proofs that descend from the root by the digits of a rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.llm.common import stage

#: Bits of a rank that pick a child: runs of eight.
DIGIT_BITS = 3
FAN_OUT = 1 << DIGIT_BITS
DIGEST_BYTES = 32
#: Ranks are below 2^63, so no tree is higher than this.
HIGHEST = 21
TOP = "top"


def encoded(value: Column) -> Column:
    """A field so that neighbours cannot run into each other: byte count, colon, value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(text: Column) -> Column:
    """SHA-256 as 32 bytes. Digests are kept as bytes and become hex text where they are hashed or shown."""
    return F.unhex(F.sha2(text, 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hex_text), "")


def tree_key(group: Column) -> Column:
    """Name of a group's tree that is never null and sorts as the group does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def height_of(size: Column) -> Column:
    """Levels above the leaves of a tree: as many powers of the fan-out, from 1 on, as are below the number of leaves."""
    powers = [FAN_OUT**k for k in range(HIGHEST)]
    return F.size(F.filter(F.lit(powers), lambda x: x < size))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (with a column `tree`) with `position`, from 0 inside each tree by `order`, and `height` of the tree.

    One range partitioning by (tree, order): a row's place in its sorted piece is written with it, and the rows of the tree in earlier
    pieces are added, so no tree is sorted in one task. Rows that are equal in all of these are parted by their place in the
    input, so that many repeated rows do not meet in one piece either.
    """
    keys = ["tree", *order, "_tie"]
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = stage(laid.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    laid = laid.withColumn("_piece", F.shiftrightunsigned("_at", 33))
    runs = laid.groupBy("tree", "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_piece", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), height_of(F.sum("_n").over(whole)).alias("height"))
    placed = laid.join(runs, ["tree", "_piece"])
    return placed.withColumn("position", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_piece", "_first", "_before")


def grown(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Trees over `leaves` (tree, position, height, digest): (tree, height, digest) of every root, and the stores of the levels 1, 2, ...
    with a record (digest, children) for every distinct node."""
    top = leaves.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
    roots = leaves.where("height = 0").select("tree", "height", "digest")
    level, stores = leaves, []
    for h in range(1, top + 1):
        runs = level.where(F.col("height") >= h).groupBy("tree", "height", F.shiftright("position", DIGIT_BITS).alias("position"))
        nodes = runs.agg(F.sort_array(F.collect_list(F.struct("position", "digest")))["digest"].alias("children"))
        level = stage(nodes.withColumn("digest", digest_of(joined_hex(F.col("children")))), "level")
        roots = roots.union(level.where(F.col("height") == h).select("tree", "height", "digest"))
        stores.append(level.select("digest", "children"))
        level = level.drop("children")
    return roots, stores


@dataclass
class Manifest:
    """leaves (tree, position, height, digest and the columns of the rows), a root per tree (tree, position and height in the top tree, own
    height as `below`, digest) and the stores of both kinds of trees."""

    leaves: DataFrame
    trees: DataFrame
    stores: list[DataFrame]
    top_stores: list[DataFrame]
    root: DataFrame


def build_manifest(rows: DataFrame, digest: Column, group: str, order: list[str]) -> Manifest:
    """Leaves are the digests of the rows, in one tree per value of `group` by `order`; runs of eight nodes become one node until one
    remains. The roots of the trees, by group (null first), are the leaves of the top tree in the same way.

    Rows that tie in `order` follow by digest; nulls come first; repeated rows are leaves of their own; a table without rows has no root.
    """
    keyed = stage(rows.select("*", tree_key(F.col(group)).alias("tree"), digest.alias("digest")), "leaves")
    leaves = stage(ranked(keyed, [*order, "digest"]), "leaves")
    roots, stores = grown(leaves)
    roots = stage(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group_tree"), F.col("height").alias("below"), "digest"), "roots")
    trees = stage(ranked(roots, ["group_tree"]), "trees")
    root, top_stores = grown(trees)
    return Manifest(leaves, trees, stores, top_stores, root)


def descended(entries: DataFrame, stores: list[DataFrame], requests: DataFrame) -> DataFrame:
    """`requests` (tree, position, height, others) with what `entries` (tree, height, digest, path, others) hold for their tree, the digest
    found at their position, and `path`, to which every level has added (digit, siblings).

    Requests go down together from the root of their tree. Those whose digits agree so far are one row, so a level has no more rows
    than nodes; a row asks the store for the children of its digest, the requests take the child of their next digit, and
    the others become the siblings. Only the rows of one level are held; each level is staged.
    """
    digit = F.col("digit")
    chosen = F.get("children", digit).alias("digest")
    # A last run has fewer children; what is not there adds nothing.
    siblings = F.concat(*(F.coalesce(F.when(digit != i, F.get("children", F.lit(i))), F.lit(b"")) for i in range(FAN_OUT)))
    longer = F.concat("path", F.array(F.struct(digit.alias("digit"), siblings.alias("siblings")))).alias("path")
    carried = [c for c in entries.columns if c not in ("tree", "height", "digest", "path")]
    frontier = None
    for h in range(len(stores), -1, -1):
        here = requests.where(F.col("height") >= h)
        if h:
            here = here.select("tree", "height", F.shiftright("position", DIGIT_BITS * h).alias("position")).distinct()
        begun = here.where(F.col("height") == h).join(entries.drop("height"), "tree")
        if frontier is not None:
            records = stores[h].groupBy("digest").agg(F.first("children").alias("children"))
            opened = frontier.join(records, "digest").drop("digest").withColumnRenamed("position", "parent")
            asked = here.withColumn("parent", F.shiftright("position", DIGIT_BITS)).withColumn("digit", F.col("position").bitwiseAND(FAN_OUT - 1).cast("int"))
            met = asked.join(opened, ["tree", "parent"]).select(*here.columns, *carried, chosen, longer)
            begun = begun.select(*met.columns).union(met)
        frontier = stage(begun.drop("height"), "frontier") if h else begun
    return frontier


def inclusion_proofs(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """`requests` (tree, position, height, others: rows of `manifest.leaves` without their digest) with digest, subroot, root and path, the
    segments (digit, siblings) from the leaf to the root."""
    wanted = manifest.trees.join(requests.select(F.col("tree").alias("group_tree")).distinct(), "group_tree").drop("digest")
    none = F.array().cast("array<struct<digit:int,siblings:binary>>").alias("path")
    entries = manifest.root.select("tree", "height", "digest", F.col("digest").alias("root"), none)
    found = descended(entries, manifest.top_stores, wanted)
    entries = stage(found.select(F.col("group_tree").alias("tree"), F.col("below").alias("height"), "digest", F.col("digest").alias("subroot"), "root", "path"), "entries")
    proofs = descended(entries, manifest.stores, requests)
    return proofs.withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf (hex text) and the segments of its proof lead to."""

    def up(node: Column, step: Column) -> Column:
        cut = step["digit"] * DIGEST_BYTES
        left = step["siblings"].substr(F.lit(1), cut)
        right = step["siblings"].substr(cut + 1, F.lit(FAN_OUT * DIGEST_BYTES))
        return F.sha2(F.concat(hex_text(left), node, hex_text(right)), 256)

    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: hex_text(s["siblings"])), ""), 256)


def audited(
    docs: DataFrame, changed: dict[str, Column], where: Column, group: str = "lang", key: str = "doc_id",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
) -> DataFrame:
    """Manifest of `docs` over `fields`, and an audit of every row: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Rows that meet `where` are presented with the columns in `changed` altered; the others as they are. folded_root is what the
    presented row and the proof from the manifest lead to, verified tells whether that is the root. A null `where` counts as
    false. Null fields are a dash, empty ones have length zero; repeated rows, ties of the key and null keys and groups are
    defined by `build_manifest`; an empty table gives no rows; other columns are not read.
    """
    given = digest_of(F.concat(*(encoded(F.col(f)) for f in fields)))
    altered = digest_of(F.concat(*(encoded(changed.get(f, F.col(f))) for f in fields)))
    narrow = docs.select(F.col(key).alias("id"), F.col(group).alias("group"), given.alias("given"), F.when(where, altered).alias("altered"))
    manifest = build_manifest(narrow, F.col("given"), "group", ["id"])
    found = inclusion_proofs(manifest, manifest.leaves.select("tree", "position", "height", "id", "altered"))
    presented = hex_text(F.coalesce("altered", "digest"))
    shown = found.select("id", hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
                         proof_digest(F.col("path")).alias("proof_sha256"), folded(presented, F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    upper, lower = (bytes(range(k, k + 26)).decode() for k in (65, 97))
    return F.translate(text, upper, lower)
