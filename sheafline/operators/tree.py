"""Directory trees as tables of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .lineage import settled
from .packing import running_totals


def nodes(files: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """bundle_id, node_id, parent_id, kind, name, path, depth of all files, implied and explicit directories, and the root."""
    own = files.select("bundle_id", "path").distinct()
    implied = own.select("bundle_id", F.explode(paths.ancestors(F.col("path"))).alias("path"))
    if directories is not None:
        explicit = directories.select("bundle_id", "path")
        implied = implied.unionByName(explicit).unionByName(explicit.select("bundle_id", F.explode(paths.ancestors(F.col("path"))).alias("path")))
    root = own.select("bundle_id", F.lit("").alias("path"))
    dirs = implied.unionByName(root).distinct().withColumn("kind", F.lit("directory"))
    both = dirs.unionByName(own.withColumn("kind", F.lit("file")))
    is_dir = F.col("kind") == "directory"
    return both.select(
        "bundle_id", F.when(is_dir, paths.node_id("directory", F.col("path"))).otherwise(paths.node_id("file", F.col("path"))).alias("node_id"),
        F.when(F.col("path") != "", paths.node_id("directory", paths.parent(F.col("path")))).alias("parent_id"), "kind", F.substring_index("path", "/", -1).alias("name"), "path",
        F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/", -1))).alias("depth"))


def ordered_children(tree: DataFrame) -> DataFrame:
    """ordinal of each node among its siblings: directories first, then by name with numbers by value."""
    key = F.struct((F.col("kind") == "file").alias("file"), paths.natural_key(F.col("name"), lower=True).alias("key"), "name")
    rows = tree.filter("parent_id is not null").withColumns({"__key": key, "__one": F.lit(1).cast("long")})
    out = running_totals(rows, ("bundle_id", "parent_id"), "__key", "__one")  # by ranges: a directory may hold very many files
    return out.withColumn("ordinal", F.col("upto").cast("int")).drop("__key", "__one", "upto")


def dangling(tree: DataFrame) -> DataFrame:
    """Nodes whose parent is no directory of the tree."""
    dirs = tree.filter("kind = 'directory'").select("bundle_id", F.col("node_id").alias("parent_id"))
    return tree.filter("parent_id is not null").join(dirs, ["bundle_id", "parent_id"], "left_anti")


def rendered(tree: DataFrame) -> DataFrame:
    """A line for each node, indented by depth, in path order."""
    mark = F.when(F.col("kind") == "directory", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    return tree.filter("path <> ''").select("bundle_id", "path", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), mark).alias("line"))


def ranks(nodes: DataFrame) -> DataFrame:
    """bundle_id, node_id, state of each declared directory (node_id, parent_id): `rooted` where its parents lead to the root, `island` where they end at a node that is no directory, `cycle` where they never end.

    Each directory points to its parent; by pointing to what their pointers point to, pointers double their reach in
    each round, so rounds follow the logarithm of the depth. A pointer that has gone more steps than there are directories
    goes round in a cycle. Ends are joined as rows of their own and dropped as soon as they are known, so what is joined
    again are the few that are still under way; those with one target are as many as the directories below it.
    """
    dirs = nodes.filter("kind = 'directory'").groupBy("bundle_id", "node_id").agg(F.min("parent_id").alias("at"))
    dirs = settled(dirs)
    known = dirs.select("bundle_id", F.col("node_id").alias("at"), F.lit(True).alias("known"))
    rows = dirs.join(known, ["bundle_id", "at"], "left").withColumn("state", F.when(F.col("at").isNull(), "rooted").when(F.col("known").isNull(), "island"))
    rows = settled(rows.select("bundle_id", "node_id", "at", "state"))
    done, open_ = rows.filter("state is not null"), rows.filter("state is null")
    steps, most = 1, dirs.count()
    while steps <= most and not open_.isEmpty():
        every = done.unionByName(open_).select("bundle_id", F.col("node_id").alias("at"), F.col("at").alias("to"), F.col("state").alias("ends"))
        next_ = settled(open_.drop("state").join(every, ["bundle_id", "at"]).select("bundle_id", "node_id", F.col("to").alias("at"), F.col("ends").alias("state")))
        done = settled(done.unionByName(next_.filter("state is not null")))
        open_ = next_.filter("state is null")
        steps *= 2
    return done.select("bundle_id", "node_id", "state").unionByName(open_.select("bundle_id", "node_id", F.lit("cycle").alias("state")))


def checked(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """bundle_id, node_id, code: what is wrong with a declared tree (node_id, parent_id, kind, name, path) against the records of files and directories (node_id, kind, path).

    Codes: a node met twice, a kind that is none, a node without a record or at another path, a file with children, several
    roots, a parent that is no directory, a path that is not its parent's path and its name, and directories and files
    from which no way leads to the root, because it ends elsewhere (island) or never (cycle).
    """
    rules = lambda rows, codes: rows.select("bundle_id", "node_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in codes.items()]))).alias("code"))
    coded = lambda rows, code: rows.select("bundle_id", "node_id", F.lit(code).alias("code"))
    nodes = settled(nodes.select("bundle_id", "node_id", "parent_id", "kind", "name", "path"))
    kinds = records.select("bundle_id", "node_id", F.col("kind").alias("own_kind"), F.col("path").alias("own_path"))
    known = nodes.join(kinds, ["bundle_id", "node_id"], "left")
    good = F.col("kind").isin("file", "directory")
    lost = F.col("own_kind").isNull() | (F.col("own_kind") != F.col("kind"))
    one = rules(known, {
        "tree-kind": ~good,
        "tree-file-reference": (F.col("kind") == "file") & lost, "tree-directory-reference": (F.col("kind") == "directory") & lost,
        "tree-file-path": (F.col("kind") == "file") & ~lost & (F.col("path") != F.col("own_path")), "tree-directory-path": (F.col("kind") == "directory") & ~lost & (F.col("path") != F.col("own_path")),
        "tree-file-root": (F.col("kind") == "file") & F.col("parent_id").isNull(),
    })
    twice = coded(nodes.groupBy("bundle_id", "node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "tree-duplicate-node")
    parents = nodes.groupBy("bundle_id", F.col("node_id").alias("parent_id")).agg(F.min("path").alias("above"), F.max((F.col("kind") == "file").cast("int")).alias("is_file"))
    below = nodes.filter("parent_id is not null").join(parents, ["bundle_id", "parent_id"], "left")
    own = F.when(F.col("above") == "", F.col("name")).otherwise(F.concat("above", F.lit("/"), "name"))
    links = rules(below, {"tree-parent": F.col("is_file").isNull(), "tree-path": F.col("path") != own})
    holders = below.filter("is_file = 1").select("bundle_id", F.col("parent_id").alias("node_id")).distinct()
    roots = nodes.filter("parent_id is null and kind = 'directory'").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id")).filter("n > 1")
    states = settled(ranks(nodes))
    bad = states.filter("state <> 'rooted'")
    files = nodes.filter("kind <> 'directory' and parent_id is not null").select("bundle_id", "node_id", "parent_id").distinct()
    fallen = files.join(states.withColumnRenamed("node_id", "parent_id"), ["bundle_id", "parent_id"], "left").select("bundle_id", "node_id", F.coalesce("state", F.lit("island")).alias("state")).filter("state <> 'rooted'")
    astray = bad.unionByName(fallen).distinct().select("bundle_id", "node_id", F.concat(F.lit("tree-"), "state").alias("code"))
    return one.unionByName(twice).unionByName(links).unionByName(coded(holders, "tree-file-children")).unionByName(coded(roots, "tree-roots")).unionByName(astray)
