"""Trees as a relation of nodes, and the ways in which tables become one.

A node relation has the columns parent (text; null at the top), id, name and is_leaf.  A page of children comes
from a total order: containers before leaves, then the name, then the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from pyspark.sql.window import Window

#: Levels that a walk goes down at most, unless told otherwise.
DEEPEST = 64


def folders_first(is_leaf: str = "is_leaf", name: str = "name", ident: str = "id") -> list[Column]:
    return [F.col(is_leaf).asc(), F.col(name).asc(), F.col(ident).asc()]


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows [offset, offset + limit) of the order, which must be total."""
    rows = df.orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


def children(nodes: DataFrame, parent: str | None, offset: int = 0, limit: int | None = None) -> DataFrame:
    here = nodes.filter(F.col("parent").isNull() if parent is None else F.col("parent") == parent)
    return page(here, folders_first(), offset, limit)


def pages(nodes: DataFrame, size: int) -> DataFrame:
    """All pages of all nodes at once: each child with its page and its place on it."""
    at = F.row_number().over(Window.partitionBy("parent").orderBy(*folders_first())) - 1
    return nodes.withColumn("_at", at).withColumns({"page": F.floor(F.col("_at") / size).cast("int"), "place": (F.col("_at") % size).cast("int")}).drop("_at")


def path_tree(paths: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """The directory tree of paths: distinct (parent, id, name, is_leaf); a path that is also a directory is two nodes."""
    parts = F.filter(F.split(path, F.lit(f"[{separator}]")), lambda x: x != "")
    split = paths.select(parts.alias("_p")).filter(F.size("_p") > 0)
    level = split.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_n"))
    up = F.array_join(F.slice("_p", F.lit(1), F.col("_n") - 1), separator)
    return level.select(
        F.nullif(up, F.lit("")).alias("parent"), F.array_join(F.slice("_p", F.lit(1), F.col("_n")), separator).alias("id"), F.element_at("_p", F.col("_n")).alias("name"), (F.col("_n") == F.size("_p")).alias("is_leaf")
    ).distinct()


def ancestors(keys: DataFrame, key: str, path: str, separator: str = "/") -> DataFrame:
    """The chain of nodes above and including each path: (key, depth, ancestor)."""
    parts = F.filter(F.split(path, F.lit(f"[{separator}]")), lambda x: x != "")
    rows = keys.select(key, parts.alias("_p")).filter(F.size("_p") > 0)
    return rows.select(key, F.posexplode(F.transform("_p", lambda x, i: F.array_join(F.slice("_p", F.lit(1), i + 1), separator))).alias("depth", "ancestor"))


def closure(nodes: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(ancestor, id, depth) for each node below each ancestor, itself included at depth 0: as many rows as nodes have
    ancestors.

    Each round doubles the length of the known paths, so a tree of depth d takes about log2 d joins.  Nodes of a
    cycle, and paths longer than ``deepest``, end there.
    """
    reach = nodes.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth"))
    step = nodes.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))).select(F.col("parent").alias("ancestor"), "id", F.lit(1).alias("depth"))
    known, length = cut(step), 1
    rounds = [known]
    while length < deepest:
        # Paths of the full length go on by all known ones; each round is computed once.
        right = known.select(F.col("ancestor").alias("_mid"), F.col("id").alias("_id"), F.col("depth").alias("_more"))
        far = rounds[-1].filter(F.col("depth") == length).join(right, F.col("id") == F.col("_mid"))
        longer = cut(far.select("ancestor", F.col("_id").alias("id"), (F.col("depth") + F.col("_more")).alias("depth")).filter(F.col("depth") <= deepest))
        if longer.isEmpty():
            break
        rounds.append(longer)
        known, length = known.union(longer), 2 * length
    return reach.union(known)


def depths(nodes: DataFrame, root: str | None = None) -> DataFrame:
    """(id, depth) of a node (or all top nodes) and what is below: the rows of a recursion from there, which has one for
    each way that leads to a node.

    Ways go up and double their lengths in each round, so a tree of depth d takes about log2 d joins, whatever its
    depth and size.  Ways that never arrive, as those of a cycle or of a missing parent, are no rows.
    """
    top = F.col("parent").isNull() if root is None else F.col("id").eqNullSafe(root)
    # A way that has arrived leads no further up.
    ways = cut(nodes.filter(top | F.col("parent").isNotNull()).select("id", F.when(~top, F.col("parent")).alias("up"), F.when(top, 0).otherwise(1).alias("depth")))
    arrived = ways.filter("up IS NULL").count()
    while not ways.filter("up IS NOT NULL").isEmpty():
        ahead = ways.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        further = ways.join(ahead, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        ways = cut(ways.filter("up IS NULL").union(further))
        before, arrived = arrived, ways.filter("up IS NULL").count()
        if arrived == before:
            # A longer way would have passed a node that arrives in this round.
            break
    return ways.filter("up IS NULL").select("id", "depth")


def recursive_nodes(rows: DataFrame, ident: str, parent: str, name: str, is_leaf: Column, root: str | None = None) -> DataFrame:
    """One table whose rows name their parents; rows below ``root`` are at the top."""
    up = F.col(parent).cast("string")
    top = up.isNull() | (up == "") | (up == root) if root is not None else up.isNull() | (up == "")
    return rows.select(F.when(~top, up).alias("parent"), F.col(ident).cast("string").alias("id"), F.col(name).alias("name"), is_leaf.alias("is_leaf"))


def folders_and_leaves(folders: DataFrame, leaves: DataFrame, leaf_folder: str, leaf_id: str, leaf_name: str) -> DataFrame:
    """A folder relation (a node relation without leaves) with the rows of another table in its folders."""
    items = leaves.select(F.col(leaf_folder).cast("string").alias("parent"), F.col(leaf_id).cast("string").alias("id"), F.col(leaf_name).alias("name"), F.lit(True).alias("is_leaf"))
    return folders.select("parent", "id", "name", "is_leaf").unionByName(items)


def value_groups(rows: DataFrame, group: str, ident: str, name: str, root_name: str) -> DataFrame:
    """A group for each distinct value, null and empty under the root's name, with its rows below it."""
    key = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit(root_name))
    groups = rows.select(key.alias("id")).distinct().select(F.lit(None).cast("string").alias("parent"), "id", F.col("id").alias("name"), F.lit(False).alias("is_leaf"))
    return groups.unionByName(rows.select(key.alias("parent"), F.col(ident).cast("string").alias("id"), F.col(name).alias("name"), F.lit(True).alias("is_leaf")))


def named_groups(definitions: DataFrame, rows: DataFrame, group: str, group_name: str, ident: str, name: str) -> DataFrame:
    """Groups from a table of their own, also empty ones, with their rows below them."""
    groups = definitions.select(F.lit(None).cast("string").alias("parent"), F.col(group).cast("string").alias("id"), F.col(group_name).alias("name"), F.lit(False).alias("is_leaf"))
    items = rows.join(definitions.select(group), group, "left_semi")
    return groups.unionByName(items.select(F.col(group).cast("string").alias("parent"), F.col(ident).cast("string").alias("id"), F.col(name).alias("name"), F.lit(True).alias("is_leaf")))


def named_group_trees(definitions: DataFrame, rows: DataFrame, group: str, group_name: str, root: str, ident: str, parent: str, name: str, is_leaf: Column) -> DataFrame:
    """Groups that each hold a tree of their own: rows whose parent is the group's root are right below the group.

    Ids become ``<group>/<id>``, as two groups may use the same ids.
    """
    key = lambda c: F.concat_ws("/", F.col(group).cast("string"), F.col(c).cast("string"))
    groups = definitions.select(F.lit(None).cast("string").alias("parent"), F.col(group).cast("string").alias("id"), F.col(group_name).alias("name"), F.lit(False).alias("is_leaf"))
    inner = rows.join(definitions.select(group, root), group)
    top = F.col(parent).isNull() | (F.col(parent) == F.col(root))
    items = inner.select(F.when(top, F.col(group).cast("string")).otherwise(key(parent)).alias("parent"), key(ident).alias("id"), F.col(name).alias("name"), is_leaf.alias("is_leaf"))
    return groups.unionByName(items)


def categorized(nodes: DataFrame, category: Column, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """A level of categories above the top nodes; categories without nodes are left out.  The column place has the
    order of the labels; a top node of no listed category is in the first."""
    keys = [k for k, _ in labels]
    top = F.col("parent").isNull()
    kind = F.when(category.isin(*keys), category).otherwise(keys[0])
    rows = nodes.withColumn("_kind", F.when(top, F.concat(F.lit("category:"), kind)))
    order = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(labels) for x in (f"category:{k}", i)])
    title = F.create_map(*[F.lit(x) for k, t in labels for x in (f"category:{k}", t)])
    heads = rows.filter(top).select(F.col("_kind").alias("id")).distinct()
    heads = heads.select(F.lit(None).cast("string").alias("parent"), "id", title[F.col("id")].alias("name"), F.lit(False).alias("is_leaf"), order[F.col("id")].alias("place"))
    rest = rows.select(F.coalesce("parent", "_kind").alias("parent"), "id", "name", "is_leaf", F.lit(None).cast("int").alias("place"))
    return heads.unionByName(rest)


def file_system_nodes(entries: DataFrame) -> DataFrame:
    """A file system's entries (dirname, basename, file_type: 2 is a directory) as nodes."""
    full = F.when(F.col("dirname") == "/", F.concat(F.lit("/"), "basename")).otherwise(F.concat_ws("/", "dirname", "basename"))
    return entries.select(F.when(F.col("dirname") != "/", F.col("dirname")).alias("parent"), full.alias("id"), F.col("basename").alias("name"), (F.col("file_type") != 2).alias("is_leaf"))


def disk_key(fid: Column, path: Column) -> Column:
    """Which disk a fragment belongs to: (uuid, index) from its name; a file of another name is a disk of its own."""
    shape = r"D\(([^)]*)\).*S\(([^)]*)\)(_[0-9]+)?\.img$"
    uuid = F.nullif(F.regexp_extract(path, shape, 1), F.lit(""))
    return F.when(uuid.isNotNull(), F.struct(uuid.alias("disk"), F.regexp_extract(path, shape, 2).alias("index"))).otherwise(F.struct(F.lit("_single").alias("disk"), fid.cast("string").alias("index")))


def disk_order(key: Column) -> list[Column]:
    """Disks with a number in its order, others after them by text."""
    number = key["index"].try_cast("bigint")
    return [number.isNull().asc(), number.asc(), key["index"].asc(), key["disk"].asc()]


def devices(device: DataFrame, objects: DataFrame, version_id: int | None = None) -> DataFrame:
    """Devices and their objects; interrupted rows are left out, objects of another format are marked unsupported."""
    rows = objects.filter(F.coalesce("temp_postfix", F.lit("")) == "")
    if version_id is not None:
        rows, device = rows.filter(F.col("version_id") == version_id), device.filter(F.col("version_id") == version_id)
    top = device.select(F.lit(None).cast("string").alias("parent"), F.concat(F.lit("device:"), F.col("config_device_id").cast("string")).alias("id"), F.col("host_name").alias("name"), F.lit(False).alias("is_leaf"), F.lit(True).alias("supported"))
    plain = (F.col("dedup_object") == 0) | (F.col("data_format") == 1)
    items = rows.select(F.concat(F.lit("device:"), F.col("config_device_id").cast("string")).alias("parent"), F.col("object_id").cast("string").alias("id"), F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit(True).alias("is_leaf"), plain.alias("supported"))
    return top.unionByName(items)


def export_names(nodes: DataFrame) -> DataFrame:
    """A file or directory name for each node that is safe, and alone in its directory also where case is ignored."""
    from ..functions.names import numbered_names, safe_file_name

    safe = nodes.withColumn("_safe", safe_file_name(F.col("name")))
    return numbered_names(safe, ["parent"], "_safe", ["is_leaf", "id"]).drop("_safe")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two node relations: (id, change) with ADDED, REMOVED or RELABELLED."""
    a = old.select("id", F.col("name").alias("_old"), F.lit(1).alias("_a"))
    b = new.select(F.col("id").alias("_id"), F.col("name").alias("_new"), F.lit(1).alias("_b"))
    both = a.join(b, F.col("id") == F.col("_id"), "full_outer")
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(~F.col("_old").eqNullSafe(F.col("_new")), "RELABELLED")
    return both.select(F.coalesce("id", "_id").alias("id"), change.alias("change")).filter("change IS NOT NULL")
