"""Trees of files as content-addressed objects, and their differences by a join that goes down level by level.

A tree is known by the digest of its entries, names with what they hold, so equal folders are one object, whichever commit or place they
are at. Two trees with one digest are equal all the way down: the join opens only those that differ, and reads as many rows as the
folders on the way to changes have entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.storage import checkpointed

ROOTS = "commit string, tree string"
ENTRIES = "tree string, name string, kind string, hash string"


def tree_objects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, entries): roots(commit, tree) of files(commit, path, blob), and entries(tree, name, kind, hash) of all distinct trees, kind
    being blob or tree. Folders are put together from the deepest up, one grouping a level, each row of which is a folder's entries.

    Of files given twice the smallest blob counts; rows with a null commit, path or blob take no part.
    """
    spark = files.sparkSession
    parts = F.split("path", "/")
    rows = files.where("commit is not null and path is not null and blob is not null").groupBy("commit", "path").agg(F.min("blob").alias("hash"))
    rows = checkpointed(rows.select("commit", F.size(parts).alias("depth"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), F.lit("blob").alias("kind"), "hash"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    columns = ["commit", "folder", "name", "kind", "hash"]
    trees, entries = spark.createDataFrame([], "commit string, folder string, name string, kind string, hash string"), spark.createDataFrame([], ENTRIES)
    for depth in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == depth).select(columns).unionByName(trees)
        made = here.groupBy("commit", "folder").agg(F.array_sort(F.collect_list(F.struct("name", "kind", "hash"))).alias("es"))
        made = checkpointed(made.withColumn("tree", F.sha2(F.to_json("es"), 256)))
        entries = entries.unionByName(made.groupBy("tree").agg(F.first("es").alias("es")).select("tree", F.inline("es")))
        up = F.split("folder", "/")
        trees = made.where("folder != ''").select("commit", F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/").alias("folder"), F.element_at(up, -1).alias("name"), F.lit("tree").alias("kind"), F.col("tree").alias("hash"))
    roots = made.where("folder = ''").select("commit", "tree") if deepest else spark.createDataFrame([], ROOTS)
    return roots, entries.distinct()


def object_diff(before: DataFrame, after: DataFrame, entries: DataFrame) -> DataFrame:
    """(commit, path, change) between two roots(commit, tree) of each commit: Insert, Modify or Delete of files. A commit in one of them
    alone has all of its files inserted or deleted; a file in place of a folder is an insert, and what was in the folder deletes."""
    spark = before.sparkSession
    b, a = before.select("commit", F.col("tree").alias("b")), after.select("commit", F.col("tree").alias("a"))
    front = checkpointed(b.join(a, "commit", "full_outer").where(~F.col("b").eqNullSafe(F.col("a"))).select("commit", F.lit("").alias("folder"), "b", "a"))
    out = spark.createDataFrame([], "commit string, path string, change string")
    while not front.isEmpty():
        both = checkpointed(_opened(front, entries))
        path, old, new = F.concat("folder", "name"), F.col("b_kind"), F.col("a_kind")
        change = F.when((old == "blob") & (new == "blob"), F.lit("Modify")).when(old == "blob", F.lit("Delete")).when(new == "blob", F.lit("Insert"))
        out = out.unionByName(both.where((old == "blob") | (new == "blob")).select("commit", path.alias("path"), change.alias("change")))
        below = both.where((old == "tree") | (new == "tree"))
        front = checkpointed(below.select("commit", F.concat(path, F.lit("/")).alias("folder"), F.when(old == "tree", F.col("b_hash")).alias("b"), F.when(new == "tree", F.col("a_hash")).alias("a")))
    return out


def _opened(front: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of front(commit, folder, b, a) that differ between the trees b and a."""

    def side(s: str) -> DataFrame:
        rows = front.where(F.col(s).isNotNull()).select("commit", "folder", F.col(s).alias("tree")).join(entries, "tree")
        return rows.select("commit", "folder", "name", F.col("kind").alias(f"{s}_kind"), F.col("hash").alias(f"{s}_hash"))

    both = side("b").join(side("a"), ["commit", "folder", "name"], "full_outer")
    return both.where(~(F.col("b_kind").eqNullSafe(F.col("a_kind")) & F.col("b_hash").eqNullSafe(F.col("a_hash"))))
