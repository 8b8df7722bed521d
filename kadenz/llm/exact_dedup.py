"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of fixed size. Equal blocks get one integer name: the distinct blocks are
sorted and numbered. Neighbouring names are then paired and the distinct pairs are sorted and numbered
in the same way, level after level, until a document has one name. Texts of equal length go through
the same levels, so (length, last name) is the same for two documents exactly when their texts are.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadenz.llm.staging import stage

#: Characters of one block.
BLOCK = 2048
KEYS = ["__id", "__tag", "__len"]


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z only are lowered."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def _named(distinct: DataFrame, by: list[str], label: str) -> DataFrame:
    """Sorts distinct rows within hash partitions and numbers them; the written table fixes the numbers."""
    numbered = distinct.sortWithinPartitions(*by).withColumn("__name", F.monotonically_increasing_id())
    return stage(numbered.select(*[c for c in numbered.columns if c != "__block"]), label)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per (id, text): __id, __tag (hash of the text, tells texts under a repeated id apart), __len,
    __rows (how many input rows) and __name.

    Blocks travel through one shuffle, as distinct blocks with map-side combining, so a hot block costs one
    row per task. The way back to documents joins on 128-bit block hashes; if two different blocks ever
    shared one, the job would stop with an error instead of giving a wrong result.
    """
    text = normalised(F.col(text_col))
    # blocks first, then the explode: what stands beside a generator is worked out for each of its rows
    cut = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(text).alias("__tag"), F.length(text).alias("__len"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), 0).alias("__blocks"),
    )
    cut = cut.select("__id", "__tag", "__len", F.posexplode_outer("__blocks").alias("__pos", "__block"))
    cut = cut.withColumns({"__pos": F.coalesce("__pos", F.lit(0)), "__block": F.coalesce("__block", F.lit(""))})
    hashed = {"__h1": F.xxhash64("__block"), "__h2": F.xxhash64(F.lit(1), "__block")}
    names = _named(cut.select("__block").distinct().withColumns(hashed), ["__block"], "block-names")
    found = cut.withColumns(hashed).drop("__block").join(names, ["__h1", "__h2"])
    nodes = found.groupBy(*KEYS, "__pos").agg(
        F.max("__name").alias("__name"), F.min("__name").alias("__least"), F.count(F.lit(1)).alias("__rows")
    )
    nodes = nodes.withColumn("__name", F.when(F.col("__name") == F.col("__least"), F.col("__name")).otherwise(F.raise_error(F.lit("two blocks share a hash")))).drop("__least")
    nodes = stage(nodes, "block-level-0")
    done, level, size = [], 0, block
    while True:
        one = F.col("__len") <= size
        done.append(nodes.where(one).select(*KEYS, "__rows", "__name"))
        more = nodes.where(~one)
        if more.isEmpty():
            break
        level, size = level + 1, 2 * size
        pairs = stage(
            more.groupBy(*KEYS, "__rows", F.expr("__pos div 2").alias("__pos")).agg(
                F.max(F.when(F.col("__pos") % 2 == 0, F.col("__name"))).alias("__a"),
                F.coalesce(F.max(F.when(F.col("__pos") % 2 == 1, F.col("__name"))), F.lit(-1)).alias("__b"),
            ),
            f"block-pairs-{level}",
        )
        names = _named(pairs.select("__a", "__b").distinct(), ["__a", "__b"], f"pair-names-{level}")
        nodes = stage(pairs.join(names, ["__a", "__b"]).select(*KEYS, "__rows", "__pos", "__name"), f"block-level-{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds keep_id, group_size and kept to every row of docs.

    Texts are equal when identical after lowering A-Z. Of equal texts the row with the largest id stays.
    columns: input columns to return (all, if not given); leave the text out where it isn't needed, as then
    only hashes of it are shuffled. Input columns named like a result are replaced.

    A null text is an empty one, and all empty texts form one group. A null id takes part in its group, but
    stays only if all ids of the group are null. Of rows that repeat the largest id and the text any one stays. An
    empty table gives an empty result.
    """
    new = ["keep_id", "group_size", "kept"]
    known = stage(identities(docs, id_col, text_col, block), "identities")
    # written, so that the join reads two plain tables and the rows of a hot group can be split over tasks
    groups = stage(known.groupBy("__len", "__name").agg(F.max("__id").alias("keep_id"), F.sum("__rows").alias("group_size")), "groups")
    several = F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__rows") > 1)
    verdict = known.join(groups, ["__len", "__name"]).select("__id", F.col("__tag").alias("__vtag"), "keep_id", "group_size", several.alias("__several"))
    verdict = stage(verdict, "verdicts")
    keep = [c for c in columns or docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("__rid"), F.xxhash64(normalised(F.col(text_col))).alias("__rtag"))
    out = rows.join(verdict, F.col("__rid").eqNullSafe(F.col("__id")) & (F.col("__rtag") == F.col("__vtag")))
    out = out.withColumn("kept", F.col("__rid").eqNullSafe(F.col("keep_id")))
    if not verdict.where("__several").isEmpty():
        out = out.where("NOT __several").unionByName(_one_of(out.where("__several")))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "keep_id", "group_size", "kept")


def _one_of(rows: DataFrame) -> DataFrame:
    """Rows that repeat an id and a text: one of each stays. One of each task's goes into the choice, so no task holds all."""
    salted = rows.withColumn("__salt", F.spark_partition_id())
    within = Window.partitionBy("__rid", "__rtag", "__salt").orderBy("__rid")
    salted = salted.withColumn("__salt", F.when(F.row_number().over(within) == 1, -1).otherwise(F.col("__salt")))
    among = Window.partitionBy("__rid", "__rtag", "__salt").orderBy("__rid")
    return salted.withColumn("kept", (F.col("__salt") == -1) & (F.row_number().over(among) == 1)).drop("__salt")
