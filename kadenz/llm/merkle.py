"""Merkle manifest of a dataset, in DataFrame operations only.

Every row is a leaf: the hash of its fields. The leaves of a group stand in the order of their ids; the position of
a node divided by the fanout is its parent's, the remainder its slot. A level is made by a slot pivot: conditional
aggregates spread each parent's children into one column per slot, and concatenating the columns gives what the
parent hashes. Concatenating all columns but the own one gives a child's siblings. The groups' roots, in the order of
the groups, are the leaves of one more tree, whose root stands for the whole table.

No task holds a group: positions come from sampled ranges, a parent has `fanout` children at most, and levels shrink
by the fanout. A row's proof travels down the tree once per parent, not once per row.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadenz.llm.staging import stage
from kadenz.operators.ordering import numbered, running

#: Children of a node.
FANOUT = 16
#: Siblings before and behind a node, as hex texts, from its own parent up.
STEPS = "array<struct<ahead: string, behind: string>>"


def digest(*fields: Column) -> Column:
    """Lower-case hex sha256 of the fields: `-` for null, else the number of UTF-8 bytes, `:` and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lowered(text: Column) -> Column:
    """A-Z only are lowered; null stays null."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _joined(slots: list[Column]) -> Column:
    return F.concat(*[F.coalesce(s, F.lit("")) for s in slots])


def _slots(fanout: int) -> list[str]:
    return [f"s{k}" for k in range(fanout)]


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The pivoted levels of the trees of all groups: (grp, pos, s0, s1, ..., own).

    leaves: grp, pos from 0 without gaps, h. Row (grp, pos) of level k has the hashes of the children of that node,
    which stand on level k - 1 (0: the leaves). A group that has one node left has its row too, with `own` false: that
    node, in s0, is its root and is not hashed again. Levels end when every group has its root.
    """
    out, nodes = [], leaves.select("grp", "pos", "h")
    slot = F.pmod(F.col("pos"), F.lit(fanout))
    while True:
        parent = F.floor(F.col("pos") / fanout).cast("long").alias("pos")
        spread = [F.max(F.when(slot == k, F.col("h"))).alias(s) for k, s in enumerate(_slots(fanout))]
        # a parent at 0 with one child: the only node of its level
        level = nodes.groupBy("grp", parent).agg(*spread).withColumn("own", (F.col("pos") > 0) | F.col("s1").isNotNull())
        out.append(stage(level, f"merkle-level-{len(out) + 1}"))
        hashed = out[-1].where("own")
        if hashed.isEmpty():
            return out
        nodes = hashed.select("grp", "pos", F.sha2(_joined([F.col(s) for s in _slots(fanout)]), 256).alias("h"))


def roots(found: list[DataFrame]) -> DataFrame:
    """(grp, h, height): each group's root and the level that it stands on."""
    tops = [level.where("NOT own").select("grp", F.col("s0").alias("h"), F.lit(k).alias("height")) for k, level in enumerate(found)]
    return reduce(DataFrame.unionByName, tops)


def _around(k: Column, fanout: int) -> Column:
    """The siblings of slot k: all slot columns but its own; a column without a child adds nothing."""
    slots = F.array(*[F.col(s) for s in _slots(fanout)])
    return F.struct(
        F.array_join(F.slice(slots, F.lit(1), k), "").alias("ahead"), F.array_join(F.slice(slots, k + 2, F.lit(fanout)), "").alias("behind")
    )


def proofs(found: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, pos, own, s0, s1, ..., steps, and what else `above` carries): the parents of leaves with the steps above them.

    above: grp, steps (those of the group's root). From the top down, each level hands its steps to its children.
    A group of one leaf has one row, with `own` false.
    """
    carried = [c for c in above.columns if c != "grp"]
    slots = _slots(fanout)
    # one row for each group and level: its root's row, met by what stands above the root
    known = None
    for level in reversed(found):
        tops, inner = level.where("NOT own"), level.where("own")
        here = tops.join(above.hint("merge"), _same(tops, above, "grp")).select(*[tops[c] for c in level.columns], *[above[c] for c in carried])
        if known is not None:
            here = here.unionByName(inner.join(known.hint("merge"), _same(inner, known, "grp", "pos")).select(*[inner[c] for c in level.columns], *[known[c] for c in carried]))
        if level is found[0]:
            return here
        here = stage(here, "merkle-steps")
        children = here.select("*", F.posexplode(F.array(*[F.col(s) for s in slots])).alias("k", "child")).where("child IS NOT NULL")
        # the only child of a row without a hash is the root itself, which has no step of its own
        steps = F.when(F.col("own"), F.concat(F.array(_around(F.col("k"), fanout)), F.col("steps"))).otherwise(F.col("steps"))
        known = children.withColumns({"pos": F.col("pos") * fanout + F.col("k"), "steps": steps}).select("grp", "pos", *carried)
    raise ValueError("a tree has a level at least")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["ahead"], h, s["behind"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings from the leaf's run up to the root, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["ahead"], s["behind"])), "")


def manifest(rows: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", claims: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: id, group, leaf, subroot, root, steps, and each claim.

    A leaf is the digest of the fields in their order. Leaves of a group ascend by id (null first; repeated ids by
    leaf), groups ascend by their bytes (null first, a group of its own). claims: more leaves to carry along, by name,
    as expressions over the input, for checks of other versions of the rows. steps: the siblings around the row's node
    on each level up to the root, which `fold` and `siblings` take. A group of one row has its leaf as subroot, a
    table of one group its subroot as root. Equal rows have equal leaves and stand side by side, so which of
    them has which position does not matter. An empty table gives an empty result; other columns are not read.
    """
    claims = claims or {}
    leaves = rows.select(
        F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").alias("id"), digest(*[F.col(f"`{c}`") for c in fields]).alias("h"),
        *[c.alias(f"claim{i}") for i, c in enumerate(claims.values())], F.lit(1).cast("long").alias("one"),
    )
    leaves = stage(leaves, "merkle-leaves")
    leaves = stage(running(leaves, ["id", "h"], {"pos": "one"}, keys=["grp"]).drop("one"), "merkle-placed")
    trees = levels(leaves, fanout)
    tops = numbered(roots(trees), ["grp"], "pos").select(F.col("grp").alias("sub"), F.lit(0).alias("grp"), (F.col("pos") - 1).alias("pos"), "h")
    tops = stage(tops, "merkle-subroots")
    crown = levels(tops, fanout)
    whole = roots(crown).select("grp", F.col("h").alias("root"), F.array().cast(STEPS).alias("steps"))
    above = _down(tops.withColumnRenamed("h", "subroot"), proofs(crown, whole, fanout), fanout)
    above = stage(above.select(F.col("sub").alias("grp"), "subroot", "root", "steps"), "merkle-crown")
    out = _down(leaves.withColumnRenamed("h", "leaf"), proofs(trees, above, fanout), fanout)
    return out.select(F.col("id").alias(id_col), F.col("grp").alias(group_col), "leaf", "subroot", "root", "steps", *[F.col(f"claim{i}").alias(c) for i, c in enumerate(claims)])


def _down(leaves: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    """The leaves with their parents' columns, and with their own step before those above."""
    left = leaves.withColumnsRenamed({"grp": "of", "pos": "at"})
    # paths compress so well that their files say little about the size of a broadcast
    met = left.join(parents.hint("merge"), left["of"].eqNullSafe(parents["grp"]) & (F.floor(left["at"] / fanout) == parents["pos"]))
    slot = F.pmod(F.col("at"), F.lit(fanout)).cast("int")
    steps = F.when(F.col("own"), F.concat(F.array(_around(slot, fanout)), F.col("steps"))).otherwise(F.col("steps"))
    return met.withColumn("steps", steps).drop("own", "of", "at", "pos", *_slots(fanout))
