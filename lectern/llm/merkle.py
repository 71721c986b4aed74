"""Merkle manifest of a table by the preimages of parents.

Each row is a leaf: a digest of its columns. Leaves of one group, in order, are the lowest nodes of a
tree; every two neighbours become a parent, whose *preimage* is the text of its children's digests and
whose digest is that of the preimage. The preimages are the manifest. Where a leaf is to be proved,
it meets the preimages of its ancestors: in each, what is left without its own 64 characters are its
siblings, and the preimage with other characters in their place is what a parent of a changed leaf has.

Trees are raised and descended by blocks of 256 neighbours, eight levels at once, so a tree of 16
million leaves takes three rounds and nothing larger than a block comes to one task, whatever the share
of a group. The places of leaves come from a sort in ranges.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pick, ranked, ship, stored

#: Characters of a digest as text.
SLOT = 64
#: Levels of a tree that are raised or descended at once, and nodes at their foot.
LEVELS = 8
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(preimage: str) -> str:
    return sha256(preimage.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value with its length in front, or ``-`` for null, so that no two rows have the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _raised(pdf: pd.DataFrame) -> pd.DataFrame:
    """The parents above a block's nodes, up to the single node at its top: level 1 to 8, index within the level, preimage; level 0 is the top's digest."""
    pdf = pdf.sort_values("idx")
    nodes, n = pdf["hash"].tolist(), int(pdf["n"].iloc[0])
    block = int(pdf["idx"].iloc[0]) >> LEVELS
    out, level = [], 0
    # A tree within one block ends where one node is left; in others a block has all its levels.
    while len(nodes) > 1 if n <= BLOCK else level < LEVELS:
        pairs = ["".join(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        nodes, level = [digest(p) for p in pairs], level + 1
        out += [(level, i, p) for i, p in enumerate(pairs)]
    out.append((0, block, nodes[0]))
    rows = pd.DataFrame(out, columns=["level", "place", "content"])
    rows["tree"], rows["block"], rows["n"] = pdf["tree"].iloc[0], block, n
    return rows


_RAISED = "level int, place int, content string, tree string, block long, n long"


def raised(nodes: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For nodes (tree, idx, hash, n), n those of the tree: of each round the nodes, and the stored preimages and tops above them."""
    rounds = []
    while True:
        block = F.shiftright("idx", LEVELS).alias("block")
        above = stored(nodes.select("tree", "idx", "hash", "n").groupBy("tree", block).applyInPandas(lambda key, pdf: _raised(pdf), _RAISED), "preimages")
        rounds.append((nodes, above))
        tops = above.where("level = 0").select("tree", F.col("block").alias("idx"), F.col("content").alias("hash"), F.ceil(F.col("n") / BLOCK).alias("n"))
        if tops.where("n > 1").isEmpty():
            return rounds
        # Trees that have come to one node need no more rounds.
        nodes = tops.where("n > 1")


def roots(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(tree, root) of each tree."""
    tops = [above.where(f"level = 0 AND n <= {BLOCK}") for _, above in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionAll(t)
    return out.select("tree", F.col("content").alias("root"))


def _path(place: int, levels: dict[tuple[int, int], str]) -> list[tuple[str, int]]:
    """The ancestors of the node at ``place`` of a block, lowest first: preimage, and where in it the node's branch stands."""
    out, level = [], 1
    while (level, place >> 1) in levels:
        out.append((levels[level, place >> 1], place & 1))
        place, level = place >> 1, level + 1
    return out


def without(preimage: str, slot: int) -> str:
    """The siblings of the child at ``slot``."""
    return preimage[: SLOT * slot] + preimage[SLOT * (slot + 1) :]


def spliced(preimage: str, slot: int, other: str) -> str:
    """The preimage with another digest for the child at ``slot``."""
    return preimage[: SLOT * slot] + other + preimage[SLOT * (slot + 1) :]


def _told(path: list[tuple[str, int]]) -> str:
    """A path as text: where the branch stands and the preimage, for each ancestor."""
    return ",".join(f"{slot}{preimage}" for preimage, slot in path)


def _read(told: str) -> list[tuple[str, int]]:
    return [(p[1:], int(p[0])) for p in told.split(",")] if told else []


def _descend(rounds: list, above_tops: DataFrame | None, leaf: str, finish) -> DataFrame:
    """Gives each node of the first round its path: round by round from the top, a block's path goes to its nodes.

    ``above_tops`` (tree, up) are paths above the roots. ``finish`` makes the rows of ``leaf``, a schema, from a frame of
    nodes and the paths of each.
    """

    def joined(left: pd.DataFrame, right: pd.DataFrame) -> list[list[tuple[str, int]]]:
        levels = {(a, b): c for a, b, c in zip(right["level"], right["place"], right["content"], strict=True)}
        up = _read(levels.pop((0, 0)))
        return [_path(i & BLOCK - 1, levels) + up for i in left["idx"].tolist()]

    def passed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": left["tree"], "block": left["idx"], "up": [_told(f) for f in joined(left, right)]})

    def finished(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return finish(left, joined(left, right))

    ups = None
    for k in range(len(rounds) - 1, -1, -1):
        nodes, above = rounds[k]
        # Above a block stands the path of its top: that of the tree's root, or of a node of the next round.
        last = above.where((F.col("level") == 0) & (F.col("n") <= BLOCK)).select("tree", "block")
        tops = last.join(above_tops, "tree") if above_tops is not None else last.withColumn("up", F.lit(""))
        tops = tops.select("tree", "block", "up")
        if ups is not None:
            tops = tops.unionAll(ups)
        paths = above.where("level > 0").select("tree", "block", "level", "place", "content").unionAll(tops.select("tree", "block", F.lit(0), F.lit(0), "up"))
        keyed = nodes.withColumn("block", F.shiftright("idx", LEVELS))
        both = keyed.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInPandas(*((passed, "tree string, block long, up string") if k else (finished, leaf)))
        if k == 0:
            return both
        ups = stored(both, "paths")


def manifest(docs: DataFrame, changed: Column, tampered: dict[str, Column], group: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``fields``, encoded one after the other; the leaves of each ``group`` ascend by
    doc_id and make one tree, whose root is the group's subroot (a lone leaf is itself one), and the
    subroots, in the order of groups, null first, make the tree of ``root``. ``proof_sha256`` is the
    digest of all siblings of the leaf, lowest first, and ``folded_root`` what the leaf and its
    siblings give; for rows where ``changed`` holds, the leaf is made with ``tampered`` (expressions by
    field) instead. ``verified`` says whether that is the root.

    Null fields are told from empty ones; a null ``changed`` counts as false. Rows with one doc_id stand
    by their leaf digests (null ids first), so those that are equal are interchangeable. An empty table
    gives no rows; columns whose names are like others do not matter.
    """
    ship(docs.sparkSession)
    base = pick(docs, "doc_id", *(f for f in dict.fromkeys((*fields, group)) if f != "doc_id"))
    leaf = F.sha2(F.concat(*(encoded(F.col(f)) for f in fields)), 256)
    other = F.sha2(F.concat(*(encoded(tampered.get(f, F.col(f))) for f in fields)), 256)
    # No group is like the key of null, which is also the smallest.
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit(""))
    leaves = ranked(base.select(key.alias("tree"), "doc_id", leaf.alias("hash"), F.when(F.coalesce(changed, F.lit(False)), other).alias("other")), "rank", F.col("tree"), F.col("doc_id"), F.col("hash"))
    leaves = stored(leaves, "leaves")
    groups = stored(leaves.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "groups")
    nodes = leaves.join(groups, "tree").select("tree", (F.col("rank") - F.col("first")).alias("idx"), "hash", "n", F.col("doc_id").cast("string").alias("doc_id"), "other")  # pandas would make longs with nulls floats
    lower = raised(nodes)
    subroots = stored(roots(lower), "subroots")
    count = subroots.count()
    if not count:
        return leaves.select("doc_id", F.col("hash").alias("leaf"), *(F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    upper = raised(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("hash"), F.lit(count).cast("long").alias("n")), "idx", F.col("of")))

    def as_paths(left: pd.DataFrame, found: list) -> pd.DataFrame:
        return pd.DataFrame({"tree": left["of"], "subroot": left["hash"], "up": [_told(f) for f in found]})

    root = roots(upper).first()["root"]
    over = stored(_descend(upper, None, "tree string, subroot string, up string", as_paths), "over")

    def proved(left: pd.DataFrame, found: list) -> pd.DataFrame:
        proofs, folds = [], []
        for h, o, path in zip(left["hash"], left["other"], found, strict=True):
            proofs.append(digest("".join(without(p, s) for p, s in path)))
            now = o if isinstance(o, str) else h
            for p, s in path:
                now = digest(spliced(p, s, now))
            folds.append(now)
        return pd.DataFrame({"tree": left["tree"], "doc_id": left["doc_id"], "leaf": left["hash"], "proof_sha256": proofs, "folded_root": folds})

    id_type = base.schema["doc_id"].dataType.simpleString()
    rows = _descend(lower, over.select("tree", "up"), "tree string, doc_id string, leaf string, proof_sha256 string, folded_root string", proved)
    return rows.join(over.select("tree", "subroot"), "tree").select(F.col("doc_id").cast(id_type).alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
