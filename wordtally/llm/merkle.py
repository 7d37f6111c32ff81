"""Merkle manifest of a table by butterfly exchange (operator 12).

A leaf is the hash of a row's fields. The leaves of a language, ordered by
``doc_id``, are cut into partitions of ``FANOUT ** BLOCK_LEVELS`` consecutive
ones, and each partition hashes its own subtree. Then the partitions exchange
subtree roots round by round: in round ``r`` those whose numbers differ only
in digit ``r`` (base ``FANOUT``) form an aligned group of at most ``FANOUT``,
swap the roots of their subtrees of ``FANOUT ** r`` partitions, and all of
them hash the same ancestor. So each partition gathers its own upper proof on
the way up, and nothing is sent down again. Where the last subtree has fewer
partitions than its neighbours, its members also answer for the numbers it
lacks, dealt evenly among them. A second butterfly runs over the languages'
roots. A round is one shuffle of at most two rows a partition of leaves.

Texts are read once, by the scan that hashes them; what is sorted and grouped
are the hashes. Nodes, proofs and folding follow the contract of
``op12_merkle_manifest``.

Defined cases: a null field hashes as ``-``, an empty text as ``0:``; a long
text is hashed whole; rows without ``doc_id`` come first in their language and
are never tampered with; rows with equal ids are leaves of their own, ordered
by their hash, and equal rows are equal leaves side by side; a null language
is a group of its own, before all others; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, map_rows
from wordtally.operators.ranking import dense_index

FANOUT = 8
#: Levels that one partition hashes by itself: FANOUT ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before: string, after: string>>"


def node_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(row: dict[str, Column]) -> Column:
    """Hash of the fields, each with its length in bytes."""
    fields = [row[f].cast("string") for f in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text the audit changes: 3 divides the crc32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (language, null as the empty string and first), doc_id, leaf, changed (the tampered leaf) and a tie-breaker."""
    row = {f: F.col(f) for f in FIELDS}
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaf = leaf_hash(row)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf.alias("leaf"),
        F.when(tampered(F.col("doc_id")) & (lower != F.col("text")), leaf_hash(row | {"text": lower})).alias("changed"),
        F.monotonically_increasing_id().alias("tie"),
    )


def depth(n: Column) -> Column:
    """Levels above the leaves of a tree over ``n`` leaves."""
    return sum(((n > FANOUT**k).cast("int") for k in range(1, 20)), (n > 1).cast("int"))


def subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels of a subtree, leaves first."""
    out = [nodes]
    for _ in range(levels):
        nodes = [node_hash(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def blocks(rows: DataFrame, block_levels: int) -> DataFrame:
    """Partitions of consecutive leaves with the root of their subtree: grp, p, parts, depth, own (its levels), leaves, node."""
    size = FANOUT**block_levels
    ranked = dense_index(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")], "grp", "pos", "n")
    held = ranked.groupBy("grp", F.expr(f"pos div {size}").alias("p")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "changed"))).alias("leaves")
    )
    levels = depth(F.col("n"))
    held = held.select("grp", "p", F.expr(f"(n + {size - 1}) div {size}").alias("parts"), levels.alias("depth"), F.least(levels, F.lit(block_levels)).alias("own"), "leaves")

    def run(cols: dict[str, list]) -> dict[str, list]:
        tops = [subtree([x["leaf"] for x in row], own)[-1] for row, own in zip(cols["leaves"], cols["own"])]
        return {**cols, "node": [t[0] for t in tops]}

    ddl = "grp string, p long, parts long, depth int, own int, leaves array<struct<pos: long, doc_id: long, leaf: string, changed: string>>, node string"
    return map_rows(held, run, ddl, rows=16)


def butterfly(nodes: DataFrame, first_level: int, work: Work, name: str) -> DataFrame:
    """grp, p, node (the root of the group) and proof (sibling hashes level by level) of every partition.

    ``nodes`` holds grp, p (dense from 0), parts (partitions of the group),
    depth (levels of the group's tree) and node, the root of the partition's
    subtree, which stands at level ``first_level`` or is the group's root.
    """
    cur = work.store(nodes.select("grp", "p", "parts", "depth", "node", F.expr(f"cast(array() AS {PROOF})").alias("proof")), f"{name}_0")
    rounds = (cur.agg(F.max("depth").alias("d")).first()["d"] or 0) - first_level
    done = []
    for r in range(max(rounds, 0)):
        done.append(cur.where(F.col("depth") <= first_level + r))
        span = FANOUT**r
        low, sub = F.expr(f"p % {span}"), F.expr(f"p div {span}")
        short = F.expr(f"parts - ((parts - 1) div {span}) * {span}")  # partitions in the last subtree
        alone = (sub < F.expr(f"(parts - 1) div {span}")) | (sub % FANOUT == 0)
        lows = F.when(alone, F.array(low)).otherwise(F.sequence(low, F.lit(span - 1).cast("long"), short))
        send = cur.where(F.col("depth") > first_level + r).select("*", low.alias("own"), (sub % FANOUT).alias("digit"), F.expr(f"p div {span * FANOUT}").alias("high"), F.explode(lows).alias("low"))
        # the copies sent for numbers that the last subtree lacks carry no partition of their own
        mine = F.when(F.col("low") == F.col("own"), F.struct("p", "proof"))
        met = send.groupBy("grp", "high", "low", "parts", "depth").agg(F.sort_array(F.collect_list(F.struct("digit", "node", mine.alias("mine")))).alias("run"))
        met = met.select("grp", "parts", "depth", F.transform("run", lambda x: x["node"]).alias("roots"), F.posexplode("run").alias("at", "one")).where("one.mine IS NOT NULL")
        step = F.struct(F.array_join(F.slice("roots", F.lit(1), F.col("at")), "").alias("before"), F.array_join(F.slice("roots", F.col("at") + 2, F.lit(FANOUT)), "").alias("after"))
        cur = met.select("grp", F.col("one.mine.p").alias("p"), "parts", "depth", F.sha2(F.array_join("roots", ""), 256).alias("node"), F.concat("one.mine.proof", F.array(step)).alias("proof"))
        cur = work.store(cur, f"{name}_{r + 1}")
    for d in done:
        cur = cur.unionByName(d)
    return cur.select("grp", "p", "node", "proof")


def _audit(cols: dict[str, list]) -> dict[str, list]:
    """One row a leaf: its proof and the root folded from its tampered (else original) form."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
    for held, own, upper, subroot, root in zip(cols["leaves"], cols["own"], cols["proof"], cols["subroot"], cols["root"]):
        tree = subtree([x["leaf"] for x in held], own)
        above = [(s["before"], s["after"]) for s in upper]
        for at, x in enumerate(held):
            proof = []
            for level in tree[:-1]:
                start = at - at % FANOUT
                proof.append(("".join(level[start:at]), "".join(level[at + 1 : start + FANOUT])))
                at //= FANOUT
            proof += above
            node = x["changed"] or x["leaf"]
            for before, after in proof:
                node = node_hash([before, node, after])
            row = (x["doc_id"], x["leaf"], subroot, root, node_hash([s for step in proof for s in step]), node, node == root)
            for column, value in zip(out.values(), row):
                column.append(value)
    return out


def manifest(docs: DataFrame, work: Work, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    held = work.store(blocks(work.store(leaves(docs), "leaves"), block_levels), "blocks")
    upper = butterfly(held, block_levels, work, "exchange")
    tops = dense_index(upper.where("p = 0").select("grp", "node"), [F.col("grp")], None, "p", "parts")
    tops = work.store(tops.select("grp", "p", "node", "parts"), "subroots")
    over = butterfly(tops.select(F.lit("").alias("grp"), "p", "parts", depth(F.col("parts")).alias("depth"), "node"), 0, work, "languages")
    over = over.select("p", F.col("node").alias("root"), F.col("proof").alias("last"))
    tops = tops.join(over, "p").select("grp", F.col("node").alias("subroot"), "root", "last")
    upper = upper.select("grp", "p", "proof").join(tops, "grp").select("grp", "p", "subroot", "root", F.concat("proof", "last").alias("proof"))
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return map_rows(held.select("grp", "p", "own", "leaves").join(upper, ["grp", "p"]), _audit, ddl, rows=16)
