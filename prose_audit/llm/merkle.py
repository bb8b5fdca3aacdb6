"""A Merkle manifest of a table: one tree for each source, a tree over their roots, and versions of tampered rows.

Leaves get their places by a range sort with prefix sums. Nodes lie in aligned blocks of FANOUT ** HEIGHT; a task
builds the levels of one block, and the blocks' roots are the nodes of the next tier, until a tree has one node.
From the top down each block then learns the siblings on its way to the root.

The tree is persistent: a tampered leaf makes a version of its own by path copying. ``Block.replace`` copies the
ancestors of that leaf inside the block and shares all other nodes; the version goes on from the block's root along
the upper tiers, where it copies one node a level as well. Nothing of another version or of untouched nodes is copied.

No group grows with the input: blocks have a fixed size whatever the source's, and a block's way to the root is one
row. Trees may be as many as rows.

Defined cases: a null field is written ``-``, a null source is a source of its own and comes first, null doc_ids come
first in their source and are never tampered with, equal doc_ids are ordered by their leaves, repeated rows are leaves
of their own; a source of one row has its leaf as subroot, a table of one source its subroot as root; empty and very
long texts are hashed whole; an empty table gives no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, placed, stored

#: Children of a node; levels of an aligned block.
FANOUT, HEIGHT = 16, 2
BLOCK = FANOUT**HEIGHT
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "struct<level: int, place: long, digest: string>"
SIBLINGS = "struct<place: long, left: string, right: string>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels that a block of a tree of ``nodes`` nodes has above them: until one is left, HEIGHT at most."""
    levels = 0
    while levels < HEIGHT and FANOUT**levels < nodes:
        levels += 1
    return levels


class Block:
    """Nodes of an aligned block, each a digest with its children's numbers, and the number of its root."""

    def __init__(self, digests: list[str], levels: int) -> None:
        self.digests, self.children = list(digests), [()] * len(digests)
        row = list(range(len(digests)))
        self.levels = [row]
        for _ in range(levels):
            row = [self.add(tuple(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
            self.levels.append(row)
        self.root = row[0]

    def add(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest([self.digests[c] for c in children]))
        self.children.append(children)
        return len(self.digests) - 1

    def replace(self, place: int, leaf: str) -> list[int]:
        """The numbers of a new leaf and of its copied ancestors, the last being the root of the version."""
        self.digests.append(leaf)
        self.children.append(())
        copied = [len(self.digests) - 1]
        for level in range(1, len(self.levels)):
            own = place % FANOUT
            place //= FANOUT
            children = self.children[self.levels[level][place]]
            copied.append(self.add((*children[:own], copied[-1], *children[own + 1 :])))
        return copied

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """Digests to the left and to the right of a leaf and of its ancestors, by level."""
        out = []
        for level in range(1, len(self.levels)):
            own = place % FANOUT
            place //= FANOUT
            run = [self.digests[c] for c in self.children[self.levels[level][place]]]
            out.append(("".join(run[:own]), "".join(run[own + 1 :])))
        return out


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The digest of a row of documents with this text."""
    rest = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*rest, field(text)).cast("binary"), 256)


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK))


def ordered(table: pa.Table) -> tuple[list[dict], Block, int]:
    """Rows of a block by place, the block, and the place of its first node."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    return rows, Block([r["digest"] for r in rows], height(rows[0]["nodes"])), rows[0]["place"]


def roots(nodes: DataFrame) -> DataFrame:
    """``nodes(tree, place, nodes, digest)`` → the same of the next tier: the roots of the aligned blocks."""
    schema = "tree string, place long, nodes long, digest string"
    out = arrow_schema(nodes.sparkSession, schema)

    def build(table: pa.Table) -> pa.Table:
        rows, block, first = ordered(table)
        row = {"tree": rows[0]["tree"], "place": first // BLOCK, "nodes": -(-rows[0]["nodes"] // BLOCK), "digest": block.digests[block.root]}
        return pa.Table.from_pylist([row], schema=out)

    return in_blocks(nodes.select("tree", "place", "nodes", "digest")).groupBy("tree", "block").applyInArrow(build, schema)


def with_ways(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """``nodes`` and the ``way`` of each to the root, given ``upper(tree, place, way, subroot, root)`` of the next tier."""
    schema = f"tree string, place long, digest string, way array<{SIBLINGS}>, subroot string, root string"
    out = arrow_schema(nodes.sparkSession, schema)

    def extend(own: pa.Table, above: pa.Table) -> pa.Table:
        (rows, block, first), up = ordered(own), above.to_pylist()[0]
        found = []
        for r in rows:
            way = [{"place": r["place"] // FANOUT ** (k + 1), "left": a, "right": b} for k, (a, b) in enumerate(block.siblings(r["place"] - first))] + up["way"]
            found.append({"tree": r["tree"], "place": r["place"], "digest": r["digest"], "way": way, "subroot": up["subroot"], "root": up["root"]})
        return pa.Table.from_pylist(found, schema=out)

    return joined(nodes.select("tree", "place", "nodes", "digest"), upper).applyInArrow(extend, schema)


def joined(nodes: DataFrame, upper: DataFrame):
    above = upper.withColumnRenamed("place", "block")
    return in_blocks(nodes).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tiers above them, up to that in which every tree has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("nodes")).first()[0] or 1) > 1:
        out.append(stored(roots(out[-1]), "merkle-tier"))
    return out


def ways(own: list[DataFrame], top: DataFrame) -> DataFrame:
    """The ways of the nodes of the second of the tiers, from those of the last one's."""
    for tier in own[-2:0:-1]:
        top = stored(with_ways(tier, top), "merkle-ways")
    return top


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves, proofs and versions of ``docs(doc_id, text, lang, source, n_chars)``.

    Where ``tampered`` is true, the row's text is taken to have its A-Z lower-cased. Returns source, doc_id, place,
    leaf, subroot, root, proof_sha256, n_siblings, and of rows tampered with ``version``: the new leaf and the nodes
    copied for it, up to the version's root. A node's place is that in its source's tree, above the subroot that in
    the tree of sources.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", "n_chars", "text")
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col("source")))
    changed = F.when(tampered, leaf(F.translate("text", CAPITALS, SMALL)))
    leaves = placed(own.select(tree.alias("tree"), "source", "doc_id", leaf(F.col("text")).alias("digest"), changed.alias("changed")), ["doc_id", "digest"])
    of_source = tiers(leaves.select("tree", "place", "nodes", "digest"))
    if len(of_source) == 1:  # every source has one row at most
        of_source.append(stored(roots(of_source[0]), "merkle-tier"))
    subroots = of_source[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    ranked = placed(subroots, ["source"])
    of_all = tiers(ranked.select("tree", "place", "nodes", "digest"))
    if len(of_all) == 1:
        of_all.append(stored(roots(of_all[0]), "merkle-tier"))
    none = F.array().cast(f"array<{SIBLINGS}>")
    end = of_all[-1].select("tree", "place", none.alias("way"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    sources = with_ways(of_all[0], ways(of_all, end)).select("place", "way", "root")
    top = ranked.join(sources, "place").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "way", F.col("digest").alias("subroot"), "root")
    return finish(leaves, ways(of_source, stored(top, "merkle-ways")))


def finish(leaves: DataFrame, upper: DataFrame) -> DataFrame:
    """Proofs and versions of the leaves of each block, from the way of its root."""
    schema = f"source string, doc_id long, place long, leaf string, subroot string, root string, proof_sha256 string, n_siblings int, version array<{NODE}>"
    out = arrow_schema(leaves.sparkSession, schema)

    def prove(own: pa.Table, above: pa.Table) -> pa.Table:
        (rows, block, first), up = ordered(own), above.to_pylist()[0]
        rest = "".join(s["left"] + s["right"] for s in up["way"])
        found = []
        for r in rows:
            inner = "".join(left + right for left, right in block.siblings(r["place"] - first))
            row = {"source": r["source"], "doc_id": r["doc_id"], "place": r["place"], "leaf": r["digest"], "subroot": up["subroot"], "root": up["root"], "proof_sha256": digest([inner, rest]), "n_siblings": (len(inner) + len(rest)) // 64}
            if r["changed"] is not None:
                copied = block.replace(r["place"] - first, r["changed"])
                row["version"] = [{"level": k, "place": r["place"] // FANOUT**k, "digest": block.digests[c]} for k, c in enumerate(copied)]
                for above_it in up["way"]:
                    node = digest([above_it["left"], row["version"][-1]["digest"], above_it["right"]])
                    row["version"].append({"level": len(row["version"]), "place": above_it["place"], "digest": node})
            found.append(row)
        return pa.Table.from_pylist(found, schema=out)

    return joined(leaves.select("tree", "place", "nodes", "digest", "source", "doc_id", "changed"), upper).applyInArrow(prove, schema)


def every_fifth(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0


def check_rows(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and whether each row, every fifth of them tampered with, still leads to its root."""
    rows = manifest(docs, every_fifth(F.col("doc_id")))
    folded = F.coalesce(F.element_at("version", -1)["digest"], F.col("root"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def _sql() -> str:
    """The same rows as SQL over ``documents``, for sources of 16 ** 5 rows and as many sources at most."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    rest = " || ".join(map(said, ("doc_id", "source", "lang", "n_chars")))

    def levels(first: str, name: str, count: int) -> str:
        out = ""
        for k in range(count):
            at = first if k == 0 else f"{name}{k}"
            out += f"""
{name}_s{k} AS (SELECT tree, place, n,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {at}),
{name}{k + 1} AS (SELECT tree, place // 16 AS place, (any_value(n) + 15) // 16 AS n,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest FROM {at} GROUP BY tree, place // 16),"""
        return out

    def climb(first: str, name: str, sides: str, tree: str, place: str, count: int) -> str:
        out = ""
        for k in range(count):
            at = first if k == 0 else f"{name}{k - 1}"
            out += f"""
{name}{k} AS (SELECT u.* REPLACE (proof || l || r AS proof, CASE WHEN s.n > 1 THEN sha256(l || folded || r) ELSE folded END AS folded)
    FROM {at} u JOIN {sides}_s{k} s ON s.tree = u.{tree} AND s.place = u.{place} // {16**k}),"""
        return out

    return rf"""
WITH table_of AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hashed AS (SELECT doc_id, source, coalesce(':' || source, '-') AS tree, sha256({rest} || {said("text")}) AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d)::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0
      THEN sha256({rest} || {said("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM documents, table_of),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
a0 AS (SELECT tree, place, n, leaf AS digest FROM leaves),{levels("a0", "a", 5)}
b0 AS (SELECT '' AS tree, tree AS source_tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, digest FROM a5),{levels("b0", "b", 5)}
u AS (SELECT doc_id, leaf, l.tree, l.place, '' AS top, b0.place AS rank, b0.digest AS subroot, b5.digest AS root, changed IS NOT NULL AS tampered, '' AS proof, coalesce(changed, leaf) AS folded
    FROM leaves l JOIN b0 ON b0.source_tree = l.tree JOIN b5 ON true),{climb("u", "v", "a", "tree", "place", 5)}{climb("v4", "w", "b", "top", "rank", 5)}
done AS (SELECT * FROM w4)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM done
"""


CHECK_SQL = _sql()
