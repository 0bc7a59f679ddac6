"""Merkle manifest of a dataset: one digest over all rows, and a proof for each row.

Rows are leaves of their group's tree, whose nodes take runs of ``fan``
children; the groups' roots are leaves of one more tree. Trees are worked up
and down in supersteps over RDDs, as messages between a node and its parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, ASCII_UPPER, in_order, remainder_of_crc32, settled, stage_table

#: So many groups at most are broadcast; of more, those that hold one in so many
#: rows, which are fewer, and the join shuffles the rows of the others.
BROADCAST_GROUPS = 10_000
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree long, node long, n long, digest string"
_FAMILIES = "tree long, node long, n long, children array<string>"
#: One level of a path: the place of the node in its run, and the others of the run.
Step = tuple[int, list[str]]


def digest_of(parts: Iterable[str]) -> str:
    """Lowercase hexadecimal sha256 of texts, one after the other."""
    h = hashlib.sha256()
    for part in parts:
        h.update(part.encode())
    return h.hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 over the fields: ``-`` for null, else byte count, colon and value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: str, path: list[Step]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for slot, siblings in path:
        leaf = digest_of([*siblings[:slot], leaf, *siblings[slot:]])
    return leaf


def proof_digest(path: list[Step]) -> str:
    return digest_of(sibling for _, siblings in path for sibling in siblings)


def levels_of(most: int, fan: int) -> int:
    """Supersteps until a tree of ``most`` leaves has one node."""
    steps = 0
    while most > 1:
        most, steps = -(-most // fan), steps + 1
    return steps


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def send_up(nodes: DataFrame, steps: int, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """Upward supersteps: each node sends its digest to its parent; a parent that has all of its children hashes them and goes on.

    ``nodes`` has ``tree, node, n, digest``: nodes of a tree are numbered from
    0 to before n. Trees of one node send nothing more. Returns the families
    (a parent and its children's digests, in order) of every level, written as
    tables, so that a lost executor costs one superstep, and the last node of
    each tree. A parent gets ``fan`` messages at most.
    """
    spark, families, done = nodes.sparkSession, [], [nodes.where("n = 1")]
    level = nodes.where("n > 1")

    def message(row: T.Row) -> tuple:
        return (row.tree, row.node // fan), (row.n, row.node % fan, row.digest)

    def complete(item: tuple) -> tuple:
        (tree, parent), got = item
        inbox = sorted(got)
        n = inbox[0][0]
        if len(inbox) != min(fan, n - parent * fan):
            raise ValueError(f"node {parent} of tree {tree} has {len(inbox)} children")
        return tree, parent, -(-n // fan), [digest for _, _, digest in inbox]

    def forward(row: T.Row) -> tuple:
        return row.tree, row.node, row.n, digest_of(row.children)

    for _ in range(steps):
        inboxes = level.rdd.map(message).groupByKey(_partitions(nodes))
        family = stage_table(spark.createDataFrame(inboxes.map(complete), _FAMILIES, verifySchema=False), "families")
        families.append(family)
        hashed = spark.createDataFrame(family.rdd.map(forward), _NODES, verifySchema=False)
        done.append(hashed.where("n = 1"))
        level = hashed.where("n > 1")
    return families, stage_table(reduce(DataFrame.unionByName, done), "roots")


def send_down(families: list[DataFrame], known: RDD, fan: int) -> RDD:
    """Downward supersteps: each parent sends its children its path, with their siblings before it.

    ``families`` are those of ``send_up``, or its upper levels. ``known`` has
    ``((tree, 0), (path, note))`` for the last node of each tree; the result
    the same for the children of the lowest of ``families``, and for last nodes
    of trees that have no family there.
    """

    def to_children(item: tuple) -> Iterator[tuple]:
        (tree, parent), (children, paths) = item
        for path, note in paths:
            if not children:
                # The tree's last node lies on a lower level; the path waits.
                yield (tree, parent), (path, note)
            for kids in children:
                for slot in range(len(kids)):
                    yield (tree, parent * fan + slot), ([(slot, kids[:slot] + kids[slot + 1 :]), *path], note)

    for family in reversed(families):
        parents = family.rdd.map(lambda r: ((r.tree, r.node), r.children))
        known = parents.cogroup(known, _partitions(family)).mapValues(lambda both: tuple(map(list, both))).flatMap(to_children)
    return known


def _with_tree(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Rows with ``tree``, ``first`` and ``n`` of their group; the rows of no large group meet in one task."""

    def joined(part: DataFrame, of: DataFrame) -> DataFrame:
        return part.join(of.select(F.col(group).alias("_group"), "tree", "first", "n"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")

    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return joined(rows, F.broadcast(groups))
    large = F.col("n") * BROADCAST_GROUPS > F.lit(groups.agg(F.sum("n")).first()[0])
    names = F.broadcast(groups.where(large).select(F.col(group).alias("_large")))
    others = rows.join(names, F.col(group).eqNullSafe(F.col("_large")), "left_anti")
    return joined(rows, F.broadcast(groups.where(large))).unionByName(joined(others, groups.where(~large)))


def numbered_leaves(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """``id, leaf, shown, tree, node, n`` of ``id, grp, leaf, shown``; the number of groups and of the rows of the largest.

    Groups are numbered in ascending order, null first, and rows inside them by
    id, null first; equal ids by their digests.
    """
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    placed = in_order(leaves, order)
    sizes = stage_table(placed.groupBy("grp").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    many, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    groups = stage_table(in_order(sizes, [F.col("first")], "tree", rows=many), "trees")
    vertices = _with_tree(placed, groups, "grp").withColumn("node", F.col("place") - F.col("first"))
    return vertices.select("id", "leaf", "shown", "tree", "node", "n"), many, most


def merkle_manifest(
    documents: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "source",
    key: str = "doc_id",
    fan: int = FAN,
    shown: list[Column] | None = None,
    with_paths: bool = False,
) -> DataFrame:
    """Per row: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``, and ``path`` if asked for.

    A leaf is the digest of ``fields``. Leaves of a group ascend by ``key``;
    runs of ``fan`` become their digest, level by level, until one is left, the
    group's subroot. Groups, ascending and null first, are leaves of the root's
    tree. ``path`` has a row's siblings from its own run up to the root's, and
    its slot among them; ``proof_sha256`` is the digest of all of them.
    ``folded_root`` is what the path makes of the row as it is ``shown`` (the
    fields as a holder of the data has them now; else the row itself), and
    ``verified`` says whether that is the root.

    Null fields have a digest form of their own; null groups are a group, null
    keys come first. Rows that repeat a key are leaves of their own, ordered by
    digest. One row alone is its leaf, subroot and root. Very long texts are
    hashed by built-in functions and go no further. An empty table gives no
    rows. Other columns are ignored, whatever their names.

    Texts are read once and never shuffled. A superstep's shuffle is a
    ``fan``-th of the one below; paths are joined with leaves by runs, so one
    path is sent for ``fan`` rows. The driver gets numbers only.
    """
    own = leaf_digest([F.col(c) for c in fields])
    rows = documents.select(
        F.col(key).alias("id"), F.col(group).alias("grp"), own.alias("leaf"), (leaf_digest(shown) if shown else own).alias("shown")
    )
    spark = documents.sparkSession
    placed, many, most = numbered_leaves(stage_table(rows, "leaves"))
    vertices = stage_table(placed, "vertices")
    families, subroots = send_up(vertices.select("tree", "node", "n", F.col("leaf").alias("digest")), levels_of(most, fan), fan)
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), F.lit(many).cast("long").alias("n"), "digest")
    upper, roots = send_up(over, levels_of(many, fan), fan)

    at_root = roots.rdd.map(lambda r: ((0, 0), ([], r.digest)))
    by_group = send_down(upper, at_root, fan).map(lambda x: (x[0][1], x[1]))
    of_groups = subroots.rdd.map(lambda r: (r.tree, r.digest)).join(by_group, _partitions(documents))
    last_nodes = of_groups.map(lambda x: ((x[0], 0), (x[1][1][0], (x[1][0], x[1][1][1]))))
    known = send_down(families[1:], last_nodes, fan)
    runs = vertices.rdd.map(lambda r: ((r.tree, r.node // fan), (r.node % fan, r.n, r.id, r.leaf, r.shown)))

    def verify(item: tuple) -> Iterator[tuple]:
        _, (members, paths) = item
        # Ids are not compared: slots are distinct.
        run, (above, (subroot, root)) = sorted(members, key=lambda m: m[0]), next(iter(paths))
        digests = [leaf for _, _, _, leaf, _ in run]
        for slot, n, key_, leaf, seen in run:
            path = [(slot, digests[:slot] + digests[slot + 1 :]), *above] if n > 1 else above
            folded = fold(seen, path)
            yield key_, leaf, subroot, root, proof_digest(path), folded, folded == root, *([path] if with_paths else [])

    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("id", documents.schema[key].dataType), *[T.StructField(c, T.StringType()) for c in names], T.StructField("verified", T.BooleanType())])
    if with_paths:
        schema = schema.add("path", T._parse_datatype_string("array<struct<slot: int, siblings: array<string>>>"))
    return spark.createDataFrame(runs.cogroup(known, _partitions(documents)).flatMap(verify), schema, verifySchema=False)


def op13_query(documents: DataFrame) -> DataFrame:
    lowered = F.translate("text", ASCII_UPPER, ASCII_LOWER)
    held = F.when(remainder_of_crc32("doc_id", 5) == 0, lowered).otherwise(F.col("text"))
    manifest = settled(
        documents.sparkSession, "manifest", lambda: merkle_manifest(documents, shown=[F.col(c) for c in FIELDS[:-1]] + [held])
    )
    return manifest.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Trees of more leaves than 16 to this power have no SQL here.
_SQL_LEVELS = 6


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(({column})::VARCHAR))::VARCHAR || ':' || ({column})::VARCHAR END"


def _tree_sql(name: str, leaves: str) -> str:
    """Tables {name}_0, {name}_1, ... of nodes level by level, {name}_runs_k of children in lists, and the last nodes, {name}_last."""
    parts = [f"{name}_0 AS (SELECT tree, node, n, digest FROM {leaves})"]
    for k in range(_SQL_LEVELS):
        parts.append(f"{name}_runs_{k} AS (SELECT tree, node // 16 AS run, any_value(n) AS n, list(digest ORDER BY node) AS children FROM {name}_{k} GROUP BY ALL)")
        parts.append(
            f"{name}_{k + 1} AS (SELECT tree, run AS node, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN children[1] ELSE sha256(array_to_string(children, '')) END AS digest FROM {name}_runs_{k})"
        )
    return ", ".join([*parts, f"{name}_last AS (SELECT tree, digest FROM {name}_{_SQL_LEVELS})"])


def _climb_sql(source: str, name: str, tree: str, node: str, prefix: str) -> tuple[str, str]:
    """Tables that climb from each row of ``source`` to the top of its tree, with proof and folded digest so far."""
    parts = []
    for k in range(_SQL_LEVELS):
        slot = f"(s.{node} // {16**k} % 16)"
        parts.append(
            f"{prefix}_{k} AS (SELECT s.* REPLACE (CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(list_concat(r.children[1:{slot}], r.children[{slot} + 2:]), '') END AS proof, "
            f"CASE WHEN r.n = 1 THEN folded ELSE sha256(array_to_string(r.children[1:{slot}], '') || folded || array_to_string(r.children[{slot} + 2:], '')) END AS folded) "
            f"FROM {source} s JOIN {name}_runs_{k} r ON r.tree = s.{tree} AND r.run = s.{node} // {16 ** (k + 1)})"
        )
        source = f"{prefix}_{k}"
    return ", ".join(parts), source


_CLIMB, _TOP = _climb_sql("leaves", "low", "tree", "node", "climb")
_CLIMB_UP, _DONE = _climb_sql(_TOP, "high", "zero", "tree", "climb_up")
# The checksum's table follows from its polynomial.
OP13_SQL = f"""
WITH RECURSIVE crc_steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM crc_steps WHERE k = 8
), rows AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 0 THEN translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}') ELSE text END AS held
  FROM documents, crc_table
), hashed AS (
  SELECT doc_id, source, sha256({" || ".join(_field_sql(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_field_sql(c) for c in [*FIELDS[:-1], "held"])}) AS shown
  FROM rows
), leaves AS (
  SELECT doc_id, leaf, shown AS folded, leaf AS digest, '' AS proof, 0 AS zero, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), {_tree_sql("low", "leaves")}, groups AS (
  SELECT 0 AS tree, tree AS node, count(*) OVER () AS n, digest FROM low_last
), {_tree_sql("high", "groups")}, {_CLIMB}, {_CLIMB_UP}
SELECT d.doc_id, d.leaf, l.digest AS subroot, h.digest AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = h.digest AS verified
FROM {_DONE} d JOIN low_last l ON l.tree = d.tree JOIN high_last h ON true
"""
