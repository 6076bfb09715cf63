"""A Merkle manifest of a dataset: eight-way trees per language under one root.

Leaves are numbered per group by a range sort. Every aligned block of ``BLOCK`` nodes
keeps each of its levels as one string of hex digests; SQL cuts fixed-width pieces of
eight digests out of it and hashes them to the next level. What a block comes to is a
node of the next round, until each group has one node, its subroot; the subroots form
a tree of their own. Coming down again, a node hands its children what lies before and
after them in their runs, so a document's proof is these pieces, level by level.

Built-in functions only. Rows of one round shuffle digests, never texts; a block is a
bounded group; the number of rounds is the logarithm of the largest group to base 512.

Defined cases: null fields are ``-``; null languages and null doc_ids come first;
rows of equal doc_id are ordered by their leaf; rows equal in both are leaves side by
side; a null doc_id is never tampered with; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import written

WIDTH, ARITY, DEPTH = 64, 8, 3
BLOCK = ARITY**DEPTH
RUN = WIDTH * ARITY
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value."""
    raw = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(raw).cast("string"), F.lit(":"), raw), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(lang, doc_id, leaf, changed): ``changed`` is the leaf of a document whose text is lower-cased where ``tampered`` holds."""
    others = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    changed = F.when(tampered & text.isNotNull(), hashed(*others, field(F.translate(text, UPPER, LOWER))))
    leaf = hashed(*others, field(text))
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), changed.alias("changed"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``at``, their place within the group from 0, and ``nodes``, the group's size; no window over rows.

    After a range sort the row number in a task grows along the order, so a place is
    the distance to the group's first row in the task plus the group's rows in earlier
    tasks. Tasks and groups are pairs in sorted order, so there are few of them.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    sorted_rows = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "merkle-sorted")
    task = F.shiftright("_row", 33)
    parts = sorted_rows.groupBy(group, task.alias("_task")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    listed = parts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_task", "_first", "_rows"))).alias("_parts"), F.sum("_rows").alias("nodes"))
    start = F.aggregate(F.slice("_parts", 1, F.col("_place")), F.lit(0).cast("long"), lambda total, part: total + part["_rows"])
    starts = listed.select(group, "nodes", "_parts", F.posexplode("_parts").alias("_place", "_part")).select(
        F.col(group).alias("_group"), "nodes", F.col("_part._task").alias("_task"), (start - F.col("_part._first")).alias("_shift")
    )
    joined = sorted_rows.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (task == F.col("_task")))
    return joined.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("at"), "nodes")


def piece(level: Column, start: Column, length: Column) -> Column:
    """Digests of a level from number ``start`` on; levels are binary, where a place is found without counting characters."""
    return F.substring(level, (start * WIDTH + 1).cast("int"), (length * WIDTH).cast("int"))


def parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / RUN).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda r: F.sha2(piece(level, r * ARITY, F.lit(ARITY)), 256)), "").cast("binary")


def depth(nodes: Column) -> Column:
    """Levels that a round adds above ``nodes`` nodes of a group: none above a single one, ``DEPTH`` at most."""
    chain = F
    for d in range(DEPTH):
        chain = chain.when(nodes <= ARITY**d, d)
    return chain.otherwise(DEPTH)


def flanks(levels: Column, place: Column) -> Column:
    """What lies before and after a node in its run, level by level."""

    def beside(level: Column, height: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(ARITY)), height)).cast("long")
        first = own - F.pmod(own, F.lit(ARITY).cast("long"))
        return F.struct(piece(level, first, own - first).alias("before"), piece(level, own + 1, first + ARITY - own - 1).alias("after"))

    # the topmost level is the node that goes up
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def blocks(nodes: DataFrame, group: str, *payload: str) -> DataFrame:
    """One round: (group, block, members, levels, nodes) of rows (group, at, nodes, digest and the payload)."""
    member = F.struct("at", "digest", *payload)
    listed = nodes.groupBy(group, F.floor(F.col("at") / BLOCK).alias("block"), "nodes").agg(F.sort_array(F.collect_list(member)).alias("members"))
    first = F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary")
    higher = F.sequence(F.lit(1), depth(F.col("nodes")))
    levels = F.when(F.col("nodes") == 1, F.array(first)).otherwise(
        F.aggregate(higher, F.array(first), lambda known, _: F.concat(known, F.array(parents(F.element_at(known, -1)))))
    )
    return written(listed.withColumn("levels", levels), "merkle-blocks")


def rising(nodes: DataFrame, group: str, *payload: str) -> list[DataFrame]:
    """All rounds of a forest, from its leaves to one node per group."""
    rounds = [blocks(nodes, group, *payload)]
    while rounds[-1].agg(F.max("nodes")).first()[0] or 0:
        last = rounds[-1]
        if last.where(F.col("nodes") > BLOCK).isEmpty():
            break
        count = F.ceil(F.col("nodes") / BLOCK)
        rounds.append(blocks(last.select(group, F.col("block").alias("at"), count.alias("nodes"), top().alias("digest")), group))
    return rounds


def top() -> Column:
    return F.element_at("levels", -1).cast("string")


def descending(rounds: list[DataFrame], group: str, paths: DataFrame) -> DataFrame:
    """Blocks of the lowest round with the path above them; ``paths`` has (group, path and more) above each group's last node."""
    more = [c for c in paths.columns if c not in (group, "path")]
    above = paths.withColumn("block", F.lit(0).cast("long"))
    for height in range(len(rounds) - 1, -1, -1):
        level = rounds[height].alias("b").join(above.alias("p"), F.col(f"b.{group}").eqNullSafe(F.col(f"p.{group}")) & (F.col("b.block") == F.col("p.block")))
        level = level.select("b.*", "p.path", *[f"p.{c}" for c in more])
        if not height:
            return level
        child = F.transform("members", lambda m: F.struct(m["at"].alias("block"), F.concat(flanks(F.col("levels"), F.pmod(m["at"], F.lit(BLOCK).cast("long"))), F.col("path")).alias("path")))
        above = written(level.select(group, *more, F.explode(child).alias("c")).select(group, *more, "c.block", "c.path"), "merkle-paths")
    raise ValueError("no rounds")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings come to."""
    return F.aggregate(path, node, lambda at, run: F.sha2(F.concat(run["before"], at.cast("binary"), run["after"]), 256))


def proof(path: Column) -> Column:
    empty = F.lit("").cast("binary")
    return F.aggregate(path, empty, lambda known, run: F.concat(known, run["before"], run["after"]))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest's row per document, with the root folded again where ``tampered`` holds."""
    known = written(leaves(docs, tampered), "merkle-leaves")
    nodes = numbered(known, "lang", "doc_id", "leaf", "changed").withColumn("digest", F.col("leaf"))
    trees = rising(nodes, "lang", "doc_id", "changed")
    subroots = trees[-1].select("lang", top().alias("digest"), F.lit(True).alias("_all"))
    forest = rising(numbered(subroots, "_all", "lang", "digest"), "_all", "lang")
    root = forest[-1].select("_all", F.array().cast("array<struct<before: binary, after: binary>>").alias("path"), top().alias("root"))
    lowest = descending(forest, "_all", root)

    def subroot(m: Column) -> Column:
        return F.struct(m["lang"].alias("lang"), m["digest"].alias("subroot"), F.concat(flanks(F.col("levels"), F.pmod(m["at"], F.lit(BLOCK).cast("long"))), F.col("path")).alias("path"))

    paths = written(lowest.select("root", F.explode(F.transform("members", subroot)).alias("c")).select("root", "c.*"), "merkle-paths")

    def row(m: Column) -> Column:
        path = F.concat(flanks(F.col("levels"), F.pmod(m["at"], F.lit(BLOCK).cast("long"))), F.col("path"))
        # bound once, as the path serves both
        return F.transform(
            F.array(path),
            lambda p: F.struct(
                m["doc_id"].alias("doc_id"), m["digest"].alias("leaf"), F.sha2(proof(p), 256).alias("proof_sha256"),
                fold(F.coalesce(m["changed"], m["digest"]), p).alias("folded_root"),
            ),
        )[0]

    rows = descending(trees, "lang", paths).select("subroot", "root", F.explode(F.transform("members", row)).alias("r"))
    done = rows.select("r.doc_id", "r.leaf", "subroot", "root", "r.proof_sha256", "r.folded_root")
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_third() -> Column:
    """Where 3 divides the CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, length(d) + 1), lambda i: ascii(substr(d, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""
_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_CUT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_FIELDS} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN text IS NOT NULL AND xor({CRC}, 4294967295) % 3 = 0 THEN sha256({_FIELDS} || strlen({_CUT}) || ':' || {_CUT}) END AS changed
  FROM (SELECT *, doc_id::VARCHAR AS d FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
tree(g, lvl, pos, node, nodes) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM placed
  UNION ALL
  SELECT g, any_value(lvl) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(nodes) + 7) // 8 FROM tree WHERE nodes > 1 GROUP BY g, pos // 8),
subroots AS (SELECT g, lvl AS height, node FROM tree WHERE nodes = 1),
forest(lvl, pos, node, nodes) AS (
  SELECT 0, g, node, count(*) OVER () FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(nodes) + 7) // 8 FROM forest WHERE nodes > 1 GROUP BY pos // 8),
sides AS (
  SELECT p.g, p.pos, s.lvl, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < p.pos // s.w), '') AS before, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > p.pos // s.w), '') AS after
  FROM placed p JOIN (SELECT g, unnest(range(height)) AS lvl, (8 ** unnest(range(height)))::BIGINT AS w FROM subroots) s ON s.g = p.g
    JOIN tree t ON t.g = p.g AND t.lvl = s.lvl AND t.pos // 8 = p.pos // (s.w * 8) GROUP BY p.g, p.pos, s.lvl
  UNION ALL
  SELECT p.g, p.pos, r.height + s.lvl, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < p.g // s.w), ''), coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > p.g // s.w), '')
  FROM placed p JOIN subroots r ON r.g = p.g
    CROSS JOIN (SELECT unnest(range(m)) AS lvl, (8 ** unnest(range(m)))::BIGINT AS w FROM (SELECT max(lvl) AS m FROM forest)) s
    JOIN forest t ON t.lvl = s.lvl AND t.pos // 8 = p.g // (s.w * 8) GROUP BY p.g, p.pos, r.height + s.lvl),
folded(g, pos, lvl, node) AS (
  SELECT g, pos, 0, coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT f.g, f.pos, (f.lvl + 1)::INT, sha256(s.before || f.node || s.after) FROM folded f JOIN sides s ON s.g = f.g AND s.pos = f.pos AND s.lvl = f.lvl),
proofs AS (SELECT g, pos, string_agg(before || after, '' ORDER BY lvl) AS proof, count(*) AS n FROM sides GROUP BY ALL)
SELECT p.doc_id, p.leaf, r.node AS subroot, top.node AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = top.node AS verified
FROM placed p JOIN subroots r ON r.g = p.g CROSS JOIN (SELECT node FROM forest WHERE nodes = 1) top LEFT JOIN proofs q ON q.g = p.g AND q.pos = p.pos
  JOIN folded f ON f.g = p.g AND f.pos = p.pos AND f.lvl = coalesce(q.n, 0)
"""


@query("op12_merkle_manifest", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), every_third())
