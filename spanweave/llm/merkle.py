"""Merkle manifest of a dataset: a digest for each row, a subroot for each group, one root, and a proof for each row.

A group's digests ascend by an order column; every FAN_OUT consecutive ones become their digest until one
remains. Groups' subroots, ordered by group, give the root in the same way.

Levels are kept as strings. A block is an aligned run of FAN_OUT**LEVELS nodes, so whole levels lie inside it:
its level is one string of hex digests, the parents are the digests of the string's fixed-width substrings, and
a row's siblings are the substrings that flank its own. Blocks are built in parallel, whatever the size of a
group; their top nodes are the next, far smaller tree, and so on. Proofs go back down the same way: a block
gets the path of its top node by one join, and hands it on to its nodes. Only digests are moved, texts are
read once.

Positions come from a range sort over all groups and counts per (group, range), so no task sees a whole group.

Defined cases: a null group is a group of its own, the first; a null in any field is `-`; a null order value
comes first; rows that agree in the order value are ordered by digest, and equal rows are interchangeable; an
empty table gives no rows; one group's subroot is the root, one row's leaf its subroot; other columns of the
input are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, stored

FAN_OUT = 3
#: Levels that a block holds: 243 nodes.
LEVELS = 5
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row's place in its partition, in the lower bits of monotonically_increasing_id.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a path of siblings give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with key) and their place `at` from 0 among the `n` rows of their key, ascending by order, nulls first."""
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged = stored(ranged.withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", ROW_BITS)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    counts = ranged.groupBy("key", "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    upto, whole = Window.partitionBy("key").orderBy("_range"), Window.partitionBy("key")
    starts = counts.select("key", "_range", "_first", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"), F.sum("_n").over(whole).alias("n"))
    return ranged.join(stored(starts), ["key", "_range"]).select(*rows.columns, (F.col("_start") + F.col("_row") - F.col("_first")).alias("at"), "n")


def _parents(level: Column) -> Column:
    width = FAN_OUT * DIGEST
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda run: F.sha2(F.substring(level, run * width + 1, F.lit(width)), 256)), "")


def _goes_on(n: Column, level: Column) -> Column:
    """A tree of n nodes has more than one of them at this level."""
    return n > F.pow(F.lit(FAN_OUT), level)


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """key, n, block, levels (strings of digests, the block's nodes first), items (the carried columns of its nodes)."""
    items = F.sort_array(F.collect_list(F.struct("at", "digest", *carried)))
    grouped = nodes.groupBy("key", "n", F.expr(f"at div {FAN_OUT**LEVELS}").alias("block")).agg(items.alias("items"))
    first = F.array_join(F.transform("items", lambda x: x["digest"]), "")
    up = lambda done, level: F.when(_goes_on(F.col("n"), level), _parents(F.element_at(done, -1))).otherwise(F.element_at(done, -1))
    levels = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.array(first), lambda done, level: F.concat(done, F.array(up(done, level))))
    kept = F.transform("items", lambda x: F.struct(x["at"].alias("at"), *[x[c].alias(c) for c in carried]))
    return stored(grouped.select("key", "n", "block", levels.alias("levels"), kept.alias("items")))


def tree(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all steps of the trees over nodes (key, at, n, digest, carried), and each key's root: key, digest.

    A step takes LEVELS levels at a time, so there are as many as the depth over LEVELS.
    """
    steps = []
    while True:
        steps.append(blocks(nodes, [] if steps else carried))
        nodes = steps[-1].select("key", F.col("block").alias("at"), F.ceil(F.col("n") / FAN_OUT**LEVELS).alias("n"), F.element_at("levels", -1).alias("digest"))
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return steps, nodes.select("key", "digest")


def _path_in_block(i: Column) -> Column:
    """The siblings of node i of a block, level by level."""

    def flanks(level: Column) -> Column:
        at = (i / F.pow(F.lit(FAN_OUT), level)).cast("int")
        run = at - at % FAN_OUT
        string = F.get("levels", level)
        before = F.substring(string, run * DIGEST + 1, (at - run) * DIGEST)
        after = F.substring(string, (at + 1) * DIGEST + 1, (run + FAN_OUT - 1 - at) * DIGEST)
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: _goes_on(F.col("n"), level)), flanks)


def paths(steps: list[DataFrame], carried: list[str], above: DataFrame) -> DataFrame:
    """key, at, digest, the carried columns and path of every node. above: key, path and other columns of each key's root, which are handed down."""
    more = [c for c in above.columns if c not in ("key", "path")]
    above = above.withColumn("at", F.lit(0).cast("long"))
    for k in range(len(steps) - 1, -1, -1):
        held = [] if k else carried
        joined = steps[k].join(above.withColumnRenamed("at", "block"), ["key", "block"])
        node = lambda i: F.struct(
            *[F.get("items", i)[c].alias(c) for c in ("at", *held)], F.substring(F.get("levels", F.lit(0)), i * DIGEST + 1, F.lit(DIGEST)).alias("digest"), _path_in_block(i).alias("inside")
        )
        each = F.transform(F.sequence(F.lit(0), F.size("items") - 1), node)
        rows = joined.select("key", F.explode(each).alias("_node"), F.col("path").alias("_above"), *more)
        above = rows.select("key", *[F.col(f"_node.{c}").alias(c) for c in ("at", "digest", *held)], F.concat("_node.inside", "_above").alias("path"), *more)
    return above


def manifest(leaves: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """leaves (group, order column, digest, carried columns) with subroot, root and path, the siblings from leaf to root.

    `order` is one of the carried columns.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
    rows = stored(leaves.select(key.alias("key"), "digest", *carried))
    steps, subroots = tree(numbered(rows, [order, "digest"]), carried)
    tops = subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    top_steps, roots = tree(numbered(tops, ["group", "digest"]), ["group"])
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    over = paths(top_steps, ["group"], roots.select("key", no_path.alias("path"), F.col("digest").alias("root")))
    over = stored(over.select(F.col("group").alias("key"), "path", F.col("digest").alias("subroot"), "root"))
    return paths(steps, carried, over)


def manifest_of_documents(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", **alike: Column) -> DataFrame:
    """manifest over the fields of docs. alike: further columns to carry along, such as a leaf of changed rows."""
    columns = [docs[f"`{c}`"] for c in fields]
    leaves = docs.select(docs[f"`{group}`"].alias("group"), docs[f"`{order}`"].alias(order), leaf(*columns).alias("digest"), *[c.alias(n) for n, c in alike.items()])
    return manifest(leaves, order, [order, *alike])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    stripped = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = manifest_of_documents(docs, tampered=F.when(even, leaf(*stripped)))
    folded = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_CRC_BYTE = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)"

OP12_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_LEAF} AS leaf, {_LEAF.replace("text::", "replace(text, chr(10), '')::")} AS stripped,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {_CRC_BYTE}), 4294967295::BIGINT) AS crc
  FROM documents
), leaves AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN stripped ELSE leaf END AS shown, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM rows
), nodes AS (
  SELECT k, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT k, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY k, level, pos // 3, n
), subroots AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place AS pos, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n
), runs AS (
  SELECT k, level, pos // 3 AS run, list(h ORDER BY pos) AS l FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS l FROM tops WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT r.k, r.pos, g.level AS step, g.l, (r.pos // (3 ** g.level)::BIGINT) % 3 AS i FROM leaves r JOIN runs g ON g.k = r.k AND g.run = r.pos // (3 ** (g.level + 1))::BIGINT
  UNION ALL
  SELECT r.k, r.pos, 1000 + g.level, g.l, (s.place // (3 ** g.level)::BIGINT) % 3 FROM leaves r JOIN subroots s USING (k) JOIN top_runs g ON g.run = s.place // (3 ** (g.level + 1))::BIGINT
), proofs AS (
  SELECT k, pos, list({{'a': array_to_string(l[:i], ''), 'b': array_to_string(l[i + 2:], ''), 'h': ''}} ORDER BY step) AS path FROM steps GROUP BY ALL
), folded AS (
  SELECT r.doc_id, r.leaf, s.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda p: p.a || p.b), '')) AS proof_sha256,
    list_reduce(list_prepend({{'a': '', 'b': '', 'h': r.shown}}, coalesce(path, [])), lambda x, p: {{'a': '', 'b': '', 'h': sha256(p.a || x.h || p.b)}}).h AS folded_root
  FROM leaves r JOIN subroots s USING (k) LEFT JOIN proofs p ON p.k = r.k AND p.pos = r.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""
