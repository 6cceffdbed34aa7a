"""Merkle manifest of a document table: one root, one proof per row, and the check of changed rows against it.

Each language is a tree of arity eight over its rows in order of doc_id; the roots of the languages form one more tree.
A tree lives in aligned blocks of 512 nodes, three levels each. A block keeps every level as one hex string: parents
hash substrings of eight digests, the siblings of a node are the substrings to both sides of its own digest. The roots
of blocks are the nodes of the next round, so a tree over n rows takes log512(n) rounds and no task holds more than a
block, whatever language most rows have. Everything is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import read, stored

ARITY = 8
HEX = 64
#: Levels that one block climbs.
LEVELS = 3
BLOCK = ARITY**LEVELS
#: Characters of a whole run of siblings.
RUN = ARITY * HEX
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_STEPS = "cast(array() as array<struct<left: string, right: string>>)"


def leaf(values: list[Column]) -> Column:
    """Digest of a row: each value as its number of UTF-8 bytes, a colon and itself, or a dash if it is missing."""
    fields = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*fields), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with key and copies) repeated ``copies`` times each, with pos, the place in ``order`` within the key
    from 0 on, and n, the number of places of the key.

    Rows are range-partitioned by key and order; ranges are numbered apart and begin where the ranges before end.
    """
    ranged = stored(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("key", "part").agg(F.sum("copies").alias("size"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("key", "part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy("key")).alias("n"))
    before = Window.partitionBy("key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    placed = inside.join(stored(offsets, "offsets"), ["key", "part"]).withColumn("first", F.col("offset") + F.col("inside"))
    return placed.withColumn("pos", F.explode(F.expr("sequence(first, first + copies - 1)"))).drop("part", "copies", "offset", "inside", "first")


def _parents(level: str) -> Column:
    return F.expr(f"array_join(transform(sequence(0, (length({level}) - 1) div {RUN}), i -> sha2(substring({level}, int(i * {RUN} + 1), {RUN}), 256)), '')")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (key, pos, n, digest, payload) with their levels as strings; the last level is one digest.

    A tree of n nodes has more than one node, and so a level above, after k levels if n is over 8 ** k.
    """
    packed = nodes.groupBy("key", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "payload"))).alias("nodes"))
    packed = packed.withColumn("level0", F.expr("array_join(transform(nodes, x -> x.digest), '')"))
    for k in range(LEVELS):
        packed = packed.withColumn(f"level{k + 1}", F.when(F.col("n") > ARITY**k, _parents(f"level{k}")).otherwise(F.col(f"level{k}")))
    return packed


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks over nodes (key, pos, n, digest, payload), and the root of each key: key, digest."""
    rounds, roots = [], []
    while True:
        blocks = stored(_blocks(nodes), "blocks")
        rounds.append(blocks)
        top = F.col(f"level{LEVELS}").alias("digest")
        roots.append(blocks.where(f"n <= {BLOCK}").select("key", top))
        higher = blocks.where(f"n > {BLOCK}")
        if higher.isEmpty():
            return rounds, reduce(DataFrame.unionByName, roots)
        nodes = higher.select("key", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), top, F.lit(None).cast("string").alias("payload"))


def _siblings(k: int) -> Column:
    """What stands in a node's run at level ``k`` of its block to both sides of it; nothing above the root."""
    at = f"((pos % {BLOCK}) div {ARITY**k})"
    left = f"substring(level{k}, int({at} div {ARITY} * {RUN} + 1), int({at} % {ARITY} * {HEX}))"
    right = f"substring(level{k}, int(({at} + 1) * {HEX} + 1), int(({ARITY - 1} - {at} % {ARITY}) * {HEX}))"
    return F.when(F.col("n") > ARITY**k, F.expr(f"struct({left} as left, {right} as right)"))


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with their way to the root: key, pos, digest, payload, path and the other columns of
    ``above`` (key, path, ...), which is the way from each key's root on. A step of a path has what stands to the left
    and to the right of a node among its siblings, as one string each."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    extra = [c for c in above.columns if c not in ("key", "block", "path")]
    ways = None
    for blocks in reversed(rounds):
        finished = blocks.where(f"n <= {BLOCK}").select("key").distinct().join(above, "key").select("key", "block", "path", *extra)
        ways = finished if ways is None else finished.unionByName(ways.select("key", F.col("pos").alias("block"), "path", *extra))
        rows = blocks.join(ways, ["key", "block"]).withColumn("node", F.explode("nodes")).select("*", "node.*")
        steps = F.filter(F.array(*[_siblings(k) for k in range(LEVELS)]), lambda x: x.isNotNull())
        ways = rows.select("key", "pos", "digest", "payload", F.concat(steps, "path").alias("path"), *extra)
    return ways


def proof(path: str = "path") -> Column:
    """Digest of all siblings, from the leaf to the root, left to right."""
    return F.expr(f"sha2(array_join(transform({path}, s -> concat(s.left, s.right)), ''), 256)")


def folded(start: str, path: str = "path") -> Column:
    """The root that ``start`` and the siblings give."""
    return F.expr(f"aggregate({path}, {start}, (digest, s) -> sha2(concat(s.left, digest, s.right), 256))")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (of its language), root, proof_sha256, folded_root, verified.

    ``changed`` maps columns to what a later copy of the row holds there: folded_root is the root that the changed row and
    the siblings on record give, verified tells if it is the root. Rows of a language are ordered by doc_id (a missing
    one first), equal ids by leaf; repeated rows are a leaf each. A missing language is one of its own, before the
    others; an empty table has no rows and no root. Other columns are not read.
    """
    original = leaf([F.col(c) for c in FIELDS])
    later = leaf([(changed or {}).get(c, F.col(c)) for c in FIELDS])
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("key"), original.alias("digest"), later.alias("later"))
    leaves = numbered(rows.groupBy("key", "doc_id", "digest", "later").agg(F.count("*").alias("copies")), ["doc_id", "digest", "later"])
    rounds, subroots = tree(leaves.select("key", "pos", "n", "digest", F.struct("doc_id", "later").alias("payload")))
    subroots = stored(subroots, "subroots")
    named = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest", F.lit(1).cast("long").alias("copies")), ["name"])
    top, root = tree(named.select("key", "pos", "n", "digest", F.col("name").alias("payload")))
    above = paths(top, root.select("key", F.expr(_NO_STEPS).alias("path"), F.col("digest").alias("root")))
    above = stored(above.select(F.col("payload").alias("key"), "path", "root", F.col("digest").alias("subroot")), "above")
    found = paths(rounds, above).withColumn("folded_root", folded("payload.later"))
    return found.select("payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(third, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return manifest(read(spark, sf_dir, "documents"), {"text": text})


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
SQL: dict[str, str] = {
    "op11_merkle_manifest": """
with recursive crc as (
    select distinct doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
        lambda a, c: list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, (x % 2) * 3988292384))), 4294967295) % 3 = 0 as hit
    from documents where doc_id is not null
), docs as (
    select doc_id, source, lang, n_chars, text,
           case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as later
    from documents left join crc using (doc_id)
), heads as (
    select *, coalesce(strlen(cast(doc_id as varchar)) || ':' || cast(doc_id as varchar), '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') as head
    from docs
), leaves as (
    select row_number() over () as r, coalesce('+' || lang, '') as key, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
           sha256(head || coalesce(strlen(later) || ':' || later, '-')) as later
    from heads
), placed as (
    select *, row_number() over (partition by key order by doc_id nulls first, leaf, later) - 1 as pos, count(*) over (partition by key) as n from leaves
), nodes as (
    select key, 0 as level, pos, n, leaf as h from placed
    union all
    select key, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by key, level, pos // 8
), subroots as (
    select key, h as subroot, row_number() over (order by key) - 1 as pos, count(*) over () as n from nodes where n = 1
), tops as (
    select 0 as level, pos, n, subroot as h from subroots
    union all
    select level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 8
), every as (
    select key as t, level, pos, n, h from nodes union all select '~', level, pos, n, h from tops
), steps as (
    select t, level, run, hs, inner_one, case when inner_one then t else '~' end as t2, case when inner_one then level + 1 else 0 end as level2,
           case when inner_one then run else subroots.pos end as pos2
    from (select t, level, pos // 8 as run, list(h order by pos) as hs, any_value(n) > 8 or t = '~' as inner_one from every where n > 1 group by t, level, pos // 8)
    left join subroots on key = t
), climbed as (
    select r, case when placed.n > 1 then key else '~' end as t, 0 as level, case when placed.n > 1 then placed.pos else subroots.pos end as pos, later as h, '' as proof
    from placed join subroots using (key)
    union all
    select r, t2, level2, pos2, sha256(array_to_string(hs[1:pos % 8], '') || h || array_to_string(hs[pos % 8 + 2:], '')),
           proof || array_to_string(hs[1:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
    from climbed join steps using (t, level) where run = pos // 8
)
select doc_id, leaf, subroot, tops.h as root, sha256(proof) as proof_sha256, climbed.h as folded_root, climbed.h = tops.h as verified
from climbed join placed using (r) join subroots using (key) cross join tops
where t = '~' and climbed.level = (select max(level) from tops) and tops.n = 1
"""
}
