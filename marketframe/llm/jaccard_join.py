"""Groups of texts whose sets of word shingles are similar, by vertical partitioning of the shingles' global order.

1. Texts with equal sets are one node.
2. A node can only link if enough of the first shingles of its set, in order of their hashes, occur in the first shingles
   of another node; the others are alone and leave.
3. The shingles of the rest are put into one global order, rare ones first, and cut into fragments of about equal size. A
   node becomes one segment per fragment. Shingles of one node only are counted, not kept.
4. Two nodes that link share a shingle of their prefixes in this order. Nodes with a common prefix shingle meet their hub,
   the node among them that misses the fewest shared shingles. Each fragment counts the common shingles of the hub's
   segment with the others' segments separately, the counts are summed per pair, and the links give components.
5. Where the nodes around a hub still are of several components, only pairs across components can change anything: nodes
   are dealt to blocks by component, and pairs of blocks are counted in the same way, fragment by fragment, with the
   counts of a pair of blocks as one matrix. Pairs are never rows; what leaves the blocks are links.

Step 5 works within the neighbours of one hub, never within all that a chain of links reaches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import chunks, discard, read, stored, utf8
from marketframe.llm.lm_score import pack_sorted, unpack_sorted
from marketframe.llm.simhash import components
from marketframe.llm.suffix_dedup import identity
from marketframe.llm.tokens import MULTIPLIER, grams, mix, word_bytes, words

#: Parts of the global order that are counted separately.
FRAGMENTS = 8
#: Nodes of one side of a pair of blocks.
BLOCK = 256
#: First shingles that a slice of texts packs together, those in one range of shingles, and the rows of one range of nodes.
SLICE_TOKENS = 250_000
RANGE_TOKENS = 500_000
RANGE_NODES = 200_000


class Rule(NamedTuple):
    """Sets of shingles of ``words`` words link if ``over * intersection >= under * union``."""

    words: int
    under: int
    over: int

    def least(self, size):
        """Common shingles that a set of this size needs to link with any."""
        return -(-self.under * size // self.over)

    def linked(self, common, size_a, size_b):
        return self.over * common >= self.under * (size_a + size_b - common)


RULE = Rule(4, 85, 100)


def shingles(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text in turn, ascending, and their numbers. A shorter text is one."""
    w = words(texts, word_bytes("black"))
    code, inside = grams(w, length)
    owner, code = w.owner[: len(code)][inside], code[inside]
    counts = np.bincount(w.owner, minlength=len(texts))
    begins = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        whole = w.hash[begins[short]]
        for k in range(1, length):
            more = counts[short] > k
            whole[more] = mix(whole[more] * MULTIPLIER + w.hash[begins[short[more]] + k])
        owner, code = np.concatenate([owner, short]), np.concatenate([code, whole])
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return code[fresh], np.bincount(owner[fresh], minlength=len(texts))


def nodes_of(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A digest of each set; an empty one has zero."""
    raw, ends = code.tobytes(), 8 * np.cumsum(sizes)
    found = [int.from_bytes(hashlib.md5(raw[end - 8 * size : end]).digest()[:8], "little", signed=True) if size else 0 for size, end in zip(sizes.tolist(), ends.tolist())]
    return np.array(found, np.int64)


def _marks(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            code, sizes = shingles(texts, rule.words)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in range(3)), pa.array(nodes_of(code, sizes)), pa.array(sizes, pa.int64())], names=["doc_id", "one", "two", "node", "size"])

    return run


def first_needed(rule: Rule, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of first shingles, how many of them must occur among the first ones of others) for sets of these sizes.

    Of two linked sets, a and b, at most ``size - least`` shingles of either are not common. So of the first
    ``size - least + more`` ones of each the common ones number min(more_a, more_b) at least, if sets have so many; as
    no linked set is smaller than ``least(size)``, ``more(least(size))`` is a bound.
    """
    more = np.maximum(sizes // 10, 1)
    smallest = rule.least(sizes)
    return np.minimum(sizes - smallest + more, sizes), np.maximum(smallest // 10, 1)


def _first(rule: Rule, parts: int):
    """The first shingles of the sets in a slice of texts with their nodes: for each of ``parts`` ranges of the scrambled
    shingles one row (part, tokens, nodes), sorted and packed. A task passes a set on again only after many others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
        written: set[int] = set()
        tokens, owners = [], []

        def out() -> pa.RecordBatch:
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            cuts = np.append(np.searchsorted(token, bounds), len(token))
            some = np.flatnonzero(np.diff(cuts))
            packed = [pack_sorted(token[cuts[p] : cuts[p + 1]]) for p in some], [owner[cuts[p] : cuts[p + 1]].tobytes() for p in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "tokens", "nodes"])

        for _, texts in chunks(batches):
            code, sizes = shingles(texts, rule.words)
            nodes = nodes_of(code, sizes)
            wanted, _ = first_needed(rule, sizes)
            for i, node in enumerate(nodes.tolist()):
                if node in written:
                    wanted[i] = 0
                written.add(node)
            if len(written) > 200_000:
                written.clear()
            begins = np.cumsum(sizes) - sizes
            keep = np.arange(len(code)) - np.repeat(begins, sizes) < np.repeat(wanted, sizes)
            # first ones are small numbers: scrambled they fall evenly into the ranges
            tokens.append(mix(code[keep] ^ MULTIPLIER))
            owners.append(np.repeat(nodes, sizes)[keep])
            if sum(map(len, tokens)) >= SLICE_TOKENS:
                yield out()
                tokens, owners = [], []
        if tokens:
            yield out()

    return run


def _met(ranges: int):
    """Of one range of shingles: how many of each node's first ones are among those of another node, packed into one row
    (range, nodes, counts) for each of ``ranges`` ranges of nodes."""

    def run(asked: pa.Table) -> pa.Table:
        bounds = np.array([(p << 64) // ranges for p in range(ranges)], np.uint64)
        token = np.concatenate([unpack_sorted(t.as_py()) for t in asked.column("tokens")])
        node = np.concatenate([np.frombuffer(n.as_py(), np.uint64) for n in asked.column("nodes")])
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        different = new.copy()
        different[1:] |= node[1:] != node[:-1]
        node, new = node[different], new[different]
        number = np.cumsum(new) - 1
        found, met = np.unique(node[np.bincount(number)[number] > 1], return_counts=True)
        cuts = np.append(np.searchsorted(found, bounds), len(found))
        some = np.flatnonzero(np.diff(cuts))
        packed = [found[cuts[p] : cuts[p + 1]].tobytes() for p in some], [met[cuts[p] : cuts[p + 1]].tobytes() for p in some]
        return pa.table({"range": pa.array(some, pa.int64()), "nodes": pa.array(packed[0], pa.binary()), "counts": pa.array(packed[1], pa.binary())})

    return run


def _met_in_all(part: pa.Table) -> pa.Table:
    """Sums of ``_met`` over all ranges of shingles: node, met."""
    nodes, counts = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in part.column(c)]) for c in ("nodes", "counts"))
    node, where = np.unique(nodes, return_inverse=True)
    return pa.table({"node": node, "met": np.bincount(where, weights=counts).astype(np.int64)})


def _tokens(rule: Rule):
    """All shingles of each node: rows (node, size, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            code, sizes = shingles(texts, rule.words)
            node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(sizes, sizes)), pa.array(code.view(np.int64))], names=["node", "size", "token"])

    return run


def _runs(cell: np.ndarray, fragment: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal (cell, fragment), and the end."""
    return np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]) | (fragment[1:] != fragment[:-1])) + 1, [len(cell)]])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of each array on the left with each on the right."""
    tokens = np.concatenate([*left, *right]) if left or right else np.empty(0, np.int64)
    value, number = np.unique(tokens, return_inverse=True)
    cut = sum(map(len, left))
    rows_l = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_r = np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.bincount(number[:cut], minlength=len(value)).astype(bool) & np.bincount(number[cut:], minlength=len(value)).astype(bool)
    place = np.cumsum(both) - 1
    out = np.zeros((len(left), len(right)), np.int32)
    in_l, in_r = both[number[:cut]], both[number[cut:]]
    rows_l, cols_l = rows_l[in_l], place[number[:cut][in_l]]
    rows_r, cols_r = rows_r[in_r], place[number[cut:][in_r]]
    width = min(4096, int(both.sum()))
    for at in range(0, int(both.sum()), 4096):  # products stay below 2 ** 24 and are exact
        dense_l, dense_r = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        part_l, part_r = (cols_l >= at) & (cols_l < at + width), (cols_r >= at) & (cols_r < at + width)
        dense_l[rows_l[part_l], cols_l[part_l] - at] = 1
        dense_r[rows_r[part_r], cols_r[part_r] - at] = 1
        out += (dense_l @ dense_r.T).astype(np.int32)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one fragment: for each group of rows (cell, fragment, side, node, tokens), sorted by all but the
    tokens, one row (cell, counts), the matrix of the nodes of side 0 by those of side 1 in order of node.

    Every node has a row in each fragment of its cell, an empty one where it has no tokens there.
    """
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    cells, counts = [], []

    def work(rows: pa.RecordBatch) -> None:
        cell = rows.column(0).to_numpy(zero_copy_only=False)
        side = rows.column(2).to_numpy(zero_copy_only=False)
        fragment = rows.column(1).to_numpy(zero_copy_only=False)
        tokens = [np.frombuffer(t.as_buffer(), np.int64) for t in rows.column(4)]
        cuts = _runs(cell, fragment)
        for a, b in zip(cuts[:-1], cuts[1:]):
            middle = a + int((side[a:b] == 0).sum())
            matrix = common_counts(tokens[a:middle], tokens[middle:b])
            if matrix.any():
                cells.append(int(cell[a]))
                counts.append(pack(matrix.tobytes()))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.binary())], names=["cell", "counts"])
        cells.clear()
        counts.clear()
        return batch

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        cell, fragment = (held.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        last = int(_runs(cell, fragment)[-2])
        if last:
            work(held.slice(0, last))
            held = held.slice(last)
            yield out()
    if held is not None:
        work(held)
        yield out()


def _sum(rule: Rule):
    """Links of a pair of blocks: sums its matrices over the fragments and compares with the sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            a, b = [], []
            for counts, left, right in zip(*(batch.column(i) for i in range(3))):
                left, right = left.values, right.values
                nodes_a, sizes_a = (left.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                nodes_b, sizes_b = (right.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                total = np.zeros((len(nodes_a), len(nodes_b)), np.int64)
                for part in counts.values:
                    total += np.frombuffer(unpack(part.as_py()), np.int32).reshape(total.shape)
                rows, columns = np.nonzero(rule.linked(total, sizes_a[:, None], sizes_b[None, :]) & (total > 0))
                a.append(nodes_a[rows])
                b.append(nodes_b[columns])
            none = [np.empty(0, np.int64)]
            a, b = np.concatenate(a or none), np.concatenate(b or none)
            far = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[far]), pa.array(b[far])], names=["a", "b"])

    return run


def _links(cells: DataFrame, segments: DataFrame, rule: Rule) -> DataFrame:
    """Links between the sides of each cell: rows (cell, side, node) in, rows (a, b) out."""
    cells = stored(cells.select("cell", "side", "node").distinct(), "cells")
    rows = cells.join(segments, "node").select("cell", "fragment", "side", "node", "size", "tokens")
    rows = rows.select("cell", "fragment", "side", "node", "tokens").repartition("cell", "fragment").sortWithinPartitions("cell", "fragment", "side", "node")
    partial = rows.mapInArrow(_count, "cell long, counts binary").groupBy("cell").agg(F.collect_list("counts").alias("counts"))
    sizes = segments.where("fragment = 0").select("node", "size")
    members = F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.struct("node", "size")))), F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.struct("node", "size"))))
    sides = cells.join(sizes, "node").groupBy("cell").agg(members[0].alias("left"), members[1].alias("right"))
    return stored(partial.join(sides, "cell").select("counts", "left", "right").mapInArrow(_sum(rule), "a long, b long").distinct(), "links")


def _segments(texts: DataFrame, alive: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(segments: node, size, fragment, tokens in global order as bytes; prefixes: token, node, size, lacking).

    ``alive`` has node and the digests of one text of it. ``lacking`` counts the shingles that no other node has.
    """
    folded = texts.groupBy("one", "two").agg(F.first("text").alias("text"))
    rows = stored(folded.join(alive, ["one", "two"]).select("node", "text").mapInArrow(_tokens(rule), "node long, size long, token long"), "tokens")
    # frequencies are stored before they are joined: only a join of two plain shuffles can split a frequent token
    frequency = stored(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    # rare tokens first, equally frequent ones by hash; the places of whole tokens are what fragments are cut by
    place = (F.log2("df") * 1_000_000).cast("long") * 1024 + F.pmod("token", F.lit(1024))
    shared = stored(rows.join(frequency, "token").select("node", "size", place.alias("place"), "token"), "shared")
    listed = shared.groupBy("node").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("shared"))
    listed = listed.where(F.size("shared") * rule.over >= F.col("size") * rule.under)
    listed = stored(listed, "listed")
    spread = [n / FRAGMENTS for n in range(1, FRAGMENTS)]
    cuts = shared.agg(F.percentile_approx("place", spread, 1000).alias("cuts")).first().cuts or []
    edges = [None, *sorted(set(cuts)), None]

    def piece(low: int | None, high: int | None):
        whole = F.lit(True)
        inside = F.filter("shared", lambda x: (whole if low is None else x.place > low) & (whole if high is None else x.place <= high))
        return F.transform(inside, lambda x: x.token)

    pieces = F.array(*[piece(low, high) for low, high in zip(edges[:-1], edges[1:])])
    split = listed.select("node", "size", F.posexplode_outer(pieces).alias("fragment", "tokens"))
    packed = split.mapInArrow(_pack, "node long, size long, fragment int, tokens binary")
    segments = stored(packed, "segments")
    # a set's prefix begins with the shingles that are in no other set
    lacking = F.col("size") - F.size("shared")
    wanted = (F.col("size") - F.ceil(F.col("size") * rule.under / rule.over) + 1 - lacking).cast("int")
    prefixes = listed.where(wanted > 0).select("node", "size", lacking.alias("lacking"), F.explode(F.slice("shared", 1, wanted)).alias("x"))
    prefixes = stored(prefixes.select(F.col("x.token").alias("token"), "node", "size", "lacking"), "prefixes")
    discard(rows, frequency, shared, listed)
    return segments, prefixes


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of tokens as bytes."""
    for batch in batches:
        column = batch.column(3)
        flat = column.flatten().to_numpy(zero_copy_only=False).tobytes()
        ends = 8 * np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        begins = np.concatenate([[0], ends[:-1]])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([flat[a:b] for a, b in zip(begins, ends)], pa.binary())], names=["node", "size", "fragment", "tokens"])


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a block number within their keys, so that a block has about ``BLOCK`` nodes."""
    sizes = stored(rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes")
    return rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")


def node_links(texts: DataFrame, alive: DataFrame, rule: Rule) -> DataFrame:
    """node and root of every node that links with another."""
    segments, prefixes = _segments(texts, alive, rule)
    best = F.min(F.struct(F.col("lacking") / F.col("size"), "node")).getField("node").alias("hub")
    hubs = stored(prefixes.groupBy("token").agg(F.count("*").alias("n"), best).where("n > 1").select("token", "hub"), "hubs")
    around = stored(prefixes.join(hubs, "token").select("hub", "node").where("node <> hub").distinct(), "around")
    star = _dealt(around, ["hub"])
    cell = F.xxhash64("hub", "block").alias("cell")
    sides = star.select(cell, F.lit(1).alias("side"), "node").unionByName(star.select(cell, F.lit(0).alias("side"), F.col("hub").alias("node")).distinct())
    links = _links(sides, segments, rule)
    roots = components(links)

    rooted = stored(around.join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root")), "rooted")
    main = roots.select(F.col("node").alias("hub"), F.col("root").alias("main"))
    rooted = rooted.join(main, "hub", "left").withColumn("rest", F.col("root") != F.coalesce("main", "hub"))
    rooted = stored(rooted.select("hub", "node", "rest"), "rooted")
    # hubs with at least one node outside their own component: those nodes meet each other and the component's other nodes
    mixed = stored(rooted.where("rest").select("hub").distinct(), "mixed")
    placed = stored(_dealt(rooted.join(mixed, "hub"), ["hub", "rest"]), "placed")
    outer = placed.where("rest").select("hub", F.col("block").alias("first")).distinct()
    inner = placed.select("hub", "rest", F.col("block").alias("second")).distinct()
    pairs = outer.join(inner, "hub").where("not rest or first <= second")
    pairs = stored(pairs.withColumn("cell", F.xxhash64("hub", "first", "rest", "second")), "pairs")
    if pairs.isEmpty():
        return roots
    left = placed.where("rest").join(pairs.select("hub", F.col("first").alias("block"), "cell"), ["hub", "block"]).select("cell", F.lit(0).alias("side"), "node")
    right = placed.join(pairs.select("hub", "rest", F.col("second").alias("block"), "cell"), ["hub", "rest", "block"]).select("cell", F.lit(1).alias("side"), "node")
    return components(links.unionByName(_links(left.unionByName(right), segments, rule)))


def similar_groups(docs: DataFrame, rule: Rule = RULE, empty_together: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id reachable over links.

    Words are runs of bytes other than ASCII white space with A-Z lower-cased; a text with fewer words than a shingle is
    one shingle, a text without words (also a missing one) has none and links with nothing, or with its like if
    ``empty_together``. Sets are compared whole; shingles and sets are known by 64-bit hashes. Repeated rows and equal
    sets are one group whatever their number. Rows without a doc_id take part but never name a group (one of only such
    rows has a missing component_id). Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", *identity(utf8()), utf8().alias("text"))
    two = texts.schema["two"].dataType.simpleString()
    marked = stored(texts.mapInArrow(_marks(rule), f"doc_id {kind}, one long, two {two}, node long, size long"), "marks")
    named = marked.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.min(F.struct("one", "two")).alias("text"))
    distinct = stored(named, "distinct")

    total = marked.agg(F.sum("size").alias("shingles"), F.count("*").alias("rows")).first()
    parts = 1 + (total.shingles or 0) * (rule.over - rule.under) // rule.over // RANGE_TOKENS
    ranges = 1 + total.rows // RANGE_NODES
    asked = texts.select("text").mapInArrow(_first(rule, parts), "part long, tokens binary, nodes binary")
    met = asked.groupBy("part").applyInArrow(_met(ranges), "range long, nodes binary, counts binary")
    met = met.groupBy("range").applyInArrow(_met_in_all, "node long, met long")
    need = F.greatest(F.floor(F.ceil(F.col("size") * rule.under / rule.over) / 10), F.lit(1))
    alive = stored(distinct.join(met, "node").where(F.col("met") >= need).select("node", "text.one", "text.two"), "alive")

    roots = node_links(texts.select("one", "two", "text"), alive, rule)
    rooted = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    some = marked.where("size > 0").join(named, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    none = marked.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"))
    if empty_together:
        none = none.crossJoin(F.broadcast(none.agg(F.min("doc_id").alias("component_id"))))
    else:
        none = none.withColumn("component_id", F.col("doc_id"))
    return some.unionByName(none)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
QUERIES = {"op12_jaccard_join": op12_jaccard_join}
SQL: dict[str, str] = {
    "op12_jaccard_join": f"""
with recursive docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
rows_of as (
    select r, array_to_string(w[k : k + 3], ' ') as g from (select r, w, unnest(range(1, greatest(len(w) - 2, 2))) as k from docs where len(w) > 0)
), sets as (select r, list_sort(list_distinct(list(g))) as s from rows_of group by r),
nodes as (select row_number() over () as a, s, len(s) as n from (select distinct s from sets)),
grams as (select a, n, unnest(s) as g from nodes),
links as (
    select x.a, y.a as b from grams x join grams y on x.g = y.g and x.a <> y.a
    group by x.a, y.a having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach as (select a, a as b from nodes union select reach.a, links.b from reach join links on reach.b = links.a),
ids as (select a, r, doc_id, n from nodes join sets using (s) join docs using (r)),
least as (select reach.a, min(doc_id) as component_id from reach join ids on ids.a = reach.b group by reach.a)
select docs.doc_id, coalesce(ids.n, 0)::bigint as n_shingles, case when ids.a is null then docs.doc_id else component_id end as component_id
from docs left join ids using (r) left join least on least.a = ids.a
"""
}
