"""N-gram Jaccard join with signature trees.

Texts become sets of hashed word shingles. Documents with the same set are one
class, so copies cost one row each and nothing more. Candidate classes are found
without loss by the pigeonhole principle: the range of hashes is cut into more
parts than two sets that link can differ in, so at least one part with shingles is
the same in both; each class sends the sums of the parts it must (by its size) to
be matched. Matches form blocks. Within a block, classes are leaves of a signature
tree whose nodes hold the OR of the token bitmaps and the range of sizes below; the
tree is traversed against itself, pairs of nodes whose greatest possible overlap is
too small are pruned, pairs already connected are skipped, the rest are checked on
the exact sets. A block of more than CHUNK classes is cut into chunks by hash: each
by itself, then the first of each component met, then the classes that share a sum
and still are of different components. No pair is lost, and a group of n near
copies costs about n checks.

A Bloom filter keeps what cannot match from being sent; it has BITS_A_KEY bits for
each key, at most 32 MB in all, and exact joins follow it. Sets with no shingle link with nothing. A null
doc_id links with nothing and its component is null. Rows that repeat a doc_id
belong to the class of their own text, and further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, table, written
from .components import components

#: Most classes in one task's tree.
CHUNK = 600
#: Times that a block's classes are sent on average, at most, before its sums are used instead.
MOST_SENT = 8
#: Bits of a Bloom filter for each key, and the most it may have (32 MB), as a power of two.
BITS_A_KEY, MOST_BITS = 12, 28
#: Pieces in which a filter comes to the driver; a power of two, no more than the words of the smallest filter.
SLICES = 512
KEPT_WORDS = 400_000

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """The hashes of the distinct shingles, in order. Only A to Z are lower-cased, only ASCII white space parts words."""
    ws = data.lower().split() if data else []
    n = len(ws)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(_WORDS.__getitem__, ws), _U, n)
    if n < width:
        x = np.array([n], _U)
        for v in h:
            x = mix(x * _ODD[7] + v)
        return x
    total = h[: n - width + 1] * _ODD[0]
    for i in range(1, width):
        total = total + h[i : n - width + 1 + i] * _ODD[i % 7] + _U(i // 7)
    return np.unique(mix(total))


class Rule:
    """Two sets link when 100 |x and y| >= percent |x or y|."""

    def __init__(self, percent: int):
        self.p = percent

    def differ(self, total: int) -> int:
        """Most elements in one of two linked sets only, by the sum of their sizes."""
        return (100 - self.p) * total // (100 + self.p)

    def partner(self, n: int) -> int:
        """The largest size that a set of n elements can link with."""
        return 100 * n // self.p

    def links(self, n: int, m: int, shared: int) -> bool:
        return (100 + self.p) * shared >= self.p * (n + m)


#: The largest size of each band; it grows as sizes come.
TOPS = [1]


def part_sums(s: np.ndarray, rule: Rule) -> np.ndarray:
    """What a set sends to be matched: hashes of (band of sizes, part, sum of the part's shingles).

    Each band of sizes reaches a quarter further than the one before and rules the
    pairs whose larger set it holds, so parts hold five shingles or more and seldom
    agree by chance. A band has m parts, more than such sets can differ in. Parts of
    fewer than two shingles are weak: a common line makes them agree. If x can differ
    from any partner in at most d elements and has w weak parts, at least
    a = m - d - w strong parts agree with a partner, so one of its first m - a + 1
    parts does, for both. Where a < 1 all agreeing parts can be weak in both, and such
    sets send the weak ones too; where all can be empty, one sum of the band as well.
    """
    n = len(s)
    if not n:
        return s
    out = []
    far = rule.partner(n)
    while TOPS[-1] < far:
        TOPS.append(TOPS[-1] * 5 // 4 + 1)
    for band in range(bisect_left(TOPS, n), bisect_left(TOPS, far) + 1):
        top = TOPS[band]
        most = rule.differ(2 * top)
        d = rule.differ(n + min(far, top))
        if not d:
            continue  # only equal sets link, and those are one class
        m = most + 2 + most * 12 // 100
        part = ((s >> _U(32)) * _U(m)) >> _U(32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, part = np.add.reduceat(s, at), part[at]
        strong = np.diff(at, append=n) > 1
        a = m - d - (m - int(strong.sum()))
        if a >= 1:
            strong &= part <= m - a
            sums, part = sums[strong], part[strong]
        elif len(at) <= d:
            out.append(mix(np.array([band], _U) * _ODD[3] + _ODD[4]))
        out.append(mix(mix(sums * _ODD[5] + part) + np.array([band], _U) * _ODD[6]))
    return np.concatenate(out) if out else np.empty(0, _U)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def bloom(keys: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """A filter of spread 64-bit numbers whose size follows theirs, up to 2 ** MOST_BITS bits; its power of two, and its words.

    Executors put the words together in SLICES pieces of bytes: the driver gets these, no row for each word.
    """
    power = min(MOST_BITS, max(16, (keys.count() * BITS_A_KEY).bit_length()))
    mask, k = (1 << power) - 1, F.col(column)
    each = (1 << (power - 6)) // SLICES
    at = F.explode(F.array(k.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(k, 64 - power).bitwiseAND(F.lit(mask))))
    words = keys.select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))

    def put(key: tuple, rows: pa.Table) -> pa.Table:
        piece = np.zeros(each, np.int64)
        piece[rows["w"].to_numpy() % each] = rows["bits"].to_numpy()
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([piece.tobytes()], pa.binary())})

    out = np.zeros(1 << (power - 6), np.uint64)
    for r in words.groupBy(F.expr(f"w div {each}").alias("slice")).applyInArrow(put, "slice long, bits binary").collect():
        out[r["slice"] * each : (r["slice"] + 1) * each] = np.frombuffer(r["bits"], np.uint64)
    return power, out


def may_hold(filter_: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    power, bits = filter_
    ok = np.ones(len(keys), bool)
    for at in (keys & _U((1 << power) - 1), keys >> _U(64 - power)):
        ok &= (bits[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1
    return ok


class Tree:
    """A node: the OR of the bitmaps below, the range of their sizes, the most elements a set has beyond its bits."""

    __slots__ = ("bits", "low", "high", "spare", "parts", "leaf")

    def __init__(self, parts: list[Tree] | None, leaf: int = -1, bits: int = 0, size: int = 0):
        self.parts, self.leaf = parts, leaf
        if parts is None:
            self.bits, self.low, self.high, self.spare = bits, size, size, size - bits.bit_count()
        else:
            self.bits, self.low, self.high, self.spare = 0, min(p.low for p in parts), max(p.high for p in parts), max(p.spare for p in parts)
            for p in parts:
                self.bits |= p.bits


def signature_tree(sets: list[np.ndarray], fan: int = 4) -> Tree:
    width = 64
    while width < 2 * max(len(s) for s in sets) and width < 1 << 15:
        width *= 2
    leaves = []
    for i, s in enumerate(sets):
        held = np.zeros(width, np.uint8)
        held[(s & _U(width - 1)).astype(np.int64)] = 1
        leaves.append(Tree(None, i, int.from_bytes(np.packbits(held).tobytes(), "big"), len(s)))
    level = sorted(leaves, key=lambda t: (t.low, t.bits))
    while len(level) > 1:
        level = [Tree(level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0]


def tree_links(ids: list[int], comps: list[int], sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what the sets connect; pairs of one component (given or found here) are skipped."""
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    tree = signature_tree(sets)
    stack = [(tree, tree)]
    while stack:
        a, b = stack.pop()
        if a.high * 100 < rule.p * b.low or b.high * 100 < rule.p * a.low:
            continue
        if a is not b:
            most = min(a.high, b.high, (a.bits & b.bits).bit_count() + min(a.spare, b.spare))
            if not rule.links(a.low, b.low, most):
                continue
        if a.parts is None and b.parts is None:
            if a is b or (x := find(comps[a.leaf])) == (y := find(comps[b.leaf])):
                continue
            s, t = sets[a.leaf], sets[b.leaf]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            if rule.links(len(s), len(t), int((t[at] == s).sum())):
                root[x] = y
                out.append((ids[a.leaf], ids[b.leaf]))
        elif a is b:
            ps = a.parts
            stack += [(ps[i], ps[j]) for i in range(len(ps)) for j in range(i, len(ps))]
        elif b.parts is None or a.parts is not None and len(a.parts) and a.high >= b.high:
            stack += [(p, b) for p in a.parts]
        else:
            stack += [(a, p) for p in b.parts]
    return out


def _block_links(rows: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """Links within each group of rows (node, comp, data) with equal keys. A partition is streamed, a group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, comps, sets = None, [], [], []

        def made() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and len(set(comps)) > 1 and (found := tree_links(ids, comps, sets, rule)):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            *ks, node, comp, data = (c.to_pylist() for c in batch.columns)
            for k, i, c, d in zip(zip(*ks), node, comp, data):
                if k != now:  # keys follow each other in order
                    yield from made()
                    now, ids, comps, sets = k, [], [], []
                ids.append(i)
                comps.append(c)
                sets.append(np.frombuffer(d, _U))
        yield from made()

    dealt = rows.select(*keys, "node", "comp", "data").repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(run, "a long, b long")


def links(blocks: DataFrame, sets: DataFrame, matches: DataFrame, rule: Rule, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all nodes of a block that exact links connect. blocks: block, node; sets: node, data; matches: sig, node."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select("block", F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    placed = blocks.join(parts, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    placed = written(placed.join(sets, "node").withColumn("comp", F.col("node")), "placed")
    found = written(_block_links(placed, ["block", "chunk"], rule), "links")
    large = placed.where("k > 1")
    if not large.limit(1).count():
        return found

    def labelled(known: DataFrame) -> DataFrame:
        comp = components(known).withColumnRenamed("comp", "to")
        return large.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("to", "node")).drop("to")

    # the first of each component of a chunk stands for it; there may be so many that they need chunks again
    reps_before = None
    while True:
        now = labelled(found)
        reps = now.groupBy("block", "comp").agg(F.min("node").alias("node"))
        many = reps.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
        total = many.agg(F.sum("n")).first()[0] or 0
        if not total or reps_before and 2 * total > reps_before:
            break  # none is left open, or too few were joined for another round to pay
        reps_before = total
        shared = reps.join(many, "block").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(total)), F.ceil(F.col("n") / chunk)).cast("int"))
        held = shared.join(placed.select("block", "node", "data"), ["block", "node"])
        found = written(found.unionByName(_block_links(held, ["block", "chunk"], rule)), "links")
    if not total:
        return found
    # blocks that still hold several components: where few classes are outside the main one, these meet
    # the block's other classes; else what shares a sum meets, unless it is one component already
    open_ = written(now.join(many.select("block"), "block", "left_semi").select("block", "node", "comp"), "open")
    tally = _tally(open_, "block", chunk)
    few = tally.where(f"n * others + rest * (k + others - 1) <= {MOST_SENT} * (n + rest)").select("block")
    by_block = _meetings(open_.join(few, "block", "left_semi"), "block", chunk)
    wide = open_.join(few, "block", "left_anti").select("node", "comp")
    by_sum = _meetings(written(matches.join(wide, "node"), "met"), "sig", chunk)
    held = by_block.unionByName(by_sum).join(placed.select("node", "data"), "node")
    return written(found.unionByName(_block_links(held, ["key", "low", "high"], rule)), "links")


def _tally(rows: DataFrame, by: str, chunk: int) -> DataFrame:
    """by, main (its largest component), n and rest (classes in and outside it), k and others (their chunks), where there are several."""
    counts = rows.groupBy(by, "comp").agg(F.count("*").alias("n"))
    found = counts.groupBy(by).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("all")).withColumn("rest", F.col("all") - F.col("n")).where("rest > 0")
    return found.select(by, "main", "n", "rest", F.ceil(F.col("n") / chunk).cast("int").alias("k"), F.ceil(F.col("rest") / chunk).cast("int").alias("others"))


def _meetings(rows: DataFrame, by: str, chunk: int) -> DataFrame:
    """key, low, high, node, comp: within each group of by, chunks outside the main component meet its chunks and each other."""
    cut = rows.join(_tally(rows, by, chunk), by).withColumn("of_main", F.col("comp") == F.col("main"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", by), F.when(F.col("of_main"), F.col("k")).otherwise(F.col("others"))).cast("int"))
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.col("own").alias("low"), j.alias("high")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda c: F.struct(c.alias("low"), F.col("own").alias("high")))
    apart = F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda j: j != F.col("own"))
    among = F.transform(apart, lambda j: F.struct((-1 - F.least(F.col("own"), j)).alias("low"), F.greatest(F.col("own"), j).alias("high")))
    at = F.explode(F.when(F.col("of_main"), with_others).otherwise(F.concat(with_main, among)))
    return cut.withColumn("at", at).select(F.struct(F.lit(by).alias("by"), F.col(by).alias("id")).alias("key"), "node", "comp", "at.low", "at.high")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    spark = docs.sparkSession
    rule = Rule(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))

    def per_batch(made: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    yield from made(*(c.to_pylist() for c in batch.slice(at, 1000).columns))

        return run

    def node_of(s: np.ndarray) -> int:
        return int(_U(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))

    def read(doc_ids: list, data: list) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], []]
        sigs, ends = [], [0]
        for doc, d in zip(doc_ids, data):
            s = shingle_set(d, width)
            p = part_sums(s, rule) if doc is not None else s[:0]
            for c, v in zip(rows, (doc, node_of(s), len(s))):
                c.append(v)
            sigs.append(p)
            ends.append(ends[-1] + len(p))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(sigs).astype(_U)))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows), lists], names=["doc_id", "node", "n", "sigs"])

    # each text is shingled here, once; its sums are written, those of one text of each class are sent to be matched
    linkable = texts.where("doc_id IS NOT NULL AND data IS NOT NULL")
    summed = written(texts.mapInArrow(per_batch(read), "doc_id long, node long, n long, sigs array<long>"), "sums")
    matched = summed.select("node", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    matched = written(matched.where("low < high").select("sig", "low"), "matched")
    passing = spark.sparkContext.broadcast(bloom(matched, "sig"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            ok = may_hold(passing.value, values.view(_U))
            nodes = np.repeat(batch.column(0).to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[ok]), pa.array(values[ok])], names=["node", "sig"])

    known = summed.select("doc_id", "node", "n")
    sent = summed.where("size(sigs) > 0").select("node", "sigs").mapInArrow(passed, "node long, sig long")
    classes = written(known.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
    # matches as stars: each class of a sum with its lowest class
    matches = written(sent.distinct().join(matched, "sig"), "matches")
    stars = matches.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    blocks = written(components(stars).select(F.col("comp").alias("block"), "node"), "blocks")
    # the exact sets of these classes, from one text of each
    wanted = blocks.join(classes, "node").select("node", "rep", F.xxhash64("rep").alias("key"))
    near = spark.sparkContext.broadcast(bloom(wanted, "key"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = may_hold(near.value, batch.column(2).to_numpy(zero_copy_only=False).view(_U))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok)).columns[:2], names=["rep", "data"])

    kept = linkable.select("doc_id", "data", F.xxhash64("doc_id").alias("key")).mapInArrow(chosen, "rep long, data binary")

    def hashed(nodes: list, data: list) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(d, width) for d in data]
        # a doc_id may stand on rows of several texts: only the text of this class is its set
        ok = [node_of(s) == n for n, s in zip(nodes, sets)]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, k in zip(nodes, ok) if k], pa.int64()), pa.array([s.tobytes() for s, k in zip(sets, ok) if k], pa.binary())], names=["node", "data"])

    sets = kept.join(wanted.select("node", "rep"), "rep").select("node", "data").mapInArrow(per_batch(hashed), "node long, data binary").dropDuplicates(["node"])
    found = links(blocks, sets, matches.select("sig", "node"), rule, chunk)
    # components by the smallest document of each class
    by_rep = found.join(classes.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(classes.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    reps = components(by_rep).select(F.col("node").alias("rep"), "comp")
    final = written(classes.join(reps, "rep", "left").select(F.col("node").alias("_node"), F.coalesce("comp", "rep").alias("comp")), "final")
    told = known.select("doc_id", "node", "n").join(final, F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    return told.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(CASE WHEN len(ws) < 4 THEN ws ELSE ws[i:i + 3] END, ' ') AS x FROM d, unnest(range(1, greatest(len(ws) - 2, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON b.x = a.x AND b.r <> a.r GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * p.shared >= 85 * (x.n + y.n - p.shared)),
walk AS (SELECT r AS origin, r FROM d UNION SELECT w.origin, e.b FROM walk w JOIN e ON e.a = w.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(o.doc_id) FROM walk w JOIN d o ON o.r = w.r WHERE w.origin = d.r) AS component_id
FROM d LEFT JOIN n USING (r)
"""
