"""Near-duplicate documents by an LSH forest over MinHash signatures.

Texts with equal shingle sets are one node.  Every tree of the forest sorts
the nodes by its own stretch of the signature.  Nodes whose signatures share a
prefix form a region; a region with more than ``REGION`` nodes is searched one
value deeper, until its parts are small enough to take all pairs, or the
stretch ends, where a node pairs with the next few in order only.  So dense
regions are searched deep and sparse ones shallow, and pairs grow with nodes.

Pairs go through a 64-bit sketch and a length test, and are confirmed on full
sets: first neighbours in a few orders, then, of all others, those that their
components don't join already.  So copies of one text by the thousand cost a
few confirmations each.

Regions that stay dense are then searched exactly: all nodes that share
``DENSE_DEPTH`` values with more than ``REGION`` others are compared block by
block, on full sets, but for those that one component holds already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import binaries, park, partitions, small_batches, table, tidy
from tremor.llm.components import components
from tremor.llm.hashing import shingles, word_hashes

TREES, DEPTH = 16, 8
REGION = 24  # nodes of a region whose pairs are all taken
LEAST_DEPTH = 2
DENSE_DEPTH = 3  # regions of over REGION nodes that share so many values are compared exactly
SKETCH_BLOCK, SET_BLOCK = 4096, 256  # rows of a block of sketches and of sets; blocks of a region meet in pairs
FIRST_TREES = 3  # orders whose direct neighbours are confirmed first
SKETCH = 44  # equal bits of 64: at a similarity of 0.8 57.6 are expected, with a deviation of 2.4
BROADCAST_NODES = 1_000_000  # nodes with pairs (some 30 bytes each) that are sent to all tasks; more are joined by shuffle


@cache
def _coefficients():
    import numpy as np

    draw = np.random.default_rng(11)
    n = TREES * DEPTH
    return draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


def signature(hashes):
    """MinHash values of a set of 64-bit hashes."""
    import numpy as np

    a, b = _coefficients()
    low = None
    for k in range(0, len(hashes), 2048):
        part = (hashes[k : k + 2048] >> np.uint64(32)).astype(np.uint32)[:, None]
        least = (part * a + b).min(axis=0)
        low = least if low is None else np.minimum(low, least)
    return low


def _nodes(size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
            counts, nodes, labels, sketches = [], [], [], []
            for words in word_hashes([x.lower() for x in binaries(batch, "text")]):
                own = shingles(words, size)
                counts.append(len(own))
                if not len(own):
                    nodes.append(None)
                    labels.append(None)
                    sketches.append(None)
                    continue
                values = signature(own)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                labels.append(values.astype(">u4").tobytes())
                bits = np.packbits((values[::2] ^ (values[::2] >> np.uint32(15)) ^ (values[::2] >> np.uint32(7))) & np.uint32(1))
                sketches.append(int.from_bytes(bits.tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.int64()), pa.array(labels, pa.binary())],
                ["doc_id", "text_key", "n", "node", "sketch", "label"],
            )

    return run


def _regions(batches: Iterator) -> Iterator:
    """Rows sorted by (tree, label, node) within the tasks to candidate pairs."""
    import numpy as np
    import pyarrow as pa

    least = LEAST_DEPTH * 4

    def pairs(group: list[tuple]) -> Iterator:
        """Pairs of a region: sorted rows that share a prefix of ``depth`` values."""
        todo = [(0, len(group), LEAST_DEPTH)]
        while todo:
            lo, hi, depth = todo.pop()
            if hi - lo < 2:
                continue
            if hi - lo <= REGION:
                yield from ((i, j) for i in range(lo, hi) for j in range(i + 1, hi))
            elif depth == DEPTH:
                yield from ((i, j) for i in range(lo, hi) for j in range(i + 1, min(hi, i + 4)))
            else:
                at = lo
                for k in range(lo + 1, hi + 1):
                    if k == hi or group[k][1][4 * depth : 4 * depth + 4] != group[at][1][4 * depth : 4 * depth + 4]:
                        todo.append((at, k, depth + 1))
                        at = k

    def found(group: list[tuple]):
        ij = np.array(list(pairs(group)) + [(i, i + 1) for i in range(len(group) - 1)], np.int64).reshape(-1, 2)
        node, n, sketch = (np.array([x[c] for x in group], np.int64) for c in (2, 3, 4))
        i, j = ij[:, 0], ij[:, 1]
        alike = np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)) <= 64 - SKETCH
        close = np.minimum(n[i], n[j]) * 100 >= 80 * np.maximum(n[i], n[j])
        keep = alike & close & (node[i] != node[j])
        a, b = np.minimum(node[i], node[j])[keep], np.maximum(node[i], node[j])[keep]
        first = (group[0][0] < FIRST_TREES) & (j - i == 1)[keep]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(first)], ["a", "b", "first"])

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "label", "node", "n", "sketch")), strict=True):
            if group and (row[0] != group[0][0] or row[1][:least] != group[0][1][:least] or len(group) >= 200_000):
                if len(group) > 1:
                    yield found(group)
                # a region too large for memory goes on with its last rows
                group = group[-REGION:] if len(group) >= 200_000 else []
            group.append(row)
    if len(group) > 1:
        yield found(group)


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b (nodes, a < b) and first: pairs to confirm, from node, n, sketch, label."""
    n = partitions(nodes.sparkSession)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = nodes.select(tree.alias("tree"), "label", "node", "n", "sketch")
    rows = rows.withColumn("label", F.substring("label", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)))
    rows = rows.repartition(n, "tree", F.substring("label", 1, 4 * LEAST_DEPTH)).sortWithinPartitions("tree", "label", "node")
    found = rows.mapInArrow(tidy(_regions), "a bigint, b bigint, first boolean")
    return found.groupBy("a", "b").agg(F.max("first").alias("first"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (with region, node and component) once for each pair of blocks, ``i`` and ``j``, to compare;
    ``own`` is the row's block.

    Blocks hold ``size`` rows of a region on average; those below 0 are of its largest component and meet
    the others only, so that a row of a large component isn't dealt out more often than other rows need it.
    Any two rows that aren't both of that component meet in one pair of blocks.
    """
    count = F.count(F.lit(1))
    of_component = rows.groupBy("region", "component").agg(count.alias("n"))
    n = of_component.groupBy("region").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda x: F.ceil(x / size).cast("int")
    n = n.select("region", F.col("top.component").alias("top"), blocks(F.col("top.n")).alias("n_top"), blocks(F.col("all") - F.col("top.n")).alias("n_rest"))
    rows = rows.join(n, "region").withColumn("in_top", F.col("component") == F.col("top"))
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("in_top"), -1 - place(F.col("n_top"))).otherwise(place(F.col("n_rest"))))
    low = F.when(F.col("in_top"), F.lit(0)).otherwise(-F.col("n_top"))
    rows = rows.where("n_rest > 0").withColumn("other", F.explode(F.sequence(low, F.col("n_rest") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n_top", "n_rest", "top", "in_top")
    return rows.repartition(partitions(rows.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j")


def _groups(batches: Iterator, read) -> Iterator[list[tuple]]:
    """The rows of each pair of blocks; ``read`` makes (key, row) of a batch."""
    last, group = None, []
    for batch in batches:
        for key, row in read(batch):
            if key != last and group:
                yield group
                group = []
            last = key
            group.append(row)
    if group:
        yield group


def _keys(part) -> Iterator:
    return zip(*(part.column(c).to_pylist() for c in ("region", "i", "j")), strict=True)


def _alike(batches: Iterator) -> Iterator:
    """region and node of the nodes that may be similar to one of another component."""
    import numpy as np
    import pyarrow as pa

    def read(batch):
        yield from zip(_keys(batch), zip(*(batch.column(c).to_pylist() for c in ("region", "own", "node", "n", "sketch", "component")), strict=True), strict=True)

    for group in _groups(batches, read):
        own, node, n, sketch, component = (np.array([x[c] for x in group], np.int64) for c in range(1, 6))
        right = own == own.max()
        left = ~right if not right.all() else right
        live = np.zeros(len(group), bool)
        r = np.flatnonzero(right)
        for k in range(0, int(left.sum()), 256):
            m = np.flatnonzero(left)[k : k + 256]
            fits = np.bitwise_count((sketch[m][:, None] ^ sketch[r]).view(np.uint64)) <= 64 - SKETCH
            fits &= np.minimum(n[m][:, None], n[r]) * 100 >= 80 * np.maximum(n[m][:, None], n[r])
            fits &= component[m][:, None] != component[r]
            live[m] |= fits.any(axis=1)
            live[r] |= fits.any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([group[0][0]] * int(live.sum()), pa.int64()), pa.array(node[live])], ["region", "node"])


def _common(left: list, right: list):
    """Sizes of the intersections of each set of ``left`` with each of ``right``."""
    import numpy as np

    both = np.zeros((len(left), len(right)), np.float64)
    words, at = np.unique(np.concatenate(left + right), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    often = np.bincount(at, minlength=len(words)) > 1
    place = np.cumsum(often) - 1
    rows, at = rows[often[at]], place[at[often[at]]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    for lo in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        has = np.zeros((len(left) + len(right), 4096), np.float32)
        has[rows[a:b], at[a:b] - lo] = 1
        both += has[: len(left)] @ has[len(left) :].T
    return both


def _links(size: int, percent: int):
    """Links of nodes of different components, as many as join all that belong together."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def read(batch):
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = (shingles(x, size) for x in word_hashes([t.lower() for t in binaries(part, "text")]))
                yield from zip(_keys(part), zip(*(part.column(c).to_pylist() for c in ("own", "node", "component")), sets, strict=True), strict=True)

        for group in _groups(batches, read):
            last = max(x[0] for x in group)
            right = [x for x in group if x[0] == last]
            left = [x for x in group if x[0] != last] or right
            n, m = (np.array([len(x[3]) for x in side], np.float64) for side in (left, right))
            both = _common([x[3] for x in left], [x[3] for x in right])
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while x in root:
                    x = root[x]
                return x

            a, b = [], []
            for i, j in zip(*np.nonzero(100 * both >= percent * (n[:, None] + m - both)), strict=True):
                x, y = find(left[i][2]), find(right[j][2])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(left[i][1])
                    b.append(right[j][1])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def dense(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """region, node and component of the nodes to compare exactly, from node, n, sketch, label and the components so far."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    own = F.coalesce("component", "node").alias("component")
    rows = nodes.join(joined, "node", "left").select(tree.alias("tree"), "label", "node", "n", "sketch", own)
    region = F.xxhash64("tree", F.substring("label", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DENSE_DEPTH)))
    rows = rows.select(region.alias("region"), "node", "n", "sketch", "component")
    open_ = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    rows = rows.join(open_.where((F.col("size") > REGION) & (F.col("low") < F.col("high"))).select("region"), "region")
    live = _blocks(rows, SKETCH_BLOCK).mapInArrow(tidy(_alike), "region bigint, node bigint").distinct()
    return live.join(joined, "node", "left").select("region", "node", own)


def _confirm(size: int, percent: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = [[shingles(x, size) for x in word_hashes([t.lower() for t in binaries(part, c)])] for c in ("text_a", "text_b")]
                ids = zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)
                for (i, j), x, y in zip(ids, *sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        a.append(i)
                        b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, group_key, n_shingles, component_id and kept for every row.

    Sets of ``size``-word shingles are linked from ``percent`` similarity.
    Null and empty texts have an empty set and stand alone.  component_id is
    the smallest doc_id reachable, null if none has one; kept is true for
    component_id itself (every repeated row of that doc_id) and where
    component_id is null.  Other columns are not read; an empty table gives an
    empty result.  ``text_key``: a hash of the text, to tell rows with equal
    doc_id apart; ``group_key``: one value for all rows of a component, null for
    empty sets.
    """
    with small_batches(documents.sparkSession):
        return _near_duplicates(documents, size, percent)


def _near_duplicates(documents: DataFrame, size: int, percent: int) -> DataFrame:
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = park(docs.mapInArrow(tidy(_nodes(size)), f"doc_id {kind}, text_key bigint, n bigint, node bigint, sketch bigint, label binary"), "near-rows")
    full = rows.where("node is not null")
    # the row whose text stands for the node, and the node's smallest doc_id
    by_node = full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("label").alias("label"))
    nodes = park(by_node.select("node", F.col("m.doc_id").alias("doc_id"), F.col("m.text_key").alias("text_key"), "n", "sketch", "label"), "near-nodes")
    pairs = park(candidates(nodes.select("node", "n", "sketch", "label")), "near-pairs")

    paired = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = park(nodes.join(some, "node").select("node", F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key")), "near-wanted")
        few = wanted.count() <= BROADCAST_NODES
        here = F.broadcast(wanted) if few else wanted
        found = docs.join(here, (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("node", "text").dropDuplicates(["node"])
        return park(found, "near-texts")

    texts = texts_of(paired)

    def confirmed(some: DataFrame) -> DataFrame:
        one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return park(some.select("a", "b").join(one, "a").join(other, "b").mapInArrow(tidy(_confirm(size, percent)), "a bigint, b bigint"), "near-links")

    links = confirmed(pairs.where("first"))
    joined = park(components(links), "near-components")
    of_a = joined.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = pairs.where("not first").join(of_a, "a", "left").join(of_b, "b", "left").where("not (ca <=> cb) or ca is null")
    more = confirmed(apart)
    links = links.unionByName(more)
    joined = park(components(links), "near-components")
    left = park(dense(nodes, joined), "near-dense")
    if not left.isEmpty():
        rest = _blocks(left, SET_BLOCK).select("region", "i", "j", "own", "node", "component")
        rest = rest.join(texts_of(left.select("node").distinct()), "node").repartition(partitions(documents.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j")
        exact = park(rest.mapInArrow(tidy(_links(size, percent)), "a bigint, b bigint"), "near-links")
        joined = park(components(links.unionByName(exact)), "near-components")

    least = nodes.select("node", "doc_id").join(joined, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = joined.join(least, "component").select("node", "component", "component_id")
    alone = nodes.select("node", "doc_id").join(of_node, "node", "left").select("node", F.coalesce("component", "node").alias("group_key"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node").join(alone, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "text_key", "group_key", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id (null last) and, among
    its texts, the smallest hash; of repeated rows the one that comes first as JSON.  Null and empty texts all stay."""
    judged = park(near_duplicates(documents, size, percent).where("group_key is not null").groupBy("group_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "near-judged")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    stays = judged.groupBy("group_key").agg(F.min(order).alias("least")).select(F.col("least.doc_id").alias("stay_doc"), F.col("least.text_key").alias("stay_key"))
    # a text is in one group only, so that id and text tell whether a row stays, without a join by group
    judged = judged.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key"), "n")
    same = F.col("of_doc").eqNullSafe(F.col("stay_doc")) & (F.col("of_key") == F.col("stay_key"))
    repeated = park(judged.where("n > 1").join(stays, same, "left_semi").select("of_doc", "of_key"), "near-repeated")
    gone = judged.join(stays, same, "left_anti").select("of_doc", "of_key").unionByName(repeated)
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    on = F.col("row.doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("row.text") == F.col("of_key"))
    out = row.join(gone, on, "left_anti")
    n = repeated.count()
    if n:
        few = F.broadcast(repeated) if n <= BROADCAST_NODES else repeated
        # the least row of equal ones, found before the shuffle as far as possible
        first = row.join(few, on).groupBy("of_doc", "of_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(first.select("row"))
    return out.select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2).drop("text_key", "group_key")


ORACLE = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 2 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from d),
classes as (select min(doc_id) as rep, s, len(s) as n from (select doc_id, list_sort(s) as s from sets where len(s) > 0) t group by s),
words as (select rep, n, unnest(s) as x from classes),
freq as (select x, count(*) as f from words group by x),
ranked as (select rep, n, x, row_number() over (partition by rep order by f, x) as r from words join freq using (x)),
prefix as (select rep, n, x from ranked where r <= n - cast(ceil(0.8 * n) as bigint) + 1),
cand as (select distinct a.rep as a, b.rep as b from prefix a join prefix b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links as (select c.a, c.b from cand c join classes x on x.rep = c.a join classes y on y.rep = c.b
  where 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
both_ways as (select a, b from links union select b, a from links),
reach(node, root) as (select rep, rep from classes union select e.b, r.root from reach r join both_ways e on e.a = r.node),
comp as (select node, min(root) as component from reach group by node)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(comp.component, s.doc_id) as component_id, s.doc_id = coalesce(comp.component, s.doc_id) as kept
from sets s left join classes c on list_sort(s.s) = c.s left join comp on comp.node = c.rep
"""
