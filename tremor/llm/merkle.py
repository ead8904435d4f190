"""Merkle manifest of a data set: a tree for each language, and a tree of their roots.

Leaves are numbered within their language, and every aligned block of 512
becomes one row.  Inside a block, authentication paths are made leaf by leaf
by treehash stacks that work ahead of the leaf (traversal scheduling): a level
holds the run of nodes that the present leaf needs and a stack for the next
one, so that a task keeps a number of nodes that is logarithmic in the block
beside its row.  The tops of blocks are the leaves of the tier above, which is
made in the same way; the paths of tops are appended to those of their leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tremor.llm.common import UPPER, crc_of_id, crc_sql, park, small_batches, table
from tremor.llm.placing import placed

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place:int,siblings:array<string>>>"
_MEMBER = "struct<place:bigint,doc_id:bigint,leaf:string,claim:string>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


@dataclass
class Treehash:
    """The nodes of one height over the leaves from ``start`` to ``stop``, made from one leaf at a time.

    The last run of the block's ``n`` leaves may be short, even a single node."""

    height: int
    at: int
    stop: int
    n: int
    stack: list = field(default_factory=list)  # (height, node), heights falling
    done: list = field(default_factory=list)

    @property
    def low(self) -> float:
        """Height of the lowest node on the stack: the scheduler serves the lowest first, so that few stacks are deep."""
        if self.at >= self.stop:
            return float("inf")
        return self.stack[-1][0] if self.stack else self.height

    def step(self, leaves: list[str]) -> None:
        height, node = 0, leaves[self.at]
        self.at += 1
        while height < self.height and (self.at == self.n or self.at % FAN ** (height + 1) == 0):
            run = [node]
            while self.stack and self.stack[-1][0] == height:
                run.append(self.stack.pop()[1])
            height, node = height + 1, digest(*reversed(run))
        self.done.append(node) if height == self.height else self.stack.append((height, node))

    def finish(self, leaves: list[str]) -> list[str]:
        while self.at < self.stop:
            self.step(leaves)
        return self.done


def block_height(block: int, n: int) -> int:
    """Levels of a block: all of them, but for the only block of a small group, which ends with one node."""
    if block > 0 or n == BLOCK:
        return LEVELS
    height = 0
    while FAN**height < n:
        height += 1
    return height


def top(leaves: list[str], height: int) -> str:
    return Treehash(height, 0, len(leaves), len(leaves)).finish(leaves)[0]


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in order its path: by level, from the leaves up, its place in the run and the run's nodes."""
    n = len(leaves)
    runs = [Treehash(k, 0, min(n, FAN ** (k + 1)), n).finish(leaves) for k in range(height)]
    ahead = [Treehash(k, min(n, FAN ** (k + 1)), min(n, 2 * FAN ** (k + 1)), n) for k in range(height - 1)]
    for i in range(n):
        yield [(i // FAN**k % FAN, runs[k]) for k in range(height)]
        for _ in ahead:  # a leaf for each level and step is what all stacks need together
            lowest = min(ahead, key=lambda t: (t.low, t.height))
            if lowest.at < lowest.stop:
                lowest.step(leaves)
        for k in range(height - 1):
            if (i + 1) % FAN ** (k + 1) == 0:
                runs[k] = ahead[k].finish(leaves)
                ahead[k] = Treehash(k, min(n, i + 1 + FAN ** (k + 1)), min(n, i + 1 + 2 * FAN ** (k + 1)), n)


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The top that ``node`` and its siblings give; path: place and siblings, level by level."""
    for place, siblings in path:
        node = digest(*siblings[:place], node, *siblings[place:])
    return node


def _member(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column | None = None) -> Column:
    """The leaf of a documents row, with ``text`` in place of its own."""
    values = [F.col(c) if c != "text" or text is None else text for c in FIELDS]
    return F.sha2(F.concat(*[_member(c) for c in values]), 256)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of numbered nodes, one row each: grp, block, members in order."""
    member = F.struct("place", "doc_id", "leaf", "claim").cast(_MEMBER)
    rows = nodes.groupBy("grp", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return park(rows, "merkle-blocks")


def _map(rows: DataFrame, of_block: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """The rows that ``of_block`` gives for each block."""

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                found = list(of_block({c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}))
                yield pa.RecordBatch.from_pylist(found, kinds)

    return rows.mapInArrow(run, schema)


def _tops(blocks: DataFrame) -> DataFrame:
    def of_block(row: dict) -> Iterator[dict]:
        leaves = [m["leaf"] for m in row["members"]]
        yield {"grp": row["grp"], "place": row["block"], "leaf": top(leaves, block_height(row["block"], len(leaves)))}

    return park(_map(blocks, of_block, "grp string, place bigint, leaf string"), "merkle-tops")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks over numbered nodes, lowest first, and the top of each group (grp, leaf)."""
    tiers = []
    while True:
        tiers.append(_blocks(nodes))
        nodes = _tops(tiers[-1])
        if nodes.where("place > 0").isEmpty():
            return tiers, nodes.select("grp", "leaf")
        nodes = nodes.withColumns({"doc_id": F.lit(None).cast("bigint"), "claim": F.lit(None).cast("string")})


def _below(row: dict) -> Iterator[tuple[dict, list[tuple[int, list[str]]]]]:
    """Members of a block with their paths inside it."""
    leaves = [m["leaf"] for m in row["members"]]
    paths = traverse(leaves, block_height(row["block"], len(leaves)))
    for m, path in zip(row["members"], paths, strict=True):
        yield m, [(place, run[:place] + run[place + 1 :]) for place, run in path]


def _paths(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """Every member of the blocks with its whole path; ``upper``: grp, block, path, subroot and root of each block."""

    def of_block(row: dict) -> Iterator[dict]:
        for m, path in _below(row):
            own = [{"place": place, "siblings": siblings} for place, siblings in path]
            yield {"grp": row["grp"], "place": m["place"], "doc_id": m["doc_id"], "leaf": m["leaf"], "claim": m["claim"], "path": own + row["path"], "subroot": row["subroot"], "root": row["root"]}

    schema = f"grp string, place bigint, doc_id bigint, leaf string, claim string, path {PATH}, subroot string, root string"
    return _map(blocks.join(upper, ["grp", "block"]), of_block, schema)


def _descend(tiers: list[DataFrame], upper: DataFrame) -> DataFrame:
    """``upper`` of the lowest tier's blocks from that of the highest."""
    for tier in reversed(tiers[1:]):
        found = _paths(tier, upper).select("grp", F.col("place").alias("block"), "path", "subroot", "root")
        upper = park(found, "merkle-paths")
    return upper


@dataclass(frozen=True)
class Manifest:
    """blocks: grp, block and members (place, doc_id, leaf, claim); upper: grp, block, path, subroot and root.
    grp is the language behind a ``=``, empty for null."""

    blocks: DataFrame
    upper: DataFrame


def manifest(documents: DataFrame, claim: Column | None = None) -> Manifest:
    """The trees over ``documents``; ``claim`` is the text that each row is said to have, to be tried by ``audit``.

    Within a language rows ascend by doc_id, a null one first; rows of one
    doc_id by their leaves, so that repeated rows are equal neighbours.  Nulls
    and empty texts have leaves of their own (``-`` and ``0:``).  Only the
    columns of the leaf are read.  An empty table gives empty trees.
    """
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaf = leaf_of()
    rows = documents.select(group.alias("grp"), "doc_id", leaf.alias("leaf"), (leaf if claim is None else leaf_of(claim)).alias("claim"))
    tiers, subroots = _climb(placed(rows, "grp", ["doc_id", "leaf"]))
    # the tree of subroots, as one more group
    nodes = subroots.select(F.lit("").alias("all"), "grp", "leaf")
    nodes = park(placed(nodes, "all", ["grp"]), "merkle-subroots")
    above, root = _climb(nodes.select(F.col("all").alias("grp"), "place", F.lit(None).cast("bigint").alias("doc_id"), "leaf", F.lit(None).cast("string").alias("claim")))
    start = root.select("grp", F.lit(0).cast("bigint").alias("block"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("leaf").alias("root"))
    found = _paths(above[0], _descend(above, start)).select("place", F.col("path"), F.col("leaf").alias("subroot"), "root")
    start = found.join(nodes.select("place", "grp"), "place").select("grp", F.lit(0).cast("bigint").alias("block"), "path", "subroot", "root")
    return Manifest(tiers[0], _descend(tiers, park(start, "merkle-paths")))


def proofs(found: Manifest) -> DataFrame:
    """doc_id, leaf, claim, path, subroot and root of every row: what an outside verifier needs.

    path holds for each level, from the leaf up, the node's place in its run and the run's other nodes."""
    return _paths(found.blocks, found.upper).select("doc_id", "leaf", "claim", "path", "subroot", "root")


def audit(found: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: each row's claimed leaf folded along its
    path.  Paths are used where they are made and never written, as they are longer than many a document."""

    def of_block(row: dict) -> Iterator[dict]:
        upper = [(x["place"], x["siblings"]) for x in row["path"]]
        above = "".join(s for _, siblings in upper for s in siblings)
        for m, path in _below(row):
            proof = digest(*[s for _, siblings in path for s in siblings], above)
            got = fold(m["claim"], path + upper)
            yield {"doc_id": m["doc_id"], "leaf": m["leaf"], "subroot": row["subroot"], "root": row["root"], "proof_sha256": proof, "folded_root": got, "verified": got == row["root"]}

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _map(found.blocks.join(found.upper, ["grp", "block"]), of_block, schema)


def tampered() -> Column:
    """The text, in lower case (A-Z) where 3 divides the crc32 of the doc_id."""
    return F.when(crc_of_id() % 3 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return audit(manifest(table(spark, sf_dir, "documents"), tampered()))


def _sql_member(c: str) -> str:
    return f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_member(text if c == "text" else c) for c in FIELDS) + ")"


_LOWER = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
ORACLE = f"""
with recursive d as (select row_number() over () as k, doc_id, coalesce('=' || lang, '') as g, {_sql_leaf("text")} as leaf,
  {_sql_leaf("t")} as claim from (select *, case when {crc_sql('doc_id')} % 3 = 0 then {_LOWER} else text end as t from documents) x),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf, k) - 1 as i, count(*) over (partition by g) as n from d),
low as (select g, 0 as lv, i, leaf as h, n from p
  union all select g, lv + 1, i // {FAN}, sha256(string_agg(h, '' order by i)), (n + {FAN - 1}) // {FAN} from low where n > 1 group by g, lv, i // {FAN}, n),
subs as (select g, h, lv as height, row_number() over (order by g) - 1 as i, count(*) over () as n from low where n = 1),
high as (select 0 as lv, i, h, n from subs
  union all select lv + 1, i // {FAN}, sha256(string_agg(h, '' order by i)), (n + {FAN - 1}) // {FAN} from high where n > 1 group by lv, i // {FAN}, n),
nodes as (select g, lv, i, h from low where n > 1 union all select s.g, s.height + x.lv, x.i, x.h from high x, (select g, height from subs) s where x.n > 1),
spot as (select p.k, p.g, t.lv, case when t.lv < s.height then p.i // cast(power({FAN}, t.lv) as bigint) else s.i // cast(power({FAN}, t.lv - s.height) as bigint) end as own
  from p join subs s using (g) join (select distinct g, lv from nodes) t using (g)),
sib as (select spot.k, spot.lv, coalesce(string_agg(x.h, '' order by x.i) filter (where x.i < spot.own), '') as l, coalesce(string_agg(x.h, '' order by x.i) filter (where x.i > spot.own), '') as r
  from spot join nodes x on x.g = spot.g and x.lv = spot.lv and x.i // {FAN} = spot.own // {FAN} group by all),
proof as (select k, sha256(string_agg(l || r, '' order by lv)) as proof, max(lv) as top from sib group by k),
folded as (select k, 0 as lv, claim as h from p union all select f.k, f.lv + 1, sha256(s.l || f.h || s.r) from folded f join sib s on s.k = f.k and s.lv = f.lv)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, coalesce(proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from p join subs s using (g) cross join (select h from high where n = 1) r left join proof using (k) join folded f on f.k = p.k and f.lv = coalesce(proof.top + 1, 0)
"""
