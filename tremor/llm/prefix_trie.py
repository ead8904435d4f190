"""Prefix trie of conversations, merged family by family.

A family is the conversations with one base id (the id without its last two
digits).  Conversations are cogrouped by it, rebuilt, and made into the small
trie of the family; only the nodes of these tries are shuffled and merged.  A
node is named by the exclusive or of 120-bit hashes of (depth, turn) over its
path, so that a long conversation is cut into pieces of 512 turns which know
what came before them by one number: no task holds more than a piece of a
family.  Sums over subtrees need no walk: every node belongs to its smallest
member, the nodes that a conversation owns lie on its own path, and what a
subtree holds is the sum over members of what each of them owns from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import crc_sql, park, table
from tremor.llm.placing import placed

FAMILY, MOST_SHARED = 100, 6
PIECE = 512  # turns of a conversation in one group
HOT_SHARE = 1000  # a node with over 1/1000 of all nodes as children goes to all tasks: 1000 rows at most
_NODE = "a bigint, b bigint, depth bigint, pa bigint, pb bigint, chars bigint, conv_id bigint, n_convs bigint, first_end bigint, ends string"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place from 0, digest and chars of every turn; ties of turn by role, then by the digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    return placed(rows, "conv_id", ["turn", "role", "digest"]).select("conv_id", "place", "digest", "chars")


def _conversations(turns: DataFrame) -> DataFrame:
    """conv_id, base, n_own, skip (own turns that are left out), k (turns taken from the base) and length once rebuilt."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED)
    bases = own.where("conv_id = base").select("base", F.col("n_own").alias("n_base"))
    is_base = F.col("conv_id") == F.col("base")  # it is its own beginning
    own = own.join(bases, "base", "left").select(
        "conv_id", "base", "n_own", F.when(is_base, 0).otherwise(F.col("h")).alias("skip"), F.when(is_base, 0).otherwise(F.least("h", F.coalesce("n_base", F.lit(0)))).alias("k")
    )
    return park(own.withColumn("length", F.col("k") + F.greatest(F.col("n_own") - F.col("skip"), F.lit(0))), "trie-conversations")


def _piece(depth: Column) -> Column:
    return F.floor(F.greatest(depth - 1, F.lit(0)) / PIECE)


def _lane(hashed: Column, start: int) -> Column:
    return F.conv(F.substring(hashed, start, 15), 16, 10).cast("bigint")


def _own_parts(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """base, piece, conv_id, depth, the hash (a, b) of (depth, turn), and chars of the turns that conversations keep."""
    spread = convs.select("conv_id", "base", "skip", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_own") - 1) / PIECE))).alias("chunk"))
    rows = turns.withColumn("chunk", F.floor(F.col("place") / PIECE)).join(spread, ["conv_id", "chunk"]).where("place >= skip")
    rows = rows.withColumn("depth", F.col("place") - F.col("skip") + F.col("k") + 1)
    hashed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    return park(rows.select("base", _piece(F.col("depth")).alias("piece"), "conv_id", "depth", _lane(hashed, 1).alias("a"), _lane(hashed, 16).alias("b"), "chars"), "trie-turns")


def _pieces(parts: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each piece of a conversation: base, piece, conv_id, k, length, and the name (a, b) of the node before it."""
    rows = convs.select("base", "conv_id", "k", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), _piece(F.col("length")))).alias("piece"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.groupBy("conv_id", "piece").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    later = rows.where("piece > 0").select("conv_id", "piece").unionByName(rows.where(f"length > {PIECE} and piece = 0").select("conv_id", "piece"))
    before = later.join(own, ["conv_id", "piece"], "left").select("conv_id", "piece", *[F.bit_xor(c).over(earlier).alias(f"own_{c}") for c in "ab"])
    first = parts.where(f"conv_id = base and depth < {MOST_SHARED}").groupBy("base").agg(F.collect_list(F.struct("depth", "a", "b")).alias("first"))
    rows = rows.join(before, ["conv_id", "piece"], "left").join(first, "base", "left")

    def carried(c: str) -> Column:
        shared = F.aggregate(F.filter("first", lambda x: x["depth"] <= F.col("k")), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(x[c]))
        return F.when(F.col("piece") > 0, F.coalesce(f"own_{c}", F.lit(0)).bitwiseXOR(F.coalesce(shared, F.lit(0)))).otherwise(0).alias(f"before_{c}")

    return park(rows.select("base", "piece", "conv_id", "k", "length", carried("a"), carried("b")), "trie-pieces")


def _rebuilt(base: int, piece: int, turns, convs):
    """Rows (conv_id, depth, a, b, pa, pb, chars, end) of the nodes on the paths of a family's conversations, by conversation
    and depth.  ``turns`` and ``convs`` are pandas frames of one piece of the family."""
    import numpy as np
    import pandas as pd

    convs = convs.sort_values("conv_id")
    rows = turns[["conv_id", "depth", "a", "b", "chars"]]
    if piece == 0:
        first = rows[(rows.conv_id == base) & (rows.depth < MOST_SHARED)].sort_values("depth")
        at = np.concatenate([np.arange(0), *[np.arange(k) for k in convs.k]]).astype(int)
        heads = first.iloc[at].assign(conv_id=np.repeat(convs.conv_id.to_numpy(), convs.k.to_numpy()))
        root = pd.DataFrame({"conv_id": convs.conv_id, "depth": 0, "a": 0, "b": 0, "chars": 0})
        rows = pd.concat([root, heads, rows])
    rows = rows.sort_values(["conv_id", "depth"], kind="stable").reset_index(drop=True)
    conv = rows.conv_id.to_numpy()
    start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if len(conv) else np.arange(0)
    info = convs.set_index("conv_id").loc[conv[start]] if len(conv) else convs
    runs = np.diff(np.append(start, len(conv)))
    out = {"conv_id": conv, "depth": rows.depth.to_numpy(), "chars": rows.chars.to_numpy(), "end": rows.depth.to_numpy() == np.repeat(info.length.to_numpy(), runs)}
    for c in "ab":
        own = rows[c].to_numpy().astype(np.int64)
        total = np.bitwise_xor.accumulate(own) if len(own) else own
        undo = np.repeat(np.where(start > 0, total[start - 1], 0) ^ info[f"before_{c}"].to_numpy(), runs) if len(own) else own
        out[c] = total ^ undo
        out[f"p{c}"] = out[c] ^ own
    return pd.DataFrame(out)


def _family_nodes(key, turns, convs):
    """The trie of one piece of a family, as rows of ``_NODE``; ends: ids of the members that end at the node."""
    import pandas as pd

    rows = _rebuilt(*key, turns, convs)
    nodes = rows.groupby(["a", "b"], sort=False).agg(depth=("depth", "first"), pa=("pa", "first"), pb=("pb", "first"), chars=("chars", "first"), conv_id=("conv_id", "min"), n_convs=("conv_id", "size"))
    ends = rows[rows.end].groupby(["a", "b"], sort=False).conv_id.agg(first_end="min", ends=lambda ids: ",".join(map(str, sorted(ids))))
    found = nodes.join(ends).reset_index()
    found["first_end"] = found.first_end.astype(pd.Int64Dtype()) if len(ends) else pd.array([None] * len(found), pd.Int64Dtype())
    found["ends"] = found.ends.astype(object).where(found.ends.notna(), None) if len(ends) else None
    return found[["a", "b", "depth", "pa", "pb", "chars", "conv_id", "n_convs", "first_end", "ends"]]


def _family_shares(key, turns, convs):
    """a, b, n_leaves, saved: what the members of a family own below each node that has several members."""
    import numpy as np
    import pandas as pd

    rows = _rebuilt(*key, turns, convs)
    weights = [(c, x["depth"], x["w"]) for c, own in zip(convs.conv_id, convs.weights, strict=True) for x in (own if own is not None else ())]
    own = pd.DataFrame(weights, columns=["conv_id", "depth", "w"]).astype("int64")
    rows = rows.merge(own, "left", ["conv_id", "depth"]).merge(convs[["conv_id", "leaf", "alone_from", "later"]], "left", "conv_id")
    w = rows.w.fillna(0).to_numpy().astype(np.int64)
    total = pd.Series(w).groupby(rows.conv_id.to_numpy()).transform("sum").to_numpy()
    before = pd.Series(w).groupby(rows.conv_id.to_numpy()).cumsum().to_numpy() - w
    rows["saved"] = total - before + rows.later.to_numpy()
    rows = rows[(rows.depth < rows.alone_from) & ((rows.saved > 0) | (rows.leaf > 0))]
    return rows.groupby(["a", "b"], sort=False).agg(n_leaves=("leaf", "sum"), saved=("saved", "sum")).reset_index()


def _ends_hash(batches: Iterator) -> Iterator:
    """SHA-256 over the sorted ids of each node, read as a stream: rows come by node, and within it by first id."""
    from hashlib import sha256

    import pyarrow as pa

    node, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ends")], strict=True):
            if (a, b) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["a", "b", "ends_sha256"])


def _merged(family_nodes: DataFrame) -> DataFrame:
    """The nodes of the whole trie, with n_children and ends_sha256, by one shuffle of the families' nodes."""
    one = family_nodes.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("depth", "pa", "pb", "chars", "conv_id")], F.sum("n_convs").alias("n_convs"))
    ends = family_nodes.where("ends is not null").select("a", "b", "first_end", "ends").repartition("a", "b").sortWithinPartitions("a", "b", "first_end")
    ends = ends.select("a", "b", "ends").mapInArrow(_ends_hash, "a bigint, b bigint, ends_sha256 string")
    one = park(one.join(ends, ["a", "b"], "left"), "trie-merged")
    children = one.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    rows = one.join(children, ["a", "b"], "left").fillna(0, ["n_children"])
    return park(rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "trie-nodes")


def _shares(nodes: DataFrame, parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """a, b, n_leaves and saved of nodes with several members: a second round of families."""
    owned = nodes.select("conv_id", "depth", "n_convs", "n_children", _piece(F.col("depth")).alias("piece"), ((F.col("n_convs") - 1) * F.col("chars")).alias("w"))
    of_conv = owned.groupBy("conv_id").agg(F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"), F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("alone_from"))
    of_piece = owned.where("w > 0").groupBy("conv_id", "piece").agg(F.collect_list(F.struct("depth", "w")).alias("weights"), F.sum("w").alias("own"))
    following = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    long = pieces.where(f"length > {PIECE}").select("conv_id", "piece").join(of_piece.drop("weights"), ["conv_id", "piece"], "left")
    later = long.select("conv_id", "piece", F.sum("own").over(following).alias("later"))
    # what holds for a conversation goes to all its pieces: by a key that a long one does not share
    first = pieces.where("piece = 0").select("conv_id", "length").join(of_conv, "conv_id", "left")
    spread = first.select("conv_id", "leaf", "alone_from", F.explode(F.sequence(F.lit(0).cast("bigint"), _piece(F.col("length")))).alias("piece"))
    told = pieces.join(spread, ["conv_id", "piece"]).join(of_piece.drop("own"), ["conv_id", "piece"], "left").join(later, ["conv_id", "piece"], "left")
    told = told.fillna({"leaf": 0, "later": 0, "alone_from": (1 << 62)})
    shares = parts.groupBy("base", "piece").cogroup(told.groupBy("base", "piece")).applyInPandas(_family_shares, "a bigint, b bigint, n_leaves bigint, saved bigint")
    return shares.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id.  Parents with very many children go to all tasks, the others are joined."""
    least = max(10, nodes.count() // HOT_SHARE)
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") >= least).drop("n_children"))
    below = nodes.where("depth > 0")
    rest = below.join(hot, ["pa", "pb"], "left_anti").join(parents.where((F.col("n_children") > 0) & (F.col("n_children") < least)).drop("n_children"), ["pa", "pb"])
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return below.join(hot, ["pa", "pb"]).unionByName(rest).unionByName(root)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: a, b (its name), pa, pb (its parent's), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn, a null one first, ties by role and then by a
    hash of the text; equal rows are turns of their own.  Null role or text
    counts as empty.  Rows without a conv_id belong to no conversation and are
    left out.  Other columns are not read; without a conversation there is no
    node, not even the root.
    """
    turns = _turns(conversations)
    convs = _conversations(turns)
    parts = _own_parts(turns, convs)
    pieces = _pieces(parts, convs)
    families = parts.groupBy("base", "piece").cogroup(pieces.groupBy("base", "piece")).applyInPandas(_family_nodes, _NODE)
    nodes = _merged(park(families, "trie-families"))
    rows = _with_parents(nodes).join(_shares(nodes, parts, pieces), ["a", "b"], "left")
    alone = F.col("n_convs") == 1  # its subtree is a chain of its only member
    return rows.select(
        "a", "b", "pa", "pb", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(alone, 1).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "ends_sha256",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("a", "b", "pa", "pb")


ORACLE = f"""
with src as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(strlen(role) || ':' || role || text)) - 1 as p from src),
c as (select *, conv_id - conv_id % {FAMILY} as base, {crc_sql("conv_id")} % {MOST_SHARED} as h from (select conv_id, count(*) as n from t group by conv_id) x),
turns as (select c.conv_id, p + 1 as d, role, text from c join t on t.conv_id = c.base and p < c.h
  union all select c.conv_id, p - c.h + least(c.h, coalesce(b.n, 0)) + 1, role, text from c join t using (conv_id) left join c b on b.conv_id = c.base where p >= c.h),
whole as (select c.conv_id, list(strlen(role) || ':' || role || strlen(text) || ':' || text order by d) filter (where d is not null) as s, list(length(text) order by d) filter (where d is not null) as ns
  from c left join turns using (conv_id) group by c.conv_id),
paths as (select conv_id, d, sha256(array_to_string(coalesce(s, [])[1:d], '')) as key, sha256(array_to_string(coalesce(s, [])[1:d - 1], '')) as up, case when d = 0 then 0 else ns[d] end as chars, d = coalesce(len(s), 0) as ends
  from (select *, unnest(range(coalesce(len(s), 0) + 1)) as d from whole) x),
nodes as (select key, d, any_value(up) as up, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n, sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (where ends), '')) as ends from paths group by key, d),
kids as (select up as key, d - 1 as d, count(*) as n_children from nodes where d > 0 group by all),
below as (select p.key, p.d, sum((u.n - 1) * u.chars) as saved, count(*) filter (where k.n_children is null) as n_leaves
  from nodes u left join kids k using (key, d) join paths p on p.conv_id = u.conv_id and p.d <= u.d group by all)
select v.conv_id, v.d as depth, u.conv_id as parent_conv_id, v.n as n_convs, coalesce(n_children, 0) as n_children, b.n_leaves, cast(b.saved as bigint) as saved_tokens, v.ends as ends_sha256
from nodes v left join kids using (key, d) join below b using (key, d) left join nodes u on u.key = v.up and u.d = v.d - 1
"""
