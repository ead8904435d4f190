"""Benchmark decontamination by template canonicalisation, in SQL functions only.

Numbers, names and units become typed placeholders, so that a question with
other figures or names keeps its template.  A word of mixed case is a name,
also where it begins a sentence: as a slot it stands for a name or for itself.
Windows of template tokens of all documents are hash-joined with those of the
benchmark; along each alignment of document and item, a slot value of the item
must stand for one value of the document only.  An item that is mostly
placeholders (figures, lists of names) has no template to speak of; its
windows of few literals are looked up by their own words.  So are windows that
hold a name, besides: in a text of other letter case names can't be told.
A number is one token with its separators: ``1,200`` is ``1200``, ``5.5`` a number
of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import park, table

WINDOW = 8  # template tokens; a shorter item is one window of its own length
LITERALS = 0.5  # share of a window's tokens that must not be placeholders
KEY_BITS = 17  # last bits of keys by which windows are tried before the join
LEAST_SHARE, LEAST_WINDOWS = 0.25, 2  # of an item's windows, to call it found
BROADCAST_BYTES = 64 << 20  # benchmark windows and keys of documents that are sent to all tasks; more are joined by shuffle

# Units after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "inch inches foot feet yard yards mile miles meter meters metre metres gram grams pound pounds ounce ounces liter liters litre litres percent dollar dollars euro euros cent cents usd eur mph kmh kb mb gb w kw v a hz khz mhz c f"
).split()
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
SEPARATORS = r"[^a-z0-9A-Z\p{L}\p{N}]+"  # the ranges are letters and digits too, but told without a look at a character's category
POINT = "\u02d1"  # a letter that stands for the point inside a number


def _raw(text: Column) -> Column:
    # the sign comes first, so that what is beside it is looked at only there
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r",(?<=[0-9],)(?=[0-9])", "")
    text = F.regexp_replace(text, r"\.(?<=[0-9]\.)(?=[0-9])", POINT)
    return F.array_remove(F.split(text, SEPARATORS), "")


def _number(x: Column) -> Column:
    return (x >= "0") & (x < ":")  # a digit comes first


def _canonical(raw: Column) -> Column:
    """Template tokens."""
    before = F.concat(F.array(F.lit("")), raw)

    def token(x: Column, prev: Column) -> Column:
        low = F.lower(x)
        return (
            F.when(_number(x), NUM)
            .when(_number(prev) & low.isin(UNITS), UNIT)
            .when((x != low) & (x != F.upper(x)), NAME)
            .otherwise(low)
        )

    return F.filter(F.zip_with(raw, before, lambda x, p: F.when(x.isNotNull(), token(x, p))), lambda t: t.isNotNull())


def _hashes(tokens: Column) -> Column:
    """Each token is hashed once, not once for each window that it is in."""
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _canonical_hashes(raw: str, low: str, hashes: str) -> Column:
    """``_hashes(_canonical(raw))`` from the columns of tokens, of lower-cased ones and of their hashes."""

    def of(x: Column, i: Column) -> Column:
        small = F.get(F.col(low), i)
        return (
            F.when(_number(x), F.xxhash64(F.lit(NUM)))
            .when(_number(F.get(F.col(raw), i - 1)) & small.isin(UNITS), F.xxhash64(F.lit(UNIT)))
            .when(x == small, F.get(F.col(hashes), i))
            .when(x != F.upper(x), F.xxhash64(F.lit(NAME)))
            .otherwise(F.get(F.col(hashes), i))
        )

    return F.transform(raw, of)


def _windows(size: Column, of: Column, literal: bool) -> Column:
    """Keys of all slices of ``size`` token hashes, none if there are fewer."""
    n = F.size(of) - size + 1
    places = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(of, i, size), F.lit(int(literal))))


def _placed(size: int, of: str, literal: bool) -> Column:
    """place and key of the same windows.  The hash of a slice is that of its elements in turn, which are got one by one."""
    h = F.col(of)
    key = lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)], F.lit(int(literal)))
    return F.slice(F.transform(h, lambda x, i: F.struct(i.alias("place"), key(x, i).alias("key"))), 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))


def _bits(bench: DataFrame) -> list[int]:
    """A set of 2 ** KEY_BITS bits, as longs: those that the benchmark's keys end in.  16 KB, however many keys there are."""
    import numpy as np

    low = F.col("key").bitwiseAND((1 << KEY_BITS) - 1)
    found = np.zeros((1 << KEY_BITS - 15, 512), "<i8")
    for part, bits in bench.select(low.alias("k")).groupBy(F.shiftright("k", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("k").bitwiseAND(32767))).collect():
        found[part] = np.frombuffer(bytes(bits), "<i8")
    return found.ravel().tolist()


def _maybe(placed: Column, bits: list[int]) -> Column:
    """Without most of the windows whose key is none of the benchmark's, before each becomes a row."""
    known = F.lit(bits)

    def of(w: Column) -> Column:
        at = w["key"].bitwiseAND((1 << KEY_BITS) - 1)
        return F.getbit(F.get(known, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    return F.filter(placed, of)


def _lower(raw: Column) -> Column:
    return F.transform(raw, F.lower)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, at, size, literal, n_windows, key and values (slot values, null for literals) of the windows with
    enough literals, and of all windows of items that have few of them.  ``literal``: the key is of the words
    themselves, which windows with a name have as well."""
    items = benchmark.select("item_id", "text").dropDuplicates().where("item_id is not null")
    items = items.withColumn("raw", _raw(F.col("text"))).select("item_id", "raw", _canonical(F.col("raw")).alias("c")).where(F.size("c") > 0)
    items = items.withColumn("size", F.least(F.lit(WINDOW), F.size("c")))
    items = items.withColumns({"th": _hashes(F.col("c")), "wh": _hashes(_lower(F.col("raw")))})
    keys = F.arrays_zip(_windows(F.col("size"), F.col("th"), False).alias("t"), _windows(F.col("size"), F.col("wh"), True).alias("w"))
    rows = items.select("item_id", "raw", "c", "size", F.posexplode(keys).alias("k", "keys"))
    tokens = F.slice("c", F.col("k") + 1, F.col("size"))
    slots = F.zip_with(tokens, F.slice("raw", F.col("k") + 1, F.col("size")), lambda t, r: F.when(t.isin(NUM, NAME, UNIT), F.lower(r)))
    rows = rows.select("item_id", F.col("k").alias("at"), "size", "keys", slots.alias("values"), F.array_contains(tokens, NAME).alias("named"))
    rows = rows.withColumn("literal", F.size(F.array_compact("values")) > (1 - LITERALS) * F.col("size"))
    n = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("literal")).alias("n_rich"))
    rows = rows.join(n, "item_id").withColumn("poor", 2 * F.col("n_rich") < F.col("n_all")).where("poor or not literal")
    ways = F.when(F.col("literal"), F.array(F.lit(True))).when(F.col("named"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("literal", F.explode(ways))
    none = F.transform("values", lambda _: F.lit(None).cast("string"))
    return rows.select(
        "item_id", "at", "size", "literal", F.when(F.col("poor"), F.col("n_all")).otherwise(F.col("n_rich")).alias("n_windows"),
        F.when(F.col("literal"), F.col("keys")["w"]).otherwise(F.col("keys")["t"]).alias("key"), F.when(F.col("literal"), none).otherwise(F.col("values")).alias("values"),
    )


def contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_key, item_id, n_hit, n_windows, exact: the items found in documents.

    ``exact``: all slots have the item's values.  Null and empty texts hold
    nothing; a null doc_id is a document like others; rows with equal doc_id
    and text give one row (text_key, a hash of the text, tells others apart);
    items without an id or words are left out; other columns are not read;
    empty tables give an empty result.
    """
    bench = park(benchmark_windows(benchmark), "benchmark-windows")
    kinds = sorted(map(tuple, bench.select("size", "literal").distinct().collect()))  # two for each length up to WINDOW at most
    bytes_of = bench.agg(F.sum(150 + 32 * F.col("size") + F.length(F.array_join("values", "")))).first()[0] or 0
    bench = F.broadcast(bench) if bytes_of <= broadcast_bytes else bench
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    # one pass: the keys of all kinds of windows, tokens and their hashes worked out once
    rows = docs.select("doc_id", "text_key", _raw(F.col("text")).alias("raw"))
    rows = rows.select("doc_id", "text_key", "raw", _lower(F.col("raw")).alias("low"))
    rows = rows.select("doc_id", "text_key", "raw", "low", _hashes(F.col("low")).alias("h1"))
    rows = rows.select("doc_id", "text_key", "h1", *([_canonical_hashes("raw", "low", "h1").alias("h0")] if any(not literal for _, literal in kinds) else []))

    placed = [_placed(size, f"h{int(literal)}", literal) for size, literal in kinds]
    windows = _maybe(F.concat(*placed), _bits(bench)) if placed else F.array().cast("array<struct<place:int,key:bigint>>")
    # outer, lest the optimizer works the windows out once more to leave empty ones out
    keys = rows.select("doc_id", "text_key", F.explode_outer(windows).alias("w")).select("doc_id", "text_key", "w.place", "w.key")
    # only keys go through the join
    found = keys.join(bench, "key").select("doc_id", "text_key", "place", "item_id", "n_windows", "at", "size", "values")
    found = park(found, "benchmark-hits")
    wanted = park(found.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key")).distinct(), "benchmark-docs")
    wanted = F.broadcast(wanted) if 100 * wanted.count() <= broadcast_bytes else wanted
    on = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_key"))
    raws = docs.join(wanted, on).select("of_doc", "of_key", _raw(F.col("text")).alias("raw")).dropDuplicates(["of_doc", "of_key"])
    own = F.zip_with("values", F.slice("raw", F.col("place") + 1, F.col("size")), lambda v, r: F.when(v.isNotNull(), F.struct(v.alias("item"), F.lower(r).alias("doc"))))
    found = found.join(raws, on).select("doc_id", "text_key", "item_id", "n_windows", "at", (F.col("place") - F.col("at")).alias("shift"), F.array_compact(own).alias("slots"))
    # slots of an alignment: pairs of values, each item value with one document value
    along = found.groupBy("doc_id", "text_key", "item_id", "n_windows", "shift").agg(F.collect_set("at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    same = F.size(F.array_distinct(F.transform("slots", lambda s: s["item"]))) == F.size("slots")
    along = along.where(same).withColumn("exact", ~F.exists("slots", lambda s: s["item"] != s["doc"]))
    per_item = along.groupBy("doc_id", "text_key", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_hit"), F.max("exact").alias("exact"))
    least = F.least(F.col("n_windows"), F.greatest(F.lit(LEAST_WINDOWS), F.ceil(LEAST_SHARE * F.col("n_windows"))))
    return per_item.where(F.col("n_hit") >= least).select("doc_id", "text_key", "item_id", "n_hit", "n_windows", "exact")


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item, with all their columns.

    Null and empty texts stay.  Of rows with one doc_id, or none, those go whose
    own text holds an item, with all their repetitions; columns may have any
    name; an empty benchmark takes nothing, an empty table stays empty.
    """
    found = contaminated(documents, benchmark).select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key")).distinct()
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    on = F.col("row.doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("row.text") == F.col("of_key"))
    return row.join(found, on, "left_anti").select("row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
_DIGIT = "(substr({0}, 1, 1) between '0' and '9')"
_TOKEN = f"""case when {_DIGIT.format("x")} then '{NUM}'
  when i > 1 and {_DIGIT.format("raw[i - 1]")} and lower(x) in ({_UNIT_LIST}) then '{UNIT}' when x <> lower(x) and x <> upper(x) then '{NAME}' else lower(x) end"""


# a digit belongs to one match of a pass: a second pass has the separators between single digits
_NUMBERS = "t"
for _mark, _by in ((",", ""), ("[.]", POINT)):
    for _ in range(2):
        _NUMBERS = f"regexp_replace({_NUMBERS}, '([0-9]){_mark}([0-9])', '\\1{_by}\\2', 'g')"


def _sql_tokens(source: str, key: str) -> str:
    return f"""(select {key}, t, raw, list_transform(raw, lambda x, i: {_TOKEN}) as c from (
    select {key}, t, list_filter(string_split_regex({_NUMBERS}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as raw
    from (select distinct {key}, coalesce(text, '') as t from {source}) s) r)"""


ORACLE = f"""
with items as (select *, least({WINDOW}, len(c)) as size from {_sql_tokens("benchmark", "item_id")} b where len(c) > 0 and item_id is not null),
bw as (select item_id, size, k as spot, c[k:k + size - 1] as key, list_transform(raw[k:k + size - 1], lambda r: lower(r)) as own,
    list_transform(range(k, k + size), lambda j: case when c[j] in ('{NUM}', '{NAME}', '{UNIT}') then lower(raw[j]) end) as vals
  from (select *, unnest(range(1, len(c) - size + 2)) as k from items) t),
bl as (select *, len(list_filter(vals, lambda v: v is not null)) > {1 - LITERALS} * size as literal from bw),
bn as (select *, count(*) over (partition by item_id) as n_all, count(*) filter (where not literal) over (partition by item_id) as n_rich from bl),
bench as (select item_id, size, spot, way as literal, case when way then own else key end as key, case when way then list_transform(vals, lambda v: cast(null as varchar)) else vals end as vals,
    case when 2 * n_rich < n_all then n_all else n_rich end as n_windows
  from (select *, unnest(case when literal then [true] when list_contains(key, '{NAME}') then [false, true] else [false] end) as way from bn) x where 2 * n_rich < n_all or not literal),
docs as {_sql_tokens("documents", "doc_id")},
dw as (select doc_id, t, size, literal, k as place, case when literal then list_transform(raw[k:k + size - 1], lambda r: lower(r)) else c[k:k + size - 1] end as key, raw[k:k + size - 1] as raw
  from (select doc_id, t, size, literal, raw, c, unnest(range(1, len(c) - size + 2)) as k from docs, (select distinct size, literal from bench) z) t),
hits as (select doc_id, t, item_id, n_windows, spot, place - spot as shift,
    list_transform(range(1, d.size + 1), lambda j: case when vals[j] is not null then vals[j] || chr(2) || lower(raw[j]) end) as pairs
  from dw d join bench b on d.size = b.size and d.literal = b.literal and d.key = b.key),
pairs as (select distinct doc_id, t, item_id, shift, p from (select doc_id, t, item_id, shift, unnest(pairs) as p from hits) u where p is not null),
slots as (select doc_id, t, item_id, shift, count(*) = count(distinct split_part(p, chr(2), 1)) as same, bool_and(split_part(p, chr(2), 1) = split_part(p, chr(2), 2)) as exact from pairs group by all),
good as (select h.doc_id, h.t, h.item_id, h.n_windows, h.spot, coalesce(s.exact, true) as exact from hits h left join slots s
  on h.doc_id is not distinct from s.doc_id and h.t = s.t and h.item_id = s.item_id and h.shift = s.shift where coalesce(s.same, true)),
found as (select doc_id, t, item_id, n_windows, cast(count(distinct spot) as bigint) as n_hit, bool_or(exact) as exact from good group by doc_id, t, item_id, n_windows)
select doc_id, item_id, n_hit, cast(n_windows as bigint) as n_windows, exact from found
where n_hit >= least(n_windows, greatest({LEAST_WINDOWS}, ceil({LEAST_SHARE} * n_windows)))
"""
