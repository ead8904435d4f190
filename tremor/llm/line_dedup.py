"""Corpus-wide line de-duplication with a once-seen and a twice-seen Bloom filter.

Pass 1 fills, per task, a filter of line keys seen and one of keys seen again,
and merges them over tasks (bits set in two once-seen filters go to the
twice-seen one, which so holds every key of two or more documents).  Pass 2
lets only lines in the twice-seen filter, the suspects, reach a shuffle, where
their documents are counted exactly.  Pass 3 drops the confirmed keys.

The filters have a fixed upper size.  A crowded filter only lets more suspects
through; the counts behind it stay exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import UPPER, WS, binaries, park, table

HASHES = 4
SEGMENT = 1 << 16  # bytes of a filter that travel together
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # 128 KB to 32 MB
BROADCAST_KEYS = 500_000  # confirmed keys (16 bytes each) that are sent to all tasks; more are joined


def _keys(text: bytes) -> list[bytes]:
    return [x.strip(WS) for x in text.lower().split(b"\n")]


def _digest(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _places(digests: list[bytes], bits: int):
    import numpy as np

    pair = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    step = pair[:, 1] | np.uint64(1)
    at = pair[:, :1] + step[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (at & np.uint64(bits - 1)).astype(np.int64)


def _has(bloom, at):
    return ((bloom[at >> 3] >> (at & 7).astype("uint8")) & 1).all(axis=1)


def _put(bloom, at) -> None:
    import numpy as np

    at = at.ravel()
    np.bitwise_or.at(bloom, at >> 3, np.left_shift(1, at & 7).astype("uint8"))


def _filters(bits: int):
    """Task of pass 1: one row per filter segment that is not empty."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        once, twice = np.zeros(bits >> 3, "uint8"), np.zeros(bits >> 3, "uint8")
        for batch in batches:
            texts = binaries(batch, "text")
            for i in range(0, len(texts), 512):
                seen: set[bytes] = set()
                again: set[bytes] = set()
                for text in texts[i : i + 512]:
                    keys = set(_keys(text))
                    again |= seen & keys
                    seen |= keys
                seen.discard(b"")
                again.discard(b"")
                if again:
                    _put(twice, _places([_digest(x) for x in again], bits))
                if seen:
                    at = _places([_digest(x) for x in seen], bits)
                    known = _has(once, at)
                    _put(twice, at[known])
                    _put(once, at[~known])
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, bits >> 3, SEGMENT):
            a, b = once[k : k + SEGMENT], twice[k : k + SEGMENT]
            if a.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k // SEGMENT], pa.int32()), pa.array([pack(a.tobytes())], pa.binary()), pa.array([pack(b.tobytes())], pa.binary())],
                    ["segment", "once", "twice"],
                )

    return run


def _merge(x: tuple[bytes, bytes], y: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
    import numpy as np
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    (a1, a2), (b1, b2) = ([np.frombuffer(unpack(v), "uint8") for v in z] for z in (x, y))
    pack = zstandard.ZstdCompressor(level=1).compress
    return pack((a1 | b1).tobytes()), pack((a2 | b2 | (a1 & b1)).tobytes())


def twice_seen(docs: DataFrame, bits: int) -> bytes:
    """The merged twice-seen filter: ``bits`` / 8 bytes, whatever the input."""
    import zstandard

    rows = docs.select("text").mapInArrow(_filters(bits), "segment int, once binary, twice binary").rdd
    merged = rows.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2])))).reduceByKey(_merge).mapValues(lambda v: v[1])
    out = bytearray(bits >> 3)
    unpack = zstandard.ZstdDecompressor().decompress
    for segment, twice in merged.toLocalIterator():
        part = unpack(twice)
        out[segment * SEGMENT : segment * SEGMENT + len(part)] = part
    return bytes(out)


def _suspects(bloom_of, bits: int):
    """Task of pass 2: (doc_id, hash of the text, key) of the lines that may recur."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bloom = np.frombuffer(bloom_of.value, "uint8")
        for batch in batches:
            rows, digests = [], []
            for row, text in enumerate(binaries(batch, "text")):
                keys = set(_keys(text))
                keys.discard(b"")
                digests += map(_digest, keys)
                rows += [row] * len(keys)
            if digests:
                hit = np.flatnonzero(_has(bloom, _places(digests, bits))).tolist()
                own = pa.array([rows[i] for i in hit], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column("of_text").take(own), pa.array([digests[i] for i in hit], pa.binary())],
                    ["doc_id", "of_text", "key"],
                )

    return run


def _clean(keys_of):
    """Task of pass 3; ``keys_of``: broadcast keys, beside which a row may have its own in ``keys``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frequent = keys_of.value
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            own = batch.column("keys").to_pylist() if "keys" in batch.schema.names else [()] * batch.num_rows
            for text, more in zip(binaries(batch, "text"), own, strict=True):
                lines = text.split(b"\n")
                kept = lines
                if frequent or more:
                    more = set(more)
                    digests = [_digest(x) if x else b"" for x in _keys(text)]
                    kept = [x for x, key in zip(lines, digests, strict=True) if not (key in frequent or key in more)]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    return run


def frequent_keys(docs: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(suspects, confirmed): the lines that may recur and the keys that do."""
    spark = docs.sparkSession
    bloom = spark.sparkContext.broadcast(twice_seen(docs, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()
    suspects = park(docs.mapInArrow(_suspects(bloom, bits), f"doc_id {kind}, of_text bigint, key binary"), "line-suspects")
    counts = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    return suspects, park(counts.where(F.col("n_docs") >= min_docs), "line-keys")


def line_dedup(documents: DataFrame, min_docs: int = 10, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, text without the lines whose key is in ``min_docs`` documents,
    n_lines, n_dropped.

    Every row is one document, so a repeated row counts again.  A null or
    empty text is one empty line, which is never dropped; a null doc_id is a
    document like others; other columns are not read.  An empty table gives an
    empty result.  Confirmed keys go to all tasks if there are at most
    ``broadcast_keys``.  Of more, those with over 1 in ``broadcast_keys`` of
    all confirmed lines still do, which are fewer; the others, none of them
    hot, come by joins on key and doc_id.
    """
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("of_text"))  # so that many rows of a null doc_id are no group
    spark = docs.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (128 * docs.count()).bit_length()))
    suspects, confirmed = frequent_keys(docs, min_docs, bits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint"
    n_keys, n_found = confirmed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    hot = F.lit(True) if n_keys <= broadcast_keys else F.col("n_docs") * broadcast_keys > n_found
    keys = spark.sparkContext.broadcast({bytes(r[0]) for r in confirmed.where(hot).select("key").toLocalIterator()})
    if n_keys <= broadcast_keys:
        return docs.mapInArrow(_clean(keys), out)
    named = suspects.select(F.col("doc_id").alias("of_doc"), F.col("of_text").alias("with_text"), "key")
    per_doc = named.join(confirmed.where(~hot).select("key"), "key").groupBy("of_doc", "with_text").agg(F.collect_set("key").alias("keys"))
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("of_text") == F.col("with_text")), "left")
    empty = F.array().cast("array<binary>")
    return joined.select("doc_id", "text", F.coalesce("keys", empty).alias("keys")).mapInArrow(_clean(keys), out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
with lines as (
  select doc_id, i, ls[i] as line, translate(trim(ls[i], {_STRIP}), '{UPPER}', '{UPPER.lower()}') as key
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)) t),
frequent as (select key from lines where key <> '' group by key having count(distinct doc_id) >= 10),
marked as (select l.*, f.key is not null as gone from lines l left join frequent f on l.key = f.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
