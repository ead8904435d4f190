"""Token ids in a binary format with one shared zstandard dictionary.

A file image holds up to ``SEGMENT_DOCS`` documents in ascending doc_id order:
header (magic, id width, document count, SHA-256 of the dictionary), document
ids, frame offsets, token counts, then one zstandard frame per document, so
that a short document is read by its offset without its neighbours.  Images
are rows of a Parquet table (bucket, seq, first_id, last_id, tokens_before,
n_tokens, image; the ids are those of the first and last document), the
dictionary is a one-row table beside it; any store that Spark writes to holds
them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import partitions, shared_dir, small_batches, table, trim

MAGIC = b"TRMIDS1\n"
HEAD = struct.Struct("<8sIIQ32s")
END_ID = 2
SEGMENT_DOCS, SEGMENT_BYTES = 1024, 1 << 20
DICT_BYTES = 64 << 10
SAMPLE_DOCS, SAMPLE_CHARS = 512, 20_000  # the dictionary is trained on at most so many documents, none longer
CACHED_CHUNKS = 300_000  # of a Python worker, some 200 bytes each
PUNCTUATION = ".,;:!?#*$%&|<>()[]{}\"/-_=+~"  # neither letters, digits, white space nor apostrophes
KEPT_CHUNKS = 100_000  # of them between tasks
LINE, LAST = "\ue000", "\ue000\ue000"  # mark a chunk after a line break, and the line break that ends a text
GROUP_CHARS = 1 << 23  # texts that are encoded together
SLICE = 2048  # documents of an Arrow batch that are encoded together
_coders: dict[str, Coder] = {}


class Coder:
    """Encodes texts chunk by chunk, each distinct chunk of a group of texts once.

    Ids are kept in two generations: when the young one is full it becomes the
    old one, whose chunks come back as they are met.

    The byte-level pre-tokenizer starts a new piece at every space that a
    non-space follows, and takes a line break between non-spaces for a piece
    of its own, so that ids of " word", or of a line break and the word after
    it, don't depend on their neighbours; a word of letters and the
    punctuation after it are pieces of their own.  Texts that are cut in
    another way (a space before white space or at the end, strings of the
    tokenizer's special tokens) are encoded whole, as are all texts for
    tokenizers of another kind.
    """

    def __init__(self, name: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import numpy as np
        from tokenizers import Tokenizer

        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.whole = [LINE, *(x.content for x in self.tokenizer.get_added_tokens_decoder().values())]
        self.young: dict[str, bytes] = {LAST: self._ids(["\n"])[0]}
        self.old: dict[str, bytes] = {}
        if self.by_chunk:
            vocab = self.tokenizer.get_vocab()
            self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.n_bytes[i] = len(token)  # a character of the vocabulary stands for a byte

    def forget(self) -> None:
        """Keep the chunks that came first, which are the frequent ones."""
        self.old, self.young = {}, dict(islice(self.young.items(), KEPT_CHUNKS)) | {LAST: self.young[LAST]}

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that are pieces of their own in their concatenation, cut from those of it."""
        import numpy as np

        some = [parts[i : i + 1000] for i in range(0, len(parts), 1000)]
        out: list[bytes] = []
        for own, found in zip(some, self.tokenizer.encode_batch_fast(["".join(x) for x in some], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(x.encode()) for x in own])) + 1
            at = [0, *(ends * ids.itemsize).tolist()]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _of_chunks(self, chunks: list[str]) -> list[bytes | None]:
        """The ids of each of ``chunks``, which are distinct; None if it can't be encoded alone."""
        if len(self.young) > CACHED_CHUNKS // 2:
            self.old, self.young = self.young, {LAST: self.young[LAST]}
        young, old = self.young, self.old
        known = list(map(young.get, chunks))
        missing = []
        for k, ids in enumerate(known):
            if ids is None:
                chunk = chunks[k]
                back = old.get(chunk)
                if back is None:
                    missing.append(k)
                else:
                    young[chunk] = known[k] = back
        alone = [k for k in missing if chunks[k].removeprefix(LINE)[:1].strip()]
        young |= dict.fromkeys([chunks[k] for k in missing], b"")
        parts = [chunks[k] for k in alone]
        for k, chunk, ids in zip(alone, parts, self._joined(["\n" + x[1:] if x[0] == LINE else " " + x for x in parts]), strict=True):
            young[chunk] = known[k] = ids
        return [ids or None for ids in known]

    def _marked(self, text: str) -> str | None:
        """A text whose chunks begin at spaces; None if it is to be encoded whole."""
        if any(x in text for x in self.whole):
            return None
        if "\n\n" in text:  # a line break beside white space can be part of a longer piece
            return text
        last = text[-1:] == "\n" and text[-2:-1].strip() != ""
        text = (text[:-1] if last else text).replace("\n", f" {LINE}")
        return f"{text} {LAST}" if last else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.by_chunk:
            return self._ids(texts)
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = [self._marked(x) for x in texts]
        chunks = pc.split_pattern(pa.array([x or "" for x in marked], pa.large_string()), " ")
        first = chunks.offsets.to_numpy()
        distinct = chunks.values.dictionary_encode()
        # punctuation after a letter is a piece of its own
        stems = pc.utf8_rtrim(distinct.dictionary, PUNCTUATION)
        cut = pc.and_(pc.match_substring_regex(stems, r"\p{L}$"), pc.not_equal(stems, distinct.dictionary))
        tails = pa.array([x[len(y) :] for x, y in zip(distinct.dictionary.filter(cut).to_pylist(), stems.filter(cut).to_pylist(), strict=True)], pa.string()).dictionary_encode()
        tail_ids = pa.array(self._ids(tails.dictionary.to_pylist()), pa.large_binary()).take(tails.indices)
        stems = pc.if_else(cut, stems, distinct.dictionary).dictionary_encode()
        ids = pa.array(self._of_chunks(stems.dictionary.to_pylist()), pa.large_binary()).take(stems.indices)
        ids = pc.replace_with_mask(ids, cut, pc.binary_join_element_wise(ids.filter(cut), tail_ids, pa.scalar(b"", pa.large_binary())))
        ids_of = ids.take(distinct.indices)
        _, ends, data = ids_of.buffers()
        ends, data = np.frombuffer(ends, np.int64, len(ids_of) + 1), memoryview(data or b"")
        odd = np.cumsum(np.append(0, np.diff(ends) == 0))  # how many chunks before have no ids
        odd = odd[first[1:]] > odd[first[:-1] + 1]
        heads = self._ids([(x or "").partition(" ")[0] for x in marked])
        whole = [k for k, x in enumerate(marked) if x is None or odd[k]]
        own = dict(zip(whole, self._ids([texts[k] for k in whole]), strict=True))
        at = zip(ends[first[:-1] + 1].tolist(), ends[first[1:]].tolist(), strict=True)
        return [own[k] if k in own else head + data[a:b] for k, (head, (a, b)) in enumerate(zip(heads, at, strict=True))]


def coder(name: str) -> Coder:
    if name not in _coders:
        _coders[name] = Coder(name)
    return _coders[name]


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary from the serialized ids of a bounded sample, first by a hash of doc_id."""
    import zstandard

    first = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.join(F.broadcast(first.distinct()), "doc_id").where(F.length("text").between(1, SAMPLE_CHARS)).select("text").limit(SAMPLE_DOCS)
    samples = coder(tokenizer).encode(sorted(r[0] for r in rows.collect()))
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def pack_image(ids: list, frames: list[bytes], counts: list[int], width: int, dict_sha: bytes) -> bytes:
    import numpy as np

    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
    known = np.array([x is not None for x in ids], "u1")
    values = np.array([0 if x is None else x for x in ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, 1, width, len(ids), dict_sha), known.tobytes(), values.tobytes(), offsets.tobytes(), np.array(counts, "<u8").tobytes(), *frames])


class Image:
    """Random access to the documents of a file image."""

    def __init__(self, data: bytes, dictionary: bytes):
        import numpy as np
        import zstandard

        magic, version, self.width, n, dict_sha = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token-id file image")
        if dict_sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the image was written with another dictionary")
        at = HEAD.size
        known = np.frombuffer(data, "u1", n, at)
        values = np.frombuffer(data, "<i8", n, at + n)
        self.ids = [int(v) if k else None for k, v in zip(known, values, strict=True)]
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 9 * n)
        self.counts = np.frombuffer(data, "<u8", n, at + 17 * n + 8)
        self.start = at + 25 * n + 8
        self.data = memoryview(data)
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, k: int):
        """The ids of document ``k``."""
        import numpy as np

        a, b = (self.start + int(x) for x in self.offsets[k : k + 2])
        raw = self.reader.decompress(self.data[a:b], max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


class Buckets:
    """Ranges of doc_id that are written as one partition each, in order.

    ``found`` holds the ids at equal steps of the sorted ids, so that an id
    with many rows is in it several times; such an id, and a null id with as
    many rows, has buckets of its own, among which its rows are dealt.
    """

    def __init__(self, found: list[int], nulls: int):
        from collections import Counter

        import numpy as np

        heavy = {x: n for x, n in Counter(found).items() if n > 1}
        self.bounds = sorted({*found, *(x - 1 for x in heavy)})
        self.ways = np.array([*(heavy.get(x, 1) for x in self.bounds), 1, max(1, nulls)])
        self.first = np.cumsum(self.ways) - self.ways

    def of(self, ids: list[int | None], row: int):
        """The bucket of each id, for rows that begin with number ``row`` of their task."""
        import numpy as np

        known = np.array([x is not None for x in ids], bool)
        values = np.array([x if x is not None else 0 for x in ids], np.int64)
        k = np.where(known, np.searchsorted(np.array(self.bounds, np.int64), values), len(self.bounds) + 1)
        return self.first[k] + (row + np.arange(len(ids))) % self.ways[k]


def _encode(tokenizer: str, dictionary: bytes, buckets: Buckets, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        code = coder(tokenizer)
        write = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(dictionary), write_content_size=True, write_checksum=False)
        end = np.array([end_id], code.dtype).tobytes()
        width = len(end)
        row = 0
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                part = batch.column("doc_id").to_pylist()
                raw = [x + end for x in code.encode([x or "" for x in batch.column("text").to_pylist()])]
                frames = [write.compress(x) for x in raw]
                counts = [len(x) // width for x in raw]
                del raw
                yield pa.RecordBatch.from_arrays([pa.array(buckets.of(part, row), pa.int32()), pa.array(part, pa.int64()), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["bucket", "doc_id", "n", "frame"])
                row += len(part)
                del frames
            trim()
        code.forget()  # a worker that waits for its next task keeps little
        trim()

    return run


def _pack(width: int, dict_sha: bytes):
    """Rows sorted by (bucket, doc_id) to file images."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bucket, seq, before, size = None, 0, 0, 0
        docs: list[tuple] = []

        def image():
            ids, counts, frames = zip(*docs, strict=True)
            data = pack_image(list(ids), list(frames), list(counts), width, dict_sha)
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([seq], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([max((x for x in ids if x is not None), default=None)], pa.int64()), pa.array([before], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([data], pa.binary())],
                ["bucket", "seq", "first_id", "last_id", "tokens_before", "n_tokens", "image"],
            )

        for batch in batches:
            for b, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "frame")), strict=True):
                if docs and (b != bucket or len(docs) >= SEGMENT_DOCS or size >= SEGMENT_BYTES):
                    yield image()
                    seq, before = seq + 1, before + sum(x[1] for x in docs)
                    docs, size = [], 0
                if b != bucket:
                    bucket, seq, before = b, 0, 0
                docs.append((doc_id, n, frame))
                size += len(frame)
        if docs:
            yield image()

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> None:
    """Encode ``documents`` and write images and dictionary under ``path``.

    A null or empty text is the end id alone; documents with a null doc_id
    come last; rows with equal doc_id follow one another, in no set order;
    other columns are not read; an empty table gives no images.  The format
    holds ids of 64 bits: a doc_id of another type is cast, and a text that is
    no number is an error.  ``tokenizer``: a file of the public tokenizers or a path.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    n = partitions(spark)
    found = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("ids"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    buckets = Buckets(list(found["ids"] or []), -(-n * found["nulls"] // max(1, found["rows"])))
    frames = docs.mapInArrow(_encode(tokenizer, dictionary, buckets, end_id), "bucket int, doc_id bigint, n bigint, frame binary")
    ordered = frames.repartition(n, "bucket").sortWithinPartitions("bucket", F.asc_nulls_last("doc_id"), "frame")
    width = int(coder(tokenizer).dtype[-1])
    images = ordered.mapInArrow(_pack(width, hashlib.sha256(dictionary).digest()), "bucket int, seq bigint, first_id bigint, last_id bigint, tokens_before bigint, n_tokens bigint, image binary")
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").write.parquet(f"{path}/dictionary")
    with small_batches(spark):
        images.write.parquet(f"{path}/images")


def _decode(dictionary: bytes, starts: dict[int, int]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for bucket, before, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokens_before", "image")), strict=True):
                image = Image(data, dictionary)
                tokens = [image.tokens(k).astype("<u4") for k in range(len(image))]
                start = starts[bucket] + before + np.cumsum([0, *map(len, tokens)])[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(image.ids, pa.int64()), pa.array(start, pa.int64()), pa.array(tokens, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))] if run.with_ids else
                    [pa.array(image.ids, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in tokens], pa.int64()), pa.array([zlib.crc32(x) for x in tokens], pa.int64())],
                    ["doc_id", "start", "ids"] if run.with_ids else ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    run.with_ids = False
    return run


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, and ids or else n_tokens and ids_crc32, from the files.

    Only the token total of each bucket, one number per written partition,
    comes to the driver.  One row per document written, repeated and null
    doc_ids included; an empty text has the end id alone; files without
    documents give no rows.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    images = spark.read.parquet(f"{path}/images")
    starts, at = {}, 0
    for bucket, n in images.groupBy("bucket").agg(F.sum("n_tokens")).orderBy("bucket").collect():
        starts[bucket], at = at, at + n
    decode = _decode(dictionary, starts)
    decode.with_ids = ids
    return images.select("bucket", "tokens_before", "image").mapInArrow(decode, "doc_id bigint, start bigint, " + ("ids array<int>" if ids else "n_tokens bigint, ids_crc32 bigint"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of single documents: ranges of ids in the images' columns leave all other images
    unread, and of an image only the frames asked for are decompressed.

    All rows of a repeated doc_id are found; ids that were never written, and an empty list, give no rows; documents
    without doc_id can't be asked for."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    wanted = frozenset(doc_ids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("image").to_pylist():
                image = Image(data, dictionary)
                own = [k for k, x in enumerate(image.ids) if x in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([image.ids[k] for k in own], pa.int64()), pa.array([image.tokens(k).tolist() for k in own], pa.list_(pa.int32()))], ["doc_id", "ids"])

    holds = [f"first_id <= {int(x)} and last_id >= {int(x)}" for x in sorted(wanted)]
    return spark.read.parquet(f"{path}/images").where(" or ".join(holds) or "false").select("image").mapInArrow(run, "doc_id bigint, ids array<int>")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
