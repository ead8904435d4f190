"""Trigram language model in Elias-Fano tries, one for each shard of words.

With counts c over the training documents, a word w after u v has

    p(w | u v) = (1 - d3) c(u v w) / c(u v)   if u v w was seen, else  d3 p(w | v)
    p(w | v)   = (1 - d2) c(v w) / c(v)       if v w was seen, else    d2 p(w)
    p(w)       = (c(w) + 1/2) / (N + V)

where d = a * c ** -b of the context's count c is the share left for unseen
words (1 for an unseen context): back-off with a linear discount that falls
with the context's count.  1/2 a type is left for as many unseen types.  The
sums over w stay below 1, as words seen after a context also have a part of
what is left for the others.

The logarithm is a sum of terms, each of counts of one word and its
neighbours, so that every occurrence goes to the shard of its word once, with
the two words before it and the one after: c(u v w), c(v w) and c(w) decide
there which of the three it is and its numerator; as a context for the next
word, c(u v), c(v) and what was seen after them give the rest.  A word with
over an eighth of a shard's tokens is spread over all shards by the word before
it, and such a pair by the word before both.  Their counts are known to all
tasks, and their parts as contexts v and u v are added where w is.  A shard merges the
counts of all blocks of documents into a trie (words; words before them, twice;
words after them, also after pairs; quantised log10 counts), looks each
distinct n-gram up in it, and sends back one sum for each document that it has
tokens of.  So all that travels is bounded by the tokens, whatever the number
of blocks and shards.  Which words and pairs are spread, and how the documents are cut,
doesn't change a score.

The tries can be written and score new documents later, see ``score_texts``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import binaries, crc_of_id, park, partitions, routes, small_batches, table, tidy, trim
from tremor.llm.elias_fano import Trie
from tremor.llm.hashing import word_hashes

MOD, HELD_OUT = 7, 2
HOT = 8  # words with 1 in so many tokens of a shard of usual size are spread over all shards
MOST_HOT = 1_000_000  # the most frequent words at most: any other has less than a millionth of all tokens
DISCOUNT2, DISCOUNT3 = (0.9, 0.1), (0.75, 0.1)  # a and b
END = 0x5EED_0F_7E97  # stands for the end of a document, and for the context before its first word
BLOCK_TOKENS, SHARD_TOKENS = 1_000_000, 1_500_000
SURVEYED = 4_000_000  # distinct words that a task of the survey holds at a time
LEAST_SHARD = 100_000  # tokens of a shard where there are more partitions than shards
CONTEXT = (1 << 32) - 1  # neighbours are told apart by so many bits of their hashes
CODED = 255  # most frequent neighbours that are sent as one byte
STEP = 4096  # codes of log10 counts for each unit


def _pack(*arrays) -> bytes:
    import io

    import numpy as np
    import zstandard

    out = io.BytesIO()
    for x in arrays:
        np.save(out, x, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(data: bytes) -> list:
    import io

    import numpy as np
    import zstandard

    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(data))
    out, size = [], len(raw.getvalue())
    while raw.tell() < size:
        out.append(np.load(raw, allow_pickle=False))
    return out


def _blocks(batches: Iterator) -> Iterator:
    """(ids, held flags, hashes per document with the end) of about ``BLOCK_TOKENS`` tokens."""
    import numpy as np

    end = np.array([END], np.uint64)
    ids, held, words, n = [], [], [], 0
    for batch in batches:
        texts = [x.lower() for x in binaries(batch, "text")]
        for doc_id, out, own in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), word_hashes(texts), strict=True):
            ids.append(doc_id)
            held.append(out)
            words.append(np.concatenate([own, end]))
            n += len(own) + 1
            if n >= BLOCK_TOKENS:
                yield ids, held, words
                ids, held, words, n = [], [], [], 0
    if ids:
        yield ids, held, words


def _survey(rarest: int):
    """Task: counts of the training tokens that are 1 in ``rarest`` at least of those of their task (of a part of it, where
    it has very many words); key null: of all tokens."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def frequent():
            known = keys[counts * rarest >= counts.sum()], counts[counts * rarest >= counts.sum()]
            key = pa.array(np.append(known[0].view(np.int64), 0), mask=np.append(np.zeros(len(known[0]), bool), True))
            n = pa.array(np.append(known[1], counts.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([key, n, pa.array(np.append(np.zeros(len(known[0]), np.int64), n_all))], ["key", "n", "n_all"])

        keys, counts, n_all = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for _, held, words in _blocks(batches):
            train = [x for x, out in zip(words, held, strict=True) if not out]
            own, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *train]), return_counts=True)
            keys, of = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(of, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            n_all += sum(map(len, words))
            if len(keys) > SURVEYED:
                yield frequent()
                keys, counts, n_all = keys[:0], counts[:0], 0
        yield frequent()

    return run


def _pair(before, word):
    """A pair of neighbours as one number."""
    import numpy as np

    return ((before & np.uint64(CONTEXT)) << np.uint64(32)) | (word & np.uint64(CONTEXT))


def _exact(words):
    """Task that counts training tokens which are one of ``words``, and pairs of two of them: (whether a pair, key, count)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        end = np.array([END], np.uint64)
        total = np.zeros(len(words), np.int64)
        for _, _, docs in _blocks(batches):
            word, before = np.concatenate(docs), np.concatenate([np.concatenate([end, x[:-1]]) for x in docs])
            at = _place(words, word)
            total += np.bincount(at[at >= 0], minlength=len(words))
            both = (at >= 0) & (_place(words, before) >= 0)
            keys, counts = np.unique(_pair(before[both], word[both]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(keys), pa.bool_()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["pair", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(words), pa.bool_()), pa.array(words.view(np.int64)), pa.array(total)], ["pair", "key", "n"])

    return run


class Plan:
    """What all tasks know: N, the number of shards, and the words and pairs that are spread over them with their training counts.

    A word or pair is spread from 1 in ``HOT`` tokens of a shard of usual size on, however large the corpus is."""

    def __init__(self, docs: DataFrame):
        import numpy as np

        # tokens are no more than half of the bytes and two a row; so no more shards than these, and no lower share of a frequent word
        rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        rarest = 4 * HOT * self.shards_of(size // 2 + 2 * rows, docs)
        counted = docs.mapInArrow(_survey(rarest), "key bigint, n bigint, n_all bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))
        found = park(counted, "lm-survey")
        whole = found.where("key is null").first()
        self.n, total = (whole["n"], whole["n_all"]) if whole else (0, 0)
        self.shards = self.shards_of(total, docs)
        least = total / (HOT * self.shards)
        words = found.where("key is not null").select("key", "n").orderBy(F.desc("n"), "key")
        # a quarter of that count at most is missing
        may_be_hot = words.where(F.col("n") >= 0.75 * least).limit(MOST_HOT).collect() if self.shards > 1 else []
        candidates = np.unique(np.array([END, *(k & ((1 << 64) - 1) for k, _ in may_be_hot)], np.uint64))
        exact = docs.where("not held_out").mapInArrow(_exact(candidates), "pair boolean, key bigint, n bigint").groupBy("pair", "key").agg(F.sum("n").alias("n"))
        hot = exact.where((F.col("n") >= least) | (~F.col("pair") & (F.col("key") == F.lit(END).cast("bigint"))))
        counts = ({END: 0}, {})
        for pair, key, n in hot.orderBy("pair", F.desc("n"), "key").limit(2 * MOST_HOT).collect():
            counts[pair][key & ((1 << 64) - 1)] = n
        (self.hot, self.n_hot), (self.pairs, self.n_pairs) = ((np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], np.int64)) for x in counts)
        self.hot_context = np.argsort(self.hot & np.uint64(CONTEXT))
        coded = [r["key"] & ((1 << 64) - 1) for r in words.limit(CODED).collect()]
        self.coded = np.unique(np.array([END, *coded], np.uint64) & np.uint64(CONTEXT))[:CODED]

    @staticmethod
    def shards_of(tokens: int, docs: DataFrame) -> int:
        return max(1, -(-tokens // SHARD_TOKENS), min(partitions(docs.sparkSession), tokens // LEAST_SHARD))

    def dump(self, n: int, v: int) -> bytes:
        import numpy as np

        return _pack(np.array([self.n, self.shards, n, v], np.int64), self.hot, self.n_hot, self.pairs, self.n_pairs, self.coded)

    @staticmethod
    def load(data: bytes) -> tuple[Plan, int, int]:
        """A written plan, with the totals of training tokens and of distinct ones."""
        import numpy as np

        plan = object.__new__(Plan)
        numbers, plan.hot, plan.n_hot, plan.pairs, plan.n_pairs, plan.coded = _unpack(data)
        plan.n, plan.shards, n, v = numbers.tolist()
        plan.hot_context = np.argsort(plan.hot & np.uint64(CONTEXT))
        return plan, n, v


def _place(keys, wanted):
    """Where each wanted value is in the sorted keys, -1 for nowhere."""
    import numpy as np

    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _short(plan: Plan, x) -> tuple:
    """Neighbours as one byte each, 0 for those that follow in full."""
    import numpy as np

    code = (_place(plan.coded, x) + 1).astype(np.uint8)
    return code, x[code == 0].astype(np.uint32)


def _long(plan: Plan, parts: list[tuple]):
    import numpy as np

    code = np.concatenate([x for x, _ in parts])
    out = plan.coded[code.astype(np.int64) - 1]
    out[code == 0] = np.concatenate([x for _, x in parts])
    return out


def _occurrences(plan: Plan):
    """Documents to blobs (shard, block, payload); shard -1: the block's documents."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def row(shard: int, block: str, *arrays):
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.string()), pa.array([_pack(*arrays)], pa.binary())], ["shard", "block", "payload"])

        for seq, (ids, held, docs) in enumerate(_blocks(batches)):
            block = f"{task}-{seq}"
            sizes = np.array([len(x) for x in docs], np.int64)
            known = np.array([x is not None for x in ids], bool)
            yield row(-1, block, known, np.array([x or 0 for x in ids], np.int64), np.array(held, bool), sizes)
            word = np.concatenate(docs)
            low = word & np.uint64(CONTEXT)
            first = np.cumsum(sizes) - sizes
            before = np.roll(low, 1)
            before[first] = END & CONTEXT
            before2 = np.roll(before, 1)
            before2[first] = END & CONTEXT
            after = np.roll(low, -1)  # of a document's last token: not used
            doc = np.repeat(np.arange(len(docs), dtype=np.uint16 if len(docs) < 1 << 16 else np.uint32), sizes)
            shard = ((word >> np.uint64(32)) % np.uint64(plan.shards)).astype(np.int32)
            spread = _place(plan.hot, word) >= 0
            shard[spread] = ((word[spread] >> np.uint64(32)) + before[spread] * np.uint64(0x9E3779B1)) % np.uint64(plan.shards)
            spread = _place(plan.pairs, _pair(before, word)) >= 0
            shard[spread] = ((word[spread] >> np.uint64(32)) + before[spread] * np.uint64(0x9E3779B1) + before2[spread] * np.uint64(0x85EBCA77)) % np.uint64(plan.shards)
            train = ~np.array(held, bool)[doc]
            order = np.lexsort((before, word, shard))
            word, before, before2, after, doc, train, shard = (x[order] for x in (word, before, before2, after, doc, train, shard))
            own, cuts = np.unique(shard, return_index=True)
            for s, a, b in zip(own.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                w, c = word[a:b], before[a:b]
                new = np.ones(b - a, bool)
                new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
                pair = np.flatnonzero(new)
                top = np.ones(len(pair), bool)
                top[1:] = w[pair][1:] != w[pair][:-1]
                tops = np.flatnonzero(top)
                yield row(
                    s, block, w[pair][tops], np.diff(np.append(tops, len(pair))).astype(np.uint32), np.diff(np.append(pair, b - a)).astype(np.uint32), doc[a:b], np.packbits(train[a:b]),
                    *_short(plan, c[pair]), *_short(plan, before2[a:b]), *_short(plan, after[a:b]),
                )

    return run


def _left(count, discount: tuple[float, float]):
    """log10 of the share that a context leaves for unseen words, and of what a seen word's count is multiplied by."""
    import numpy as np

    a, b = discount
    c = np.maximum(count, 1).astype(np.float64)
    share = np.where(count > 0, a * c**-b, 1.0)
    return np.log10(share), np.log10(np.maximum(1 - share, 1e-300) / c)


def _shard_sums(plan: Plan, keep: bool = False):
    """Blobs sorted by shard to (block, payload): per document of a block the sums of a shard.

    Block null: payload holds the shard's training tokens and distinct ones, but for the words spread over all;
    with ``keep`` a second row with documents true holds its trie.  A blob of block "" is the trie of a model: documents
    of its shard are then only scored by it."""

    def distinct(parent, child):
        """Distinct (parent, child) as arrays sorted by both, and which of them each is."""
        import numpy as np

        key, of = np.unique((parent.astype(np.uint64) << np.uint64(32)) | child, return_inverse=True)
        return (key >> np.uint64(32)).astype(np.int64), key & np.uint64(CONTEXT), of.astype(np.int32)

    def code(counts):
        import numpy as np

        return np.round(np.log10(counts) * STEP).astype(np.uint16)

    def grown(words, of_word, before, of_pair, before2, after_pair, after, seen_word, seen_pair, seen_tri, seen_after):
        """The trie of what occurs in training documents."""
        import numpy as np

        trie = Trie()
        kept = np.flatnonzero(seen_word > 0)
        trie.add("word", 1, np.zeros(len(kept), np.int64), words[kept], seen_word[kept])
        place = np.cumsum(seen_word > 0) - 1
        own = np.flatnonzero(seen_pair > 0)
        trie.add("before", len(kept), place[of_word[own]], before[own], code(seen_pair[own]))
        place_pair = np.cumsum(seen_pair > 0) - 1
        held = np.flatnonzero(seen_tri > 0)
        trie.add("before2", len(own), place_pair[of_pair[held]], before2[held], code(seen_tri[held]))
        held = np.flatnonzero(seen_after > 0)
        trie.add("after pair", len(own), place_pair[after_pair[held]], after[held])
        follow = np.sort((place[of_word[after_pair[held]]].astype(np.uint64) << np.uint64(32)) | after[held])
        follow = follow[np.append(True, follow[1:] != follow[:-1])[: len(follow)]]
        trie.add("after", len(kept), (follow >> np.uint64(32)).astype(np.int64), follow & np.uint64(CONTEXT))
        return trie.map()

    def process(shard: int, blobs: list[tuple[str, bytes]]):
        import numpy as np

        trie = Trie.load(blobs.pop(0)[1]) if blobs[0][0] == "" else None
        if not blobs:
            return
        model = trie is not None
        names, parts = [x[0] for x in blobs], []
        while blobs:  # their bytes go as they are unpacked
            parts.append(_unpack(blobs.pop(0)[1]))
        n_hot = plan.n_hot
        train = np.concatenate([np.unpackbits(p[4], count=len(p[3])).astype(bool) for p in parts])
        words, word = np.unique(np.concatenate([np.repeat(p[0], p[1]) for p in parts]), return_inverse=True)
        of_word, before, pair = distinct(word, _long(plan, [p[5:7] for p in parts]))
        pair = np.repeat(pair, np.concatenate([p[2] for p in parts]))  # of each occurrence
        of_pair, before2, tri = distinct(pair, _long(plan, [p[7:9] for p in parts]))
        after_pair, after, nxt = distinct(pair, _long(plan, [p[9:11] for p in parts]))
        docs = [p[3] for p in parts]
        del parts, word
        seen_tri, seen_after = (np.bincount(x[train], minlength=len(y)) for x, y in ((tri, of_pair), (nxt, after_pair)))
        seen_pair = np.bincount(of_pair, seen_tri, len(of_word)).astype(np.int64)
        seen_word = np.bincount(of_word, seen_pair, len(words)).astype(np.int64)
        hot = _place(plan.hot, words)
        seen_word = np.where(hot >= 0, n_hot[hot], seen_word)
        hot_pair = _place(plan.pairs, _pair(before, words[of_word]))
        if len(plan.pairs):
            seen_pair = np.where(hot_pair >= 0, plan.n_pairs[hot_pair], seen_pair)
        if trie is None:
            trie = grown(words, of_word, before, of_pair, before2, after_pair, after, seen_word, seen_pair, seen_tri, seen_after)
        del seen_tri, seen_after, seen_pair
        # every distinct n-gram is looked up once
        at_word = trie.find("word", np.zeros(len(words), np.int64), words)

        def value(name, at):
            return np.where(at >= 0, trie.codes(name)[np.maximum(at, 0)] / STEP if len(trie.codes(name)) else 0.0, 0.0)

        held = trie.codes("word")[np.maximum(at_word, 0)] if len(trie.codes("word")) else np.zeros(len(words), np.int64)
        count = np.where(hot >= 0, n_hot[hot], np.where(at_word >= 0, held, 0))
        at_pair = trie.find("before", at_word[of_word], before)
        at_tri = trie.find("before2", at_pair[of_pair], before2)
        at_after_pair = trie.find("after pair", at_pair[after_pair], after)
        at_after = trie.find("after", at_word[of_word[after_pair]], after)
        # as a word: which of the three, its numerator, and what a frequent word before it leaves
        start = before == np.uint64(END & CONTEXT)
        level3 = (at_tri >= 0) & ~start[of_pair]
        context = plan.hot_context[np.maximum(_place((plan.hot & np.uint64(CONTEXT))[plan.hot_context], before), 0)]
        is_hot = _place((plan.hot & np.uint64(CONTEXT))[plan.hot_context], before) >= 0
        left, taken = _left(np.where(is_hot, n_hot[context], 0), DISCOUNT2)
        lower = np.where(at_pair >= 0, value("before", at_pair) + np.where(is_hot, taken, 0.0), np.log10(count + 0.5)[of_word] + np.where(is_hot, left, 0.0))
        log_p = np.where(level3, value("before2", at_tri), lower[of_pair])
        if len(plan.pairs):  # and what a frequent pair before it leaves
            context = _place(plan.pairs, _pair(before2, before[of_pair]))
            left, taken = _left(plan.n_pairs[context], DISCOUNT3)
            log_p += np.where((context >= 0) & ~start[of_pair], np.where(level3, taken, left), 0.0)
        unseen = (~level3 & (at_pair < 0)[of_pair])[tri]
        # as the context of the next word
        # a context's count of up to 1,000 is read from its code without a loss
        left, taken = _left(np.where(at_pair >= 0, np.round(10.0 ** value("before", at_pair)), 0), DISCOUNT3)
        rest = np.where((hot_pair >= 0)[after_pair], 0.0, np.where(at_after_pair >= 0, taken[after_pair], left[after_pair]))
        left, taken = _left(count, DISCOUNT2)
        cold = (hot < 0)[of_word[after_pair]] & (at_after_pair < 0)
        rest += np.where(cold, np.where(at_after >= 0, taken[of_word[after_pair]], left[of_word[after_pair]]), 0.0)
        rest[(words == np.uint64(END))[of_word[after_pair]]] = 0.0
        log_p = log_p[tri] + rest[nxt]
        log_c = np.log10((count + 1.0) / (plan.n + 1.0))[of_word][pair]  # against N + 1, lest large sums cancel
        known = (count > 0)[of_word][pair]
        if not model:
            yield None, False, shard, _pack(np.array([seen_word[hot < 0].sum(), (seen_word[hot < 0] > 0).sum()], np.int64))
        if keep:
            yield None, True, shard, trie.dump()
        del trie, tri, nxt, pair, rest, lower
        at = 0
        for block, doc in zip(names, docs, strict=True):
            mine = slice(at, at + len(doc))
            at += len(doc)
            own, of = np.unique(doc, return_inverse=True)
            counts = (np.bincount(of, x[mine]).astype(np.uint32) for x in (known, unseen))
            yield block, False, shard, _pack(np.diff(own, prepend=own[:1]), own[:1], np.bincount(of, log_p[mine]).astype(np.float32), np.bincount(of, log_c[mine]), *counts)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], ["block", "documents", "shard", "payload"])

        blobs: list[tuple[str, bytes]] = []
        now = None
        for batch in batches:
            for shard, block, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "payload")), strict=True):
                if shard < 0:
                    yield batch_of([(block, True, shard, payload)])
                    continue
                if shard != now and blobs:
                    if rows := list(process(now, blobs)):
                        yield batch_of(rows)
                    blobs = []
                    trim()
                now = shard
                blobs.append((block, payload))
        if blobs and (rows := list(process(now, blobs))):
            yield batch_of(rows)

    return run


def _assemble(plan: Plan, n: int, v: int):
    """Rows sorted by block to one row per document."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def documents(rows: list[tuple[bool, bytes]]):
            known, ids, held, sizes = next(_unpack(x) for is_docs, x in rows if is_docs)
            log_p, log_c, n_known, unseen = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for _, x in (r for r in rows if not r[0]):
                step, first, *sums = _unpack(x)
                own = np.cumsum(step.astype(np.int64)) + first
                for total, part in zip((log_p, log_c, n_known, unseen), sums, strict=True):
                    total[own] += part
            log_p -= unseen * math.log10(max(1, n + v))
            base = log_c - sizes * math.log10((n + v + 1) / (plan.n + 1.0))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=~known), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(np.minimum(0.0, log_p), pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        rows: list[tuple[bool, bytes]] = []
        now = None
        for batch in batches:
            for block, is_docs, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "documents", "payload")), strict=True):
                if block != now and rows:
                    yield documents(rows)
                    rows = []
                now = block
                rows.append((is_docs, payload))
        if rows:
            yield documents(rows)

    return run


SUMS = "block string, documents boolean, shard int, payload binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _by_shard(docs: DataFrame, plan: Plan, tries: DataFrame | None = None) -> DataFrame:
    """Blobs of documents, and a model's tries before them, one shard after the other to each partition, not as their
    hashes fall."""
    n = partitions(docs.sparkSession)
    blobs = docs.mapInArrow(_occurrences(plan), "shard int, block string, payload binary")
    if tries is not None:
        blobs = blobs.unionByName(tries)
    route = F.get(F.array(*map(F.lit, routes(docs.sparkSession, n))), F.pmod(F.col("shard"), F.lit(n)))
    spread = F.when(F.col("shard") < 0, F.hash("block")).otherwise(route)
    return blobs.repartition(n, spread).sortWithinPartitions("shard", "block")


def _scored(sums: DataFrame, plan: Plan, n: int, v: int) -> DataFrame:
    by_block = sums.where("block is not null").repartition(partitions(sums.sparkSession), "block").sortWithinPartitions("block")
    return by_block.select("block", "documents", "payload").mapInArrow(_assemble(plan, n, v), SCORES)


def lm_scores(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Documents whose crc32 of doc_id (null: of empty text) has the remainder
    ``HELD_OUT`` by ``MOD`` are scored, the others are scored and learnt from.
    A null or empty text is the end alone; repeated rows count each time;
    other columns are not read; without training documents all counts are 0;
    an empty table gives an empty result.  doc_id is cast to a whole number: a
    text that is none is an error.

    With ``model``, a path on a shared file system, the tries are also written
    there, for ``score_texts``.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (crc_of_id() % MOD == HELD_OUT).alias("held_out"))
    plan = Plan(docs)
    with small_batches(docs.sparkSession):
        sums = park(_by_shard(docs, plan).mapInArrow(tidy(_shard_sums(plan, model is not None)), SUMS), "lm-sums")
    totals = sums.where("block is null and not documents").select("payload").mapInArrow(_totals, "n bigint, v bigint").agg(F.sum("n"), F.sum("v")).first()
    n_train, v_train = (int(x or 0) + int(y) for x, y in zip(totals, (plan.n_hot.sum(), (plan.n_hot > 0).sum()), strict=True))
    if model is not None:
        about = docs.sparkSession.createDataFrame([(-1, bytearray(plan.dump(n_train, v_train)))], "shard int, payload binary")
        with small_batches(docs.sparkSession):
            sums.where("block is null and documents").select("shard", "payload").unionByName(about).write.mode("overwrite").parquet(model)
    return _scored(sums, plan, n_train, v_train)


def score_texts(documents: DataFrame, model: str) -> DataFrame:
    """The columns of ``lm_scores`` for new documents, by a model that it wrote; nothing is learnt from them and all are
    marked as held out.

    Each shard's trie is read once, by the one task that has the shard's tokens.  Odd rows are treated as there.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(True).alias("held_out"))
    tries = docs.sparkSession.read.parquet(model)
    plan, n, v = Plan.load(bytes(tries.where("shard = -1").first()["payload"]))
    with small_batches(docs.sparkSession):
        blobs = _by_shard(docs, plan, tries.where("shard >= 0").select("shard", F.lit("").alias("block"), "payload"))
        sums = park(blobs.mapInArrow(tidy(_shard_sums(plan)), SUMS), "lm-sums")
    return _scored(sums, plan, n, v)


def _totals(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = [_unpack(x)[0].tolist() for x in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["n", "v"])


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
