"""Token ids in a compact binary format: an adaptive context-mixing range coder over independent blocks.

Predictions. Order 2 and order 1 each remember, for the ids before (two, one), an id that followed and how often it was
right. Order 0 is a distribution over all ids of the frame: the frame's own counts, to which every block adds its ids as
it goes (``RECOUNT``). The mixture gives an id x the probability g2 [x = order 2's] + (1 - g2) g1 [x = order 1's] +
(1 - g2) (1 - g1) order0(x). The weights g2 and g1 adapt after every id, in a set of their own for each pair of confidences
and for agreement of the two. The range coder codes along that sum.

Blocks and frames. A block holds ``BLOCK`` ids; models, weights and coder start anew in every block, and a block carries its
number of ids and the crc32 of its ids, so blocks are read, checked and retried alone. A frame is a run of blocks that share
one head (the ids that occur and their counts), under a checksum of its own. The blocks of a frame are coded in lockstep,
one lane each, so every step is a few dozen operations on arrays. Only whole numbers decide intervals, so a frame reads
the same on any machine.

File format: Parquet part files as containers (so Spark's commit protocol makes a lost executor harmless), one row a frame:
shard, frame, first (ids of the shard before it), payload, pieces. payload: b"CMR2", u32 vocabulary, blocks, ids in use,
bytes of the head, crc32 of head and directory; the head (deflated: gaps between the ids in use, then their weights, u32
each); the directory (u32 ids, 16-bit code words and crc32 of the ids as little-endian u32, for each block); code words.
pieces: for each document or part of one in the frame, i64 key, u32 ids, u32 ordinal in the shard.
Ids stand in ascending order of doc_id through shards and frames.

Defined results: a null text is empty (the end id only); a null doc_id is larger than all others; rows that repeat an id
stand next to each other in the order of a hash of their text; other columns are passed over; an empty table gives an
empty result. A tokenizer that keeps white space, or lets it change the ids of words, is given whole texts.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolattice.llm.cluster import ARROW_ROWS, release, scratch, written
from chronolattice.llm.contexts import batch_of
from chronolattice.llm.substring_dedup import LAST, row_keys

BLOCK, MAGIC = 8192, b"CMR2"
#: Blocks of a frame at most, and lanes times ids in use at most: they bound memory, whatever the input.
LANES, CELLS = 384, 2_000_000
I = np.int64  # noqa: E741
U = np.uint64
PRIOR, GAIN = 1 << 17, 32  # weight of the frame's counts in order 0, and of an id seen in the block
CONTEXTS = 13  # log2 of the order-2 table
LOW32 = (1 << 32) - 1
SLOTS = 12  # log2 of the slots through which a decoder enters order 0
#: Steps at which a block's own ids join order 0.
RECOUNT = tuple([256, *range(1024, BLOCK, 1024)])


def _gates() -> tuple[np.ndarray, np.ndarray]:
    """First weights of orders 2 and 1, of 4096, by the set (confidence of order 2, of order 1, agreement)."""
    q2, q1 = np.arange(128) >> 4, np.arange(128) >> 1 & 7
    g2, g1 = 4096 * (10 * q2 + 1) // (10 * q2 + 10), 4096 * (10 * q1 + 1) // (10 * q1 + 25)
    return np.clip(np.where(q2 > 0, g2, 0), 64, 4032).astype(np.int32), np.clip(g1, 64, 4032).astype(np.int32)


class Mixer:
    """The models of many lanes, each started anew. ``ids``: (step, lane), filled by the coder as far as it has come;
    ids are places among the ``weights``."""

    def __init__(self, lanes: int, weights: np.ndarray, ids: np.ndarray):
        k = len(weights)
        self.lanes, self.k, self.ids = lanes, k, ids
        lane = np.arange(lanes, dtype=I)
        self.base0, self.base1, self.base2, self.base_gate = lane * (k + 1), lane * k, lane << CONTEXTS, lane << 7
        # an entry: the id, and its confidence (0 to 7) in the lowest three bits
        self.t1, self.t2 = np.zeros(lanes * k, np.uint32), np.zeros(lanes << CONTEXTS, np.uint32)
        g2, g1 = _gates()
        self.w2, self.w1 = np.tile(g2, lanes), np.tile(g1, lanes)
        self.prev1 = self.prev2 = np.zeros(lanes, I)
        self.count = np.tile(weights.astype(np.int32), (lanes, 1))
        self.cum = np.zeros((lanes, k + 1), np.int32)
        self.done = 0
        self.recount(0)

    def recount(self, step: int) -> None:
        """Adds the ids of the steps before ``step`` to order 0."""
        if step > self.done:
            new = np.bincount((self.ids[self.done : step] + self.base1).ravel(), minlength=self.lanes * self.k)
            new *= GAIN
            self.count += new.reshape(self.lanes, self.k).astype(np.int32)
            self.done = step
        np.cumsum(self.count, axis=1, out=self.cum[:, 1:])
        self.total, self.starts = PRIOR + GAIN * step, self.cum.ravel()

    def slots(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Shift of a target to its slot, lanes' first slots, and for each slot the last id that begins at or before it."""
        shift = max(0, (self.total - 1).bit_length() - SLOTS)
        n = (self.total - 1 >> shift) + 2
        first = np.arange(self.lanes, dtype=I) * n
        at = ((self.cum[:, 1:] + ((1 << shift) - 1)) >> shift) + first[:, None]
        return shift, first, np.cumsum(np.bincount(at.ravel(), minlength=self.lanes * n).reshape(self.lanes, n), axis=1).astype(np.int32).ravel()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of order 2's and order 1's id, of 4096."""
        self.i1 = self.base1 + self.prev1
        self.i2 = self.base2 + ((self.prev2 * 0x9E3779B1 + self.prev1 * 0x85EBCA6B & LOW32) >> (32 - CONTEXTS))
        self.e1, self.e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.c1, self.c2 = self.e1 >> 3, self.e2 >> 3
        same = self.c1 == self.c2
        self.gate = self.base_gate + ((self.e2 & 7) << 4 | (self.e1 & 7) << 1 | same)
        self.g2, self.g1 = self.w2.take(self.gate), self.w1.take(self.gate)
        return self.g2, np.where(same, 0, self.g1)

    def update(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        self.w2[self.gate] = np.clip(self.g2 + ((hit2.astype(np.int32) << 12) - self.g2 >> 5), 64, 4032)
        moved = np.clip(self.g1 + ((hit1.astype(np.int32) << 12) - self.g1 >> 5), 64, 4032)
        self.w1[self.gate] = np.where(hit2, self.g1, moved)  # order 1 was not asked where order 2 was right
        fresh = x.astype(np.uint32) << 3 | 1
        for t, i, e, c in ((self.t1, self.i1, self.e1, self.c1), (self.t2, self.i2, self.e2, self.c2)):
            q = e & 7
            t[i] = np.where(c == x, e + (q < 7), np.where(q > 1, e - q + (q >> 1), fresh))
        self.prev2, self.prev1 = self.prev1, x


def _counts(ids: np.ndarray, vocab: int) -> np.ndarray:
    out = np.zeros(vocab, I)
    for a in range(0, len(ids), 1 << 17):
        out += np.bincount(ids[a : a + (1 << 17)], minlength=vocab)
    return out


def _weights(count: np.ndarray) -> np.ndarray:
    """Counts scaled to the sum PRIOR, 1 at least."""
    w = np.maximum(1, count * (PRIOR - len(count)) // int(count.sum()))
    w[np.argmax(w)] += PRIOR - int(w.sum())
    return w


def encode_frames(ids: np.ndarray, vocab: int) -> list[tuple[int, bytes]]:
    """Frames of all ids, each with its number of ids: as many blocks in each as LANES and CELLS allow."""
    if vocab > PRIOR // 2:
        raise ValueError("the vocabulary is too large for order 0")
    if len(ids) and int(ids.max()) >= vocab:
        raise ValueError("an id lies outside the vocabulary")
    out, at = [], 0
    while at < len(ids):
        part = ids[at : at + LANES * BLOCK]
        kinds = int(np.count_nonzero(_counts(part, vocab)))
        part = part[: max(1, CELLS // kinds) * BLOCK]
        out.append((len(part), _encode(part, vocab)))
        at += len(part)
    return out


def _encode(ids: np.ndarray, vocab: int) -> bytes:
    count = _counts(ids, vocab)
    used = np.flatnonzero(count)
    weights = _weights(count[used])
    place = np.zeros(vocab, np.int32)
    place[used] = np.arange(len(used))
    n, steps = -(-len(ids) // BLOCK), min(BLOCK, len(ids))
    # zeros pad the last block; the words that only they need are left out
    x = np.zeros((steps, n), np.int32)
    for j in range(n):
        own = ids[j * steps : (j + 1) * steps]
        x[: len(own), j] = place[own]
    m = Mixer(n, weights, x)
    low, rng = np.zeros(n, I), np.full(n, (1 << 48) - 1, I)
    # code words as they come, with a carry to the word before in bit 16
    width = steps * 9 // 16 + 1024
    words, pos = np.zeros((n, width), np.uint32), np.zeros(n, I)
    flat, begin = words.ravel(), np.arange(n, dtype=I) * width

    def shift() -> None:
        nonlocal low, rng, pos
        need = rng <= LOW32
        while need.any():
            flat[begin + pos] = low >> 32
            low, rng = np.where(need, (low & LOW32) << 16, low), np.where(need, rng << 16, rng)
            pos = pos + need
            need = rng <= LOW32

    short, most = len(ids) - steps * (n - 1), None
    for step in range(steps):
        if step == short:
            most = int(pos[-1]) + 3  # as many as a decoder has read by then
        if step in RECOUNT:
            m.recount(step)
        if not step & 255 and int(pos.max()) + 1024 > width:
            words, width = np.pad(words, ((0, 0), (0, width // 2 + 1024))), width + width // 2 + 1024
            flat, begin = words.ravel(), np.arange(n, dtype=I) * width
        v = x[step].astype(I)
        f2, f1 = m.predict()
        hit2 = v == m.c2
        hit1 = (v == m.c1) > hit2
        b = (rng >> 12) * f2
        low, rng = np.where(hit2, low, low + b), np.where(hit2, b, rng - b)
        b = (rng >> 12) * f1
        rng = np.where(hit1, b, rng)
        e = np.flatnonzero(~(hit2 | hit1))
        at = m.base0.take(e) + v.take(e)
        start = m.starts.take(at)
        size, b = m.starts.take(at + 1) - start, b.take(e)
        r = (rng.take(e) - b) // m.total
        low[e] += b + r * start
        rng[e] = r * size
        m.update(v, hit2, hit1)
        shift()
    for _ in range(3):
        flat[begin + pos] = low >> 32
        low, pos = (low & LOW32) << 16, pos + 1
    pos[-1] = most or pos[-1]
    while True:
        carry = words >> 16
        if not carry.any():
            break
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
    head = zlib.compress(np.concatenate((np.diff(used, prepend=-1), weights)).astype("<u4").tobytes(), 6)
    sizes = np.minimum(steps, len(ids) - steps * np.arange(n))
    crcs = [zlib.crc32(np.ascontiguousarray(ids[j * steps : (j + 1) * steps], "<u4")) for j in range(n)]
    directory = np.stack([sizes, pos, crcs], axis=1).astype("<u4").tobytes()
    coded = [words[j, : pos[j]].astype("<u2").tobytes() for j in range(n)]
    return b"".join([MAGIC, struct.pack("<5I", vocab, n, len(used), len(head), zlib.crc32(head + directory)), head, directory, *coded])


def decode_frame(payload: bytes, blocks: Sequence[int] | None = None) -> list[np.ndarray]:
    """The ids of a frame's blocks, or of those wanted alone; raises ValueError if a checksum differs."""
    if payload[:4] != MAGIC or len(payload) < 24:
        raise ValueError("not a frame of token ids")
    _, n, kinds, size, crc = struct.unpack_from("<5I", payload, 4)
    head, directory = payload[24 : 24 + size], payload[24 + size : 24 + size + 12 * n]
    if zlib.crc32(head + directory) != crc:
        raise ValueError("a frame's checksum differs")
    table = np.frombuffer(zlib.decompress(head), "<u4").astype(I)
    used, weights = np.cumsum(table[:kinds]) - 1, table[kinds:]
    entries = np.frombuffer(directory, "<u4").reshape(n, 3).astype(I)
    wanted = np.arange(n) if blocks is None else np.asarray(blocks, I)
    if not len(wanted):
        return []
    base = 24 + size + 12 * n + 2 * (np.cumsum(entries[:, 1]) - entries[:, 1])
    lanes, steps = len(wanted), int(entries[wanted, 0].max())
    # a lane reads zeros past its end, and what it yields there is cut off
    width = int(entries[wanted, 1].max()) + 1
    words = np.zeros((lanes, width), np.uint16)
    for j, w in enumerate(wanted.tolist()):
        got = np.frombuffer(payload[base[w] : base[w] + 2 * entries[w, 1]], "<u2")
        words[j, : len(got)] = got
    ids = np.zeros((steps, lanes), np.int32)
    m = Mixer(lanes, weights, ids)
    begin, flat = np.arange(lanes, dtype=I) * width, words.ravel()
    code = words[:, 0].astype(I) << 32 | words[:, 1].astype(I) << 16 | words[:, 2]
    rng, pos = np.full(lanes, (1 << 48) - 1, I), np.full(lanes, 3, I)
    shift, first, enter = m.slots()
    for step in range(steps):
        if step in RECOUNT:
            m.recount(step)
            shift, first, enter = m.slots()
        f2, f1 = m.predict()
        b = (rng >> 12) * f2
        hit2 = code < b
        code, rng = np.where(hit2, code, code - b), np.where(hit2, b, rng - b)
        b = (rng >> 12) * f1
        hit1 = (code < b) > hit2
        rng = np.where(hit1, b, rng)
        x = np.where(hit2, m.c2, m.c1).astype(I)
        e = np.flatnonzero(~(hit2 | hit1))
        if len(e):
            b = b.take(e)
            left, r = code.take(e) - b, (rng.take(e) - b) // m.total
            target = np.minimum((left.view(U) // r.view(U)).view(I), m.total - 1)
            own = m.base0.take(e)
            at = own + enter.take(first.take(e) + (target >> shift))
            after = m.starts.take(at + 1) <= target
            while after.any():
                at += after
                after = m.starts.take(at + 1) <= target
            start = m.starts.take(at)
            x[e], code[e], rng[e] = at - own, left - r * start, r * (m.starts.take(at + 1) - start)
        need = rng <= LOW32
        while need.any():
            code = np.where(need, code << 16 | flat.take(begin + np.minimum(pos, width - 1)), code)
            rng, pos = np.where(need, rng << 16, rng), pos + need
            need = rng <= LOW32
        ids[step] = x
        m.update(x, hit2, hit1)
    out = []
    for j, w in enumerate(wanted.tolist()):
        own = used[ids[: entries[w, 0], j]].astype("<u4")
        if zlib.crc32(own) != entries[w, 2]:
            raise ValueError("a block's checksum differs")
        out.append(own)
    return out


#: What tells whether a text's ids are its words' ids in a row.
PROBES = ("a b", "One  two\n\nthree\tfour", "it 's they 're don 't x", " . , ;  -- ( a ) ", "3 14 2,718 1e5", "été ́ 你好 世界 рус", "end of line \r\n", "<| a |> < b >")


class Words:
    """Ids of texts by way of their words, where the tokenizer splits at white space and drops it, so that a text's ids
    are its words' ids in a row (tried on PROBES); else of whole texts. Words stay known until two generations of
    ``most`` new ones have come."""

    def __init__(self, path: str, most: int = 100_000):
        # a task has one core; threads of the library's own cost more than they gain on words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.known, self.old, self.most = Tokenizer.from_file(path), {}, {}, most
        self.vocab = self.tok.get_vocab_size()
        self.by_word = all(self._plain([p])[0] == b"".join(self._plain(p.split())) for p in PROBES)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        if not self.by_word:
            return self._plain([t.decode() for t in texts])
        split = [t.split() for t in texts]
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old, fresh = self.known, self.old, []
        for w in set().union(*split).difference(known):
            if w in old:
                known[w] = old[w]
            else:
                fresh.append(w)
        for a in range(0, len(fresh), 10_000):
            part = fresh[a : a + 10_000]
            known.update(zip(part, self._plain([w.decode() for w in part]), strict=True))
        return [b"".join(map(known.__getitem__, ws)) for ws in split]


#: One table of words a worker process and tokenizer: tasks that a worker runs later find words known.
_TABLES: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = Words(path)
    return _TABLES[path]


PIECE = np.dtype([("d", "<i8"), ("n", "<u4"), ("all", "<u4"), ("o", "<u4")])
FRAME = "shard int, frame int, first long, payload binary, pieces binary"


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> None:
    """Encodes all texts and writes the format to ``path``, in ascending order of doc_id."""
    spark = docs.sparkSession
    # rows that share an id, or have none, are dealt by text and place too, so that they need not be in one shard
    base = row_keys(docs, text, doc_id).withColumn("h", F.xxhash64("t")).withColumn("i", F.monotonically_increasing_id())
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = base.repartitionByRange(n, "d", "h", "i").sortWithinPartitions("d", "h", "i").select("d", F.col("t").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = words_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        shard, frames, first, ordinal, held = TaskContext.get().partitionId(), 0, 0, 0, 0
        parts, pieces = [], []

        def flush() -> pa.RecordBatch:
            """The frames of all that is held. Only a document that is long or stands where CELLS ends a frame has
            pieces in several."""
            nonlocal frames, first, parts, pieces, held
            ids, table = np.frombuffer(b"".join(parts), "<i4"), np.concatenate(pieces)
            parts, pieces, held = [], [], 0
            coded = encode_frames(ids, words.vocab)
            ends, stops = np.cumsum(table["all"].astype(I)), np.cumsum([c for c, _ in coded])
            begins, own = ends - table["all"], []
            for (size, _), b in zip(coded, stops.tolist(), strict=True):
                a = b - size
                lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(begins, b, side="left")
                piece = table[lo:hi].copy()
                piece["n"] = np.minimum(ends[lo:hi], b) - np.maximum(begins[lo:hi], a)
                own.append(piece.tobytes())
            k = len(coded)
            out = batch_of(FRAME, k, shard=np.full(k, shard), frame=np.arange(frames, frames + k), first=first + stops - [c for c, _ in coded], payload=pa.array([c for _, c in coded], pa.binary()), pieces=pa.array(own, pa.binary()))
            frames, first = frames + k, first + len(ids)
            return out

        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                got = words.ids(part.column(1).to_pylist())
                table = np.zeros(len(got), PIECE)
                table["d"], table["all"] = part.column(0).to_numpy(), [len(g) // 4 + 1 for g in got]
                table["o"] = np.arange(ordinal, ordinal + len(got)) & LOW32
                parts += [x for g in got for x in (g, end)]
                pieces.append(table)
                ordinal, held = ordinal + len(got), held + int(table["all"].sum())
                if held >= LANES * BLOCK:
                    yield flush()
        if held:
            yield flush()

    # batches of texts come through the executor's memory and the worker's: small ones cost nothing here
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "1000")
    try:
        ordered.mapInArrow(run, FRAME).write.option("compression", "none").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(shard, frame, ordinal, d, at, n, all, crc[, ids]) of every document piece in the files, from decoded frames: at is
    its place in the shard, n its number of ids, all the document's, crc theirs."""
    schema = "shard int, frame int, ordinal long, d long, at long, n long, all long, crc long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, frame, first, payload, pieces in zip(*batch.columns, strict=True):
                raw = memoryview(np.concatenate(decode_frame(payload.as_py())).tobytes())
                table = np.frombuffer(pieces.as_py(), PIECE)
                k, n = len(table), table["n"].astype(I)
                at = np.cumsum(n) - n
                own = [raw[4 * a : 4 * (a + c)] for a, c in zip(at.tolist(), n.tolist(), strict=True)]
                more = {"ids": pa.array([bytes(x) for x in own], pa.binary())} if ids else {}
                yield batch_of(schema, k, shard=np.full(k, shard.as_py()), frame=np.full(k, frame.as_py()), ordinal=table["o"], d=table["d"], at=first.as_py() + at, n=n, all=table["all"], crc=np.array([zlib.crc32(x) for x in own], I), **more)

    return spark.read.schema(FRAME).parquet(path).mapInArrow(run, schema)


def _crc_join(crcs: list[tuple[int, int]]) -> int:
    """The crc32 of pieces in a row from theirs and their lengths in bytes."""

    def times(mat: list[int], vec: int) -> int:
        out, i = 0, 0
        while vec:
            if vec & 1:
                out ^= mat[i]
            vec >>= 1
            i += 1
        return out

    def zeros(crc: int, n: int) -> int:  # crc moved on by n zero bytes, by squaring the one-bit step
        mat = [0xEDB88320] + [1 << i for i in range(31)]
        for _ in range(3):
            mat = [times(mat, x) for x in mat]
        while n:
            if n & 1:
                crc = times(mat, crc)
            mat = [times(mat, x) for x in mat]
            n >>= 1
        return crc

    total = 0
    for crc, n in crcs:
        total = zeros(total, n) ^ crc
    return total


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, in the files' order: start is the number of ids before.
    The files are decoded once, into a table of a few numbers a piece."""
    pieces = written(read_tokens(spark, path), "pieces")
    join: Callable = F.udf(lambda ps: _crc_join([(p["crc"], 4 * p["n"]) for p in ps]), "long")
    whole = pieces.where("n = all").select("shard", "d", "at", "n", "crc")
    # only documents that go over a frame's end need their pieces' sums joined
    several = pieces.where("n <> all").groupBy("shard", "ordinal", "d").agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "crc", "n"))).alias("ps"))
    rows = whole.unionByName(several.select("shard", "d", "at", "n", join("ps").alias("crc")))
    totals = pieces.groupBy("shard").agg(F.max(F.col("at") + F.col("n")).alias("z"))
    before = totals.select("shard", F.coalesce(F.sum("z").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row a shard: their number is that of partitions written, whatever the rows
    out = rows.join(F.broadcast(before), "shard")
    return out.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), (F.col("before") + F.col("at")).cast("long").alias("start"), F.col("n").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "shard")


def encode_documents(docs: DataFrame, *, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", path: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the files (to ``path``, or a new folder of the shared storage) and returns ``token_index`` of what they hold."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer=tokenizer, end_id=end_id, text=text, doc_id=doc_id, shards=shards)
    release(spark)
    return token_index(spark, path)
