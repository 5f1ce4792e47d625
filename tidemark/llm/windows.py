"""Which windows of a corpus also stand earlier in it: exact, in parallel, without shipping the corpus.

A window is W consecutive symbols (bytes or words) of one document. The key of a window is the least hash of its
grams of m symbols, so equal windows have equal keys, and windows next to each other mostly share one: a run is a
maximal stretch of windows with the same key. Documents lie in blocks by hash of doc_id.

1. count: each block sends its distinct keys, cut to 40 bits, to the bucket of the key.
2. tell: a bucket returns to each block which of its keys occur again anywhere, and which are hot (over ``HOT`` times).
3. send: a block sends its runs with recurring keys, as bytes, to the shard of the key. Runs of hot keys go window by
   window to the shard of the whole window, so no key, however common, meets in one task; a block combines equal ones
   before it sends them. Where ``combine`` says so it does that with all runs.
4. judge: a shard compares windows exactly (the operator's own method, on bytes) and returns a bit for each.
5. finish: blocks apply the bits.

Hashes only propose: two windows that differ may meet in a shard, equal ones always do. What a block combined: all but
the first of equal runs stand in a later document or place. The text is shuffled once; the steps use the same exchange.
Blocks and shards are as many as twice the shuffle partitions, and more where that would put over ``BLOCK_BYTES`` of
text into a block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .base import partitions, text_or_empty

HOT = 4096
LONGEST = 256
MOST = (1 << 16) - 1  # a block's count of a key goes up to this, which is hot by itself
BLOCK_BYTES = 128 << 20
LAST = (1 << 63) - 1
STEP = 1 << 16  # symbols that are hashed at a time: their arrays stay in a processor's own cache


@dataclass(frozen=True)
class Plan:
    """symbols: Arrow text column -> (symbols, row offsets). content: the same -> (bytes, the n + 1 places in them where
    symbols begin, None if symbols are bytes). within: whether an earlier place in the same document counts too. judge: (bytes of the pieces,
    where each begins and ends, their windows and documents, window) -> a bit for each window; pieces come by document
    and place. finish: (ids, text column, symbols, offsets, covered) -> table."""

    window: int
    gram: int
    within: bool
    combine: bool
    symbols: Callable
    content: Callable
    judge: Callable
    finish: Callable
    schema: str
    hot: int = HOT


@dataclass
class Runs:
    """Runs of a block in order of (document, start); first: index of the first equal run, for recurring ones."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    doubled: np.ndarray


def room_for(w: int) -> np.ndarray:
    """Arrays that ``gram_keys`` and ``find_runs`` work in: fresh ones for each step cost as much as the work itself."""
    return np.empty((2, STEP + w), np.uint64)


def gram_keys(symbols: np.ndarray, m: int, room: np.ndarray) -> np.ndarray:
    """A hash of the m symbols from each place, alike wherever they stand, in room[0]; equal grams have equal ones."""
    n = len(symbols)
    up, down = textnp.powers(n + 1)
    values, sums = room[0, :n], room[1, : n + 1]
    values[:] = symbols
    values += np.uint64(1)
    values *= up[:n]
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    grams = np.subtract(sums[m:], sums[:-m], out=room[0, : n + 1 - m])
    grams *= down[: len(grams)]
    return textnp.mix(grams)


def find_runs(symbols: np.ndarray, offsets: np.ndarray, plan: Plan) -> Runs:
    w, m, n = plan.window, plan.gram, len(symbols)
    wide = w - m + 1
    starts, counts, keys, doubled = [], [], [], []
    room, other = room_for(w), room_for(w)
    for lo in range(0, max(0, n - w + 1), STEP):
        hi = min(n, lo + STEP + w - 1)
        size = hi - lo
        grams = gram_keys(symbols[lo:hi], m, room)
        least, span, turn = grams, 1, 0
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:], out=other[turn, : len(least) - span])
            span, turn = span * 2, 1 - turn
        total = size - w + 1
        least = np.minimum(least[:total], least[wide - span : wide - span + total], out=other[turn, :total]) if span < wide else least[:total]
        valid = np.ones(total, bool)
        a, b = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, lo + total, "left"))
        for s, e in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=False):
            valid[max(0, max(s, e - w + 1) - lo) : max(0, e - lo)] = False
        new = np.ones(total, bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        cuts = offsets[a:b]
        cuts = cuts[(cuts >= lo) & (cuts < lo + total)] - lo
        new[cuts] = True
        at = np.flatnonzero(new)
        length = np.diff(np.r_[at, total])
        ok = valid[at]
        # valid windows of a document come first, so a run that starts valid ends at the next invalid one
        at, length = at[ok], length[ok]
        bad = np.r_[np.cumsum(~valid), 0]
        if len(at):
            tail = bad[at + length - 1] - bad[at]
            length = length - tail
        twice = np.zeros(len(at), bool)
        if plan.within and len(at):
            times = np.zeros(total, np.uint8)
            for k in range(wide):
                times += grams[k : k + total] == least
            twice = (np.maximum.reduceat(times, at) > 1) | (length > wide)
        pieces = -(-length // LONGEST)
        if len(at) and pieces.max() > 1:
            owner = np.repeat(np.arange(len(at)), pieces)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts.append(lo + at[owner] + step * LONGEST)
            counts.append(np.minimum(LONGEST, length[owner] - step * LONGEST))
            keys.append(least[at[owner]])
            doubled.append(twice[owner])
        else:
            starts.append(lo + at)
            counts.append(length)
            keys.append(least[at])
            doubled.append(twice)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Runs(join(starts, np.int64), join(counts, np.int64), join(keys, np.uint64), join(doubled, bool))


def slots(runs: Runs, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (bucket << 40 | fingerprint) of a block in order, and the place of each run's among them."""
    slot = ((runs.key & np.uint64(0xFFFFFF)) % np.uint64(buckets)) << np.uint64(40) | runs.key >> np.uint64(24)
    return np.unique(slot, return_inverse=True)


def pack(prints: np.ndarray) -> bytes:
    return prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def equal_spans(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each span of the bytes a hash, alike in all blocks, and the first span that has the same bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text, size = np.frombuffer(raw + bytes(8), np.uint8), end - begin
    hashes = textnp.word_hashes(text, begin, end)
    order = np.argsort(hashes, kind="stable")
    at = np.flatnonzero(np.r_[True, hashes[order[1:]] != hashes[order[:-1]]])
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[at], np.diff(np.r_[at, len(order)]))
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    copies = np.flatnonzero(first != np.arange(len(first)))
    ok = bool((size[copies] == size[first[copies]]).all())
    for k in range(0, int(size[copies].max(initial=0)), 8):
        copies = copies[size[copies] > k]
        differ = eight[begin[copies] + k] ^ eight[begin[first[copies]] + k] if ok else np.zeros(0, np.uint64)
        ok = ok and not (differ & textnp.LOW_BYTES[np.minimum(size[copies] - k, 8)]).any()
    if not ok:  # two spans that differ share a hash
        seen: dict[bytes, int] = {}
        first = np.array([seen.setdefault(raw[a:b], k) for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True))], np.int64)
    return hashes, first


class Block:
    """One block's documents in order of doc_id, with its runs."""

    def __init__(self, table: pa.Table, plan: Plan, buckets: int):
        table = table.sort_by([("doc_key", "ascending"), ("text", "ascending")])
        self.plan, self.buckets = plan, buckets
        self.ids, self.doc_key, self.text = table.column("doc_id"), table.column("doc_key").to_numpy(), table.column("text")
        self.symbols, self.offsets = plan.symbols(self.text)
        self.runs = find_runs(self.symbols, self.offsets, plan)
        self.slot, self.place = slots(self.runs, buckets)
        self.doc = np.searchsorted(self.offsets, self.runs.start, "right") - 1

    def counted(self) -> np.ndarray:
        """For each slot how often it counts here, at most ``MOST``."""
        n = np.bincount(self.place, minlength=len(self.slot))
        if self.plan.within:
            n = n + np.bincount(self.place, self.runs.doubled, minlength=len(self.slot)).astype(np.int64)
        else:  # one for each document
            order = np.argsort(self.place, kind="stable")  # runs of a place stay in order of document
            p, k = self.place[order], self.doc_key[self.doc[order]]
            fresh = np.r_[True, (p[1:] != p[:-1]) | (k[1:] != k[:-1])] if len(p) else np.zeros(0, bool)
            n = np.bincount(p[fresh], minlength=len(self.slot))
        return np.minimum(n, MOST).astype(np.uint16)

    def choose(self, told: pa.Table, shards: int) -> None:
        """Sets what is sent: pieces (start, windows) with shard, and for each recurring run its first equal piece."""
        again, hot = np.zeros(len(self.slot), bool), np.zeros(len(self.slot), bool)
        bucket = (self.slot >> np.uint64(40)).astype(np.int64)
        for b, flags in zip(told.column("bucket").to_pylist(), told.column("flags").to_pylist(), strict=True):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            bits = np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * (hi - lo)).astype(bool)
            again[lo:hi], hot[lo:hi] = bits[: hi - lo], bits[hi - lo :]
        chosen = np.flatnonzero(again[self.place])
        start, count, key = self.runs.start[chosen], self.runs.count[chosen], self.runs.key[chosen]
        is_hot = hot[self.place[chosen]]
        times = np.where(is_hot, count, 1)
        owner = np.repeat(np.arange(len(chosen)), times)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        self.start = start[owner] + step
        self.count = np.where(is_hot[owner], 1, count[owner])
        self.hot = is_hot[owner]
        self.key = key[owner]
        self.raw, cut = self.plan.content(self.text)
        self.begin, self.end = self.start, self.start + self.count + self.plan.window - 1
        if cut is not None:
            self.begin, self.end = cut[self.begin], cut[self.end]
        self.first = np.arange(len(self.start))
        same = self.first.copy() if self.plan.combine else np.flatnonzero(self.hot)
        hashes = np.zeros(len(self.start), np.uint64)
        hashes[same], equal = equal_spans(self.raw, self.begin[same], self.end[same])
        self.first[same] = same[equal]
        self.sent = np.flatnonzero(self.first == np.arange(len(self.first)))
        target = np.where(self.hot[self.sent], hashes[self.sent], textnp.mix(self.key[self.sent].copy()))
        self.shard = (target % np.uint64(shards)).astype(np.int64)

    def piece_doc(self) -> np.ndarray:
        return self.doc_key[np.searchsorted(self.offsets, self.start, "right") - 1]


COUNT_SCHEMA = "block int, bucket int, prints binary, counts binary"
TELL_SCHEMA = "block int, bucket int, flags binary"
SEND_SCHEMA = "block int, shard int, contents binary, sizes binary, windows binary, docs binary"
JUDGE_SCHEMA = "block int, shard int, bits binary"


def _count(plan: Plan, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, plan, buckets)
        counts, bucket = block.counted(), (block.slot >> np.uint64(40)).astype(np.int64)
        found = np.unique(bucket)
        lo, hi = np.searchsorted(bucket, found), np.searchsorted(bucket, found, "right")
        prints = block.slot & np.uint64((1 << 40) - 1)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(found), pa.int32()),
                "bucket": pa.array(found, pa.int32()),
                "prints": pa.array([pack(prints[a:b]) for a, b in zip(lo, hi, strict=True)], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
            }
        )

    return run


def _tell(limit: int):
    return lambda key, table: _told(table, limit)


def _told(table: pa.Table, limit: int) -> pa.Table:
    raw = table.column("prints").to_pylist()
    prints = unpack(b"".join(raw))
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)
    order = np.argsort(prints, kind="stable")
    ranked = prints[order]
    at = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    total = np.repeat(np.add.reduceat(counts[order].astype(np.int64), at), np.diff(np.r_[at, len(ranked)]))
    again, hot = np.zeros(len(prints), bool), np.zeros(len(prints), bool)
    again[order], hot[order] = total > 1, total > limit
    ends = np.cumsum([len(r) // 5 for r in raw])
    flags = [np.packbits(np.r_[again[a:b], hot[a:b]]).tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": pa.array(flags, pa.binary())})


def _send(plan: Plan, buckets: int, shards: int):
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(table, plan, buckets)
        block.choose(told, shards)
        docs = block.piece_doc()[block.sent]
        rows = {name: [] for name in ("block", "shard", "contents", "sizes", "windows", "docs")}
        order = np.argsort(block.shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block.shard[order])) + 1) if len(order) else []:
            rows["block"].append(key[0].as_py())
            rows["shard"].append(int(block.shard[part[0]]))
            begin, end = block.begin[block.sent[part]], block.end[block.sent[part]]
            rows["contents"].append(b"".join([block.raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))
            rows["sizes"].append((end - begin).astype(np.uint32).tobytes())
            rows["windows"].append(block.count[block.sent[part]].astype(np.uint16).tobytes())
            rows["docs"].append(docs[part].tobytes())
        kinds = {"block": pa.int32(), "shard": pa.int32()}
        return pa.table({name: pa.array(values, kinds.get(name, pa.binary())) for name, values in rows.items()})

    return run


def _judge(plan: Plan):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        windows = [np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column("windows").to_pylist()]
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
        size = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("sizes").to_pylist()]).astype(np.int64)
        raw, count = b"".join(table.column("contents").to_pylist()), np.concatenate(windows)
        begin, first = np.cumsum(size) - size, np.cumsum(count) - count
        order = np.argsort(docs, kind="stable")  # a document is in one block, whose pieces are in order
        answers = plan.judge(raw, begin[order], (begin + size)[order], count[order], docs[order], plan.window)
        bits = np.empty(len(answers), bool)
        bits[spread(first[order], count[order])] = answers
        ends = np.cumsum([int(x.sum()) for x in windows])
        out = [np.packbits(bits[a:b]).tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "bits": pa.array(out, pa.binary())})

    return run


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, ``count`` numbers from each, one after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _finish(plan: Plan, buckets: int, shards: int):
    def run(key: tuple, table: pa.Table, both: pa.Table) -> pa.Table:
        block = Block(table, plan, buckets)
        told = both.filter(pc.is_valid(both.column("flags")))
        judged = both.filter(pc.is_valid(both.column("bits")))
        block.choose(told, shards)
        at = np.r_[0, np.cumsum(block.count)]
        earlier = np.zeros(at[-1], bool)
        bits_of = dict(zip(judged.column("shard").to_pylist(), judged.column("bits").to_pylist(), strict=True))
        order = np.argsort(block.shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block.shard[order])) + 1) if len(order) else []:
            pieces = block.sent[part]
            n = block.count[pieces]
            bits = np.unpackbits(np.frombuffer(bits_of[int(block.shard[part[0]])], np.uint8), count=int(n.sum())).astype(bool)
            earlier[spread(at[pieces], n)] = bits
        copies = np.flatnonzero(block.first != np.arange(len(block.first)))
        docs = block.piece_doc()
        whole = copies if plan.within else copies[docs[copies] > docs[block.first[copies]]]
        windows_of = lambda rows: spread(at[rows], block.count[rows])
        earlier[windows_of(whole)] = True
        if not plan.within:  # rows that repeat a doc_id share the answer of its first row
            same = copies[docs[copies] == docs[block.first[copies]]]
            earlier[windows_of(same)] = earlier[windows_of(block.first[same])]
        position = np.repeat(block.start - at[:-1], block.count) + np.arange(at[-1])
        hits = position[earlier]
        edges = np.zeros(len(block.symbols) + 1, np.int32)
        edges[hits] += 1
        edges[hits + plan.window] -= 1
        covered = np.cumsum(edges[:-1]) > 0
        return plan.finish(block.ids, block.text, block.symbols, block.offsets, covered)

    return run


def run(docs: DataFrame, plan: Plan) -> DataFrame:
    """plan.finish's rows for all documents. docs: doc_id, text."""
    if plan.hot > MOST:
        raise ValueError(f"hot is at most {MOST}")
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"))
    full = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    blocks, buckets, shards = max(2 * n, full), max(n, full), max(2 * n, 4 * full)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_key"), F.lit(blocks)).cast("int"))
    # block, bucket and shard numbers are partition numbers, so each is one task's and none gets several by chance
    by_block = lambda df: df.repartitionById(blocks, "block").groupBy("block")
    counts = by_block(rows).applyInArrow(_count(plan, buckets), COUNT_SCHEMA)
    told = counts.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_tell(plan.hot), TELL_SCHEMA)
    sent = by_block(rows).cogroup(by_block(told)).applyInArrow(_send(plan, buckets, shards), SEND_SCHEMA)
    judged = sent.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_judge(plan), JUDGE_SCHEMA)
    both = told.withColumns({"shard": F.lit(None).cast("int"), "bits": F.lit(None).cast("binary")}).unionByName(
        judged.withColumns({"bucket": F.lit(None).cast("int"), "flags": F.lit(None).cast("binary")})
    )
    return by_block(rows).cogroup(by_block(both)).applyInArrow(_finish(plan, buckets, shards), plan.schema)
