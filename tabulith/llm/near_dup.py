"""N-gram Jaccard join: groups of documents whose shingle sets nearly agree.

Two documents link when ``|A & B| / |A | B|`` reaches the threshold; a group is
what links reach.  Every link is found, in these steps.

* Each set is ordered by a global order of shingles (frequent ones last); two
  linked sets share one of their first shingles, so only documents that share such
  a shingle can link.  A shingle's leader is its smallest document; documents that
  share a first shingle share its leader, and a document stands under a leader once,
  however many shingles they share.  What is left of a set after a shingle bounds
  the overlap of pairs whose first shared shingle it is, and so their sizes.
* First, every document is paired with the leader it shares most first shingles
  with, and the pair is verified.  Copies and verified pairs give provisional groups.
* What remains are leaders with documents of several groups.  Their documents form
  tiles, ordered by set size and cut into bounded blocks; inside a tile only sizes
  within the threshold's band meet, and only if each is within the size the other's
  first shingles there allow.  A document goes on if some document of another group
  meets it so.
* The tiles of what went on are laid again with hashed bitmaps of the sets, whose bit
  counts bound the overlap from above, and what these leave once more with the sorted
  arrays, whose intersection decides.  A pair already connected inside its tile is skipped, so a
  tile gives fewer links than it has rows, and never lists its pairs.

Hot shingles are combined before shuffling, long lists are cut into blocks and hot
keys of joins are left to adaptive execution.  Null, blank and empty texts have an
empty set and link with nothing.  Shorter texts count as one shingle.  Repeated
rows are separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .rows import keyed, mix, pieces, signed, stored, told_apart

#: Text bytes handled at once by a task.
PIECE = 2_000_000
#: A shingle in at least this share of a piece's documents is counted as frequent.
FREQUENT = 0.01
#: Rows of one block of a tile.
TILE = 1024
#: Shingles of one block of a tile, about.
ITEMS = 2_000_000
#: Slots of the filter that keeps texts of unwanted documents out of a verification.
SLOTS = 1 << 24

#: Bytes of the words that are hashed together, at most.
SHORT = 32

_ODD = [np.uint64(x | 1) for x in np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64).tolist()]
#: The first bytes of eight, by their number.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and the number of words of each text.

    Words stand between ASCII white space, A-Z lower-cased.  Those of up to ``SHORT``
    bytes are hashed eight bytes at a time, all together.
    """
    whole = b"".join([b" ", b" ".join([t or b"" for t in texts]).lower(), b" " * 8])
    data = np.frombuffer(whole, np.uint8)
    space = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(whole) - 7, np.dtype("<u8"), whole, strides=(1,))
    h = length.astype(np.uint64) * _ODD[-1]
    for j in range(0, SHORT, 8):
        on = np.flatnonzero(length > j) if j else slice(None)
        part = eight[starts[on] + j] & _BYTES[np.minimum(length[on] - j, 8)]
        h[on] = mix(h[on] + part)
    for k in np.flatnonzero(length > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest(whole[starts[k] : starts[k] + length[k]])
    borders = np.cumsum([1] + [len(t or b"") + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, borders))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    h, words = word_hashes(texts)
    k = np.minimum(words, width)
    sizes = np.where(words > 0, words - k + 1, 0)
    ends = np.cumsum(sizes)
    at = np.repeat(np.cumsum(words) - words - ends + sizes, sizes) + np.arange(ends[-1])
    k = np.repeat(k, sizes)
    total = k.astype(np.uint64)
    for j in range(width):
        on = slice(None) if not len(k) or k.min() > j else k > j
        total[on] += (mix(h + _ODD[j]) * _ODD[j + 32])[at[on] + j]
    total = mix(total)
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        total[start:end].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    last = np.cumsum(np.r_[0, new])[ends]
    return np.split(total[new], last[:-1])


def bitmap(values: np.ndarray) -> np.ndarray:
    """A bitmap of four to eight bits per value, at least 256 and at most 2**17 bits."""
    bits = min(1 << 17, max(256, 1 << max(0, 4 * len(values) - 1).bit_length()))
    flags = np.zeros(bits, bool)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _profile(width: int):
    """Per document its size, digest and bitmap, and the piece's frequent shingles."""
    heavy = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            every, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= max(3, FREQUENT * len(sets))
            first = [{"token": int(t), "n": int(c)} for t, c in zip(signed(every[often]), n[often])]
            yield pa.record_batch([
                batch.column("rid"), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.array([first] + [None] * (len(sets) - 1), heavy),
            ], ["rid", "id", "n", "digest", "bits", "heavy"])

    return profile


def _leading(width: int, numer: int, denom: int, heavy):
    """``(token, rid, n, most)`` for the first shingles of every set; copies in a piece once.

    If the shingle is the first that two sets share, the overlap is at most what is
    left of the set from there on; ``most`` is the largest size of the other set at
    which that can still reach the threshold.
    """

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = heavy.value
        for batch in pieces(batches, "text", PIECE):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            rid = batch.column("rid").to_numpy()
            seen: set[bytes] = set()
            out_t, out_r, out_n, out_m = [], [], [], []
            for k in np.argsort(rid, kind="stable"):
                s = sets[k]
                d = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                first = len(s) - (numer * len(s) + denom - 1) // denom + 1
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, ranks[at], 0)
                    s = s[np.lexsort((s, rank))] if rank.any() else s
                out_t.append(s[:first])
                out_r.append(np.full(first, rid[k]))
                out_n.append(np.full(first, len(s), np.int32))
                out_m.append(((len(s) - np.arange(first)) * (numer + denom) // numer - len(s)).astype(np.int32))
            if out_t:
                yield pa.record_batch([pa.array(signed(np.concatenate(out_t))), pa.array(np.concatenate(out_r)), pa.array(np.concatenate(out_n)), pa.array(np.concatenate(out_m))], ["token", "rid", "n", "most"])

    return leading


def _wanted(width: int, slots):
    """The sets of the documents whose slot is marked."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = slots.value
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            keep = (marks[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            for part in pieces(iter([batch.filter(pa.array(keep == 1))]), "text", PIECE):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                yield pa.record_batch([part.column("rid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rid", "tokens"])

    return wanted


def reach(x: np.ndarray, y: np.ndarray, numer: int, denom: int) -> bool:
    """Exact test of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return denom * common >= numer * (len(x) + len(y) - common)


def _likely(numer: int, denom: int):
    """The pairs whose bitmaps do not exclude a link."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("m", "n", "left", "right"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                x, y = folded(x, w), folded(y, w)
                common, own, other = (int(np.bitwise_count(b).sum()) for b in (x & y, x, y))
                keep.append(min(m - own, n - other) + common >= -(-numer * (m + n) // (numer + denom)))
            yield pa.record_batch([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return likely


def _decide(numer: int, denom: int):
    """Exact intersection of the two sorted arrays of each pair."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                reach(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), numer, denom)
                for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            ]
            yield pa.record_batch([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return decide


class Stack:
    """Bitmaps of rows in order of set size, laid out so that a row meets a slice.

    Rows of one width stand together with the rows of the next width, folded; sizes
    within a threshold of at least one half differ by one width at most, and rows
    that are wider still are folded as well.
    """

    def __init__(self, bits: list[np.ndarray]):
        self.width = np.array([len(b) for b in bits])
        self.first, self.rows, self.ones = {}, {}, {}
        for w in np.unique(self.width).tolist():
            start = int(np.searchsorted(self.width, w))
            self.first[w] = start
            self.rows[w] = [folded(b, w) for b in bits[start:]] if w < self.width[-1] else bits[start:]
            self.rows[w] = np.stack(self.rows[w])
            self.ones[w] = np.bitwise_count(self.rows[w]).sum(axis=1).astype(np.int64)

    def overlap(self, a: int, n: np.ndarray, start: int, end: int) -> np.ndarray:
        """Upper bounds of the overlap of row ``a`` with rows ``start`` to ``end``."""
        w = int(self.width[a])
        rows, ones, first = self.rows[w], self.ones[w], self.first[w]
        common = np.bitwise_count(rows[start - first : end - first] & rows[a - first]).sum(axis=1).astype(np.int64)
        return common + np.minimum(n[a] - ones[a - first], n[start:end] - ones[start - first : end - first])


def tile_survivors(
    n: np.ndarray, group: np.ndarray, mask: np.ndarray, most: np.ndarray, bits: list[np.ndarray] | None, block: np.ndarray | None,
    numer: int, denom: int,
) -> np.ndarray:
    """Rows that may link with a row of another group; ``n`` ascends.

    ``mask`` has a bit for each first shingle of the row under this leader; pairs
    without a common bit share none.  ``most`` is the largest partner these shingles
    allow.  With ``block``, only rows of different blocks meet.  Without ``bits``, no
    overlap is bounded.
    """
    stack, alive = Stack(bits) if bits is not None else None, np.zeros(len(n), bool)
    ends = np.searchsorted(n, n * denom // numer, "right")
    for a in range(len(n) - 1):
        start, end = a + 1, int(ends[a])
        if start >= end:
            continue
        meets = (group[start:end] != group[a]) & ((mask[start:end] & mask[a]) != 0)
        meets &= (n[start:end] <= most[a]) & (most[start:end] >= n[a])
        if block is not None:
            meets &= block[start:end] != block[a]
        if not meets.any():
            continue
        if stack is not None:
            need = -(-numer * (n[a] + n[start:end]) // (numer + denom))
            meets &= stack.overlap(a, n, start, end) >= need
        if meets.any():
            alive[a] = True
            alive[start:end] |= meets
    return alive


def tile_links(n: np.ndarray, group: np.ndarray, sets: list[np.ndarray], block: np.ndarray | None, numer: int, denom: int) -> list[tuple[int, int]]:
    """Exact links that connect the groups of a tile, no more than connect them."""
    names, root = np.unique(group, return_inverse=True)
    ends, links = np.searchsorted(n, n * denom // numer, "right"), []
    for a in range(len(n) - 1):
        at, end = a + 1, int(ends[a])
        while at < end and len(names) > 1:
            open_ = root[at:end] != root[a]
            if block is not None:
                open_ &= block[at:end] != block[a]
            for b in (np.flatnonzero(open_) + at).tolist():
                at = b + 1
                if reach(sets[a], sets[b], numer, denom):
                    links.append((a, b))
                    root[root == root[b]] = root[a]
                    break
            else:
                break
    return links


def _walk(finish):
    """Hands each tile (rows sorted by leader, block pair and size) to ``finish``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            t, i, j = (batch.column(c).to_numpy() for c in ("leader", "i", "j"))
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(t)]):
                if s == e:
                    continue
                now = (t[s], i[s], j[s])
                if now != key and held:
                    yield from finish(key, pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = now
                held.append(batch.slice(int(s), int(e - s)))
        if held:
            yield from finish(key, pa.Table.from_batches(held).combine_chunks())

    return walk


def _columns(key, rows):
    n, group, rid, block = (rows.column(c).to_numpy() for c in ("n", "component", "rid", "block"))
    return n, group, rid, block if key[1] != key[2] else None


#: Columns of a tile's row.
TILED = {"leader": "long", "i": "int", "j": "int", "block": "int", "n": "long", "rid": "long", "component": "long", "mask": "long", "most": "int"}


def _survivors(numer: int, denom: int, with_bits: bool):
    """The rows of each tile that some pair may link, by sizes or also by bitmaps."""

    def finish(key, rows):
        n, group, rid, block = _columns(key, rows)
        if group.min() == group.max():
            return
        bits = [np.frombuffer(b, np.uint64) for b in rows.column("bits").to_pylist()] if with_bits else None
        mask, most = (rows.column(c).to_numpy() for c in ("mask", "most"))
        alive = tile_survivors(n, group, mask, most, bits, block, numer, denom)
        yield from rows.filter(pa.array(alive)).select(list(TILED)).to_batches()

    return _walk(finish)


def _links(numer: int, denom: int):
    """The links that connect the groups of each tile."""

    def finish(key, rows):
        n, group, rid, block = _columns(key, rows)
        sets = [np.frombuffer(b, np.uint64) for b in rows.column("tokens").to_pylist()]
        links = tile_links(n, group, sets, block, numer, denom)
        if links:
            at = np.array(links)
            yield pa.record_batch([pa.array(rid[at[:, 0]]), pa.array(rid[at[:, 1]])], ["src", "dst"])

    return _walk(finish)


class NearDuplicates:
    """The join over one table; ``groups()`` gives the result."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, numer: int, denom: int):
        self.width, self.numer, self.denom = width, numer, denom
        self.spark = docs.sparkSession
        self.given = keyed(docs, id_col, text=docs[text_col].cast("string").cast("binary"))
        kind = dict(self.given.dtypes)["id"]
        self.profiles = stored(self.given.select("rid", "id", "text").mapInArrow(
            _profile(width), f"rid long, id {kind}, n long, digest binary, bits binary, heavy array<struct<token:bigint,n:bigint>>"
        ), "near-profiles")

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequent shingles, sorted, with the rank of their count.

        A shingle stands here if it is in ``FREQUENT / 2`` of all documents by the
        counts of the pieces that saw it often; that bounds the list by the mean set
        size over ``FREQUENT / 2``.  It only steers the order, so it cannot lose links.
        """
        total = self.profiles.count()
        counts = self.profiles.where("heavy is not null").select(F.explode("heavy").alias("h")).groupBy("h.token").agg(F.sum("h.n").alias("n"))
        rows = counts.where(F.col("n") >= max(3.0, FREQUENT / 2 * total)).toArrow()
        tokens = rows.column("token").to_numpy().view(np.uint64)
        ranks = rows.column("n").to_numpy()
        order = np.argsort(tokens)
        return tokens[order], ranks[order]

    def copies(self) -> DataFrame:
        """``src, dst``: the first document with a set, and each later one."""
        full = self.profiles.where("n > 0")
        first = full.groupBy("digest").agg(F.min("rid").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "src")
        return stored(full.select("digest", F.col("rid").alias("dst")).join(first, "digest").where("src <> dst").select("src", "dst"), "near-copies")

    def members(self, copies: DataFrame) -> DataFrame:
        """``leader, rid, votes, mask, most``: once for each document under a leader.

        ``votes`` counts the first shingles under the leader, ``mask`` hashes them,
        ``most`` is the largest partner that one of them allows.
        Copies are left out but for the first.  Of a pair, the smaller set has the
        first shared shingle where ``most`` still allows its own size, so only such
        rows can lead; other rows stay if ``most`` allows the leader's size, the
        smallest partner they can have there.
        """
        heavy = self.spark.sparkContext.broadcast(self.frequent())
        lead = self.given.select("rid", "text").mapInArrow(_leading(self.width, self.numer, self.denom, heavy), "token long, rid long, n int, most int")
        lead = lead.join(copies.select(F.col("dst").alias("rid")), "rid", "left_anti")
        low = lead.where("most >= n").groupBy("token").agg(F.min(F.struct("n", "rid")).alias("low")).select(
            "token", F.col("low.n").alias("least"), F.col("low.rid").alias("leader")
        )
        under = lead.select("token", "rid", "most").join(low, "token").where("rid <> leader and most >= least")
        return stored(under.groupBy("leader", "rid").agg(
            F.count(F.lit(1)).alias("votes"), F.expr("bit_or(shiftleft(1L, int(token & 63)))").alias("mask"), F.max("most").alias("most")
        ), "near-members")

    def arrays(self, rids: DataFrame) -> DataFrame:
        """``rid, tokens`` of at least the documents in ``rids``.

        A fixed number of slots is marked, so that the sets of most other documents
        are not built.
        """
        slot = F.pmod(F.xxhash64("rid"), F.lit(SLOTS)).cast("int")
        ends = rids.select(slot.alias("slot"))
        marks = ends.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()
        filled = np.zeros(SLOTS // 64, np.uint64)
        filled[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
        slots = self.spark.sparkContext.broadcast(filled)
        return self.given.select("rid", slot.alias("slot"), "text").mapInArrow(_wanted(self.width, slots), "rid long, tokens binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``src, dst`` whose sets reach the threshold."""
        left = self.profiles.select(F.col("rid").alias("src"), F.col("n").alias("m"), F.col("bits").alias("left"))
        right = self.profiles.select(F.col("rid").alias("dst"), "n", F.col("bits").alias("right"))
        banded = pairs.join(left, "src").join(right, "dst").where(
            (F.col("m") * self.denom >= F.col("n") * self.numer) & (F.col("n") * self.denom >= F.col("m") * self.numer)
        )
        pairs = stored(banded.select("src", "dst", "m", "n", "left", "right").mapInArrow(
            _likely(self.numer, self.denom), "src long, dst long"
        ), "near-pairs")
        sets = self.arrays(pairs.select(F.explode(F.array("src", "dst")).alias("rid")))
        left = sets.select(F.col("rid").alias("src"), F.col("tokens").alias("left"))
        right = sets.select(F.col("rid").alias("dst"), F.col("tokens").alias("right"))
        return stored(pairs.join(left, "src").join(right, "dst").select("src", "dst", "left", "right").mapInArrow(
            _decide(self.numer, self.denom), "src long, dst long"
        ), "near-links")

    def across(self, members: DataFrame, components: DataFrame) -> DataFrame:
        """Links that connect the different components under each leader.

        The leader itself allows any shingle and any size.
        """
        leaders = members.select("leader").distinct().select(
            "leader", F.col("leader").alias("rid"), F.lit(-1).cast("long").alias("mask"), F.lit((1 << 31) - 1).alias("most")
        )
        members = members.select("leader", "rid", "mask", "most").unionByName(leaders).join(self.profiles.select("rid", "n"), "rid")
        known = members.join(components.select(F.col("id").alias("rid"), "component"), "rid", "left").withColumn(
            "component", F.coalesce("component", "rid")
        )
        mixed = known.groupBy("leader").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")
        ).where("low < high").select("leader", F.ceil(F.greatest(F.col("size") / TILE, F.col("total") / ITEMS)).cast("int").alias("blocks"))
        rows = known.join(mixed, "leader").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*TILED)
        tile, kinds = ["leader", "i", "j"], ", ".join(f"{k} {t}" for k, t in TILED.items())

        def survivors(rows: DataFrame, with_bits: bool) -> DataFrame:
            laid = rows.repartition(*tile).sortWithinPartitions(*tile, "n", "rid")
            return stored(laid.mapInArrow(_survivors(self.numer, self.denom, with_bits), kinds), "near-survivors")

        alive = survivors(rows, False)
        alive = survivors(alive.join(self.profiles.select("rid", "bits"), "rid"), True)
        full = alive.join(self.arrays(alive.select("rid")), "rid")
        return stored(full.repartition(*tile).sortWithinPartitions(*tile, "n", "rid").mapInArrow(
            _links(self.numer, self.denom), "src long, dst long"
        ), "near-links")

    def groups(self) -> DataFrame:
        """``rid, id, n, component``; the component is the smallest ``rid`` of the group."""
        copies = self.copies()
        members = self.members(copies)
        best = members.groupBy("rid").agg(F.max(F.struct("votes", (-F.col("leader")).alias("low"))).alias("best"))
        links = self.verified(best.select((-F.col("best.low")).alias("src"), F.col("rid").alias("dst")))
        links = links.unionByName(self.across(members, connected_components(links)))
        found = connected_components(links).select(F.col("id").alias("src"), "component")
        first = self.profiles.select("rid", "id", "n").join(copies.select(F.col("dst").alias("rid"), "src"), "rid", "left").withColumn(
            "src", F.coalesce("src", "rid")
        )
        return first.join(found, "src", "left").select("rid", "id", "n", F.coalesce("component", "src").alias("component"))


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, numer: int = 80, denom: int = 100
) -> DataFrame:
    """``rid, id, n, component``: documents with the smallest key their links reach.

    ``n`` is the number of distinct shingles of ``width`` words; the similarity is at
    least ``numer / denom``.
    """
    return NearDuplicates(docs, id_col, text_col, width, numer, denom).groups()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the first document of each group; same columns.

    Rows that share an id or have none are told apart; of equal ones the first stays.
    """
    rows, key = told_apart(docs, id_col)
    gone = near_duplicate_groups(rows, key, text_col, **options).where("rid <> component").select(F.col("id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)
