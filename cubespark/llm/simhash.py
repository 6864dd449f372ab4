"""SimHash near-dedup by a Gray-order hierarchical index over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, fresh, spread
from .components import components

SEED = 42
#: Children of a node of the index.
FAN = 8
#: Pairs of queries and nodes that go down a level together at most; bounds the memory of a walk.
WALK = 1 << 15
#: Queries that walk together at most, and that a task holds at a time.
STEP, HELD = 1 << 10, 1 << 14
#: Joins without a flat table of groups at most.
LOOSE = 16
#: Ranges of the Gray order at most: as many upper nodes come to the driver. Parts of the queries of a range.
RANGES, PARTS = 1 << 16, 4
#: Words (fixed values: five of the extended Hamming code's) that differ in four bits or more, one for each table of keys.
TABLES = (0x00, 0x0F, 0x33, 0x3C, 0x55)
#: Bits of a key, items of a range, and the bits of 128 in which signatures of similar texts differ at most.
KEY_BITS, PER_RANGE, FAR = 25, 1 << 20, 20


# ---- fingerprints ----


def shingles_of(text: bytes, width: int) -> Iterator[bytes]:
    """Runs of ``width`` words in lower case, repeats included; all words if they are fewer, nothing without words."""
    words = text.lower().split()  # on bytes: A-Z and the six ASCII blanks only
    if len(words) < width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False))


def fingerprint(text: bytes, width: int = 3, chunk: int = 1 << 18) -> int:
    """64 bits: each is set if it is set in over half the hashes of the ``width``-word shingles of ``text``."""
    hashes = map(xxhash.xxh64_intdigest, shingles_of(text, width), repeat(SEED))
    ones, total = np.zeros(64, np.int64), 0
    while len(some := np.fromiter(islice(hashes, chunk), np.uint64)):
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def signature(text: bytes, width: int = 5, chunk: int = 1 << 17) -> bytes:
    """128 bits: each is set if it is set in over half the hashes of the distinct ``width``-word shingles of ``text``; as
    the smallest of them has it where they are split evenly. Zeros without words."""
    hashes = {xxhash.xxh3_128_digest(x) for x in shingles_of(text, width)}
    if not hashes:
        return bytes(16)
    least, total, ones, each = min(hashes), len(hashes), np.zeros(128, np.int64), iter(hashes)
    while some := b"".join(islice(each, chunk)):
        ones += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    tie = np.unpackbits(np.frombuffer(least, np.uint8)).astype(bool)
    return np.packbits(np.where(2 * ones == total, tie, 2 * ones > total)).tobytes()


def signature_column(width: int):
    def prints(texts: pa.Array) -> pa.Array:
        found = np.frombuffer(b"".join([signature(x, width) for x in as_bytes(texts)]), np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return F.arrow_udf(prints, "a long, b long")


def fingerprint_column(width: int):
    def prints(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x, width) for x in as_bytes(texts)), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return F.arrow_udf(prints, "long")


# ---- the index ----


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of ``codes`` in the reflected Gray sequence: neighbours there differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(code: Column) -> Column:
    """A long that sorts codes (as signed longs) by their place in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class Groups:
    """Disjoint sets over 0..n-1 as parent pointers, joined many pairs at a time; ``of`` is flat unless ``merge`` was used."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.merges = self.loose = 0

    def roots(self, some: np.ndarray) -> np.ndarray:
        some = self.of[some]
        while self.loose and ((up := self.of[some]) != some).any():
            some = up
        return some

    def flatten(self) -> None:
        while self.loose and (self.of != (up := self.of[self.of])).any():
            self.of = up
        self.loose = 0

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs; the cost follows their number, not that of all items, as these are made flat at times only."""
        while True:
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            self.merges += 1
            self.loose += 1
        if self.loose > LOOSE:
            self.flatten()

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.merge(a, b)
        self.flatten()


class GrayIndex:
    """Leaves in Gray order under nodes of ``FAN`` children.

    A leaf is a code, or a range of codes by the bits that all of them have (``ands``) and that any has (``ors``).
    A node keeps the bits that all below it share, less those that a node above it keeps already. Going down, a
    query adds up its differences to these patterns; beyond ``most`` the whole group is pruned. ``visits`` counts
    the nodes that were compared, level by level from the leaves up.
    """

    def __init__(self, ands: np.ndarray, ors: np.ndarray, most: int):
        self.most = most
        low, high = [ands], [ors]
        while len(low[-1]) > FAN or len(low) == 1:
            starts = np.arange(0, len(low[-1]), FAN)
            low.append(np.bitwise_and.reduceat(low[-1], starts))
            high.append(np.bitwise_or.reduceat(high[-1], starts))
        shared = [~(x ^ y) for x, y in zip(low, high, strict=True)]
        masks = [m if k == len(shared) - 1 else m & ~np.repeat(shared[k + 1], FAN)[: len(m)] for k, m in enumerate(shared)]
        self.sizes = [len(x) for x in low]
        # the children of a node are a row, so that going down takes whole rows
        rows = lambda x: np.pad(x, (0, -len(x) % FAN)).reshape(-1, FAN)
        self.values, self.masks = [rows(x) for x in low], [rows(x) for x in masks]
        self.visits = [0] * len(low)

    def walks(self, codes: np.ndarray, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) in parts: the leaves that no pattern on the way rules out for each of ``codes``.

        ``skip(level, q, node)`` may drop more pairs of a query and a node on the way down. ``WALK`` pairs at most go
        down a level together, the others wait: memory is bounded whatever is pruned, and how many queries walk
        together doesn't depend on the size of the index.
        """
        waiting = [(len(self.sizes), np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint8))]
        while waiting:
            level, q, node, gone = waiting.pop()
            if level == 0:
                yield q, node
                continue
            if len(q) > WALK:
                waiting.append((level, q[WALK:], node[WALK:], gone[WALK:]))
                q, node, gone = q[:WALK], node[:WALK], gone[:WALK]
            level -= 1
            differ = self.values[level].take(node, axis=0)
            differ ^= codes[q][:, None]
            differ &= self.masks[level].take(node, axis=0)
            now = (np.bitwise_count(differ) + gone[:, None]).ravel()
            on = np.flatnonzero(now <= self.most)
            above = on // FAN
            q, node, gone = q[above], node[above] * FAN + on % FAN, now[on]
            self.visits[level] += len(now)
            if self.sizes[level] % FAN:
                real = node < self.sizes[level]
                q, node, gone = q[real], node[real], gone[real]
            if skip is not None and len(q):
                on = skip(level, q, node)
                q, node, gone = q[on], node[on], gone[on]
            if len(q):
                waiting.append((level, q, node, gone))

    def walk(self, codes: np.ndarray, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """All parts of ``walks``."""
        parts = list(self.walks(codes, skip))
        q, leaf = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in parts)]) for i in (0, 1))
        return q, leaf


class Linker:
    """Joins queries with the items of one range that are near them, and tells which links did it.

    An item is a row whose first number is its code. Codes are near if they differ in ``most`` bits or fewer. With
    ``far`` items are near only if, besides, all their other numbers differ in ``far`` bits or fewer together.
    """

    def __init__(self, items: np.ndarray, most: int, far: int | None = None):
        items = items.reshape(len(items), -1)
        self.items = items[np.argsort(gray_rank(items[:, 0]), kind="stable")]
        self.codes = np.ascontiguousarray(self.items[:, 0])
        self.most, self.far, self.index = most, far, GrayIndex(self.codes, self.codes, most)
        self.own = np.arange(len(items))  # groups of the range's items so far, by their least place

    def _near(self, queries: np.ndarray, places: np.ndarray) -> np.ndarray:
        if self.far is None:
            return np.bitwise_count(queries[:, 0] ^ self.codes[places]) <= self.most
        return np.bitwise_count(queries[:, 1:] ^ self.items[places, 1:]).sum(axis=1) <= self.far

    def link(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (a, b), pairs of items, of a spanning forest: with those of earlier calls they join what is near.

        Nodes whose items all belong to a query's group are passed over. One item of each group of items is tried on
        the way down, so that a query of a dense group meets it soon and passes over the rest.
        """
        queries = queries.reshape(len(queries), -1)
        queries = queries[np.argsort(gray_rank(queries[:, 0]), kind="stable")]  # neighbours walk the same nodes
        n, before = len(self.codes), self.own
        groups = Groups(n + len(queries))
        groups.of[:n] = before
        same, seen, merges = self._uniform(before), sum(self.index.visits), 0
        for begin in range(0, len(queries), STEP):
            some = queries[begin : begin + STEP]
            at = n + begin

            def skip(level, q, node, some=some, at=at):
                one = same[level][node]  # of some time ago: what was one group then is one now
                whole = np.flatnonzero(one >= 0)
                if not len(whole):
                    return slice(None)
                apart = groups.roots(one[whole]) != groups.roots(at + q[whole])
                if level:
                    try_ = whole[apart]
                    first = node[try_] * FAN**level
                    near = self._near(some[q[try_]], first)
                    groups.merge(at + q[try_[near]], first[near])
                    apart = groups.roots(one[whole]) != groups.roots(at + q[whole])
                on = np.ones(len(q), bool)
                on[whole] = apart
                return on

            for q, leaf in self.index.walks(np.ascontiguousarray(some[:, 0]), skip):
                if self.far is not None:
                    near = self._near(some[q], leaf)
                    q, leaf = q[near], leaf[near]
                groups.merge(at + q, leaf)
                # groups are told anew once as much work is done as that takes
                if groups.merges != merges and sum(self.index.visits) - seen > n:
                    groups.flatten()
                    same, seen, merges = self._uniform(groups.of[:n]), sum(self.index.visits), groups.merges
        groups.flatten()
        self.own = groups.of[:n]
        every = np.concatenate([self.items, queries])
        roots = np.flatnonzero((before == np.arange(n)) & (self.own != before))
        moved = np.concatenate([roots, n + np.flatnonzero(groups.of[n:] != np.arange(n, len(every)))])
        a, b = every[moved], every[groups.of[moved]]
        apart = (a != b).any(axis=1)
        return a[apart], b[apart]

    def _uniform(self, of: np.ndarray) -> list[np.ndarray]:
        """For each level the group that all below a node belong to, or -1."""
        levels = [of]
        for _ in self.index.sizes[1:]:
            starts = np.arange(0, len(levels[-1]), FAN)
            low, high = np.minimum.reduceat(levels[-1], starts), np.maximum.reduceat(levels[-1], starts)
            levels.append(np.where(low == high, low, -1))
        return levels


# ---- the distributed join ----


def _router(nodes: list[tuple[int, int, int]], most: int):
    """From (range, code, ..) rows to (cell, role, items): role 0 are the items of a range, role 1 the queries that the
    upper nodes don't rule out there. ``nodes``: (range, and, or) in Gray order."""
    ands, ors = (np.array([x[i] for x in nodes], np.int64).view(np.uint64) for i in (1, 2))
    place = np.full(max(x[0] for x in nodes) + 1, -1)
    place[[x[0] for x in nodes]] = np.arange(len(nodes))

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(ands, ors, most)
        for part in parts:
            if not len(part):
                continue
            home = place[part.column(0).to_numpy()]
            items = np.stack([x.to_numpy().view(np.uint64) for x in part.columns[1:]], axis=1)
            codes = np.ascontiguousarray(items[:, 0])
            out = [(int(r) * PARTS + p, 0, items[home == r].tobytes()) for r in np.unique(home) for p in range(PARTS)]
            q, target = index.walk(codes)
            # of two ranges one sends to the other: as many to lower as to higher ones
            on = (target == home[q]) | (((home[q] + target) % 2 == 0) == (target > home[q]))
            q, target = q[on], target[on]
            mixed = np.bitwise_xor.reduce(items[q], axis=1) * np.uint64(0x9E3779B97F4A7C15)
            cell = target * PARTS + (mixed >> np.uint64(32)).astype(np.int64) % PARTS
            order = np.argsort(cell, kind="stable")
            cell, q = cell[order], q[order]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            out += [(int(cell[i]), 1, items[q[i:j]].tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            cells, roles, held = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(roles, pa.int32()), pa.array(held, pa.binary())], ["cell", "role", "items"])

    return route


def _cell_linker(width: int, most: int, far: int | None):
    """Links of the cells of a task; rows come sorted by (cell, role), so the items of a range come before its queries."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting, size, linker = None, [], [], 0, None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size, linker
            if waiting:
                if linker is None:
                    linker = Linker(np.concatenate(held), most, far)
                both = linker.link(np.concatenate(waiting))
                waiting, size = [], 0
                columns = [np.ascontiguousarray(x[:, i]).view(np.int64) for x in both for i in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [f"{x}{i}" for x in "xy" for i in range(width)])

        for part in parts:
            for cell, role, raw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if cell != now:
                    yield from answer()
                    now, held, linker = cell, [], None
                items = np.frombuffer(raw, np.uint64).reshape(-1, width)
                if role == 0:
                    held.append(items)
                    continue
                waiting.append(items)
                size += len(items)
                if size >= HELD:
                    yield from answer()
        yield from answer()

    return batches


def item_links(items: DataFrame, ranges: int, most: int, far: int | None = None) -> DataFrame:
    """Links (x0, .., y0, ..) that join all of ``items`` (a code and further longs, distinct rows) that hang together.

    One hierarchical index in Gray order over all codes. They are sorted by Gray rank and cut into ``ranges`` of equal
    size (``RANGES`` at most, whatever the input); the bits that a range shares are the index's upper nodes. Each code
    walks the upper nodes and goes, as a query, to its own range and to those of the others that accumulated
    differences don't rule out, one way between any two ranges. There the lower nodes, built from the range's codes,
    are walked down to the codes. The queries of a range are dealt into ``PARTS`` cells; a task holds one range and
    ``HELD`` queries at a time. Only links of a spanning forest leave a cell, never all pairs. Every code takes this
    way, whatever the sizes.
    """
    code, *rest = items.columns
    order = gray_order(F.col(code))
    ranged = cut(items.repartitionByRange(max(1, min(RANGES, ranges)), order, *rest).select(F.spark_partition_id().alias("range"), *items.columns))
    nodes = ranged.groupBy("range").agg(F.bit_and(code).alias("low"), F.bit_or(code).alias("high"), F.min(order).alias("rank")).collect()
    schema = ", ".join(f"{x}{i} long" for x in "xy" for i in range(len(items.columns)))
    if not nodes:
        return items.sparkSession.createDataFrame([], schema)
    upper = [(r["range"], r["low"], r["high"]) for r in sorted(nodes, key=lambda r: (r["rank"], r["range"]))]
    routed = ranged.mapInArrow(_router(upper, most), "cell long, role int, items binary")
    rows = routed.repartition("cell").sortWithinPartitions("cell", "role")
    return rows.mapInArrow(_cell_linker(len(items.columns), most, far), schema)


def fingerprint_links(codes: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that join all of ``codes`` (fp, distinct) that hang together by ``most`` or fewer differing bits."""
    codes = cut(codes.select("fp"))
    return item_links(codes, isqrt(codes.count()) // 4, most).select(F.col("x0").alias("a"), F.col("y0").alias("b")).distinct()


def signature_links(signatures: DataFrame) -> DataFrame:
    """Links (a, b), ids, that join ``signatures`` (id, a, b; distinct) that hang together by ``FAR`` or fewer of 128 bits.

    Each signature has a key of ``KEY_BITS`` of its bits in each of five tables; those that agree in a key up to three
    bits are compared whole. A table's keys carry a word that differs from the others' in four bits or more, so one
    Gray-order index holds all tables and its upper nodes keep them apart. Two signatures that differ in 20 bits
    share such a key with a probability of 99.7 %; no link is lost otherwise.
    """
    a, b, low = F.col("a"), F.col("b"), F.lit((1 << KEY_BITS) - 1)
    part = lambda x, at: F.shiftrightunsigned(x, at).bitwiseAND(low)
    mixed = F.shiftrightunsigned(a, 2 * KEY_BITS).bitwiseAND(F.lit((1 << 13) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(b, 2 * KEY_BITS).bitwiseAND(F.lit((1 << 12) - 1)), 13))
    keys = [part(a, 0), part(a, KEY_BITS), part(b, 0), part(b, KEY_BITS), mixed]
    code = F.explode(F.array(*(key.bitwiseOR(F.lit(word << KEY_BITS)) for word, key in zip(TABLES, keys, strict=True))))
    n = len(TABLES) * signatures.count()
    found = item_links(signatures.select(code.alias("code"), "a", "b"), max(min(8 * len(TABLES), isqrt(n) // 4), n // PER_RANGE), 3, FAR)
    return found.select(F.xxhash64("x1", "x2").alias("a"), F.xxhash64("y1", "y2").alias("b")).filter("a <> b").distinct()


def similar_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """(doc_id, row_hash, component) of each row of ``docs``: texts of similar ``width``-word shingles share a component.

    Similarity is told by 128-bit SimHash signatures of the distinct shingles: a Jaccard similarity of 0.8 makes them
    differ in 19 bits on average, ``FAR`` or fewer are linked, texts that share a quarter of their shingles differ in
    some 50. A component is all that links reach. Texts without words (null, empty, blank) are one component. Equal
    texts share a signature and enter the index once. Repeated rows are rows like others. An empty table gives an
    empty table. Other columns of ``docs`` are not looked at.
    """
    made = spread(docs).select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row_hash"), signature_column(width)(F.col(text)).alias("s"))
    rows = cut(made.select("doc_id", "row_hash", "s.a", "s.b", F.xxhash64("s.a", "s.b").alias("id")))
    found = components(signature_links(cut(rows.select("id", "a", "b").distinct())))
    named = rows.join(found, F.col("id") == F.col("node"), "left")
    return named.select("doc_id", "row_hash", F.coalesce(F.col("component"), F.col("id")).alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, row_hash, fp, component, component_id) of each row of ``docs``.

    Fingerprints that differ in ``most`` bits or fewer are linked; a component is all that links reach. ``component``
    is its smallest fingerprint as a signed number, component_id its smallest doc_id, null only where none has one.
    Copies of a text share a fingerprint and enter the index once. Near copies whose fingerprints differ in more bits
    aren't linked: the README has the measured recall; ``similar_texts`` links texts that share less. Texts without words (null, empty, blank) have
    fingerprint 0. Repeated rows are rows like others, of equal component. An empty table gives an empty table.
    Other columns of ``docs`` are not looked at.
    """
    rows = cut(spread(docs).select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row_hash"), fingerprint_column(width)(F.col(text)).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(fingerprint_links(prints.select("fp"), most))
    named = prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "component", "component_id")
    return rows.join(named, F.col("fp") == F.col("f")).select("doc_id", "row_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """``docs`` with one row of each component of ``similar_texts``: of the smallest id (null last), then the smallest hash
    of the row."""
    found = similar_texts(docs, text, key, width)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash")).alias("first"))
    of_id, row = fresh(docs, "_id", "_row")
    first = first.select(F.col("first.doc_id").alias(of_id), F.col("first.row_hash").alias(row))
    # the hash alone deals out both sides, so that equal rows meet where they are joined and need no second exchange
    rows = docs.withColumn(row, F.xxhash64(F.col(key), F.col(text)))
    same_id = F.forall(F.array(key), lambda x: x.eqNullSafe(F.col(of_id)))
    return rows.join(first, row).filter(same_id).dropDuplicates([row, key]).select(*docs.columns)
