"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The product of the incidence matrix with its transpose holds, for two documents, the number of shingles they share. It
is taken by blocks of columns, rare shingles first, and size-derived bounds discard pairs:

* Documents of equal shingle sets are one *class* (one matrix row).
* With ``need(n) = ceil(t n)``, two classes that link share a column among the first ``n - need(n) + 1`` of each, in any
  order of the columns that all classes use. Only this block of columns is multiplied. Rare columns come first; the
  ``heavy`` most frequent ones last (a bounded list; it steers cost, never results).
* Overlap counts of that block are summed per pair. Pairs are dropped when their sizes, the places where they met, or
  count plus what is left cannot reach ``ceil(t / (1 + t) * (a + b))``.
* What survives is intersected on whole rows; the exact test is ``den * intersection >= num * union``.
* A column of over ``wide`` classes emits no pairs within itself: its members in the order of their sizes are paired with
  the next ones and with the smallest ones (linear), and the links that this finds are contracted.

A pair that shares a wide column may have lost counts. If its classes are still in different components, both are in a
wide column that holds more than one component. A second round takes just the classes of such columns, counts all their
columns, orders these anew and asks for more: the *first* column that a pair shares has, in both rows, as many columns
from there on as the overlap needs. For classes that have a passage in common this holds for hardly more pairs than link,
since what is their own comes first. A sketch of each row, the parities of its columns in 512 places, bounds the overlap of
near copies: parities that differ are columns that are not shared. Every pair of different components that passes is
intersected on whole rows, narrow columns and the neighbours in wide ones first, then, of wide columns that still hold
several components, the rest.

So components are exact, whatever is wide. No column yields all its pairs, unless they all may link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, distinct_sets, forget, hot_join, kept, mixed, only, small
from .graph import components

ENTRY = "key long, cls long, n int, pos int, hc int"
_LIVE = "n > 0 and doc_id is not null"
PAIR = "kind int, a long, b long, na int, nb int, ha int, hb int, cnt int"


def _class_of(s: np.ndarray) -> int:
    return int(mixed(s.sum(dtype=np.uint64, keepdims=True) * np.uint64(3) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def _sets(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Batch, first row and shingle sets of the rows from there on, a chunk of text at a time."""
    only()
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for i, j in chunks(offsets):
            yield batch, i, distinct_sets(data, offsets[i : j + 1], width)


def classes(docs: DataFrame, id_col: str, text_col: str, width: int = 5) -> DataFrame:
    """``doc_id, th, cls, n``: each row's text by hash, its class (0 for an empty set) and the size of its shingle set."""

    def run(batches):
        for batch, i, sets in _sets(batches, 2, width):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), batch.column(1).slice(i, len(sets)), pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "th", "cls", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, th long, cls long, n long")


def _frequent(docs: DataFrame, text_col: str, width: int, tau: int, heavy: int) -> np.ndarray:
    """The at most ``heavy`` most frequent of the shingles that over ``tau`` documents hold among their lower two fifths, rarest first."""

    def run(batches):
        for _, _, sets in _sets(batches, 0, width):
            low = [s[: (2 * len(s) + 4) // 5] for s in sets]
            key, count = np.unique(np.concatenate(low), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int32))], ["key", "c"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, c int").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > tau)
    top = found.orderBy(F.desc("c"), "key").limit(heavy).toPandas()
    return top.key.to_numpy(np.int64)[::-1].copy().view(np.uint64)


def _hot(reps: DataFrame, total: int) -> dict[int, int]:
    """Of classes that over a ten-thousandth of all rows are in, so at most 10,000, the smallest id."""
    found = reps.where(F.col("c") > max(16, -(-total // 10_000))).select("cls", "doc_id").toPandas()
    return dict(zip(found.cls.tolist(), found.doc_id.tolist(), strict=True))


def _entries(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, frequent: np.ndarray, hot: dict[int, int]) -> DataFrame:
    """The block of columns that is multiplied, by rows: for each class its first columns in the common order.

    A class of many rows speaks through the row of its smallest id, others perhaps more than once.
    """
    rank = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[rank], rank, hot))

    def run(batches):
        known, place, speaker = shared.value
        for batch, i, sets in _sets(batches, 1, width):
            out, seen = [], set()
            for s, own in zip(sets, batch.column(0).slice(i, len(sets)).to_pylist(), strict=True):
                n, c = len(s), _class_of(s)
                if not n or own is None or c in seen or speaker.get(c, own) != own:
                    continue
                seen.add(c)
                p = n - -(-num * n // den) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    rare, late = s[~hit], hit.nonzero()[0]
                    k = s[late[np.argsort(place[at[late]])]] if len(rare) < p else s[:0]
                else:
                    rare, k = s, s[:0]
                first = np.concatenate([rare[:p], k])[:p]
                out.append((first, c, n, max(0, p - len(rare))))
            if out:
                sizes = np.array([len(x[0]) for x in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out]).view(np.int64))]
                    + [pa.array(np.repeat(np.array([x[1] for x in out], np.int64), sizes)), pa.array(np.repeat(np.array([x[2] for x in out], np.int32), sizes))]
                    + [pa.array((np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)), pa.array(np.repeat(np.array([x[3] for x in out], np.int32), sizes))],
                    ["key", "cls", "n", "pos", "hc"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENTRY)


def _columns(batches: Iterator[pa.RecordBatch], over: int | None = None, limit: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Sorted entries in pieces that end where a key ends. Only a key's own rows are ever held beyond a batch.

    With ``over``, a key of more than ``limit`` rows comes in pieces that share ``over`` rows, so each has more than that.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # keys ascend
        if cut:
            head = [c[:cut] for c in cols]
            yield [np.concatenate(x) for x in zip(*held, head, strict=True)] if held else head
            held = []
        held.append([c[cut:] for c in cols])
        if over is not None and sum(len(h[0]) for h in held) > limit:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield whole
            held = [[c[-over:] for c in whole]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _fits(num: int, den: int, na, nb, pa_, pb) -> np.ndarray:
    """Sizes and places of a shared column that leave room for the overlap a link needs, were all before and after shared.

    Every shared column of a pair that links passes, so its counts are whole.
    """
    need = -(-num * (na.astype(np.int64) + nb) // (num + den))
    off = pa_ - pb
    return (num * np.maximum(na, nb).astype(np.int64) <= den * np.minimum(na, nb)) & (np.minimum(na - np.maximum(off, 0), nb - np.maximum(-off, 0)) >= need)


def _batch(kind, a, b, na, nb, ha, hb, cnt) -> pa.RecordBatch:
    names = [x.split()[0] for x in PAIR.split(", ")]
    cols = [np.full(len(a), kind, np.int32), a.astype(np.int64), b.astype(np.int64), *(x.astype(np.int32) for x in (na, nb, ha, hb, cnt))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _counted(a, b, na, nb, ha, hb) -> pa.RecordBatch:
    """Pairs with the number of times each came up here; the smaller class first."""
    swap = a > b
    a, b, na, nb, ha, hb = (np.where(swap, y, x) for x, y in ((a, b), (b, a), (na, nb), (nb, na), (ha, hb), (hb, ha)))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    lead = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return _batch(0, a[lead], b[lead], *(x[order][lead] for x in (na, nb, ha, hb)), np.diff(np.append(lead, len(a))))


def _neighbours(start: int, count: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a column's members, each with the next ``near`` and with the ``near`` smallest ones."""
    place = np.arange(start, start + count)
    pairs = [(place[: count - d], place[d:]) for d in range(1, near + 1)] + [(np.full(count - d - 1, start + d), place[d + 1 :]) for d in range(near)]
    return np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs])


def _products(entries: DataFrame, num: int, den: int, wide: int, near: int) -> DataFrame:
    """kind 0: pairs with overlap counts; kind 1: entries (a key, b class, na size, nb place, ha heavy count) of wide columns."""

    def run(batches):
        for key, cls, n, pos, hc in _columns(batches, wide + 1):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            left, right = [], []
            for k in np.unique(size[(size > 1) & (size <= wide)]):
                x, y = np.triu_indices(k, 1)
                at = starts[size == k]
                step = max(1, (1 << 21) // len(x))
                for t in range(0, len(at), step):
                    i, j = (at[t : t + step, None] + x).ravel(), (at[t : t + step, None] + y).ravel()
                    ok = _fits(num, den, n[i], n[j], pos[i], pos[j]) & (cls[i] != cls[j])
                    left.append(i[ok])
                    right.append(j[ok])
            for s, k in zip(starts[size > wide], size[size > wide], strict=True):
                whole = slice(s, s + k)
                yield _batch(1, key[whole], cls[whole], n[whole], pos[whole], hc[whole], hc[whole], hc[whole])
                i, j = _neighbours(s, k, near)
                ok = _fits(num, den, n[i], n[j], pos[i], pos[j]) & (cls[i] != cls[j])
                left.append(i[ok])
                right.append(j[ok])
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            if len(i):
                yield _counted(cls[i], cls[j], n[i], n[j], hc[i], hc[j])

    mix = F.xxhash64("cls", "key")
    dealt = entries.withColumn("mix", mix).repartition("key").sortWithinPartitions("key", "n", "mix").drop("mix")
    return dealt.mapInArrow(run, PAIR)


def _possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose summed overlap can still reach what a link needs: counts here, heavy columns, and all that comes later."""
    need = lambda n: f"({num} * {n} + {den - 1}) div {den}"
    total = pairs.groupBy("a", "b").agg(F.sum("cnt").alias("cnt"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("ha").alias("ha"), F.max("hb").alias("hb"))
    return total.where(f"cnt + least(ha, hb) + greatest({need('na')}, {need('nb')}) - 1 >= ({num} * (na + nb) + {num + den - 1}) div {num + den}").select("a", "b")


def _whole(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, name: str) -> DataFrame:
    """``cls, row``: the sorted shingles of the classes whose smallest rows (``doc_id, th``) are wanted; written once."""

    def rows(batches):
        for _, _, sets in _sets(batches, 0, width):
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "row"])

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    some = some.join(small(wanted.select("doc_id", "th"), 1_000_000), ["doc_id", "th"], "left_semi").select("text")
    return kept(some.mapInArrow(rows, "cls long, row binary").dropDuplicates(["cls"]), name)


def _verified(pairs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link, by the intersection of whole rows."""

    def test(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = np.zeros(len(x), bool)
            for i in range(len(x)):
                a, b = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = den * inter >= num * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    joined = pairs.join(table.select(F.col("cls").alias("a"), F.col("row").alias("ra")), "a").join(table.select(F.col("cls").alias("b"), F.col("row").alias("rb")), "b")
    return joined.select("a", "b", "ra", "rb").mapInArrow(test, "a long, b long")


# the second round

_SKETCH = [f"s{i}" for i in range(8)]


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of columns in each of 512 places, as eight words."""
    return np.packbits(np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1).view(np.int64)


def _may_link(num: int, den: int, na, nb, sa: list[np.ndarray], sb: list[np.ndarray]) -> np.ndarray:
    """Whether sizes and sketches leave the overlap that a link needs: two rows differ in as many columns as parities at least."""
    apart = sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in zip(sa, sb, strict=True))
    both = na.astype(np.int64) + nb
    return both - apart >= 2 * -(-num * both // (num + den))


def _counted_columns(table: DataFrame, tau: int, heavy: int) -> np.ndarray:
    """The at most ``heavy`` most frequent of the columns that over ``tau`` rows of ``table`` have, rarest first."""

    def run(batches):
        for batch in batches:
            flat = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(0)]
            for i in range(0, len(flat), 256):
                key, count = np.unique(np.concatenate(flat[i : i + 256]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int32))], ["key", "c"])

    found = table.select("row").mapInArrow(run, "key long, c int").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > tau)
    return found.orderBy(F.desc("c"), "key").limit(heavy).toPandas().key.to_numpy(np.int64)[::-1].copy().view(np.uint64)


def _ordered(table: DataFrame, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """``key, cls, n, pos, upto`` and the sketch: each row's first columns in the common order, and the largest size that a
    partner can have whose first shared column this is."""
    rank = np.argsort(frequent)
    shared = table.sparkSession.sparkContext.broadcast((frequent[rank], rank))

    def run(batches):
        known, place = shared.value
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for v in batch.column(1):
                s = np.frombuffer(v.as_buffer(), np.uint64)
                sketches.append(_sketch(s))
                p = len(s) - -(-num * len(s) // den) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    late = hit.nonzero()[0]
                    s = np.concatenate([s[~hit], s[late[np.argsort(place[at[late]])]]])
                keys.append(s[:p])
                sizes.append(len(s))
            if keys:
                n, k = np.array(sizes, np.int64), np.array([len(x) for x in keys], np.int64)
                pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                n = np.repeat(n, k)
                upto = (n - pos) * (num + den) // num - n
                cls, sketch = np.repeat(np.asarray(batch.column(0), np.int64), k), np.repeat(np.array(sketches), k, axis=0)
                cols = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(cls), *(pa.array(x.astype(np.int32)) for x in (n, pos, upto)), *map(pa.array, sketch.T.copy())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "cls", "n", "pos", "upto", *_SKETCH])

    return table.select("cls", "row").mapInArrow(run, "key long, cls long, n int, pos int, upto int, " + ", ".join(f"{c} long" for c in _SKETCH))


def _first_shared(num: int, den: int, na, nb, ua, ub) -> np.ndarray:
    """Whether a column may be the first that two classes share: each is within the other's reach, and sizes allow a link."""
    return (nb <= ua) & (na <= ub) & (num * np.maximum(na, nb).astype(np.int64) <= den * np.minimum(na, nb))


def _met(a: np.ndarray, b: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of classes, the smaller first."""
    x, y = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    lead = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(x[lead]), pa.array(y[lead])], ["a", "b"])


def _close(entries: DataFrame, num: int, den: int, wide: int, near: int) -> DataFrame:
    """``a, b``: pairs that meet in narrow columns, and neighbours in wide ones, of different components."""

    def run(batches):
        for key, cls, n, upto, root, *sketch in _columns(batches, wide + 1):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            some = []
            for k in np.unique(size[(size > 1) & (size <= wide)]):
                x, y = np.triu_indices(k, 1)
                at = starts[size == k]
                step = max(1, (1 << 20) // len(x))
                some += [((at[t : t + step, None] + x).ravel(), (at[t : t + step, None] + y).ravel()) for t in range(0, len(at), step)]
            some += [_neighbours(s, k, near) for s, k in zip(starts[size > wide], size[size > wide], strict=True)]
            for i, j in some:
                ok = (root[i] != root[j]) & _first_shared(num, den, n[i], n[j], upto[i], upto[j])
                i, j = i[ok], j[ok]
                ok = _may_link(num, den, n[i], n[j], [x[i] for x in sketch], [x[j] for x in sketch])
                if ok.any():
                    yield _met(i[ok], j[ok], cls)

    mix = F.xxhash64("cls", "key")
    dealt = entries.select("key", "cls", "n", "upto", "root", *_SKETCH).withColumn("mix", mix).repartition("key").sortWithinPartitions("key", "n", "mix").drop("mix")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _rest(entries: DataFrame, num: int, den: int, wide: int) -> DataFrame:
    """``a, b``: all pairs that meet in wide columns of several components, and are of different ones.

    A column of many members is dealt over tasks: each member comes once as the larger of a pair, and to every part as the
    smaller one if it can be that (few are: a partner no smaller has to be in its reach).
    """
    mixed_keys = entries.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where(f"c > {wide} and lo < hi")
    e = entries.join(mixed_keys.select("key", F.floor(F.col("c") / 4096).cast("int").alias("last")), "key")
    larger = e.withColumns({"part": F.pmod(F.xxhash64("cls"), F.col("last") + 1).cast("int"), "larger": F.lit(1)})
    smaller = e.where("upto >= n").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("last"))), "larger": F.lit(0)})
    names = ["key", "part", "larger", "n", "cls", "upto", "root", *_SKETCH]

    def run(batches):
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, larger, n, cls, upto, root, *sketch = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (larger[1:] != larger[:-1])]))
            for s, e_ in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if (key[s], part[s]) != now:
                    now, held = (key[s], part[s]), []
                if not larger[s]:
                    held.append(tuple(x[s:e_] for x in (n, cls, upto, root, *sketch)))
                    continue
                if not held:
                    continue
                held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                sn, sc, su, sr, *ss = held[0]
                y = np.arange(s, e_)
                lo, hi = np.searchsorted(sn, -(-num * n[y].astype(np.int64) // den)), np.searchsorted(sn, n[y], side="right")
                at = 0
                while at < len(y):  # so many pairs at a time
                    upto_ = np.cumsum(hi[at:] - lo[at:])
                    to = at + max(1, int(np.searchsorted(upto_, 1 << 20, side="right")))
                    k = hi[at:to] - lo[at:to]
                    j = np.repeat(y[at:to], k)
                    i = np.repeat(lo[at:to] - np.cumsum(k) + k, k) + np.arange(k.sum())
                    ok = (sr[i] != root[j]) & _first_shared(num, den, sn[i], n[j], su[i], upto[j])
                    i, j = i[ok], j[ok]
                    ok = _may_link(num, den, sn[i], n[j], [x[i] for x in ss], [x[j] for x in sketch])
                    if ok.any():
                        both = np.concatenate([sc[i[ok]], cls[j[ok]]])
                        m = len(both) // 2
                        yield _met(np.arange(m), np.arange(m, 2 * m), both)
                    at = to

    dealt = smaller.select(*names).union(larger.select(*names)).repartition("key", "part").sortWithinPartitions("key", "part", "larger", "n")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _second_round(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, members: DataFrame, links: DataFrame, width: int, num: int, den: int, tau: int, heavy: int, wide: int, near: int) -> DataFrame:
    """``links`` and those that connect classes of wide columns (``members``: ``key, cls``) beyond them."""
    roots = components(links, "a", "b")
    e = _rooted(members.distinct(), roots)
    several = e.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = kept(e.join(several, "key", "left_semi").select("cls").distinct(), "open")
    if not open_.limit(1).count():
        return links
    table = _whole(docs, reps.join(open_, "cls", "left_semi"), id_col, text_col, width, "rows")
    entries = kept(_ordered(table, _counted_columns(table, tau, heavy), num, den), "entries")
    close = kept(_close(_rooted(entries, roots), num, den, wide, near), "pairs")
    links = links.union(kept(_verified(close, table, num, den), "links"))
    wide_keys = entries.groupBy("key").count().where(F.col("count") > wide).select("key")
    left = kept(_rooted(entries.join(wide_keys, "key", "left_semi"), components(links, "a", "b")), "wide")
    forget(open_, close, entries)
    if left.limit(1).count():
        rest = kept(_rest(left, num, den, wide), "pairs")
        links = links.union(kept(_verified(rest, table, num, den), "links"))
        forget(rest)
    forget(left, table)
    return links


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, tau: int = 8, heavy: int = 200_000, wide: int = 64, near: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, classes and links between these: (``doc_id, th, cls, n``), (``cls, doc_id, th, c``: smallest row, rows), (``a, b``).

    Links are all pairs of classes that ``den * intersection >= num * union``, but for pairs that share wide columns and
    that other links already connect. Two sets share a class by a 64-bit hash.
    """
    of = kept(classes(docs, id_col, text_col, width), "classes")
    reps = kept(of.where(_LIVE).groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.count("*").alias("c")).select("cls", "m.doc_id", "m.th", "c"), "reps")
    frequent = _frequent(docs, text_col, width, tau, heavy)
    met = kept(_products(_entries(docs, id_col, text_col, width, num, den, frequent, _hot(reps, of.count())), num, den, wide, near), "products")
    pairs = kept(_possible(met.where("kind = 0"), num, den), "pairs")
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    table = _whole(docs, reps.join(ends, "cls", "left_semi"), id_col, text_col, width, "rows")
    links = kept(_verified(pairs, table, num, den), "links")
    forget(pairs, table)
    members = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cls"))
    if members.limit(1).count():
        links = _second_round(docs, id_col, text_col, reps, members, links, width, num, den, tau, heavy, wide, near)
    forget(met)
    return of, reps, links


def component_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """``doc_id, th, n_shingles, component_id, component_th`` for every row: the row (id, hash of the text) and the smallest of its component."""
    of, reps, links = link_classes(docs, id_col, text_col, width, num, den, **options)
    roots = components(links, "a", "b").select(F.col("node").alias("cls"), "root")
    least = reps.select("cls", F.struct("doc_id", "th").alias("least")).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    n = reps.agg(F.sum("c")).first()[0] or 0
    by_root = least.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("c"))
    by_root = by_root.select("root", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("component_th"), "c")
    named = kept(hot_join(least, by_root.drop("c"), by_root, "root", "cls", n).select("cls", "component_id", "component_th"), "named")
    rows = hot_join(of.where(_LIVE), named, reps.select("cls", "c"), "cls", "doc_id", n)
    alone = of.where(f"not ({_LIVE})").withColumns({"component_id": F.col("doc_id"), "component_th": F.col("th")})
    names = ["doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "component_th"]
    return rows.select(*names).union(alone.select(*names))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: its component's smallest id under Jaccard >= num / den.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than ``width`` words is one shingle. A
    null or blank text has no shingle and no link: its component is its own id. A row of null id links with nothing and
    has a null component. Components are of rows: texts that repeat an id link by what they hold only, not by the id.
    Other columns are left alone.
    """
    return component_rows(docs, id_col, text_col, width, num, den, **options).select("doc_id", "n_shingles", "component_id")
