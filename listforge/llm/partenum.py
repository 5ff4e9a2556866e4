"""Jaccard join of shingle sets by PartEnum signatures.

The shingle domain (64-bit hashes) is cut into n equal ranges, n fixed by the size band of
the larger set of a pair.  Two sets with Jaccard similarity of at least t differ in at most
k elements (their symmetric difference), so at most k of the ranges that hold elements of
a set can differ from the other set's; every remaining non-empty range is equal in both.
A signature is the content of one range, and the enumerated subset of ranges is the k+1
first non-empty ones under one global order of signatures (rarest content first, then by
hash): the first signature that both sets have is then within the first k+1 of each.  So
similar sets of a band share a signature, and no pair is lost.  Sets with too few non-empty
ranges for that (k or fewer) add single-element signatures among themselves.

Signatures only propose.  The sets of a signature are first held against each other by odd
sketches: 512 parities of the elements.  The bits in which two sketches differ never exceed
the symmetric difference, so nothing similar is lost.  Sets of 400 elements and more are
sketched on a sample by hash (one in 4, 16, ...); there the limit has room for chance, and
a pair that links is missed with a probability below 1e-14 (Chernoff), as likely as equal
64-bit hashes.  What may link forms families by spanning trees, never all pairs of a group.  The families' texts are then compared exactly,
in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import batches, give_back, keep_only
from listforge.llm.components import connected_components
from listforge.session import materialize, ship_package

WORDS = 5
PERCENT = 75              # least similarity, in hundredths
HOT_BITS = 22             # size of the table that says how frequent a shingle is
HOT_PER_TASK = 1 << 16    # frequent shingles a task reports
SKETCH_SETS = 2000        # sets of a signature that are held against each other; of more, all go on
BLOCK_SETS = 512          # sets of a block
BLOCK_SHINGLES = 400_000  # and their shingles

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F)
_BASE = 0x2545F4914F6CDD1D
_TEXT_PIECE = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[0]))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _TEXT_PIECE + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _TEXT_PIECE + 1)


def _hash_words(raw: bytes) -> np.ndarray:
    """A hash per word of at most _TEXT_PIECE bytes: polynomial over bytes, then mixed."""
    a = np.frombuffer(raw, dtype=np.uint8)
    gap = np.empty(len(a) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _SPACE[a]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    first, end = turn[::2], turn[1::2]
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * _UP[:len(a)], out=total[1:])
    return _mix((total[end] - total[first]) * _DOWN[first] + (end - first).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Words are runs of anything but blank, tab, LF, VT, FF, CR; A-Z count as a-z."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) <= _TEXT_PIECE:
        return _hash_words(raw)
    out, lo = [], 0
    while lo < len(raw):
        piece = raw[lo:lo + _TEXT_PIECE]
        if lo + _TEXT_PIECE < len(raw):
            cut = max(piece.rfind(c) for c in b" \t\n\v\f\r")
            if cut < 0:  # one word longer than a piece: folded piece by piece
                stop = min((x for x in (raw.find(c, lo) for c in b" \t\n\v\f\r") if x >= 0), default=len(raw))
                word = np.zeros(1, dtype=np.uint64)
                for at in range(lo, stop, _TEXT_PIECE):
                    word = _mix(word * np.uint64(_ODD[1]) + _hash_words(raw[at:min(stop, at + _TEXT_PIECE)]))
                out.append(word)
                lo = stop
                continue
            piece = piece[:cut + 1]
        out.append(_hash_words(piece))
        lo += len(piece)
    return np.concatenate(out)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words: the whole sequence as one."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, dtype=np.uint64)
    width = min(words, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h += w[j:len(w) - width + 1 + j] * np.uint64(_ODD[j % 5]) if j < 5 else _mix(h) + w[j:len(w) - width + 1 + j]
    return np.unique(_mix(h))


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that name a set (two independent sums of mixed elements)."""
    n = np.uint64(len(s))
    one = _mix(np.array([s.sum(dtype=np.uint64) + n], dtype=np.uint64))
    two = _mix(np.array([_mix(s ^ np.uint64(_ODD[2])).sum(dtype=np.uint64) ^ n], dtype=np.uint64))
    return one.astype(">u8").tobytes() + two.astype(">u8").tobytes()


def sketch_level(n: int) -> int:
    """Sets of n elements are sketched on one in 4**level of them: fewer than 400 expected."""
    level = 0
    while n >= 400 << (2 * level):
        level += 1
    return level


def odd_sketch(s: np.ndarray, level: int) -> bytes:
    """For each of 512 ranges whether it holds an odd number of (sampled) elements."""
    own = s[(s & np.uint64((1 << (2 * level)) - 1)) == 0] if level else s
    odd = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def odd_sketches(s: np.ndarray, percent: int = PERCENT) -> bytes:
    """The sketch of the set's level, and the next if a larger partner may be there."""
    level = sketch_level(len(s))
    up = sketch_level(len(s) * 100 // percent)
    return odd_sketch(s, level) + (odd_sketch(s, up) if up != level else b"")


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def _band(n: int) -> int:
    """Band i holds sizes 4**i up to 4**(i+1) - 1."""
    return (n.bit_length() - 1) // 2


def most_different(n: int, other: int, percent: int = PERCENT) -> int:
    """What the symmetric difference of linked sets of these sizes (or smaller) can't exceed."""
    return (n + other) * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set in its own band and, as the smaller set of a pair, the next."""
    n, out = len(s), []
    largest = n * 100 // percent
    mixed, heat = _mix(s + np.uint64(_ODD[3])), hot[s >> np.uint64(64 - HOT_BITS)]
    for band in {_band(n), _band(largest)}:
        k = most_different(n, min(largest, 4 ** (band + 1) - 1), percent)
        part = s >> np.uint64(64 - (2 * band + 1))  # 2 * 4**band ranges
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        content = _mix(np.add.reduceat(mixed, first) + part[first] * np.uint64(_ODD[4]) + np.uint64(band))
        rare = np.minimum.reduceat(heat, first).astype(np.uint64)
        order = (rare << np.uint64(56)) | (content >> np.uint64(8))
        if len(order) > k + 1:
            content = content[np.argpartition(order, k)[:k + 1]]
        elif len(order) <= k:
            alone = _mix(mixed + np.uint64(band + 101))
            own = (heat.astype(np.uint64) << np.uint64(56)) | (alone >> np.uint64(8))
            content = np.concatenate((content, alone[np.argpartition(own, k)[:k + 1]] if n > k + 1 else alone))
        out.append(content)
    return np.concatenate(out)


def _sums(values: np.ndarray, times: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their summed times, of at least ``least``; the ``most`` most frequent."""
    order = np.argsort(values, kind="stable")
    values, times = values[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    n = np.add.reduceat(times, first) if len(first) else times
    keep = np.flatnonzero(n >= least)
    keep = keep[np.argsort(-n[keep], kind="stable")[:most]]
    return values[first[keep]], n[keep]


def _describe(words: int, percent: int):
    """Per document its set's key and size; per task the shingles most of its documents share."""
    def run(parts):
        keep_only()
        make = batches({"doc_id": pa.int64(), "mark": pa.int64(), "n": pa.int64(), "key": pa.binary(), "odd": pa.binary(),
                        "hot": pa.int64(), "times": pa.int64()})
        seen, size, values, times = [], 0, np.empty(0, np.uint64), np.empty(0, np.int64)

        def count():
            own = np.concatenate(seen)
            v, n = _sums(own, np.ones(len(own), dtype=np.int64), 2, len(own))
            return _sums(np.concatenate((values, v)), np.concatenate((times, n)), 2, 8 * HOT_PER_TASK)

        for batch in parts:
            out = []
            for name, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), words)
                out.append((name, mark, len(s), set_key(s) if len(s) else None, odd_sketches(s, percent) if len(s) else None, None, None))
                if len(s):
                    seen.append(s)
                    size += len(s)
                if size > 1_500_000:
                    values, times = count()
                    seen, size = [], 0
            yield make(out)
            del batch, out
            give_back()
        if seen:
            values, times = count()
            seen.clear()
        top = slice(0, HOT_PER_TASK)
        cells, n = (values[top] >> np.uint64(64 - HOT_BITS)).tolist(), times[top].tolist()
        yield make([(None, None, None, None, None, v, c) for v, c in zip(cells, n, strict=True)])

    return run


def _sign(hot, words: int, percent: int):
    def run(parts):
        keep_only()
        schema = pa.schema([("sig", pa.int64()), ("short", pa.int64())])
        done: set[bytes] = set()  # a set that this task has signed is not signed again
        for batch in parts:
            sigs, owners, size = [], [], 0
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words)
                if not len(s) or (key := set_key(s)) in done:
                    continue
                done.add(key)
                own = signatures(s, hot.value, percent)
                sigs.append(own.view(np.int64))
                owners.append(np.full(len(own), _short(key), dtype=np.int64))
                size += len(own)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owners))], schema=schema)
                    sigs, owners, size = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owners))], schema=schema)
            del batch, sigs, owners
            give_back()

    return run


def _shared(parts):
    """(sig, short) in order -> (gid, short): the sets of each signature that several have.

    Signatures of the same sets are one group (a task names it once); a group too large to
    hold is passed on as it comes, under its signature.
    """
    schema = pa.schema([("gid", pa.int64()), ("short", pa.int64())])
    done: set[int] = set()

    def groups(sig, short):
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (short[1:] != short[:-1])))
        sig, short = sig[new], short[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(first, len(sig)))
        gid = _mix(np.add.reduceat(_mix(short.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
        several = np.flatnonzero(size > 1)
        _, at = np.unique(gid[several], return_index=True)
        if len(done) > 1_000_000:
            done.clear()
        fresh = [g for g in several[np.sort(at)].tolist() if int(gid[g]) not in done]
        done.update(gid[fresh].tolist())
        keep = np.zeros(len(first), dtype=bool)
        keep[fresh] = True
        rows = np.repeat(keep, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(gid, size)[rows]), pa.array(short[rows])], schema=schema)

    sigs, shorts, held, large = [], [], 0, None
    for batch in parts:
        sigs.append(batch.column(0).to_numpy())
        shorts.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held < 400_000:
            continue
        sig, short = np.concatenate(sigs), np.concatenate(shorts)
        if large is not None:  # the rest of a group that is passed on
            n = int(np.searchsorted(sig, large, side="right"))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(sig[:n]), pa.array(short[:n])], schema=schema)
            sig, short = sig[n:], short[n:]
            large = large if not len(sig) else None
        cut = int(np.searchsorted(sig, sig[-1], side="left")) if len(sig) else 0
        if cut:
            yield groups(sig[:cut], short[:cut])
        elif len(sig):
            large = int(sig[-1])
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(short)], schema=schema)
            cut = len(sig)
        sigs, shorts, held = [sig[cut:]], [short[cut:]], len(sig) - cut
    if held:
        sig, short = np.concatenate(sigs), np.concatenate(shorts)
        n = int(np.searchsorted(sig, large, side="right")) if large is not None else 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(sig[:n]), pa.array(short[:n])], schema=schema)
        if len(sig) > n:
            yield groups(sig[n:], short[n:])


def _trees(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each node's component, from edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def may_link(n: np.ndarray, odd: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, whose sizes and odd sketches allow a link."""
    level = np.array([sketch_level(int(x)) for x in n])
    ok_i, ok_j = [], []
    for at in np.unique(level):
        # those of this level, and those below that have a sketch for it
        who = np.flatnonzero((level == at) | ((level == at - 1) & np.array([len(o) == 128 for o in odd])))
        if len(who) < 2:
            continue
        bits = np.frombuffer(b"".join(odd[x][:64] if level[x] == at else odd[x][64:] for x in who.tolist()),
                             dtype=np.uint64).reshape(-1, 8)
        size, own = n[who], level[who] == at
        for lo in range(0, len(who), 128):
            a = slice(lo, lo + 128)
            most = (size[a, None] + size[None, :]) * (100 - percent) // (100 + percent)
            fits = (np.abs(size[a, None] - size[None, :]) <= most) & (own[a, None] | own[None, :])
            if at:
                mean = most / 4.0 ** at
                most = mean + 8 * np.sqrt(mean) + 15
            fits &= np.bitwise_count(bits[a, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64) <= most
            i, j = np.nonzero(fits)
            i += lo
            ok_i.append(who[i[i < j]])
            ok_j.append(who[j[i < j]])
    if not ok_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(ok_i), np.concatenate(ok_j)


def _may_link(percent: int):
    """(gid, short, n, odd) in order -> (hub, short): trees over the sets of a group that may link."""
    def run(parts):
        keep_only()
        make = batches({"hub": pa.int64(), "short": pa.int64()})
        now, rows, hub = None, [], None
        done: set[tuple[int, int]] = set()

        def close():
            short = np.array([r[0] for r in rows], dtype=np.int64)
            i, j = may_link(np.array([r[1] for r in rows], dtype=np.int64), [r[2] for r in rows], percent)
            root = _trees(i, j, len(rows)) if len(i) else np.arange(len(rows))
            at = np.flatnonzero(root != np.arange(len(rows)))
            return [(a, b) for a, b in zip(short[root[at]].tolist(), short[at].tolist(), strict=True) if a != b]

        def fresh(edges):
            edges = [e for e in edges if e not in done]
            if len(done) > 500_000:
                done.clear()
            done.update(edges)
            return edges

        for batch in parts:
            out = []
            for gid, short, n, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gid != now:
                    if len(rows) > 1:
                        out += fresh(close())
                    now, rows, hub = gid, [], None
                if hub is None:
                    rows.append((short, n, odd))
                    if len(rows) > SKETCH_SETS:
                        hub = rows[0][0]
                        out += [(hub, r[0]) for r in rows[1:] if r[0] != hub]
                        rows = []
                elif short != hub:
                    out.append((hub, short))
            if out:
                yield make(out)
        if len(rows) > 1:
            yield make(fresh(close()))

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes (upper triangle), by runs of equal elements."""
    g = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    total, pending, size = np.zeros(g * g, dtype=np.int64), [], 0
    at, step = np.arange(len(every)), 1
    while True:
        at = at[at + step < len(every)]
        at = at[every[at] == every[at + step]]
        if not len(at):
            break
        pending.append(owner[at] * g + owner[at + step])  # stable order: the lower owner first
        size += len(at)
        if size > 4_000_000:
            total += np.bincount(np.concatenate(pending), minlength=g * g)
            pending, size = [], 0
        step += 1
    if pending:
        total += np.bincount(np.concatenate(pending), minlength=g * g)
    return total.reshape(g, g)


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, that link."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    common = intersections(sets)
    i, j = np.nonzero(common)
    c = common[i, j]
    ok = 100 * c >= percent * (n[i] + n[j] - c)
    return i[ok], j[ok]


def _compare(words: int, percent: int):
    """Tasks of texts -> per set with a link in a task: key, a set of its component, links."""
    def run(parts):
        keep_only()
        make = batches({"key": pa.binary(), "root": pa.binary(), "links": pa.int64()})
        now, sets, keys, copies, sides = None, [], [], [], []

        def close():
            if len(sets) < 2:
                return None
            i, j = linked(sets, percent)
            side = np.array(sides)
            if side.any():  # a task of two blocks has pairs across them only
                across = side[i] != side[j]
                i, j = i[across], j[across]
            if not len(i):
                return None
            root, n = _trees(i, j, len(sets)), np.array(copies, dtype=np.int64)
            degree = np.bincount(i, n[j], len(sets)) + np.bincount(j, n[i], len(sets))
            return make([(keys[x], keys[root[x]], int(degree[x])) for x in np.flatnonzero(degree).tolist()])

        for batch in parts:
            for task, side, key, n, text in zip(*(batch.column(c) for c in range(5)), strict=True):
                task = task.as_py()
                if task != now:
                    if (got := close()) is not None:
                        yield got
                    now, sets, keys, copies, sides = task, [], [], [], []
                s, key = shingle_set(text.as_py(), words), key.as_py()
                if key in keys or set_key(s) != key:
                    continue  # a repeated id with another text, or the same row again
                sets.append(s)
                keys.append(key)
                copies.append(n.as_py())
                sides.append(side.as_py())
        if (got := close()) is not None:
            yield got
        sets.clear()
        give_back()

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    Documents link when 100 * common >= percent * union of their shingle sets.
    ``component_id`` is the smallest id reachable by links; ``n_links`` counts the other
    rows it links with.  Null or wordless texts have the empty set and link with nothing
    (component: the own id).  Null ids take part; they are never a component_id unless all
    of the component are null.  Rows that repeat an id or a text are rows like others.
    Other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    # rows without an id are told apart by their text
    mark = F.when(name.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    rows = docs.select(name.alias("doc_id"), mark.alias("mark"), text.alias("text"))
    described = materialize(rows.mapInArrow(
        _describe(words, percent), "doc_id long, mark long, n long, key binary, odd binary, hot long, times long"), "partenum-sets")
    own = described.where("n is not null").select("doc_id", "mark", "n", "key", "odd")
    classes = own.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.when(F.min("doc_id").isNull(), F.min("mark")).otherwise(0).alias("rep_mark"), F.min("n").alias("n"), F.min("odd").alias("odd"),
        F.count(F.lit(1)).alias("copies"))
    short = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    classes = classes.withColumn("short", short)
    classes = materialize(classes, "partenum-classes")

    # a table of fixed size: how frequent the shingles are that tasks reported; it orders
    # signatures and decides nothing else
    cells = described.where("hot is not null").groupBy("hot").agg(F.sum("times").alias("t")).toArrow()
    table = np.zeros(1 << HOT_BITS, dtype=np.uint8)  # at most as many rows
    table[cells["hot"].to_numpy()] = np.minimum(60, np.log2(cells["t"].to_numpy() + 1)).astype(np.uint8)
    hot = spark.sparkContext.broadcast(table)

    signed = rows.select("text").mapInArrow(_sign(hot, words, percent), "sig long, short long")
    groups = signed.repartition("sig").sortWithinPartitions("sig", "short").mapInArrow(
        _shared, "gid long, short long")
    proposed = groups.join(classes.select("short", "n", "odd"), "short").select("gid", "short", "n", "odd")
    stars = proposed.repartition("gid").sortWithinPartitions("gid", "short").mapInArrow(
        _may_link(percent), "hub long, short long")
    families = connected_components(stars, "hub", "short")
    members = families.join(classes, families["node"] == classes["short"]).select(
        F.col("root").alias("family"), "key", "rep", "rep_mark", "n", "copies")
    members = materialize(members, "partenum-members")

    same = F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("rep_mark") == F.col("mark"))
    links = materialize(_tasks(members).join(rows, same)
                        .select("task", "side", "key", "copies", "text")
                        .repartition("task").sortWithinPartitions("task", "key")
                        .mapInArrow(_compare(words, percent), "key binary, root binary, links long"),
                        "partenum-links")
    found = connected_components(links, "root", "key")
    degrees = links.groupBy("key").agg(F.sum("links").alias("links"))
    of_class = classes.join(found, classes["key"] == found["node"], "left").join(degrees, "key", "left").select(
        "key", "rep", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    smallest = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest, "root").select(
        "key", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    with_words = own.where("n > 0").join(of_class, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    without = own.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                        F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without).withColumnRenamed("doc_id", id_col)


def _tasks(members: DataFrame) -> DataFrame:
    """members with the comparisons they take part in: (task, side, key, rep, rep_mark, copies).

    A family that fits one block is one task.  A larger one is cut by size band (a ratio of
    4/3, so only neighbouring bands can link) and hash into blocks; a task is one block, or
    two that can link.
    """
    totals = members.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all"))
    fits = (F.col("sets") <= BLOCK_SETS) & (F.col("all") <= BLOCK_SHINGLES)
    m = members.join(totals.select("family", fits.alias("fits")), "family")
    m = m.withColumn("band", F.when(F.col("fits"), 0).otherwise(
        F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1)).cast("int"))
    blocks = m.groupBy("family", "band").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("cuts"),
        F.min("fits").alias("fits"))
    m = m.join(blocks.select("family", "band", "cuts"), ["family", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    one = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    near = one.where("not fits").select("family", F.explode(F.array("band", F.col("band") + 1)).alias("band"),
                                        F.col("band").alias("band1"), F.col("block").alias("block1"))
    # pairs of blocks of one family, each once
    pairs = near.join(one.select("family", "band", "block"), ["family", "band"]).where(
        "band > band1 or block > block1")
    name = F.concat_ws(":", "family", "band1", "block1", "band", "block")
    first = pairs.select("family", F.col("band1").alias("band"), F.col("block1").alias("block"),
                         F.lit(0).alias("side"), name.alias("task"))
    second = pairs.select("family", "band", "block", F.lit(1).alias("side"), name.alias("task"))
    alone = one.select("family", "band", "block", F.lit(0).alias("side"),
                       F.concat_ws(":", "family", "band", "block").alias("task"))
    todo = first.unionByName(second).unionByName(alone)
    return m.join(todo, ["family", "band", "block"]).select("task", "side", "key", "rep", "rep_mark", "copies")
