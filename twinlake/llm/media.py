"""Local image descriptors that find cropped or edited copies of images.

Corners at several scales (Harris measure, strongest of each neighbourhood), an orientation from the patch's centroid,
binary brightness tests turned with it, Hamming tables on bands of the bits that give candidate pairs, and for each
candidate pair the Hamming distance of all their corners on all bits and a vote of the near ones on one similarity
transform. An image is a row (id, height, width, pixels), pixels being grey bytes by row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlake.llm.common import materialise, small_batches, tidy
from twinlake.llm.components import components
from twinlake.llm.tokens import binary

#: Scales (each half the one before), how far a corner is the strongest, radius of a patch, turns told apart.
SCALES, REACH, RADIUS, TURNS = 2, 10, 7, 16
#: Binary tests (a patch with fewer than ``FLAT`` of either outcome is too flat), and the bands of them that the tables hold.
TESTS, BANDS, FLAT = 96, 2, 8
#: Wrong bits of a match; matches that must agree on a transform, also as a share of the corners of the image with fewer; side of a voting bin.
WRONG, VOTES, SHARE, BIN = 8, 6, 0.25, 6
#: Matches of a corner up to which it votes before those that have more.
RARE = 2
#: Rows of an image that are looked at together.
STRIP = 2048
IMAGE = "id long, height int, width int, pixels binary"

_rng = np.random.default_rng(11)
_pattern = _rng.normal(0, RADIUS / 2, (TESTS, 2, 2))
_pattern *= np.minimum(1, (RADIUS - 0.5) / np.linalg.norm(_pattern, axis=2, keepdims=True))  # inside the patch at any turn
_angles = np.arange(TURNS) * 2 * np.pi / TURNS
_cos, _sin = np.cos(_angles), np.sin(_angles)
_turned = np.rint(np.stack([_pattern @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) for a in _angles])).astype("i4")
_span = np.arange(-RADIUS, RADIUS + 1)
_disc = (_span[:, None] ** 2 + _span[None, :] ** 2 <= RADIUS**2).astype("f4")
_centroid = np.stack([(_disc * _span[:, None]).reshape(-1), (_disc * _span[None, :]).reshape(-1)], 1).astype("f4")


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1 of the last two axes, edges padded; the same for the same surroundings, wherever they stand."""
    for axis in (-2, -1):
        n = x.shape[axis]
        ends = (x[..., :1, :], x[..., -1:, :]) if axis == -2 else (x[..., :1], x[..., -1:])
        p = np.concatenate([ends[0]] * r + [x] + [ends[1]] * r, axis)
        views = [p[..., k : k + n, :] if axis == -2 else p[..., k : k + n] for k in range(2 * r + 1)]
        x = views[0] + views[1]
        for v in views[2:]:
            x += v
    return x


def _peak(x: np.ndarray, r: int) -> np.ndarray:
    """The largest of the square of side 2r + 1 around each place."""
    h, w = x.shape
    p = np.full((h + 2 * r, w + 2 * r), -np.inf, x.dtype)
    p[r : r + h, r : r + w] = x
    for axis in (0, 1):
        size = 1
        while size < 2 * r + 1:
            step = min(size, 2 * r + 1 - size)
            p = np.maximum(p[:-step], p[step:]) if axis == 0 else np.maximum(p[:, :-step], p[:, step:])
            size += step
    return p


def _corners(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns, turns and packed tests of the corners of one strip at one scale."""
    soft = _box(img, 1)
    g = np.zeros((2, *soft.shape), soft.dtype)
    np.subtract(soft[:, 2:], soft[:, :-2], out=g[0, :, 1:-1])
    np.subtract(soft[2:], soft[:-2], out=g[1, 1:-1])
    g /= 9
    of = np.empty((3, *soft.shape), soft.dtype)
    np.multiply(g, g, out=of[:2])
    np.multiply(g[0], g[1], out=of[2])
    xx, yy, xy = _box(of, 2)
    m = xx * yy
    m -= xy * xy
    xx += yy
    xx *= xx
    xx *= np.float32(0.05)
    m -= xx
    inner = m[RADIUS : img.shape[0] - RADIUS, RADIUS : img.shape[1] - RADIUS]
    y, x = np.nonzero((inner >= _peak(m, REACH)[RADIUS : img.shape[0] - RADIUS, RADIUS : img.shape[1] - RADIUS]) & (inner > 1))
    y, x = y + RADIUS, x + RADIUS
    patch = soft[y[:, None, None] + _span[:, None], x[:, None, None] + _span[None, :]].reshape(len(y), _centroid.shape[0]) @ _centroid
    turn = np.arctan2(patch[:, 0], patch[:, 1])
    turn = np.rint(turn / (2 * np.pi) * TURNS).astype("i4") % TURNS
    t = _turned[turn]
    less = soft[y[:, None] + t[:, :, 0, 0], x[:, None] + t[:, :, 0, 1]] < soft[y[:, None] + t[:, :, 1, 0], x[:, None] + t[:, :, 1, 1]]
    ones = less.sum(1)
    ok = (ones >= FLAT) & (ones <= TESTS - FLAT)
    return y[ok], x[ok], turn[ok], np.packbits(less[ok], axis=1)


def features(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (scale, turn, y, x in pixels of the first scale) and their test bits, packed, of one grey image.

    A tall image is looked at in strips that overlap by all that a corner depends on, with the same result."""
    places, bits = [np.zeros((0, 4), "<u4")], [np.zeros((0, TESTS // 8), np.uint8)]
    around = REACH + RADIUS + 4
    for s in range(SCALES):
        if s:
            h, w = (n // 2 * 2 for n in img.shape)
            img = img[:h, :w].astype("f4")
            img = (img[::2, ::2] + img[::2, 1::2] + img[1::2, ::2] + img[1::2, 1::2]) / np.float32(4)
        if min(img.shape) < 2 * RADIUS + 2:
            break
        for top in range(0, img.shape[0], STRIP):
            first = max(0, top - around)
            y, x, turn, test = _corners(img[first : top + STRIP + around].astype("f4"))
            own = (y + first >= top) & (y + first < top + STRIP)
            places.append(np.stack([np.full(own.sum(), s), turn[own], y[own] + first << s, x[own] << s], 1).astype("<u4"))
            bits.append(test[own])
    return np.concatenate(places), np.concatenate(bits)


def _packed(places: np.ndarray, bits: np.ndarray) -> bytes:
    return zstandard.compress(places[:, :2].astype(np.uint8).T.tobytes() + np.ascontiguousarray(places[:, 2:].T).astype("<u4").tobytes() + bits.tobytes(), 3)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n = len(raw) // (10 + TESTS // 8)
    small, wide = raw[: 2 * n].reshape(2, n), np.frombuffer(raw[2 * n : 10 * n].tobytes(), "<u4").reshape(2, n)
    return np.concatenate([small, wide]).T.astype("f8"), raw[10 * n :].reshape(n, TESTS // 8)


def _describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 64):
            part, rows = b.slice(at, 64), []
            for i, h, w, px in zip(*(part.column(c).to_pylist() for c in ("id", "height", "width", "pixels")), strict=True):
                if i is None or px is None or not (h or 0) > 0 or not (w or 0) > 0 or len(px) != h * w:
                    rows.append((None, 0, None))
                    continue
                p, d = features(np.frombuffer(px, np.uint8).reshape(h, w))
                rows.append((hashlib.md5(b"%d:" % h + px).digest(), len(p), _packed(p, d)))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("id"), binary(list(c[0])), pa.array(c[1], pa.int32()), binary(list(c[2]))], names=["id", "digest", "n", "corners"])


DESCRIBED = "id long, digest binary, n int, corners binary"


def described(images: DataFrame) -> DataFrame:
    """(id, digest, n, corners): pixels are read once and go no further; ill-formed images have no digest."""
    return images.select("id", "height", "width", "pixels").mapInArrow(tidy(_describe), DESCRIBED)


def tables(found: DataFrame) -> DataFrame:
    """(row, key, w, n): the entries of each image in the tables, one table a band of the bits; ``w`` of its ``n`` corners have that entry.

    An image of fewer than ``VOTES`` corners is no copy of another one and has no entries."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = TESTS // 8 // BANDS
        for b in it:
            rows, keys, times, sizes = [], [], [], []
            for row, blob in zip(b.column("row").to_pylist(), b.column("corners").to_pylist(), strict=True):
                d = _unpacked(blob)[1]
                for k in range(BANDS):
                    word = np.zeros((len(d), 8), np.uint8)
                    word[:, :step], word[:, 7] = d[:, k * step : (k + 1) * step], k
                    key, w = np.unique(word.reshape(-1).view("<i8"), return_counts=True)
                    keys.append(key)
                    times.append(w)
                    rows.append(np.full(len(key), row))
                    sizes.append(np.full(len(key), len(d)))
            if rows:
                kinds = (rows, pa.int64()), (keys, pa.int64()), (times, pa.int32()), (sizes, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in kinds], names=["row", "key", "w", "n"])

    return found.where(F.col("n") >= VOTES).select("row", "corners").mapInArrow(run, "row long, key long, w int, n int")


def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the test bits of ``a`` and ``b`` of which at most ``WRONG`` differ.

    The first 64 bits rule out nearly all, so the rest is looked at for few."""
    p, q = (np.ascontiguousarray(x[:, :8]).view("<u8").reshape(-1) for x in (a, b))
    rest, of = (np.ascontiguousarray(x[:, 8:]).view("<u4").reshape(-1) for x in (a, b))
    at, few = [], max(1, (1 << 16) // max(1, len(q)))
    for k in range(0, len(p), few):
        wrong = np.bitwise_count(p[k : k + few, None] ^ q)
        one = np.flatnonzero(wrong <= WRONG)
        i, j = one // max(1, len(q)), one % max(1, len(q))
        ok = wrong.reshape(-1)[one] + np.bitwise_count(rest[i + k] ^ of[j]) <= WRONG
        at.append(np.stack([i[ok] + k, j[ok]]))
    i, j = np.concatenate(at, 1) if at else np.zeros((2, 0), "i8")
    return i, j


def copies_of(a: tuple[np.ndarray, np.ndarray], places: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of which images ``a`` is a copy; image k has the corners ``starts[k]`` to ``starts[k + 1]``, no fewer than ``a``.

    ``VOTES`` corners of ``a``, and ``SHARE`` of them, have a match (all bits, ``WRONG`` may differ) on one turn, scale and
    shift. A vote is one number, the image, the transform and the corner that votes for it, so that one sort counts all."""
    n, need = len(a[0]), max(VOTES, SHARE * len(a[0]))
    out = np.zeros(len(starts) - 1, bool)
    if n < need:
        return out
    i, j = near(a[1], bits)
    of = np.searchsorted(starts, j, "right") - 1
    times = np.bincount(of * n + i, minlength=len(out) * n)
    keep = ((times.reshape(-1, n) > 0).sum(1) >= need)[of]
    i, j, of = i[keep], j[keep], of[keep]
    rare = times[of * n + i] <= RARE
    for some in (rare, True):  # corners that repeat have most matches: who has votes enough without them needs no more
        at = np.flatnonzero(~out[of] & some)
        if len(at):
            out |= _voted(a[0][i[at]], places[j[at]], i[at], of[at], len(out), n, need)
    return out


def _voted(s: np.ndarray, t: np.ndarray, i: np.ndarray, of: np.ndarray, images: int, n: int, need: float) -> np.ndarray:
    """Which images get ``need`` votes for one transform by matches of places ``s`` and ``t``: corner ``i`` of ``n`` and image ``of``."""
    out = np.zeros(images, bool)
    scale, spin = t[:, 0] - s[:, 0], (t[:, 1] - s[:, 1]).astype("i8") % TURNS
    grow, cos, sin = 2.0**scale, _cos[spin], _sin[spin]
    dy = t[:, 2] - grow * (cos * s[:, 2] + sin * s[:, 3])
    dx = t[:, 3] - grow * (cos * s[:, 3] - sin * s[:, 2])
    kind = (scale.astype("i8") + SCALES - 1) * TURNS + spin
    for v in (0, 0.5):
        for u in (0, 0.5):
            y, x = np.floor(dy / BIN + v).astype("i8"), np.floor(dx / BIN + u).astype("i8")
            y, x = y - y.min(), x - x.min()
            kinds, high, wide = 2 * SCALES * TURNS, int(y.max()) + 1, int(x.max()) + 1
            if len(out) * kinds * high * wide * n < 1 << 62:
                shift, shifts = (kind * high + y) * wide + x, kinds * high * wide
            else:  # very wide images: shifts by their rank, a place in an image being under 2^20 bins
                shift = np.unique((kind << 42) + (y << 21) + x, return_inverse=True)[1]
                shifts = int(shift.max()) + 1
            vote = np.sort((of * shifts + shift) * n + i)
            at_bin = vote[np.append(True, vote[1:] != vote[:-1])] // n
            first = np.flatnonzero(np.append(True, at_bin[1:] != at_bin[:-1]))
            out[at_bin[first[np.diff(np.append(first, len(at_bin))) >= need]] // shifts] = True
            left = ~out[of]
            if not left.any():
                return out
            i, of, dy, dx, kind = i[left], of[left], dy[left], dx[left], kind[left]
    return out


def is_copy(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether corners agree on one transform: ``VOTES`` of them, and ``SHARE`` of those of the image with fewer."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    return bool(copies_of(a, *b, np.array([0, len(b[0])]))[0])


#: Corners held against corners at once.
AT_ONCE = 1 << 21


def copies_among(images: list[tuple[np.ndarray, np.ndarray]], asked) -> Iterator[tuple[int, np.ndarray]]:
    """(x, later ones) of ``images``, in order of their corners' number, that are copies; ``asked(x)`` says for which after x that is asked."""
    sizes = np.array([len(p) for p, _ in images])
    starts = np.append(0, np.cumsum(sizes))
    places, bits = (np.concatenate([im[k] for im in images]) for k in (0, 1))
    for x, a in enumerate(images[:-1]):
        ask = asked(x)
        later = np.flatnonzero(ask) + x + 1
        while len(later) and sizes[x] >= VOTES:
            take = max(1, int(np.searchsorted(np.cumsum(sizes[later]) * sizes[x], AT_ONCE, "right")))
            some, later = later[:take], later[take:]
            low, high = some[0], some[-1] + 1
            if 2 * len(some) > high - low:  # nearly all: a slice, no copy
                own = slice(starts[low], starts[high])
                ok = np.flatnonzero(copies_of(a, places[own], bits[own], starts[low : high + 1] - starts[low])) + low
                ok = ok[ask[ok - x - 1]]
            else:
                to = np.append(0, np.cumsum(sizes[some]))
                at = np.arange(to[-1]) + np.repeat(starts[some] - to[:-1], sizes[some])
                ok = some[copies_of(a, places[at], bits[at], to)]
            if len(ok):
                yield x, ok


def corners_of(node: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, corners) of the images of which ``rows`` has the number in one column or more.

    Joins with corners are by shuffle at any size: a broadcast would hold them all."""
    ends = rows.select(F.explode(F.array(*rows.columns)).alias("row")).distinct()
    return node.join(ends, "row", "left_semi").select("row", "corners")


def links(pairs: DataFrame, node: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) of images that are copies; ``a`` has no more corners, and its corners travel to those of ``b``."""
    return _held(pairs, corners_of(node, pairs), _unpacked, is_copy)


def may_be_links(pairs: DataFrame, node: DataFrame) -> DataFrame:
    """The pairs (a, b) of which, on the first 64 bits alone, as many corners of ``a`` have a match as a copy needs: all links, and few others.

    Only these bits travel, half of what ``links`` moves."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("row"), binary([_unpacked(x)[1][:, :8].tobytes() for x in b.column("corners").to_pylist()])], names=["row", "corners"])

    def enough(a: np.ndarray, b: np.ndarray) -> bool:
        n, step = 0, max(1, (1 << 16) // max(1, len(b)))
        for k in range(0, len(a), step):
            n += np.count_nonzero((np.bitwise_count(a[k : k + step, None] ^ b) <= WRONG).any(1))
        return n >= max(VOTES, SHARE * len(a))

    return _held(pairs, corners_of(node, pairs).mapInArrow(tidy(cut), "row long, corners binary"), lambda x: np.frombuffer(x, "<u8"), enough)


def _held(pairs: DataFrame, corners: DataFrame, read, test) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for p in it:
            for at in range(0, p.num_rows, 256):
                part, ok = p.slice(at, 256), []
                for b, x, y in zip(*(part.column(c).to_pylist() for c in ("b", "x", "y")), strict=True):
                    if b != last:
                        last, own = b, read(y)
                    ok.append(bool(test(read(x), own)))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (corners.select(F.col("row").alias(r), F.col("corners").alias(c)).hint("merge") for r, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


#: Images of an entry up to which its pairs are rows; the images of other entries are held against each other in blocks.
FEW = 32
#: Images of a class or entry that are held against each other at once.
TOGETHER = 256


def few_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): the pairs of images of different components in an entry of ``FEW`` at most, ``a`` having no more corners and ``enough``."""

    def pairs(key, row, comp, n, enough):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        for h in np.unique(size[size > 1]):
            every = first[size == h][:, None] + np.arange(h)
            for at in (every[k : k + 1024] for k in range(0, len(every), 1024)):
                c, m, r, e = comp[at], n[at], row[at], enough[at]
                g, i, j = np.nonzero(e[:, :, None] & (c[:, :, None] != c[:, None]) & (m[:, :, None] <= m[:, None]))
                a, b, tie = r[g, i], r[g, j], m[g, i] == m[g, j]
                a, b = np.where(tie, np.minimum(a, b), a), np.where(tie, np.maximum(a, b), b)
                got = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), "i8")
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the rows of the last key, which may go on
        for b in it:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "row", "comp", "n", "enough")]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from pairs(*(c[:cut] for c in cols))
            kept = [c[cut:] for c in cols]
        if kept is not None:
            yield from pairs(*kept)

    d = entries.where(F.col("holders") <= FEW).select("key", "row", "comp", "n", "enough")
    return d.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def blocks(d: DataFrame, size: str, *by: str) -> DataFrame:
    """Rows of ``d`` for each pair (i, j) of parts of about ``TOGETHER`` of the ``size`` images of a group ``by`` that theirs is one of."""
    d = d.withColumn("parts", F.ceil(F.col(size) / TOGETHER)).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    d = d.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return d.withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with")).drop("parts", "with", size).groupBy(*by, "i", "j")


def _in_order(key, members):
    """Of a block's images, fewest corners first: rows, unpacked corners, columns by name; and which later ones lie in parts that are held against x's."""
    own = [_unpacked(x) for x in members.column("corners").to_pylist()]
    cols = {c: members.column(c).to_numpy() for c in members.column_names if c != "corners"}
    order = np.lexsort((cols["row"], [len(p) for p, _ in own]))
    cols = {c: v[order] for c, v in cols.items()}
    part, one = cols["part"], key[-2].as_py() == key[-1].as_py()
    return [own[k] for k in order], cols, lambda x: np.full(len(part) - x - 1, True) if one else part[x + 1 :] != part[x]


def hot_links(entries: DataFrame, node: DataFrame) -> DataFrame:
    """(a, b): copies of different components among the images of an entry of more than ``FEW``, held against each other in blocks; no pair is a row but a copy.

    As in ``few_pairs`` the image with fewer corners has ``enough``. Images of one scene share many such entries: a pair is
    looked at in the least of those in which it is asked for, which each image's list of its entries tells."""

    def run(key, members):
        own, cols, apart = _in_order(key, members)
        comp, enough, n = cols["comp"], cols["enough"], cols["n"]
        lists = [[k[k < key[0].as_py()] for k in cols[c]] for c in ("keys", "asking")]
        ids = np.unique(np.concatenate(lists[0]))
        has, asks = np.zeros((2, len(own), len(ids)), "f4")
        for of, rows in zip((has, asks), lists, strict=True):
            for r, k in enumerate(rows):
                of[r, np.searchsorted(ids, k)] = 1
        done = asks @ has.T > 0
        done = [done[x, x + 1 :] | done[x + 1 :, x] & (n[x + 1 :] == n[x]) for x in range(len(own))]
        asked = lambda x: apart(x) & (comp[x + 1 :] != comp[x]) & (enough[x] | enough[x + 1 :] & (n[x + 1 :] == n[x])) & ~done[x]
        got = [(np.full(len(y), cols["row"][x]), cols["row"][y]) for x, y in copies_among(own, asked)]
        a, b = (np.concatenate(x) for x in zip(*got, strict=True)) if got else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    hot = entries.where(F.col("holders") > FEW)
    mixed = hot.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("enough").alias("any")).where("low <> high and any").select("key")
    hot = hot.join(mixed, "key", "left_semi").select("key", "row", "comp", "n", "enough", "holders")
    lists = hot.groupBy("row").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("enough"), F.col("key"))).alias("asking"))
    d = hot.join(lists, "row").join(corners_of(node, hot.select("row")).hint("merge"), "row")
    return blocks(d, "holders", "key").applyInArrow(run, "a long, b long")


def entries_left(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(key, row, comp, n, holders, enough) of shared entries: what the second round goes by.

    ``w`` says how many corners of an image stand behind an entry, so images that repeat a corner are counted in full.
    Each image, as the one with fewer corners, leaves out its commonest entries while fewer than ``VOTES`` of its corners
    stand behind them (``enough`` is false); the other one leaves out none. So every pair of which the entries they share
    hold ``VOTES`` corners of the one with fewer still meets."""
    s = shared.join(label.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    common = Window.partitionBy("row").orderBy(F.desc("holders"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return materialise(s.select("key", "row", "comp", "n", "holders", (F.sum("w").over(common) >= VOTES).alias("enough")), "media-rest")


def class_links(label: DataFrame, node: DataFrame) -> DataFrame:
    """(row, n_links) of the images of every class (node, comp): how many of its class each is a copy of, all held against all.

    A class is dealt into parts of about ``TOGETHER`` images, and each pair of parts is a group; pairs are no rows."""

    def run(key, members):
        own, cols, asked = _in_order(key, members)
        n = np.zeros(len(own), "i8")
        for x, y in copies_among(own, asked):
            n[x] += len(y)
            n[y] += 1
        return pa.table({"row": pa.array(cols["row"], pa.int64()), "n": pa.array(n, pa.int64())})

    size = label.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    d = materialise(label.join(size, "comp").withColumnRenamed("node", "row"), "media-classes")
    two = d.where("size = 2").select("row", F.lit(1).cast("long").alias("n"))
    d = d.where("size > 2")
    d = d.join(corners_of(node, d.select("row")).hint("merge"), "row")
    n = two.unionByName(blocks(d, "size", "comp").applyInArrow(run, "row long, n long"))
    return n.groupBy("row").agg(F.sum("n").alias("n_links"))


def copies(images: DataFrame) -> DataFrame:
    """One row per row of ``images``: ``id``, ``class_id`` (smallest id of its class), ``n_links``.

    Candidates are images that share entries of the tables behind which ``VOTES`` corners stand. In each entry all
    images first meet its first one, so a hot pattern gives a row an image, not pairs, and those that so meet an image often enough are
    looked at; where an entry's images are then still in different components, these are held against each other: as pairs
    where they are ``FEW``, in blocks where they are more. Every candidate pair is so looked at, or is in one class already.
    A pair is linked by ``is_copy``, on all corners and bits, and links make classes. ``n_links`` counts all different images
    that an image is linked to, which are of its class: within a class all are held against all.
    Equal images (height, width, pixels) are one node. Rows are told apart by their place: one id on several images
    is each of them. Null ids, and null, empty or ill-sized pixels, are left out of matching and are a
    class of their own. An image without corners links to equals only."""
    return classes(described(images))


def classes(images: DataFrame) -> DataFrame:
    """``copies`` of images that are ``described``."""
    small_batches(images.sparkSession)
    found = materialise(images.withColumn("row", F.monotonically_increasing_id()), "media")
    good = found.where("digest is not null")
    rep = good.groupBy("digest").agg(F.min("row").alias("rep"))
    rows = materialise(good.select("row", "id", "digest").join(rep, "digest").select("row", "id", "rep"), "media-rows")
    node = good.join(rows.where("row <> rep").select("row"), "row", "left_anti").select("row", "n", "corners")
    of = Window.partitionBy("key")
    every = tables(node).withColumn("to", F.min(F.struct("row", "n")).over(of)).withColumn("holders", F.count(F.lit(1)).over(of))
    shared = materialise(every.where("holders > 1").select("key", "row", "n", "w", "holders", F.col("to.row").alias("to"), F.col("to.n").alias("to_n")), "media-shared")
    met = shared.where("row <> to").groupBy("to", "row", "to_n", "n").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= VOTES)
    less = F.struct("n", "row") < F.struct(F.col("to_n").alias("n"), F.col("to").alias("row"))
    pairs = materialise(met.select(F.when(less, F.col("row")).otherwise(F.col("to")).alias("a"), F.when(less, F.col("to")).otherwise(F.col("row")).alias("b")), "media-pairs")
    known = materialise(links(pairs, node), "media-links")
    left = entries_left(shared, components(known))
    more = materialise(few_pairs(left).join(pairs, ["a", "b"], "left_anti"), "media-more")
    more = materialise(may_be_links(more, node), "media-near")
    label = components(known.unionByName(links(more, node)).unionByName(hot_links(left, node)))
    degree = class_links(label, node).withColumnRenamed("row", "rep")
    node = rows.groupBy("rep").agg(F.min("id").alias("least")).join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    group = node.groupBy("comp").agg(F.min("least").alias("class_id"))
    node = node.join(group, "comp").join(degree, "rep", "left").select("rep", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.join(node, "rep").select("id", "class_id", "n_links")
    rest = found.where("digest is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(rest)


#: Letters a line of a rendered page, and the pixels of a letter.
COLUMNS, GLYPH = 48, (2, 2)


def _text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    bare = F.regexp_replace(F.col(f"`{html_col}`"), r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", "")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(p|div|h[1-6]|li|ul|tr|br|article|nav)\b[^>]*>", "\n"), r"<[^>]*>", "")
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))


def _draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    glyph = np.random.default_rng(5).integers(0, 256, (4096, *GLYPH)).astype(np.uint8)
    glyph[:, -1] = 255
    glyph[32] = 255
    for b in it:
        for at in range(0, b.num_rows, 64):
            part, rows = b.slice(at, 64), []
            for text in part.column("text").to_pylist():
                lines = [line[k : k + COLUMNS].ljust(COLUMNS) for line in map(str.strip, text.split("\n")) if line for k in range(0, len(line), COLUMNS)]
                code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, COLUMNS) % 4096
                px = glyph[code].transpose(0, 2, 1, 3).reshape(len(lines) * GLYPH[0], COLUMNS * GLYPH[1])
                rows.append((px.shape[0], px.shape[1], px.tobytes()))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), binary(list(c[2]))], names=["id", "height", "width", "pixels"])


def rendered(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Each page's visible text as a grey image: a fixed pattern a letter, paragraphs on lines of their own.

    The test tables hold no pictures; this gives every page one, so that copies of pages are copies of images."""
    return _text(pages, id_col, html_col).mapInArrow(_draw, IMAGE)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the class of its cropped and edited copies. Pages are drawn and described in one pass, so pixels leave no worker."""
    pages = _text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html").mapInArrow(tidy(lambda it: _describe(_draw(it))), DESCRIBED)
    return classes(pages).select(F.col("id").alias("page_id"), "class_id", "n_links")
