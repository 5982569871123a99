"""Image copies: cropped, turned and brightened copies are found, others are not."""

import numpy as np
from helpers import DATA, folder
from pyspark.sql import functions as F

from twinlake.llm import media

KIND = "id long, height int, width int, pixels binary, key string"


def picture(seed, h=220, w=240):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (h // 10 + 1, w // 10 + 1))
    return np.kron(x, np.ones((10, 10), int))[:h, :w].astype(np.uint8)


def found(spark, images):
    rows = [(i, *(x.shape if x is not None else (None, None)), bytearray(x.tobytes()) if x is not None else None, "k") for i, x in images]
    return {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, KIND)).collect()}


def test_crops_and_edits(spark):
    a, b = picture(1), picture(2)
    edited = a.copy()
    edited[60:90, 60:90] = 128
    images = [(1, a), (2, b), (3, a[15:, 20:].copy()), (4, np.clip(a.astype(int) + 12, 0, 255).astype(np.uint8)), (5, edited), (6, a.copy()), (7, np.rot90(a).copy()), (8, picture(3))]
    got = found(spark, images)
    assert {i: got[i] for i in (1, 3, 4, 5, 6)} == dict.fromkeys((1, 3, 4, 5, 6), 1)
    assert got[7] == 1  # a quarter turn
    assert got[2] == 2 and got[8] == 8


def test_edges(spark):
    tiny = np.zeros((3, 3), np.uint8)
    flat = np.full((100, 100), 7, np.uint8)
    rows = [(1, None, None, None, ""), (2, 0, 0, bytearray(), ""), (3, 5, 5, bytearray(b"short"), ""), (4, 3, 3, bytearray(tiny.tobytes()), ""), (5, 3, 3, bytearray(tiny.tobytes()), ""), (6, 100, 100, bytearray(flat.tobytes()), ""), (None, 3, 3, bytearray(tiny.tobytes()), ""), (7, 1, 9, bytearray(tiny.tobytes()), "")]
    got = media.copies(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(rows)
    by = {r.id: r.class_id for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, None: None}
    assert media.copies(spark.createDataFrame([], KIND)).collect() == []


def test_pages(spark, tmp_path):
    def html(k, more=""):
        word = np.random.default_rng(k).integers(0, 26, (12, 8, 6)) + 97
        lines = [" ".join(bytes(w.tolist()).decode() for w in line) for line in word]
        return "<html><p>" + "</p><p>".join(lines) + f"</p>{more}</html>"

    rows = [(1, "u", html(1)), (2, "u", html(1, "<p>and one more line</p>")), (3, "u", html(5)), (4, "u", None), (5, "u", ""), (6, "u", html(1))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.class_id for r in media.op1(spark, folder(spark, tmp_path, pages=d)).collect()}
    assert got[1] == got[2] == got[6] == 1 and got[3] == 3
    n = spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert media.op1(spark, DATA).count() == n


def test_votes_split_over_smaller_images(spark, monkeypatch):
    """Images 20 and 21 share twelve corners, each of which stands in another smaller image too."""
    corners = [(i, 100 + k, 30 * k, 17 * k * k % 400) for k in range(12) for i in (k + 1, 20, 21)]
    corners += [(i, 200, 5, 5) for i in range(1, 31)]  # one hot bucket of all
    rows = []
    for i in range(1, 31):
        own = [c for c in corners if c[0] == i]
        places = np.array([(0, 0, y, x) for _, _, y, x in own], "<u4")
        bits = np.stack([np.random.default_rng(key).integers(0, 256, 12).astype(np.uint8) for _, key, _, _ in own])
        rows.append((i, bytearray([i] * 16), len(own), bytearray(media._packed(places, bits))))
    monkeypatch.setattr(media, "described", lambda images: spark.createDataFrame(rows, "id long, digest binary, n int, corners binary"))
    got = {r.id: (r.class_id, r.n_links) for r in media.copies(spark.createDataFrame([], KIND)).collect()}
    assert got == {i: (20, 1) if i in (20, 21) else (i, 0) for i in range(1, 31)}


def test_one_id_on_two_images(spark):
    a, b = picture(1), picture(2)
    rows = [(1, *a.shape, bytearray(a.tobytes()), ""), (1, *b.shape, bytearray(b.tobytes()), ""), (2, *b.shape, bytearray(b.tobytes()), "")]
    got = sorted((r.id, r.class_id) for r in media.copies(spark.createDataFrame(rows, KIND)).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]


def test_strips_give_the_same_corners(monkeypatch):
    img = picture(5, 700, 120)
    want = sorted(zip(*(x.tolist() for x in media.features(img)), strict=True))
    monkeypatch.setattr(media, "STRIP", 64)
    assert want and sorted(zip(*(x.tolist() for x in media.features(img)), strict=True)) == want


def test_every_pair_of_the_pages(spark):
    """On all pages of the table of 250: classes are those of all pairs that share entries, none split and none joined."""
    from collections import Counter

    pages = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/pages.parquet")
    found = [r for r in media.described(media.rendered(pages)).collect()]
    good = [(r.id, bytes(r.digest), media._unpacked(bytes(r.corners))) for r in found if r.digest is not None]
    holders = {}
    for k, (_, _, (_, d)) in enumerate(good):
        for band in (0, 1):
            for w in {x.tobytes() for x in d[:, 6 * band : 6 * band + 6]}:
                holders.setdefault((band, w), []).append(k)
    n = Counter((i, j) for h in holders.values() for i in h for j in h if i < j)
    up = list(range(len(good)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, j), shared in n.items():
        need = max(media.VOTES, np.ceil(media.SHARE * min(len(good[i][2][0]), len(good[j][2][0]))))
        if good[i][1] == good[j][1] or shared >= need and media.is_copy(good[i][2], good[j][2]):
            up[root(i)] = root(j)
    least = {}
    for k, (i, _, _) in enumerate(good):
        least[root(k)] = min(i, least.get(root(k), i))
    want = {i: least[root(k)] for k, (i, _, _) in enumerate(good)}
    got = {r.id: r.class_id for r in media.copies(media.rendered(pages)).collect()}
    together = lambda c: {(i, j) for i in c for j in c if i < j and c[i] == c[j]}
    assert together(want) <= together({i: got[i] for i in want})
    assert len(set(want.values())) > 0.5 * len(want)


def test_recall_of_planted_edits(spark):
    """Crops to a half or more, moved brightness, covered parts, quarter turns: nine of ten are found, and no others are joined."""
    rng, images, source = np.random.default_rng(3), [], {}
    for k in range(12):
        a = picture(100 + k)
        y, x = rng.integers(0, 60, 2)
        covered = a.copy()
        covered[y : y + 60, x : x + 60] = 90
        kinds = [a, a[y : y + 150, x : x + 170], np.clip(a.astype(int) + 10, 0, 255).astype(np.uint8), covered, np.rot90(a)]
        for n, img in enumerate(kinds):
            images.append((10 * k + n + 1, np.ascontiguousarray(img)))
            source[10 * k + n + 1] = 10 * k + 1
    got = found(spark, images)
    assert all(source[i] == source[c] for i, c in got.items())
    assert sum(got[i] == source[i] for i in got) >= 0.9 * len(got)


def described_as(spark, monkeypatch, own):
    """``copies`` of images given by their corners: (y, x, seed of the tests' outcomes)."""
    rows = []
    for i, corners in own.items():
        places = np.array([(0, 0, y, x) for y, x, _ in corners], "<u4")
        bits = np.stack([np.random.default_rng(key).integers(0, 256, 12).astype(np.uint8) for _, _, key in corners])
        rows.append((i, bytearray([i] * 16), len(corners), bytearray(media._packed(places, bits))))
    monkeypatch.setattr(media, "described", lambda images: spark.createDataFrame(rows, "id long, digest binary, n int, corners binary"))
    return {r.id: (r.class_id, r.n_links) for r in media.copies(spark.createDataFrame([], KIND)).collect()}


def test_links_within_a_class_are_all_counted(spark, monkeypatch):
    """Four images of one scene are copies of each other, whichever met first; a fifth is a copy of one of them only."""
    scene = [(20 * k, 13 * k * k % 300, 100 + k) for k in range(12)]
    more = [(20 * k, 7 * k * k % 300, 300 + k) for k in range(12)]
    own = {i: [*scene, (300 + i, 5, 200 + i)] for i in (1, 2, 3)} | {4: scene + more, 5: [*more, (310, 5, 205)]}
    monkeypatch.setattr(media, "TOGETHER", 2)
    assert described_as(spark, monkeypatch, own) == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 4), 5: (1, 1)}


def test_repeated_corners(spark, monkeypatch):
    """Tiled images, of which one corner comes again and again, share few entries, but many corners stand behind them."""
    tiles = [(30 * k, 11 * k * k % 200, 100 + k % 2) for k in range(24)]
    own = {1: [*tiles, (900, 5, 301)], 2: [*tiles, (900, 5, 302)], 3: [(30 * k, 17 * k, 400 + k) for k in range(8)]}
    assert described_as(spark, monkeypatch, own) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_pairs_that_share_fewer_entries_than_votes_are_asked(spark, monkeypatch):
    """Of 12 matches of 40 corners eight have a wrong bit in each band: four corners, with two entries each, are shared, ten are asked for.

    The first image of those entries is another one, which shares no more than two with either."""
    own = {i + 1: [(9 * i, 4, 100 + i)] * 1 + [(9 * i, 40 * i, 600 + 20 * i + k) for k in range(3)] for i in range(8)}
    own |= {i: [(25 * k, 19 * k * k % 400, 100 + k) for k in range(4)] + [(900 + 9 * k, 7 * k, 1000 * i + k) for k in range(28)] for i in (20, 21)}
    near = [(25 * k, 19 * k * k % 400, 2000 + k) for k in range(4, 12)]
    rows = []
    for i, corners in own.items():
        if i >= 20:
            corners = corners + near
        places = np.array([(0, 0, y, x) for y, x, _ in corners], "<u4")
        bits = np.stack([np.random.default_rng(key).integers(0, 256, 12).astype(np.uint8) for _, _, key in corners])
        if i == 21:
            bits[-8:, 0] ^= 1
            bits[-8:, 6] ^= 1
        rows.append((i, bytearray([i] * 16), len(corners), bytearray(media._packed(places, bits))))
    monkeypatch.setattr(media, "described", lambda images: spark.createDataFrame(rows, "id long, digest binary, n int, corners binary"))
    got = {r.id: (r.class_id, r.n_links) for r in media.copies(spark.createDataFrame([], KIND)).collect()}
    assert got == {i: (20, 1) if i in (20, 21) else (i, 0) for i in own}


def plain_near(a, b):
    """All pairs on all bits at once."""
    wrong = np.bitwise_count(a.view("<u4")[:, None] ^ b.view("<u4")[None]).sum(2)
    return np.nonzero(wrong <= media.WRONG)


def test_near_corners_are_those_of_all_bits_in_less_time():
    import time

    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 256, (2, 700, 12)).astype(np.uint8)
    for k in range(300):  # up to twelve wrong bits, in any of the bytes
        b[k] = a[(7 * k) % 700]
        for bit in rng.choice(96, k % 13, replace=False):
            b[k, bit // 8] ^= 1 << bit % 8
    took = []
    for way in (plain_near, media.near):
        best = []
        for _ in range(3):
            began = time.process_time()
            got = way(a, b)
            best.append(time.process_time() - began)
        took.append((min(best), set(zip(*(x.tolist() for x in got), strict=True))))
    assert took[0][1] == took[1][1] and len(took[0][1]) > 150
    assert took[1][0] < 0.5 * took[0][0]
    for x, y in ((a[:0], b), (a, b[:0]), (a[:1], b)):
        assert [v.tolist() for v in media.near(x, y)] == [v.tolist() for v in plain_near(x, y)]


def plain_agree(a, b):
    """Whether corners agree on one transform, bin by bin."""
    from collections import defaultdict

    if len(a[0]) > len(b[0]):
        a, b = b, a
    need = max(media.VOTES, media.SHARE * len(a[0]))
    votes = defaultdict(set)
    for i, j in zip(*plain_near(a[1], b[1]), strict=True):
        (s0, s1, sy, sx), (t0, t1, ty, tx) = a[0][i], b[0][j]
        grow, angle = 2.0 ** (t0 - s0), (t1 - s1) % media.TURNS * 2 * np.pi / media.TURNS
        dy, dx = ty - grow * (np.cos(angle) * sy + np.sin(angle) * sx), tx - grow * (np.cos(angle) * sx - np.sin(angle) * sy)
        for v in (0, 0.5):
            for u in (0, 0.5):
                votes[v, u, t0 - s0, (t1 - s1) % media.TURNS, np.floor(dy / media.BIN + v), np.floor(dx / media.BIN + u)].add(i)
    return len(a[0]) >= need and max(map(len, votes.values()), default=0) >= need


def crowd(seed, count):
    """Images that share corners of a few scenes, some at one shift and some anywhere, with wrong bits and repeated corners."""
    rng = np.random.default_rng(seed)
    bits, places = rng.integers(0, 256, (40, 12)).astype(np.uint8), rng.integers(0, 400, (40, 2))
    out = []
    for _ in range(count):
        own = rng.choice(40, rng.integers(1, 30))  # some of them again and again
        d, yx = bits[own].copy(), places[own] + rng.integers(0, 50, 2)
        loose = rng.random(len(own)) < rng.choice([0, 0.5, 0.9])
        yx[loose] = rng.integers(0, 400, (loose.sum(), 2))
        for k in range(len(own)):
            for bit in rng.choice(96, rng.integers(0, 7), replace=False):
                d[k, bit // 8] ^= 1 << bit % 8
        out.append((np.concatenate([rng.integers(0, 2, (len(own), 1)) * (rng.random() < 0.3), np.zeros((len(own), 1)), yx], 1).astype("f8"), d))
    return out


def test_images_held_together_give_the_copies_of_pair_by_pair(monkeypatch):
    own = sorted(crowd(4, 50), key=lambda x: len(x[0]))
    want = {(x, y) for x in range(50) for y in range(x + 1, 50) if plain_agree(own[x], own[y])}
    for at_once in (media.AT_ONCE, 200):
        monkeypatch.setattr(media, "AT_ONCE", at_once)
        assert {(x, y) for x, ys in media.copies_among(own, lambda x: np.full(49 - x, True)) for y in ys.tolist()} == want
    for step in (2, 5):
        asked = lambda x: (np.arange(x + 1, 50) + x) % step == 0  # noqa: B023, E731
        assert {(x, y) for x, ys in media.copies_among(own, asked) for y in ys.tolist()} == {(x, y) for x, y in want if (x + y) % step == 0}
    assert all(media.is_copy(own[y], own[x]) == ((x, y) in want) for x in range(50) for y in range(x + 1, 50) if len(own[x][0]) < len(own[y][0]))
    assert 20 < len(want) < 1000


def test_a_hot_entry_gives_no_pairs_but_its_copies(spark, monkeypatch):
    """Of 90 images that share entries but for two scenes are no copies, no pair is a row; in an entry of a few they are."""
    monkeypatch.setattr(media, "TOGETHER", 16)
    own = crowd(9, 90)
    node = spark.createDataFrame([(i, len(p), bytearray(media._packed(p.astype("<u4"), d))) for i, (p, d) in enumerate(own)], "row long, n int, corners binary")
    kind = "key long, row long, comp long, n int, holders long, enough boolean"
    hot = spark.createDataFrame([(7, i, i // 2, len(p), 90, i % 3 > 0) for i, (p, _) in enumerate(own)], kind)
    assert media.few_pairs(hot).collect() == []
    less = lambda i, j: (len(own[i][0]), i) < (len(own[j][0]), j)
    met = lambda i, j: i // 2 != j // 2 and less(i, j) and (i % 3 > 0 or j % 3 > 0 and len(own[i][0]) == len(own[j][0]))
    want = {(i, j) for i in range(90) for j in range(90) if met(i, j) and plain_agree(own[i], own[j])}
    assert sorted(tuple(r) for r in media.hot_links(hot, node).collect()) == sorted(want) and want
    twice = hot.unionByName(hot.withColumn("key", F.lit(8).cast("long"))).unionByName(hot.where("row % 2 = 0").withColumn("key", F.lit(3).cast("long")))
    assert sorted(tuple(r) for r in media.hot_links(twice, node).collect()) == sorted(want)  # none in two entries
    few = spark.createDataFrame([(i // 30, i, i // 2, len(p), 30, i % 3 > 0) for i, (p, _) in enumerate(own)], kind)
    pairs = media.few_pairs(few)
    assert {tuple(r) for r in pairs.collect()} == {(i, j) for i in range(90) for j in range(90) if i // 30 == j // 30 and met(i, j)}
    near = media.may_be_links(pairs, node)
    assert {tuple(r) for r in media.links(near, node).collect()} == {tuple(r) for r in media.links(pairs, node).collect()} == {(i, j) for i, j in want if i // 30 == j // 30}
    assert near.count() < pairs.count()
