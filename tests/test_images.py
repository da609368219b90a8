"""Image steps against plain loops, and the operators that choose them."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docassay.functions import pixels as P
from docassay.operators import images as I

R = np.random.default_rng(4)
GREY = R.integers(0, 256, (19, 23)).astype(float)


def at(image, y, x, mode):
    h, w = image.shape
    if mode == "edge":
        return image[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    return image[mirror(y, h), mirror(x, w)]


def each(image, f):
    return np.array([[f(y, x) for x in range(image.shape[1])] for y in range(image.shape[0])])


def test_laplacian_sharpening():
    def one(y, x):
        lap = sum(2 * at(GREY, y + dy, x + dx, "mirror") for dy in (-1, 1) for dx in (-1, 1)) - 8 * GREY[y, x]
        return min(255, max(0, GREY[y, x] - min(128, max(-128, lap))))

    assert np.allclose(P.laplacian_sharpened(GREY), each(GREY, one))


def test_high_pass_only_brightens():
    blur = P.blurred(GREY, 2.0)
    assert np.allclose(P.high_passed(GREY, 2.0, 0.5), each(GREY, lambda y, x: min(255, GREY[y, x] + 0.5 * max(0, GREY[y, x] - blur[y, x]))))


def test_blur_is_a_weighted_mean():
    k = np.array([math.exp(-(i**2) / (2 * 1.5**2)) for i in range(-5, 6)])
    k /= k.sum()
    y = 9
    want = sum(k[i] * k[j] * GREY[y + i - 5, 11 + j - 5] for i in range(11) for j in range(11))
    assert abs(P.blurred(GREY, 1.5)[y, 11] - want) < 1e-9


def test_adaptive_threshold():
    block, less = 11, 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = [math.exp(-(i**2) / (2 * sigma**2)) for i in range(-5, 6)]

    def one(y, x):
        mean = sum(k[i] * k[j] * at(GREY, y + i - 5, x + j - 5, "edge") for i in range(11) for j in range(11)) / sum(k) ** 2
        return 255 if GREY[y, x] > round(mean) - less else 0

    assert (P.adaptive(GREY, block, less) == each(GREY, one)).mean() > 0.999


def test_morphology():
    dots = np.zeros((9, 9))
    dots[4, 4] = 255
    dots[1:4, 1:4] = 255
    opened = P.opened(dots, 3, 3)
    assert opened[4, 4] == 0 and opened[2, 2] == 255
    gap = np.full((9, 9), 255.0)
    gap[4, 2:7] = 0
    assert (P.closed(gap, 2, 1) == 255).all() and P.closed(np.zeros((5, 5)), 2, 2).max() == 0


def test_bilateral():
    def one(y, x):
        total = weight = 0.0
        for dy in range(-4, 5):
            for dx in range(-4, 5):
                if dy * dy + dx * dx <= 16:
                    v = at(GREY, y + dy, x + dx, "mirror")
                    w = math.exp(-((v - GREY[y, x]) ** 2) / (2 * 75**2) - (dy * dy + dx * dx) / (2 * 75**2))
                    total, weight = total + w * v, weight + w
        return total / weight

    assert np.allclose(P.bilateral(GREY, 9, 75, 75), each(GREY, one))


def test_equalisation():
    flat = np.full((64, 64), 90.0)
    assert P.equalised(flat, 3, 8).std() == 0
    ramp = np.tile(np.linspace(100, 140, 64).round(), (64, 1))
    out = P.equalised(ramp, 3, 8)
    assert out.std() > ramp.std() and out.min() >= 0 and out.max() <= 255
    # a single tile without a limit is plain histogram equalisation
    g = R.integers(0, 256, (32, 32)).astype(float)
    cdf = np.bincount(g.astype(int).ravel(), minlength=256).cumsum()
    assert np.allclose(P.equalised(g, 256, 1), np.rint(cdf[g.astype(int)] * 255 / 1024))


def test_enlarging():
    assert np.allclose(P.enlarged(np.full((5, 7), 77.0), 3), 77)
    a = -0.75
    kernel = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0
    out = P.enlarged(GREY, 2)

    def one(y, x):
        sy, sx = (y + 0.5) / 2 - 0.5, (x + 0.5) / 2 - 0.5
        total = 0.0
        for i in range(math.floor(sy) - 1, math.floor(sy) + 3):
            for j in range(math.floor(sx) - 1, math.floor(sx) + 3):
                total += kernel(abs(sy - i)) * kernel(abs(sx - j)) * at(GREY, i, j, "edge")
        return min(255, max(0, round(total)))

    assert out.shape == (38, 46) and np.abs(out - np.array([[one(y, x) for x in range(46)] for y in range(38)])).max() <= 1


def test_wiener_undoes_a_blur():
    sharp = np.kron(R.integers(0, 2, (16, 16)), np.ones((4, 4))) * 200.0
    k = np.exp(-((np.arange(7) - 3) ** 2) / (2 * 1.4**2))
    soft = np.real(np.fft.ifft2(np.fft.fft2(sharp) * np.fft.fft2(np.roll(np.pad(np.outer(k, k) / k.sum() ** 2, ((0, 57), (0, 57))), (-3, -3), (0, 1)))))
    assert np.abs(P.gaussian_wiener(soft, 7, 0.002) - sharp).mean() < 0.8 * np.abs(soft - sharp).mean()


def test_hue_and_saturation():
    import colorsys

    bgr = R.integers(0, 256, (12, 12, 3)).astype(np.uint8)
    hue, saturation = P.hue_and_saturation(bgr)
    for y in range(12):
        for x in range(12):
            b, g, r = (int(v) / 255 for v in bgr[y, x])
            h, s, _ = colorsys.rgb_to_hsv(r, g, b)
            assert abs(saturation[y, x] - 255 * s) <= 0.51 and min(abs(hue[y, x] - 180 * h), 180 - abs(hue[y, x] - 180 * h)) <= 0.51


def test_coloured_strips_become_white():
    image = np.full((40, 40, 3), 120, np.uint8)
    image[5:8, 10:30] = (20, 120, 240)  # orange
    out = P.without_colours(image, I.COLOURED_STRIPS)
    assert (out[5:8, 10:30] == 255).all() and (out[1, 10] == 255).all() and (out[30, 30] == 120).all()


def frame(spark, images):
    rows = [(k, bytearray(i.astype(np.uint8).tobytes()), i.shape[0], i.shape[1], 1 if i.ndim == 2 else 3) for k, i in enumerate(images)]
    rows.append((99, None, None, None, None))
    return spark.createDataFrame(rows, "k long, data binary, height int, width int, n_channels int")


def test_steps_of_each_row(spark):
    tall = R.integers(0, 256, (60, 30, 3))
    df = frame(spark, [tall, GREY])
    got = {x.k: x for x in I.applied(df, I.steps_column((("landscape",), ("gray",)))).collect()}
    assert (got[0].height, got[0].width, got[0].n_channels) == (30, 60, 1) and got[99].data is None
    want = P.gray(np.rot90(tall.astype(np.uint8), -1))
    assert (np.frombuffer(got[0].data, np.uint8).reshape(30, 60) == want).all()
    assert bytes(got[1].data) == GREY.astype(np.uint8).tobytes()
    photo = {x.k: x for x in I.applied(df, I.steps_column((("without photo",),))).collect()}[1]
    pixels = np.frombuffer(photo.data, np.uint8).reshape(GREY.shape)
    assert (pixels[int(19 * 0.18) : int(19 * 0.82), : int(23 * 0.28)] == 255).all() and pixels[0, 0] == GREY[0, 0]


def test_variants_and_the_first_readable(spark):
    recipes = I.qr_recipes()
    assert len(recipes) == 82 and len({n for n in recipes if n.startswith("x4 ")}) == 10
    picked = {n: recipes[n] for n in ("gray", "inverted", "corner otsu", "turned 90", "x2 otsu")}
    image = R.integers(0, 256, (40, 80))
    unreadable = spark.createDataFrame([(7, b"xx", 9, 9, 1), (8, None, 1, 1, 1)], "k int, data binary, height int, width int, n_channels int")
    images = frame(spark, [image]).select("k", "data", "height", "width", "n_channels").unionByName(unreadable)
    for name in ("gray", "inverted", "turned 90", "x2 otsu"):  # each variant is what the steps give one by one
        alone = I.applied(images.where("k = 0"), I.steps_column(picked[name])).first()
        want = (alone.height, alone.width, bytes(alone.data))
        seen = I.first_readable(images, lambda x, want=want: "seen" if (*x.shape, x.tobytes()) == want else None, picked)
        assert [tuple(x) for x in seen.where("payload = 'seen'").collect()] == [(0, name, list(picked).index(name), "seen")]
    assert I.first_readable(images, lambda x: "small" if min(x.shape) < 20 else None, picked).where("payload IS NOT NULL").count() == 0  # the corner is 14 high

    def decoder():
        calls = 0

        def decode(pixels):
            nonlocal calls
            calls += 1
            if calls == 2:
                raise ValueError("not a code")
            return f"found after {calls}" if pixels.shape[0] == 80 else None

        return decode

    read = sorted(tuple(x) for x in I.first_readable(images.where("k < 9"), decoder(), picked).collect())
    assert read == [(0, "turned 90", 3, "found after 3"), (7, None, None, None), (8, None, None, None)]


@pytest.mark.parametrize("measured,n", [(301.0, 1), (300.0, 2), (100.0, 3), (30.0, 4), (None, 4)])
def test_blurred_images_get_more_steps(spark, measured, n):
    df = spark.createDataFrame([(measured,)], "s double").select(F.size(I.sharpening(F.col("s"))).alias("n"))
    assert df.first().n == n


def test_cleaning(spark):
    card = np.full((60, 100, 3), 200)
    card[20:22, 40:90] = 10  # a line of text
    card[2:6, :] = (20, 120, 240)
    got = I.cleaned(frame(spark, [card])).where("k = 0").first()
    pixels = np.frombuffer(got.data, np.uint8).reshape(60, 100)
    assert set(np.unique(pixels)) <= {0, 255} and pixels[21, 60] == 0 and pixels[40, 60] == 255 and got.sharpness > 0


def test_hologram_over_the_whole_corner(spark):
    def score(image):
        m = I.with_measures(frame(spark, [image])).where("k = 0")
        return m.select(I.hologram_check(*(F.col(f"m.{c}") for c in ("corner_colourful", "corner_saturation", "corner_hues")))["score"].alias("s")).first().s

    card = np.full((1000, 600, 3), 180)
    assert score(card) == 45
    rainbow = card.copy()
    stripes = np.array([(0, 0, 255), (0, 255, 0), (255, 0, 0), (0, 255, 255)])
    rainbow[200:300, :132] = stripes[np.arange(132) % 4]  # below the corner's first 4,096 pixels
    assert score(rainbow) == 92
    plain = card.copy()
    plain[200:300, :132] = (0, 0, 255)  # as colourful, of one hue
    assert score(plain) == 75


def test_high_frequencies_of_both_directions(spark):
    g = R.integers(0, 256, (32, 32))
    m = I.with_measures(frame(spark, [g])).where("k = 0").first().m
    c = P.dct_matrix(8)
    block = np.repeat(g[:8, :8, None], 3, 2).astype(np.uint8)
    d = c @ P.gray(block) @ c.T
    want = ((d[4:] ** 2).sum() + (d[:, 4:] ** 2).sum()) / ((d**2).sum() + 1e-6)
    assert any(abs(x - want) < 1e-9 for x in m.dct_high)
    assert any(abs(x - (np.abs(d.ravel()[1:]) < 0.5).mean()) < 1e-9 for x in m.dct_zeros)


def test_distances_to_ground():
    ink = R.random((17, 21)) < 0.8
    ground = np.argwhere(~ink)
    want = [min(math.hypot(y - a, x - b) for a, b in ground) for y, x in np.argwhere(ink)]
    assert np.allclose(P.distances_to_ground(ink), want)
    assert np.isinf(P.distances_to_ground(np.ones((3, 3), bool))).all() and len(P.distances_to_ground(np.zeros((3, 3), bool))) == 0


def test_texture_cells():
    image = R.integers(0, 256, (100, 100)).astype(float)
    got = P.texture_cells(image)
    k = (0.25, 0.5, 0.25)
    for row in range(4):
        for col in range(4):
            cell = image[row * 25 : row * 25 + 25, col * 25 : col * 25 + 25]
            blur = each(cell, lambda y, x: round(sum(k[i] * k[j] * at(cell, y + i - 1, x + j - 1, "mirror") for i in range(3) for j in range(3))))
            above = (cell > blur).sum()
            pair = np.array([625 - above, above])
            assert np.allclose(got[(row * 4 + col) * 2 :][:2], pair / np.linalg.norm(pair), atol=0.003)


def test_gradients():
    def one(y, x):
        v = lambda dy, dx: at(GREY, y + dy, x + dx, "mirror")
        gx = v(-1, 1) + 2 * v(0, 1) + v(1, 1) - v(-1, -1) - 2 * v(0, -1) - v(1, -1)
        gy = v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)
        return math.hypot(gx, gy)

    assert np.allclose(P.gradients(GREY), each(GREY, one))


def test_texture_of_equal_images_matches(spark):
    a, b = R.integers(0, 256, (60, 60)), np.full((60, 60), 90)
    h = frame(spark, [a, a, b]).select("k", I.texture_histograms("data", "height", "width", "n_channels").alias("h"))
    pairs = h.alias("x").join(h.alias("y"), F.expr("x.k = 0 AND y.k > 0")).select(F.col("y.k").alias("k"), I.histogram_match(F.col("x.h"), F.col("y.h")).alias("m"))
    got = {r.k: r.m for r in pairs.collect()}
    assert (got[1].distance, got[1].score, got[1].label) == (0.0, 100.0, "match") and got[2].label == "no match" and got[99].score is None and got[99].label is None


def test_face_measures(spark):
    face = R.integers(100, 140, (90, 90, 3))
    face[:, :, 2] += 60
    flat = np.full((90, 90, 3), 10)
    rows = frame(spark, [face, flat]).select("k", I.face_measures("data", "height", "width", "n_channels").alias("f")).collect()
    f = {r.k: r.f for r in rows}
    assert f[0].entropy > 5 and f[0].dark == 0 and f[0].solid == 0 and f[0].skin_pixels > 1000
    assert f[1].entropy < 2 and f[1].dark == 1 and f[1].solid == 1 and f[1].variance == 0 and f[1].strokes == 0
    assert f[99].entropy is None
    grey = P.gray(face.astype(np.uint8))
    assert abs(f[0].variance - grey.var()) < 1e-6
    spots = [grey[y : y + 16, x : x + 16].var() for y in range(0, 74, 16) for x in range(0, 74, 16)]
    assert f[0].solid == np.mean([v < 15 for v in spots])


def test_face_scores(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    parts = {k: v(c) for k, c in I.liveness_parts(lit(5.0), lit(0.1), lit(0.7), lit(500.0), lit(60.0), lit(20.0)).items()}
    assert {k: round(x, 6) for k, x in parts.items()} == {"entropy": 50.0, "gradient": 50.0, "high": 60.0, "saturation": 90.0}
    assert v(I.liveness_parts(lit(9.0), lit(0.5), lit(0.2), lit(9.0), lit(0.0), lit(0.0))["saturation"]) == 65.0
    for strokes, spread, score, passed in ((99.0, 2.0, 50, True), (500.0, 1.3, 30, False), (500.0, 1.2, 65, True), (500.0, 0.8, 90, True)):
        assert tuple(v(I.font_check(lit(strokes), lit(spread)))) == (score, passed)


@pytest.mark.parametrize("shape", [(64, 64), (16, 40), (130, 33), (200, 150)])
def test_ring_of_half_a_spectrum(shape):
    image = R.integers(0, 256, shape).astype(float)
    whole = P.spectrum(P.resized(image, 128, 128), 2)
    for inner, outer in ((20, 40), (26, 51), (64, 64)):
        want = whole[P.ring(whole.shape, inner, outer)]
        assert np.allclose(P.ring_magnitudes(image, 128, inner, outer), want, rtol=1e-9, atol=1e-6)


def test_rings_are_made_once():
    assert P.ring((512, 512), 102, 204) is P.ring((512, 512), 102, 204)


def test_face_checks_measure_only_faces(spark):
    """The frequencies come with the face's measures; the other measures of an image took most of the time."""
    from docassay.plans.images import face_checks

    plan = face_checks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "face_measures(" in plan and not re.search(r"(?<!face_)measures\(", plan)


def test_steps_hold_few_results_at_once():
    images = pd.DataFrame({"i": range(1000), "data": [bytes([k % 256]) * 6 for k in range(1000)], "height": 2, "width": 3, "n_channels": 1, "__steps": [[{"name": "inverted", "args": []}]] * 1000})
    pieces = list(I._stepped(iter([images, images.iloc[:0], images.iloc[:300]]), ["i"]))
    assert max(map(len, pieces)) <= I.PIECE
    whole = pd.concat(pieces)
    assert list(whole.i) == [*range(1000), *range(300)]
    assert list(whole.data) == [bytes([255 - k % 256]) * 6 for k in whole.i]
