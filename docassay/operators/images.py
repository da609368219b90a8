"""Image measurements and the checks made of them.

Measuring runs in Arrow batches, an image at a time; every threshold and score
is an expression on the measured columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.functions import pixels as P

_NUMBERS = ("brightness", "contrast", "sharpness", "moire_peaks", "moire_global", "fft_peak", "fft_high", "lbp_entropy", "ela_pixels", "ela_blocks", "corner_colourful", "corner_saturation", "corner_hues")
_ARRAYS = ("dct64", "noise_variances", "dct_energies", "dct_high", "dct_zeros")
MEASURES = T.StructType(
    [T.StructField(k, T.DoubleType()) for k in _NUMBERS] + [T.StructField(k, T.ArrayType(T.DoubleType())) for k in _ARRAYS]
)


def _frequencies(g: np.ndarray) -> tuple[float, float]:
    """The strongest frequency and the mean of the high ones, as multiples of the mean."""
    s = P.spectrum(P.resized(g, 128, 128), 2)
    mean = max(s.mean(), 1e-9)
    return s.max() / mean, s[P.ring(s.shape, 0.4 * 128, 128)].mean() / mean


def _measured(bgr: np.ndarray) -> dict:
    g = P.gray(bgr)
    out = {"brightness": g.mean(), "contrast": g.std(), "sharpness": P.laplacian(g).var(), "dct64": P.perceptual_coefficients(g).tolist()}
    out["noise_variances"] = P.blocks(P.median_residual(g), 16).var(axis=(1, 2)).tolist()
    c = P.dct_matrix(8)
    d = c @ P.blocks(g, 8, step=4) @ c.T
    energy = (d**2).sum((1, 2))
    high = (d[:, 4:, :] ** 2).sum((1, 2)) + (d[:, :, 4:] ** 2).sum((1, 2))  # what is high both ways counts twice
    out["dct_energies"] = energy.tolist()
    out["dct_high"] = (high / (energy + 1e-6)).tolist()
    out["dct_zeros"] = (np.abs(d.reshape(-1, 64)[:, 1:]) < 0.5).mean(1).tolist()
    band = P.ring_magnitudes(g, 512, 102, 204)
    out["moire_peaks"] = (band > band.mean() + 3.5 * band.std()).mean()
    out["moire_global"] = band.max() / max(band.mean(), 1e-9)
    out["fft_peak"], out["fft_high"] = _frequencies(g)
    share = np.bincount(P.local_patterns(g).ravel(), minlength=256) / max(1, (g.shape[0] - 2) * (g.shape[1] - 2))
    out["lbp_entropy"] = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    e = P.recompression_error(g)
    out["ela_pixels"] = (e > e.mean() + 3 * e.std()).mean()
    each = e.mean((1, 2))
    out["ela_blocks"] = (each > each.mean() + 3 * each.std()).mean()
    hue, saturation = P.hue_and_saturation(bgr[: max(1, int(0.30 * bgr.shape[0])), : max(1, int(0.22 * bgr.shape[1]))])
    colourful = saturation > 60
    out["corner_colourful"], out["corner_saturation"] = colourful.mean(), saturation.mean()
    out["corner_hues"] = hue[colourful].std() if colourful.sum() > 50 else 0.0
    return out


@F.pandas_udf(MEASURES)
def measures(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Measures of raw pixels (rows of BGR or grey bytes); null for unreadable or very small images."""
    rows = []
    for d, h, w, n in zip(data, height, width, channels):
        fits = d is not None and h >= 16 and w >= 16 and n in (1, 3, 4) and len(d) == h * w * n
        image = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(n)) if fits else None
        if fits and n == 1:
            image = image.repeat(3, -1)
        rows.append(_measured(image) if fits else dict.fromkeys([*_NUMBERS, *_ARRAYS]))
    return pd.DataFrame(rows, columns=[*_NUMBERS, *_ARRAYS])


def with_measures(images: DataFrame) -> DataFrame:
    """`images` (data, height, width, n_channels) with a struct m of measures."""
    return images.withColumn("m", measures("data", "height", "width", "n_channels"))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values).cast("double"))


def _spread(values: Column, mean: Column) -> Column:
    return F.sqrt(_mean(F.transform(values, lambda x: (x - mean) * (x - mean))))


def phash(dct64: Column) -> Column:
    """64 bits as a long, first coefficient highest: above the mean of all but the first."""
    mean = (F.aggregate(dct64, F.lit(0.0), lambda s, x: s + x) - F.get(dct64, 0)) / 63.0
    return F.aggregate(
        F.transform(dct64, lambda x: (x > mean).cast("long")), F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b)
    )


def blur_label(sharpness: Column) -> Column:
    return F.when(sharpness > 300, "SHARP").when(sharpness > 100, "MODERATE").when(sharpness > 30, "BLURRY").otherwise("VERY BLURRY")


def noise_check(variances: Column) -> Column:
    """struct(score, passed): share of blocks far below the mean noise."""
    mean = _mean(variances)
    low = F.size(F.filter(variances, lambda v: v < mean - 2.5 * _spread(variances, mean))) / F.size(variances)
    score = F.when(mean < 1e-6, 50).when(low > 0.12, 25).when(low > 0.06, 60).otherwise(88)
    return F.struct(score.alias("score"), (score != 25).alias("passed"))


def recompression_check(block_share: Column, pixel_share: Column) -> Column:
    """struct(score, passed): share of blocks, and of pixels, that coarser coefficients change far more than others.

    The coarse steps stand for a JPEG round trip; no encoder comes with Spark.
    """
    score = F.when(block_share > 0.05, 20).when(block_share > 0.02, 55).when(pixel_share > 0.08, 65).otherwise(90)
    return F.struct(score.alias("score"), (score != 20).alias("passed"))


def moire_check(peaks: Column, strongest: Column) -> Column:
    score = F.when((peaks > 0.008) & (strongest > 12), 15).when((peaks > 0.004) | (strongest > 8), 55).otherwise(92)
    return F.struct(score.alias("score"), (score != 15).alias("passed"))


def generated_check(energies: Column, high: Column, zeros: Column) -> Column:
    """struct(score, passed) by three signs of a generated image."""
    mean = _mean(energies)
    signs = (
        (F.try_divide(_spread(energies, mean), mean) < 0.20).cast("int")
        + (_mean(high) > 0.18).cast("int")
        + (_mean(zeros) > 0.30).cast("int")
    )
    score = F.when(mean.isNull(), 60).when(signs >= 3, 15).when(signs == 2, 55).when(signs == 1, 75).otherwise(90)
    return F.struct(score.alias("score"), (score != 15).alias("passed"))


def hologram_check(colourful: Column, saturation: Column, hues: Column) -> Column:
    """struct(score, passed) by the upper left corner: share of colourful pixels, mean saturation, spread of their hues; never fails."""
    score = F.when((colourful > 0.10) & (hues > 15), 92).when((colourful > 0.04) | (saturation > 25), 75).otherwise(45)
    return F.struct(score.alias("score"), F.lit(True).alias("passed"))


def face_quality(sharpness: Column, brightness: Column, area: Column, contrast: Column) -> Column:
    """struct(score, label) of a face crop."""
    score = (
        F.when(sharpness > 200, 35).when(sharpness > 80, 25).when(sharpness > 20, 12).otherwise(0)
        + F.when(brightness.between(60, 200), 25).when(brightness.between(40, 220), 15).otherwise(5)
        + F.when(area > 5000, 25).when(area > 2000, 15).when(area > 500, 8).otherwise(0)
        + F.when(contrast > 40, 15).when(contrast > 20, 10).otherwise(3)
    )
    return F.struct(score.alias("score"), F.when(score >= 75, "GOOD").when(score >= 45, "ACCEPTABLE").otherwise("POOR").alias("label"))


def liveness(peak: Column, high: Column) -> Column:
    """struct(score, label) by the strongest frequency and the share of high ones."""
    zero = F.lit(0.0)
    raw = F.lit(100.0) - F.greatest(zero, (peak - 5) * 5) - F.greatest(zero, (high - 1.5) * 15)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw).cast("int")))
    return F.struct(score.alias("score"), F.when(score >= 65, "live").when(score >= 40, "uncertain").otherwise("suspicious").alias("label"))


def age_check(born: Column, estimate: Column, as_of: Column, tolerance: Column) -> Column:
    """struct(age, score): declared age in years and how well an estimated one agrees; null without either."""
    age = F.datediff(as_of, born) / 365.25
    off = F.abs(age - estimate)
    score = F.when(off <= 0.5 * tolerance, 100).when(off <= tolerance, 75).when(off <= 1.5 * tolerance, 45).when(off.isNotNull(), 10)
    return F.struct(age.alias("age"), score.alias("score"))


def match_by_cosine(similarity: Column, least: float = 0.28) -> Column:
    """struct(matched, score, distance) of two embeddings' cosine."""
    return F.struct((similarity >= least).alias("matched"), F.round((similarity + 1) / 2 * 100, 1).alias("score"), F.round(1 - similarity, 4).alias("distance"))


# Hues, least saturation and least brightness of coloured strips; the photograph's place on a card's front.
COLOURED_STRIPS = ((5, 25, 80, 80), (40, 85, 50, 50))
PHOTO = (0.18, 0.82, 0.0, 0.28)
# Parts of a card that may hold a QR code (top, bottom, left, right share); pixels that a part needs.
QR_PARTS = {
    "lower right": (0.45, 1.0, 0.55, 1.0), "wide lower right": (0.35, 1.0, 0.45, 1.0), "corner": (0.65, 1.0, 0.65, 1.0),
    "right half": (0.0, 1.0, 0.5, 1.0), "lower half": (0.5, 1.0, 0.0, 1.0), "whole": (0.0, 1.0, 0.0, 1.0),
}
LEAST_PART = 20


def _part(image: np.ndarray, top: float, bottom: float, left: float, right: float) -> np.ndarray | None:
    h, w = image.shape[:2]
    part = image[int(h * top) : int(h * bottom), int(w * left) : int(w * right)]
    return part if min(part.shape[:2]) > LEAST_PART else None


def _without_photo(image: np.ndarray) -> np.ndarray:
    out, (h, w) = image.copy(), image.shape[:2]
    out[int(h * PHOTO[0]) : int(h * PHOTO[1]), int(w * PHOTO[2]) : int(w * PHOTO[3])] = 255
    return out


#: Steps by name. Each turns an image into another; those above "gray" also take colours.
STEPS = {
    "landscape": lambda i: np.rot90(i, -1) if i.shape[0] > i.shape[1] else i,
    "turned": lambda i, quarters: np.rot90(i, -int(quarters)),
    "part": _part,
    "without photo": _without_photo,
    "without colours": lambda i: P.without_colours(i, COLOURED_STRIPS) if i.ndim == 3 else i,
    "gray": lambda i: P.gray(i) if i.ndim == 3 else i,
    "inverted": lambda g: 255 - g,
    "unsharp": P.unsharp,
    "laplacian": P.laplacian_sharpened,
    "high pass": P.high_passed,
    "gamma": P.gamma,
    "wiener": lambda g, size, noise: P.wiener(g, int(size), noise),
    "gaussian wiener": lambda g, size, noise: P.gaussian_wiener(g, int(size), noise),
    "equalised": lambda g, clip, tiles: P.equalised(g, clip, int(tiles)),
    "bilateral": lambda g, size, levels, places: P.bilateral(g, int(size), levels, places),
    "enlarged": lambda g, times: P.enlarged(g, int(times)),
    "otsu": P.otsu,
    "adaptive": lambda g, block, less: P.adaptive(g, int(block), less),
    "otsu or adaptive": lambda g, block, less: np.maximum(P.otsu(g), P.adaptive(g, int(block), less)),
    "opened": lambda g, height, width: P.opened(g, int(height), int(width)),
    "closed": lambda g, height, width: P.closed(g, int(height), int(width)),
}
Steps = tuple[tuple, ...]


def steps_column(steps: Steps) -> Column:
    """Steps, (name, arguments...) each, as a column."""
    each = [F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, args)).cast("array<double>").alias("args")) for name, *args in steps]
    return F.array(*each).cast("array<struct<name: string, args: array<double>>>")


def qr_recipes() -> dict[str, Steps]:
    """The steps of every variant of an image in which a QR code is sought, in the order of their tiers."""
    # Parameters of the steps.
    clahe, tight, smooth, fine = ("equalised", 3, 8), ("equalised", 4, 4), ("bilateral", 9, 75, 75), ("adaptive", 11, 2)
    sharp, sharper = ("unsharp", 3, 0.8), ("unsharp", 5, 1.5)
    out: dict[str, Steps] = {}
    for k in (2, 3, 4):
        kinds = {"otsu": (("otsu",),), "unsharp otsu": (("unsharp", 2, 0.5), ("otsu",)), "clahe": (clahe,), "adaptive": (fine,)}
        kinds |= {f"{part} otsu": (("part", *place), ("otsu",)) for part, place in QR_PARTS.items()}
        out |= {f"x{k} {name}": (("enlarged", k), *steps) for name, steps in kinds.items()}
    out |= {"gray": (), "inverted": (("inverted",),)} | {f"gamma {g}": (("gamma", g),) for g in (0.4, 0.6, 1.5, 2.0)}
    out |= {"clahe": (clahe,), "tight clahe": (tight,), "bilateral": (smooth,), "bilateral clahe": (smooth, clahe)}
    out |= {"unsharp": (sharp,), "strong unsharp": (sharper,), "clahe unsharp": (clahe, sharp)}
    out |= {"wiener": (("wiener", 5, 0.01),), "strong wiener": (("wiener", 9, 0.005),)}
    out |= {"otsu": (("otsu",),), "inverted otsu": (("otsu",), ("inverted",)), "adaptive": (fine,)}
    out |= {"clahe adaptive": (clahe, fine), "bilateral adaptive": (smooth, fine)}
    out |= {"opened": (("otsu",), ("opened", 3, 3)), "closed": (("otsu",), ("closed", 2, 2))}
    for part, place in QR_PARTS.items():
        kinds = {"gray": (), "inverted": (("inverted",),), "otsu": (("otsu",),), "clahe": (clahe,)}
        out |= {f"{part} {name}": (("part", *place), *steps) for name, steps in kinds.items()}
    for quarters in (1, 2, 3):
        out |= {f"turned {90 * quarters}": (("turned", quarters),), f"turned {90 * quarters} otsu": (("turned", quarters), ("otsu",))}
    return {name: (("gray",), *steps) for name, steps in out.items()}


#: Images whose results are held at once; a batch may have 10,000.
PIECE = 256


def _stepped(frames: Iterator[pd.DataFrame], kept: list[str]) -> Iterator[pd.DataFrame]:
    """Each row's steps applied to its image, by pieces of the batches."""
    for frame in frames:
        for start in range(0, len(frame), PIECE):
            piece, rows = frame.iloc[start : start + PIECE], []
            for d, h, w, n, todo in zip(*(piece[c] for c in ("data", "height", "width", "n_channels", "__steps"))):
                image = _opened(d, h, w, n)
                for step in todo if todo is not None else ():
                    image = None if image is None else STEPS[step["name"]](image, *step["args"])
                if image is None:
                    rows.append((None, None, None, None))
                else:
                    whole = _whole(image)
                    rows.append((whole.tobytes(), *whole.shape[:2], 3 if whole.ndim == 3 else 1))
            out = piece[kept].copy()
            for k, c in enumerate(("data", "height", "width", "n_channels")):
                out[c] = pd.Series([r[k] for r in rows], index=out.index, dtype="object" if c == "data" else "Int32")
            yield out


def applied(images: DataFrame, steps: Column) -> DataFrame:
    """`images` (data, height, width, n_channels, ...) after each row's own steps; unreadable ones, and parts too small, have null data."""
    kept = [c for c in images.columns if c not in ("data", "height", "width", "n_channels")]

    fields = {f.name: f.dataType.simpleString() for f in images.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in kept), "data binary, height int, width int, n_channels int"])
    asked = images.select(*kept, "data", "height", "width", "n_channels", steps.alias("__steps"))
    return asked.mapInPandas(lambda frames: _stepped(frames, kept), schema)


def _opened(d, h, w, n) -> np.ndarray | None:
    """The pixels that steps work on: three colours, or grey as doubles; None for unreadable ones."""
    if d is None or len(d) != h * w * n:
        return None
    image = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(n))
    return image[..., :3] if n >= 3 else image[..., 0].astype(np.float64)


def _whole(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def _each_variant(image: np.ndarray, recipes: dict[str, Steps]) -> Iterator[tuple[int, str, np.ndarray]]:
    """(rank, name, grey pixels) of the recipes in order, each made when it is asked for; too small parts are left out.

    What several recipes begin with is made once.
    """
    made: dict[Steps, np.ndarray | None] = {(): image}
    for rank, (name, steps) in enumerate(recipes.items()):
        for k in range(1, len(steps) + 1):
            if steps[:k] not in made:
                before, (step, *args) = made[steps[: k - 1]], steps[k - 1]
                made[steps[:k]] = None if before is None else STEPS[step](before, *args)
        if made[steps] is not None:
            yield rank, name, _whole(made[steps])


def first_readable(images: DataFrame, decode: Callable[[np.ndarray], str | None], recipes: dict[str, Steps] | None = None) -> DataFrame:
    """`images` without their pixels, with variant, rank and payload of the first variant in which `decode` finds one; null for none.

    The later recipes of an image are not made any more. A decoder's error counts as nothing found.
    """
    recipes = qr_recipes() if recipes is None else recipes

    def read(image: np.ndarray | None) -> tuple:
        for rank, name, pixels in () if image is None else _each_variant(image, recipes):
            try:
                payload = decode(pixels)
            except Exception:
                payload = None
            if payload:
                return name, rank, payload
        return None, None, None

    @F.pandas_udf(T.StructType.fromDDL("variant string, rank int, payload string"))
    def found(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = [read(_opened(*x)) for x in zip(data, height, width, channels)]
        out = pd.DataFrame(rows, columns=["variant", "rank", "payload"])
        return out.astype({"rank": "Int32"})

    kept = [c for c in images.columns if c not in ("data", "height", "width", "n_channels", "variant", "rank", "payload")]
    return images.select(*kept, found("data", "height", "width", "n_channels").alias("__x")).select(*kept, "__x.*")


@F.pandas_udf(T.DoubleType())
def sharpness(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Variance of the Laplacian of grey images; null for unreadable ones."""
    made = lambda d, h, w: float(P.laplacian(np.frombuffer(d, np.uint8).reshape(int(h), int(w)).astype(np.float64)).var())
    return pd.Series([made(d, h, w) if d is not None and len(d) == h * w else None for d, h, w in zip(data, height, width)], dtype="float64")


def sharpening(measured: Column) -> Column:
    """The steps that an image of this sharpness needs: the more, the more it is blurred."""
    # Parameters of each class of sharpness.
    return (
        F.when(measured > 300, steps_column((("unsharp", 1.5, 0.6),)))
        .when(measured > 100, steps_column((("unsharp", 2.0, 1.2), ("high pass", 4, 0.3))))
        .when(measured > 30, steps_column((("unsharp", 2.5, 1.8), ("laplacian",), ("high pass", 5, 0.5))))
        .otherwise(steps_column((("gaussian wiener", 7, 0.02), ("unsharp", 2.0, 1.5), ("laplacian",), ("high pass", 4, 0.4))))
    )


def cleaned(images: DataFrame, front: bool = True) -> DataFrame:
    """`images` made ready for OCR: black on white in data, and the measured sharpness.

    Turned to landscape, without photograph (fronts only) and coloured strips,
    grey, equalised, sharpened as each needs it, binarised (Otsu or adaptive),
    small gaps closed. Denoising and deskewing are left out.
    """
    first = (("landscape",), *((("without photo",),) if front else ()), ("without colours",), ("gray",), ("equalised", 3, 8))
    grey = applied(images, steps_column(first)).withColumn("sharpness", sharpness("data", "height", "width"))
    last = steps_column((("otsu or adaptive", 21, 10), ("closed", 2, 1)))
    return applied(grey, F.concat(sharpening(F.col("sharpness")), last))


def _grey(d, h, w, n) -> np.ndarray | None:
    if d is None or len(d) != h * w * n:
        return None
    image = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(n))
    return P.gray(image) if n >= 3 else image[..., 0].astype(np.float64)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def texture_histograms(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    """Texture of each cell of an image (see `pixels.texture_cells`); null for unreadable ones."""
    greys = (_grey(*x) for x in zip(data, height, width, channels))
    return pd.Series([None if g is None else P.texture_cells(g).tolist() for g in greys])


def histogram_match(a: Column, b: Column) -> Column:
    """struct(distance, score, label) by the chi-square distance of two histograms."""
    distance = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x + y > 0, 2 * (x - y) * (x - y) / (x + y)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x
    )
    score = F.when(distance.isNotNull(), 100 * (1 - F.least(distance / 2, F.lit(1.0))))
    label = F.when(score >= 70, "match").when(score >= 55, "likely").when(score >= 35, "uncertain").when(score.isNotNull(), "no match")
    return F.struct(F.round(distance, 4).alias("distance"), F.round(score, 1).alias("score"), label.alias("label"))


_FACE = ("entropy", "sharp_edges", "high_share", "skin_pixels", "skin_saturation", "skin_spread", "solid", "variance", "dark", "strokes", "stroke_spread", "fft_peak", "fft_high")
FACE_MEASURES = T.StructType([T.StructField(k, T.DoubleType()) for k in _FACE])


def _face_measured(bgr: np.ndarray) -> list[float]:
    g = P.gray(bgr)
    small = np.rint(P.resized(g, 128, 128))
    patterns = np.zeros(small.shape, np.int64)
    patterns[1:-1, 1:-1] = P.local_patterns(small)
    share = np.bincount(patterns.ravel(), minlength=256) / patterns.size
    f = np.abs(np.fft.fftshift(np.fft.fft2(small)))
    hue, saturation = P.hue_and_saturation(bgr)
    skin = saturation[(hue >= 3) & (hue <= 30) & (bgr.max(-1) > 40)]
    size = max(16, min(g.shape) // 6)
    spots = [g[y : y + size, x : x + size].var() for y in range(0, g.shape[0] - size, size) for x in range(0, g.shape[1] - size, size)]
    lower = g[int(g.shape[0] * 0.70) :, int(g.shape[1] * 0.20) : int(g.shape[1] * 0.85)]
    strokes = P.distances_to_ground(P.otsu(lower) == 0)
    strokes = strokes[np.isfinite(strokes)]
    return [
        float(-(share[share > 0] * np.log2(share[share > 0] + 1e-10)).sum()), (P.gradients(small) > 150).mean(),
        f[P.ring(f.shape, np.nextafter(0.35 * 128, 200), 1e9)].sum() / (f.sum() + 1e-6),
        float(len(skin)), skin.mean() if len(skin) else 0.0, skin.std() if len(skin) else 0.0,
        (np.array(spots) < 15).mean() if spots else 0.0, g.var(), (g < 30).mean(),
        float(len(strokes)), strokes.std() / (np.median(strokes) + 1e-6) if len(strokes) else 0.0,
        *_frequencies(g),
    ]


@F.pandas_udf(FACE_MEASURES)
def face_measures(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Measures of a face crop, and of the strokes of a card's lower part; null for unreadable or very small images."""
    rows = []
    for d, h, w, n in zip(data, height, width, channels):
        fits = d is not None and h >= 16 and w >= 16 and n in (1, 3, 4) and len(d) == h * w * n
        image = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(n)) if fits else None
        rows.append(_face_measured(image.repeat(3, -1) if n == 1 else image[..., :3]) if fits else [None] * len(_FACE))
    return pd.DataFrame(rows, columns=list(_FACE)).astype("float64")


def font_check(strokes: Column, spread: Column) -> Column:
    """struct(score, passed): how much the strokes' widths differ in the number's region."""
    score = F.when(strokes < 100, 50).when(spread > 1.2, 30).when(spread > 0.8, 65).when(spread.isNotNull(), 90)
    return F.struct(score.alias("score"), (score != 30).alias("passed"))


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def liveness_parts(entropy: Column, edges: Column, high: Column, pixels: Column, saturation: Column, spread: Column) -> dict[str, Column]:
    """Part scores from 0 to 100 of a face's measures: texture, edges, high frequencies and skin."""
    skin = F.when(saturation.between(25, 120), 1.0).otherwise(0.4) * F.when(spread.between(8, 50), 1.0).otherwise(0.5) * 90
    return {
        "entropy": _within((entropy - 3.0) / 4.0 * 100), "gradient": _within((0.20 - edges) / 0.20 * 100),
        "high": _within((0.85 - high) / 0.25 * 100), "saturation": F.when(pixels > 200, skin).otherwise(65.0),
    }


def passive_liveness(entropy: Column, gradient: Column, high: Column, saturation: Column) -> Column:
    """struct(score, real) of four part scores from 0 to 100."""
    score = F.round(_within(0.35 * entropy + 0.30 * gradient + 0.20 * high + 0.15 * saturation), 1)
    return F.struct(score.alias("score"), (score >= 55).alias("real"))


def combined_liveness(frequency: Column, passive: Column) -> Column:
    score = F.least(frequency, passive)
    return F.struct(score.alias("score"), (score >= 55).alias("real"))


def occlusion_score(eyes: Column, solid: Column, variance: Column, dark: Column) -> Column:
    """Weighted score of visible eyes, solid blocks, variance and dark share, each cut to whole points."""
    part = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))).cast("int")
    seen = F.when(eyes >= 2, 100).when(eyes == 1, 65).otherwise(35)
    return F.floor((40 * seen + 30 * part(100 - 300 * solid) + 20 * part(variance / 5) + 10 * part(100 - 500 * dark)) / 100).cast("int")


def face_region(data: DataFrame) -> DataFrame:
    """x, y, w, h of the part of a card that holds the photograph when no detector is at hand."""
    w, h = F.col("width"), F.col("height")
    return data.withColumn(
        "face", F.struct(F.lit(0).alias("x"), F.floor(h * 0.12).cast("int").alias("y"), F.floor(w * 0.30).cast("int").alias("w"), (F.floor(h * 0.88) - F.floor(h * 0.12)).cast("int").alias("h"))
    )
