"""Bands, nodata masks and stretches over array columns.

A tile's pixels are ``bands`` array<array<float>>, each band row-major, and
``mask`` array<boolean>, true where there is no data, or null.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.errors import BandError

#: Band numbers, from 1, of the named choices.
PRESETS = {"rgb": (1, 2, 3), "naip_rgb": (1, 2, 3), "sentinel2_rgb": (4, 3, 2), "worldview_rgb": (5, 3, 2)}
MODES = ("percentile", "minmax", "none")


def band_numbers(bands: str | list[int] | tuple[int, ...]) -> list[int]:
    """Band numbers, from 1, of a preset's name or a list."""
    if isinstance(bands, str):
        if bands not in PRESETS:
            raise BandError(f"no band preset {bands!r}; there are {', '.join(PRESETS)}", bands=bands)
        return list(PRESETS[bands])
    own = list(bands)
    if not own or any(isinstance(b, bool) or not isinstance(b, int) or b < 1 for b in own):
        raise BandError(f"bands must be numbers from 1 on: {bands!r}", bands=bands)
    return own


def clamp_bands(numbers: list[int], count: int) -> list[int]:
    """Numbers beyond the raster's bands become its last; warns where that changes a raster of several bands."""
    own = [min(n, count) for n in numbers]
    if own != numbers and count > 1:
        warnings.warn(f"bands {numbers} reach beyond {count} bands; {own} are used", RuntimeWarning, stacklevel=2)
    return own


def clamped(numbers: Column, count: Column) -> Column:
    return F.transform(numbers, lambda n: F.least(n, count))


def read_order(numbers: Column) -> Column:
    """The bands to read: each once, in the file's order."""
    return F.array_sort(F.array_distinct(numbers))


def select_bands(bands: Column, read: Column, numbers: Column) -> Column:
    """``numbers`` out of ``bands``, which hold the bands ``read``; one band alone stands for all."""
    return F.when(F.size(bands) == 1, F.transform(numbers, lambda n: F.get(bands, F.lit(0)))).otherwise(
        F.transform(numbers, lambda n: F.get(bands, F.array_position(read, n).cast("int") - 1))
    )


def alpha_mask(bands: Column, wanted: Column) -> Column:
    """True where the fourth of exactly four bands is 0 and three are wanted; else null."""
    return F.when((F.size(bands) == 4) & (F.size(wanted) == 3), F.transform(F.get(bands, F.lit(3)), lambda v: v == 0))


def nodata_mask(bands: Column, nodata: Column) -> Column:
    """True where every band has the nodata value; null without one."""
    n = F.size(F.get(bands, F.lit(0)))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.forall(bands, lambda b: F.get(b, i) == nodata))
    return F.when(nodata.isNotNull() & (n > 0), at)


def nodata_fraction(mask: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(mask, lambda m: m)), F.size(mask)), F.lit(0.0))


def masked_mean(band: Column, mask: Column) -> Column:
    """Mean of the pixels that have data; 0 without any."""
    kept = F.filter(F.zip_with(band, mask, lambda v, m: F.when(~m, v.cast("double"))), lambda v: v.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, v: s + v), F.size(kept)), F.lit(0.0))


def fill_nodata(bands: Column, mask: Column, whole_numbers: bool = False) -> Column:
    """Each band's masked pixels become its mean; for integer rasters the mean is truncated."""

    def fill(band: Column) -> Column:
        mean = masked_mean(band, mask)
        mean = F.when(mean < 0, F.ceil(mean)).otherwise(F.floor(mean)).cast("double") if whole_numbers else mean
        # the mean is bound once, or it would be worked out again at each pixel
        return F.get(F.transform(F.array(mean), lambda m: F.zip_with(band, mask, lambda v, x: F.when(x, m).otherwise(v))), F.lit(0))

    return F.when(mask.isNull(), bands).otherwise(F.transform(bands, fill))


def stretched(value: Column, vmin: Column, vmax: Column) -> Column:
    """``value`` between vmin and vmax as 0 to 1, clipped; 0 where they are equal."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - vmin, vmax - vmin)))
    return F.when(vmax == vmin, F.lit(0.0)).when(value.isNotNull(), share)  # least and greatest pass over nulls


def stretch_bands(bands: Column, vmin: Column, vmax: Column) -> Column:
    """Every band by its own entry of the arrays vmin and vmax; where there are fewer, the last one counts on."""

    def own(limits: Column, i: Column) -> Column:
        return F.get(limits, F.least(i, F.size(limits) - 1))

    return F.transform(bands, lambda b, i: F.transform(b, lambda v: stretched(v, own(vmin, i), own(vmax, i))))


def to_byte(value: Column) -> Column:
    """0 to 1 as 0 to 255, truncated."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 255).cast("int")
