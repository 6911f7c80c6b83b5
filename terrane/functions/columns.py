"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gas constant in kJ/(mol K) (fixed value).
R = 0.008314462618


def bin_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Index of x among n equal bins over [lo, hi], by comparison with the edges lo + i*step, the last edge included; null outside.

    A division alone puts values that lie on edges into the wrong bin. A range of no width is widened by one half on both sides.
    """
    flat = lo == hi
    lo, hi = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    step = (hi - lo) / n
    i = F.floor((x - lo) / step)
    i = i - F.when(x < lo + i * step, 1).otherwise(0) + F.when(x >= lo + (i + 1) * step, 1).otherwise(0)
    return F.when((x >= lo) & (x <= hi), F.least(i, F.lit(n - 1)).cast("int"))


def bin_center(i: Column, lo: Column, hi: Column, n: int) -> Column:
    flat = lo == hi
    lo, hi = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    return lo + (i + 0.5) * ((hi - lo) / n)


def free_energy(p: Column, p_max: Column, temperature: float = 300.0) -> Column:
    """-RT ln(p / p_max), null where nothing was sampled."""
    return F.when(p > 0, -R * temperature * F.log(p / p_max))


def wrapped(difference: Column, period: float) -> Column:
    """A periodic difference brought into half a period around zero; halves round to even."""
    return difference - period * F.rint(difference / period)


def harmonic(x: Column, center: Column, kappa: Column, period: float | None = None) -> Column:
    d = x - center
    d = d if period is None else wrapped(d, period)
    return 0.5 * kappa * d * d


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def slug(label: Column) -> Column:
    """A label as part of a file name: a leading word State in small letters, blanks as underscores, nothing else but letters, digits, dots, underscores and hyphens."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(label), r"^State\b", "state"), r"\s+", "_"), r"[^A-Za-z0-9_.-]", "")
    return F.when(plain == "", "state").otherwise(plain)


def band(x: Column) -> Column:
    """Wording for a subspace overlap or a cosine content."""
    return F.when(x >= 0.7, "high").when(x >= 0.5, "moderate").otherwise("low")


def counter_uniform(n: Column, *parts: Column) -> Column:
    """A uniform integer in [0, n) from a hash of the parts: the same in any engine, partition and retry."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("bigint") % n


def frames_in_window(start: Column, stop: Column, dt: Column, stride: int = 1) -> Column:
    """How many frames of spacing dt lie in a window, both ends counted, after striding; one at least."""
    whole = F.floor((stop - start) / dt + 1e-9) + 1
    return F.greatest(F.lit(1), F.floor(whole / stride)).cast("long")


def checked_weight(w: Column) -> Column:
    """A weight as it is; an error for one that is null, not a number, infinite or negative."""
    x = w.cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    return F.when(good, x).otherwise(F.raise_error(F.concat(F.lit("not a weight: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("double"))


def bin_label(state: Column, basin: Column, occupied: Column) -> Column:
    """What a cell is called: its state, `minor` for a basin without one, nothing where nothing was sampled."""
    return F.when(~occupied | basin.isNull() | (basin == 0), F.lit("")).otherwise(F.coalesce(state, F.lit("minor")))


def insignificant(difference: Column, sd: Column, times: float = 2.0) -> Column:
    """Differences that lie within so many standard deviations of 0."""
    return F.abs(difference) < times * sd


def sentence(n_states: Column, top: Column, share: Column, rmsip: Column, cosine: Column) -> Column:
    """An interpretation in words of a landscape and of how well it was sampled."""
    return F.format_string("%d major states; %s holds %.1f %% of the frames. Overlap between halves is %s and cosine content is %s.", n_states.cast("int"), top, 100.0 * share, band(rmsip), band(cosine))
