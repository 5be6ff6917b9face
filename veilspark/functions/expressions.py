"""Column expressions shared by the techniques, the risk measures and the reports.

Everything here is a native expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPRESSED = "*"

# Technique name -> initial used in solution names.
INITIALS = {"sup": "S", "topbot": "T", "noise": "N", "round": "R", "globalrec": "G"}

# Learner code -> display name.
MODEL_NAMES = {
    "Bag": "Bagging",
    "RF": "Random Forest",
    "NN": "Neural Network",
    "XGB": "XGBoost",
    "LogR": "Logistic Regression",
}


def round_to_base(col: Column, base: float) -> Column:
    """Nearest multiple of ``base``, halves to the even multiple.

    ``rint(-0.5)`` is ``-0.0``; adding 0.0 turns it into plain zero.
    """
    b = F.lit(float(base))
    return F.rint(col.cast("double") / b) * b + F.lit(0.0)


def bin_left_edge(col: Column, low: int, width: int) -> Column:
    """Left edge of the right-closed bin of ``width`` that starts at ``low``.

    The lowest edge belongs to the first bin; null stays null. Integer arithmetic only,
    so values beyond 2^53 keep their exact bin.
    """
    beyond = col - F.lit(low) - F.lit(1)
    return F.when(col <= F.lit(low), F.lit(low)).when(
        col > F.lit(low), F.lit(low) + beyond - F.pmod(beyond, F.lit(width))
    )


def hash_uniform(seed: str, *keys: Column) -> Column:
    """Uniform number in (-0.5, 0.5) that depends on nothing but seed and keys.

    Unlike ``rand(seed)`` it does not change with partitioning, and a task that is
    run again after an executor loss draws the same value.
    """
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    head = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (head.cast("double") + 0.5) / F.lit(float(2**52)) - 0.5


def missing_if_nan(value: Column) -> Column:
    """A double, with null for not-a-number."""
    return F.when(~F.isnan(value), value)


def laplace_noise(u: Column, scale: Column) -> Column:
    """Laplace draw with the given scale from a uniform in (-0.5, 0.5)."""
    return -scale * F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))


def numeric_similarity(a: Column, b: Column, scale: float = 1.0, integer: bool = False) -> Column:
    """Linear similarity: 1 at equality, 0 from a distance of ``2 * scale`` on.

    Whole numbers are subtracted as such; a distance beyond 64 bits is none that is similar.
    """
    apart = F.coalesce(F.try_subtract(a, b).cast("double"), F.when(a.isNotNull() & b.isNotNull(), float("inf"))) if integer else a - b
    score = F.greatest(F.lit(0.0), 1.0 - F.abs(apart) / F.lit(2.0 * scale))
    return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))


def text_similarity(
    a: Column, b: Column, threshold: float = 0.9, worth: Column | None = None
) -> Column:
    """1 where the normalised edit similarity reaches ``threshold``, else 0.

    Below ``1 / (1 - threshold)`` characters a single edit already fails, so short
    texts are compared for equality only. Missing or empty on both sides counts 0. The
    edit distance is computed only where ``worth`` holds; elsewhere it counts 0.
    """
    longest = F.greatest(F.length(a), F.length(b))
    shortest_editable = int(round(1.0 / (1.0 - threshold)))
    edits = F.levenshtein(a, b) / longest.cast("double")
    skipped = longest < shortest_editable
    if worth is not None:
        skipped = skipped | ~worth
    return (
        F.when(a.isNull() | b.isNull() | (longest == 0), 0.0)
        .when(a == b, 1.0)
        .when(skipped, 0.0)
        .when(1.0 - edits >= threshold, 1.0)
        .otherwise(0.0)
    )


def relative_error(original: Column, protected: Column, absolute: bool = False) -> Column:
    """``|protected - original| / original``; null where the original is zero.

    ``absolute=True`` divides by the magnitude of the original instead.
    """
    base = F.abs(original) if absolute else original
    return F.try_divide(F.abs(protected - original).cast("double"), base.cast("double"))


def percentage_difference(value: Column, baseline: Column) -> Column:
    """``100 * (value - baseline) / baseline``; null for a zero baseline."""
    return F.try_divide(100.0 * (value - baseline), baseline)


def absolute_percentage_difference(value: Column, baseline: Column) -> Column:
    """``100 * |value - baseline| / baseline``; null for a zero baseline."""
    return F.try_divide(100.0 * F.abs(value - baseline), baseline)


def technique_initials(techniques: Column | str) -> Column:
    """Map an array of technique names to their initials, in the same order."""
    techniques = F.col(techniques) if isinstance(techniques, str) else techniques
    lookup = F.create_map(*[F.lit(x) for pair in INITIALS.items() for x in pair])
    return F.transform(techniques, lambda t: F.coalesce(lookup[t], t))


def solution_name(techniques: Column) -> Column:
    """Canonical name of a combination: sorted members joined by ``', '``."""
    return F.array_join(F.array_sort(techniques), ", ")


def compact_solution(name: Column) -> Column:
    """``'G, N'`` -> ``'GN'``."""
    return F.replace(name, F.lit(", "), F.lit(""))


def dataset_number(name: Column) -> Column:
    """Number of the original dataset in names such as ``ds12_transf3``."""
    return F.regexp_extract(F.split(name, "_")[0], "[0-9]+", 0).cast("int")


def display_model(code: Column) -> Column:
    """Learner code to display name; unknown codes stay as they are."""
    lookup = F.create_map(*[F.lit(x) for pair in MODEL_NAMES.items() for x in pair])
    return F.coalesce(lookup[code], code)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform in (-0.5, 0.5), by inversion."""
    p = u + 0.5
    # Cumulative probabilities of Poisson(1) for 0, 1, 2, ... 8.
    cumulative = (
        0.36787944117144233,
        0.7357588823428847,
        0.9196986029286058,
        0.9810118431238462,
        0.9963401531726563,
        0.9994058151824183,
        0.999916758850712,
        0.9999897508033253,
        0.999998874797402,
    )
    count = F.when(p < cumulative[0], 0)
    for k, edge in enumerate(cumulative[1:], start=1):
        count = count.when(p < edge, k)
    return count.otherwise(len(cumulative)).cast("bigint")
