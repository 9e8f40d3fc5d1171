"""Column -> Column helpers. All stay inside code generation; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap(x, box) -> Column:
    """Coordinate moved into [0, box)."""
    x, box = col(x), box if isinstance(box, Column) else F.lit(float(box))
    return x - box * F.floor(x / box)


def minimum_image(delta, box) -> Column:
    """Shortest periodic displacement; half-way cases go to the even image."""
    delta, box = col(delta), box if isinstance(box, Column) else F.lit(float(box))
    return delta - box * F.rint(delta / box)


def nearest_image(x, reference, box) -> Column:
    """``x`` moved to the image in [reference - box/2, reference + box/2)."""
    x, reference = col(x), col(reference)
    box = box if isinstance(box, Column) else F.lit(float(box))
    d = x - reference
    return reference + d - box * F.floor(d / box + F.lit(0.5))


def norm(*deltas: Column) -> Column:
    total = deltas[0] * deltas[0]
    for d in deltas[1:]:
        total = total + d * d
    return F.sqrt(total)


def base_pair_index(i, n) -> Column:
    """Position along a two-strand molecule whose second strand runs backwards."""
    i, n = col(i), n if isinstance(n, Column) else F.lit(n)
    return F.least(i, n - F.lit(1) - i)


def int_div(x, width: int) -> Column:
    """``x // width`` for non-negative integers, as a long."""
    return F.floor(col(x) / F.lit(width)).cast("long")


def cut_index(x, cuts: Sequence[float]) -> Column:
    """Number of cut points that are <= x (a bucket index for ordered cuts)."""
    x = col(x)
    out = F.lit(0)
    for cut in cuts:
        out = out + F.when(x >= F.lit(cut), 1).otherwise(0)
    return out


def radial_bin(distance, high: float = C.HISTOGRAM_MAX_NM, bins: int = C.HISTOGRAM_BINS) -> Column:
    """One-based bin of [0, high) in equal widths; everything from ``high`` on falls into bin ``bins + 1``."""
    return F.width_bucket(col(distance), F.lit(0.0), F.lit(float(high)), F.lit(bins)).cast("long")


def ratio(numerator, denominator) -> Column:
    """Division that is missing, not infinite, when the denominator is zero."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(d != 0, n / d)


def close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = col(a), b if isinstance(b, Column) else F.lit(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def null_if_nan(c) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def production_block(frame) -> Column:
    return int_div(col(frame) - F.lit(1), C.FRAMES_PER_BLOCK)


def time_us(frame) -> Column:
    return col(frame) * F.lit(C.US_PER_FRAME)


def species_code(name) -> Column:
    pairs = [F.lit(v) for kv in C.SPECIES_CODE.items() for v in kv]
    return F.create_map(*pairs)[col(name)]


def residue_charge(name) -> Column:
    pairs = [F.lit(v) for kv in C.RESIDUE_CHARGE.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[col(name)], F.lit(0.0))


def reverse_complement(sequence) -> Column:
    return F.reverse(F.translate(col(sequence), "ATCG", "TAGC"))


def task_key(replicate="replicate", system="system") -> Column:
    return F.concat_ws("__", col(replicate), col(system))


def has_tag(tags, tag: str) -> Column:
    return F.array_contains(F.split(col(tags), ","), tag)


def pair_count(n) -> Column:
    """Unordered pairs among n nodes."""
    n = col(n).cast("double")
    return n * (n - F.lit(1.0)) / F.lit(2.0)


def inclusion_basis(available, explicit, included) -> Column:
    """Ordered labelling rules: the first one that holds wins."""
    return (
        F.when(~col(available), "unavailable")
        .when(col(explicit), "explicit_third_repeat")
        .when(col(included), "standard")
        .otherwise("excluded")
    )


def expected_partners(p_same, n_same, p_cross, n_cross) -> Column:
    """Mean partners of one chain from pair probabilities; missing when its species is absent."""
    n_same, n_cross = col(n_same), col(n_cross)
    value = F.coalesce(col(p_same), F.lit(0.0)) * (n_same - 1) + F.coalesce(col(p_cross), F.lit(0.0)) * n_cross
    return F.when(n_same > 0, value)


def cross_partners(p_cross, n_cross) -> Column:
    """Partners of another species: zero, not missing, when that species is absent."""
    n_cross = col(n_cross)
    return F.when(n_cross == 0, F.lit(0.0)).otherwise(col(p_cross) * n_cross)


def millimolar(count, box_nm) -> Column:
    litres = F.pow(col(box_nm), F.lit(3.0)) * F.lit(1e-24)
    return col(count) / F.lit(C.AVOGADRO) / litres * F.lit(1e3)


def fixed_box_nm(residues) -> Column:
    """Box edge that keeps the residue concentration of the composition series."""
    return F.lit(C.BASE_BOX_NM) * F.cbrt(col(residues) / F.lit(float(C.BASE_BOX_RESIDUES)))


def per_hundred(count, residues) -> Column:
    return F.when(col(residues) > 0, col(count) * F.lit(100.0) / col(residues))


def undo_fragments(value, side, fragments) -> Column:
    """Profile per chain -> profile per residue copy: only the fragmented species is rescaled."""
    return F.when(col(side) == "MED1", col(value) * col(fragments)).otherwise(col(value))


def odds_ratio(a, b, c, d) -> Column:
    """(a/b)/(c/d); if any cell is zero, one half is added to all four."""
    a, b, c, d = (col(v).cast("double") for v in (a, b, c, d))
    plus = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), F.lit(0.5)).otherwise(F.lit(0.0))
    return ((a + plus) / (b + plus)) / ((c + plus) / (d + plus))
