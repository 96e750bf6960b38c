"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    A column used several times inside a higher-order lambda (or along a
    chain of rewrites) would otherwise be recomputed per use; binding it
    through a one-element ``transform`` evaluates it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sum(arr: Column, passes: int = 31) -> Column:
    """Inclusive prefix sums of a numeric array in O(n log n).

    Hillis-Steele scan: pass k adds the element 2^k positions back. 31
    passes cover every array; those beyond its size leave it as it is."""
    def shifted_add(step):
        # a one-parameter lambda: PySpark reads the arity to pick the
        # (element) or (element, index) form
        return lambda a: F.when(F.size(a) <= step, a).otherwise(F.transform(
            a, lambda x, i: F.when(i >= step, x + F.element_at(a, i - step + 1)).otherwise(x)))

    out = arr
    for k in range(passes):
        out = let(out, shifted_add(1 << k))
    return out
