"""Missing amounts solved from algebraic identities.

    tenure  = ceil(charges / monthly)       charges      = tenure * monthly
    tenure  = ceil(distance / distance_avg) distance     = tenure * distance_avg
    revenue = charges - refunds + extra + distance
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcascade.functions import ceil_quotient, quotient

# Repeating the eleven rules until nothing is filled any more takes at most
# three passes, and of the later passes most rules can never fire. These are
# the rules that can, by position in ``identity_rules``. A test enumerates all
# 256 patterns of missing values with any of the three divisors zero. So no
# data scan is needed to detect convergence, and the generated code stays below
# the size from which the JVM no longer compiles a method.
PASSES = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10),
    (0, 1, 2, 3, 5, 6, 8, 9),
    (2,),
)


@dataclass(frozen=True)
class BillingColumns:
    tenure: str = "Tenure in Months"
    charges: str = "Total Charges"
    monthly: str = "Monthly Charge"
    distance: str = "Total Long Distance Charges"
    distance_avg: str = "Avg Monthly Long Distance Charges"
    refunds: str = "Total Refunds"
    extra: str = "Total Extra Data Charges"
    revenue: str = "Total Revenue"

    def names(self) -> list[str]:
        return list(astuple(self))


def identity_rules(c: BillingColumns) -> list[tuple[str, Column]]:
    """(target, value) in the order in which a pass applies them."""

    def v(name: str) -> Column:
        return F.col(f"`{name}`")

    return [
        (c.tenure, ceil_quotient(v(c.charges), v(c.monthly))),
        (c.charges, v(c.tenure) * v(c.monthly)),
        (c.monthly, quotient(v(c.charges), v(c.tenure))),
        (c.tenure, ceil_quotient(v(c.distance), v(c.distance_avg))),
        (c.distance, v(c.tenure) * v(c.distance_avg)),
        (c.distance_avg, quotient(v(c.distance), v(c.tenure))),
        (c.revenue, v(c.charges) - v(c.refunds) + v(c.extra) + v(c.distance)),
        (c.charges, v(c.revenue) + v(c.refunds) - v(c.extra) - v(c.distance)),
        (c.refunds, v(c.charges) + v(c.extra) + v(c.distance) - v(c.revenue)),
        (c.extra, v(c.revenue) - v(c.charges) + v(c.refunds) - v(c.distance)),
        (c.distance, v(c.revenue) - v(c.charges) + v(c.refunds) - v(c.extra)),
    ]


def solve_identities(df: DataFrame, c: BillingColumns) -> DataFrame:
    """Fill what the identities determine; row-local, so no shuffle and no action."""
    order = df.columns
    rules = identity_rules(c)
    df = df.withColumns({n: F.col(f"`{n}`").cast("double") for n in c.names()})
    for active in PASSES:
        for i in active:
            target, value = rules[i]
            df = df.withColumn(target, F.coalesce(F.col(f"`{target}`"), value))
    return df.select(*[F.col(f"`{n}`") for n in order])
