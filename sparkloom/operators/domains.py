"""Value-set predicates: what a scan may be asked to keep, as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Range:
    """An interval; None is unbounded."""

    low: object = None
    high: object = None
    low_inclusive: bool = True
    high_inclusive: bool = True

    def column(self, c: Column) -> Column:
        parts = []
        if self.low is not None:
            parts.append(c >= self.low if self.low_inclusive else c > self.low)
        if self.high is not None:
            parts.append(c <= self.high if self.high_inclusive else c < self.high)
        out = F.lit(True) if not parts else parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass
class Domain:
    """Values of a column: single ``values`` (kept, or left out if not
    ``inclusive``), ``ranges``, or ``all`` or none; and whether NULL belongs."""

    values: list = field(default_factory=list)
    inclusive: bool = True
    ranges: list[Range] | None = None
    all: bool | None = None
    null_allowed: bool = False


def domain_to_column(name: str, domain: Domain) -> Column:
    c = F.col(name)
    if domain.all is not None:
        if domain.all:
            return F.lit(True) if domain.null_allowed else c.isNotNull()
        return c.isNull() if domain.null_allowed else F.lit(False)
    if domain.ranges is not None:
        keep = F.lit(False)
        for k, r in enumerate(domain.ranges):
            keep = r.column(c) if k == 0 else keep | r.column(c)
    elif domain.inclusive:
        keep = c.isin(domain.values) if domain.values else F.lit(False)
    else:
        keep = ~c.isin(domain.values) if domain.values else F.lit(True)
    return keep | c.isNull() if domain.null_allowed else keep & c.isNotNull()


def tuple_domain_to_column(domains: dict[str, Domain] | None) -> Column:
    """A conjunction over columns; None keeps no row at all."""
    if domains is None:
        return F.lit(False)
    out = F.lit(True)
    for k, (name, domain) in enumerate(domains.items()):
        out = domain_to_column(name, domain) if k == 0 else out & domain_to_column(name, domain)
    return out
