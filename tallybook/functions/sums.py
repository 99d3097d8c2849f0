"""Exact sums of money, whatever decimal or integer type the amounts have.

An amount is a whole number of units, a unit being its last digit. It is split into limbs, small
whole numbers that are summed as ``bigint``, and the sums of the limbs are put together again, on a few
rows. So a fact is aggregated in fixed-width buffers on the map side, and no sum passes through a type
that could round it.

Amounts of up to ``SHORT_DIGITS`` digits go through a double, which rounds to the right unit, and have
two limbs by bits: their sums hold for 2**38 of the largest amounts. Longer ones have a limb for each
``LIMB_DIGITS`` digits: their sums hold for 2**43. A sum that does not fit fails the query, whether or
not the session runs in ANSI mode: ``try_sum`` gives NULL then, which a count of the amounts tells from
the NULL of a sum over nothing.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT_DIGITS = 15
LOW_BITS = 25
LIMB_DIGITS = 6
OVERFLOW = "sum of {} is out of range"


@dataclass(frozen=True)
class Money:
    """Digits before and after the point that the amounts of a table need."""

    whole: int = 13
    scale: int = 2

    @property
    def total_type(self) -> str:
        """The type of sums: as many digits as a decimal holds."""
        return f"decimal(38,{self.scale})"

    @property
    def is_short(self) -> bool:
        return self.whole + self.scale <= SHORT_DIGITS

    @property
    def limbs(self) -> int:
        return 2 if self.is_short else -(-(self.whole + self.scale) // LIMB_DIGITS)

    @property
    def base(self) -> int:
        return 2**LOW_BITS if self.is_short else 10**LIMB_DIGITS

    def parts(self, amount: str) -> list[str]:
        """What the limbs are computed from: whole units, or the limbs themselves, lowest first."""
        if self.is_short:
            return [f"cast(rint(cast({amount} as double) * 1e{self.scale}D) as bigint)"]
        parts = []
        for k in range(self.limbs):
            rest = amount
            if k + 1 < self.limbs:
                rest = f"({amount} % {_power_of_ten(LIMB_DIGITS * (k + 1) - self.scale)})"
            parts.append(f"({rest} div {_power_of_ten(LIMB_DIGITS * k - self.scale)})")
        return parts

    def split(self, parts: list[str]) -> list[str]:
        """The limbs, lowest first, of what ``parts`` gave."""
        if not self.is_short:
            return parts
        (units,) = parts
        return [f"{units} & {2**LOW_BITS - 1}", f"shiftright({units}, {LOW_BITS})"]


def _power_of_ten(exponent: int) -> str:
    digits = "1" + "0" * exponent if exponent >= 0 else "0." + "0" * (-exponent - 1) + "1"
    return f"{digits}BD"


def in_limbs(
    frame: DataFrame,
    keys: Iterable[str],
    money: Money,
    amounts: Mapping[str, str],
    differences: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """``keys`` and the limbs of each figure.

    ``amounts`` gives figures by their expressions, ``differences`` those that are the difference of
    two others, row by row.
    """
    differences = differences or {}
    parts = {f: money.parts(amount) for f, amount in amounts.items()}
    for figure, (a, b) in differences.items():
        parts[figure] = [f"{a}_part_{k} - {b}_part_{k}" for k in range(len(parts[a]))]
    computed = [f"{p} as {f}_part_{k}" for f, own in parts.items() for k, p in enumerate(own)]
    split = [
        f"{limb} as {f}_{k}"
        for f, own in parts.items()
        for k, limb in enumerate(money.split([f"{f}_part_{i}" for i in range(len(own))]))
    ]
    rows = [f"if({f}_part_0 is null, 0L, 1L) as {f}_rows" for f in parts]
    return frame.selectExpr(*keys, *computed, *split, *rows)


def summed(
    limbs: DataFrame,
    keys: Collection[str],
    money: Money,
    figures: Iterable[str],
    *others: str,
) -> DataFrame:
    """Limbs summed by ``keys``, for ``as_money`` or to be summed on; ``others`` are aggregates."""
    names = [(f, f"{f}_{k}") for f in figures for k in range(money.limbs)]
    counts = [f"{f}_rows" for f in dict.fromkeys(f for f, _ in names)]
    sums = limbs.groupBy(*keys).agg(
        *(F.expr(f"try_sum({name}) as {name}") for _, name in names),
        *(F.expr(f"sum({name}) as {name}") for name in counts),
        *map(F.expr, others),
    )

    def checked(figure: str, name: str) -> str:
        failed = f"raise_error('{OVERFLOW.format(figure)}')"
        return f"if({figure}_rows > 0 and {name} is null, {failed}, {name}) as {name}"

    kept = [c for c in sums.columns if c not in {name for _, name in names}]
    return sums.selectExpr(*kept, *(checked(f, name) for f, name in names))


def as_money(
    limbs: DataFrame, keys: Iterable[str], money: Money, figures: Iterable[str]
) -> DataFrame:
    """``keys`` and the figures, put together from their summed limbs."""

    def together(figure: str) -> str:
        units = f"cast({figure}_{money.limbs - 1} as decimal(38,0))"
        for k in reversed(range(money.limbs - 1)):
            units = f"({units} * {money.base}BD + {figure}_{k})"
        failed = f"raise_error('{OVERFLOW.format(figure)}')"
        # By way of text, as multiplying by a fraction could cost digits.
        amount = f"cast(concat(cast({units} as string), 'E-{money.scale}') as {money.total_type})"
        return f"if({figure}_rows > 0, coalesce({amount}, {failed}), null) as {figure}"

    return limbs.selectExpr(*keys, *map(together, figures))
