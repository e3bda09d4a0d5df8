"""Rounding and percentages."""


def literal(value: float) -> str:
    return f"{float(value)!r}D"


def round2(x: str) -> str:
    """Two decimals, half to even after scaling."""
    return f"(rint(({x}) * 100) / 100)"


def hundredths(x: str) -> str:
    """A two-decimal double as a whole number, so that sums do not depend on row order."""
    return f"cast(rint(({x}) * 100) as bigint)"


def ratio_percent(part: str, whole: str) -> str:
    """``part / whole * 100``; null when there is nothing to divide by."""
    return f"(try_divide({part}, {whole}) * 100)"


def percent(part: str, whole: str) -> str:
    """Rounded percentage, 0 where the whole is 0 or null."""
    return round2(f"coalesce({ratio_percent(part, whole)}, 0D)")


def order_free_mean(score: str) -> str:
    """Aggregate: mean of scores up to 100 that is the same for every order and partitioning.

    The scores are added as whole multiples of 2 ** -50, which a double from 4 upwards is exactly.
    The exact sum is divided as a decimal, so repeating every row does not change the mean.
    """
    units = f"cast(cast(rint(({score}) * {2**50}D) as bigint) as decimal(20, 0))"
    exact = f"try_divide(sum({units}), cast(count({score}) as decimal(18, 0)))"
    return f"(cast({exact} as double) / {2**50}D)"


def round2_by_value(x: str) -> str:
    """Two decimals of the double's exact binary value, as printf's ``%.2f`` gives.

    ``x * 100`` may land on a tie although ``x`` is not one. The lost low part of the product
    (error-free transformation: split ``x`` into halves of 26 bits) tells which side it was on.
    """
    product = f"(({x}) * 100)"
    scaled = f"(({x}) * 134217729D)"  # 2**27 + 1
    high = f"({scaled} - ({scaled} - ({x})))"
    lost = f"(({high} * 100 - {product}) + (({x}) - {high}) * 100)"
    return (
        f"(case when {product} - floor({product}) <> 0.5D or {lost} = 0 then rint({product})"
        f" when {lost} > 0 then cast(ceil({product}) as double)"
        f" else cast(floor({product}) as double) end / 100)"
    )
