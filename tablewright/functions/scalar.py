"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


#: All texts that a cast to double takes, but for such as it reads as NaN.
NUMBER_TEXT = (r"(?i)\A[\x00-\x20]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[fd]?"
               r"|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[fd]?|inf(?:inity)?)[\x00-\x20]*\z")


def parse_number(column: Column, data_type: T.DataType | None = None) -> Column:
    """The value as a double, NULL when it does not parse or is NaN; the type spares needless checks.

    A text is cast only if it looks like a number: a cast that fails costs as much as fifty that do not.
    """
    if isinstance(data_type, T.IntegralType):
        return column.cast("double")
    number = column.try_cast("double")
    if isinstance(data_type, T.StringType):
        number = F.when(column.rlike(NUMBER_TEXT), number)
    return F.nanvl(number, F.lit(None).cast("double"))


def double_array(values: list[float]) -> Column:
    """A constant array in one literal, however long."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def is_missing(column: Column, data_type: T.DataType) -> Column:
    """True for NULL, and for NaN in floating columns."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def text_of(column: Column, data_type: T.DataType) -> Column:
    """The text used as a category."""
    return column if isinstance(data_type, T.StringType) else column.cast("string")


def divide(top: Column, bottom: Column) -> Column:
    """Division in doubles that gives NULL on a zero divisor."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def round_to(column: Column, places: int) -> Column:
    """Round and drop the sign of a negative zero."""
    return F.round(column.cast("double"), places) + F.lit(0.0)


def yeo_johnson(column: Column, power: float) -> Column:
    """The Yeo-Johnson power transform for a fixed power (Yeo and Johnson, 2000)."""
    x = column.cast("double")
    right = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(float(power))) - 1) / power
    mirrored = 2.0 - power
    left = -F.log1p(-x) if mirrored == 0 else -(F.pow(1 - x, F.lit(mirrored)) - 1) / mirrored
    return F.when(x >= 0, right).otherwise(left)


# Coefficients of algorithm AS 241 (Wichura, 1988), constant term first.
CENTRE_TOP = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
              45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
CENTRE_BOTTOM = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
                 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
NEAR_TOP = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
            1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4)
NEAR_BOTTOM = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
               0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
FAR_TOP = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
           0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
FAR_BOTTOM = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
              7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda total, c: total * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_quantile(column: Column) -> Column:
    """The inverse of the standard normal distribution function, for 0 < p < 1."""
    p = column.cast("double")
    q = p - 0.5
    inner = F.lit(0.180625) - q * q
    centre = q * polynomial(inner, CENTRE_TOP) / polynomial(inner, CENTRE_BOTTOM)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    near = polynomial(r - 1.6, NEAR_TOP) / polynomial(r - 1.6, NEAR_BOTTOM)
    far = polynomial(r - 5.0, FAR_TOP) / polynomial(r - 5.0, FAR_BOTTOM)
    tail = F.when(r <= 5, near).otherwise(far)
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)
