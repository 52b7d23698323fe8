"""Feature-store transforms: cleaning rules bound to feature names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.payload import WHITESPACE, strip, text_to_double
from tidemill.functions.scalars import NUMBERS

Transform = Callable[[Column, str], Column]


def missing(value: Column, kind: str) -> Column:
    """Null or blank text."""
    if kind == "string":
        return value.isNull() | (strip(value) == "")
    return value.isNull()


def _as_double(value: Column, kind: str) -> Column:
    return text_to_double(value) if kind == "string" else value.cast("double")


@dataclass(frozen=True)
class Numeric:
    """Clip to bounds and scale to [0, 1].

    A missing value becomes the default and then takes the same path; text
    that is no number becomes the default as it stands.
    """

    low: float | None = None
    high: float | None = None
    normalize: bool = False
    clip: bool = True
    fill: bool = True
    default: float = 0.0

    def __call__(self, value: Column, kind: str) -> Column:
        gap = missing(value, kind)
        given = _as_double(value, kind)
        broken = ~gap & given.isNull()
        number = F.when(gap, F.lit(self.default if self.fill else None).cast("double")).otherwise(given)
        if self.clip:
            # Spark orders NaN above every number; Python keeps NaN on clipping.
            if self.low is not None:
                number = F.when(number < self.low, F.lit(float(self.low))).otherwise(number)
            if self.high is not None:
                number = F.when(
                    (number > self.high) & ~F.isnan(number), F.lit(float(self.high))
                ).otherwise(number)
        if self.normalize and self.low is not None and self.high is not None and self.high > self.low:
            number = (number - self.low) / (self.high - self.low)
        fallback = F.lit(self.default if self.fill else None).cast("double")
        return F.when(broken, fallback).otherwise(number)


@dataclass(frozen=True)
class Categorical:
    """Strip, fold case, check against a list, and optionally encode.

    The published form looks codes up by the list's own spelling, so a list
    with capitals maps to the default code; ``exact_keys`` keeps that.
    """

    valid: tuple[str, ...] = ()
    case_sensitive: bool = False
    encode: bool = False
    fill: bool = True
    default: str = "unknown"
    exact_keys: bool = False

    def codes(self) -> dict[str, int]:
        fold = (lambda s: s) if self.case_sensitive or self.exact_keys else str.lower
        table = {fold(name): i for i, name in enumerate(self.valid)}
        table.setdefault(self.default, len(self.valid))
        return table

    def __call__(self, value: Column, kind: str) -> Column:
        gap = missing(value, kind)
        filled = F.when(gap, F.lit(self.default if self.fill else None)).otherwise(
            value.cast("string")
        )
        text = strip(filled)
        if not self.case_sensitive:
            text = F.lower(text)
        if self.valid:
            allowed = [v if self.case_sensitive else v.lower() for v in self.valid]
            text = F.when(text.isin(*allowed), text).otherwise(
                F.lit(self.default if self.fill else None)
            )
            text = F.when(filled.isNotNull(), text)
        if not self.encode:
            return text
        table = self.codes()
        pairs = [p for name, code in table.items() for p in (F.lit(name), F.lit(code))]
        code = F.coalesce(
            F.try_element_at(F.create_map(*pairs), text), F.lit(table.get(self.default, 0))
        )
        return F.when(text.isNotNull(), code)


# Accepted date formats in the order in which they are tried.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
)


@dataclass(frozen=True)
class DateTime:
    """Read a date in one of five formats or as an epoch second.

    ``output`` is ``timestamp`` (epoch), ``iso`` or ``components``. The default
    date is an argument because a clock default would not be repeatable.
    """

    output: str = "timestamp"
    fill: bool = True
    default: str | None = None

    def __call__(self, value: Column, kind: str) -> Column:
        if kind == "string":
            parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS])
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            parsed = value.cast("timestamp")
        else:
            parsed = F.timestamp_micros((value.cast("double") * 1000000).cast("bigint"))
        if self.fill and self.default is not None:
            parsed = F.coalesce(parsed, F.lit(self.default).cast("timestamp"))
        if self.output == "iso":
            return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")
        if self.output == "components":
            return F.when(
                parsed.isNotNull(),
                F.struct(
                    F.year(parsed).alias("year"),
                    F.month(parsed).alias("month"),
                    F.dayofmonth(parsed).alias("day"),
                    F.hour(parsed).alias("hour"),
                    F.minute(parsed).alias("minute"),
                    F.second(parsed).alias("second"),
                    F.weekday(parsed).alias("weekday"),
                    F.dayofyear(parsed).alias("day_of_year"),
                ),
            )
        return F.unix_micros(parsed) / F.lit(1000000.0)


@dataclass(frozen=True)
class Boolean:
    """Words, numbers and booleans to true or false, optionally as 1 or 0.

    Text that is in neither list counts as true when it is not blank.
    """

    # Words for true and false.
    true_words: tuple[str, ...] = ("true", "yes", "1", "y", "on", "enabled")
    false_words: tuple[str, ...] = ("false", "no", "0", "n", "off", "disabled")
    numeric: bool = False
    fill: bool = True
    default: bool = False

    def __call__(self, value: Column, kind: str) -> Column:
        if kind == "boolean":
            truth = value
        elif kind == "string":
            word = F.lower(strip(value))
            truth = F.when(word.isin(*self.true_words), True).when(
                word.isin(*self.false_words), False
            ).otherwise(True)
        else:
            truth = value != 0
        truth = F.when(missing(value, kind), F.lit(self.default if self.fill else None)).otherwise(truth)
        return truth.cast("int") if self.numeric else truth


@dataclass(frozen=True)
class Text:
    """Strip, fold case, drop special characters, cut: in this order."""

    max_length: int | None = None
    lower: bool = True
    strip_space: bool = True
    plain: bool = False
    fill: bool = True
    default: str = ""

    def __call__(self, value: Column, kind: str) -> Column:
        gap = missing(value, kind)
        text = F.when(gap, F.lit(self.default if self.fill else None)).otherwise(
            value.cast("string")
        )
        if self.strip_space:
            text = F.btrim(text, F.lit(WHITESPACE))
        if self.lower:
            text = F.lower(text)
        if self.plain:
            text = F.regexp_replace(text, r"(?U)[^a-zA-Z0-9\s]", "")
        if self.max_length is not None:
            text = F.substring(text, 1, self.max_length)
        return text


@dataclass
class TransformRegistry:
    """Transforms by feature name; other features pass through."""

    transforms: dict[str, Transform] = field(default_factory=dict)

    def register(self, name: str, transform: Transform) -> "TransformRegistry":
        self.transforms[name] = transform
        return self

    def apply(self, df: DataFrame, prefix: str = "") -> DataFrame:
        kinds = dict(df.dtypes)
        columns = {
            prefix + name: transform(F.col(prefix + name), kinds[prefix + name])
            for name, transform in self.transforms.items()
            if prefix + name in kinds
        }
        return df.withColumns(columns) if columns else df


def common_transforms() -> TransformRegistry:
    """The published preset for payment features."""
    # Bounds, lists and defaults of the preset.
    return TransformRegistry(
        {
            "amount": Numeric(0, 10000, default=0.0),
            "age": Numeric(0, 120, default=30.0),
            "merchant_category": Categorical(
                ("electronics", "grocery", "gas", "restaurant", "retail", "other"), default="other"
            ),
            "payment_method": Categorical(
                ("credit", "debit", "cash", "mobile"), default="credit"
            ),
        }
    )
