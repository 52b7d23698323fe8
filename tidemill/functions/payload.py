"""Reading fields off a record, whether it arrives as JSON or as columns.

JSON payloads are parsed once into a map from key to text, which keeps the
difference between a missing key and a key holding null. Tables have no such
difference: a null cell counts as missing for text fields and as null for
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Python's spellings of numbers. The pattern keeps out Java's, such as "1.5d".
FLOAT_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
INT_TEXT = r"^[+-]?\d+$"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every Unicode kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def text_to_double(text: Column) -> Column:
    """Number from text, or null when the text is not a decimal literal."""
    clean = strip(text)
    return F.when(clean.rlike(FLOAT_TEXT), clean.try_cast("double"))


def number_sql(text: str, kind: str) -> str:
    """SQL form of reading a ``double`` or ``bigint`` from text."""
    clean = f"btrim({text}, '{WHITESPACE}')"
    pattern = FLOAT_TEXT if kind == "double" else INT_TEXT
    return f"CASE WHEN {clean} RLIKE r'{pattern}' THEN try_cast({clean} AS {kind}) END"


MAP = "map<string,string>"


class JsonRecord:
    """SQL expressions for the top-level fields of a JSON document.

    ``fields`` is a map column from key to text. The type of a value is only
    asked for where the text alone does not settle the reading; then the
    document, a VARIANT expression, is looked into.
    """

    def __init__(self, fields: str, document: str):
        self.fields = fields
        self.document = document

    def stage(self, df: DataFrame, numbers: dict[str, str]) -> DataFrame:
        """Add one column per numeric field, so that each is read once."""
        return df.selectExpr("*", *[f"{self._read(n, kind)} AS `_number_{n}`" for n, kind in numbers.items()])

    def _read(self, name: str, kind: str) -> str:
        # int() drops the fraction of a number but refuses it in text.
        text = f"btrim({self.text(name)}, '{WHITESPACE}')"
        pattern = FLOAT_TEXT if kind == "double" else INT_TEXT
        native = f"try_variant_get({self.document}, '$.{name}', 'double')"
        return (
            f"CASE WHEN {self.text(name)} IS NULL THEN NULL "
            f"WHEN {text} RLIKE r'{pattern}' THEN try_cast({text} AS {kind}) "
            f"WHEN {self.kind(name)} <> 'STRING' THEN CAST({native} AS {kind}) END"
        )

    def kind(self, name: str) -> str:
        return f"schema_of_variant(try_variant_get({self.document}, '$.{name}', 'variant'))"

    def present(self, name: str) -> str:
        return f"coalesce(map_contains_key({self.fields}, '{name}'), FALSE)"

    def is_null(self, name: str) -> str:
        return f"({self.present(name)} AND {self.text(name)} IS NULL)"

    def text(self, name: str) -> str:
        return f"{self.fields}['{name}']"

    def text_or(self, name: str, default: str) -> str:
        return f"coalesce({self.text(name)}, IF({self.present(name)}, NULL, '{default}'))"

    def number(self, name: str) -> str:
        return f"`_number_{name}`"


class TableRecord:
    """SQL expressions for the fields of a frame that is already columnar."""

    def __init__(self, df: DataFrame, numbers: dict[str, str] | None = None):
        self.types = dict(df.dtypes)
        self.numbers = numbers or {}

    def present(self, name: str) -> str:
        return "TRUE" if name in self.types else "FALSE"

    def is_null(self, name: str) -> str:
        return f"`{name}` IS NULL" if name in self.types else "FALSE"

    def text(self, name: str) -> str:
        return f"CAST(`{name}` AS STRING)" if name in self.types else "CAST(NULL AS STRING)"

    def text_or(self, name: str, default: str) -> str:
        return f"coalesce({self.text(name)}, '{default}')"

    def number(self, name: str) -> str:
        kind = self.numbers.get(name, "double")
        if name not in self.types:
            return f"CAST(NULL AS {kind})"
        if self.types[name] == "string":
            return number_sql(f"`{name}`", kind)
        return f"CAST(`{name}` AS {kind})"


def decode_payload(value: Column) -> Column:
    """JSON text of a message body.

    JSON stays as it is, other text goes under ``raw_data``, bytes that are
    not UTF-8 go under ``raw_data_b64`` and a null body gives a null
    ``raw_data``.
    """
    text = F.try_validate_utf8(value.cast("string"))
    return (
        F.when(value.isNull(), F.lit('{"raw_data":null}'))
        .when(text.isNull(), F.to_json(F.struct(F.base64(value).alias("raw_data_b64"))))
        .when(F.try_parse_json(text).isNotNull(), text)
        .otherwise(F.to_json(F.struct(text.alias("raw_data"))))
    )
