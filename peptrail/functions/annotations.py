"""Annotation strings ``EC:…;GO:…;IPR:IPR…`` and their packed forms, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptrail.operators.settle import numbered

# The packed alphabet, in the order of its codes, and the prefixes packing leaves out.
ALPHABET = "$0123456789-.,;"
PREFIXES = ("EC:", "GO:", "IPR:IPR")

CODES = "0123456789ABCDE"  # the hexadecimal digit of each place in the alphabet


def split(text: Column) -> Column:
    """The annotations of a string, without empty ones; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x != "")


def has_category(annotations: Column, letter: str) -> Column:
    return F.exists(annotations, lambda x: F.substring(x, 1, 1) == letter)


def _stripped(parts: Column, prefix: str) -> Column:
    """The parts of a kind (the letters before the first colon), without its prefix."""
    own = F.filter(parts, lambda x: F.startswith(x, F.lit(prefix[: prefix.index(":")])))
    return F.transform(own, lambda x: F.substring(x, len(prefix) + 1, 1 << 30))


def _prefixed(parts: Column, prefix: str) -> Column:
    return F.transform(parts, lambda x: F.concat(F.lit(prefix), x))


def pack(text: Column) -> Column:
    """Two symbols a byte, grouped EC, GO, IPR; annotations of other kinds are left out.

    A symbol outside the alphabet is an error. An empty text packs to no bytes, null to null.
    """
    parts = split(text)
    kinds = [F.array_join(_stripped(parts, p), ";") for p in PREFIXES]
    symbols = F.concat_ws(",", *kinds)
    checked = F.when(symbols.rlike(r"^[$0-9\-.,;]*$"), symbols).otherwise(F.raise_error(F.concat(F.lit("cannot pack: "), symbols)))
    padded = F.when(F.length(checked) % 2 == 1, F.concat(checked, F.lit("$"))).otherwise(checked)
    return F.when(text == "", F.unhex(F.lit(""))).when(text.isNotNull(), F.unhex(F.translate(padded, ALPHABET, CODES)))


def unpack(packed: Column) -> Column:
    """The string that ``pack`` packed, in the order EC, GO, IPR."""
    symbols = F.translate(F.hex(packed), CODES + "F", ALPHABET + "?")
    checked = F.when(~F.contains(symbols, F.lit("?")), symbols).otherwise(F.raise_error(F.concat(F.lit("cannot unpack: "), F.hex(packed))))
    kinds = F.split(F.rtrim(checked, F.lit("$")), ",")
    named = [_prefixed(split(F.get(kinds, F.lit(i))), p) for i, p in enumerate(PREFIXES)]
    return F.when(packed.isNotNull(), F.array_join(F.concat(*named), ";"))


def extend_dictionary(dictionary: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``dictionary(code, annotation)`` with the annotations of ``rows`` that it lacks, in their order, behind its largest code.

    Codes that are there stay as they are, so what was encoded before can be decoded ever after.
    """
    new = rows.select(F.explode(split(F.col(text))).alias("annotation")).distinct().join(dictionary, "annotation", "left_anti")
    last = dictionary.agg(F.max("code")).first()[0]
    added = numbered(new, ["annotation"], "code", 0 if last is None else last + 1)
    return dictionary.select("code", "annotation").union(added.select(F.col("code").cast(dictionary.schema["code"].dataType), "annotation"))


def encode_codes(rows: DataFrame, key: str, text: str, dictionary: DataFrame, order: str | None = None) -> DataFrame:
    """``(key, codes)``: three little-endian bytes for each annotation of ``dictionary(code, annotation)``.

    Unknown annotations are left out; of a repeated dictionary entry the smallest code counts. Rows that share a key are coded
    place by place, at each in their ``order``, or else by code.
    """
    first = dictionary.groupBy("annotation").agg(F.min("code").alias("code"))
    each = rows.select(F.col(key).alias("_key"), (F.lit(0) if order is None else F.col(order)).alias("_nth"), F.posexplode_outer(split(F.col(text))).alias("_at", "annotation")).join(first, "annotation", "left")
    six = F.lpad(F.hex("code"), 6, "0")
    little = F.concat(F.substring(six, 5, 2), F.substring(six, 3, 2), F.substring(six, 1, 2))
    parts = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("_at", "_nth", little.alias("x")))))
    return each.groupBy("_key").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")).alias("codes")).withColumnRenamed("_key", key)


def decode_codes(rows: DataFrame, key: str, codes: str, dictionary: DataFrame) -> DataFrame:
    """``(key, text)`` from whole groups of three bytes; an unknown code is an error."""
    n = F.floor(F.length(codes) / 3).cast("int")
    digits = F.hex(codes)
    code = lambda i: F.conv(F.concat(*(F.substring(digits, 6 * i + at, F.lit(2)) for at in (5, 3, 1))), 16, 10).cast("int")
    found = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), code))
    each = rows.select(F.col(key).alias("_key"), F.posexplode_outer(found).alias("_at", "code")).join(dictionary, "code", "left")
    name = F.when(F.col("annotation").isNull() & F.col("code").isNotNull(), F.raise_error(F.concat(F.lit("unknown code "), F.col("code").cast("string")))).otherwise(F.col("annotation"))
    parts = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("_at", name.alias("x")))))
    return each.groupBy("_key").agg(F.array_join(F.transform(parts, lambda p: p["x"]), ";").alias("text")).withColumnRenamed("_key", key)
