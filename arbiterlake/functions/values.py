"""Booleans, numbers, JSON, arrays and hashes with the data model's null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

#: Fixed words of the boolean parser.
TRUE_WORDS = ("true", "1", "yes", "y", "是", "有", "需要", "required")
FALSE_WORDS = ("false", "0", "no", "n", "否", "无", "不需要", "none", "null", "nan", "")

#: Fixed vocabularies, in canonical order.
COARSE_TAGS = (
    "missing_facts", "overclaim", "missing_evidence_warning", "unverified_basis", "fabricated_citation",
    "weak_fact_rule_application", "missing_procedure_warning", "jurisdiction_risk", "unsafe_action_suggestion", "needs_human_review",
)
ASSET_ROUTES = ("eval", "sft", "preference", "badcase", "regression")
POLICIES = ("auto_answer", "grounded_answer", "clarify", "human_review", "block")
STATUSES = ("pending_review", "reviewed", "blocked", "released")

TAG = "array<struct<coarse_error_tag:string,error_subtype:string>>"


def parse_bool(c: Column, default: bool = False) -> Column:
    """Boolean from text; numbers count as their truth; anything unknown or null is the default."""
    word = F.lower(clean(c))
    number = word.try_cast("double")
    return (
        F.when(c.isNull(), default).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
        .when(number.isNotNull(), number != 0).otherwise(default)
    )


def narrow_bool(c: Column) -> Column:
    return F.lower(clean(c)).isin("true", "1", "yes", "y")


def number(c: Column, default: float = 0.0) -> Column:
    """Number or the default; NaN counts as missing."""
    value = c.cast("string").try_cast("double")
    return F.when(value.isNull() | F.isnan(value), default).otherwise(value)


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole from whole numbers, zero if the whole is zero; rounded like the floating-point quotient itself.

    Whole numbers tell which side of a tie the quotient is on. An exact tie goes where the nearest double lies,
    and to the even side if the tie is a double. The double's distance from the tie is exact: it is taken apart
    into a part of 24 bits and the rest, whose products with the scale are doubles.
    """
    scale = 10**places
    a, b = part.cast("long"), whole.cast("long")
    rest = (a * scale) % b
    down = (a * scale - rest) / b
    x = a.cast("double") / b.cast("double")
    high = x.cast("float").cast("double")
    beyond = (high * (2.0 * scale) - (2 * down + 1)) + (x - high) * (2.0 * scale)
    tie = F.when(beyond > 0, 1).when(beyond < 0, 0).otherwise(down.cast("long") % 2)
    return F.when(b == 0, 0.0).otherwise((down + F.when(2 * rest > b, 1).when(2 * rest < b, 0).otherwise(tie)) / float(scale))


def first_of(order: Sequence[str], present: Column, otherwise: str) -> Column:
    """The first word of ``order`` that the array has."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(present, x)), F.lit(0)), F.lit(otherwise))


def canonical(order: Sequence[str], present: Column) -> Column:
    """The words of ``order`` that the array has, in order."""
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(present, x))


def overlaps(present: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(present, F.array(*map(F.lit, words)))


def json_items(c: Column) -> Column:
    """Elements of a JSON array as text (objects stay JSON); anything else is empty."""
    text = clean(c)
    return F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def error_tags(c: Column, strict: bool = True, objects_only: bool = False) -> Column:
    """Tags from a JSON array of names or objects. ``strict``: an unknown name becomes needs_human_review,
    and an object so renamed gets a subtype; otherwise names stay and empty ones go. ``objects_only``: names
    that are no objects are left out, as ensembles do."""

    def one(item: Column) -> Column:
        is_object = item.startswith("{")
        name = F.when(is_object, clean(F.get_json_object(item, "$.coarse_error_tag"))).otherwise(item)
        subtype = F.when(is_object, clean(F.get_json_object(item, "$.error_subtype"))).otherwise("")
        known = name.isin(*COARSE_TAGS) if strict else F.lit(True)
        return F.struct(
            F.when(known, name).otherwise("needs_human_review").alias("coarse_error_tag"),
            F.when(~known & is_object & (subtype == ""), "non_standard_error_tag").otherwise(subtype).alias("error_subtype"),
        )

    items = F.filter(json_items(c), lambda x: x.startswith("{")) if objects_only else json_items(c)
    made = F.transform(items, one)
    return made if strict else F.filter(made, lambda t: F.coalesce(t["coarse_error_tag"], F.lit("")) != "")


def plain_tags(c: Column) -> Column:
    """Names as the dashboard counts them: those of objects unless they are empty, and all others as they stand."""
    name = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.coarse_error_tag")).otherwise(x)
    return F.transform(F.filter(json_items(c), lambda x: ~x.startswith("{") | (F.coalesce(name(x), F.lit("")) != "")), name)


def tag_names(tags: Column) -> Column:
    return F.transform(tags, lambda t: t["coarse_error_tag"])


def hash_modulo(c: Column, n: int) -> Column:
    """The SHA-256 of the text as a number, modulo ``n``, folded over its hex digits."""
    digits = F.filter(F.split(F.sha2(c, 256), ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * 16 + F.conv(x, 16, 10).cast("long")) % n)


def hash_bits(c: Column, count: int = 9) -> Column:
    """The low bits of the SHA-256 as 0/1, lowest first."""
    low = F.conv(F.right(F.sha2(c, 256), F.lit(4)), 16, 10).cast("int")
    return F.array(*(F.shiftright(low, i).bitwiseAND(F.lit(1)) for i in range(count)))
