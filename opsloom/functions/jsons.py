"""JSON text columns and the validation of structured replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.functions.ids import strip
from opsloom.functions.values import in_domain
from opsloom.schemas import ACTIONS

INT_MAX = 2_147_483_647
REPLY_TEXT_FIELDS = ("case_summary", "suggested_response", "reasoning")


def with_json(df: DataFrame, col: str, schema: T.DataType, out: str | None = None) -> DataFrame:
    """Parse a JSON text column; text that is not JSON gives null."""
    text = F.col(col)
    parsed = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))
    return df.withColumn(out or col, parsed)


def strip_fence(col: Column) -> Column:
    """Trim; inside a code fence drop the opening line, the closing fence and trim again."""
    text = strip(col)
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(
        F.substring(text, 4, INT_MAX)
    )
    return F.when(F.startswith(text, F.lit("```")), strip(F.regexp_replace(body, r"```$", ""))).otherwise(text)


def whole_json(col: Column) -> Column:
    """The text as a variant, null unless all of it is one JSON value.

    The parser stops after the first value, so the text is wrapped in an object whose last
    key must be reached.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"value":'), col, F.lit('\n,"_end_":true}')))
    complete = F.try_variant_get(wrapped, "$._end_", "boolean")
    return F.when(complete, F.try_variant_get(wrapped, "$.value", "variant"))


def _field(doc: Column, name: str) -> tuple[Column, Column]:
    """A field's text and its JSON type; the type is null where the field is absent."""
    path = f"$.{name}"
    return (
        F.try_variant_get(doc, path, "string"),
        F.schema_of_variant(F.try_variant_get(doc, path, "variant")),
    )


def _evaluated(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed exactly once.

    A filter on a plain column is moved below the projection together with a copy of the
    column's expression; it is not moved below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[col.alias(name) for name, col in cols.items()]))))


def parse_replies(df: DataFrame, raw: str, error: str | None = None) -> DataFrame:
    """Add the five reply fields and `reject_reason` (null = valid) for a raw reply column.

    Unknown or missing actions become no_action, missing texts become empty, a missing
    amount becomes 0. Replies that are not one JSON object, and amounts that are not whole
    numbers in the integer range, are rejected with a reason. `error` names a column with the
    responder's own error.
    """
    df = _evaluated(df, _text=strip_fence(F.col(raw)))
    df = _evaluated(df, _doc=whole_json(F.col("_text"))).drop("_text")
    doc = F.col("_doc")
    action, action_type = _field(doc, "suggested_action")
    cents, cents_type = _field(doc, "suggested_amount_cents")
    number = F.try_variant_get(doc, "$.suggested_amount_cents", "double")
    digits = F.replace(strip(cents), F.lit("_"), F.lit(""))
    amount = (
        F.when(doc.isNull(), F.lit(None).cast("double"))
        .when(cents_type.isNull(), F.lit(0.0))
        .when(cents_type == "BOOLEAN", F.when(cents == "true", 1.0).otherwise(0.0))
        .when(cents_type == "STRING", F.when(strip(cents).rlike(r"^[+-]?\d+(_\d+)*$"), digits.try_cast("double")))
        .when(cents_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number)
    )
    out = {}
    for name in REPLY_TEXT_FIELDS:
        text, kind = _field(doc, name)
        out[name] = F.coalesce(F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text), F.lit(""))
    out["suggested_action"] = F.when(in_domain(action, ACTIONS), action).otherwise("no_action")
    truncated = F.when(F.abs(amount) < INT_MAX + 1.0, amount.cast("int"))
    df = _evaluated(df, suggested_amount_cents=truncated)
    reasons = [
        (doc.isNull(), "not json"),
        (~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), "not an object"),
        (F.coalesce(action_type.rlike("^(ARRAY|OBJECT)"), F.lit(False)), "bad action"),
        (F.col("suggested_amount_cents").isNull(), "bad amount"),
    ]
    if error:
        reasons.insert(0, (F.col(error).isNotNull(), "responder error"))
    reason = F.lit(None).cast("string")
    for cond, text in reversed(reasons):
        reason = F.when(cond, F.lit(text)).otherwise(reason)
    out["reject_reason"] = reason
    return df.withColumns(out).drop("_doc")
