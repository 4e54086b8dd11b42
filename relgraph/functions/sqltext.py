"""Classification of string literals that hold SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relgraph.functions.text import let, strip, words

OPERATIONS = {"SELECT": "select", "INSERT": "insert", "UPDATE": "update", "DELETE": "delete",
              "EXEC": "stored_procedure", "EXECUTE": "stored_procedure"}
MAX_TEXT = 400
_IDENTIFIER = r"^[A-Za-z_$#][A-Za-z0-9_$#]*$"


def collapse(text: Column) -> Column:
    return let(
        F.array_join(words(text), " "),
        lambda joined: F.when(F.octet_length(joined) <= MAX_TEXT, joined).otherwise(
            F.concat(F.substring(joined, 1, MAX_TEXT), F.lit("..."))
        ),
    )


def _object_token(tokens: Column, operation: Column) -> Column:
    marker = F.when(operation.isin("select", "delete"), "FROM").when(operation == "insert", "INTO")
    at = F.array_position(F.transform(tokens, lambda t: F.upper(t)), marker).cast("int")
    return F.when(marker.isNull(), F.get(tokens, F.lit(1))).when(at > 0, F.get(tokens, at))


def _object_parts(token: Column) -> Column:
    """Unquoted name parts of an object token; empty when it names no plain object."""
    parts = F.filter(
        F.transform(F.split(F.rtrim(strip(token), F.lit(";")), r"\."), lambda p: F.btrim(strip(p), F.lit('[]"`'))),
        lambda p: p != "",
    )
    usable = token.isNotNull() & ~F.contains(token, F.lit("(")) & ~token.rlike(r"^[@$]")
    clean = lambda ps: F.forall(ps, lambda p: p.rlike(_IDENTIFIER)) & F.size(ps).isin(1, 2)
    nothing = F.array().cast("array<string>")
    return F.when(~usable, nothing).otherwise(let(parts, lambda ps: F.when(clean(ps), ps).otherwise(nothing)))


def classify_sql(text: Column) -> Column:
    """``struct<operation, schema, object, narrowed>``, null when the literal is no statement."""
    operations = F.create_map(*[F.lit(p) for kv in OPERATIONS.items() for p in kv])

    def with_object(tokens: Column, operation: Column) -> Column:
        def shaped(parts: Column) -> Column:
            return F.struct(
                operation.alias("operation"),
                F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).alias("schema"),
                F.get(parts, F.size(parts) - 1).alias("object"),
                (F.size(parts) > 0).alias("narrowed"),
            )

        return F.when(
            operation.isNotNull(), let(let(_object_token(tokens, operation), _object_parts), shaped)
        )

    return let(
        words(text),
        lambda tokens: let(
            F.try_element_at(operations, F.upper(F.get(tokens, F.lit(0)))), lambda operation: with_object(tokens, operation)
        ),
    )
