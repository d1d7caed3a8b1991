"""Token budgets and costs of batched scoring; plain numbers on the driver, column arithmetic for rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Estimated output tokens of a JSON value by kind (fixed values).
OUTPUT_TOKENS = {"number": 5, "integer": 5, "boolean": 5, "string": 50, "other": 20}


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def input_budget(max_input: int, instructions: str) -> int:
    left = max_input - math.ceil(len(instructions) / 4) - math.ceil(max_input * 0.1)
    if left <= 0:
        raise ValueError("the instructions leave no room for items")
    return left


def items_per_batch(max_output: int, per_item: int) -> int:
    return max(1, (max_output - math.ceil(max_output * 0.15)) // per_item)


def output_estimate(schema: dict) -> int:
    """Estimated output tokens of one value of a JSON schema."""
    kind = schema.get("type")
    if kind == "object":
        members = schema.get("properties", {})
        return 6 * len(members) + 2 + sum(map(output_estimate, members.values()))
    if kind == "array":
        return 2 * output_estimate(schema["items"]) + 2 if schema.get("items") else 10
    return OUTPUT_TOKENS.get(kind, OUTPUT_TOKENS["other"])


def cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    return input_tokens * F.lit(input_price) + output_tokens * F.lit(output_price)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
