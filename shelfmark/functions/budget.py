"""Column functions on how much a model takes at once, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import schema as s


def model_family(model: Column) -> Column:
    """The longest known family that is part of a model's name, else 'default'."""
    known = sorted((k for k in s.MODEL_CONTEXT if k != "default"), key=len, reverse=True)
    low = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return F.coalesce(*[F.when(low.contains(k), k) for k in known], F.lit("default"))


def effective_context(model: Column, assumed: int = 8_192) -> Column:
    """Tokens of context that count; ``assumed`` is the context of unknown models."""
    table = dict(s.MODEL_CONTEXT) | {"default": (s.MODEL_CONTEXT["default"][0], assumed)}
    family = model_family(model)
    value = F.coalesce(*[F.when(family == k, int(share * context)) for k, (share, context) in table.items()])
    return F.greatest(value, F.lit(s.LEAST_CONTEXT))


def chunk_size(context: Column, n_categories: Column) -> Column:
    """Rows that fit one call beside the catalogue; 0 if none do."""
    room = context - (s.SYSTEM_TOKENS + n_categories * s.CATEGORY_TOKENS + s.RESPONSE_TOKENS)
    return F.when(room <= 0, 0).otherwise(F.least(F.floor(room / s.ROW_TOKENS), F.lit(s.MOST_CHUNK))).cast("int")


def use_rolling(context: Column, n_files: Column) -> Column:
    return (n_files >= s.LEAST_CHUNK) & (chunk_size(context, F.lit(10)) >= s.LEAST_CHUNK)


def tier(n_files: Column) -> Column:
    return F.when(n_files < 60, "small").when(n_files < 100, "medium").otherwise("large")


def use_microbatch(mode: Column, prompt_chars: Column, context: Column, budget: Column) -> Column:
    """'on' and 'off' decide; 'auto' compares a third of the characters with what the budget leaves."""
    auto = F.floor(prompt_chars / 3) > F.greatest(F.lit(1024), context - budget)
    return F.when(mode == "on", True).when(mode == "off", False).otherwise(auto)


def cost(model: Column, prompt_chars: Column, response_chars: Column) -> Column:
    """Estimated US dollars of a call: a third of the characters are tokens."""
    name = F.lower(F.coalesce(model, F.lit("")))
    free = F.lit(False)
    for word in s.LOCAL:
        free = free | name.contains(word)
    price = lambda i: F.coalesce(*[F.when(name == m, F.lit(p[i])) for m, p in s.PRICES.items()], F.when(free, 0.0), F.lit(s.UNKNOWN_PRICE[i]))
    return F.floor(prompt_chars / 3) / 1e6 * price(0) + F.floor(response_chars / 3) / 1e6 * price(1)
