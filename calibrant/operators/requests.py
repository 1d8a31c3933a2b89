"""Stored answers and the requests that still lack one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.operators.staging import computed_once


def request_key(model: Column, prompt: Column, **params: Column) -> Column:
    """Key of a request: a digest over model, prompt and every parameter, in name order."""
    fields = [model.alias("m"), prompt.alias("p")]
    fields += [params[name].alias(name) for name in sorted(params)]
    return F.sha1(F.to_json(F.struct(*fields)))


def with_request_key(
    df: DataFrame, model: Column, prompt: Column, name: str = "key", **params: Column
) -> DataFrame:
    """Add the request key, computed once per row."""
    return computed_once(df, **{name: request_key(model, prompt, **params)})


def distinct_requests(requests: DataFrame, key: str = "key") -> DataFrame:
    """One row per key; equal keys mean equal requests."""
    return requests.dropDuplicates([key])


def merge_store(store: DataFrame, fresh: DataFrame, order: str, key: str = "key") -> DataFrame:
    """The store plus fresh answers to keys it does not have, the earliest answer of each.

    Only the keys of the store are shuffled, not its texts.
    """
    rest = [c for c in store.columns if c != key]
    first = fresh.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_kept")).select(key, "_kept.*")
    return store.unionByName(first.join(store.select(key), key, "left_anti"))


def pending_requests(requests: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Distinct requests without a stored answer."""
    return distinct_requests(requests, key).join(store.select(key), key, "left_anti")


def answered_requests(
    requests: DataFrame, store: DataFrame, key: str = "key",
    answer: Sequence[str] = ("text", "reasoning", "finish_reason"),
) -> DataFrame:
    """Every request with its stored answer, NULL while it is pending."""
    return requests.join(store.select(key, *answer), key, "left")
