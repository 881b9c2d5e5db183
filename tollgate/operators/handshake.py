"""Checks of the two-phase handshake: binding, expiry, replay, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.session import cut_lineage


def parameters_bound(params: Column, authorised_hash: Column) -> Column:
    """The executed parameters are those the token was issued for."""
    return F.sha2(params, 256) == authorised_hash


def in_time(executed: Column, expiry: Column) -> Column:
    return executed <= expiry


def first_uses(uses: DataFrame, key: str = "token", order: tuple[str, ...] = ("ts", "log_id")) -> DataFrame:
    """First use and number of uses per token, combined before the shuffle."""
    first = F.min(F.struct(*order))
    return uses.groupBy(key).agg(F.count("*").alias("uses"), first.alias("first_use"))


def outcomes(uses: DataFrame, key: str = "token", order: tuple[str, ...] = ("ts", "log_id"), expiry: str = "expiry") -> DataFrame:
    """``outcome`` of every use of a single-use token: ``first``, ``replay`` or ``expired``.

    The life of a token runs from its issue to ``expiry``, whatever is done with it. A
    use after it is expired and spends nothing; of the uses within it the first passes
    and the others are replays. A use without a token is null.

    The first uses are stored before the join, so that adaptive execution can split the
    rows of a token that most of them use.
    """
    alive = F.col(order[0]) <= F.col(expiry)
    first = cut_lineage(first_uses(uses.filter(alive & F.col(key).isNotNull()), key, order).select(key, "first_use"))
    outcome = (
        F.when(F.col(key).isNull(), F.lit(None))
        .when(~alive, "expired")
        .when(F.struct(*order) == F.col("first_use"), "first")
        .otherwise("replay")
    )
    return uses.join(first, key, "left").select(*uses.columns, outcome.alias("outcome"))


def replays(uses: DataFrame, key: str = "token", order: tuple[str, ...] = ("ts", "log_id")) -> DataFrame:
    """Every use of a single-use token but the first, for uses known to lie within the token's life."""
    marked = outcomes(uses.withColumn("_expiry", F.col(order[0])), key, order, "_expiry")
    return marked.filter("outcome = 'replay'").select(*uses.columns)


def match(authorised: DataFrame, executed: DataFrame) -> DataFrame:
    """Executions inside the life of their authorisation, by transaction id (unique on both sides)."""
    a, e = authorised.alias("a"), executed.alias("e")
    same = (F.col("a.transaction_id") == F.col("e.transaction_id")) & (F.col("a.token") == F.col("e.token"))
    alive = F.col("e.exec_ts").between(F.col("a.auth_ts"), F.col("a.expiry"))
    return a.join(e, same & alive).select(
        "a.transaction_id", "a.token", "a.auth_ts", "e.exec_ts", "a.auth_hash", "e.exec_hash"
    )


def orphans(authorised: DataFrame, executed: DataFrame) -> DataFrame:
    """Transactions with only one of the two phases."""
    a = authorised.select("transaction_id", F.lit(True).alias("authorised"))
    e = executed.select("transaction_id", F.lit(True).alias("executed"))
    return (
        a.join(e, "transaction_id", "full_outer")
        .filter("authorised IS NULL OR executed IS NULL")
        .select(
            "transaction_id",
            F.when(F.col("executed").isNull(), "not executed").otherwise("not authorised").alias("finding"),
        )
    )


def metrics(log: DataFrame, keys: list[str]) -> DataFrame:
    """Token use, failed checks and their share."""
    failed = ~F.col("bound") | ~F.col("alive")
    return log.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("bound")).alias("unbound"),
        F.count_if(~F.col("alive")).alias("expired"),
        (F.count_if(failed) / F.count("*")).alias("error_rate"),
    )
