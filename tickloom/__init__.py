"""Trade and order-book analytics as Spark DataFrame jobs."""

from tickloom.operators.query import QueryBuilder, query_trades

__all__ = ["QueryBuilder", "query_trades"]
