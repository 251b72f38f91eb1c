"""Spark-native analytics for order-level market data, auction snapshots and strategy PnL."""
