"""Moodtide: market-sentiment, backtest and portfolio-disclosure analytics on Spark."""
