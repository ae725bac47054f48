"""Reading of price bars, filings and gauges."""
