"""Analytics of negotiated payer rates on Spark."""
