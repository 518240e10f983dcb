"""Market-event analytics on Spark: bars, features, events, labels, matching and statistics over candle tables and streams."""
