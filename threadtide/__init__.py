"""Analytics for threaded discussion on Spark: features, cleaning, matching, user roll-ups and tests."""
