"""Training-data operators: dedup, scoring, filtering, sampling and archives on Spark."""
