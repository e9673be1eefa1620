"""Data-quality scenarios on Spark: prepare tables several ways, train on each, compare the scores."""
