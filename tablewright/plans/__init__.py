"""Compositions of operators: scenarios, the fitted preprocessor, experiments, model comparison."""
