"""Reading and writing: CSV pairs, the scenario store, fitted state, the dataset registry."""
