"""Table operators: every function takes a DataFrame and gives one, or a small fitted state."""
