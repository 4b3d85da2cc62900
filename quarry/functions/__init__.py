"""Column functions on text: no Python runs on the executors."""
