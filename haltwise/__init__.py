"""Transit-vehicle analytics as composable Spark DataFrame operators."""
