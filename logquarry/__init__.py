"""logquarry: web access-log analytics as composable Spark DataFrame operators."""
