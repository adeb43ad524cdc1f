"""memlens: analytics, retrieval and upkeep of coding-agent memory on Spark."""
