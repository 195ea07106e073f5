"""Feed intelligence and measurement tracking as DataFrame jobs on Spark."""
