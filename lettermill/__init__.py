"""lettermill: correspondence analytics and corpus preparation on Spark."""
