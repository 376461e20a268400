"""Aviation activity and emission analytics as lazy Spark DataFrame functions."""
