"""Analytics over time-stamped activities and sensor streams, as Spark DataFrame functions."""
