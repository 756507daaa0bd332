"""lattica: an analytics engine expressed as Spark DataFrame plans."""
