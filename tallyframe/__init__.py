"""Decision-data analytics expressed as PySpark DataFrame plans."""
