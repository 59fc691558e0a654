"""quarrylens: data-quality, governance and training-data analytics as Spark DataFrame functions."""
