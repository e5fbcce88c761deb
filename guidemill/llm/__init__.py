"""Training-data operators: ten corpus filters, de-duplicators and packers, each (DataFrame in, DataFrame out)."""
