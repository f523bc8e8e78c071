"""Reports: whole logical plans made of the operators."""
