"""Orogen: terrain-patch similarity analytics expressed as Spark plans."""
