"""DataFrame -> DataFrame transformations; usable with ``DataFrame.transform``."""
