"""A PySpark engine for change-tape datasets and training-data tables."""

#: End of an interval that is still open.
OPEN = 9223372036854775807
#: Nanoseconds of a day.
DAY = 86_400_000_000_000
