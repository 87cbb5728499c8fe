"""Ways in which a value can be wrong. Each takes a column and a seeded hash and keeps nulls null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sidecar types each mutation takes; text mutations take text.
NUMBERS = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
TEXT = ("VARCHAR",)
TAKES = {
    "sentinel": (*NUMBERS, *TEXT, "BOOLEAN"), "typo": (*TEXT, "BIGINT", "INTEGER"), "case": TEXT, "whitespace": TEXT, "truncate": TEXT, "precision_drop": ("DOUBLE", "FLOAT", "DECIMAL"),
    "scale": NUMBERS, "mojibake": TEXT, "format_dirt": TEXT, "resample": (*NUMBERS, *TEXT, "BOOLEAN"), "out_of_domain": TEXT,
}
CLASS = {
    "sentinel": "sentinel_value", "typo": "typo_value", "case": "case_drift", "whitespace": "whitespace_pad", "truncate": "truncated_value", "precision_drop": "precision_drop",
    "scale": "scaled_value", "mojibake": "mojibake_value", "format_dirt": "format_dirt", "resample": "resampled_value", "out_of_domain": "out_of_domain_value",
}


def swapped(text: Column, at: Column) -> Column:
    """text with the characters at (1-based) and after it exchanged."""
    return F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1, F.lit(1)), F.substr(text, at, F.lit(1)), F.substr(text, at + 2))


def typo(c: Column, seed: Column) -> Column:
    """Two neighbouring characters exchanged at a seeded place; of a number two digits, kept if that leaves it as it was."""
    n = F.length(c)
    return F.when(n >= 2, swapped(c, (F.pmod(seed, n - 1) + 1).cast("int"))).otherwise(c)


def case(c: Column, form: str) -> Column:
    if form == "upper":
        return F.upper(c)
    if form == "lower":
        return F.lower(c)
    letters = F.split(c, "")
    flipped = lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))
    if form == "swap":
        return F.array_join(F.transform(letters, flipped), "")
    # title: a letter after anything but a letter is upper case, others lower
    before = F.concat(F.array(F.lit(" ")), letters)
    return F.array_join(F.transform(letters, lambda x, i: F.when(F.element_at(before, i + 1).rlike(r"\p{L}"), F.lower(x)).otherwise(F.upper(x))), "")


def mojibake(c: Column) -> Column:
    """UTF-8 bytes read as Latin-1."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def format_dirt(c: Column) -> Column:
    """Thousands commas in a text of digits, otherwise unchanged."""
    return F.when(c.rlike(r"^\d{4,}$"), F.regexp_replace(c, r"(?<=\d)(?=(\d{3})+$)", ",")).otherwise(c)


def out_of_domain(c: Column, domain: Column) -> Column:
    """The first transposition that is not in the domain (an array), else the last character twice."""
    n = F.length(c)
    tries = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: swapped(c, i))
    fresh = F.filter(tries, lambda x: (x != c) & ~F.array_contains(domain, x))
    return F.when(c.isNull(), c).otherwise(F.when((n >= 2) & (F.size(fresh) > 0), F.get(fresh, F.lit(0))).otherwise(F.concat(c, F.right(c, F.lit(1)))))


def resample(c: Column, values: Column, seed: Column) -> Column:
    """Another of the column's distinct values (an ascending array); unchanged if there is no other."""
    others = F.filter(values, lambda x: x != c)
    return F.when(c.isNull() | (F.size(others) == 0), c).otherwise(F.get(others, F.pmod(seed, F.size(others)).cast("int")))


def mutate(kind: str, c: Column, declared: str, seed: Column, values: Column | None = None, **options) -> Column:
    """The mutated column in its own type; ``values`` are the distinct values (resample) or the domain (out_of_domain)."""
    from tidelog.sources.bundle import spark_type

    own = spark_type(declared)
    whole = own in ("bigint", "int", "smallint", "tinyint")
    text: dict[str, Callable[[], Column]] = {
        "sentinel": lambda: F.when(c.isNotNull(), F.lit(options["value"]).cast(own)),
        "typo": lambda: typo(c.cast("string"), seed).try_cast(own),
        "case": lambda: case(c, options["form"]),
        "whitespace": lambda: F.concat(F.lit(" "), c) if options["where"] == "leading" else F.concat(c, F.lit(" ")),
        "truncate": lambda: F.left(c, F.lit(options["max_length"])),
        "precision_drop": lambda: F.bround(c, options["digits"]).cast(own),
        "scale": lambda: (F.bround(c * F.lit(float(options["factor"]))) if whole else c * F.lit(float(options["factor"]))).cast(own),
        "mojibake": lambda: mojibake(c),
        "format_dirt": lambda: format_dirt(c),
        "resample": lambda: resample(c, values, seed),
        "out_of_domain": lambda: out_of_domain(c, values),
    }
    return text[kind]()
