"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Older electrode names and their present ones.
ELECTRODE_ALIASES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}

# The two spellings of the doubled derivation, and its plain name.
DOUBLED_CHANNELS = ("T8-P8-0", "T8-P8-1")
PLAIN_DOUBLED = "T8-P8"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression captured by a lambda would be evaluated for every element;
    bound as the element of a one-element array it is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def array_var(values: Column) -> Column:
    """Population variance of an array, centred on its mean."""

    def around(mean: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(values)

    return bind(array_mean(values), around)


def sigmoid(logit: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(logit)))


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def canonical_channel(name: Column | str) -> Column:
    plain = stripped(name)
    return F.when(plain.isin(*DOUBLED_CHANNELS), PLAIN_DOUBLED).otherwise(plain)


def canonical_electrode(name: Column | str) -> Column:
    upper = F.upper(stripped(name))
    known = F.create_map(*[F.lit(x) for pair in ELECTRODE_ALIASES.items() for x in pair])
    return F.coalesce(known[upper], upper)


def normalized_filename(name: Column | str) -> Column:
    """Repair two known typing errors of record names (fixed values)."""
    text = F.replace(stripped(name), F.lit("PNO6"), F.lit("PN06"))
    return F.when(text == "PN11-.edf", "PN11-1.edf").otherwise(text)


def clock_seconds(text: Column | str) -> Column:
    """Seconds of ``HH.MM.SS`` or ``HH:MM:SS``; NULL when not a time of day."""
    parts = F.split(F.replace(stripped(text), F.lit(":"), F.lit(".")), r"\.")
    h, m, s = (stripped(F.get(parts, F.lit(i))).try_cast("int") for i in range(3))
    valid = (F.size(parts) == 3) & (h <= 23) & (m <= 59) & (s <= 59)
    return F.when(valid, h * 3600 + m * 60 + s)
