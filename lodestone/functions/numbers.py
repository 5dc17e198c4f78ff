"""Figures as the user interface shows them, energy and queue arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kwh(watts: Column, seconds: Column) -> Column:
    return watts * seconds / F.lit(3600.0) / F.lit(1000.0)


def watts_since(joules: Column, start_joules: Column, seconds: Column, start_seconds: Column) -> Column:
    """Mean power since the start; a counter that ran over counts as none, no time gives null."""
    return F.try_divide(F.greatest(F.lit(0.0), joules - start_joules), seconds - start_seconds)


def ram_watts(start_gb: Column, gb: Column, per_gb: float = 0.375) -> Column:
    return (start_gb + gb) / 2 * per_gb


def hair_dryer_seconds(kwh_: Column) -> Column:
    return kwh_ * 1000 / 2200 * 3600


def phone_battery_percent(kwh_: Column) -> Column:
    return kwh_ * 1000 / 5 * 1000 / 5000 * 0.8 * 100


def fixed(x: Column, places: int) -> Column:
    """x with that many decimal places as toFixed() writes it: what its binary value is nearest to, of two the larger.

    x times a power of two is a whole number, exactly, so the halves between decimals are compared as such; figures of
    4,194,304 and more, which have no room for that in a long, are rounded as printed.
    """
    size, unit = F.abs(x), 10**places
    bits = F.when(size < 1, 62).when(size < 2048, 52).otherwise(41)
    scaled = F.floor(size * F.pow(F.lit(2.0), bits)).cast("decimal(20,0)") * F.lit(2 * unit).cast("decimal(9,0)")
    near = F.floor(size * unit).cast("long")
    over = lambda n: (scaled >= (2 * n + 1).cast("decimal(17,0)") * F.pow(F.lit(2.0), bits).cast("decimal(20,0)")).cast("long")
    n = near - 1 + over(near - 1) + over(near) + over(near + 1)
    whole = F.floor(n / unit).cast("string")
    text = F.concat(whole, F.lit("."), F.lpad((n % unit).cast("string"), places, "0")) if places else whole
    return F.when(size < 1 << 22, F.concat(F.when(x < 0, "-").otherwise(""), text)).otherwise(F.format_string(f"%.{places}f", x))


def percent(score: Column) -> Column:
    return F.concat(fixed(score * 100, 1), F.lit("%"))


def german_integer(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", ".")


def german_decimal(x: Column, places: int) -> Column:
    return F.replace(fixed(x, places), F.lit("."), F.lit(","))


def queue_seconds(position: Column, each: int = 40) -> Column:
    return F.greatest(F.greatest(position, F.lit(1)) - 1, F.lit(1)) * each


def queue_message(position: Column, seconds: Column) -> Column:
    several = F.concat(F.lit("requests waiting: "), (position - 1).cast("string"), F.lit(", seconds: "), seconds.cast("string"))
    return F.when(position == 1, "").when(position == 2, F.concat(F.lit("1 request waiting, seconds: "), seconds.cast("string"))).otherwise(several)


def progress_percent(elapsed: Column, has_output: Column, expected: int = 40) -> Column:
    return F.when(has_output, F.lit(100.0)).otherwise(elapsed / F.greatest(F.lit(float(expected)), elapsed + 4) * 100)


def energy_from_micro(c: Column) -> Column:
    return c / 1e6


def energy_from_milli(c: Column) -> Column:
    return c / 1e3


def gib(c: Column) -> Column:
    return c / float(1024**3)


def seconds_from_nano(c: Column) -> Column:
    return c / 1e9


def node_size(length: Column, factor: float = 100.0) -> Column:
    return F.lit(10.0) + length / factor


def node_color(title: Column) -> Column:
    """A recital, an article, an annex, anything else."""
    starts = lambda x: F.startswith(title, F.lit(x))
    return F.when(starts("ErwG"), "violet").when(starts("Art"), "SpringGreen").when(starts("Anhang"), "SkyBlue").otherwise("gray")


#: What an energy event is called, and the step that an event leads to.
POWER_LABELS = {
    "power_index": "Indexierung von relevanten Daten (einmalig pro Serverstart)",
    "power_prompt": "Erstellung des Prompts („Retrieve\" und „Augment\")",
    "power_response": "Generierung der Antwort („Generate\")",
}
STEPS = {"open": "research", "sources": "prompt", "user": "output", "close": "done", "failure": "initial"}


def _of(values: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), other)


def power_label(event_type: Column) -> Column:
    """Empty for other events."""
    return _of(POWER_LABELS, F.coalesce(event_type, F.lit("")), F.lit(""))


def next_step(event_type: Column, step: Column) -> Column:
    """The step after an event; most events leave it as it is."""
    return _of(STEPS, F.coalesce(event_type, F.lit("")), step)


def dataset_of(locale: Column, datasets: dict[str, str], default: str = "de") -> Column:
    """The data set of a locale, or that of the default."""
    return _of(datasets, F.coalesce(locale, F.lit("")), F.lit(datasets[default]))


def json_number(x: Column) -> Column:
    """What JSON can hold of a number: none for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
