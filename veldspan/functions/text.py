"""Text, time and schedule expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a log line says when a run has crashed.
CRASH = r"Traceback|CRITICAL|CUDA out of memory|OOM|Killed|loss:[nN][aA][nN]"


def fixed(x: str, digits: int = 2) -> Column:
    """A number (SQL text) with fixed decimals, half to even on the binary value as printf does."""
    return F.expr(f"format_number({x}, '0.{'0' * digits}')")


def fixed_width(x: str, width: int = 9) -> Column:
    """A number (SQL text) with nine decimals, cut to ``width`` characters."""
    return F.substring(fixed(x, 9), 1, width)


def unix_lines(text: Column) -> Column:
    """Carriage returns as line feeds, as progress bars in logs need it."""
    return F.translate(text, "\r", "\n")


def structured_name(name: Column, fields: tuple[str, ...], sep: str = "-") -> Column:
    """The parts of a composed name as a struct; null where their number is another."""
    parts = F.split(name, re.escape(sep))
    return F.when(F.size(parts) == len(fields), F.struct(*[parts[i].alias(f) for i, f in enumerate(fields)]))


def local_time(ts: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC time as text in a time zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


# the sentences that prompts start with are fixed values
def alignment_prompt(similarity: str, caption: Column) -> Column:
    return F.concat(F.lit("Text alignment is "), fixed(similarity), F.lit(". "), caption)


def consistency_prompt(similarity: str, caption: Column) -> Column:
    return F.concat(F.lit("[consistency="), fixed(similarity), F.lit("] "), caption)


def safe_name(text: Column, limit: int = 196) -> Column:
    """A file name: spaces and slashes become underscores, dots go, the rest is cut."""
    return F.substring(F.translate(text, " /.", "__"), 1, limit)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def flat_id(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit("_")), F.lit(".mp3"), F.lit(".wav"))


def duration(seconds: Column) -> Column:
    """``Nd Mh`` from a day on, ``Nh Mm`` below."""
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s / 3600), F.floor(s / 60)
    long = F.concat(days.cast("string"), F.lit("d "), (hours - days * 24).cast("string"), F.lit("h"))
    short = F.concat(hours.cast("string"), F.lit("h "), (minutes - hours * 60).cast("string"), F.lit("m"))
    return F.when(s >= 86400, long).otherwise(short)


def crashed(line: Column) -> Column:
    return line.rlike(CRASH)


def metric_line(line: Column, key: str) -> Column:
    """The number of a ``key: value`` line; null for other lines."""
    return F.try_to_number(F.nullif(F.regexp_extract(line, rf"^{key}:\s*(-?[0-9.]+)", 1), F.lit("")), F.lit("S99999D999999")).cast("double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cosine_anneal(step: Column, steps: int) -> Column:
    return (1 + F.cos(F.lit(3.141592653589793) * step / steps)) / 2


def learning_rate(step: Column, steps: int, warmup: int, kind: str) -> Column:
    """Linear warm-up, then constant, poly (power 0.9) or step (a tenth at 80 % and again at 90 %)."""
    warm = (step + 1) / (warmup + 1)
    later = {
        "constant": F.lit(1.0),
        "poly": F.pow(1 - step / steps, F.lit(0.9)),
        "step": F.when(step >= int(steps * 0.9), F.lit(0.01)).when(step >= int(steps * 0.8), F.lit(0.1)).otherwise(F.lit(1.0)),
    }[kind]
    return F.when(step < warmup, warm).otherwise(later)


def renamed_keys(weights: Column, prefix: str, old: str, new: str) -> Column:
    """A map without a key prefix, and with a part of its keys replaced."""
    return F.transform_keys(weights, lambda k, _: F.replace(F.regexp_replace(k, f"^{prefix}", ""), F.lit(old), F.lit(new)))
