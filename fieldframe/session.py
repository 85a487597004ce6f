"""Spark session with the settings the engine expects, and small helpers: log, timeit, signature."""

from __future__ import annotations

import functools
import inspect
import sys
import time
import traceback
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession


def get_spark(app: str = "fieldframe", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode stays on.

    Keyword arguments override settings, with double underscores for dots:
    get_spark(spark__sql__shuffle__partitions="64").
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def close_spark() -> None:
    session = SparkSession.getActiveSession()
    if session is not None:
        session.stop()


LEVELS = ("INFO", "ERROR", "WARNING", "DEBUG")


def line_break(char: str = "=", n: int = 120) -> None:
    print(char * n)


def log(*values, level: str | None = None, out=None, exception: bool = True, full_traceback: bool = False, frames: int = 5) -> None:
    """Write a line with the time, the level and the values to standard output, or append it to a file or stream.

    Within an except block the exception follows, with its last frames (all,
    with full_traceback).
    """
    if level is not None and level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    text = " ".join([datetime.now().strftime("%Y-%m-%d %H:%M:%S"), *([f"[{level}]"] if level else []), *map(str, values)])
    kind, error, trace = sys.exc_info()
    if exception and error is not None:
        text += "\n" + "".join(traceback.format_exception(kind, error, trace, limit=None if full_traceback else -frames)).rstrip()
    if out is None:
        print(text)
    elif hasattr(out, "write"):
        out.write(text + "\n")
    else:
        with open(out, "a", encoding="utf-8") as file:
            file.write(text + "\n")


def timeit(func: Callable) -> Callable:
    """Print how long each call takes, in seconds, minutes, hours or days."""

    @functools.wraps(func)
    def wrapper(*args, **kwargs):
        began = time.perf_counter()
        result = func(*args, **kwargs)
        spent = time.perf_counter() - began
        size, unit = next((s, u) for s, u in ((86400, "days"), (3600, "hours"), (60, "minutes"), (0, "seconds")) if spent > s or not s)
        print(f"[ {func.__name__} ] finished in {spent / max(size, 1):.2f} {unit}")
        return result

    return wrapper


def signature(func: Callable) -> dict:
    """A function's parameters and their defaults (None where there is none)."""
    return {k: None if p.default is p.empty else p.default for k, p in inspect.signature(func).parameters.items()}
