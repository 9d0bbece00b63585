"""Fetching raster files through a transport that the caller hands in.

transport(cat, key) returns the bytes of a year (key "2018") or a day (key
"01022018"). Files of at least 1 KB that are there already are not fetched again.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import SparkSession

from skygrid.functions.calendar import parse_range, total_days
from skygrid.model import GridFrame
from skygrid.sources.grd import open_data, open_real_data
from skygrid.sources.naming import daily_path, yearly_path

Transport = Callable[[str, str], bytes]
LEAST_BYTES = 1024


def _fetch(path: str, cat: str, key: str, transport: Transport) -> None:
    if os.path.exists(path) and os.path.getsize(path) >= LEAST_BYTES:
        return
    raw = transport(cat, key)
    if not raw:
        raise ValueError(f"nothing was sent for {cat} {key}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "wb") as f:
        f.write(raw)
    os.replace(path + ".part", path)


def http_transport(urls: dict[str, tuple[str, str]]) -> Transport:
    """A transport that posts the key to a form: urls gives (url, field) of each kind."""

    def send(cat: str, key: str) -> bytes:
        from urllib import parse, request

        url, field = urls[cat]
        with request.urlopen(request.Request(url, parse.urlencode({field: key}).encode())) as r:  # noqa: S310
            return r.read()

    return send


def get_data(spark: SparkSession, cat: str, start, end=None, transport: Transport | None = None, style: str = "yearwise", folder: str = ".", sub_dir: bool = False) -> GridFrame:
    """Fetch the yearly files of the range, then open them."""
    if transport is None:
        raise ValueError("a transport is needed")
    a, b = parse_range(start, end)
    if sub_dir:
        os.makedirs(os.path.join(folder, cat), exist_ok=True)
    for y in range(a.year, b.year + 1):
        _fetch(yearly_path(y, cat, style, folder), cat, str(y), transport)
    return open_data(spark, cat, start, end, style, folder)


def get_real_data(spark: SparkSession, cat: str, start, end=None, transport: Transport | None = None, folder: str = ".") -> GridFrame:
    """Fetch the daily files of the range, then open them."""
    import datetime as dt

    if transport is None:
        raise ValueError("a transport is needed")
    a, b = parse_range(start, end)
    for k in range(total_days(a, b)):
        day = a + dt.timedelta(k)
        _fetch(daily_path(day, cat, folder), cat, day.strftime("%d%m%Y"), transport)
    return open_real_data(spark, cat, start, end, folder)
