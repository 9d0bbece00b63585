"""Names of raster files."""

from __future__ import annotations

import datetime as dt
import os

#: File names of yearly files by kind, in yearwise and in classic style, and of daily files.
YEARWISE = {"rain": "{y}.grd", "tmin": "{y}.GRD", "tmax": "{y}.GRD"}
CLASSIC = {"rain": "Rainfall_ind{y}_rfp25.grd", "tmax": "Maxtemp_MaxT_{y}.GRD", "tmin": "Mintemp_MinT_{y}.GRD"}
DAILY = {"rain": "rain_ind0.25_%y_%m_%d.grd", "rain_gpm": "%d%m%Y.grd", "tmax": "max%d%m%Y.grd", "tmin": "min%d%m%Y.grd"}


def _folder(cat: str, folder: str) -> str:
    sub = os.path.join(folder, cat)
    return sub if os.path.isdir(sub) else folder


def yearly_path(year: int, cat: str, style: str | None, folder: str) -> str:
    names = YEARWISE if style == "yearwise" else CLASSIC
    if cat not in names:
        raise ValueError(f"no yearly files of {cat}")
    return os.path.join(_folder(cat, folder), names[cat].format(y=year))


def daily_path(day: dt.date, cat: str, folder: str) -> str:
    if cat not in DAILY:
        raise ValueError(f"no daily files of {cat}")
    return os.path.join(_folder(cat, folder), day.strftime(DAILY[cat]))
