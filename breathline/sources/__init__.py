"""Readings, stations, saved frames and published tables."""

from .conform import accepted, checked_readings, conform_readings, rejected
from .readings import read_readings, select_readings, write_readings
from .saved import load_frame, load_site_years, save_frame
from .stations import read_stations

__all__ = [
    "accepted",
    "checked_readings",
    "conform_readings",
    "load_frame",
    "load_site_years",
    "read_readings",
    "read_stations",
    "rejected",
    "save_frame",
    "select_readings",
    "write_readings",
]
