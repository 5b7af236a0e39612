"""Pitch coordinates. Sources use 0-100 on both axes, the target pitch is 120 x 80."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH = 1.2, 0.8


def scale_x(x: Column) -> Column:
    return x * LENGTH


def scale_y(y: Column) -> Column:
    return y * WIDTH


def mirror_x(x: Column) -> Column:
    return 120 - x * LENGTH


def mirror_y(y: Column) -> Column:
    return 80 - y * WIDTH


def pass_angle(x: Column, y: Column, end_x: Column, end_y: Column) -> Column:
    """Direction in degrees on the target pitch; 0 is straight ahead."""
    return F.degrees(F.atan2((end_y - y) * WIDTH, (end_x - x) * LENGTH))


def marker_size(xg: Column) -> Column:
    return xg * 300 + 100
