"""Scalar functions: code bytes, units, psychometric curves, ranges and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def high_byte(code: Column) -> Column:
    return F.shiftright(code, 8)


def low_byte(code: Column) -> Column:
    return code.bitwiseAND(255)


def condition_id(high: Column, low: Column) -> Column:
    return (high - 192) * 64 + (low - 192)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rescale(x: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * (to_high - to_low) + to_low


def sigmoid(x: Column, middle: float, slope: float) -> Column:
    return 1 / (1 + F.exp(-(x - middle) / slope))


def weibull(x: Column, scale: float, shape: float, guess: float = 0.5, lapse: float = 0.0) -> Column:
    return guess + (1 - guess - lapse) * (1 - F.exp(-F.pow(x / scale, shape)))


def or_zero(x: Column) -> Column:
    """0 for null, NaN and infinite values."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def volumes_to_ms(on: Column, off: Column, tr: float) -> tuple[Column, Column]:
    """Onsets and offsets counted in volumes, as milliseconds."""
    return (on - 1) * tr, off * tr


def label_of(name: Column) -> Column:
    """A name as an identifier: other characters become _, and a leading digit gets one before it."""
    plain = F.regexp_replace(F.trim(name), "[^A-Za-z0-9_]", "_")
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def talairach(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Template coordinates to atlas coordinates, by one linear map above the origin's plane and another below it."""
    up = z >= 0
    return 0.99 * x, F.when(up, 0.9688 * y + 0.0460 * z).otherwise(0.9688 * y + 0.0420 * z), F.when(up, -0.0485 * y + 0.9189 * z).otherwise(-0.0485 * y + 0.8390 * z)
