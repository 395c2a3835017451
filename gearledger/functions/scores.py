"""Scores, flags and estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gearledger.functions.numbers import js_round


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def completeness_open(brand: Column, mpns: Column, spec_count: Column, image: Column, description: Column) -> Column:
    score = (
        F.lit(25) + _points(filled(brand), 15) + _points(F.size(mpns) > 0, 25)
        + F.least(F.lit(25), spec_count * 3) + _points(filled(image), 5) + _points(filled(description), 5)
    )
    return F.least(F.lit(100), score)


def confidence_open(source_confidence: Column, completeness: Column) -> Column:
    return F.least(F.lit(100), js_round(source_confidence * 0.75 + completeness * 0.25).cast("int"))


def completeness_export(spec_count: Column, image: Column, description: Column) -> Column:
    score = F.lit(65) + F.least(F.lit(20), spec_count * 2) + _points(filled(image), 10) + _points(filled(description), 5)
    return F.least(F.lit(100), score)


def completeness_curated(mpn: Column, spec_count: Column) -> Column:
    return F.least(F.lit(100), F.lit(35) + _points(filled(mpn), 25) + F.least(F.lit(35), spec_count * 3))


def confidence_blend(source_confidence: Column, completeness: Column) -> Column:
    """Three parts source, one part completeness."""
    return js_round((source_confidence * 3 + completeness) / 4).cast("int")


def needs_review(mpns: Column, spec_count: Column) -> Column:
    return (F.size(mpns) == 0) | (spec_count < 2)


def value_score(performance: Column, used: Column, new: Column) -> Column:
    """Performance per price in percent; null when either side is missing or zero. Used price first."""
    price = F.coalesce(used, new)
    return F.when((performance != 0) & (price != 0), js_round(performance / price * 100))


# Power model of a system.
CPU_PEAK_FACTOR = 1.35
BASE_LOAD_W = 85.0
PSU_STEP_W = 50.0


def cpu_peak(tdp: Column) -> Column:
    return js_round(tdp * F.lit(CPU_PEAK_FACTOR))


def system_draw(tdp: Column, gpu_power: Column) -> Column:
    """Draw used by the compatibility rules: the processor peak is rounded first."""
    return js_round(cpu_peak(F.coalesce(tdp, F.lit(0.0))) + F.coalesce(gpu_power, F.lit(0.0)) + F.lit(BASE_LOAD_W))


def summary_draw(tdp: Column, gpu_power: Column) -> Column:
    """Draw used by the build summary: nothing is rounded before the end."""
    return F.coalesce(gpu_power, F.lit(0.0)) + F.coalesce(tdp, F.lit(0.0)) * F.lit(CPU_PEAK_FACTOR) + F.lit(BASE_LOAD_W)


def recommended_psu(draw: Column) -> Column:
    return F.ceil(draw * F.lit(1.35) / F.lit(PSU_STEP_W)).cast("double") * F.lit(PSU_STEP_W)


def hit_confidence(score: Column) -> Column:
    return F.when(score >= 0.72, F.lit("Moyenne")).otherwise(F.lit("Faible"))
