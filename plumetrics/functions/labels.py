"""Labels derived from latitude, month, hour and scaled values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quarter of the year -> season name north and south of the tropics.
SEASON_MONTHS = {
    (12, 1, 2): ("Winter", "Summer"),
    (3, 4, 5): ("Spring", "Autumn"),
    (6, 7, 8): ("Summer", "Winter"),
    (9, 10, 11): ("Autumn", "Spring"),
}
# All labels.
SEASONS = (
    "Autumn (North)", "Autumn (South)", "Other", "Spring (North)", "Spring (South)", "Summer (North)",
    "Summer (South)", "Tropical Dry", "Tropical Wet", "Winter (North)", "Winter (South)",
)
TIMES_OF_DAY = ("Night", "Morning", "Afternoon", "Evening")
# Fixed value.
COASTAL_KM = 50


def season(latitude: Column, month: Column) -> Column:
    """Season or climate zone; anything unmatched, missing latitude too, is "Other"."""
    tropics = latitude.between(-20, 20)
    label = F.when(tropics & month.between(5, 10), "Tropical Wet").when(tropics, "Tropical Dry")
    for side, inside in enumerate([(latitude > 20) & (latitude <= 60), (latitude >= -60) & (latitude < -20)]):
        for months, names in SEASON_MONTHS.items():
            label = label.when(inside & month.isin(*months), f"{names[side]} ({('North', 'South')[side]})")
    return label.otherwise("Other")


def time_of_day(hour: Column) -> Column:
    """Quarter of the local day; a missing hour is "Evening"."""
    return F.when(hour < 6, "Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening")


def hemisphere(season_label: Column) -> Column:
    return (
        F.when(season_label.endswith("(North)"), "North")
        .when(season_label.endswith("(South)"), "South")
        .when(season_label.startswith("Tropical"), "Tropical")
    )


def coastal_status(coastal_km: Column) -> Column:
    return F.when(coastal_km < COASTAL_KM, "Coastal").when(coastal_km >= COASTAL_KM, "Inland")


def coast_shape(coastal: Column) -> Column:
    """Shape of a point by its coastal flag; missing stays missing."""
    return F.when(coastal, "Coastal").when(~coastal, "Inland")


def split_quadrant(sif: Column, co2: Column, sif_threshold: Column, co2_threshold: Column) -> Column:
    """Four labels by position above or not above two thresholds; missing stays missing."""
    label = F.when(sif.isNull() | co2.isNull(), None)
    for sif_name, sif_side in (("High", sif > sif_threshold), ("Low", sif <= sif_threshold)):
        for co2_name, co2_side in (("High", co2 > co2_threshold), ("Low", co2 <= co2_threshold)):
            label = label.when(sif_side & co2_side, f"{sif_name} SIF\n{co2_name} CO2")
    return label


def upper_quartile_quadrant(conc: Column, emissions: Column, conc_q3: Column, emissions_q3: Column) -> Column:
    """Concentration x emissions quadrant; a missing value counts as low."""
    high_conc = F.coalesce(conc > conc_q3, F.lit(False))
    high_em = F.coalesce(emissions > emissions_q3, F.lit(False))
    return (
        F.when(high_conc & high_em, "HIGH_both")
        .when(high_conc, "LOW_emissions_HIGH_conc")
        .when(high_em, "HIGH_emissions_LOW_conc")
        .otherwise("LOW_both")
    )


def iqr_zone(scaled: Column) -> Column:
    """Zone of an IQR-scaled value: 0 is the first quartile, 1 the third."""
    return F.when(scaled < 0, "below_q1").when(scaled <= 1, "middle").when(scaled > 1, "above_q3")


def recode(label: Column, mapping: dict[str, str]) -> Column:
    """Replace labels found in ``mapping``; leave the others."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, label), label)
