"""Subtracting the absorbance of dissolved iron."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tannin.functions.missing import drop_incomplete
from tannin.operators.merging import merge_tables
from tannin.operators.slopes import BAND_275, BAND_350, IN_ANY_BAND, within
from tannin.operators.spectra import analyte_slice, suva

# Absorbance per unit of iron.  350 nm has one value for its own
# SUVA and another as a member of the 350-400 nm band.
IRON_AT_254 = 0.0653
IRON_AT_350 = 0.0323
IRON_IN_BAND_275 = 0.0570
IRON_IN_BAND_350 = 0.0118

# SQL text: the coefficient for a row's wavelength, NULL outside both bands
BAND_COEFFICIENT = (
    f"case when {within(BAND_275)} then {IRON_IN_BAND_275}d "
    f"when {within(BAND_350)} then {IRON_IN_BAND_350}d end"
)


def iron_free(absorbance: str, coefficient: float | str, iron: str = "Fe") -> str:
    """SQL text: absorbance without that of the iron."""
    return f"({absorbance} - double({coefficient}) * {iron})"


def fe_join(spectrum: DataFrame, chem: DataFrame) -> DataFrame:
    """Complete spectrum rows of samples with iron.

    An inner join on known iron: what a left join followed by dropping
    incomplete rows gives, without carrying the unmatched rows.
    """
    iron = drop_incomplete(analyte_slice(chem, "Fe"), ["Fe"])
    return drop_incomplete(merge_tables(spectrum, iron, ["sampleID"]))


def fe_corrected_spectrum(with_iron: DataFrame) -> DataFrame:
    """Corrected absorbance and SUVA in the two slope bands, in one pass."""
    corrected = F.expr(iron_free("absorbance", BAND_COEFFICIENT))
    return (
        with_iron.where(IN_ANY_BAND)
        .withColumn("correctedAbsorbance", corrected)
        .withColumn("correctedSUVA", suva("correctedAbsorbance", "DOC"))
    )
