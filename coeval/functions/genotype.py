"""Genotype strings and INFO fields, parsed with built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = -1
NON_BIALLELIC = -2
HETEROZYGOUS = -3


def decode_genotype(gt: Column, heterozygous: str = "error") -> Column:
    """One observed allele per individual: 0, 1, NULL (not callable) or an error code.

    Any missing allele makes the individual uncallable. A mixed call is either
    an error or uncallable, by ``heterozygous``. The usual spellings come first
    so that the patterns run only for rare ones.
    """
    if heterozygous not in ("error", "missing"):
        raise ValueError("heterozygous must be 'error' or 'missing'")
    unphased = F.translate(gt, "|", "/")
    mixed = F.lit(None).cast("int") if heterozygous == "missing" else F.lit(HETEROZYGOUS)
    return (
        F.when(gt.isin("0", "0/0", "0|0"), F.lit(0))
        .when(gt.isin("1", "1/1", "1|1"), F.lit(1))
        .when(unphased.rlike(r"(^|/)\.(/|$)"), F.lit(None).cast("int"))
        .when(~unphased.rlike(r"^[0-9]+(/[0-9]+)*$"), F.lit(INVALID))
        .when(unphased.rlike(r"^0*0(/0*0)*$"), F.lit(0))
        .when(unphased.rlike(r"^0*1(/0*1)*$"), F.lit(1))
        .when(unphased.rlike(r"^0*[01](/0*[01])*$"), mixed)
        .otherwise(F.lit(NON_BIALLELIC))
    )


def info_value(info: Column, key: str) -> Column:
    """Value of ``key`` in a ``;``-separated INFO field, the last one when repeated.

    NULL when the key is absent or is a bare flag.
    """
    holding = F.filter(
        F.split(info, ";"),
        lambda item: F.substring_index(item, "=", 1) == F.lit(key),
    )
    last = F.try_element_at(holding, F.lit(-1))
    pattern = f"^{re.escape(key)}="
    return F.when(last.rlike(pattern), F.regexp_replace(last, pattern, ""))


def sample_genotype(sample: Column, gt_index: Column) -> Column:
    """GT sub-field of one sample column; a short column is not callable."""
    return F.coalesce(
        F.try_element_at(F.split(sample, ":"), (gt_index + 1).cast("int")), F.lit(".")
    )
