"""Masked references and role-based views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_holder(name: Column) -> Column:
    """Initials of every word followed by at least three stars."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: F.length(w) > 0)
    hidden = F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), _stars(F.greatest(F.lit(3), F.length(w) - 1))))
    text = F.array_join(hidden, " ")
    return F.when(text == "", "****").otherwise(text)


def mask_imei(imei: Column) -> Column:
    return F.concat(F.lit("**** ****"), F.right(imei, F.lit(4)))


def mask_ref(account: Column) -> Column:
    """Text before the first dash, stars, last four characters."""
    return F.concat(F.element_at(F.split(account, "-"), 1), F.lit("-****-"), F.right(account, F.lit(4)))


def mask_account(account: Column, keep_start: int = 4, keep_end: int = 2) -> Column:
    hidden = F.length(account) - keep_start - keep_end
    masked = F.concat(F.substring(account, 1, keep_start), _stars(F.greatest(hidden, F.lit(0))), F.right(account, F.lit(keep_end)))
    return F.when(hidden <= 0, account).otherwise(masked)


def display_id(bank: Column, account: Column) -> Column:
    return F.concat(bank, F.lit(" ****"), F.right(account, F.lit(4)))


def summary_view(profiles: DataFrame, can_see_pii: bool) -> DataFrame:
    """Account summaries; holder and account are masked unless the role may see them."""
    code = F.concat(F.lit("AC-"), F.lpad(F.col("account").cast("string"), 8, "0"))
    return profiles.select(
        (code if can_see_pii else mask_ref(code)).alias("account_ref"),
        (F.col("holder") if can_see_pii else mask_holder(F.col("holder"))).alias("holder"),
        "bank", "segment", "score", "severity",
    )
