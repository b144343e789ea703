"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.operators.cleaning import typed_accounts
from keepwell.plans import views
from keepwell.plans.views import table

DIGITS = 9


def raw_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return views.accounts(spark, sf).drop("k", "pts")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return typed_accounts(raw_accounts(spark, sf))


def uploaded(spark: SparkSession, sf: str) -> DataFrame:
    """The telecom table as stored data, for jobs of several passes."""
    return views.stored_accounts(spark, sf).drop("k", "pts")


def stable(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles whose last digits depend on the order of summation, rounded for display."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# typed accounts in SQL: `ta` has total, label
TYPED = """ta as (select *, case when lower(trim(Churn)) = 'yes' then 1 when lower(trim(Churn)) = 'no' then 0 end as label,
  try_cast(nullif(trim(TotalCharges), '') as double) as total from accounts)"""

CHARGES = "sum(cast(round(MonthlyCharges * 1e2) as bigint))::double / count(MonthlyCharges) / 1e2"
RATE = "sum(label)::double * 1e2 / count(label)"
BAND = """case when tenure <= -1 then null when tenure <= 12 then '0–12 months' when tenure <= 24 then '13–24 months'
  when tenure <= 48 then '25–48 months' when tenure is not null then '49+ months' end"""
TIER = """case when probability < 15e-2 then 'LOW' when probability < 33e-2 then 'MEDIUM'
  when probability < 6e-1 then 'HIGH' when probability is not null then 'CRITICAL' end"""

__all__ = ["BAND", "CHARGES", "RATE", "TIER", "TYPED", "accounts", "raw_accounts", "stable", "table", "uploaded", "views"]
