"""Loan, cost and yield formulas (F-13)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conventions: acquisition fees, works, charges, and the tax base as shares of price or rent (fixed values).
NOTARY, WORKS, CHARGES, TAX_BASE = 0.075, 0.10, 0.10, 0.5


def annuity(capital: Column, yearly_rate: Column, years: Column) -> Column:
    """Monthly payment of a loan; 0 without capital, an equal share at no interest."""
    n, i = years * 12, yearly_rate / 12
    growth = F.pow(1 + i, n)
    return F.when(capital <= 0, 0.0).when(i == 0, capital / n).otherwise(capital * i * growth / (growth - 1))


def insurance(capital: Column, yearly_rate: Column) -> Column:
    return capital * yearly_rate / 12


def acquisition_cost(price: Column, notary: float = NOTARY, works: float = WORKS) -> Column:
    return price * (1 + notary + works)


def gross_yield(yearly_rent: Column, cost: Column) -> Column:
    return F.when(cost != 0, yearly_rent / cost * 100).otherwise(0.0)


def net_yield(yearly_rent: Column, yearly_charges: Column, cost: Column) -> Column:
    return F.when(cost != 0, (yearly_rent - yearly_charges) / cost * 100).otherwise(0.0)


def property_tax(yearly_rent: Column, rate_percent: Column, base: float = TAX_BASE) -> Column:
    return yearly_rent * base * rate_percent / 100


def cash_flow(rent: Column, payment: Column, charges: Column, tax: Column) -> Column:
    """What a month leaves."""
    return rent - payment - charges - tax
