"""Column expressions that bring units, roles and identifiers of nested reaction records to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exchange format's enum names, and what they mean here.
ROLES = {
    "REACTANT": "reactant",
    "REAGENT": "reagent",
    "SOLVENT": "solvent",
    "CATALYST": "catalyst",
    "INTERNAL_STANDARD": "internal_standard",
    "PRODUCT": "product",
    "BYPRODUCT": "product",
    "SIDE_PRODUCT": "product",
    "WORKUP": "additive",
}
PRESSURE_TO_BAR = {
    "BAR": 1.0,
    "ATMOSPHERE": 1.01325,
    "PSI": 0.0689476,
    "KPSI": 68.9476,
    "KILOPASCAL": 0.01,
    "PASCAL": 1e-5,
    "MM_HG": 0.00133322,
    "TORR": 0.00133322,
}
MASS_TO_GRAM = {"KILOGRAM": 1000.0, "GRAM": 1.0, "MILLIGRAM": 0.001, "MICROGRAM": 1e-6}
VOLUME_TO_ML = {"LITER": 1000.0, "MILLILITER": 1.0, "MICROLITER": 0.001, "NANOLITER": 1e-6}
TIME_TO_SECONDS = {"HOUR": 3600.0, "MINUTE": 60.0, "SECOND": 1.0, "DAY": 86400.0}
MOLES = {"MOLE": 1.0, "MILLIMOLE": 0.001, "MICROMOLE": 1e-6, "NANOMOLE": 1e-9}
ATMOSPHERES = ("AIR", "NITROGEN", "ARGON", "OXYGEN", "HYDROGEN", "CARBON_MONOXIDE", "CARBON_DIOXIDE", "METHANE", "AMMONIA", "OZONE", "ETHYLENE", "ACETYLENE")
KEY_PATTERN = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"


def lookup(value: Column, table: dict) -> Column:
    """table[value], null where value is null or unknown."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def norm_temperature(value: Column, unit: Column) -> Column:
    """Degrees Celsius, two digits; null for unknown units."""
    celsius = F.when(unit == "CELSIUS", value).when(unit == "FAHRENHEIT", (value - 32) * 5.0 / 9.0).when(unit == "KELVIN", value - 273.15)
    return F.round(celsius, 2)


def norm_pressure(value: Column, unit: Column) -> Column:
    """Bar, four digits; null for unknown units."""
    return F.round(value * lookup(unit, PRESSURE_TO_BAR), 4)


def norm_amount(amount: Column, table: dict, digits: int) -> Column:
    """A struct<value, unit> in the table's base unit; null unless the value is positive and the unit known."""
    return F.when(amount["value"] > 0, F.round(amount["value"] * lookup(amount["unit"], table), digits))


def norm_time(times: Column) -> Column:
    """Seconds, one digit, of the first of an array of struct<value, unit> that has a positive value and a known unit."""
    usable = F.filter(times, lambda t: (t["value"] > 0) & lookup(t["unit"], TIME_TO_SECONDS).isNotNull())
    first = F.try_element_at(usable, F.lit(1))
    return F.round(first["value"] * lookup(first["unit"], TIME_TO_SECONDS), 1)


def map_role(role: Column) -> Column:
    return lookup(role, ROLES)


def map_atmosphere(name: Column) -> Column:
    return lookup(name, {a: a.lower() for a in ATMOSPHERES})


def pick_identifier(identifiers: Column, first: str = "REACTION_SMILES", otherwise: str = "REACTION_CXSMILES") -> Column:
    """The first value of type `first`, else the last of type `otherwise`, of an array of struct<type, value>."""
    preferred = F.try_element_at(F.filter(identifiers, lambda i: i["type"] == first), F.lit(1))
    other = F.try_element_at(F.filter(identifiers, lambda i: i["type"] == otherwise), F.lit(-1))
    return F.coalesce(preferred["value"], other["value"])


def measured(outcomes: Column, kind: str) -> Column:
    """All positive percentages of a kind, in order, over outcomes, products and measurements."""
    products = F.flatten(F.transform(outcomes, lambda o: o["products"]))
    found = F.flatten(F.transform(products, lambda p: F.coalesce(p["measurements"], F.array().cast("array<struct<type:string,pct:double>>"))))
    return F.transform(F.filter(found, lambda m: (m["type"] == kind) & (m["pct"] > 0)), lambda m: m["pct"])


def best_yield(outcomes: Column) -> Column:
    return F.round(F.array_max(measured(outcomes, "YIELD")), 2)


def last_selectivity(outcomes: Column) -> Column:
    """The last positive selectivity as text."""
    return F.round(F.try_element_at(measured(outcomes, "SELECTIVITY"), F.lit(-1)), 2).cast("string")


def valid_key(key: Column) -> Column:
    return F.coalesce(key.rlike(KEY_PATTERN), F.lit(False))
