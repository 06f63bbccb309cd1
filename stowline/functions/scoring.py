"""Scores, confidence and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What each doubt multiplies a score by.
UNCONFIRMED, DUPLICATE_RISK, CARRIED, STALE_CONSUMABLE, DROPPED = 0.5, 0.8, 0.5, 0.5, 0.3
UNNAMED_LOCATION, LOST_TRACK, CONTAINER_HOP, OPENED_HERE, NEVER_PLACED, UNKNOWN_CONTAINER = 0.7, 0.3, 0.9, 0.8, 0.8, 0.6
SURVIVAL_DEFAULT, SURVIVAL_FLOOR, SURVIVAL_LEAST = 0.5, 0.2, 5
SHELF_DAYS, STALE_DAYS = 7, 30
HIGH, MEDIUM = 0.7, 0.4


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def factor(when: Column, value: float) -> Column:
    return F.when(when, F.lit(float(value))).otherwise(F.lit(1.0))


# What is said of a placement, in this order; {days} is its age.
CAVEATS = {
    "unconfirmed": "the game never confirmed the move that put it here",
    "duplicate_risk": "we saw this arrive but never saw where it came from, so it may have been counted twice",
    "first_seen": "first seen being moved out of somewhere we had no record of — looted, bought, or there before the logs begin",
    "carried": "last picked up in hand to use — food, drink and handed-in items are used up without a log line",
    "stale_consumable": "food, drink and medical items are used up without a log line, and this one has not moved in {days} days — it may be gone",
    "dropped": "dropped on the floor — kept if in a hangar, cleared away anywhere else, and the logs do not say which",
    "stale": "last seen {days} days ago",
    "ambiguous": "the log did not name which of several identical items was moved, so this instance may be one of its twins",
}


def caveat(name: str, seconds: Column) -> Column:
    """The caveat's sentence for a placement of that age."""
    return F.replace(F.lit(CAVEATS[name]), F.lit("{days}"), F.round(seconds / 86400).cast("long").cast("string"))


def product(factors: list[Column]) -> Column:
    return F.aggregate(F.array(*factors), F.lit(1.0), lambda a, x: a * x)


def confidence_rank(score: Column) -> Column:
    """2 high, 1 medium, 0 low; pooled rows take the least."""
    return F.when(score >= HIGH, 2).when(score >= MEDIUM, 1).otherwise(0)


def confidence_label(rank: Column) -> Column:
    return F.when(rank == 2, "High").when(rank == 1, "Medium").otherwise("Low")


def survival_factor(survived: Column | str, checked: Column | str) -> Column:
    """Share of placements that an update left alone, once enough were checked."""
    s, n = _c(survived), _c(checked)
    return F.when(n >= SURVIVAL_LEAST, F.least(F.lit(1.0), F.greatest(F.lit(SURVIVAL_FLOOR), s / n))).otherwise(F.lit(SURVIVAL_DEFAULT))


def size_label(capacity: Column, key: Column) -> Column:
    """Capacity in micro-SCU as a container's label, or its key where it is unknown."""
    scu, centi = F.round(capacity / 1_000_000, 2), F.round(capacity / 10_000, 2)
    text = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.when(capacity >= 1_000_000, F.concat(text(scu), F.lit(" SCU container"))).when(capacity > 0, F.concat(text(centi), F.lit(" cSCU container"))).otherwise(F.concat(F.lit("container "), key))


def time_ago(at: Column, now: Column) -> Column:
    """How long ago, rounded to the unit; the day itself from thirty days on."""
    s = F.unix_seconds(now) - F.unix_seconds(at)
    in_ = lambda unit, name: F.concat(F.round(s / unit).cast("long").cast("string"), F.lit(name))
    return F.when(s < 60, "just now").when(s < 3600, in_(60, " min ago")).when(s < 86400, in_(3600, " h ago")).when(s < 30 * 86400, in_(86400, " d ago")).otherwise(F.date_format(at, "yyyy-MM-dd"))


# Type labels by category; labels that end in (Armor) are armor too.
CATEGORIES = {
    "Armor": ["Armor", "Backpack", "Suit"],
    "Clothing": ["Jacket", "Legs", "Shirt", "Shoes", "Hat", "Gloves", "Char Accessory Eyes", "Char Head Piercings"],
    "Weapons": ["FPS Weapon", "Weapon Attachment", "Grenade"],
    "Consumables": ["Food", "Drink", "Bottle", "Fps Consumable"],
    "ShipParts": [
        "Power Plant", "Cooler", "Shield", "Quantum Drive", "Jump Drive", "Radar", "Weapon Gun", "Weapon Defensive", "Weapon Mining", "Missile", "Missile Launcher", "Bomb", "Bomb Launcher", "Turret", "Utility Turret",
        "Fuel Tank", "Quantum Fuel Tank", "External Fuel Tank", "Fuel Intake", "Main Thruster", "Manneuver Thruster", "Life Support Generator", "Quantum Interdiction Generator", "E M P", "Tractor Beam", "Salvage Head", "Salvage Modifier",
    ],
}


def item_category(type_label: Column) -> Column:
    """The category of a type label, whatever its case and the blanks around it; Other for any other and for none."""
    label = F.lower(F.trim(type_label))
    out = F.when(label.endswith("(armor)"), "Armor")
    for name, labels in CATEGORIES.items():
        out = out.when(label.isin(*[x.lower() for x in labels]), name)
    return out.otherwise("Other")
