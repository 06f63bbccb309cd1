"""Column expressions that read the log's names and handles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of ports and parts of class names.
PART_PORTS = ["helmet_visor", "universal_necksock", "magazine_attach", "optics_attach", "barrel_attach", "underbarrel_attach", "module_attach", "canister_attach"]
CHARACTER_PORTS = [
    "Body_ItemPort", "Head_ItemPort", "Hair_ItemPort", "Beard_ItemPort", "Eyebrow_ItemPort", "Eyelashes_ItemPort", "Eyes_ItemPort", "Eyedetail_ItemPort", "Teeth_ItemPort",
    "Universal_Scalp_ItemPort", "Piercings_L_Ear_ItemPort", "Piercings_R_Ear_ItemPort", "mobiglas_attach", "mobiglas_screen_attach", "legacy_mobiglas_screen_attach", "Lens_ItemPort", "radar", "universal_necksock_undersuit",
]
APPAREL = ["backpack", "undersuit", "_core_", "_legs_", "_arms_"]
CONSUMABLE = ["drink_", "food_", "crlf_consumable_"]
NON_RELOCATING = ["QueryInventory", "OpenNestedInventory", "Sort", "StackAll"]
HOLDING_KINDS = ["Location", "Container", "Equipped", "World"]
ENTITY = r"(?d)^(.+?)_(\d{6,})$"
_LOCKER = r"(?d)^PersonalStorage_(.+)-\d+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def group(c: Column | str, pattern: str, n: int = 1) -> Column:
    """Group n of the first match, or null where the pattern has none."""
    return F.when(_c(c).rlike(pattern), F.regexp_extract(_c(c), pattern, n))


def entity_split(c: Column | str) -> Column:
    """``class_geid`` as struct(class_name, geid); the class part is as short as can be, so digits at its end stay there."""
    t = F.trim(_c(c))
    ok = t.rlike(ENTITY) & ~t.isin("NULL", "NONE", "INVALID")
    return F.when(ok, F.struct(F.regexp_extract(t, ENTITY, 1).alias("class_name"), F.regexp_extract(t, ENTITY, 2).alias("geid")))


def inventory(c: Column | str) -> Column:
    """``owner:Kind:sub`` as struct(kind, owner_id, sub_id, raw, key); key is the location or container it stands for."""
    raw = F.trim(F.coalesce(_c(c), F.lit("")))
    return inventory_of(raw, F.split(raw, ":", -1))


def inventory_of(raw: Column, parts: Column) -> Column:
    """The same of a trimmed handle and its parts between colons."""
    three = F.size(parts) == 3
    kind = F.when(raw.isin("", "INVALID", "NULL", "NONE"), "Invalid").when(three & parts[1].isin("Location", "Container", "ClientOnly"), parts[1]).otherwise("Unknown")
    invalid = raw.isin("", "INVALID", "NULL", "NONE")
    owner = F.when(invalid, "").when(three, parts[0]).otherwise(raw)
    sub = F.when(~invalid & three, parts[2]).otherwise("")
    key = F.when(invalid | ~three, "").when(parts[1] == "Location", parts[2]).when(parts[1] == "Container", parts[0]).otherwise("")
    return F.struct(kind.alias("kind"), owner.alias("owner_id"), sub.alias("sub_id"), F.when(invalid, "").otherwise(raw).alias("raw"), key.alias("key"))


def is_holding(kind: Column) -> Column:
    return kind.isin(*HOLDING_KINDS)


def is_placeholder(geid: Column | str) -> Column:
    """Stand-in items that every login attaches before the real ones."""
    return _c(geid).rlike(r"^2000[0-9]{8}$")


def is_part_port(port: Column | str) -> Column:
    return _c(port).isin(*PART_PORTS)


def is_character_port(port: Column | str) -> Column:
    return _c(port).isin(*CHARACTER_PORTS)


def is_body_port(port: Column | str) -> Column:
    p = _c(port)
    return p.startswith("Armor_") | p.startswith("wep_stocked_") | p.isin("backpack", "wep_sidearm")


def is_apparel(name: Column | str) -> Column:
    low = F.lower(_c(name))
    out = F.lit(False)
    for part in APPAREL:
        out = out | low.contains(part)
    return out


def is_consumable(name: Column | str) -> Column:
    low = F.lower(_c(name))
    out = F.lit(False)
    for part in CONSUMABLE:
        out = out | low.startswith(part)
    return out


def is_lootable(name: Column | str) -> Column:
    """Crates that are found in the world, which nobody keeps."""
    return F.coalesce(F.lower(_c(name)).contains("lootable"), F.lit(False))


def ship_of_locker(name: Column | str) -> Column:
    """The ship class that a locker's class names, or null."""
    return group(name, _LOCKER)
