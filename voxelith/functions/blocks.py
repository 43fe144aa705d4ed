"""Block name predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block names and the parts of names that mark a block as no ground.
AIR = ("minecraft:air", "minecraft:cave_air", "minecraft:void_air")
WATER = ("minecraft:water", "minecraft:flowing_water")
GROUND_ANYWAY = (
    "minecraft:grass_block", "minecraft:mycelium", "minecraft:podzol", "minecraft:dirt_path", "minecraft:farmland",
)
NO_GROUND = (
    "_leaves", "azalea_leaves", "_log", "_wood", "stripped_", "_planks", "_slab", "_stairs", "_fence", "_gate", "_wall",
    "_door", "_trapdoor", "_button", "_pressure_plate", "glass", "grass", "fern", "large_fern", "dead_bush", "bush",
    "bamboo", "sugarcane", "cactus", "kelp", "seagrass", "coral", "vine", "hanging_roots", "spore_blossom", "azalea",
    "dripleaf", "glow_lichen", "moss_carpet", "dandelion", "poppy", "orchid", "allium", "bluet", "tulip", "daisy",
    "cornflower", "lily_of", "sunflower", "lilac", "rose_bush", "peony", "wither_rose", "pitcher", "torchflower",
    "brown_mushroom", "red_mushroom", "crimson_fungus", "warped_fungus", "crimson_roots", "warped_roots",
    "nether_sprouts", "torch", "lantern", "chain", "bars", "carpet", "banner", "sign", "bed", "flower_pot", "skull",
    "head", "lever", "rail", "ladder", "cobweb", "string", "chest", "barrel", "bookshelf", "scaffolding", "sapling",
)


def is_air(name: Column) -> Column:
    return name.isin(*AIR)


def is_water(name: Column) -> Column:
    return name.isin(*WATER)


def is_no_ground(name: Column) -> Column:
    """Air, or a name whose part after the last colon holds one of NO_GROUND, unless it is ground anyway."""
    bare = F.substring_index(name, ":", -1)
    return is_air(name) | (~name.isin(*GROUND_ANYWAY) & bare.rlike("|".join(NO_GROUND)))


def skipped(name: str, ground_only: bool) -> bool:
    """The same test for one palette entry, used while decoding files."""
    if name in AIR:
        return True
    if not ground_only or name in GROUND_ANYWAY:
        return False
    bare = name.rpartition(":")[2]
    return any(part in bare for part in NO_GROUND)
