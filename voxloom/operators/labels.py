"""Label vocabularies and the coarse remap."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.checks import require

#: Coarse classes by id.
COARSE_NAMES = (
    "unknown",
    "other",
    "wall_structure",
    "ground_surface",
    "ceiling",
    "opening",
    "work_surface",
    "seating",
    "storage",
    "display_device",
    "person",
    "appliance_fixture",
    "small_object",
    "decor_soft",
    "navigation_structure",
)
#: Fine labels of each coarse class; all others are "other".
COARSE_GROUPS: dict[str, tuple[str, ...]] = {
    "wall_structure": ("wall", "column"),
    "ground_surface": ("floor", "rug"),
    "ceiling": ("ceiling",),
    "opening": ("door", "windowpane", "screen door"),
    "work_surface": ("table", "desk", "counter", "countertop", "coffee table", "kitchen island", "bar", "pool table"),
    "seating": ("chair", "sofa", "armchair", "seat", "bench", "swivel chair", "ottoman", "stool"),
    "storage": ("cabinet", "shelf", "wardrobe", "chest of drawers", "case", "bookcase", "buffet"),
    "display_device": ("computer", "television receiver", "screen", "crt screen", "monitor", "arcade machine"),
    "person": ("person",),
    "appliance_fixture": (
        "lamp", "light", "chandelier", "sconce", "sink", "bathtub", "toilet", "refrigerator", "stove", "oven", "microwave", "dishwasher",
        "washer", "shower", "radiator", "fan", "fireplace",
    ),
    "small_object": (
        "box", "book", "bottle", "bag", "glass", "basket", "tray", "plate", "pot", "food", "towel", "apparel", "plaything", "ball", "ashcan",
    ),
    "decor_soft": (
        "painting", "plant", "curtain", "mirror", "cushion", "pillow", "flower", "blind", "blanket", "sculpture", "poster", "bulletin board",
        "vase", "clock", "flag",
    ),
    "navigation_structure": ("railing", "stairs", "stairway", "escalator", "bannister", "step"),
}
OTHER = COARSE_NAMES.index("other")


def normalised(name: str) -> str:
    """Labels are compared lower case, without white space around."""
    if not isinstance(name, str):
        raise TypeError("a label name is a string")
    return name.strip().lower()


def fine_to_coarse(groups: Mapping[str, Iterable[str]] = COARSE_GROUPS, names: tuple[str, ...] = COARSE_NAMES) -> dict[str, int]:
    """The coarse id of each fine label; a group of no known name and a label in
    two groups are errors."""
    found: dict[str, int] = {}
    for group, members in groups.items():
        if group not in names:
            raise ValueError(f"unknown coarse class {group!r}")
        for member in map(normalised, members):
            if found.setdefault(member, names.index(group)) != names.index(group):
                raise ValueError(f"{member!r} is in two groups")
    return found


def coarse_table(spark: SparkSession, names: tuple[str, ...] = COARSE_NAMES) -> DataFrame:
    """coarse_id and coarse_name."""
    return spark.createDataFrame(list(enumerate(names)), "coarse_id bigint, coarse_name string")


def duplicate_labels(members: DataFrame) -> DataFrame:
    """Fine labels (fine_name) in more than one group (coarse_name)."""
    return members.groupBy("fine_name").agg(F.countDistinct("coarse_name").cast("bigint").alias("groups")).filter("groups > 1")


class CoarseRemap:
    """Fine ids to coarse ids through a table over 0 to the largest id.

    Ids without a name and names outside all groups become "other".
    """

    def __init__(self, fine_names: Mapping[int, str], groups: Mapping[str, Iterable[str]] = COARSE_GROUPS, names: tuple[str, ...] = COARSE_NAMES):
        if not fine_names:
            raise ValueError("there are no fine labels")
        if any(not isinstance(k, int) or isinstance(k, bool) for k in fine_names):
            raise TypeError("fine ids are integers")
        if min(fine_names) < 0:
            raise ValueError("fine ids are not negative")
        self.names = names
        of_name = fine_to_coarse(groups, names)
        self.size = max(fine_names) + 1
        self.table = [OTHER] * self.size
        for k, name in fine_names.items():
            self.table[k] = of_name.get(normalised(name), OTHER)

    def lookup(self, spark: SparkSession) -> DataFrame:
        """fine_id and coarse_id: as long as the vocabulary."""
        return spark.createDataFrame(list(enumerate(self.table)), "fine_id bigint, coarse_id bigint")

    def remap(self, df: DataFrame, label: str = "label", name: str = "coarse_id") -> DataFrame:
        """Adds the coarse id; a label below 0 or beyond the table is an error.

        The table is an array literal as long as the vocabulary, so no join is
        planned at all.
        """
        table = F.array(*[F.lit(k).cast("bigint") for k in self.table])
        at = require(self.holds(label), F.col(label).cast("int"), "a fine label is outside the table")
        return df.withColumn(name, F.element_at(table, at + 1))

    def holds(self, label: str = "label") -> Column:
        """Whether the table has a label."""
        return (F.col(label) >= 0) & (F.col(label) < self.size)

    def outside(self, df: DataFrame, label: str = "label") -> DataFrame:
        """The labels that ``remap`` would refuse, null too, and rows of each (n)."""
        return df.filter(~F.coalesce(self.holds(label), F.lit(False))).groupBy(label).agg(F.count("*").alias("n"))

    def coarse_name(self, coarse_id: int) -> str:
        if not 0 <= coarse_id < len(self.names):
            raise ValueError(f"{coarse_id} is not a coarse id")
        return self.names[coarse_id]


def with_class_names(df: DataFrame, vocabulary: DataFrame, label: str = "label", name: str = "class_name") -> DataFrame:
    """Adds the name of each label (vocabulary: fine_id, fine_name), or
    unknown_<id>."""
    names = vocabulary.select(F.col("fine_id").alias("__id"), F.col("fine_name").alias("__name"))
    joined = df.join(names, F.col(label) == F.col("__id"), "left")
    return joined.withColumn(name, F.coalesce("__name", F.concat(F.lit("unknown_"), F.col(label).cast("string")))).drop("__id", "__name")
