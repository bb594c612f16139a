"""Species and category names: normalisation and training classes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class of a rejected detection by keyword in the notes, first match wins.
NOTE_CLASSES = {
    "surface human": "FALSE_human",
    "human arm": "FALSE_human",
    "human": "FALSE_human",
    "chum box": "FALSE_equipment",
    "box and surface": "FALSE_equipment",
    "boat hull": "FALSE_equipment",
    "barracuda": "FALSE_fish",
    "snapper": "FALSE_fish",
    "triggerfish": "FALSE_fish",
    "unknown fish": "FALSE_fish",
    "sargassum": "FALSE_plant",
    "surface wave": "FALSE_other",
}

# Class by taxon group.
TAXON_CLASSES = {
    "shark": "UNKNOWN_shark",
    "ray_skate": "UNKNOWN_ray",
    "teleost": "FALSE_teleost",
    "human_diver": "FALSE_human",
    "boat_equipment": "FALSE_equipment",
    "surface_plant": "FALSE_plant",
    "benthic_plant": "FALSE_plant",
    "shadow_reflection": "FALSE_artifact",
    "video_artifact": "FALSE_artifact",
    "debris": "FALSE_debris",
    "invertebrate": "FALSE_invertebrate",
    "other": "FALSE_other",
}

# Spellings of one species or category.
SPELLINGS = {
    "g. cirratum": "Ginglymostoma_cirratum",
    "g__cirratum": "Ginglymostoma_cirratum",
    "ginglymostoma cirratum": "Ginglymostoma_cirratum",
    "ginglymostoma_cirratum": "Ginglymostoma_cirratum",
    "nurse shark": "Ginglymostoma_cirratum",
    "c. perezi": "Carcharhinus_perezi",
    "c__perezi": "Carcharhinus_perezi",
    "carcharhinus perezi": "Carcharhinus_perezi",
    "caribbean reef shark": "Carcharhinus_perezi",
    "c. acronotus": "Carcharhinus_acronotus",
    "c__acronotus": "Carcharhinus_acronotus",
    "carcharhinus acronotus": "Carcharhinus_acronotus",
    "blacknose shark": "Carcharhinus_acronotus",
    "c. limbatus": "Carcharhinus_limbatus",
    "carcharhinus limbatus": "Carcharhinus_limbatus",
    "blacktip shark": "Carcharhinus_limbatus",
    "galeocerdo cuvier": "Galeocerdo_cuvier",
    "tiger shark": "Galeocerdo_cuvier",
    "human": "FALSE_human",
    "bruv": "FALSE_equipment",
    "boat": "FALSE_equipment",
    "artifact": "FALSE_artifact",
}

UNCLASSIFIABLE = "ESU"


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key`` in a constant table, null when absent. No join, no broadcast."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(entries, key)


def blank(col: Column) -> Column:
    """True for null and for text that is empty after trimming."""
    return F.coalesce(F.trim(col) == "", F.lit(True))


def class_name(name: Column, spellings: dict[str, str] = SPELLINGS) -> Column:
    """Normal form of a known spelling; otherwise the name with ' ', '.', '/' as '_'."""
    return F.coalesce(
        lookup(spellings, F.lower(F.trim(name))), F.translate(name, " ./", "___")
    )


def training_class(true_detection: Column, taxon_group: Column, species: Column) -> Column:
    """Training class of a validated track; null when it is neither true nor false."""
    verdict = F.lower(F.trim(true_detection))
    group, sp = F.trim(taxon_group), F.trim(species)
    from_group = lookup(TAXON_CLASSES, F.lower(group))
    named = class_name(sp)
    when_true = (
        F.when(~blank(sp), named)
        .when(~blank(group), F.coalesce(from_group, F.concat(F.lit("UNKNOWN_"), class_name(group))))
        .otherwise(F.lit("UNKNOWN_elasmobranch"))
    )
    when_false = (
        F.when(from_group.isNotNull(), from_group)
        .when(
            ~blank(sp),
            F.when(named.startswith("FALSE_"), named).otherwise(F.concat(F.lit("FALSE_"), named)),
        )
        .when(~blank(group), F.concat(F.lit("FALSE_"), class_name(group)))
        .otherwise(F.lit("FALSE_other"))
    )
    return F.when(verdict == "true", when_true).when(verdict == "false", when_false)


def class_from_notes(true_detection: Column, species: Column, notes: Column) -> Column:
    """Training class in the older table form, where a rejection is explained in the notes.

    Only the exact spellings TRUE and FALSE count there.
    """
    text = F.lower(F.coalesce(notes, F.lit("")))
    rejected = F.lit("FALSE_other")
    for key, value in reversed(list(NOTE_CLASSES.items())):
        rejected = F.when(text.contains(key), F.lit(value)).otherwise(rejected)
    return F.when(
        (true_detection == "TRUE") & (F.coalesce(species, F.lit("")) != ""), class_name(species)
    ).when(true_detection == "FALSE", rejected)


def metric_column(prefix: str, label: str) -> str:
    """A column name built from data: everything but letters, digits and '_' becomes '_'."""
    return prefix + "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in label)


def metric_columns(prefix: str, labels: list[str]) -> list[str]:
    """One name per label; labels that would share a name are numbered in their order."""
    out: list[str] = []
    for label in labels:
        name = stem = metric_column(prefix, label)
        k = 2
        while name in out:
            name, k = f"{stem}_{k}", k + 1
        out.append(name)
    return out
