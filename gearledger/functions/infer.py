"""Keyword inference of brands, sockets, formats and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gearledger.functions.text import clean_printed, fold_text

UNKNOWN = "À vérifier"

# Words that name the maker of a chip.
AMD_CPU_WORDS = ("ryzen", "athlon", "phenom", "threadripper", "epyc", "fx-", "apu")
AMD_GPU_WORDS = ("radeon", "firepro", "instinct")
INTEL_GPU_WORDS = ("arc ", "intel hd", "intel uhd", "iris")

# Chipset and socket marks, first group that matches names the socket.
SOCKET_MARKS = (
    (("X870", "B850", "B840", "X670", "B650"), "AM5"),
    (("X570", "B550", "B450", "X470", "B350", "A520", "A320"), "AM4"),
    (("Z890", "B860", "H810"), "LGA1851"),
    (("Z790", "B760", "Z690", "B660", "H610", "H770", "H670"), "LGA1700"),
    (("Z590", "B560", "Z490", "B460", "H510", "H570"), "LGA1200"),
    (("Z390", "Z370", "B360", "H370", "B365", "H310"), "LGA1151 v2"),
    (("Z270", "B250", "H270", "Z170"), "LGA1151 v1"),
    (("X299",), "LGA2066"),
    (("X99",), "LGA2011-v3"),
    (("X79",), "LGA2011"),
    (("TRX40",), "sTRX4"),
    (("X399",), "TR4"),
    (("AM3", "990FX", "970"), "AM3+"),
    (("FM2", "A88X"), "FM2+"),
    (("LGA 1150", "Z97", "Z87"), "LGA1150"),
    (("LGA 1155", "Z77", "Z68", "P67", "B75"), "LGA1155"),
    (("LGA 1366", "X58"), "LGA1366"),
    (("LGA 775", "P45", "G41"), "LGA775"),
)

# Words of a device name that place it in a category.
DEVICE_WORDS = (
    ("gpu", ("geforce", "radeon", "graphics", "display", "vga", "arc a")),
    ("storage", ("nvme", "sata", "raid", "ahci", "storage controller")),
    ("expansion", ("ethernet", "wireless", "wi fi", "bluetooth", "audio", "capture", "usb controller")),
)


def contains_any(text: Column, words) -> Column:
    return reduce(lambda acc, word: acc | text.contains(word), words, F.lit(False))


def infer_brand(category: Column, reference: Column, context: Column) -> Column:
    text = F.lower(F.concat_ws(" ", reference, context))
    return (
        F.when(category == "cpu", F.when(contains_any(text, AMD_CPU_WORDS), "AMD").otherwise("Intel"))
        .when(
            category == "gpu",
            F.when(contains_any(text, AMD_GPU_WORDS), "AMD").when(contains_any(text, INTEL_GPU_WORDS), "Intel").otherwise("NVIDIA"),
        )
        .otherwise(UNKNOWN)
    )


def infer_socket(key: Column, context: Column) -> Column:
    text = F.upper(F.concat_ws(" ", key, context))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for marks, socket in SOCKET_MARKS:
        chain = chain.when(contains_any(text, marks), socket)
    written = F.regexp_extract(text, "(LGA\\s*\\d+(?:\\s*V[12])?|AM[345]\\+?|STRX4|STR5|TR4)", 1)
    return chain.otherwise(F.when(written == "", UNKNOWN).otherwise(clean_printed(written)))


def board_format(model: Column) -> Column:
    text = F.upper(model)
    return F.when(text.contains("ITX"), "Mini-ITX").when(text.contains("MATX"), "Micro-ATX").otherwise(UNKNOWN)


def ram_generation(context: Column) -> Column:
    text = F.upper(context)
    return F.when(text.contains("DDR5"), "DDR5").when(text.contains("DDR4"), "DDR4").otherwise(UNKNOWN)


def device_category(name: Column) -> Column:
    text = fold_text(name, "NFD")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, words in DEVICE_WORDS:
        chain = chain.when(contains_any(text, words), category)
    return chain


def compact_name(brand: Column, reference: Column) -> Column:
    """First of several references, brand in front when it is not part of it, variants marked."""
    first = F.element_at(F.split(reference, "\\s[/,]\\s|\\s→\\s", 2), 1)
    prefixed = F.when(
        ~F.contains(F.lower(first), F.lower(brand)) & (brand != UNKNOWN), F.concat_ws(" ", brand, first)
    ).otherwise(first)
    return clean_printed(F.concat(prefixed, F.when(first != reference, " et variantes").otherwise("")))


def split_models(text: Column) -> Column:
    """Items of a list separated by commas outside parentheses; short and stop items are dropped."""
    items = F.split(clean_printed(text), ",(?![^()]*\\))")
    cleaned = F.transform(items, clean_printed)
    return F.filter(cleaned, lambda m: (F.length(m) >= 3) & ~F.lower(m).isin("intel", "amd", "legacy"))
