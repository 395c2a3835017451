"""The published field names that feed each normalised field, per category.

An alias that starts with "=" must be the whole field name; the others match as whole words inside it.
"""

from __future__ import annotations

CATEGORIES = ("motherboard", "ram", "psu", "case", "cooling")
METHODS = ("json-ld", "spec-table", "definition-list", "spec-list", "meta")
CONFIDENCES = ("high", "medium", "low")

NEGATIVE_ANSWERS = (
    "no", "none", "n/a", "na", "-", "--", "non", "aucun", "aucune", "not supported",
    "non supporte", "sans", "absent", "nein", "false", "0",
)

# Fields that page prose may feed, always with low confidence.
PROSE_FIELDS = {
    "motherboard": ("formFactor", "memoryType", "pcie", "ethernet"),
    "ram": ("memoryType",),
    "psu": ("efficiency",),
    "case": ("caseFormFactor",),
    "cooling": ("coolerType",),
}

# category -> (field, label, unit, expression name, aliases)
FIELDS = {
    "motherboard": (
        ("socket", "Socket", None, "socket", ("socket", "cpu socket", "processor socket", "support processeur", "processeur")),
        ("chipset", "Chipset", None, "chipset", ("chipset", "jeu de composants")),
        ("formFactor", "Format", None, "board_form", ("form factor", "format", "facteur de forme")),
        ("memoryType", "Type de mémoire", None, "memory_type", ("memory", "memory type", "ram", "dram", "memoire", "type de memoire")),
        ("memorySlots", "Emplacements mémoire", None, "memory_slots", ("memory", "memory slots", "dimm", "dimm slots", "memoire", "slots memoire")),
        ("pcie", "PCIe", None, "pcie", ("expansion slots", "expansion slot", "pcie", "pci express", "pci-e", "slots", "connecteurs d extension")),
        ("wifi", "Wi-Fi", None, "wifi", ("wireless", "wi-fi", "wifi", "wlan", "networking", "network", "lan", "reseau", "sans fil")),
        ("ethernet", "Ethernet", None, "ethernet", ("lan", "ethernet", "network", "networking", "reseau")),
    ),
    "ram": (
        ("memoryType", "Type de mémoire", None, "memory_type", ("memory type", "=type", "ddr", "memory", "memoire", "technologie")),
        ("capacity", "Capacité", "Go", "capacity", ("capacity", "kit capacity", "total capacity", "memory size", "=size", "capacite", "densite")),
        ("moduleCount", "Nombre de modules", None, "module_count", ("kit", "modules", "module", "quantity", "kit configuration", "nombre de modules", "configuration")),
        ("speed", "Fréquence", "MT/s", "memory_speed", ("speed", "frequency", "data rate", "tested speed", "frequence", "vitesse", "memory speed")),
        ("latency", "Latence", "CL", "latency", ("latency", "cas latency", "timing", "timings", "tested latency", "latence")),
        ("xmp", "XMP", None, "xmp", ("xmp", "intel xmp", "profile", "profiles", "profil", "overclocking", "support")),
        ("expo", "EXPO", None, "expo", ("expo", "amd expo", "profile", "profiles", "profil", "support")),
        ("ecc", "ECC", None, "ecc", ("ecc", "error correction", "correction d erreur")),
    ),
    "psu": (
        ("wattage", "Puissance", "W", "wattage", ("wattage", "power", "output", "max power", "total power", "puissance", "continuous power", "rated power")),
        ("efficiency", "Certification", None, "efficiency", ("efficiency", "80 plus", "80plus", "certification", "rendement", "efficiency rating")),
        ("atxStandard", "Norme ATX", None, "atx_standard", ("atx", "standard", "form factor", "atx version", "specification", "norme", "format")),
        ("modularity", "Modularité", None, "modularity", ("modular", "modularity", "cable", "cabling", "modularite", "cables")),
        ("pcieConnectors", "Connecteurs PCIe", None, "pcie_connectors", ("pcie", "pci-e", "pci express", "connectors", "connector", "vga", "gpu", "connecteurs")),
        ("highPowerConnector", "Connecteur 12V-2x6", None, "high_power", ("pcie", "pci-e", "12v", "12vhpwr", "12v-2x6", "connectors", "connector", "connecteurs", "gpu")),
        ("warrantyYears", "Garantie", "ans", "warranty", ("warranty", "garantie")),
    ),
    "case": (
        ("caseFormFactor", "Format", None, "case_form", ("=type", "form factor", "case type", "chassis type", "format", "categorie", "tower")),
        ("motherboardSupport", "Cartes mères acceptées", None, "board_form_list", ("motherboard", "mainboard", "motherboard compatibility", "form factor", "supported motherboards", "cartes meres", "carte mere")),
        ("maxGpuLength", "Longueur GPU maximale", "mm", "length_mm", ("gpu", "graphics card", "video card", "vga", "gpu clearance", "carte graphique", "longueur gpu")),
        ("maxCoolerHeight", "Hauteur ventirad maximale", "mm", "length_mm", ("cpu cooler", "cooler", "cpu cooler clearance", "cpu cooler height", "heatsink", "ventirad", "hauteur ventirad")),
        ("radiators", "Radiateurs", None, "radiator_sizes", ("radiator", "radiators", "water cooling", "liquid cooling", "radiateur", "radiateurs")),
        ("dimensions", "Dimensions", None, "dimensions", ("=dimensions", "=dimension", "=size", "measurements", "product dimensions", "case dimensions")),
    ),
    "cooling": (
        ("coolerType", "Type", None, "cooler_type", ("=type", "cooler type", "product type", "category", "categorie", "series", "serie")),
        ("sockets", "Sockets", None, "socket_list", ("socket", "sockets", "compatibility", "cpu support", "supported sockets", "compatibilite", "cpu socket", "intel", "amd")),
        ("radiatorSize", "Taille du radiateur", "mm", "radiator_size", ("radiator", "radiator size", "radiateur", "radiator dimensions")),
        ("coolerHeight", "Hauteur", "mm", "cooler_height", ("height", "hauteur", "cooler height", "heatsink height", "overall height", "product dimensions", "heatsink dimensions", "cooler dimensions")),
        ("fanCount", "Nombre de ventilateurs", None, "fan_count", ("fan", "fans", "fan quantity", "fan count", "ventilateur", "ventilateurs")),
        ("fanSize", "Taille des ventilateurs", "mm", "fan_size", ("fan", "fans", "fan size", "fan dimensions", "ventilateur", "ventilateurs")),
        ("dimensions", "Dimensions", None, "dimensions", ("=dimensions", "=dimension", "=size", "product dimensions", "net dimensions")),
    ),
}


def alias_rows() -> list[tuple]:
    """(category, position, field, label, unit, expression, alias, whole_name) rows."""
    return [
        (category, position, field, label, unit, expression, alias.lstrip("="), alias.startswith("="))
        for category, fields in FIELDS.items()
        for position, (field, label, unit, expression, aliases) in enumerate(fields)
        for alias in aliases
    ]


def field_rows() -> list[tuple]:
    """(category, position, field, label, unit, expression, prose) rows."""
    return [
        (category, position, field, label, unit, expression, field in PROSE_FIELDS[category])
        for category, fields in FIELDS.items()
        for position, (field, label, unit, expression, _aliases) in enumerate(fields)
    ]


def longest_alias() -> int:
    """Number of letter-digit runs of the longest alias, i.e. how long the word n-grams must be."""
    import re

    return max(len(re.findall(r"[a-z0-9]+", row[6])) for row in alias_rows())
