"""Fixed dimension values used by the rules. All are small and bounded by their own definition."""

from __future__ import annotations

# The nine product categories, and the fourteen catalogue categories mapped onto them.
CATEGORIES = ("cpu", "gpu", "motherboard", "ram", "psu", "case", "storage", "cooling", "expansion")
CATALOGUE_TO_PRODUCT = {
    "cpu": "cpu", "gpu": "gpu", "motherboard": "motherboard", "ram": "ram", "storage": "storage", "psu": "psu",
    "case": "case", "cooling": "cooling", "fan": "cooling", "thermal_compound": "cooling", "network": "expansion",
    "sound_card": "expansion", "capture_card": "expansion", "monitor": "expansion",
}

# Open database folder -> (category, subcategory).
OPEN_FOLDERS = {
    "CPU": ("cpu", None), "GPU": ("gpu", None), "Motherboard": ("motherboard", None), "RAM": ("ram", None),
    "Storage": ("storage", None), "PSU": ("psu", None), "PCCase": ("case", None), "CPUCooler": ("cooling", "cpu_cooler"),
    "CaseFan": ("fan", "case_fan"), "NetworkCard": ("network", None), "SoundCard": ("sound_card", None),
    "CaptureCard": ("capture_card", None), "Monitor": ("monitor", None), "ThermalCompound": ("thermal_compound", None),
}

# Specification keys kept per open database folder; other folders keep all but the reserved keys.
OPEN_SPEC_KEYS = {
    "CPU": ("socket", "microarchitecture", "coreFamily", "cores", "clocks", "cache", "specifications"),
    "GPU": (
        "chipset_manufacturer", "chipset", "memory", "memory_type", "memory_bus", "core_base_clock", "core_boost_clock",
        "interface", "length", "height", "width", "tdp", "total_slot_width", "power_connectors", "video_outputs", "cooling",
    ),
    "Motherboard": (
        "socket", "chipset", "form_factor", "memory", "storage_devices", "pcie_slots", "m2_slots", "onboard_ethernet",
        "wireless_networking", "bios_features", "back_panel_ports", "ecc_support", "raid_support",
    ),
    "RAM": (
        "ram_type", "capacity", "modules", "speed", "cas_latency", "timings", "voltage", "ecc", "registered",
        "form_factor", "profile_support",
    ),
    "Storage": (
        "type", "storage_type", "capacity", "interface", "nvme", "form_factor", "read_speed", "write_speed",
        "endurance", "cache", "rpm",
    ),
    "PSU": ("wattage", "efficiency_rating", "modular", "form_factor", "length", "connectors", "atx_version", "fanless"),
    "PCCase": (
        "form_factor", "supported_motherboard_form_factors", "supported_power_supply_form_factors",
        "max_video_card_length", "max_cpu_cooler_height", "radiator_support", "fan_support", "dimensions", "volume",
        "weight", "expansion_slots",
    ),
    "CPUCooler": (
        "water_cooled", "cpu_sockets", "height", "radiator_size", "fan_size", "fan_quantity", "min_fan_rpm",
        "max_fan_rpm", "min_noise_level", "max_noise_level", "fanless",
    ),
    "CaseFan": (
        "size", "quantity", "min_airflow", "max_airflow", "min_noise_level", "max_noise_level", "pwm", "connector",
        "static_pressure", "flow_direction",
    ),
    "Monitor": (
        "screen_size", "resolution", "refresh_rate", "panel_type", "response_time", "aspect_ratio", "connectors",
        "max_brightness", "hdr", "adaptive_sync",
    ),
}
OPEN_RESERVED_KEYS = ("opendb_id", "metadata", "general_product_information")

# Price model per category.
ANNUAL_RETENTION = {
    "cpu": 0.86, "gpu": 0.80, "motherboard": 0.84, "ram": 0.88, "psu": 0.90, "case": 0.92, "storage": 0.82,
    "cooling": 0.90, "expansion": 0.85,
}
SERVICE_LIFE = {
    "cpu": 8, "gpu": 8, "motherboard": 8, "ram": 10, "psu": 10, "case": 15, "storage": 8, "cooling": 12, "expansion": 8,
}
ACTIVE_SOCKETS = ("AM5", "LGA1851")
MATURE_SOCKETS = ("AM4", "LGA1700")

# Listing model.
CONDITION_FACTOR = {
    "sealed": 1.08, "like-new": 1.0, "excellent": 0.96, "good": 0.9, "worn": 0.78, "untested": 0.55, "repair": 0.3,
}
CATEGORY_RISK = {
    "cpu": 1.0, "gpu": 0.94, "motherboard": 0.9, "ram": 1.0, "psu": 0.82, "case": 0.96, "storage": 0.83,
    "cooling": 0.88, "expansion": 0.9,
}

# Platform tables of the compatibility rules.
CPU_FAMILIES = {
    "coffee lake": "Intel 8e", "coffee lake refresh": "Intel 9e", "comet lake": "Intel 10e", "rocket lake": "Intel 11e",
    "alder lake": "Intel 12e", "raptor lake": "Intel 13e", "raptor lake refresh": "Intel 14e", "zen 2": "Ryzen 3000",
    "zen 3": "Ryzen 5000", "zen 4": "Ryzen 7000", "zen 5": "Ryzen 9000",
}
# chipset -> (families supported as delivered, families supported after a BIOS update)
CHIPSET_SUPPORT = {
    "Z370": (("Intel 8e",), ("Intel 9e",)),
    "B360": (("Intel 8e",), ("Intel 9e",)),
    "H370": (("Intel 8e",), ("Intel 9e",)),
    "Z390": (("Intel 8e", "Intel 9e"), ()),
    "B365": (("Intel 8e", "Intel 9e"), ()),
    "Z490": (("Intel 10e",), ("Intel 11e",)),
    "Z590": (("Intel 10e", "Intel 11e"), ()),
    "B660": (("Intel 12e",), ("Intel 13e", "Intel 14e")),
    "Z690": (("Intel 12e",), ("Intel 13e", "Intel 14e")),
    "B760": (("Intel 12e", "Intel 13e"), ("Intel 14e",)),
    "Z790": (("Intel 12e", "Intel 13e"), ("Intel 14e",)),
    "B450": (("Ryzen 3000",), ("Ryzen 5000",)),
    "X470": (("Ryzen 3000",), ("Ryzen 5000",)),
    "B550": (("Ryzen 3000",), ("Ryzen 5000",)),
    "X570": (("Ryzen 3000",), ("Ryzen 5000",)),
    "A620": (("Ryzen 7000",), ("Ryzen 9000",)),
    "B650": (("Ryzen 7000",), ("Ryzen 9000",)),
    "X670": (("Ryzen 7000",), ("Ryzen 9000",)),
    "B850": (("Ryzen 7000", "Ryzen 9000"), ()),
    "X870": (("Ryzen 7000", "Ryzen 9000"), ()),
}
COOLER_CLASS_W = {"moyenne": 130.0, "elevee": 200.0, "tres elevee": 280.0}

# Recommendation rules in order (highest budget, resolutions, starter build).
STARTER_RULES = (
    (900.0, ("1080p", "1440p", "4K"), "am4-budget"),
    (1400.0, ("1080p",), "itx-compact"),
    (1400.0, ("1440p", "4K"), "am5-1440p"),
    (float("inf"), ("1080p", "1440p", "4K"), "am5-1440p"),
)
COMPACT_STARTER = "itx-compact"
DEFAULT_STARTER = "am5-1440p"

# Headline fields of a product card.
HEADLINE = {
    "cpu": ("Socket", "Cœurs", "TDP"),
    "gpu": ("VRAM", "Consommation (W)", "Longueur (mm)"),
    "motherboard": ("Socket", "Chipset", "Format"),
    "ram": ("Type", "Capacité", "Fréquence"),
    "psu": ("Puissance", "Certification", "Modularité"),
    "case": ("Format", "GPU max (mm)", "Ventirad max (mm)"),
    "storage": ("Type", "Capacité", "Lecture"),
    "cooling": ("Type", "Hauteur (mm)", "Radiateur (mm)"),
    "expansion": ("Type", "Interface", "Profil"),
}
# The shorter headline used inside a build.
BUILD_HEADLINE = {
    "cpu": ("Socket", "Cœurs", "TDP"),
    "gpu": ("VRAM", "Consommation (W)", "Longueur (mm)"),
    "motherboard": ("Chipset", "Format", "RAM"),
    "ram": ("Type", "Capacité", "Fréquence"),
    "psu": ("Puissance", "Certification"),
    "case": ("Format", "GPU max (mm)"),
    "storage": ("Type", "Capacité"),
    "cooling": ("Type", "Capacité thermique"),
    "expansion": ("Type", "Interface"),
}

# Sections of a product sheet and the fields shown in each, in display order.
OTHER_SECTION = "Autres caractéristiques"
SPEC_SECTIONS = {
    "cpu": (
        ("Plateforme", ("Socket", "Architecture", "Mémoire", "iGPU")),
        ("Calcul", ("Cœurs", "Threads", "Base (GHz)", "Boost (GHz)", "Cache (Mo)")),
        ("Énergie", ("TDP",)),
        ("Indices", ("Indice monocœur", "Indice multicœur", "Indice gaming")),
    ),
    "gpu": (
        ("Puce et mémoire", ("Architecture", "VRAM", "Type VRAM")),
        ("Intégration", ("Longueur (mm)", "Slots", "Connecteurs", "Consommation (W)", "PSU recommandé (W)")),
        ("Rendu", ("1080p", "1440p", "4K", "Ray tracing", "Upscaling", "Encodeur")),
    ),
    "motherboard": (
        ("Plateforme", ("Socket", "Chipset", "Format", "Compatibilité CPU", "BIOS Flashback")),
        ("Mémoire", ("RAM", "Slots RAM", "RAM max (Go)", "RAM max (MHz)")),
        ("Connectique", ("PCIe", "Ports M.2", "Ports SATA", "WiFi", "Bluetooth")),
        ("Alimentation", ("VRM",)),
    ),
    "ram": (
        ("Module", ("Type", "Capacité", "Barrettes", "Format")),
        ("Réglages", ("Fréquence", "Latence", "Tension", "Profil", "ECC")),
    ),
    "psu": (
        ("Sortie", ("Puissance", "Certification", "Norme ATX", "ATX 3.x")),
        ("Intégration", ("Format", "Modularité", "PCIe", "12V-2x6")),
        ("Fiabilité", ("Tier", "Protections", "Garantie")),
    ),
    "case": (
        ("Format", ("Format", "Cartes mères", "Formats alimentation")),
        ("Dégagements", ("GPU max (mm)", "Ventirad max (mm)", "Radiateurs")),
        ("Ventilation et stockage", ("Ventilateurs", "Ventilateurs inclus", "Airflow", "Stockage")),
    ),
    "storage": (
        ("Interface", ("Type", "Interface", "Format")),
        ("Capacité et débit", ("Capacité", "Lecture", "Écriture")),
        ("Endurance", ("NAND", "DRAM", "Endurance")),
    ),
    "cooling": (
        ("Type", ("Type", "Capacité thermique", "Sockets compatibles")),
        ("Dimensions", ("Hauteur (mm)", "Radiateur (mm)")),
        ("Ventilation", ("Ventilateurs", "Bruit (dBA)")),
    ),
    "expansion": (
        ("Carte", ("Type", "Interface", "Profil")),
        ("Fonctions", ("Fonctions", "Antenne")),
    ),
}

# Words that tell the category of a search hit. "dark rock" is compared with single words.
CATEGORY_TERMS = {
    "cpu": ("processor", "cpu", "ryzen", "core", "athlon", "xeon"),
    "gpu": ("graphics", "gpu", "geforce", "radeon", "video", "arc"),
    "motherboard": ("motherboard", "mainboard", "chipset", "rog", "aorus", "taichi", "classified", "n7"),
    "ram": ("memory", "ram", "ddr", "dimm", "vengeance", "trident", "fury", "ballistix"),
    "psu": ("power", "supply", "psu", "focus", "supernova"),
    "case": ("case", "chassis", "tower", "masterbox", "define", "o11"),
    "storage": ("ssd", "drive", "storage", "nvme", "firecuda"),
    "cooling": ("cooler", "cooling", "heatsink", "liquid", "freezer", "dark rock"),
    "expansion": ("pcie", "capture", "network", "ethernet", "wireless", "audio", "controller"),
}

# Triage vocabulary.
FALSE_POSITIVE_TERMS = (
    "cloud gaming", "game streaming", "streaming service", "service de streaming", "smartphone", "mobile phone",
)
FAMILY_TERMS = (
    "family", "famille", "series", "serie", "série", "line", "ligne", "gamme", "brand", "marque",
    "microarchitecture", "micro architecture", "generation",
)
STRONG_FAMILY_PHRASES = (
    "series of", "serie de", "family of", "famille de", "generation of", "generation de", "gamme de carte",
    "gamme de processeur", "processor series", "gpu series",
)
RETAIL_PATTERNS = {
    "cpu": (
        "\\bryzen\\s+[3579]\\s+\\d{4}[a-z]{0,3}\\b",
        "\\bthreadripper\\s+\\d{4}[a-z]{0,3}\\b",
        "\\bcore\\s+i[3579][ -]?\\d{4,5}[a-z]{0,3}\\b",
    ),
    "gpu": (
        "\\b(?:geforce\\s+)?rtx\\s+\\d{4}(?:\\s+super|\\s+ti)?\\b",
        "\\b(?:radeon\\s+)?rx\\s+\\d{4}(?:\\s+xt|\\s+xtx)?\\b",
        "\\barc\\s+[ab]\\d{3}\\b",
        "\\bgtx\\s+\\d{3,4}(?:\\s+ti)?\\b",
    ),
    "case": ("\\bo11\\s+dynamic\\b", "\\bmasterbox\\b", "\\bnzxt\\s+h\\d{3}\\b"),
    "storage": ("\\b\\d{3,4}\\s*(?:pro|evo)\\b", "\\bfirecuda\\s+\\d+\\b"),
}
LANES = {"hardware-identifier": "identifiers", "false-positive": "rejected"}

# Words that say nothing about the identity of a product page.
GENERIC_TOKENS = (
    "a", "an", "and", "atx", "by", "computer", "desktop", "for", "gaming", "memory", "motherboard", "of", "official",
    "pc", "power", "product", "ram", "series", "supply", "the", "with",
)
IDENTITY_FIELDS = ("name", "model", "sku", "mpn", "gtin", "gtin8", "gtin12", "gtin13", "gtin14", "productID")
EVIDENCE_STATUSES = ("insufficient-metadata", "page-metadata", "structured-product")
VERIFICATION_STATUSES = ("verified", "variant-required", "rejected")
