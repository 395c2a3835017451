"""Compatibility audit of whole tables of builds.

``builds(build_id, slot, product_id)`` is joined with a narrow projection of the products (only the fields the
rules read) and folded to one row per build by a partial aggregate, so one join and one grouping move data.
Rules are columns; a rule that does not apply is null and vanishes before the rows are exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions.numbers import connector_count, js_round, numbers_in, pcie_generation
from gearledger.functions.scores import cpu_peak, recommended_psu, summary_draw, system_draw
from gearledger.functions.specs import list_of, number_of, text_of
from gearledger.functions.text import plain
from gearledger.model import literal_map
from gearledger.model.dimensions import CATEGORIES, CHIPSET_SUPPORT, COOLER_CLASS_W, CPU_FAMILIES

SLOTS = CATEGORIES
STATUSES = ("ok", "warning", "error", "unknown", "info")

# The published fields the rules read, by value kind.
TEXT_FIELDS = (
    "Socket", "Architecture", "Chipset", "BIOS Flashback", "iGPU", "Type", "RAM", "Mémoire", "Profil", "Format",
    "Radiateurs", "Capacité thermique", "Connecteurs", "12V-2x6", "PCIe", "ATX 3.x", "Interface", "WiFi", "Fonctions",
)
NUMBER_FIELDS = (
    "Barrettes", "Slots RAM", "Capacité", "RAM max (Go)", "Fréquence", "RAM max (MHz)", "Longueur (mm)", "GPU max (mm)",
    "Hauteur (mm)", "Ventirad max (mm)", "Radiateur (mm)", "TDP", "Puissance", "Consommation (W)", "PSU recommandé (W)",
    "Ports M.2", "Ports SATA",
)
LIST_FIELDS = ("Cartes mères", "Formats alimentation", "Sockets compatibles")


def product_facts(products: DataFrame) -> DataFrame:
    """The narrow side of the build join: identity, prices and the fields the rules read."""
    specs = F.col("specs")
    facts = [F.nullif(text_of(specs, f), F.lit("")).alias(f"t:{f}") for f in TEXT_FIELDS]
    facts += [number_of(specs, f).alias(f"n:{f}") for f in NUMBER_FIELDS]
    facts += [list_of(specs, f).alias(f"l:{f}") for f in LIST_FIELDS]
    head = ["product_id", "brand", "new_price", "used_price", "performance"]
    return products.select("product_id", F.struct(*head, *facts).alias("part"))


def resolve_builds(builds: DataFrame, products: DataFrame) -> DataFrame:
    """One row per build with one struct column per slot; unknown products leave the slot empty."""
    parts = builds.filter(F.col("slot").isin(*SLOTS)).join(product_facts(products), "product_id", "left")
    slots = [F.min(F.when(F.col("slot") == s, F.col("part"))).alias(s) for s in SLOTS]
    return parts.groupBy("build_id").agg(*slots)


def _has(slot: str) -> Column:
    return F.col(slot).isNotNull()


def _field(slot: str, name: str) -> Column:
    return F.col(slot)[name]


def _t(slot: str, name: str) -> Column:
    return _field(slot, f"t:{name}")


def _n(slot: str, name: str) -> Column:
    return _field(slot, f"n:{name}")


def _l(slot: str, name: str) -> Column:
    return _field(slot, f"l:{name}")


def verdict(inputs: list[Column], good: Column, bad: str, fine: str = "ok") -> Column:
    """Status of a rule. A missing input is ``unknown`` before any comparison is looked at."""
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in inputs])
    return F.when(missing, "unknown").when(good, fine).otherwise(bad)


def _margin_status(margin: Column, thin: float) -> Column:
    return F.when(margin.isNull(), "unknown").when(margin < 0, "error").when(margin < thin, "warning").otherwise("ok")


def _flat(text: Column) -> Column:
    return F.trim(plain(text))


def _rules() -> list[tuple[str, str, Column, Column]]:
    """(group, rule, emitted when, status) in display order."""
    cpu, gpu, board, ram, psu, case = (_has(s) for s in ("cpu", "gpu", "motherboard", "ram", "psu", "case"))
    cooler, storage, expansion = _has("cooling"), _has("storage"), _has("expansion")
    rules: list[tuple[str, str, Column, Column]] = []

    def add(group: str, rule: str, when: Column, status: Column) -> None:
        rules.append((group, rule, when, status))

    # Platform
    cpu_socket, board_socket = _t("cpu", "Socket"), _t("motherboard", "Socket")
    add("Plateforme", "socket", cpu & board, verdict([cpu_socket, board_socket], cpu_socket == board_socket, "error"))

    family = literal_map(CPU_FAMILIES)[_flat(_t("cpu", "Architecture"))]
    chipset = F.upper(_t("motherboard", "Chipset"))
    native = F.create_map(*[x for k, (n, _) in CHIPSET_SUPPORT.items() for x in (F.lit(k), _texts(n))])[chipset]
    updated = F.create_map(*[x for k, (_, b) in CHIPSET_SUPPORT.items() for x in (F.lit(k), _texts(b))])[chipset]
    add("Plateforme", "chipset", cpu & board, (
        F.when(family.isNull() | native.isNull(), "unknown").when(F.array_contains(native, family), "ok")
        .when(F.array_contains(updated, family), "warning").otherwise("error")
    ))
    igpu = _t("cpu", "iGPU")
    add("Plateforme", "display-output", cpu & ~gpu, verdict([igpu], _flat(igpu) != "absent", "error"))

    # Memory
    kind, accepted = _t("ram", "Type"), _t("motherboard", "RAM")
    add("Mémoire", "ram-type", ram & board, verdict([kind, accepted], F.contains(accepted, kind), "error"))
    sticks, slots = _n("ram", "Barrettes"), _n("motherboard", "Slots RAM")
    add("Mémoire", "ram-slots", ram & board, verdict([sticks, slots], sticks <= slots, "error"))
    size, limit = _n("ram", "Capacité"), _n("motherboard", "RAM max (Go)")
    add("Mémoire", "ram-capacity", ram & board, verdict([size, limit], size <= limit, "error"))
    speed, top = _n("ram", "Fréquence"), _n("motherboard", "RAM max (MHz)")
    add("Mémoire", "ram-speed", ram & board, verdict([speed, top], speed <= top, "warning"))
    ceiling = F.array_max(numbers_in(_t("cpu", "Mémoire")))
    add("Mémoire", "ram-controller", ram & cpu & speed.isNotNull() & (ceiling > 1000),
        verdict([speed, ceiling], speed <= ceiling, "info"))
    profile = _flat(_t("ram", "Profil"))
    xmp, expo, maker = profile.contains("xmp"), profile.contains("expo"), _field("cpu", "brand")
    mismatch = (expo & ~xmp & (maker == "Intel")) | (xmp & ~expo & (maker == "AMD"))
    add("Mémoire", "ram-profile", ram & cpu & (xmp | expo), F.when(mismatch, "warning").otherwise("ok"))

    # Fit
    board_form, forms = _t("motherboard", "Format"), _l("case", "Cartes mères")
    add("Intégration", "case-format", board & case, verdict([board_form, forms], F.array_contains(forms, board_form), "error"))
    add("Intégration", "gpu-length", gpu & case, _margin_status(_n("case", "GPU max (mm)") - _n("gpu", "Longueur (mm)"), 15))
    height, room = _n("cooling", "Hauteur (mm)"), _n("case", "Ventirad max (mm)")
    add("Intégration", "cooler-height", cooler & case & (height.isNotNull() | room.isNotNull()), _margin_status(room - height, 5))
    radiator, mounts = _n("cooling", "Radiateur (mm)"), numbers_in(_t("case", "Radiateurs"))
    add("Intégration", "radiator-mount", cooler & case & radiator.isNotNull(), (
        F.when(F.size(mounts) == 0, "unknown").when(F.array_contains(mounts, radiator), "ok").otherwise("error")
    ))
    psu_form, psu_forms = _t("psu", "Format"), _l("case", "Formats alimentation")
    add("Intégration", "psu-format", psu & case, verdict([psu_form, psu_forms], F.array_contains(psu_forms, psu_form), "error"))

    # Cooling
    sockets, tdp = _l("cooling", "Sockets compatibles"), _n("cpu", "TDP")
    add("Refroidissement", "cooler-socket", cooler & cpu, verdict([sockets, cpu_socket], F.array_contains(sockets, cpu_socket), "error"))
    watts = literal_map(COOLER_CLASS_W)[_flat(_t("cooling", "Capacité thermique"))]
    peak = cpu_peak(tdp)
    add("Refroidissement", "cooler-capacity", cooler & cpu, verdict([watts, peak], watts >= peak * 1.15, "warning"))
    add("Refroidissement", "cooler-missing", cpu & ~cooler, F.lit("unknown"))

    # Power
    power, advised = _n("psu", "Puissance"), _n("gpu", "PSU recommandé (W)")
    draw = system_draw(tdp, _n("gpu", "Consommation (W)"))
    add("Alimentation", "psu-power", psu, (
        F.when(power.isNull(), "unknown").when(advised.isNotNull() & (power < advised), "error")
        .when(power < draw * 1.25, "warning").otherwise("ok")
    ))
    needed, plug = _t("gpu", "Connecteurs"), _t("psu", "12V-2x6")
    flat_need = _flat(F.coalesce(needed, F.lit("")))
    modern = flat_need.contains("12vhpwr") | flat_need.contains("12v-2x6")
    available, required = connector_count(_t("psu", "PCIe")), connector_count(needed)
    add("Alimentation", "psu-connectors", psu & gpu, (
        F.when(needed.isNull(), "unknown")
        .when(modern, F.when(plug.isNotNull() & (plug != "Non"), "ok").otherwise("warning"))
        .otherwise(verdict([available, required], available >= required, "error"))
    ))
    atx3 = _t("psu", "ATX 3.x")
    add("Alimentation", "psu-atx3", psu & gpu & modern & atx3.isNotNull(), F.when(atx3 == "Oui", "ok").otherwise("warning"))

    # Storage
    drive = _flat(_t("storage", "Type"))
    m2, sata = _n("motherboard", "Ports M.2"), _n("motherboard", "Ports SATA")
    add("Stockage", "m2-port", storage & board & drive.contains("nvme"), verdict([m2], m2 >= 1, "error"))
    own, offered = pcie_generation(_t("storage", "Interface")), pcie_generation(_t("motherboard", "PCIe"))
    add("Stockage", "m2-generation", storage & board & drive.contains("nvme") & own.isNotNull() & offered.isNotNull(),
        F.when(own <= offered, "ok").otherwise("info"))
    add("Stockage", "sata-port", storage & board & drive.contains("sata"), verdict([sata], sata >= 1, "error"))

    # Connectivity
    functions = _flat(F.coalesce(_t("expansion", "Fonctions"), F.lit("")))
    add("Plateforme", "wifi", board & (_t("motherboard", "WiFi") == "Non") & ~functions.contains("wi-fi"), F.lit("info"))
    add("Plateforme", "expansion-slot", expansion & board, F.when(_t("motherboard", "PCIe").isNotNull(), "info").otherwise("unknown"))
    return rules


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# The fields each rule has read, shown with its status.
BASIS = {
    "socket": "Processeur.Socket · Carte mère.Socket",
    "chipset": "Processeur.Architecture · Carte mère.Chipset · Carte mère.BIOS Flashback",
    "display-output": "Processeur.iGPU",
    "ram-type": "Mémoire.Type · Carte mère.RAM",
    "ram-slots": "Mémoire.Barrettes · Carte mère.Slots RAM",
    "ram-capacity": "Mémoire.Capacité · Carte mère.RAM max (Go)",
    "ram-speed": "Mémoire.Fréquence · Carte mère.RAM max (MHz)",
    "ram-controller": "Mémoire.Fréquence · Processeur.Mémoire",
    "ram-profile": "Mémoire.Profil · Processeur.brand",
    "case-format": "Carte mère.Format · Boîtier.Cartes mères",
    "gpu-length": "Carte graphique.Longueur (mm) · Boîtier.GPU max (mm)",
    "cooler-height": "Refroidissement.Hauteur (mm) · Boîtier.Ventirad max (mm)",
    "radiator-mount": "Refroidissement.Radiateur (mm) · Boîtier.Radiateurs",
    "psu-format": "Alimentation.Format · Boîtier.Formats alimentation",
    "cooler-socket": "Refroidissement.Sockets compatibles · Processeur.Socket",
    "cooler-capacity": "Refroidissement.Capacité thermique · Processeur.TDP",
    "cooler-missing": "Configuration.refroidissement",
    "psu-power": "Alimentation.Puissance · Carte graphique.Consommation (W) · Carte graphique.PSU recommandé (W) · Processeur.TDP",
    "psu-connectors": "Carte graphique.Connecteurs · Alimentation.PCIe · Alimentation.12V-2x6",
    "psu-atx3": "Alimentation.ATX 3.x · Carte graphique.Connecteurs",
    "m2-port": "Stockage.Type · Carte mère.Ports M.2",
    "m2-generation": "Stockage.Interface · Carte mère.PCIe",
    "sata-port": "Stockage.Type · Carte mère.Ports SATA",
    "wifi": "Carte mère.WiFi · Carte d’extension.Fonctions",
    "expansion-slot": "Carte d’extension.Interface · Carte mère.PCIe",
    "empty": "Configuration",
}


def checks_of(resolved: DataFrame) -> DataFrame:
    """Array of check structs per resolved build."""
    entries = [
        F.when(when, F.struct(F.lit(group).alias("group"), F.lit(rule).alias("rule"), status.alias("status"),
                              F.lit(BASIS[rule]).alias("basis")))
        for group, rule, when, status in _rules()
    ]
    found = F.filter(F.array(*entries), lambda c: c.isNotNull())
    empty = F.array(F.struct(F.lit("Plateforme").alias("group"), F.lit("empty").alias("rule"),
                             F.lit("unknown").alias("status"), F.lit(BASIS["empty"]).alias("basis")))
    listed = resolved.select("build_id", *SLOTS, found.alias("found"))
    return listed.select("build_id", *SLOTS, F.when(F.size("found") == 0, empty).otherwise(F.col("found")).alias("checks"))


def check_builds(builds: DataFrame, products: DataFrame) -> DataFrame:
    """Check rows: build_id, position, group, rule, status, basis."""
    checked = checks_of(resolve_builds(builds, products))
    return checked.select("build_id", F.posexplode("checks").alias("position", "check")).select(
        "build_id", "position", "check.group", "check.rule", "check.status", "check.basis"
    )


def _verdict_columns(checks: Column) -> list[Column]:
    def count(status: str) -> Column:
        return F.size(F.filter(checks, lambda c: c["status"] == status)).cast("bigint")

    counts = {s: count(s) for s in STATUSES}
    only_empty = (F.size(checks) == 1) & (F.get(checks, 0)["rule"] == "empty")
    status = (
        F.when(only_empty, "unknown").when(counts["error"] > 0, "error").when(counts["warning"] > 0, "warning")
        .when((counts["unknown"] > 0) | (counts["ok"] == 0), "unknown").otherwise("ok")
    )
    return [status.alias("verdict"), *[counts[s].alias(f"n_{s}") for s in STATUSES]]


def build_verdict(builds: DataFrame, products: DataFrame) -> DataFrame:
    """Overall status and number of checks per status, straight from the check arrays: no second shuffle."""
    checked = checks_of(resolve_builds(builds, products))
    return checked.select("build_id", *_verdict_columns(F.col("checks")))


def verdict_from_checks(checks: DataFrame) -> DataFrame:
    """The same synthesis for check rows that were stored."""
    counts = checks.groupBy("build_id").pivot("status", list(STATUSES)).count().na.fill(0, list(STATUSES))
    lone = checks.groupBy("build_id").agg(F.count("*").alias("n"), F.max(F.col("rule") == "empty").alias("has_empty"))
    joined = counts.join(lone, "build_id")
    status = (
        F.when((F.col("n") == 1) & F.col("has_empty"), "unknown").when(F.col("error") > 0, "error")
        .when(F.col("warning") > 0, "warning").when((F.col("unknown") > 0) | (F.col("ok") == 0), "unknown").otherwise("ok")
    )
    return joined.select("build_id", status.alias("verdict"), *[F.col(s).alias(f"n_{s}") for s in STATUSES])


def _summary_columns() -> list[Column]:
    parts = [F.col(s) for s in SLOTS]
    price = [F.coalesce(p["new_price"], p["used_price"], F.lit(0.0)) for p in parts]
    priced = [(p["new_price"].isNotNull() | p["used_price"].isNotNull()).cast("int") for p in parts]
    draw = summary_draw(_n("cpu", "TDP"), _n("gpu", "Consommation (W)"))
    cpu_perf = F.nullif(_field("cpu", "performance"), F.lit(0.0))
    gpu_perf = F.nullif(_field("gpu", "performance"), F.lit(0.0))
    balance = (
        F.when(cpu_perf.isNull() | gpu_perf.isNull(), "À vérifier").when(F.abs(cpu_perf - gpu_perf) <= 15, "Équilibré")
        .when(cpu_perf > gpu_perf, "GPU limitant probable").otherwise("CPU limitant possible")
    )
    return [
        sum(price, start=F.lit(0.0)).alias("total"),
        sum((F.when(p.isNotNull(), x).otherwise(0) for p, x in zip(parts, priced)), start=F.lit(0)).alias("priced"),
        sum((p.isNotNull().cast("int") for p in parts), start=F.lit(0)).alias("parts"),
        js_round(draw).alias("estimated"), recommended_psu(draw).alias("recommended"),
        js_round(cpu_perf * 0.35 + gpu_perf * 0.65).alias("gaming"),
        js_round(cpu_perf * 0.9).alias("application"), balance.alias("balance"),
    ]


def build_summary(builds: DataFrame, products: DataFrame) -> DataFrame:
    """Total price, power and balance of every build."""
    return resolve_builds(builds, products).select("build_id", *_summary_columns())


def audit(builds: DataFrame, products: DataFrame) -> DataFrame:
    """Summary and verdict of every build in one pass."""
    checked = checks_of(resolve_builds(builds, products))
    return checked.select("build_id", *_summary_columns(), *_verdict_columns(F.col("checks")))
