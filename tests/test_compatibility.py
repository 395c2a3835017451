"""Compatibility rules on small builds."""

import pytest
from pyspark.sql import functions as F

from gearledger.functions.specs import SPEC_MAP
from gearledger.plans.compatibility import audit, build_verdict, check_builds, verdict_from_checks

N = lambda v: ("number", None, float(v), None, None)
T = lambda v: ("text", v, None, None, None)
L = lambda *v: ("list", None, None, None, list(v))

PARTS = {
    "cpu-am5": ("cpu", "AMD", {"Socket": T("AM5"), "Architecture": T("Zen 4"), "TDP": N(120), "iGPU": T("Radeon intégré"), "Mémoire": T("DDR5-5200")}),
    "cpu-am4": ("cpu", "AMD", {"Socket": T("AM4"), "Architecture": T("Zen 3"), "TDP": N(65), "iGPU": T("Absent"), "Mémoire": T("DDR4-3200")}),
    "cpu-intel9": ("cpu", "Intel", {"Socket": T("LGA1151 v2"), "Architecture": T("Coffee Lake Refresh"), "TDP": N(95)}),
    "cpu-intel13": ("cpu", "Intel", {"Socket": T("LGA1700"), "Architecture": T("Raptor Lake"), "TDP": N(125)}),
    "mb-z390": ("motherboard", "MSI", {"Socket": T("LGA1151 v2"), "Chipset": T("Z390"), "RAM": T("DDR4"), "Format": T("ATX"), "Slots RAM": N(4)}),
    "mb-b550": ("motherboard", "MSI", {"Socket": T("AM4"), "Chipset": T("b550"), "RAM": T("DDR4"), "Slots RAM": N(4), "WiFi": T("Non"), "PCIe": T("PCIe 4.0"), "Ports M.2": N(0)}),
    "mb-b650": ("motherboard", "MSI", {"Format": T("ATX")}),
    "mb-empty": ("motherboard", "X", {}),
    "ram-ddr5": ("ram", "K", {"Type": T("DDR5"), "Barrettes": N(2), "Fréquence": N(6000), "Profil": T("EXPO")}),
    "ram-ddr4": ("ram", "K", {"Type": T("DDR4"), "Barrettes": N(2), "Fréquence": N(3200), "Profil": T("XMP 2.0")}),
    "gpu-big": ("gpu", "X", {"Consommation (W)": N(263), "PSU recommandé (W)": N(700), "Connecteurs": T("2× 8 broches"), "Longueur (mm)": N(320)}),
    "gpu-modern": ("gpu", "X", {"Consommation (W)": N(220), "PSU recommandé (W)": N(650), "Connecteurs": T("1× 12VHPWR")}),
    "gpu-small": ("gpu", "X", {"Consommation (W)": N(170), "PSU recommandé (W)": N(550), "Connecteurs": T("1× 8 broches")}),
    "psu-w1": ("psu", "E", {"Puissance": N(500), "Format": T("ATX"), "PCIe": T("2× 6+2 broches")}),
    "psu-cx650": ("psu", "C", {"Puissance": N(650), "Format": T("ATX"), "PCIe": T("2× 6+2 broches"), "12V-2x6": T("Non"), "ATX 3.x": T("Non")}),
    "psu-rm750e": ("psu", "C", {"Puissance": N(750), "Format": T("ATX"), "PCIe": T("3× 6+2 broches"), "12V-2x6": T("12V-2x6"), "ATX 3.x": T("Oui")}),
    "case-nr200": ("case", "C", {"Cartes mères": L("Mini-ITX"), "Formats alimentation": L("SFX", "SFX-L"), "GPU max (mm)": N(330)}),
    "case-pop": ("case", "F", {"Cartes mères": L("ATX"), "Formats alimentation": L("ATX"), "Radiateurs": T("280 / 240 mm"), "Ventirad max (mm)": N(170)}),
    "cool-aio": ("cooling", "A", {"Radiateur (mm)": N(240), "Capacité thermique": T("Élevée"), "Sockets compatibles": L("AM4", "AM5")}),
    "ssd": ("storage", "W", {"Type": T("SSD NVMe"), "Interface": T("PCIe 4.0 x4")}),
    "ssd-old": ("storage", "W", {"Type": T("SSD SATA")}),
    "wifi-card": ("expansion", "T", {"Fonctions": T("Wi-Fi 6 et Bluetooth"), "Interface": T("PCIe x1")}),
}

CASES = [
    (("cpu-am5", "mb-z390"), "socket", "error"), (("ram-ddr5", "mb-z390"), "ram-type", "error"), (("ram-ddr4", "mb-b550"), "ram-slots", "ok"),
    (("gpu-big", "psu-w1"), "psu-power", "error"), (("psu-rm750e", "case-nr200"), "psu-format", "error"), (("mb-b650", "case-nr200"), "case-format", "error"),
    (("cpu-am4",), "display-output", "error"), (("cpu-am5",), "display-output", "ok"), (("cpu-intel9",), "display-output", "unknown"),
    (("cpu-intel9", "mb-z390"), "chipset", "ok"), (("cpu-am4", "mb-b550"), "chipset", "warning"), (("cpu-intel13", "mb-z390"), "chipset", "error"),
    (("cpu-am4", "mb-empty"), "chipset", "unknown"), (("cpu-am4", "mb-empty"), "socket", "unknown"), (("cool-aio", "case-pop"), "cooler-height", "unknown"),
    (("cool-aio", "case-pop"), "radiator-mount", "ok"), (("cool-aio", "case-nr200"), "radiator-mount", "unknown"), (("ram-ddr5", "cpu-intel13"), "ram-profile", "warning"),
    (("ram-ddr4", "cpu-am4"), "ram-profile", "warning"), (("ram-ddr5", "cpu-am5"), "ram-profile", "ok"), (("ram-ddr5", "cpu-am5"), "ram-controller", "info"),
    (("gpu-modern", "psu-cx650"), "psu-connectors", "warning"), (("gpu-modern", "psu-rm750e"), "psu-atx3", "ok"), (("gpu-small", "psu-rm750e"), "psu-connectors", "ok"),
    (("gpu-big", "case-nr200"), "gpu-length", "warning"), (("cool-aio", "cpu-am5"), "cooler-capacity", "ok"), (("cool-aio", "cpu-intel13"), "cooler-socket", "error"),
    (("cpu-am4",), "cooler-missing", "unknown"), (("ssd", "mb-b550"), "m2-port", "error"), (("ssd", "mb-b550"), "m2-generation", "ok"), (("ssd", "mb-empty"), "m2-port", "unknown"),
    (("ssd-old", "mb-empty"), "sata-port", "unknown"), (("mb-b550",), "wifi", "info"), (("wifi-card", "mb-b550"), "expansion-slot", "info"), (("ssd",), "empty", "unknown"),
    # lists that nobody published: the answer is unknown, not a failure
    (("mb-empty", "case-nr200"), "case-format", "unknown"), (("ram-ddr4", "mb-empty"), "ram-type", "unknown"),
]
ABSENT = [(("wifi-card", "mb-b550"), "wifi"), (("gpu-small", "psu-rm750e"), "psu-atx3"), (("ssd", "mb-empty"), "m2-generation"), (("cpu-am5", "gpu-big"), "display-output")]


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [(k, c, b, 100.0, None, 70.0, s) for k, (c, b, s) in PARTS.items()]
    products = spark.createDataFrame(rows, f"product_id string, category string, brand string, new_price double, used_price double, performance double, specs {SPEC_MAP}")
    sets = sorted({c[0] for c in CASES} | {a[0] for a in ABSENT} | {("cpu-am5", "gpu-big", "psu-rm750e")})
    builds = [("+".join(s), PARTS[p][0], p) for s in sets for p in s] + [("ghost", "cpu", "no-such-part")]
    return spark.createDataFrame(builds, "build_id string, slot string, product_id string"), products


def test_rules(inputs):
    found = {(r.build_id, r.rule): r.status for r in check_builds(*inputs).collect()}
    assert {(s, rule): found.get(("+".join(s), rule)) for s, rule, _ in CASES} == {(s, rule): status for s, rule, status in CASES}
    assert not [a for a in ABSENT if ("+".join(a[0]), a[1]) in found]
    assert found["ghost", "empty"] == "unknown"


def test_missing_inputs_never_pass(inputs):
    """No rule says ok when one of its sides publishes nothing."""
    rows = check_builds(*inputs).filter(F.col("build_id").contains("mb-empty")).collect()
    assert {r.status for r in rows} <= {"unknown", "info", "error"} or all(r.rule not in ("socket", "chipset", "ram-type", "case-format") for r in rows if r.status == "ok")


def test_verdicts_agree(inputs):
    direct = {r.build_id: r for r in build_verdict(*inputs).collect()}
    stored = {r.build_id: r for r in verdict_from_checks(check_builds(*inputs)).collect()}
    assert direct == stored
    assert direct["ssd"].verdict == "unknown" and direct["cpu-am5+mb-z390"].verdict == "error" and direct["cpu-am4"].n_error == 1


def test_draw_and_totals(inputs):
    row = audit(*inputs).filter("build_id = 'cpu-am5+gpu-big+psu-rm750e'").first()
    assert (row.total, row.parts, row.priced, row.estimated) == (300.0, 3, 3, 510.0)
    assert (row.recommended, row.gaming, row.application, row.balance) == (700.0, 70.0, 63.0, "Équilibré")
