"""Every operator of the inventory has a registered query."""

from surgecast import checks

INVENTORY = {
    "A": [*range(1, 11), 11, 13], "B": range(1, 8), "C": range(1, 12), "D": [1, 2, 3, 4, 5, 7], "E": range(1, 7),
    "F": [1, 2, "2b", *range(3, 9), 10], "G": range(1, 8), "H": range(1, 4), "I": range(1, 8), "J": range(1, 8),
    "K": range(1, 11), "L": range(1, 6), "M": range(1, 11), "N": range(1, 7),
}


def test_inventory_is_covered():
    covered = {c for names in checks.load()["COVERS"].values() for c in names}
    wanted = {f"{area}{n}" for area, ns in INVENTORY.items() for n in ns}
    assert wanted - covered == set()


def test_only_fits_and_whole_flows_lack_sql():
    reg = checks.load()
    assert set(reg["QUERIES"]) - set(reg["SQL"]) == {
        "seasonal_forecast", "sequence_forecast", "sequence_error", "feature_forecast", "model_round_trip", "training_run", "control_tick", "streaming_model_tick",
    }
