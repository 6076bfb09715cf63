import pytest

from statwarden.operators.capability import with_capabilities

# fixed values: version, edition, create-or-alter, maxdop, persist, rebuild keeps, histogram
GOLDEN = [
    ("13.0.1601.5", 3, 0, 0, 0, 0, 0), ("13.0.4422.0", 3, 1, 0, 0, 0, 1), ("13.0.4435.0", 3, 1, 0, 0, 0, 1),
    ("13.0.4446.0", 3, 1, 0, 1, 0, 1), ("13.0.5026.0", 3, 1, 1, 1, 0, 1), ("13.0.5888.11", 3, 1, 1, 1, 1, 1),
    ("14.0.1000.169", 3, 1, 0, 0, 0, 1), ("14.0.3006.16", 3, 1, 0, 1, 0, 1), ("14.0.3008.27", 3, 1, 0, 1, 0, 1),
    ("14.0.3015.40", 3, 1, 1, 1, 0, 1), ("14.0.3411.3", 3, 1, 1, 1, 1, 1), ("15.0.2000.5", 3, 1, 1, 1, 0, 1),
    ("15.0.4123.1", 3, 1, 1, 1, 1, 1), ("16.0.1000.6", 3, 1, 1, 1, 1, 1), ("17.0.4085.5", 3, 1, 1, 1, 1, 1),
    ("12.0.2000.8", 8, 1, 1, 1, 1, 1),
]
FLAGS = ["supports_create_or_alter", "supports_maxdop", "supports_persist", "supports_rebuild_keeps", "supports_histogram"]


def test_golden_builds(spark):
    df = spark.createDataFrame([g[:2] for g in GOLDEN], "product_version string, engine_edition int")
    found = {(r.product_version, r.engine_edition): r for r in with_capabilities(df).collect()}
    for version, edition, *flags in GOLDEN:
        row = found[version, edition]
        assert row.supported_engine
        assert [int(row[f]) for f in FLAGS] == flags, version
    assert found["12.0.2000.8", 8].supports_ce_feedback is None


@pytest.mark.parametrize("version, edition", [("13.0.5026", 3), ("abc", 3), ("14.0.999.1", 3), ("12.0.2000.8", 3), ("16.1.1000.0", 3), ("16.0.1000.6", 5)])
def test_unknown_builds_have_no_flags(spark, version, edition):
    df = spark.createDataFrame([(version, edition)], "product_version string, engine_edition int")
    row = with_capabilities(df).head()
    assert not row.supported_engine and row.build_rule_status == "UNRECOGNIZED_ENGINE_OR_VERSION"
    assert all(row[f] is None for f in FLAGS)
