"""Scores that are sums of decimals meet a gate that they equal."""

from slicegauge.operators import metadata as md
from slicegauge.operators.composite import composites, passes_threshold


def test_decimal_sums_are_exact(spark):
    """F2: 0.8 - 0.1 in doubles is above 0.7, which put a rights mean of 0.6 beyond its gate."""
    cat = spark.createDataFrame([("a", "scraped", True, True, True, 5, "broad", 0.0)],
                                "dataset string, consent_type string, subject_consent_documented boolean, subject_access_process boolean, "
                                "correction_process boolean, source_count int, scraping_breadth string, ugc_fraction double")
    meta = md.Metadata(cat)
    proxies = [md.consent_provenance(meta), md.contestability(meta), md.poisoning_susceptibility(meta), md.adversarial_provenance_risk(meta)]
    long = md.score_catalog(cat, proxies, ["dataset"])
    got = {r["name"]: r["score"] for r in long.collect()}
    assert got == {"consent_provenance": 0.7, "contestability": 0.5, "poisoning_susceptibility": 0.7, "adversarial_provenance_risk": 0.21}
    row = composites(long, "ML", ["dataset"]).select("rights", passes_threshold(0.0, 0.6, 0.6).alias("ok")).first()
    assert row.rights == 0.6 and row.ok
