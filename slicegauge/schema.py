"""Names, axes and weights of the scorecard."""

from __future__ import annotations

# Quality: high is good. Safety and rights: high is risky.
QUALITY, SAFETY, RIGHTS = "quality", "safety", "rights"
APPLICATIONS = ("DW", "ML", "LLM")

# The 19 proxies in scorecard order; the position is the `ord` column.
PROXIES = (
    (QUALITY, "appropriate_amount"), (QUALITY, "representativeness"),
    (QUALITY, "source_trustworthiness"), (QUALITY, "free_of_error"),
    (QUALITY, "objectivity"), (QUALITY, "relevance"),
    (QUALITY, "timeliness"), (QUALITY, "source_security"),
    (SAFETY, "poisoning_susceptibility"), (SAFETY, "adversarial_provenance_risk"),
    (SAFETY, "factual_decay_rate"), (SAFETY, "harm_content_density"),
    (SAFETY, "physical_harm_enablement_density"), (SAFETY, "safety_critical_edge_case_coverage"),
    (RIGHTS, "demographic_representation_gap"), (RIGHTS, "consent_provenance"),
    (RIGHTS, "reidentification_risk"), (RIGHTS, "inferential_harm_potential"),
    (RIGHTS, "contestability"),
)
ORDER = {name: i for i, (_, name) in enumerate(PROXIES, start=1)}
AXIS = {name: axis for axis, name in PROXIES}

# Quality weights per application; an unlisted name weighs 1.0.
QUALITY_WEIGHTS = {
    "DW": {"appropriate_amount": 0.5, "representativeness": 0.9, "source_trustworthiness": 0.9,
           "free_of_error": 0.9, "objectivity": 0.8, "relevance": 0.9, "timeliness": 0.3,
           "source_security": 0.9},
    "ML": {"appropriate_amount": 0.6, "representativeness": 0.9, "source_trustworthiness": 0.7,
           "free_of_error": 0.9, "objectivity": 0.8, "relevance": 0.9, "timeliness": 0.7,
           "source_security": 0.9},
    "LLM": {"appropriate_amount": 0.8, "representativeness": 0.7, "source_trustworthiness": 0.5,
            "free_of_error": 0.8, "objectivity": 0.7, "relevance": 0.8, "timeliness": 0.7,
            "source_security": 0.9},
}

SCORES_LONG = ("ord int, axis string, name string, score double, applicable boolean, "
               "raw_value string, details string")
