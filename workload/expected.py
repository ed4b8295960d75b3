"""What the SQL twins expect, written out by hand.

Fixed values. Nothing here is taken from the library, so a wrong weight,
category or pattern there shows as a difference in the rows.
"""

TRUST = ("source_identifier", "collection_methodology", "institutional_pedigree", "versioning", "license")
SECURITY = ("checksum_published", "signed_releases", "access_logging", "chain_of_custody")
CONTEST = ("subject_access_process", "correction_process", "deletion_process", "contact_for_subject_rights")

OBJECTIVITY = """CASE content_type WHEN 'measurement' THEN 1.0 WHEN 'transactional' THEN 1.0 WHEN 'reference' THEN 1.0 WHEN 'mixed' THEN 0.5
  WHEN 'opinion' THEN 0.1 WHEN 'review' THEN 0.1 WHEN 'subjective_survey' THEN 0.1 ELSE 0.5 END"""
BREADTH = """CASE coalesce(scraping_breadth, 'narrow') WHEN 'narrow' THEN 0.0 WHEN 'medium' THEN 0.3 WHEN 'broad' THEN 0.7
  WHEN 'web_scale' THEN 1.0 ELSE 0.5 END"""
CONSENT = """CASE consent_type WHEN 'opt_in' THEN 0.2 WHEN 'opt_out' THEN 0.5 WHEN 'inferred' THEN 0.8 WHEN 'scraped' THEN 0.8
  WHEN 'none' THEN 1.0 ELSE 1.0 END"""

WEIGHTS = {
    "DW": """CASE name WHEN 'appropriate_amount' THEN 0.5 WHEN 'representativeness' THEN 0.9 WHEN 'source_trustworthiness' THEN 0.9
      WHEN 'free_of_error' THEN 0.9 WHEN 'objectivity' THEN 0.8 WHEN 'relevance' THEN 0.9 WHEN 'timeliness' THEN 0.3
      WHEN 'source_security' THEN 0.9 ELSE 1.0 END""",
    "ML": """CASE name WHEN 'appropriate_amount' THEN 0.6 WHEN 'representativeness' THEN 0.9 WHEN 'source_trustworthiness' THEN 0.7
      WHEN 'free_of_error' THEN 0.9 WHEN 'objectivity' THEN 0.8 WHEN 'relevance' THEN 0.9 WHEN 'timeliness' THEN 0.7
      WHEN 'source_security' THEN 0.9 ELSE 1.0 END""",
    "LLM": """CASE name WHEN 'appropriate_amount' THEN 0.8 WHEN 'representativeness' THEN 0.7 WHEN 'source_trustworthiness' THEN 0.5
      WHEN 'free_of_error' THEN 0.8 WHEN 'objectivity' THEN 0.7 WHEN 'relevance' THEN 0.8 WHEN 'timeliness' THEN 0.7
      WHEN 'source_security' THEN 0.9 ELSE 1.0 END""",
}

TOXIC = r"regexp_matches(text, '\b(hate|kill|stupid|idiot|slur1|slur2)\b', 'i')"
PII = {
    "email": r"regexp_matches(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', 'c')",
    "ssn_like": r"regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b', 'c')",
    "phone_like": r"regexp_matches(text, '\b\+?\d{1,3}?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', 'c')",
}
DUAL_USE = {
    "explosives_synthesis": [r"\bdetonator\b", r"\bblast(ing)? cap\b", r"\bammonium nitrate.*fuel oil\b"],
    "cbrn_agents": [r"\bweaponiz(?:e|ed|ing)\b", r"\baerosolized.*pathogen\b", r"\bnerve agent\b", r"\bbinary chemical weapon\b"],
    "attack_planning": [r"\bmass casualt(?:y|ies)\b", r"\bsoft target\b", r"\bingress/egress.*facility\b"],
}
