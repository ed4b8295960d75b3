"""Combined patterns find exactly what the single ones find in Python."""

import re

import pytest
from pyspark.sql import functions as F

from slicegauge.functions import text as tx

TEXTS = ["I HATE it", "hateful", "skill", "kill!", "élite kill", "ékill", "kill_", "Stupid", "idiot.", "slur2", "ſtupid", "Kill bill",
         "detonator", "a Detonator.", "blasting cap", "blast cap", "ammonium nitrate and fuel oil", "soft target", "nerve agent\n",
         "ammonium nitrate\nfuel oil", "mass casualties", "ingress/egress of a facility", "Weaponized", "weaponize", "x@y.z", "me.you+1@host-a.org",
         "12-34", "123-45-6789", "1 (555) 123-4567", "+1-555-123-4567", "555-123-4567", "٣٣٣-٤٤-٥٥٥٥", "", "  ", "abc", "ab cd", "b", "xy z"]
SETS = [(tx.TOXIC_TERMS, True), *[(p, True) for p in tx.DUAL_USE_PATTERNS.values()], *[(p, False) for p in tx.PII_PATTERNS.values()],
        ([r"\bab|cd"], False), ([r"\ba?b"], False), ([r"\b(a|b)c?", r"\bx(y|z)"], True), (r"\bx{0,1}y", False)]


@pytest.mark.parametrize("patterns,fold", SETS)
def test_same_hits_as_python(spark, patterns, fold):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", tx.matches(F.col("t"), patterns, fold).alias("m"))
    parts = [patterns] if isinstance(patterns, str) else patterns
    want = {t: any(re.search(p, t, re.I if fold else 0) is not None for p in parts) for t in TEXTS}
    assert {r.t: r.m for r in df.collect()} == want


def test_ordered_categories(spark):
    urls = {"https://news.site.com/a": "news", "http://x.blogspot.com": "blog", "HTTP://REDDIT.com/r": "forum",
            "https://www.amazon.com/dp/1": "ecommerce", "http://arxiv.org/abs": "academic", "https://x.gov": "gov",
            "http://en.wikipedia.org": "wiki", "http://plain.org": "other", None: "other"}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", tx.url_category(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == urls


def test_keyword_precedence(spark):
    words = {"WHITE": ["WHITE"], "BLACK": ["BLACK"], "LATE": ["HISPANIC", "LATINO"]}
    df = spark.createDataFrame([("white/black",), ("Latino",), ("x",), (None,)], "r string")
    assert [r[0] for r in df.select(tx.keyword_category(F.col("r"), words)).collect()] == ["WHITE", "LATE", "OTHER", "UNKNOWN"]
