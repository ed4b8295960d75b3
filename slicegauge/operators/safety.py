"""Safety proxies that read the data (high = risky)."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sql
from ..functions.columns import no_nan
from ..functions.hashing import draw_key
from ..functions.text import DUAL_USE_PATTERNS, PII_PATTERNS, TOXIC_TERMS, TOXICITY_CATEGORIES, any_hit, is_text, matches
from .proxy import Proxy, not_applicable, single
from .ranking import hash_ranked

Toxicity = str | Sequence[str] | Callable[[Column], Column]


def toxic_flag(text: Column, classifier: Toxicity = "lexicon", threshold: float = 0.7) -> Column:
    """Whether a text counts as toxic.

    `classifier` is 'lexicon', 'none', 'categories' (the usual six score columns), a list of score columns (their maximum
    is compared), or a function text column -> score column such as a
    vectorized pandas UDF.
    """
    if classifier == "categories":
        classifier = TOXICITY_CATEGORIES
    if callable(classifier):
        return F.coalesce(classifier(text) >= threshold, F.lit(False))
    if classifier == "lexicon":
        return matches(text, TOXIC_TERMS, ignore_case=True)
    if classifier == "none":
        return F.lit(False)
    cols = [no_nan(F.col(c).cast("double")) for c in ([classifier] if isinstance(classifier, str) else classifier)]
    top = cols[0] if len(cols) == 1 else F.greatest(*cols)
    return F.coalesce(top >= threshold, F.lit(False))


def _sampled(df: DataFrame, text: str, by: Sequence[str], size: int, seed: int,
             key: str | None, small_bytes: int | None) -> DataFrame:
    """At most `size` non-blank texts per group, in md5 order of the row key."""
    k = F.col(key) if key else F.md5(F.col(text))
    rows = df.where(is_text(F.col(text))).withColumn("__k", draw_key(seed, "texts", k))
    return hash_ranked(rows, by, "__k", [key] if key else [text], "__r", size, small_bytes)


def _text_proxy(df: DataFrame, name: str, text: str | None, by: Sequence[str], hits: dict[str, Column],
                either: dict[str, list[str]], score: str, raw: str, details: dict[str, str], sample_size: int | None, seed: int,
                key: str | None, small_bytes: int | None) -> Proxy:
    """Counts of usable texts and of `hits` among them; `score` and the rest are SQL over the counts.

    In that SQL `{k}` stands for the count of hit `k` and `{n}` for the number of texts read;
    `either` names counts of texts with at least one of several hits.
    """
    if text is None or text not in df.columns:
        return not_applicable(name, 0.0, "no text column")
    p = "__" + "".join(w[0] for w in name.split("_")) + "_"
    # every pattern is matched once per text; blank texts match nothing
    usable = {p + "ok": is_text(F.col(text))}
    flags = {p + "f_" + k: F.when(is_text(F.col(text)), c) for k, c in hits.items()}
    count_ok = F.count_if(F.col(p + "ok"))
    aggs = [count_ok.alias(p + "n"), *[F.count_if(F.col(p + "f_" + k)).alias(p + k) for k in hits],
            *[F.expr(f"count_if({' OR '.join(p + 'f_' + k for k in ks)})").alias(p + a) for a, ks in either.items()]]
    frames, pool, rows = [], "n", {**usable, **flags}
    if sample_size is not None:
        pool = "pool"
        sample = _sampled(df, text, by, sample_size, seed, key, small_bytes)
        frames = [sample.withColumns(rows).groupBy(*by).agg(*aggs)]
        aggs, rows = [count_ok.alias(p + pool)], usable
    cell = {k: f"coalesce({p}{k}, 0)" for k in ["n", pool, *hits, *either]}
    details = {k: v.format(**cell) for k, v in details.items()}
    details |= {"sample_size_used": cell["n"], "population_size": cell[pool],
                "reason": f"IF({cell['n']} = 0, 'no usable text', NULL)"}
    return Proxy(name, score.format(**cell), f"{cell['n']} > 0", raw.format(**cell), details, aggs, frames, rows)


def harm_content_proxy(df: DataFrame, text: str | None, by: Sequence[str] = (),
                       sample_size: int | None = None, threshold: float = 0.7,
                       classifier: Toxicity = "lexicon", pii: Mapping[str, str] | None = None,
                       seed: int = 42, key: str | None = None, small_bytes: int | None = None) -> Proxy:
    hits = {}
    if text:
        hits = {"tox": toxic_flag(F.col(text), classifier, threshold),
                "pii": any_hit(F.col(text), PII_PATTERNS if pii is None else pii)}
    tox, pri = "coalesce(try_divide({tox}, {n}), 0.0D)", "coalesce(try_divide({pii}, {n}), 0.0D)"
    raw = f"to_json({sql.struct({'toxic_fraction': tox, 'pii_fraction': pri})})"
    used = classifier if isinstance(classifier, str) else "scores"
    return _text_proxy(df, "harm_content_density", text, by, hits, {}, f"greatest({tox}, {pri})", raw,
                       {"classifier_used": sql.value(used), "toxicity_threshold": sql.value(float(threshold))},
                       sample_size, seed, key, small_bytes)


def harm_content_density(df: DataFrame, text: str, by: Sequence[str] = (), **options) -> DataFrame:
    """Larger of the toxic share and the personal-data share of the texts.

    All texts are read by default; `sample_size` turns on a seeded sample.
    """
    return single(df, harm_content_proxy(df, text, by, **options), by)


def text_flags(df: DataFrame, text: str, patterns: Mapping[str, str | Sequence[str]],
               by: Sequence[str] = (), ignore_case: bool = False) -> DataFrame:
    """(by, n_texts, n_<pattern>..., n_any): texts with a hit, per pattern and overall."""
    flags = {f"__f_{k}": F.when(is_text(F.col(text)), matches(F.col(text), p, ignore_case)) for k, p in patterns.items()}
    out = df.withColumns({**flags, "__ok": is_text(F.col(text))})
    one = [F.count_if(F.col(f"__f_{k}")).alias(f"n_{k}") for k in patterns]
    return out.groupBy(*by).agg(F.count_if(F.col("__ok")).alias("n_texts"), *one,
                                F.expr(f"count_if({' OR '.join(sql.name(f) for f in flags)})").alias("n_any"))


def physical_harm_proxy(df: DataFrame, text: str | None, by: Sequence[str] = (),
                        sample_size: int | None = None,
                        patterns: Mapping[str, Sequence[str]] | None = None, seed: int = 42,
                        key: str | None = None, small_bytes: int | None = None) -> Proxy:
    pats, hits = patterns or DUAL_USE_PATTERNS, {}
    either = {"any": [f"c{i}" for i in range(len(pats))]}
    if text:
        hits = {f"c{i}": matches(F.col(text), p, True) for i, p in enumerate(pats.values())}
    share = "coalesce(try_divide({any}, {n}), 0.0D)"
    per = sql.struct({k: f"{{c{i}}}" for i, k in enumerate(pats)})
    return _text_proxy(df, "physical_harm_enablement_density", text, by, hits, either, share, share,
                       {"flagged_count": "{any}", "per_category_hits": per}, sample_size, seed, key,
                       small_bytes)


def physical_harm_enablement_density(df: DataFrame, text: str, by: Sequence[str] = (), **options) -> DataFrame:
    """Share of texts that hit any dual-use pattern."""
    return single(df, physical_harm_proxy(df, text, by, **options), by)


LITERAL = r"'(?:[^'\\]|\\.|'')*'"
WHOLE = ("tinyint", "smallint", "int", "integer", "bigint", "long")
# lower-cased texts that are certainly no whole number, no floating one
NO_NUMBER = {**dict.fromkeys(WHOLE, "[a-z]|^[^0-9]*$"), **dict.fromkeys(("float", "double"), "[bcghj-mo-su-xz]|^[^0-9in]*$")}


def _try_casts(predicate: str) -> str:
    """CAST as TRY_CAST; a text that cannot be a number is told by a pattern, as an exception per row costs far more than the scan."""
    out, i = "", 0
    for m in re.finditer(LITERAL + r"|\bcast\s*\(", predicate, flags=re.I):
        if m.start() < i or m.group().startswith("'"):
            continue
        depth, end = 1, m.end()
        for t in re.compile(LITERAL + r"|[()]").finditer(predicate, m.end()):
            depth += {"(": 1, ")": -1}.get(t.group(), 0)
            if not depth:
                end = t.start()
                break
        found = re.fullmatch(r"(.*)\sas\s+(.*?)\s*", predicate[m.end():end], flags=re.I | re.S)
        if not found:
            continue
        x, kind = _try_casts(found.group(1)), found.group(2)
        cast = f"TRY_CAST({x} AS {kind})"
        if kind.lower() in NO_NUMBER:
            cast = f"IF(typeof({x}) = 'string' AND lower({x}) RLIKE '{NO_NUMBER[kind.lower()]}', NULL, {cast})"
        out += predicate[i:m.start()] + cast
        i = end + 1
    return out + predicate[i:]


def _lenient(predicate: str) -> str:
    """A SQL predicate whose casts and divisions give NULL where they would fail; text literals stay as they are."""
    parts = re.split(f"({LITERAL})", _try_casts(predicate))
    for i in range(0, len(parts), 2):
        # the divisor: a name, a number, a call or a bracket without brackets inside
        parts[i] = re.sub(r"([/%])\s*([\w.`]+(?:\([^()]*\))?|\([^()]*\))", r"\1 nullif(\2, 0)", parts[i])
    return "".join(parts)


def edge_case_proxy(df: DataFrame, specs: Sequence[Mapping] | None, coupled: bool) -> Proxy:
    """`specs` hold a name, a filter (SQL predicate or Column) and a minimum count.

    A predicate that cannot be resolved is unsatisfied. One that fails on a row
    while running (a bad cast, a division by zero) does not count that row; a
    Column, or a divisor with nested brackets, must see to that itself.
    """
    name = "safety_critical_edge_case_coverage"
    if not coupled:
        return not_applicable(name, 0.0, "not coupled to a physical process")
    if not specs:
        return Proxy(name, "1.0D", details={"reason": "'no edge cases specified'"})
    aggs, ok, details = [], [], {}
    for i, s in enumerate(specs):
        need = int(s.get("min_count", 1))
        cond = F.expr(_lenient(s["filter"])) if isinstance(s["filter"], str) else s["filter"]
        agg = F.count_if(cond.cast("boolean")).alias(f"__edge{i}")
        try:
            # analysis only: a predicate that cannot be resolved is unsatisfied
            df.select(agg).schema
        except AnalysisException as e:
            details[s["name"]] = sql.value(f"error: {e.getCondition()}")
            continue
        aggs.append(agg)
        n = f"coalesce(__edge{i}, 0)"
        ok.append(f"CAST({n} >= {need} AS INT)")
        details[s["name"]] = sql.struct({"count": n, "min_required": str(need), "ok": f"{n} >= {need}"})
    coverage = f"({sql.plus(ok)} / {float(len(specs))!r}D)"
    return Proxy(name, f"1 - {coverage}", raw_value=coverage, details=details, aggs=aggs)


def edge_case_coverage(df: DataFrame, specs: Sequence[Mapping] | None, coupled: bool = True,
                       by: Sequence[str] = ()) -> DataFrame:
    """Share of the specified rare conditions that the data does not cover."""
    return single(df, edge_case_proxy(df, specs, coupled), by)


def source_counts(df: DataFrame, source: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, source_count): number of distinct contributing sources found in the data."""
    return df.groupBy(*by).agg(F.count_distinct(F.col(source)).alias("source_count"))
