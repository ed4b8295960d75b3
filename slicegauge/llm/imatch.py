"""Document fingerprints: I-Match over an inverse-document-frequency band (operator 9).

Terms (lower-cased words) whose document frequency lies inside a band make the
lexicon; too common and too rare ones are dropped. Equal texts count once in the
frequencies. Terms that are too common only by texts made up of too common terms
(a large group of near copies) stay in the lexicon. The lexicon is cut into
randomised subsets at three densities. Of every subset a text keeps its
distinct terms, sorted, and hashes them; the hashes together are the
fingerprint. Two texts are alike as far as their subsets agree, judged at the
sparsest density at which enough subsets of either hold a term.

All of it is DataFrame functions. The lexicon has at most 1 / `least` times the
mean number of distinct terms of a document, whatever the corpus, because every
one of its terms is in at least that share of the distinct texts; so it is broadcast.

Equal texts have equal fingerprints. A text with words, none of them in the
lexicon, has the hash of all its words in place of the subsets' hashes. A text
without words has an empty fingerprint, and two such texts have likeness 1. Null
texts are empty texts.
Rows without an id come last; rows with equal id and text are one behind the
other. In a table of one row the next document is the row itself. Only the id
and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .base import shuffle_parts

# (bits of the subset number, subsets used): shares of the lexicon 1/8, 1/64, 1/512
SCALES = ((3, 8), (6, 32), (9, 32))
LEAST_FILLED = 8
COPY_CLASSES = 1 << 20
MOST_COMMON = 0.75  # share of a text's terms above the band, beyond which it does not make terms common


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased words."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def each_text(texts: DataFrame) -> DataFrame:
    """text, copies: every distinct text once.

    Texts are put into `COPY_CLASSES` classes by a hash. Those of a class without a
    repeated hash stay where they are; the others are grouped, combined on the map side.
    """
    code = F.xxhash64("text")
    marks = materialize(texts.groupBy(code.alias("h")).count().filter("count > 1").select(F.pmod("h", F.lit(COPY_CLASSES)).alias("mark")).distinct())
    at = F.pmod(code, F.lit(COPY_CLASSES)) == F.col("mark")
    again = texts.join(F.broadcast(marks), at, "left_semi").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    once = texts.join(F.broadcast(marks), at, "left_anti").select("text", F.lit(1).cast("long").alias("copies"))
    return once.unionByName(materialize(again))


def frequent(texts: DataFrame, most: float, least: float) -> DataFrame:
    """term, common: the terms in at least two rows that are not too rare; common ones are above the band."""
    copies = F.col("copies") if "copies" in texts.columns else F.lit(1)
    df = texts.select(copies.alias("c"), F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("c").alias("rows"))
    n = texts.count()
    return df.filter((F.col("rows") >= 2) & (F.col("df") >= n * least)).select("term", (F.col("df") > max(2, n * most)).alias("common"))


def lexicon(texts: DataFrame, most: float = 0.05, least: float = 0.0005) -> DataFrame:
    """The terms inside the band, by document frequency over all rows of `texts` (at least 2)."""
    return frequent(texts, most, least).filter("NOT common").select("term")


def common_elsewhere(texts: DataFrame, common: DataFrame, most: float) -> DataFrame:
    """The common terms that stay above the band when only texts with enough other terms are counted.

    There are at most 1 / `most` times the mean number of distinct terms of a text, so every
    row can have them as an array. What is left out of the count are near copies in great
    number and texts of common words only; the latter's words are common elsewhere too.
    """
    all_common = common.agg(F.collect_list("term").alias("a"))
    rows = texts.select(terms(F.col("text")).alias("t")).crossJoin(F.broadcast(all_common)).select(
        F.size("t").alias("n"), F.array_intersect("t", "a").alias("c"))
    others = rows.filter(F.size("c") <= MOST_COMMON * F.col("n"))
    # term 0 counts the texts themselves
    df = materialize(others.select(F.explode(F.concat("c", F.array(F.lit(0).cast("long")))).alias("term")).groupBy("term").count())
    n = (df.filter("term = 0").first() or {"count": 0})["count"]
    return df.filter((F.col("term") != 0) & (F.col("count") > max(2, n * most))).select("term")


def full_lexicon(texts: DataFrame, most: float, least: float) -> DataFrame:
    """The band over distinct texts, and the common terms that are so by near copies only."""
    distinct = each_text(texts)
    found = materialize(frequent(distinct, most, least))
    return found.join(F.broadcast(common_elsewhere(distinct, found.filter("common"), most)), "term", "left_anti").select("term")


def order_buckets(texts: DataFrame, parts: int) -> Column:
    """The range of doc_id a row falls into, 0 for the largest ids; two short searches in sorted bounds."""
    steps = [i / parts for i in range(1, parts)]
    bounds = sorted(set(texts.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), F.lit(10_000)).alias("b")).first().b or [])) if steps else []
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + wide] for i in range(0, len(bounds), wide)]
    firsts = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    block = F.size(F.filter(firsts, lambda x: x <= F.col("doc_id")))
    at = F.when(block == 0, 0).otherwise((block - 1) * wide + F.size(F.filter(F.get(inner, block - 1), lambda x: x <= F.col("doc_id"))))
    return F.coalesce(F.lit(len(bounds)) - at, F.lit(len(bounds) + 1)).cast("int")


def in_order(texts: DataFrame) -> DataFrame:
    """bucket, at, doc_id, text, next_text, ghost: rows by descending id, each with the text behind it.

    Every bucket gets the first row of the next bucket as a ghost, so what looks
    one row ahead never leaves a bucket. One shuffle of the texts.
    """
    texts = texts.withColumn("bucket", order_buckets(texts, shuffle_parts(texts.sparkSession)))
    code = F.xxhash64("text")
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), code.alias("h"))
    heads = texts.groupBy("bucket").agg(F.max(key).alias("k"))
    # one row per bucket
    turn = Window.orderBy("bucket")
    back = heads.select(F.lag("bucket").over(turn).alias("into"), F.col("bucket").alias("own"), "k", F.max("bucket").over(Window.partitionBy()).alias("end"))
    back = materialize(back.select(F.coalesce("into", "end").alias("into"), "own", "k"))
    same = (F.col("bucket") == F.col("own")) & (key == F.col("k"))
    ghosts = texts.join(F.broadcast(back), same).groupBy("into").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    both = texts.select("bucket", "doc_id", "text", F.lit(False).alias("ghost")).unionByName(
        ghosts.select(F.col("into").alias("bucket"), "doc_id", "text", F.lit(True).alias("ghost")))
    run = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), code.desc())
    return both.select("bucket", F.row_number().over(run).alias("at"), "doc_id", "text",
                       F.coalesce(F.lead("text").over(run), F.lit("")).alias("next_text"), "ghost")


def entries(subset_rows: str) -> Column:
    """Sorted (subset, hash of its sorted terms) of one text, packed into longs: 12 bits subset, 52 bits hash."""
    return F.array_sort(F.collect_set(F.when(F.col(subset_rows).isNotNull(), F.shiftleft(F.col("subset").cast("long"), 52).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64(F.concat_ws(",", F.col(subset_rows))), 12)))))


def whole(found: str) -> Column:
    """Hash of all terms of a text in any order, NULL without terms."""
    return F.when(F.size(found) > 0, F.xxhash64(F.sort_array(found)))


def filled(marks: str, code: str) -> Column:
    """The entries of a text; if no subset holds a term, those of its hash as a whole in the first subsets."""
    stand_in = F.array(*[F.lit(s << 52).cast("long").bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(code), F.lit(s)), 12)) for s in range(SCALES[0][1])])
    return F.when((F.size(marks) == 0) & F.col(code).isNotNull(), stand_in).otherwise(F.col(marks))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets among those either text fills, at the sparsest density with enough of them."""
    out = None
    for i, (bits, used) in enumerate(SCALES):
        mine = lambda c, i=i: F.filter(c, lambda e: F.shiftrightunsigned(e, 60) == i)
        number = lambda c: F.transform(c, lambda e: F.shiftrightunsigned(e, 52))
        filled = F.size(F.array_union(number(mine(a)), number(mine(b))))
        share = F.size(F.array_intersect(mine(a), mine(b))) / F.greatest(filled, F.lit(1))
        out = F.when(filled == 0, F.lit(1.0)).otherwise(share) if out is None else F.when(filled >= LEAST_FILLED, share).otherwise(out)
    return out


def hexes(e: Column) -> Column:
    return F.concat_ws("", F.transform(e, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def fingerprints(docs: DataFrame, most: float = 0.05, least: float = 0.0005) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lex = full_lexicon(texts, most, least)
    rows = in_order(texts)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    base = ["bucket", "at", "doc_id", "n_chars", "edited_sha256", "ghost", "whole1", "whole2"]
    # one row per term, with the text it is in: 1 the document's, 2 the edited one's, 3 both; term 0 keeps texts without terms
    rows = rows.select("bucket", "at", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "ghost",
                       terms(F.col("text")).alias("t1"), terms(F.col("edited")).alias("t2"))
    rows = rows.withColumn("whole1", whole("t1")).withColumn("whole2", whole("t2"))
    tagged = F.concat(F.transform("t1", lambda t: F.struct(t.alias("term"), F.lit(1).alias("where"))),
                      F.transform("t2", lambda t: F.struct(t.alias("term"), F.lit(2).alias("where"))),
                      F.array(F.struct(F.lit(0).cast("long").alias("term"), F.lit(0).alias("where"))))
    each = rows.select(*base, F.explode(tagged).alias("x")).select(*base, "x.term", "x.where")
    lex = lex.unionByName(lex.sparkSession.range(1).select(F.col("id").alias("term")))
    each = each.join(F.broadcast(lex), "term")
    subsets = F.filter(F.array(*[
        F.when(F.shiftrightunsigned(F.xxhash64("term", F.lit(i)), 64 - bits) < used, F.lit(i * 256) + F.shiftrightunsigned(F.xxhash64("term", F.lit(i)), 64 - bits).cast("int"))
        for i, (bits, used) in enumerate(SCALES)]), lambda s: s.isNotNull())
    each = each.select(*base, "term", "where", F.explode(F.when(F.col("where") == 0, F.array(F.lit(-1))).otherwise(subsets)).alias("subset"))
    pick = lambda w: F.array_sort(F.collect_set(F.when(F.col("where") == w, F.col("term"))))
    per = each.groupBy(*base, "subset").agg(pick(1).alias("own"), pick(2).alias("other"))
    full = lambda c: F.when((F.size(c) > 0) & (F.col("subset") >= 0), F.col(c))
    per = per.select(*base, "subset", full("own").alias("own"), full("other").alias("other"))
    marks = per.groupBy(*base).agg(entries("own").alias("f"), entries("other").alias("g"))
    marks = marks.withColumn("f", filled("f", "whole1")).withColumn("g", filled("g", "whole2"))
    ahead = F.coalesce(F.lead("f").over(Window.partitionBy("bucket").orderBy("at")), F.col("f"))
    out = marks.withColumn("next", ahead).filter(~F.col("ghost"))
    return out.select("doc_id", "n_chars", "edited_sha256", hexes(F.col("f")).alias("fingerprint"), hexes(F.col("g")).alias("edited_fingerprint"),
                      likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next")).alias("near_next"))
