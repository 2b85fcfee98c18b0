"""Document fingerprints: I-Match over randomised lexicon subsets.

The lexicon has the terms within a band of inverse document frequency.  Document
frequencies are counted exactly, term by term, and terms are joined to the band.
As the band has a lower end, relative to the number of documents, its size has a
bound that does not grow with them: terms per document over that end.

A document keeps the distinct terms of the band; each of SUBSETS random subsets
of the lexicon sorts those of its terms and hashes them.  Subsets thin out with
the length of the text, by powers of two, so that each keeps about one term of a
document and survives small edits.  The hashes at the next power are kept as
well, and two texts are compared at a power that both have, so a copy on the
other side of a boundary stays alike.  A text that has no term in any subset is
told by a hash of all its terms instead, so only empty texts look alike by having
nothing.  All is DataFrame functions: no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, likely_in, small

SUBSETS = 64
#: Code points per document for which a subset of the lexicon is a 64th part.
CHARS_PER_LEVEL = 512
#: Band of document frequency as a share of all documents; a term of one document only is out, too.
BAND = (1e-4, 0.02)
#: The band is broadcast up to so many terms, else joined by shuffling terms.
BAND_ROWS = 2_000_000
#: Marks a subset in which a document has no term.
NONE = "-"
#: Begins the first place of a text that no subset has a term of; a hash of all its terms follows.
WHOLE = "="
#: Documents of one ordered run, what a task sorts; and runs at most, beyond which runs get longer (sorts spill).
RUN, MOST_RUNS = 500, 100_000


def terms_of(text: Column) -> Column:
    """Distinct 64-bit term hashes: words in lower case, cut at anything that is no letter, mark or digit."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexicon(texts: DataFrame, n: int, band: tuple[float, float] = BAND) -> DataFrame:
    """band_term: the terms of texts(t), n rows, whose document frequency lies in the band."""
    counts = texts.select(F.explode(terms_of(F.col("t"))).alias("band_term")).groupBy("band_term").agg(F.count("*").alias("df"))
    return cut(counts.where(F.col("df").between(max(2, math.ceil(band[0] * n)), max(2, math.floor(band[1] * n)))).select("band_term"))


def level_of(n_chars: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n_chars, F.lit(1)) / CHARS_PER_LEVEL)).cast("int"))


def slot_of(term: Column, level: Column) -> Column:
    """Subset of a term at a level, if less than SUBSETS; a term that has one at a level has the same at all lower ones."""
    return F.shiftright(term, 18).bitwiseAND(F.call_function("shiftleft", F.lit(SUBSETS).cast("long"), level) - 1)


def digests(chosen: Column) -> Column:
    """SUBSETS hashes (hexadecimal, or NONE) of sorted structs (s, t)."""
    def of_group(group: Column, g: Column) -> Column:
        mine = lambda k: F.concat_ws(" ", F.transform(F.filter(group, lambda x: x["s"] == g * 8 + k), lambda x: F.hex(x["t"])))
        return F.transform(F.sequence(F.lit(0), F.lit(7)), mine)

    groups = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS // 8 - 1)), lambda g: F.filter(chosen, lambda x: F.shiftright(x["s"], 3) == g))
    return F.transform(F.flatten(F.transform(groups, of_group)), lambda x: F.when(x == "", NONE).otherwise(F.substring(F.md5(x.cast("binary")), 1, 8)))


def at_level(chosen: Column, level: Column) -> Column:
    """Those of the chosen terms that a level not lower than theirs also chooses."""
    return F.filter(chosen, lambda x: slot_of(x["t"], level) < SUBSETS)


def in_subsets(terms: Column, level: Column) -> Column:
    """The terms that some subset of the level has, in the band or not."""
    return F.filter(terms, lambda t: slot_of(t, level) < SUBSETS)


def sketch(text: Column, level: Column) -> Column:
    """Struct of terms, those that some subset of the level has, and mark, which stands for all terms.

    The mark does not depend on their order.  A text without terms is marked by
    itself, an empty one not at all.
    """
    mark = lambda ts: F.when(F.size(ts) > 0, F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t))).when(text != "", F.xxhash64(text))
    return let(terms_of(text), lambda ts: F.struct(in_subsets(ts, level).alias("terms"), mark(ts).alias("mark")))


def marked(hashes: Column, x: Column) -> Column:
    """hashes, the first replaced by WHOLE and the mark if x has chosen no terms but has a mark."""
    own = F.concat(F.lit(WHOLE), F.lower(F.hex(x["mark"])))
    return F.when((F.size(x["chosen"]) == 0) & x["mark"].isNotNull(), F.concat(F.array(own), F.slice(hashes, 2, SUBSETS - 1))).otherwise(hashes)


def fingerprint_of(terms: Column, level: Column, mark: Column) -> Column:
    """Struct of level, mark, chosen (sorted structs of subset and term) and fp: SUBSETS hashes at the level, and as many at the next.

    terms: those of the band that the level's subsets have.  The subset s has the
    terms h with h / 2**18 mod (SUBSETS * thin) = s, thin being 2 to the level.
    """
    def complete(x: Column) -> Column:
        at = lambda chosen: marked(let(chosen, digests), x)
        fp = F.concat(at(x["chosen"]), at(at_level(x["chosen"], x["level"] + 1)))
        return F.struct(x["level"].alias("level"), x["mark"].alias("mark"), x["chosen"].alias("chosen"), fp.alias("fp"))

    chosen = lambda v: F.sort_array(F.transform(terms, lambda t: F.struct(slot_of(t, v).alias("s"), t.alias("t"))))
    return let(let(level, lambda v: F.struct(v.alias("level"), mark.alias("mark"), chosen(v).alias("chosen"))), complete)


def with_band_terms(rows: DataFrame, lists: list[Column], facts: list[str], band: DataFrame) -> DataFrame:
    """facts, and terms: array of (term in the band, its last three bits being 1 + the number of its list), one row per row of rows.

    Terms are exploded, kept if the band has them, and brought together again; a
    row's facts travel with one entry of its own.  A bitmap of the band keeps most
    other terms from being exploded.  The band is broadcast if a count shows it to
    be small, else terms are shuffled.
    """
    likely = likely_in(band, "band_term")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    nothing = F.lit(None).cast(numbered.select(F.struct(*facts).alias("f")).schema["f"].dataType)
    entry = lambda term, code, of: F.struct(term.alias("term"), F.lit(code).cast("long").alias("code"), of.alias("facts"))
    own = F.array(entry(F.xxhash64("row"), 0, F.struct(*facts)))
    listed = lambda terms, code: F.transform(F.filter(terms, likely), lambda t: entry(t, code, nothing))
    entries = F.concat(own, *[listed(terms, k + 1) for k, terms in enumerate(lists)])
    exploded = numbered.select("row", F.explode(entries).alias("e")).select("row", "e.term", "e.code", "e.facts")
    joined = exploded.join(small(band, BAND_ROWS), F.col("term") == F.col("band_term"), "left").where("code = 0 OR band_term IS NOT NULL")
    packed = F.when(F.col("code") > 0, F.col("term").bitwiseAND(F.lit(-8)).bitwiseOR(F.col("code")))
    together = joined.groupBy("row").agg(F.first("facts", ignorenulls=True).alias("facts"), F.collect_list(packed).alias("terms"))
    return together.select("facts.*", "terms")


def of_list(*codes: int) -> Column:
    """The terms of the lists with these numbers (from 1), without the number."""
    return F.transform(F.filter("terms", lambda t: t.bitwiseAND(F.lit(7)).isin(*codes)), lambda t: t.bitwiseAND(F.lit(-8)))


def likeness(a: Column, b: Column) -> Column:
    """Equal places among those in which either document has something; two documents without any: 1."""
    def share(pairs: Column) -> Column:
        equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
        return F.when(F.size(pairs) == 0, 1.0).otherwise(equal / F.size(pairs)).cast("double")

    return let(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] != NONE) | (p["y"] != NONE)), share)


def alike(a: Column, b: Column) -> Column:
    """likeness of two results of fingerprint_of, both at the higher of their levels."""
    own, above = (lambda x: F.slice(x["fp"], 1, SUBSETS)), (lambda x: F.slice(x["fp"], SUBSETS + 1, SUBSETS))
    apart = b["level"] - a["level"]
    common = lambda x: marked(let(at_level(x["chosen"], F.greatest(a["level"], b["level"])), digests), x)
    return F.when(apart == 0, likeness(own(a), own(b))).when(apart == 1, likeness(above(a), own(b))).when(apart == -1, likeness(own(a), above(b))).otherwise(likeness(common(a), common(b)))


def ordered_runs(rows: DataFrame, n: int, run_rows: int = RUN) -> DataFrame:
    """rows(id, t) with _h (a hash of t), _run, _sub and _guest, so that the order by descending id, then _h, is found run by run.

    A run holds about run_rows neighbours.  The first row of each run also comes
    as a guest to the run before it (that of the first run to the last), behind
    that run's own rows: what follows a row is then in its own run, and nothing
    is sorted over the whole table.  An id with more rows than a run is cut into
    runs by _h; null ids come last.
    """
    rows = rows.withColumn("_h", F.xxhash64("t"))
    ident = F.col("id")
    longest = max(run_rows, -(-n // MOST_RUNS))
    runs = max(1, n // longest)
    edges = {int(b) for b in rows.approxQuantile("id", [i / runs for i in range(1, runs)], 1 / (4 * runs))} if runs > 1 else set()
    hot = [(r["id"], -(-r["count"] // longest)) for r in rows.groupBy("id").count().where(F.col("count") > longest).collect()]  # n / longest rows at most
    edges = sorted(edges | {e for h, _ in hot if h is not None for e in (h - 1, h)})
    wide = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + wide] for i in range(0, len(edges), wide)] or [[]]
    inner = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    outer = F.from_json(F.lit(str([g[0] for g in groups if g])), "array<bigint>")
    group = F.greatest(F.size(F.filter(outer, lambda e: e < ident)) - 1, F.lit(0))
    run = group * wide + F.size(F.filter(F.get(inner, group), lambda e: e < ident))
    rows = rows.withColumn("_run", F.when(ident.isNull(), -1).otherwise(run).cast("int"))
    spark = rows.sparkSession
    hot = F.broadcast(spark.createDataFrame(hot, "_hot bigint, _parts bigint"))
    rows = rows.join(hot, ident.eqNullSafe(F.col("_hot")), "left").drop("_hot")
    part = F.floor((F.col("_h") / float(1 << 64) + 0.5) * F.col("_parts"))
    rows = rows.withColumn("_sub", F.coalesce(F.least(part, F.col("_parts") - 1), F.lit(0)).cast("int")).drop("_parts")
    firsts = rows.groupBy("_run", "_sub").agg(F.min(F.struct(F.negative("id").alias("i"), F.col("_h").alias("h"))).alias("f")).collect()  # one row per run
    firsts = sorted(((r["_run"], r["_sub"], r["f"]["i"], r["f"]["h"]) for r in firsts), key=lambda r: (-r[0], r[1]))
    hosts = [(r[0], r[1], None if r[2] is None else -r[2], r[3], *firsts[i - 1][:2]) for i, r in enumerate(firsts)]
    hosts = F.broadcast(spark.createDataFrame(hosts, "_r int, _s int, _first bigint, _first_h bigint, _host int, _host_sub int"))
    rows = rows.join(hosts, (F.col("_run") == F.col("_r")) & (F.col("_sub") == F.col("_s")))
    place = lambda run, sub, guest: F.struct(F.col(run).alias("run"), F.col(sub).alias("sub"), F.lit(guest).alias("guest"))
    places = F.array(place("_run", "_sub", False), place("_host", "_host_sub", True))
    first = ident.eqNullSafe(F.col("_first")) & (F.col("_h") == F.col("_first_h"))
    rows = rows.withColumn("_place", F.explode(F.when(first, places).otherwise(F.slice(places, 1, 1))))
    return rows.select("id", "t", "_h", F.col("_place.run").alias("_run"), F.col("_place.sub").alias("_sub"), F.col("_place.guest").alias("_guest"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The edited text has its last third replaced by the head of the next
    document's text (descending id, null last; after the last the first; rows
    with one id in the order of a hash of their texts, so equal rows follow one
    another).  Null texts count as empty; texts are taken whole.  Returns id_col,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, one row per input row; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = rows.count()
    terms = lexicon(rows.select("t"), n, band)
    runs, order = Window.partitionBy("_run", "_sub"), ("_guest", F.col("id").desc_nulls_last(), "_h")
    pairs = ordered_runs(rows, n).withColumn("next_t", F.lead("t").over(runs.orderBy(*order, "t"))).withColumn("n", F.length("t").cast("long"))
    third = F.floor(F.col("n") / 3).cast("int")
    pairs = pairs.withColumn("e", F.concat(F.substring("t", F.lit(1), F.col("n").cast("int") - third), F.substring("next_t", F.lit(1), third)))
    pairs = pairs.withColumn("own_level", level_of(F.length("t"))).withColumn("edited_level", level_of(F.length("e")))
    pairs = pairs.withColumn("own", sketch(F.col("t"), F.col("own_level"))).withColumn("edited", sketch(F.col("e"), F.col("edited_level")))
    pairs = pairs.select("_run", "_sub", "_guest", "_h", "id", "n", F.sha2("e", 256).alias("sha"), "own_level", "edited_level", "own", "edited")
    # the same order once more, without texts: what was found of the next text
    following = F.lead(F.struct("own", "own_level")).over(runs.orderBy(*order))
    pairs = pairs.withColumn("next", following).where("NOT _guest").withColumn("next_level", F.col("next.own_level"))
    pairs = pairs.select("*", *[F.col(f"{c}.mark").alias(f"{k}_mark") for k, c in (("own", "own"), ("edited", "edited"), ("next", "next.own"))])
    own, edited, after = F.col("own.terms"), F.col("edited.terms"), F.col("next.own.terms")
    lists = [F.array_except(own, edited), F.array_except(edited, own), F.array_intersect(own, edited), after]
    kinds = {"own": (1, 3), "edited": (2, 3), "next": (4,)}
    found = with_band_terms(pairs, lists, ["id", "n", "sha", *[f"{k}_{what}" for k in kinds for what in ("level", "mark")]], terms)
    fps = [fingerprint_of(of_list(*codes), F.col(f"{k}_level"), F.col(f"{k}_mark")) for k, codes in kinds.items()]
    found = found.select("*", *[fp.alias(name) for fp, name in zip(fps, ("fp", "efp", "next_fp"), strict=True)])
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        F.concat_ws(",", "fp.fp").alias("fingerprint"), F.concat_ws(",", "efp.fp").alias("edited_fingerprint"),
        alike(F.col("fp"), F.col("efp")).alias("near_edited"), alike(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """id_col, fingerprint: the SUBSETS hashes of each text at its level and those at the next, joined by commas.

    Null texts count as empty, and empty ones have NONE in all places; a text that
    no subset has a term of has WHOLE and a hash of all its terms (if it has none, of itself) in
    the first.  Equal texts have equal fingerprints.  One row per input row; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    terms = lexicon(rows.select("t"), rows.count(), band)
    rows = rows.withColumn("level", level_of(F.length("t"))).withColumn("own", sketch(F.col("t"), F.col("level"))).withColumn("mark", F.col("own.mark"))
    found = with_band_terms(rows, [F.col("own.terms")], ["id", "level", "mark"], terms)
    return found.select(F.col("id").alias(id_col), F.concat_ws(",", fingerprint_of(of_list(1), F.col("level"), F.col("mark"))["fp"]).alias("fingerprint"))
