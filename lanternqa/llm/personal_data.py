"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the entities that fixed patterns find. Every seed is an instance, and so
is every stretch with digits that no seed covers; the one or two words before an
instance, within CONTEXT_CHARS characters, are lexical patterns. Spark scores the
graph of patterns and instances in rounds: a pattern is worth the share of all
its uses in the corpus that stand before trusted instances, an instance as much
as its best pattern. Instances of high-confidence patterns that no seed covers
are added as further identifiers.

Uses of a pattern are counted over the whole texts, for patterns that stand before
enough different instances to pass. All tables but the texts themselves have one
row per instance or pattern; counts fold before each shuffle.

Defined results: a null or empty text has no span. Spans count code points, end
exclusive. Repeated rows each get their own result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternqa.llm.scratch import Scratch
from lanternqa.session import fits_broadcast

# The kinds and their patterns. Possessive forms and the looks behind keep the leftmost matches of
# the plain patterns and make each search linear in the text.
KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# A stretch of identifier characters with a digit in it.
INSTANCE = r"(?<![A-Za-z0-9._/@+-])[A-Za-z._/@+-]*+[0-9][A-Za-z0-9._/@+-]*+"
# The places inside a word where such a stretch may begin, but for those between two letters.
JOINED = r"(?<=[^A-Za-z0-9._/@+\p{L}\p{M}\p{N}-])(?=[A-Za-z0-9._/@+-])"
MIN_DIGITS = 5
CONTEXT_CHARS = 64
BLANKS = r"[\x20\x09-\x0D]+"
ROUNDS = 3
MIN_CONFIDENCE = 0.5
MIN_SUPPORT = 3


def located(text: Column, pattern: str) -> Column:
    """All matches with their places and the end of the text before each, its blanks folded to single spaces.

    The stretches between matches come from splitting, so places are running sums of lengths.
    """
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")),
    )
    item = "struct<start:int,end:int,value:string,before:string>"
    none = F.array().cast(f"array<{item}>")

    def last(so_far: Column, more: Column) -> Column:
        return F.substring(F.regexp_replace(F.concat(so_far, more), BLANKS, " "), -CONTEXT_CHARS - 1, CONTEXT_CHARS + 1)

    def step(so_far: Column, pair: Column) -> Column:
        start = so_far["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        before = last(so_far["before"], pair["gap"])
        found = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"), before.alias("before"))
        return F.struct(
            end.alias("at"), last(before, pair["value"]).alias("before"),
            F.concat(so_far["found"], F.array(found)).alias("found"),
        )

    return F.aggregate(
        F.filter(pairs, lambda pair: pair["value"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), none.alias("found")), step,
        lambda so_far: so_far["found"],
    )


def luhn(digits: Column) -> Column:
    """Whether the last digit of a number of up to 19 digits is its check digit."""
    backwards = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(backwards, place, F.lit(1)).cast("int")
        twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid_card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def base_spans(text: Column) -> Column:
    """The seeds of a text by kind and start, as an array of (kind, start, end, value, before)."""
    has_digit = text.rlike("[0-9]")
    kinds = [
        ("email", EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        ("ip", IP, has_digit & F.contains(text, F.lit(".")), lambda v: v.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")),
        ("card", CARD, has_digit, _valid_card),
        ("phone", PHONE, has_digit & F.contains(text, F.lit("+")), lambda v: F.length(F.translate(v, "+ ().-", "")).between(9, 15)),
    ]
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")

    def of_kind(name: str, pattern: str, wanted: Column, valid) -> Column:
        found = F.filter(located(text, pattern), lambda x: valid(x["value"]))
        spans = F.transform(found, lambda x: F.struct(F.lit(name).alias("kind"), *(x[k].alias(k) for k in ("start", "end", "value", "before"))))
        return F.when(wanted, spans).otherwise(none)

    return F.concat(*(of_kind(*kind) for kind in kinds))


def instances(text: Column, seeds: Column) -> Column:
    """All seeds, and the identifier-like stretches that no seed covers: (start, end, value, one, two, seed, inside).

    `one` and `two` are the last words before; `inside` marks what begins in a word, but not where `JOINED` cuts it.
    `seeds` is a column sorted by start, the longest first; of those
    with one start the first stands for all, so no use of a pattern counts twice.
    """

    def describe(x: Column, seed: bool) -> Column:
        words = F.split(x["before"], " ")
        # The first word of a full window may be the end of a longer one.
        words = F.when(F.length(x["before"]) > CONTEXT_CHARS, F.slice(words, 2, CONTEXT_CHARS)).otherwise(words)
        # The last word may be joined to the value, as an opening quote is; it is part of the pattern.
        words = F.filter(words, lambda w: w != "")
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
            F.lower(F.try_element_at(words, F.lit(-1))).alias("one"),
            F.lower(F.try_element_at(words, F.lit(-2))).alias("two"),
            F.lit(seed).alias("seed"),
            (x["before"].rlike(r"[^\x20]$") & ~F.concat(F.substring(x["before"], -1, 1), F.substring(x["value"], 1, 1)).rlike(JOINED)).alias("inside"),
        )

    first = F.filter(seeds, lambda x, i: ~F.get(seeds, i - 1)["start"].eqNullSafe(x["start"]))
    stretches = F.filter(
        located(text, INSTANCE),
        lambda x: (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= MIN_DIGITS)
        & ~F.exists(seeds, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string,one:string,two:string,seed:boolean,inside:boolean>>")
    return F.concat(
        F.transform(first, lambda x: describe(x, True)),
        F.when(text.rlike("[0-9]"), F.transform(stretches, lambda x: describe(x, False))).otherwise(none),
    )


def contexts(one: Column, two: Column) -> Column:
    """The patterns of a place: its last word, and its last two if there are two."""
    return F.when(two.isNull(), F.array(one)).otherwise(F.array(one, F.concat_ws(" ", two, one)))


def text_contexts(texts: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(pattern), one row for each use in the texts; if given, only those whose last word is in the small `last`.

    Uses end where a word ends, and inside a word where a stretch of identifier characters begins: `id=` is used by
    `id=none` as by `id=12345`.
    """
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("words"))
    pairs = F.zip_with(F.col("words"), before, lambda one, two: F.struct(one.alias("one"), two.alias("two")))
    placed = texts.select(words.alias("words")).select(F.explode(pairs).alias("x")).select("x.*").filter("one IS NOT NULL")
    # Parts longer than any context need no look.
    pieces = F.split(F.substring("one", 1, CONTEXT_CHARS + 1), JOINED)
    begin = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(so_far: Column, piece: Column) -> Column:
        at = F.concat(so_far["at"], piece)
        return F.struct(at.alias("at"), F.concat(so_far["out"], F.array(at)).alias("out"))

    parts = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), begin, step, lambda so_far: so_far["out"])
    whole = F.array("one")
    cut = F.when(F.col("one").rlike(JOINED), F.concat(parts, whole)).otherwise(whole)
    placed = placed.select(F.explode(cut).alias("one"), "two").withColumn("last", F.lower("one"))
    if last is not None:
        placed = placed.join(F.broadcast(last), "last", "left_semi")
    return placed.select(F.explode(contexts(F.col("one"), F.col("two"))).alias("pattern")).select(F.lower("pattern").alias("pattern"))


def pattern_uses(texts: DataFrame, found: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, uses) of the wanted patterns over whole texts; uses fold in each task.

    Seeds that begin inside a stretch of identifier characters, as in `tel+1415`, end a use that no cut of the text
    shows; these are added.
    """
    count = F.count(F.lit(1)).alias("uses")
    if fits_broadcast(wanted):
        last = wanted.select(F.substring_index("pattern", " ", -1).alias("last")).distinct()
        in_texts = text_contexts(texts, last).join(F.broadcast(wanted), "pattern", "left_semi").groupBy("pattern").agg(count)
    else:
        # Written before the join, or the plan would move single uses to meet the wanted ones before it counts them.
        in_texts = scratch.write(text_contexts(texts).groupBy("pattern").agg(count), "all-uses").join(wanted, "pattern", "left_semi")
    inside = found.filter("inside").select("pattern").join(wanted, "pattern", "left_semi").groupBy("pattern").agg(count)
    return in_texts.unionByName(inside).groupBy("pattern").agg(F.sum("uses").alias("uses"))


def trusted_patterns(
    found: DataFrame, texts: DataFrame, scratch: Scratch, rounds: int = ROUNDS,
    min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """(pattern, confidence) of the patterns that mostly stand before identifiers.

    `found` has rows (value, one, two, seed, inside). A pattern needs
    `min_support` distinct trusted instances and `min_confidence` of its uses.
    """
    near = found.filter("one IS NOT NULL").select(
        "value", "seed", "inside", F.explode(contexts(F.col("one"), F.col("two"))).alias("pattern")
    )
    met = scratch.write(
        near.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "met"
    )
    # A pattern before fewer values can never have the support, so its uses need no count.
    wanted = scratch.write(
        met.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support).select("pattern"), "wanted"
    )
    uses = scratch.write(pattern_uses(texts, near, wanted, scratch), "uses")
    edges = scratch.write(met.join(uses, "pattern"), "edges")
    scratch.drop("met")
    trust = scratch.write(
        edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("trust")).filter("trust > 0"), "trust_0"
    )
    patterns = None
    for turn in range(1, rounds + 1):
        # A value that a third of all rows hold meets its own trust here; counts have folded to one row per pattern.
        scored = edges.join(trust, "value", "left").groupBy("pattern").agg(
            F.sum(F.col("n") * F.coalesce("trust", F.lit(0.0))).alias("mass"), F.count("trust").alias("support"),
            F.min("uses").alias("uses"),
        )
        confidence = F.least(F.lit(1.0), F.col("mass") / F.greatest("uses", F.lit(1)))
        patterns = scratch.write(
            scored.select("pattern", "support", confidence.alias("confidence")).filter(
                (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
            ).select("pattern", "confidence"),
            f"patterns_{turn}",
        )
        reached = edges.join(patterns, "pattern").select("value", F.col("confidence").alias("trust"))
        seeds = edges.filter("seed").select("value", F.lit(1.0).alias("trust"))
        trust = scratch.write(
            seeds.unionByName(reached).groupBy("value").agg(F.max("trust").alias("trust")), f"trust_{turn}"
        )
    return patterns


def find_personal_data(
    docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT
) -> DataFrame:
    """(doc_id, spans): every text's spans (kind, start, end) by kind and start; `context` are the added ones."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    with_base = texts.withColumn("base", base_spans(F.col("text")))
    by_start = F.transform("base", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), *(x[k].alias(k) for k in ("end", "value", "before"))))
    with_base = with_base.withColumn("seeds", F.array_sort(by_start))
    spans = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = scratch.write(
        with_base.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", spans.alias("base"),
            instances(F.col("text"), F.col("seeds")).alias("instances"),
        ),
        "rows",
    )
    found = rows.select("row", F.explode("instances").alias("x")).select("row", "x.*")
    patterns = trusted_patterns(found, texts, scratch, rounds, min_confidence, min_support)
    context = F.explode(contexts(F.col("one"), F.col("two")))
    added = (
        found.filter("NOT seed AND one IS NOT NULL").select("row", "start", "end", context.alias("pattern"))
        .join(patterns, "pattern", "left_semi").groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("added"))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select(
        "doc_id", F.concat("base", F.coalesce("added", none)).alias("spans")
    )


def mask_spans(text: Column, spans: Column, mark: str = "[PRIVATE]") -> Column:
    """The text with every span replaced by `mark`; overlapping spans share one mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, span: Column) -> Column:
        gap = F.substring(text, so_far["at"] + 1, F.greatest(span["start"] - so_far["at"], F.lit(0)))
        new = F.when(span["start"] >= so_far["at"], F.concat(so_far["out"], gap, F.lit(mark))).otherwise(so_far["out"])
        return F.struct(F.greatest(so_far["at"], span["end"]).alias("at"), new.alias("out"))

    def finish(so_far: Column) -> Column:
        return F.concat(so_far["out"], F.substring(text, so_far["at"] + 1, F.length(text)))

    return F.aggregate(ordered, begin, step, finish)


def personal_data_report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the seeds, and all spans as text."""

    def written(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "context")
    counts = [count(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
