"""Gates, assertions, canonical claims and conflict candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.operators.components import TASK_ROWS, components, cut, dealt
from millrace.operators.order import numbered

# Vocabularies of the gates.
PREDICATES = ("depends_on", "supplies", "invests_in", "acquires", "partners_with", "manufactures", "regulates", "announces", "located_in", "has_capacity", "has_market_share")
MENTION_TYPES = ("Person", "Organization", "Location", "Product", "Technology", "Event", "Source")
LEAST_CONFIDENCE = 0.6


def reasons(*tests: tuple[Column, Column | str]) -> Column:
    """The reasons whose tests hold, in order; a null test holds not."""
    return F.array_compact(F.array(*[F.when(t, F.lit(r) if isinstance(r, str) else r) for t, r in tests]))


def gated(df: DataFrame, found: Column) -> DataFrame:
    return df.withColumn("reasons", found).withColumn("status", F.when(F.size("reasons") == 0, "promoted").otherwise("quarantined"))


def claim_gate(claims: DataFrame, least: float = LEAST_CONFIDENCE, predicates: tuple[str, ...] = PREDICATES) -> DataFrame:
    """Claims with their reasons against promotion and their status."""
    c = F.col
    empty = lambda x: c(x).isNull() | (c(x).cast("string") == "")
    return gated(claims, reasons(
        (c("confidence").isNull() | (c("confidence") < 0) | (c("confidence") > 1), "confidence_out_of_range"), (empty("doc_id"), "missing_doc_id"),
        (c("char_start").isNull() | c("char_end").isNull() | (c("char_start") < 0) | (c("char_end") < c("char_start")), "invalid_span"),
        *([(F.coalesce(F.size("provenance_ref"), F.lit(0)) < 1, "missing_provenance_ref")] if "provenance_ref" in claims.columns else []),
        (~c("predicate").isin(*predicates), F.concat(F.lit("unknown_predicate:"), c("predicate"))),
        (c("confidence") < least, "low_confidence"), (empty("subject_id"), "missing_subject"),
    ))


def mention_gate(mentions: DataFrame) -> DataFrame:
    c = F.col
    return gated(mentions, reasons(
        (c("start").isNull() | (c("start") < 0) | (c("end") < c("start")), "invalid_span"), (c("entity_id").isNull() | (c("entity_id") == ""), "unresolved_entity"),
        (~c("mention_type").isin(*MENTION_TYPES), F.concat(F.lit("unknown_mention_type:"), c("mention_type"))), (c("surface").isNull() | (c("surface") == ""), "missing_surface"),
    ))


def edge_gate(edges: DataFrame) -> DataFrame:
    c = F.col
    return gated(edges, reasons(((c("score") < 0) | (c("score") > 1), "score_out_of_range"), (c("resolution_ref").isNull(), "missing_resolution_ref"), (c("a") == c("b"), "self_loop")))


def mutations(promoted: DataFrame, ref: str) -> DataFrame:
    """One numbered mutation for each promoted element, whatever its repeats; numbers follow the reference."""
    rows = promoted.select(F.concat(F.lit("promote:"), F.col(ref).cast("string")).alias("idempotency_key")).distinct()
    return numbered(rows, [F.asc("idempotency_key")], "_k").withColumn("mutation_id", F.format_string("mut-%04d", "_k")).drop("_k")


# Fixed value: when claims without a publication time count as observed.
OBSERVED = "2026-08-03 12:00:00"


def observed_at(published: Column) -> Column:
    return F.coalesce(published, F.lit(OBSERVED).cast("timestamp"))


def assertions(claims: DataFrame, observed: Column) -> DataFrame:
    """Open-ended assertions of claims, observed at a time."""
    return claims.withColumn("assertion_id", ids.typed_id("asr", F.col("claim_id"))).withColumn("tx_from", observed).withColumn("tx_to", F.lit(None).cast("timestamp")).withColumn("valid_from", F.lit(None).cast("timestamp")).withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("time_precision", F.lit("unknown"))


# How two claims may relate.
RELATIONS = ("equivalent", "more_specific", "more_general", "supports", "contradicts", "unrelated", "temporally_superseded")


def valid_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts (a, b, relation, confidence, ...) that keep the contract; the others leave the pair undecided."""
    return verdicts.where(F.col("relation").isin(*RELATIONS) & F.col("confidence").between(0, 1))


#: Cells into which blocks are hashed to see which of them are large.
CELLS = 4096


def _by_block(links: DataFrame, claims: DataFrame, block: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """Links (a, b, *block, salt) dealt out so that those of a block meet in one task; those of a block of more than some `rows` claims by their salt too.

    No link leaves its block, so most are settled where they meet.
    """
    cell = F.pmod(F.xxhash64(*block), F.lit(CELLS)).alias("cell")
    sizes = cut(claims.groupBy(cell).agg(F.count("*").alias("n")))
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / rows))
    many = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = links.withColumn("cell", cell).join(F.broadcast(sizes), "cell", "left").withColumn("part", F.pmod("salt", parts))
    return dealt(met, *block, "part", rows=many)


def canonical(claims: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(claim_id, canonical_min): claims of a block (subject, predicate) that say the same.

    verdicts: (a, b, relation, confidence) on pairs that the rules leave open; a valid `equivalent` joins two claims
    of one block.

    The same fragment without case and outer spaces, or overlapping neighbours among spans of one
    segment number.  A hot fragment links its claims to their least one, never to each other.
    """
    block = ["subject_id", "predicate"]
    rows = claims.withColumn("frag", F.lower(F.trim("surface_fragment")))
    least = rows.groupBy(*block, "frag").agg(F.min("claim_id").alias("b"), F.count("*").alias("n"))
    # fragments of one claim link nothing and do not travel
    least = least.where("n > 1").drop("n")
    same = rows.join(least, [*block, "frag"]).select(F.col("claim_id").alias("a"), "b", *block, F.xxhash64("claim_id").alias("salt"))
    w = Window.partitionBy(*block, "seg_order").orderBy("char_start", "char_end", "claim_id")
    last = rows.withColumn("p", F.lag(F.struct("claim_id", "char_end")).over(w)).where("p is not null and p.char_end > char_start").select(F.col("claim_id").alias("a"), F.col("p.claim_id").alias("b"), *block, F.xxhash64("seg_order").alias("salt"))
    links = same.union(last)
    if verdicts is not None:
        side = lambda x: claims.select(F.col("claim_id").alias(x), F.col("subject_id").alias(f"s{x}"), F.col("predicate").alias(f"p{x}"))
        said = valid_verdicts(verdicts).where("relation = 'equivalent'").join(side("a"), "a").join(side("b"), "b")
        links = links.union(said.where("sa <=> sb and pa <=> pb").select("a", "b", F.col("sa").alias("subject_id"), F.col("pa").alias("predicate"), F.xxhash64("a").alias("salt")))
    found = components(_by_block(links.where("a != b"), claims, block).select("a", "b"), claims.select(F.col("claim_id").alias("node")))
    return found.select(F.col("node").alias("claim_id"), F.col("component").alias("canonical_min"))


def canonical_claims(claims: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row for each canonical claim: least fragment, number of members and its id."""
    rows = claims.join(canonical(claims, verdicts), "claim_id").groupBy("subject_id", "predicate", "canonical_min")
    out = rows.agg(F.min("surface_fragment").alias("canonical_text"), F.count("*").alias("n_members"), F.array_sort(F.collect_list(F.col("claim_id").cast("string"))).alias("members"))
    quoted = F.array_join(F.transform("members", ids.json_text), ", ")
    text = F.concat(F.lit('{"m": ['), quoted, F.lit('], "p": '), ids.json_text(F.col("predicate").cast("string")), F.lit(', "s": '), ids.json_text(F.col("subject_id").cast("string")), F.lit("}"))
    return out.withColumn("canonical_claim_id", F.concat(F.lit("ccl-"), ids.short_hash(text)))


def conflicts(claims: DataFrame) -> DataFrame:
    """(a, b, kind) of claims of one subject and predicate: other polarity, or another known object."""
    l, r = claims.alias("l"), claims.alias("r")
    kind = F.when(F.col("l.polarity") != F.col("r.polarity"), "polarity").when(F.col("l.object_id") != F.col("r.object_id"), "value_conflict")
    pairs = l.join(r, (F.col("l.subject_id") == F.col("r.subject_id")) & (F.col("l.predicate") == F.col("r.predicate")) & (F.col("l.claim_id") < F.col("r.claim_id")))
    return pairs.select(F.col("l.claim_id").alias("a"), F.col("r.claim_id").alias("b"), kind.alias("kind")).where("kind is not null")


def conflict_summary(claims: DataFrame) -> DataFrame:
    """(subject_id, predicate, n_claims, n_polarity, n_value, polarity_pair, value_pair): how many conflicts each block holds, without making its pairs.

    The counts are those of `conflicts`, from the sizes of classes: pairs of unlike polarity are all pairs of a
    block less those within a polarity; pairs of unlike objects less those that a polarity already tells apart are
    left as value conflicts (a null polarity tells nothing apart, a null object is unlike none).  One pair stands for each
    kind; `conflicts_of` gives all of a subject that is asked for.
    """
    block = ["subject_id", "predicate"]
    whole = "decimal(38,0)"
    n = F.col("n").cast(whole)
    square = lambda x: F.sum(x.cast(whole) * x)
    rows = claims.where("subject_id is not null and predicate is not null").select(*block, "polarity", "object_id", "claim_id")
    many = rows.count()
    cells = dealt(rows, *block, "object_id", rows=many).groupBy(*block, "object_id", "polarity").agg(F.count("*").alias("n"), F.min("claim_id").alias("least"))
    cells = dealt(cells, *block, rows=many)
    polar, known = F.col("polarity").isNotNull(), F.col("object_id").isNotNull()
    # sums over cells, objects and polarities of a block
    by_object = cells.where(known).groupBy(*block, "object_id").agg(F.sum("n").alias("n"), F.sum(F.when(polar, F.col("n")).otherwise(0)).alias("p"), square(F.when(polar, n).otherwise(0)).alias("pp"))
    by_object = by_object.groupBy(*block).agg(F.sum("n").alias("m"), square(F.col("n")).alias("mm"), (square(F.col("p")) - F.sum("pp")).alias("cross_object"))
    by_polarity = cells.groupBy(*block, "polarity").agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("k"), F.min("least").alias("least"), F.min(F.when(known, F.struct("object_id", "least"))).alias("low"), F.max(F.when(known, F.struct("object_id", "least"))).alias("high"))
    told = lambda x: F.when(polar, x).otherwise(0)
    split = F.when(F.col("low.object_id") != F.col("high.object_id"), F.struct(F.least("low.least", "high.least").alias("a"), F.greatest("low.least", "high.least").alias("b")))
    loose = F.when(~polar, F.struct("low", "high"))
    by_polarity = by_polarity.groupBy(*block).agg(
        F.sum("n").alias("n_claims"), F.sum(told(F.col("n"))).alias("p"), square(told(F.col("n"))).alias("pp"), F.sum(told(F.col("k"))).alias("k"), square(told(F.col("k"))).alias("kk"),
        F.min(F.when(polar, F.struct("polarity", "least"))).alias("one"), F.max(F.when(polar, F.struct("polarity", "least"))).alias("two"), F.min(split).alias("within"), F.min(loose).alias("loose"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    rows = by_polarity.join(by_object, block, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast(whole))
    n_polarity = (F.col("p").cast(whole) * F.col("p") - F.col("pp")) / 2
    n_value = ((zero(F.col("m").cast(whole) * F.col("m")) - zero(F.col("mm"))) - ((F.col("k").cast(whole) * F.col("k") - F.col("kk")) - zero(F.col("cross_object")))) / 2
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    polarity_pair = F.when(F.col("one.polarity") != F.col("two.polarity"), pair(F.col("one.least"), F.col("two.least")))
    # a claim without polarity stands against any other object
    mixed = F.coalesce(*[F.when(F.col(f"loose.{x}.object_id") != F.col(f"{y}.object_id"), pair(F.col(f"loose.{x}.least"), F.col(f"{y}.least"))) for x in ("low", "high") for y in ("low", "high")])
    return rows.select(*block, "n_claims", n_polarity.cast("long").alias("n_polarity"), n_value.cast("long").alias("n_value"), polarity_pair.alias("polarity_pair"), F.coalesce("within", mixed).alias("value_pair"))


def conflicts_of(claims: DataFrame, subject: Column) -> DataFrame:
    """Conflicts of one subject: only its claims are paired."""
    return conflicts(claims.where(F.col("subject_id") == subject))


def reconcile(corpus: DataFrame, new: DataFrame, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical claims and conflicts of the blocks (subject, predicate) that new claims touch, over the whole corpus.

    corpus: all claims with their status, the new ones among them.  Promoted ones are made canonical; conflicts are
    sought among all.
    """
    touched = new.where(F.col("subject_id").cast("string") != "").select("subject_id", "predicate").distinct()
    rows = corpus.join(touched, ["subject_id", "predicate"], "left_semi")
    return canonical_claims(rows.where("status = 'promoted'"), verdicts), conflicts(rows)


def judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs that a verdict calls a real conflict, or that none was passed on."""
    rows = pairs.join(verdicts.select("a", "b", "verdict"), ["a", "b"], "left")
    return rows.where("verdict is null or verdict = 'real_conflict'").withColumn("judged_by", F.when(F.col("verdict").isNull(), "rule").otherwise("judge"))


def latest_status(events: DataFrame, key: str, order: str) -> DataFrame:
    """Review state of an element: its last event."""
    return events.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(order).alias("at"))


def golden_from_review(events: DataFrame, pairs: DataFrame, version: str, split: str = "dev") -> DataFrame:
    """Golden pairs from reviews: the last verdict on each pair, with an id from what it says.

    events: (pair_id, status, label, at); only approved pairs become golden.  pairs: (pair_id, a, b).
    """
    last = events.groupBy("pair_id").agg(F.max_by(F.struct("status", "label"), "at").alias("x")).where("x.status = 'approved'")
    rows = pairs.join(last.select("pair_id", F.col("x.label").alias("label")), "pair_id")
    return rows.select(ids.typed_id("gold", F.col("a"), F.col("b"), F.col("label"), F.lit(split), F.lit(version)).alias("golden_id"), "a", "b", "label", F.lit(split).alias("split"), F.lit(version).alias("gold_version"))
