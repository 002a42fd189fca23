"""Mentions, entity resolution and rule-driven claims.  Rules and names are tables, so corpora can bring their own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import ids, text
from millrace.operators import dictionary
from millrace.operators.components import TASK_ROWS, cut, dealt

# The patterns of strong identifiers and of the claim rules, in order.
TICKER = r"\b(?:NYSE|NASDAQ|OTC):\s*([A-Z]{1,5})\b"
URL_HOST = r"\bhttps?://(?:www\.)?([a-zA-Z0-9.-]+\.[a-z]{2,})"
CLAIM_RULES = [
    (r"(?i)(?:will host|hosts?)\s+a conference call", "announces", "earnings"),
    (r"(?i)conference call", "announces", "earnings"),
    (r"(?i)will\s+be\s+webcast|webcast", "announces", "earnings"),
    (r"(?i)\b(announces?|announced|unveils?|unveiled|reveals?|revealed|launch(?:es|ed)?)\b", "announces", "product_launch"),
    (r"(?i)\bpower(s|ed)?\b", "announces", "product_launch"),
    (r"(?i)\benables?\b", "announces", "product_launch"),
    (r"(?i)\b(produces|produce|manufactur\w*|suppl\w*|fabricat\w*|makes)\b", "supplies", "manufacturing"),
    (r"(?i)\b(supplies|provides|delivers)\s+(chips?|processors?|gpus?|semiconductor\w*)", "supplies", "manufacturing"),
    (r"(?i)\b(partnership|strategic\s+partnership|agreement|alliance)\b", "partners_with", "partnership"),
]


def segments(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, seg_order, segment_id, seg_text): a row for each sentence."""
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(text.sentences(F.col(column))).alias("seg_order", "seg_text"))
    return rows.withColumn("segment_id", F.concat(F.col("doc_id").cast("string"), F.lit("#p0.s"), F.col("seg_order").cast("string")))


def offsets(sents: Column) -> Column:
    """Normalised (start, end) of each sentence: running sums of lengths, without the spaces between; one pass."""
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end")))).alias("out"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(sents, none, step, lambda acc: acc["out"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def raw_offsets(texts: pd.Series, sents: pd.Series) -> pd.Series:
    """(start, end) of each sentence in the text as it stands, found after the one before; start -1 where white space was collapsed."""
    out = []
    for value, parts in zip(texts, sents, strict=True):
        at, row = 0, []
        for part in parts if parts is not None else []:
            start = (value or "").find(part, at)
            at = start + len(part)
            row.append({"start": start, "end": at})
            at = max(at, 0)
        out.append(row)
    return pd.Series(out)


#: Identifiers that need no dictionary: (pattern, mention type, identifier, group of its value).
STRONG = ((TICKER, "Organization", "ticker", 1), (URL_HOST, "Organization", "url", 0))


def gazetteer_mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, surface, mention_type, start, end) of every whole-word occurrence of a name of one word or more; any number of names."""
    return dictionary.occurrences(docs, names).select("doc_id", "surface", "mention_type", "start", "end")


#: Characters of text for which a task sorts mentions.
TASK_CHARS = 1 << 24


def mention_places(docs: DataFrame, names: DataFrame, radius: int = 0) -> DataFrame:
    """(doc_id, start, end, surface, mention_type, identifiers), with radius context too: `mentions` without what their document and place say."""
    none = F.create_map().cast("map<string,string>")
    known = names.select("surface", "mention_type", F.coalesce("identifiers", none).alias("known") if "identifiers" in names.columns else none.alias("known"))
    # of the types of one surface the least stays
    first = F.min_by(F.struct("mention_type", "known"), F.struct("mention_type", F.array_sort(F.map_entries("known"))))
    known = known.groupBy("surface").agg(first.alias("m")).select("surface", "m.*")
    found = dictionary.filter_of(known)
    rows = dictionary.occurrences(docs, known, words=None, context=radius, extra=dictionary.patterns(*STRONG), found=found)
    strong = F.col("extra_kind").isNotNull()
    rank = F.when(~strong, 2).otherwise(F.when(F.map_contains_key("extra_ids", "ticker"), 0).otherwise(1))
    surface = F.when(strong, F.col("text")).otherwise(F.col("surface")).alias("surface")
    rows = rows.select("doc_id", "start", "end", rank.alias("rank"), surface, F.coalesce("extra_kind", "mention_type").alias("mention_type"), *["context"] * (radius > 0), F.when(strong, F.col("extra_ids")).otherwise(F.col("known")).alias("identifiers"))
    if found.many <= dictionary.FEW_NAMES:
        return dictionary.apart(rows, in_order=True).drop("rank")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return dictionary.apart(rows, -(-chars // TASK_CHARS) * TASK_ROWS).drop("rank")


def mentions(docs: DataFrame, names: DataFrame, radius: int = 96) -> DataFrame:
    """All mentions of documents: tickers, hosts and exact names anywhere, without overlaps, each with its id.

    names: (surface, mention_type) and, if known, identifiers map<string,string>.  Of overlapping candidates
    the first to start stays, the longer one of those that start together, then tickers before hosts before names.
    Tickers and hosts are their own identifiers.
    """
    rows = mention_places(docs, names, radius)
    context = F.col("context") if radius > 0 else F.lit(None).cast("string").alias("context")
    mention_id = ids.typed_id("men", F.col("doc_id"), F.col("start"), F.col("end"), F.col("surface"), sep=":")
    return rows.select("doc_id", mention_id.alias("mention_id"), "surface", "mention_type", "start", "end", context, "identifiers")


def pattern_mentions(docs: DataFrame, pattern: str, mention_type: str) -> DataFrame:
    """First groups of a pattern, wherever it occurs."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("surface")).withColumn("mention_type", F.lit(mention_type))


def without_overlaps(spans: Column) -> Column:
    """Spans (start, end, ...) kept greedily by start, longer first; each must begin after the last kept one ends."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])))
    keep = lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(acc, F.array(s))).otherwise(acc)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), keep)


def resolve(mentions: DataFrame, fold: bool = False) -> DataFrame:
    """(doc_id, mention_type, block, name, n, entity_id, identifiers): the entities that a document mentions.

    Mentions with identifiers are one entity if these are equal; others if type and surface are (fold: without
    case).  The name is the most frequent surface, the least of equals.
    """
    rows = mentions if "identifiers" in mentions.columns else mentions.withColumn("identifiers", F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("keys", F.array_sort(F.map_entries(F.coalesce("identifiers", F.create_map().cast("map<string,string>")))))
    rows = rows.withColumn("block", block_of(F.col("keys"), F.col("surface"), fold)).groupBy("doc_id", "mention_type", "block", "keys", "surface").agg(F.count("*").alias("k"))
    best = rows.groupBy("doc_id", "mention_type", "block", "keys").agg(F.min_by("surface", F.struct(-F.col("k"), F.col("surface"))).alias("name"), F.sum("k").alias("n"))
    return best.select("doc_id", "mention_type", "block", "name", "n", ids.entity_id(F.col("mention_type"), F.col("name"), F.col("keys")).alias("entity_id"), F.map_from_entries("keys").alias("identifiers"))


def with_entities(mentions: DataFrame) -> DataFrame:
    """Mentions with the entity_id that `resolve` gives them.

    Where a mention has no identifiers its surface is the entity's name; only the others meet those of their document.
    """
    keys = F.array_sort(F.map_entries("identifiers"))
    rows = mentions.where("doc_id is not null and mention_type is not null")
    known = F.coalesce(F.size("identifiers") > 0, F.lit(False))
    plain = rows.where(~known).withColumn("entity_id", ids.entity_id(F.col("mention_type"), F.col("surface")))
    strong = rows.where(known)
    many = strong.count()
    if not many:
        return plain
    keyed = dealt(strong.withColumn("block", block_of(keys, F.col("surface"))), "doc_id", "mention_type", "block", rows=many)
    entities = resolve(strong).select("doc_id", "mention_type", "block", "entity_id")
    return plain.unionByName(keyed.join(entities, ["doc_id", "mention_type", "block"]).drop("block"))


def block_of(keys: Column, surface: Column, fold: bool = False) -> Column:
    """What mentions of one entity share within a document and type."""
    return F.when(F.size(keys) > 0, F.to_json(keys)).otherwise(F.lower(surface) if fold else surface)


def extraction_records(elements: DataFrame, element: str, **columns: Column) -> DataFrame:
    """The trail of each extracted element to its document: an id from the element's, its span and what made it.

    columns: further columns such as content_hash, fetched_at, published_at, model_id or schema_version; those that
    the elements have under these names are taken over.
    """
    known = ("segment_id", "content_hash", "fetched_at", "published_at", "model_id", "prompt_template_hash", "schema_version", "preprocess_code_version")
    more = [columns[k].alias(k) if k in columns else F.col(k) if k in elements.columns else F.lit(None).cast("string").alias(k) for k in known]
    span = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in elements.columns else F.lit(0).cast("long").alias(c) for c in ("char_start", "char_end")]
    return elements.select(ids.typed_id("ext", F.col(element)).alias("extraction_id"), F.col(element).cast("string").alias("element_id"), "doc_id", *span, *more)


def alias_candidates(entities: DataFrame) -> DataFrame:
    """Pairs of entities that share a normalised alias in different scripts; proposals only.

    entities: (entity_id, aliases array<string>).
    """
    rows = entities.select("entity_id", F.explode("aliases").alias("alias"))
    rows = rows.select("entity_id", text.normal_name("alias").alias("norm"), text.script("alias").alias("script")).distinct()
    l, r = rows.alias("l"), rows.alias("r")
    pairs = l.join(r, F.col("l.norm") == F.col("r.norm")).where("l.entity_id < r.entity_id and l.script != r.script")
    return pairs.select(F.col("l.entity_id").alias("a"), F.col("r.entity_id").alias("b"), F.lit("POSSIBLY_SAME_AS").alias("relation")).distinct()


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(rules if rules is not None else CLAIM_RULES)]
    return spark.createDataFrame(rows, "rule_no int, pattern string, predicate string, event_type string")


def matching(segs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, seg_order, seg_text, matches): the segments that a rule matches, with the first rule of each predicate that does."""
    by_predicate: dict[str, list[Column]] = {}
    for i, (r, p, e) in enumerate(rules):
        at = F.regexp_instr("seg_text", F.lit(r))
        found = F.struct(F.lit(i).alias("rule_no"), F.lit(p).alias("predicate"), F.lit(e).alias("event_type"), at.alias("at"), F.regexp_substr("seg_text", F.lit(r)).alias("fragment"))
        by_predicate.setdefault(p, []).append(F.when(at > 0, found))
    first = F.array_compact(F.array(*[F.coalesce(*x) for x in by_predicate.values()]))
    # exploded, not filtered: a filter would search all rules once more
    return segs.select("doc_id", "seg_order", "seg_text", F.explode(F.filter(F.array(first), lambda x: F.size(x) > 0)).alias("matches"))


def first_matches(matched: DataFrame) -> DataFrame:
    """(doc_id, seg_order, predicate, event_type, char_start, char_end, surface_fragment): a row for each rule of `matching`."""
    rows = matched.select("doc_id", "seg_order", F.explode("matches").alias("t"))
    start = F.col("t.at") - 1
    return rows.select("doc_id", "seg_order", "t.predicate", "t.event_type", start.alias("char_start"), (start + F.length("t.fragment")).alias("char_end"), F.col("t.fragment").alias("surface_fragment"))


def with_subjects(rows: DataFrame, segs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows (doc_id, seg_order, ...) with subject_id: of the document's mentions whose surface the segment holds, the first one's entity.

    segs: (doc_id, seg_order, seg_text) of the rows.  Surfaces are sought in segments by the dictionary join where
    the segments stand and met with their own document's by an equi-join; no text is shuffled, and of a document's
    mentions only the first of each surface is.
    """
    firsts = resolved.select("doc_id", "surface", "start", "end", "entity_id")

    def least(batches):
        for x in batches:
            yield x.sort_values(["start", "end", "entity_id"]).drop_duplicates(["doc_id", "surface"])

    place = F.struct("start", "end", "entity_id")
    own = firsts.where("doc_id is not null").mapInPandas(least, firsts.schema).groupBy("doc_id", "surface").agg(F.min(place).alias("first"))
    texts = segs.select(F.struct("doc_id", "seg_order").alias("doc_id"), F.col("seg_text").alias("text"))
    held = dictionary.occurrences(texts, resolved.select("surface").distinct(), words=None).select("doc_id.*", "surface").distinct()
    subject = held.join(own, ["doc_id", "surface"]).groupBy("doc_id", "seg_order").agg(F.min("first")["entity_id"].alias("subject_id"))
    return dealt(rows, "doc_id", "seg_order").join(subject, ["doc_id", "seg_order"])


#: Cells into which documents are hashed to bound where their claims end.
CELLS = 1 << 16


def objects_for(ends: DataFrame, resolved: DataFrame) -> DataFrame:
    """The mentions among which an object of a claim can be found; ends: (doc_id, char_end) of the claims.

    Beyond the last end of a document only the first mention of each entity can be one; so most mentions need no shuffle.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell")
    last = ends.groupBy(cell).agg(F.max("char_end").alias("last"))
    seen = resolved.where("doc_id is not null and start is not null").select("doc_id", "start", "end", "entity_id")

    def needed(batches):
        for x in batches:
            beyond = x["start"] >= x["last"]
            far = x[beyond].sort_values(["start", "end", "entity_id"]).drop_duplicates(["doc_id", "entity_id"])
            yield pd.concat([x[~beyond], far])[["doc_id", "start", "end", "entity_id"]]

    return seen.withColumn("cell", cell).join(F.broadcast(last), "cell").drop("cell").mapInPandas(needed, seen.schema)


def with_objects(rows: DataFrame, resolved: DataFrame, many: int | None = None) -> DataFrame:
    """Rows (doc_id, char_end, subject_id, ...) with object_id: the entity of the document's first mention from char_end on that is another than the subject.

    An as-of join by one descending pass over each document: the next mention at or after a place, and
    for it the next mention of another entity.  many: about how many rows and mentions there are.
    """
    many = resolved.count() if many is None else many
    marks = resolved.select("doc_id", F.col("start").alias("place"), F.lit(1).alias("side"), F.col("end").alias("rank"), "entity_id", F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("row"))
    asked = rows.select("doc_id", F.col("char_end").alias("place"), F.lit(0).alias("side"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("entity_id"), F.struct("*").alias("row"))
    down = Window.partitionBy("doc_id").orderBy(F.desc("place"), F.desc("side"), F.desc("rank"), F.desc("entity_id"))
    after = F.last("entity_id", True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    walk = down.rowsBetween(Window.unboundedPreceding, 0)
    met = dealt(marks.union(asked), "doc_id", rows=many).withColumn("after", after)
    met = met.withColumn("turn", F.when(F.col("after") != F.col("entity_id"), F.col("after")))
    met = met.withColumns({"next": F.last("entity_id", True).over(walk), "other": F.last("turn", True).over(walk)}).where("side = 0")
    object_id = F.when(F.col("next") != F.col("row.subject_id"), F.col("next")).otherwise(F.col("other"))
    return met.select("row.*", object_id.alias("object_id"))


def claims(segs: DataFrame, rules: list[tuple[str, str, str]], resolved: DataFrame) -> DataFrame:
    """A claim for the first matching rule of each predicate in a segment that holds a resolved mention of its document.

    resolved: (doc_id, surface, start, end, entity_id), places in the document.  As the evidence
    model has it, the object's place is held against the end of the match within the segment.
    """
    matched = cut(matching(segs, rules))  # read for the surfaces in segments and for the claims
    rows = first_matches(matched)
    found = with_objects(with_subjects(rows, matched, resolved), objects_for(rows, resolved), resolved.count())
    claim_id = ids.typed_id("clm", F.col("doc_id"), F.col("seg_order"), F.col("char_start"), F.col("char_end"), F.col("predicate"), sep=":")
    fixed = {"confidence": F.lit(0.8), "polarity": F.lit("positive"), "modality": F.lit("asserted")}
    return found.withColumn("claim_id", claim_id).withColumns(fixed)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
