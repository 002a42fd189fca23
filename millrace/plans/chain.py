"""The batch chain: documents to sentences, mentions, entities, claims, gate, assertions, canonical claims and conflicts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.operators import claims as C
from millrace.operators import evidence, extract, observed
from millrace.operators.components import cut, spread


@dataclass
class Chain:
    """The tables that a run makes; each is a plan over those before it, and what is canonical is worked out only for those who ask."""

    docs: DataFrame
    names: DataFrame
    segments: DataFrame
    resolved: DataFrame
    entities: DataFrame
    claims: DataFrame
    gated: DataFrame

    @cached_property
    def mentions(self) -> DataFrame:
        """Resolved mentions with their ids and what stands around them, found once more in the documents: no such text is stored."""
        rows = extract.with_entities(extract.mentions(self.docs, self.names))
        return rows.withColumn("block", extract.block_of(F.array_sort(F.map_entries("identifiers")), F.col("surface")))

    @cached_property
    def canonical(self) -> DataFrame:
        return C.canonical_claims(self.gated.where("status = 'promoted'"))

    @cached_property
    def conflicts(self) -> DataFrame:
        return C.conflicts(self.claims)


def run(docs: DataFrame, names: DataFrame, rules: list[tuple[str, str, str]] | None = None, metrics: observed.Run | None = None) -> Chain:
    """docs: (doc_id, text); names: the gazetteer (surface, mention_type[, identifiers]); metrics: gets rows, rejects and seconds of the written stages.

    Every claim refers to its extraction record (extract.extraction_records has the same ids).
    """
    docs = spread(docs.select("doc_id", "text"))
    segs = extract.segments(docs)
    write = metrics.stage if metrics is not None else lambda name, df, rejected=None: cut(df)
    # without what stands around a mention, which would outweigh the documents
    mentions = write("mentions", extract.mention_places(docs, names))
    entities = extract.resolve(mentions)
    # written once: the steps below read it several times
    resolved = write("resolved", extract.with_entities(mentions))
    made = extract.claims(segs, rules or extract.CLAIM_RULES, resolved.select("doc_id", "surface", "start", "end", "entity_id"))
    made = made.withColumn("provenance_ref", F.array(ids.typed_id("ext", F.col("claim_id"))))
    gated = write("claims", C.claim_gate(made), F.col("status") != "promoted")
    return Chain(docs, names, segs, resolved, entities, gated.drop("reasons", "status"), gated)


def investigate(claims: DataFrame, subject: str, contradictions: DataFrame | None = None) -> DataFrame:
    """A subject's conclusion with its signal."""
    one = evidence.conclusions(evidence.confidence(claims.where(F.col("subject_id") == subject), contradictions))
    return one.withColumn("signal", evidence.signal(F.col("value"), F.col("contradiction"), F.col("independent")))
