"""Duplicate documents: exact groups, MinHash signatures, banding, clusters and their roles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import ids, text
from millrace.functions.shingles import shingle_hashes
from millrace.operators.components import components, cut

PERMS, BANDS, MIN_CHARS, THRESHOLD = 64, 8, 200, 0.90
#: Trust of a source type when the root of a cluster is chosen.
TRUST = {"gov": 3, "official": 2, "research": 1, "press": 1}


def exact_groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(text_sha256, n, first id) for each distinct text; counts combine before the shuffle."""
    return docs.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("n"), F.min(key).alias("first_doc_id"))


def text_hash_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.array_sort(F.collect_list(key)).alias("doc_ids"))


def eligible(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Texts that are long enough and have a shingle at all."""
    tokens = text.word_tokens(F.col("text"))
    return docs.where((F.length("text") >= min_chars) & (F.size(tokens) >= 5))


def sha_signature(shingles: Column, perms: int = PERMS) -> Column:
    """MinHash by SHA-256 (version d1): 12 hex digits, least per permutation; null for an empty set."""
    least = lambda p: F.array_min(F.transform(shingles, lambda s: F.substring(F.sha2(F.concat(p.cast("string"), F.lit(":"), s), 256), 1, 12)))
    hexed = F.transform(F.sequence(F.lit(0), F.lit(perms - 1)), lambda p: F.conv(least(p), 16, 10).cast("long"))
    return F.when(F.size(shingles) > 0, hexed)


def seeds(perms: int = PERMS) -> list[int]:
    """Odd multipliers of version x2, one for each permutation."""
    return (np.random.default_rng(11).integers(1, 1 << 63, perms, dtype=np.uint64) | np.uint64(1)).tolist()


#: The second multiplier of version x2.
MIX = 0xD6E8FEB86659FD93


#: Bytes of text whose shingles a task hashes at once; a longer text stands alone.
SIGNED_BYTES = 1 << 20


def _signed(perms: int):
    """(doc_id, text_sha256, sig) of texts with a shingle: for each permutation the least of 60 bits of their shingles' MD5, mixed with its seed."""
    by = np.array(seeds(perms), np.uint64)[:, None]

    def least(h):
        x = h * by
        x ^= x >> np.uint64(32)
        x *= np.uint64(MIX)
        x ^= x >> np.uint64(29)
        return x.min(1)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SIGNED_BYTES, "right")) - 1)
                hashes, many = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.cumsum(many)
                has = np.flatnonzero(many)
                sig = [np.min([least(hashes[x : min(x + 4096, e)]) for x in range(e - n, e, 4096)], 0) for e, n in zip(ends[has].tolist(), many[has].tolist(), strict=True)]
                flat = pa.array(np.concatenate(sig).view(np.int64) if sig else [], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, perms), pa.int32()), flat)
                at = pa.array(has + lo)
                yield pa.record_batch([batch.column("doc_id").take(at), batch.column("text_sha256").take(at), lists], names=["doc_id", "text_sha256", "sig"])
                lo = hi

    return run


def signatures(docs: DataFrame, exact: bool = False, perms: int = PERMS) -> DataFrame:
    """(doc_id, text_sha256, sig) of the eligible documents.

    exact: the SHA-256 version d1, all in the JVM; else version x2: 60 bits of the shingles' MD5, mixed with a seed
    for each permutation, whole Arrow batches at a time (as Spark's own functions this takes several times the CPU).
    """
    docs = docs.where(F.length("text") >= MIN_CHARS)
    if not exact:
        kind = docs.schema["doc_id"].dataType.simpleString()
        texts = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.lower("text").alias("text"))
        return texts.mapInArrow(_signed(perms), f"doc_id {kind}, text_sha256 string, sig array<bigint>")
    # tokens as a column of their own: within a lambda Spark would compute them again for each shingle
    sets = docs.select("doc_id", "text", text.word_tokens(F.col("text")).alias("t")).where(F.size("t") >= 5)
    sets = sets.select("doc_id", F.sha2("text", 256).alias("text_sha256"), text.shingle_set(F.col("t")).alias("sh"))
    return sets.select("doc_id", "text_sha256", sha_signature(F.col("sh"), perms).alias("sig"))


def bands(sigs: DataFrame, count: int = BANDS) -> DataFrame:
    """(doc_id, band, band_key, sig): one row for each band of a signature."""
    rows = F.expr(f"size(sig) div {count}")
    parts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(F.array_join(F.slice("sig", i * rows + 1, rows), ",")))
    return sigs.select("doc_id", "sig", F.posexplode(parts).alias("band", "band_key"))


def similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def representatives(sigs: DataFrame) -> DataFrame:
    """(doc_id, sig): the least id of each text, so that exact copies meet once."""
    return sigs.groupBy("text_sha256").agg(F.min_by(F.struct("doc_id", "sig"), "doc_id").alias("r")).select("r.*")


def candidate_pairs(sigs: DataFrame, threshold: float = THRESHOLD, count: int = BANDS) -> DataFrame:
    """(a, b, estimate) of representatives that share a band and reach the threshold.

    All pairs, as a report of them needs; clusters come from `band_links`, which is linear for near copies.
    """
    x = bands(representatives(sigs), count)
    left, right = x.alias("l"), x.alias("r")
    pairs = left.join(right, ["band", "band_key"]).where("l.doc_id < r.doc_id")
    pairs = pairs.select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b"), similarity(F.col("l.sig"), F.col("r.sig")).alias("estimate"))
    return pairs.where(F.col("estimate") >= threshold).distinct()


def _neighbours(threshold: float):
    """Links of rows that follow each other in one bucket and are similar enough; rows come sorted."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1)
            at = [batch.column(c).to_numpy() for c in ("band", "band_key")]
            ids = batch.column("doc_id")
            near = (at[0][1:] == at[0][:-1]) & (at[1][1:] == at[1][:-1]) & ((sig[1:] == sig[:-1]).sum(1) >= threshold * sig.shape[1])
            k = np.flatnonzero(near)
            a, b = ids.take(pa.array(k)).to_pylist(), ids.take(pa.array(k + 1)).to_pylist()
            if last is not None and (last[0], last[1]) == (at[0][0], at[1][0]) and (last[2] == sig[0]).sum() >= threshold * sig.shape[1]:
                a, b = [*a, last[3]], [*b, ids[0].as_py()]
            last = at[0][-1], at[1][-1], sig[-1].copy(), ids[-1].as_py()
            yield pa.record_batch([pa.array(a, ids.type), pa.array(b, ids.type)], names=["a", "b"])

    return run


def band_links(sigs: DataFrame, threshold: float = THRESHOLD, count: int = BANDS, most: int = 64, orders: int = 4) -> DataFrame:
    """(a, b): links that join the same representatives as all pairs of `candidate_pairs` do.

    Buckets of at most `most` rows are paired off.  In a larger one, rows are sorted by several stretches of their
    signatures, neighbours are compared, and what they link is one class; then only rows outside a bucket's
    largest class meet the rows of other classes.  So near copies cost a few comparisons each, and no pair of two
    classes is left out.
    """
    one = cut(representatives(sigs))
    bucket = ["band", "band_key"]
    keys = cut(bands(one, count).drop("sig"))  # signatures travel only for rows that share a bucket
    shared = keys.join(keys.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), bucket)
    x = cut(shared.join(one, "doc_id").select("doc_id", *bucket, "sig", "n"))
    alike = similarity(F.col("l.sig"), F.col("r.sig")) >= threshold
    ends = [F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")]
    few = x.where(F.col("n") <= most)
    links = few.alias("l").join(few.alias("r"), bucket).where("l.doc_id < r.doc_id").where(alike).select(*ends).distinct()
    hot = cut(x.where(F.col("n") > most).drop("n"))
    if hot.isEmpty():
        return links
    kind = hot.schema["doc_id"].dataType.simpleString()
    found = None
    for k in range(orders):
        place = F.slice("sig", F.floor(F.size("sig") * k / orders).cast("int") + 1, F.size("sig"))
        ranked = hot.repartitionByRange(*bucket, place).sortWithinPartitions(*bucket, place)
        near = ranked.mapInArrow(_neighbours(threshold), f"a {kind}, b {kind}")
        found = near if found is None else found.union(near)
    found = cut(found.distinct())
    label = F.coalesce("component", "doc_id").alias("label")
    rows = cut(hot.join(components(found).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", *bucket, "sig", label))
    largest = rows.groupBy(*bucket, "label").agg(F.count("*").alias("n")).groupBy(*bucket).agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    rest = rows.join(largest, bucket).where("label != largest").alias("l")
    cross = rest.join(rows.alias("r"), bucket).where("l.label != r.label").where(alike).select(*ends)
    return links.union(found).union(cross.distinct())


def clusters(docs: DataFrame, exact: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, cluster_min) of every document: near copies and exact copies share the least id."""
    sigs = signatures(docs, exact)
    pairs = band_links(sigs, threshold)
    same = cut(docs.select("doc_id", F.sha2("text", 256).alias("h")))
    same = same.join(same.groupBy("h").agg(F.min("doc_id").alias("b")), "h").where("doc_id != b").select(F.col("doc_id").alias("a"), "b")
    found = components(pairs.union(same), docs.select(F.col("doc_id").alias("node")))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_min"))


def finalise(members: DataFrame) -> DataFrame:
    """Root, members and independent additions of each cluster.

    members: (cluster, doc_id, text[, published, source_type]).  The root is the earliest, then most trusted, then
    least document; a member is independent if it has a sentence that the root lacks.
    """
    has = set(members.columns)
    when = F.coalesce(F.col("published"), F.lit("9999")) if "published" in has else F.lit("9999")
    kind = F.col("source_type") if "source_type" in has else F.lit("")
    trust = F.coalesce(F.create_map(*[F.lit(x) for p in TRUST.items() for x in p])[kind], F.lit(0))
    rows = members.select("cluster", "doc_id", text.sentences(F.col("text")).alias("s"), F.struct(when.alias("w"), (-trust).alias("t"), F.col("doc_id").alias("d")).alias("rank"))
    root = rows.groupBy("cluster").agg(F.min_by("doc_id", "rank").alias("root_doc_id"), F.min_by("s", "rank").alias("root_s"))
    new = F.size(F.array_except("s", "root_s")) > 0
    return rows.join(root, "cluster").select("cluster", "doc_id", "root_doc_id", (F.col("doc_id") == F.col("root_doc_id")).alias("is_root"), (new & (F.col("doc_id") != F.col("root_doc_id"))).alias("independent"))


def roles(final: DataFrame) -> DataFrame:
    """root, independent or derived for each clustered document."""
    role = F.when(F.col("is_root"), "root").when(F.col("independent"), "independent").otherwise("derived")
    return final.select("doc_id", "cluster", "root_doc_id", role.alias("role"))


def document_roles(docs: DataFrame) -> DataFrame:
    """(doc_id, cluster, root_doc_id, role) of every document (doc_id, text); only texts that share a cluster are met with their root's."""
    rows = cut(docs.select("doc_id").join(clusters(docs), "doc_id").withColumnRenamed("cluster_min", "cluster"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    alone = sizes.where("n = 1").select("doc_id", "cluster", F.col("doc_id").alias("root_doc_id"), F.lit("root").alias("role"))
    shared = rows.join(sizes.where("n > 1").select("cluster"), "cluster", "left_semi").distinct()
    members = cut(docs.select("doc_id", "text").join(shared, "doc_id"))
    return alone.union(roles(finalise(members)))


def incremental(stored: DataFrame, new: DataFrame, threshold: float = THRESHOLD, count: int = BANDS) -> DataFrame:
    """(doc_id, matches): for each new signature the stored ones, and earlier new ones, that it is near to."""
    seen = stored.select("doc_id", "sig").union(new.select("doc_id", "sig"))
    l, r = bands(new, count).alias("l"), bands(seen, count).alias("r")
    old = stored.select(F.col("doc_id").alias("old"))
    pairs = l.join(r, ["band", "band_key"]).select(F.col("l.doc_id").alias("doc_id"), F.col("r.doc_id").alias("other"), similarity(F.col("l.sig"), F.col("r.sig")).alias("e"))
    pairs = pairs.where(F.col("e") >= threshold).where("doc_id != other").distinct().join(old, F.col("other") == F.col("old"), "left")
    return pairs.where("old is not null or other < doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("other")).alias("matches"))


def cluster_ids(final: DataFrame) -> DataFrame:
    return final.groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("doc_ids")).withColumn("cluster_id", ids.cluster_id(F.col("doc_ids")))
