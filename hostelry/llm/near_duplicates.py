"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Two documents are linked if the Jaccard similarity of their sets of word shingles is ``similarity`` or more; a
document's class is everything it reaches over links, and its id the smallest in it.

1. Documents with equal sets are one from here on. Each has a MinHash signature, cut into bands; documents that
   share a band are candidates. A pair at the threshold shares none with a probability below 1e-5.
2. Every bucket (documents with one band) has a hub: the member whose bands are shared most. All members are
   verified against the hub, which settles a group of copies of one text in as many pairs as it has members.
3. Where a bucket then still holds several classes, the members outside its largest class are verified against
   all members of other classes, in blocks of bounded size; a bucket is split into as many blocks as it needs and
   none is capped. Blocks meet as signatures first; only texts of members with a plausible partner in the block
   follow. Pairs that are already in one class need no link, so no group is ever compared with itself whole.

Verification compares signatures in batches and drops a pair as soon as the posterior probability that it reaches
the threshold is below ``miss`` (uniform prior); survivors are verified exactly on their full sets, so every link
is true, and a true pair is lost with a probability of about ``miss``.

Cases: null and empty texts have no shingles and no links; a text with fewer words than a shingle has one, all of
it; a null id is linked with nothing, has no class and is kept; rows with equal ids are one document with one class
(if their texts differ, equal sets count for each text, and links are verified on the largest); an empty table gives an empty table; other columns are not read; ids are integers.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.llm.components import components
from hostelry.llm.frames import give_back, per_document, text_slices
from hostelry.llm.words import mix, shingles, words_of
from hostelry.operators.distribution import attach, spread_join
from hostelry.session import discard, durable

BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
#: Members of a block of a bucket, about, and characters of text that one call of a task verifies, about.
BLOCK, GROUP_CHARS = 256, 1_000_000
#: Signatures that one call of a task compares in blocks, about.
GROUP_ROWS = 8192

_RANDOM = np.random.default_rng(77)
_TIMES = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    words = words_of(texts, lower=True)
    own = words.hashes()
    hashes, at = shingles(own, words.doc, n)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        first, last = words.first[i], words.first[i + 1]
        if a == b and last > first:
            whole, _ = shingles(own[first:last], np.zeros(last - first, np.int64), int(last - first))
            out.append(mix(whole ^ np.uint64(last - first)))  # a short text is no shingle of a longer one
        else:
            out.append(np.unique(hashes[a:b]))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(small), 4096):
        np.minimum(low, (small[a:a + 4096, None] * _TIMES + _PLUS).min(axis=0), out=low)
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Documents × bands; the band's number is part of its key."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(parts), 1))
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


@cache
def least_matches(similarity: float, miss: float) -> np.ndarray:
    """After each batch, the matches below which a pair is dropped: P(similarity reached | matches) < ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= similarity - 1e-9
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            weight = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(weight - weight.max())
            if weight[above].sum() >= miss * weight.sum():
                break
        out.append(m)
    return np.array(out)


def survivors(one: np.ndarray, many: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows of ``many`` whose signatures stay plausible against ``one``, batch by batch."""
    left = np.arange(len(many))
    matches = np.zeros(len(many), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[left] += (many[left, part] == one[part]).sum(axis=1)
        left = left[matches[left] >= need]
    return left


def reaches(common: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _percent(similarity: float) -> int:
    return round(100 * similarity)


def sign(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``id_, n_shingles, key_`` (digest of the set) and ``bands_`` of every document."""
    def start():
        def function(texts):
            sets = shingle_sets(texts, n)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = band_keys(np.stack([signature(s) for s in sets])).view(np.int64)
            return ([len(s) for s in sets], pa.array(keys, pa.binary()),
                    [b.tolist() if len(s) else None for s, b in zip(sets, bands, strict=True)])

        return function

    slim = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    return per_document(slim, "id_", "text_", [
        T.StructField("n_shingles", T.LongType()), T.StructField("key_", T.BinaryType()),
        T.StructField("bands_", T.ArrayType(T.LongType()))], start)


def _verify_pairs(pairs: DataFrame, n: int, similarity: float, miss: float) -> DataFrame:
    """Links among rows of (a, b, text_a, text_b)."""
    percent = _percent(similarity)

    def run(batches):
        least = least_matches(similarity, miss)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, (one, two) in text_slices(batch.column(2), batch.column(3)):
                texts = list(dict.fromkeys(one + two))
                place = {t: i for i, t in enumerate(texts)}
                sets = shingle_sets(texts, n)
                signed = np.stack([signature(s) for s in sets])
                keep = []
                for i, (x, y) in enumerate(zip((place[t] for t in one), (place[t] for t in two), strict=True), low):
                    if len(survivors(signed[x], signed[y:y + 1], least)):
                        common = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                        if reaches(common, len(sets[x]), len(sets[y]), percent):
                            keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])
        give_back()

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _signatures(texts: DataFrame, n: int) -> DataFrame:
    """``id_, signature_`` of texts with a word."""
    def start():
        def function(found):
            return (pa.array([signature(s).tobytes() if len(s) else None for s in shingle_sets(found, n)], pa.binary()),)

        return function

    return per_document(texts, "id_", "text_", [T.StructField("signature_", T.BinaryType())], start).where("signature_ is not null")


def _partners(x: int, rest: np.ndarray, labels: np.ndarray, signed: np.ndarray, bands: np.ndarray, number: int, least: np.ndarray) -> np.ndarray:
    """Places in ``rest`` of rows of other classes than row ``x`` that may be linked with it and share no earlier band:
    a pair is the business of the first band it shares."""
    other = np.flatnonzero(labels[rest] != labels[x])
    other = other[survivors(signed[x], signed[rest[other]], least)]
    return other[~(bands[rest[other], :number] == bands[x, :number]).any(axis=1)]


def _plausible(units: DataFrame, similarity: float, miss: float) -> DataFrame:
    """Members of block pairs that have a plausible partner there: rows of (group, unit, band number, outer, id, class, signature)."""
    kept = T.StructType([f for f in units.schema if f.name not in ("group_", "signature_")])
    names = kept.names

    def run(table):
        least = least_matches(similarity, miss)
        signed = np.stack([np.frombuffer(b, np.uint32) for b in table.column("signature_").to_pylist()])
        bands = band_keys(signed)
        labels, unit, outer, number_of = (table.column(c).to_numpy() for c in ("class_", "unit_", "outer_", "number_"))
        order = np.argsort(unit, kind="stable")
        keep = np.zeros(len(unit), bool)
        for members in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            rest = members[~outer[members]]
            for x in members[outer[members]]:
                other = _partners(x, rest, labels, signed, bands, int(number_of[x]), least)
                keep[rest[other]] = True
                keep[x] |= len(other) > 0
        return table.select(names).filter(pa.array(keep))

    return units.groupBy("group_").applyInArrow(run, kept)


def _verify_blocks(rows: DataFrame, n: int, similarity: float, miss: float) -> DataFrame:
    """Links between the outer and the other members of block pairs: rows of (group, unit, band number, outer, id, class, text)."""
    percent = _percent(similarity)

    def run(table):
        least = least_matches(similarity, miss)
        ids, labels = table.column("id_").to_numpy(), table.column("class_").to_numpy()
        texts = table.column("text_").to_pylist()
        known = list(dict.fromkeys(texts))
        place = {t: i for i, t in enumerate(known)}
        of = np.array([place[t] for t in texts])
        sets = shingle_sets(known, n)
        signed = np.stack([signature(s) for s in sets])
        signed, bands = signed[of], band_keys(signed)[of]
        sizes = np.array([len(s) for s in sets])
        unit, outer, number_of = (table.column(c).to_numpy(zero_copy_only=False) for c in ("unit_", "outer_", "number_"))
        order = np.argsort(unit, kind="stable")
        order = order[sizes[of[order]] > 0]
        out = [[], []]
        for members in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            rest = members[~outer[members]]
            if not len(rest):
                continue
            number = int(number_of[rest[0]])
            whole = np.concatenate([sets[of[i]] for i in rest])
            cuts = np.concatenate([[0], np.cumsum(sizes[of[rest]])])[:-1]
            for x in members[outer[members]]:
                mine = of[x]
                other = _partners(x, rest, labels, signed, bands, number, least)
                if len(other):
                    where = np.minimum(np.searchsorted(sets[mine], whole), len(sets[mine]) - 1)
                    common = np.add.reduceat((sets[mine][where] == whole).astype(np.int64), cuts)[other]
                    linked = other[reaches(common, sizes[mine], sizes[of[rest[other]]], percent)]
                    # one link to each class is enough
                    _, first = np.unique(labels[rest[linked]], return_index=True)
                    out[0] += [int(ids[x])] * len(first)
                    out[1] += ids[rest[linked[first]]].tolist()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return rows.groupBy("group_").applyInArrow(run, "a long, b long")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, miss: float = MISS,
    block: int = BLOCK,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row. ``similarity`` counts in whole hundredths."""
    signed = durable(sign(docs, id_col, text_col, n))
    usable = signed.where(F.col("id_").isNotNull() & F.col("key_").isNotNull())
    alike = usable.groupBy("key_").agg(F.min(F.struct("id_", "bands_")).alias("first_"))
    single = alike.select("key_", F.col("first_.id_").alias("id_"), F.col("first_.bands_").alias("bands_"))
    banded = single.select("id_", F.posexplode("bands_").alias("number_", "band_"))
    shared = banded.groupBy("band_").agg(F.count("*").alias("members_")).where("members_ > 1")
    members = durable(banded.join(shared, "band_"))
    texts = durable(docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).join(
        members.select("id_").distinct(), "id_", "left_semi").groupBy("id_").agg(F.max("text_").alias("text_")))

    # every member against the hub of its buckets
    weight = members.groupBy("id_").agg(F.sum("members_").alias("weight_"))
    weighed = attach(members, weight, ["id_"])
    hubs = weighed.groupBy("band_").agg(F.max(F.struct("weight_", (-F.col("id_")).alias("minus_"))).alias("hub_")).select(
        "band_", (-F.col("hub_.minus_")).alias("hub_"))
    pairs = attach(members, hubs, ["band_"]).where("id_ <> hub_").select(
        F.greatest("id_", "hub_").alias("a"), F.least("id_", "hub_").alias("b"), "hub_").dropDuplicates(["a", "b"])
    other = pairs.select(F.when(F.col("hub_") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("id_"), "hub_")
    with_text = attach(attach(other, texts, ["id_"]).select(F.col("id_").alias("a"), F.col("text_").alias("text_a"), "hub_"),
                       texts.select(F.col("id_").alias("hub_"), F.col("text_").alias("text_b")), ["hub_"])
    links = durable(_verify_pairs(with_text.withColumnRenamed("hub_", "b"), n, similarity, miss))
    found = durable(components(links))

    # what buckets with several classes still hide
    labelled = attach(members, found.withColumnRenamed("node", "id_"), ["id_"]).select(
        "id_", "number_", "band_", "members_", F.coalesce("component", "id_").alias("class_"))
    sizes = labelled.groupBy("band_", "class_").agg(F.count("*").alias("size_"))
    major = sizes.groupBy("band_").agg(F.max(F.struct("size_", "class_")).alias("top_"), F.count("*").alias("classes_")).where(
        "classes_ > 1").select("band_", F.col("top_.class_").alias("major_"), F.col("top_.size_").alias("major_size_"))
    mixed = attach(labelled, major, ["band_"]).where(F.col("major_").isNotNull()).select(
        "id_", "number_", "band_", "class_", (F.col("class_") != F.col("major_")).alias("outer_"),
        F.ceil(F.col("members_") / block).cast("int").alias("all_blocks_"),
        F.ceil((F.col("members_") - F.col("major_size_")) / block).cast("int").alias("outer_blocks_"))

    def placed(rows, outer, own, across):
        mine = F.pmod(F.xxhash64("id_"), F.col(own)).cast("int")
        spread = rows.withColumn("across_", F.explode(F.sequence(F.lit(0), F.col(across) - 1)))
        i, j = (mine, F.col("across_")) if outer else (F.col("across_"), mine)
        return spread.select("id_", "number_", "class_", F.lit(outer).alias("outer_"), F.xxhash64("band_", i, j).alias("unit_"))

    units = placed(mixed.where("outer_"), True, "outer_blocks_", "all_blocks_").unionByName(placed(mixed, False, "all_blocks_", "outer_blocks_"))
    units = durable(units)
    signatures = durable(_signatures(texts.join(units.select("id_").distinct(), "id_", "left_semi"), n))
    signed_units = spread_join(units, signatures, ["id_"]).withColumn("group_", F.pmod("unit_", F.lit(units.count() // GROUP_ROWS + 1)))
    left = durable(_plausible(signed_units, similarity, miss))
    discard(units, signatures)
    full = attach(left, texts, ["id_"])
    chars = attach(left.groupBy("id_").agg(F.count("*").alias("times_")), texts, ["id_"]).agg(
        F.coalesce(F.sum(F.col("times_") * F.length("text_")), F.lit(0))).first()[0]
    groups = int(chars // GROUP_CHARS) + 1
    more = _verify_blocks(full.withColumn("group_", F.pmod("unit_", F.lit(groups))), n, similarity, miss)
    final = components(links.unionByName(more))

    root = attach(single.select("key_", F.col("id_").alias("node")), final, ["node"]).select("key_", F.coalesce("component", "node").alias("root_"))
    rows = attach(signed.select("id_", "n_shingles", "key_"), root, ["key_"])
    # rows of one id with different texts: the id has one class, the smallest
    own = rows.groupBy("id_").agg(F.min("root_").alias("root_"))
    out = attach(rows.drop("root_"), own, ["id_"])
    component = F.when(F.col("id_").isNotNull(), F.coalesce("root_", "id_"))
    return out.select(F.col("id_").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id_") == component, F.lit(True)).alias("kept"))
