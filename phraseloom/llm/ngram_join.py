"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links make.

Sets of word shingles fall into bands of sizes; a set joins its own band and the next, so any
two sets that may be similar meet in the larger one's band. A band has a largest symmetric
difference k of similar sets. PartEnum at two levels: a hash cuts the feature domain into N1
parts, each into N2 = 4 smaller ones. Of the N1 parts one holds at most one of k < 2 * N1
differences, so in it three of the four smaller parts agree: each part enumerates its subsets of
three, and what a set has in such a subset is a signature. Empty subsets give none. To spoil all
signatures of a part takes two differences where a set has features in two or more of its smaller
parts, one where it has them in one, none where it has none; a set whose parts take more than k
in sum shares a signature with any similar set. A set whose parts take fewer adds other cuts
until one suits, and its single shingles if none does: of two similar sets both have the cut that
suits the first of them, so no similar pair is missed.

What comes before lessens the sets, not the links:

- A shingle that a single document has is in no other set. Sets of which less than the threshold
  is found elsewhere have no partner. Shingles are dealt by hash and counted, of all documents
  first and then of the classes (texts that are equal as sets) that are left.
- Shingles that FREQUENT of all documents have would put unlike sets together. Cuts of what is
  left without them come first, and the same argument holds in that domain.

Of the sets with one signature the smallest doc_id is the lead. All pairs with a lead are
verified, and what the links reach is a component. Two similar sets that share no component yet
are both beside one lead: the sets beside a lead in several components are compared by bit maps,
in blocks of bounded bytes, and pairs that the maps allow are verified, the likeliest of two
components first. No pairs are rows before the maps have allowed them.

Shingles are 64-bit hashes; at 10 ** 12 distinct shingles some 30,000 pairs of them collide, of
which a link is changed only where sets differ by one shingle from the threshold.

Texts that are the same as sets are one class from the start. Null, empty and blank texts have
0 shingles, link with nothing and are their own component. Rows with a null doc_id get a null
component. Rows with the same doc_id are one node, which has the links of all their texts; each
gets a row. An empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, forget, grouped, lowered, materialize, mix, runs, spans_of, text_bytes, word_hashes
from .components import components

WORDS = 5
#: The threshold as a fraction
NEED = (3, 4)
FREQUENT = 0.003
#: Smaller parts of a part
N2 = 4
BUCKET_ENTRIES = 2_000_000
FLUSH = 500_000
BLOCK_BYTES = 4 << 20
CUTS_RARE, CUTS_ALL = 2, 3
STEP = U64(0xD6E8FEB86659FD93)
LOW = U64(0xFFFFFFFF)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes."""
    data, offsets = text_bytes(column)
    low = lowered(data)
    starts, ends = spans_of(~SPACE[low], offsets)
    hashes = word_hashes(low, starts, ends)
    at = np.searchsorted(starts, offsets)
    padded = np.concatenate([hashes, np.zeros(words, U64)])
    sums = padded[: len(hashes)].copy()
    factor = U64(1)
    for k in range(1, words):
        factor = U64((int(factor) * int(STEP)) & 0xFFFFFFFFFFFFFFFF)
        sums += padded[k : k + len(hashes)] * factor
    sums = mix(sums)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(sums[a : b - words + 1])
        elif b > a:
            value = b - a
            for h in hashes[a:b].tolist():
                value = (value * int(STEP) + h) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([value], U64))
        else:
            yield np.zeros(0, U64)


@lru_cache
def bands() -> tuple[list[int], list[int], list[int]]:
    """Of each band: the smallest size, the largest difference k of similar sets, and the number of parts, more than (k + 1) / 2."""
    lows, ks = [], []
    low = 1
    p, q = NEED
    while low < 1 << 40:
        high = low * q // p
        lows.append(low)
        ks.append(max(0, *(t - 2 * -(-p * t // (p + q)) for t in range(max(2, 2 * high - 20), 2 * high + 1))))
        low = high + 1
    return lows, ks, [-(-14 * (k + 1) // 25) for k in ks]


def _cut(h: np.ndarray, n: int, tag: int, out: list[np.ndarray]) -> int:
    """Adds the signatures of one cut of the domain into n parts; how many differences it takes to spoil all."""
    place = ((h >> U64(32)) * U64(n * N2)) >> U64(32)
    heads = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    at = place[heads].astype(np.int64)
    part, which = np.unique(at // N2, return_inverse=True)
    sums = np.zeros((len(part), N2), U64)
    used = np.zeros((len(part), N2), bool)
    sums[which, at % N2] = np.add.reduceat(mix(h + U64(0x632BE59BD9B4E019)), heads)
    used[which, at % N2] = True
    n_used = used.sum(1)
    # each subset leaves one smaller part out
    subset = mix(sums.sum(1, keepdims=True) - sums + mix(U64(tag << 44) + (part[:, None] * N2 + np.arange(N2)).astype(U64)))
    out.append(subset[n_used[:, None] - used > 0])
    return int(np.minimum(n_used, 2).sum())


def truncated(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's bucket and its last 32 bits."""
    return ((h >> U64(32)) * U64(n_buckets)) >> U64(32), (h & LOW).astype(np.uint32)


def signatures(h: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """All signatures of a set, given as ascending hashes; rare: those that are not frequent."""
    lows, ks, parts = bands()
    own = int(np.searchsorted(lows, len(h), "right")) - 1
    out: list[np.ndarray] = []
    for band in (own, own + 1):
        for domain, family, cut in [*((rare, 1, c) for c in range(CUTS_RARE)), *((h, 2, c) for c in range(CUTS_ALL))]:
            values = domain if not cut else np.sort(mix(domain ^ U64(cut * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
            if len(values) and _cut(values, parts[band], (band * 4 + family) * 16 + cut, out) > ks[band]:
                break
        else:
            out.append(mix(h + U64(band + (1 << 60))))
    return np.concatenate(out)


PROFILE = "doc_id long, n_shingles long, digest binary, tag long"


def digest_of(h: np.ndarray) -> bytes:
    return hashlib.sha256(h.tobytes()).digest()[:16]


def tag_of(doc_id: int, digest: bytes) -> int:
    """Stands for a row's set in counts; two rows of one tag would only be counted together, which drops neither."""
    return int(mix(np.array([(doc_id & 0xFFFFFFFFFFFFFFFF) ^ int.from_bytes(digest[:8], "little")], U64)).view(np.int64)[0])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, "text", 2 << 20):
        n, digests, tags = [], [], []
        for key, h in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True):
            n.append(len(h))
            digests.append(digest_of(h))
            tags.append(None if key is None else tag_of(key, digests[-1]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(tags, pa.int64())], names=["doc_id", "n_shingles", "digest", "tag"])


PACKED = "bucket int, stretch long, tags binary, sizes binary, hashes binary"


def _packed(sets: list[np.ndarray], tags: list[int], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The sets' shingles by bucket: the tags of the sets with shingles in it, their numbers of shingles, and these."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket, low = truncated(np.concatenate(sets), n_buckets)
    # hashes ascend in a set; so by bucket, and by set within
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    bucket, low, owner = bucket[order], low[order], owner[order]
    heads = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])) + 1])
    sizes = np.diff(np.concatenate([heads, [len(low)]])).astype(np.int32)
    tag = np.array(tags, np.int64)[owner[heads]]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[heads].astype(np.int64))) + 1, [len(heads)]])
    ends = np.concatenate([heads, [len(low)]])
    stretch = int(mix(np.array(tags, np.int64).view(U64) + np.arange(len(tags), dtype=U64)).sum().view(np.int64))
    rows = [(int(bucket[heads[a]]), stretch, tag[a:b].tobytes(), sizes[a:b].tobytes(), low[ends[a] : ends[b]].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for k in range(0, len(rows), 256):
        columns = list(zip(*rows[k : k + 256], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["bucket", "stretch", "tags", "sizes", "hashes"])


def dealt_texts(texts: DataFrame, n_buckets: int) -> DataFrame:
    """Shingles of texts, packed by bucket. Equal sets of a stretch are sent once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        tags: list[int] = []
        seen: set[bytes] = set()
        n = 0
        for batch in runs(batches, "text", 1 << 20):
            for key, h in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                digest = digest_of(h)
                if key is None or not len(h) or digest in seen:
                    continue
                seen.add(digest)
                sets.append(h)
                tags.append(tag_of(key, digest))
                n += len(h)
            if n >= FLUSH:
                yield from _packed(sets, tags, n_buckets)
                sets, tags, seen, n = [], [], set(), 0
        if sets:
            yield from _packed(sets, tags, n_buckets)

    return texts.mapInArrow(deal, PACKED)


def dealt_sets(sets: DataFrame, n_buckets: int) -> DataFrame:
    """As dealt_texts, of the table of sets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "shingles", 8 * FLUSH):
            yield from _packed([np.frombuffer(x, U64) for x in batch.column("shingles").to_pylist()], batch.column("tag").to_pylist(), n_buckets)

    return sets.select("tag", "shingles").mapInArrow(deal, PACKED)


COUNTED = "stretch long, tags binary, repeats binary, common long"


def counted(packed: DataFrame, often: float) -> DataFrame:
    """Of each stretch of sets in a bucket: the tags of sets that have shingles which other sets have too, and how many; then (common) shingles that `often` sets have at least, as bucket and last 32 bits."""

    def count(pdf):
        import pandas as pd

        n_tags = (pdf["tags"].str.len() // 8).to_numpy()
        tags = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["tags"]])
        sizes = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]])
        values = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hashes"]]).astype(U64) << U64(32)
        values |= np.repeat(np.arange(len(tags), dtype=U64), sizes)
        values.sort()
        low = values >> U64(32)
        equal = low[1:] == low[:-1]
        again = np.zeros(len(low), bool)
        again[1:] = equal
        again[:-1] |= equal
        repeats = np.bincount((values[again] & LOW).astype(np.int64), minlength=len(tags)).astype(np.int32)
        heads = np.flatnonzero(again & ~np.concatenate([[False], equal]))
        counts = np.diff(np.concatenate([np.searchsorted(np.flatnonzero(again), heads), [again.sum()]]))
        common = low[heads[counts >= often]].astype(np.int64) | (int(pdf["bucket"].iloc[0]) << 32)
        rows = []
        ends = np.cumsum(n_tags).tolist()
        for stretch, at, end in zip(pdf["stretch"].tolist(), [0, *ends[:-1]], ends, strict=True):
            some = at + np.flatnonzero(repeats[at:end])
            if len(some):
                rows.append((stretch, tags[some].tobytes(), repeats[some].tobytes(), None))
        rows += [(None, None, None, x) for x in common.tolist()]
        return pd.DataFrame(rows, columns=["stretch", "tags", "repeats", "common"]).astype({"stretch": "Int64", "common": "Int64"})

    return packed.groupBy("bucket").applyInPandas(count, COUNTED)


def repeats_of(found: DataFrame) -> DataFrame:
    """tag, repeats: of how many of a set's shingles other sets have too. What the buckets found is summed by stretch, so that no row is a bucket's count of a document."""

    def total(pdf):
        import pandas as pd

        tags = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["tags"]])
        tag, at = np.unique(tags, return_inverse=True)
        n = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["repeats"]])
        return pd.DataFrame({"tag": tag, "repeats": np.bincount(at, weights=n, minlength=len(tag)).astype(np.int64)})

    return found.where("stretch is not null").select("stretch", "tags", "repeats").groupBy("stretch").applyInPandas(total, "tag long, repeats long").groupBy("tag").agg(F.sum("repeats").alias("repeats"))


SETS = "id long, digest binary, tag long, n long, bits binary, shingles binary"


def bit_map(h: np.ndarray) -> np.ndarray:
    """Words of a map of 2 to 4 bits a shingle, at least 128: bit h modulo the size is set for each shingle h."""
    size = 1 << max(7, int(2 * len(h) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(h & U64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(U64)


def folded(maps: np.ndarray, n_words: int) -> np.ndarray:
    """Maps (rows of words) as maps of n_words words."""
    while maps.shape[1] > n_words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def most_common(na, nb, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most how many shingles two sets share. A bit that only one map has stands for a shingle that only one set has."""
    both = np.bitwise_count(a & b).sum(-1, dtype=np.int64)
    return np.minimum(na - (np.bitwise_count(a).sum(-1, dtype=np.int64) - both), nb - (np.bitwise_count(b).sum(-1, dtype=np.int64) - both))


def allowed(na, nb, common) -> np.ndarray:
    p, q = NEED
    return common * q >= (na + nb - common) * p


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the classes `wanted` (id, digest), of their texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text", 1 << 20):
            rows = []
            for key, digest, h in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if digest_of(h) == digest:  # else another text of the same doc_id
                    rows.append((key, digest, tag_of(key, digest), len(h), bit_map(h).tobytes(), h.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "digest", "tag", "n", "bits", "shingles"])

    joined = texts.join(wanted.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), "doc_id").select("doc_id", "digest", "text")
    return joined.mapInArrow(build, SETS).dropDuplicates(["id", "digest"])


def signed(sets: DataFrame, frequent: np.ndarray, n_buckets: int) -> DataFrame:
    """(sig, id) of all sets."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in runs(batches, "shingles", 1 << 20):
            sigs, ids = [], []
            for key, data in zip(batch.column("id").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                h = np.frombuffer(data, U64)
                rare = h
                if len(common):
                    bucket, low = truncated(h, n_buckets)
                    short = bucket.astype(np.int64) << 32 | low.astype(np.int64)
                    at = np.searchsorted(common, short)
                    at[at == len(common)] = 0
                    rare = h[common[at] != short]
                sigs.append(np.unique(signatures(h, rare)).view(np.int64))
                ids.append(np.full(len(sigs[-1]), key, np.int64))
            flat, flat_ids = np.concatenate(sigs), np.concatenate(ids)
            for k in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(flat[k : k + (1 << 16)]), pa.array(flat_ids[k : k + (1 << 16)])], names=["sig", "id"])

    return sets.select("id", "shingles").mapInArrow(sign, "sig long, id long")


def likely(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) that the bit maps allow, with the size of both sets; no similar pair is lost."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            common = np.zeros(len(na), np.int64)
            for k, (x, y) in enumerate(zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, U64)[None], np.frombuffer(y, U64)[None]
                words = min(x.shape[1], y.shape[1])
                common[k] = most_common(na[k], nb[k], folded(x, words), folded(y, words))[0]
            ok = pa.array(allowed(na, nb, common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(na + nb).filter(ok)], names=["a", "b", "size"])

    side = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"m{k}"))
    p, q = NEED
    both = edges.join(side("b"), "b").join(side("a"), "a").where((F.least("na", "nb") * q >= F.greatest("na", "nb") * p)).select("a", "b", "na", "nb", "ma", "mb")
    return both.mapInArrow(check, "a long, b long, size long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b; size is that of both sets) whose sets are similar.

    Sets meet in rounds, each of about as many shingles as the table of sets holds, so that
    what a round shuffles does not grow with the number of pairs.
    """
    held = int(sets.agg(F.sum("n")).first()[0] or 0)
    rounds = max(1, -(-int(pairs.agg(F.sum("size")).first()[0] or 0) // max(2 * held, 1)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                ok.append(bool(allowed(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    parts = []
    for k in range(rounds):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k).select("a", "b")
        with_b = part.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")
        parts.append(materialize(both.mapInArrow(check, "a long, b long").distinct(), "similar"))
    return reduce(DataFrame.union, parts)


BESIDE = "a long, b long, size long"


def across(edges: DataFrame, sets: DataFrame, roots: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b, size) of different components beside one lead that the bit maps allow; best: for two components beside a lead, in a block, only the likeliest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in grouped(batches, ["a", "i", "j"]):
            first = group.column("block").to_numpy() == i
            ids, root, n = (group.column(c).to_numpy() for c in ("id", "root", "n"))
            maps = group.column("bits").to_pylist()
            words = np.array([len(m) // 8 for m in maps])
            by_size = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
            table = {w: np.frombuffer(b"".join(maps[k] for k in at), U64).reshape(-1, w) for w, at in by_size.items()}
            found = [np.zeros((0, 3), np.int64)]
            for w, at in by_size.items():
                for v in (w, 2 * w):  # sizes of similar sets differ less than twofold
                    if v not in by_size:
                        continue
                    other, right = by_size[v], folded(table[v], w)
                    step = max(1, (1 << 20) // (len(other) * w))
                    for k in range(0, len(at), step):
                        own = at[k : k + step]
                        common = most_common(n[own][:, None], n[other][None], table[w][k : k + step][:, None], right[None])
                        ok = allowed(n[own][:, None], n[other][None], common) & (root[own][:, None] != root[other][None])
                        if i != j:
                            ok &= first[own][:, None] != first[other][None]
                        if v == w:
                            ok &= own[:, None] < other[None]
                        x, y = np.nonzero(ok)
                        found.append(np.stack([own[x], other[y], common[x, y]], 1))
            pairs = np.concatenate(found)
            if best and len(pairs):
                low, high = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]]), np.maximum(root[pairs[:, 0]], root[pairs[:, 1]])
                order = np.lexsort((-pairs[:, 2] / (n[pairs[:, 0]] + n[pairs[:, 1]]), high, low))
                low, high = low[order], high[order]
                pairs = pairs[order[np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])]]
            x, y = ids[pairs[:, 0]], ids[pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(n[pairs[:, 0]] + n[pairs[:, 1]])], names=["a", "b", "size"])

    placed = sets.select("id", "n", "bits").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "bits", F.coalesce("root", "id").alias("root"))
    beside = edges.select("a", F.col("b").alias("id")).join(placed, "id")
    mixed = beside.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.octet_length("bits") + 64).alias("bytes")).where("low != high")
    mixed = mixed.select("a", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    members = beside.join(mixed, "a").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root", "n", "bits")
    dealt = members.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    return dealt.mapInArrow(compare, BESIDE).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach; one row for each row of docs."""
    p, q = NEED
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(texts.mapInArrow(_profile, PROFILE), "profile")
    n_docs, n_all = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    n_buckets = max(8, -(-int(n_all) // BUCKET_ENTRIES))
    enough = lambda n: F.col("repeats") * q >= F.col(n) * p

    in_rows = materialize(counted(dealt_texts(texts, n_buckets), max(16, FREQUENT * n_docs)), "repeats")
    # at most 1 / FREQUENT times the mean size of a set
    frequent = np.sort(np.array([r[0] for r in in_rows.where("common is not null").select("common").collect()], np.int64))
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    digests = known.join(repeats_of(in_rows), "tag").where(enough("n_shingles")).select("digest").distinct()
    wanted = materialize(classes.join(digests, "digest").select(F.col("rep").alias("id"), "digest"), "wanted")
    all_sets = materialize(sets_of(texts, wanted), "sets")
    in_classes = counted(dealt_sets(all_sets, n_buckets), np.inf)
    sets = materialize(all_sets.join(repeats_of(in_classes), "tag").where(enough("n")).select("id", "n", "bits", "shingles"), "sets")
    for done in (in_rows, wanted, all_sets):
        forget(done)

    sigs = materialize(signed(sets, frequent, n_buckets), "signatures")
    leads = materialize(sigs.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("sig", "a"), "leads")
    edges = materialize(sigs.join(leads.hint("shuffle_hash"), "sig").where("id != a").select("a", F.col("id").alias("b")).distinct(), "edges")
    forget(sigs)
    forget(leads)

    # a doc_id of several texts makes their classes one
    class_of = known.join(classes, "digest").select(F.col("doc_id").alias("id"), "rep")
    least = class_of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("id", "a")
    links = materialize(class_of.join(least, "id").where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "links")
    for step in ("leads", "best", "all"):
        pairs = materialize(likely(edges, sets) if step == "leads" else across(edges, sets, roots, step == "best"), "likely")  # noqa: F821
        if step == "leads" or not pairs.isEmpty():
            links = links.union(verified(pairs, sets))
            roots = materialize(components(links), "roots")
        forget(pairs)
    forget(sets)
    forget(edges)
    placed = class_of.join(roots.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    return rows.join(placed.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
