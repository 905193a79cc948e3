"""Documents whose sets of word shingles have a Jaccard similarity of at least ``SIMILAR`` percent, as components.

A set's shingles are dealt by hash over the segments of a parity sketch; a segment holds the XOR of 64-bit words of its
shingles, so one shingle more or less changes one segment, and the number of segments that differ never exceeds the
symmetric difference.  For a size band whose similar pairs differ in at most ``d`` shingles, sketches have 2d + 2 segments:
similar sets agree in d + 2 of them, and of these in one of the d + 1 best of either set, in any order that both sets see
alike, so each set looks for partners by d + 1 segments only and no similar pair is missed.  The best hold the most
shingles that are not known as common, then the most shingles.  Common are those that a certain share of all documents
hold, counted over the whole table; that list only decides which segments are looked up, so passages that many documents
quote make few chance partners, and no result depends on it.  A set enters its own band and those lower ones that hold similar smaller sets.

Equal sets are folded first.  Sets that agree in a segment form a group.  Each set is first checked exactly against the
partner it agrees with most among the smallest members of its groups; components of what is found are then taken
as known, and only pairs across components go on: within blocks of a group their bit sketches (one bit per shingle, by
XOR) are compared, and pairs whose Hamming distance allows the similarity are checked exactly.

Sketch segments travel in packed pieces, one per task batch and bucket, not as rows.  Within a task a set that repeats is
sent once, so thousands of copies cost no more than one per task.

NULL and empty texts have empty sets and link with nothing; a shorter text than a shingle is one shingle.  Sets go by
their own keys throughout, so rows that repeat a doc_id are told apart by their sets; ids only enter at the end.  Sets known only from rows with a NULL doc_id take no part, and such rows
have a NULL component.  Result columns replace columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, maybe_among, pieces, released, rows, stored, tasks_for, texts_of, worker_memory
from .components import components
from .shingles import mixed, shingle_sets

SIMILAR = 80  # percent
BAND = 1.5  # upper size of a band over its lower one
BUCKET_ENTRIES = 1 << 20
BLOCK = 1024
NEAREST = 1
SHARP = 2048  # places up to which a sketch is sparse
SMALL = 8  # members of a group up to which its pairs are listed
BITS = 40  # of a segment and of a set, as sent; a chance match only costs a check
PIECE = 2 << 20
SEEN = 100_000  # sets a task remembers having sent
SHARED_BY, OF_EVERY = 3, 8_000  # documents that hold a common shingle, of so many; as many at least in smaller tables
COUNTED = 1 << 20  # shingles counted together, about
COUNT_PARTS = 1024  # parts in which shingles are counted, at most
_MASK = np.uint64((1 << BITS) - 1)


def bands(largest: int, similar: int = SIMILAR) -> list[tuple[int, int, int, int]]:
    """Lower size, first size above, largest partner size and segments d + 1 of each band up to a size."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, int(low * BAND))
        partner = (high - 1) * 100 // similar
        out.append((low, high, partner, (high - 1 + partner) * (100 - similar) // (100 + similar) + 1))
        low = high
    return out


def segments(shingles: np.ndarray, common: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """The segments by which a set looks for partners, over all bands it enters; ``common`` is sorted."""
    n, out = len(shingles), []
    at = np.searchsorted(common, shingles)
    rare = np.append(common, np.uint64(0))[at] != shingles
    rare |= at == len(common)
    top = 1
    while top < n:
        top *= 2
    known = worker_memory("parity bands")
    for number, (low, high, partner, wanted) in enumerate(known.get((top, similar)) or known.setdefault((top, similar), bands(top, similar))):
        if low > n:
            break
        if n > partner:
            continue
        count = np.uint64(2 * wanted)
        part = (((shingles >> np.uint64(32)) * count) >> np.uint64(32)).astype(np.int64)  # ascends with the shingles
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        content = np.bitwise_xor.reduceat(mixed(shingles), first)
        size = np.diff(np.append(first, n)) + (np.add.reduceat(rare, first, dtype=np.int64) << 32)
        sketch = mixed(content ^ mixed(part[first].astype(np.uint64) * np.uint64(1 << 20) + np.uint64(number)))
        if len(sketch) < wanted:  # empty segments fill up: all alike, the least full
            empty = np.setdiff1d(np.arange(2 * wanted), part[first])
            sketch = np.append(sketch, mixed(mixed(empty.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(number))))
            size = np.append(size, np.zeros(len(empty), np.int64))
        out.append(sketch[np.lexsort((sketch, size))[::-1][:wanted]])
    return np.concatenate(out)


def bit_sketch(shingles: np.ndarray) -> bytes:
    """One bit per shingle, XORed into a power of two of places: as many as shingles at least, eight times as many for short texts."""
    width = 64
    while width < max(len(shingles), min(8 * len(shingles), SHARP)):
        width *= 2
    places = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(places.astype(np.uint8)).tobytes()


def folded_sketch(sketch: bytes, size: int) -> np.ndarray:
    """A sketch XORed down to ``size`` bytes, as words."""
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits.view(np.uint64)


def similar_sets(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= similar * (len(a) + len(b) - both)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed longs."""
    if not len(shingles):
        return 0, 0
    both = np.array([np.bitwise_xor.reduce(mixed(shingles)), shingles.sum(dtype=np.uint64)]).view(np.int64)
    return int(both[0]), int(both[1])


def _short(key: int) -> int:
    return key & ((1 << BITS) - 1)


def common_shingles(docs: DataFrame, of_every: int = OF_EVERY) -> tuple[np.ndarray, float]:
    """Shingles that ``SHARED_BY`` documents of every ``of_every`` hold, sorted, and the mean size of the sets; all documents are counted.

    There are ``of_every`` / ``SHARED_BY`` times as many as a set of mean size holds, at most.
    """
    measured = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("size")).first()
    least = max(SHARED_BY, SHARED_BY * measured["n"] / of_every)
    parts = min(COUNT_PARTS, tasks_for(docs.sparkSession, (measured["size"] or 0) // 6, COUNTED))
    schema = "part int, once binary, again binary, times binary, n long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in pieces(batches, "text", PIECE):
                texts = Counter(texts_of(batch, "text"))  # copies are one text that counts more
                sets = shingle_sets(list(texts))
                flat, times = _added(np.concatenate(sets), np.repeat(np.array(list(texts.values())), [len(s) for s in sets]))
                part = (((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)  # ascends
                edges, several = np.searchsorted(part, np.arange(parts + 1)), times > 1
                full = np.flatnonzero(np.diff(edges))
                packed = [(flat[a:b][~m], flat[a:b][m], times[a:b][m], times[a:b].sum()) for a, b in zip(edges[full], edges[full + 1]) for m in (several[a:b],)]
                yield rows(schema, [-1, *full], *([b"", *(x[k].tobytes() for x in packed)] for k in range(3)), [batch.num_rows, *(x[3] for x in packed)])
        released()

    def count(key, packed):
        read = lambda name, kind: np.frombuffer(b"".join(packed[name].to_pylist()), kind)
        once = np.sort(read("once", np.uint64))
        first = np.flatnonzero(np.append(True, once[1:] != once[:-1])[:len(once)])
        held, times = once[first], np.diff(np.append(first, len(once)))
        again, more = _added(read("again", np.uint64), read("times", np.int64))
        at = np.minimum(np.searchsorted(held, again), max(0, len(held) - 1))
        both = np.flatnonzero(held[at] == again) if len(held) else np.zeros(0, np.int64)
        times[at[both]] += more[both]
        more[both] = 0
        keep = np.concatenate([held[times >= least], again[more >= least]])
        return pa.Table.from_batches([rows(schema, [key[0].as_py()], [keep.tobytes()], [b""], [b""], [sum(packed["n"].to_pylist())])])

    found = docs.select(F.col("text").cast("string")).mapInArrow(send, schema).groupBy("part").applyInArrow(count, schema).select("part", "once", "n").collect()
    numbers = {r["part"]: r["n"] for r in found}
    listed = np.concatenate([np.frombuffer(r["once"], np.uint64) for r in found] or [np.zeros(0, np.uint64)])
    return np.sort(listed), sum(n for k, n in numbers.items() if k >= 0) / max(1, numbers.get(-1, 0))


def _added(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sum of what each counts."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])
    return values[first], np.add.reduceat(times[order], first) if len(first) else times[:0].copy()


FOUND = "segment long, set long, smallest long, doc_id long, n long, c1 long, c2 long, text long"


def sets_and_groups(docs: DataFrame, buckets: int, common: np.ndarray, similar: int = SIMILAR) -> DataFrame:
    """Rows of two kinds from one reading of the texts: doc_id, n, c1, c2 and the text's hash of each document (``segment`` is NULL), and
    ``segment``, ``set`` and the group's smallest set for every segment that two sets or more look for."""
    shared, width = docs.sparkSession.sparkContext.broadcast(common), BITS // 8

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        with np.errstate(over="ignore"):
            for batch in pieces(batches, "text", PIECE):
                sketches, owners, keys, sizes = [], [], [], []
                for shingles in shingle_sets(texts_of(batch, "text")):
                    key = set_keys(shingles)
                    keys.append(key)
                    sizes.append(len(shingles))
                    if len(shingles) and key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        sketches.append(segments(shingles, shared.value, similar))
                        owners.append(np.full(len(sketches[-1]), _short(key[0]), np.uint64))
                ids = column_of(batch, "doc_id")
                known = np.asarray(ids.is_valid())
                each = np.stack([np.asarray(ids.fill_null(0)), np.array(sizes), *np.array(keys, np.int64).reshape(-1, 2).T, known.astype(np.int64),
                                 np.asarray(column_of(batch, "hash"))], axis=1)
                to = (mixed(each[:, 0].astype(np.uint64) + each[:, 2].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield dealt(to, each.view(np.uint8), 1)
                if sketches:
                    sketch, owner = np.concatenate(sketches), np.concatenate(owners)
                    bucket = ((sketch >> np.uint64(BITS)) * np.uint64(buckets) >> np.uint64(64 - BITS)).astype(np.int64)
                    yield dealt(bucket, np.hstack([(x & _MASK).view(np.uint8).reshape(-1, 8)[:, :width] for x in (sketch, owner)]), 0)
        released()

    def dealt(bucket: np.ndarray, entries: np.ndarray, kind: int) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        entries = entries[order]
        return rows("bucket int, kind int, packed binary", full, np.full(len(full), kind), [entries[edges[k]:edges[k + 1]].tobytes() for k in full])

    def meet(key, sent):
        kinds, packed = sent["kind"].to_pylist(), sent["packed"].to_pylist()
        each = np.frombuffer(b"".join(p for p, k in zip(packed, kinds) if k), np.int64).reshape(-1, 6)
        entries = np.frombuffer(b"".join(p for p, k in zip(packed, kinds) if not k), np.uint8).reshape(-1, 2 * width)
        both = np.zeros((2, len(entries), 8), np.uint8)
        both[0, :, :width], both[1, :, :width] = entries[:, :width], entries[:, width:]
        sketch, owner = both.view(np.uint64)[:, :, 0]
        order = np.lexsort((owner, sketch))
        sketch, owner = sketch[order], owner[order]
        new = np.append(True, (sketch[1:] != sketch[:-1]) | (owner[1:] != owner[:-1]))[:len(sketch)]  # a set sent by several tasks
        sketch, owner = sketch[new], owner[new]
        first = np.flatnonzero(np.append(True, sketch[1:] != sketch[:-1])[:len(sketch)])
        size = np.diff(np.append(first, len(sketch)))
        members = np.repeat(size > 1, size)
        segment = sketch[members].astype(np.int64) + (key[0].as_py() << BITS)
        m, d = len(segment), len(each)
        no = lambda n: pa.nulls(n, pa.int64())
        groups = rows(FOUND, segment, owner[members].astype(np.int64), np.repeat(owner[first], size)[members].astype(np.int64), no(m), no(m), no(m), no(m), no(m))
        sets = rows(FOUND, no(d), no(d), no(d), pa.array(each[:, 0], mask=each[:, 4] == 0), each[:, 1], each[:, 2], each[:, 3], each[:, 5])
        released()
        return pa.Table.from_batches([groups, sets])

    sent = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash().alias("hash")).mapInArrow(send, "bucket int, kind int, packed binary"))
    return sent.groupBy("bucket").applyInArrow(meet, FOUND)


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def texts_with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, text, n and bit sketch of the wanted sets (rep, doc_id): rows of the id whose text has that set."""
    schema = "rep long, text string, n long, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in pieces(batches, "text", PIECE):
                sets = shingle_sets(texts_of(batch, "text"))
                right = np.array([set_keys(s)[0] == c for s, c in zip(sets, column_of(batch, "rep").to_pylist())], bool)
                keep = batch.filter(pa.array(right))
                chosen = [s for s, k in zip(sets, right) if k]
                yield rows(schema, column_of(keep, "rep"), column_of(keep, "text"), [len(s) for s in chosen], [bit_sketch(s) for s in chosen])
        released()

    # most documents have no partner and go before the shuffle
    maybe = maybe_among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")), wanted, "doc_id")
    return maybe.join(wanted, "doc_id").select("rep", "text").mapInArrow(run, schema)


def checked(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in pieces(pieces(batches, "text_a", PIECE), "text_b", PIECE):
                names, places = {}, []
                for name in ("text_a", "text_b"):
                    places.append([names.setdefault(t, len(names)) for t in texts_of(batch, name)])
                sets = shingle_sets(list(names))
                found = [similar_sets(sets[i], sets[j], similar) for i, j in zip(*places)]
                keep = batch.filter(pa.array(found, pa.bool_()))
                yield rows("a long, b long", column_of(keep, "a"), column_of(keep, "b"))

    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def across(groups: DataFrame, known: DataFrame, texts: DataFrame, similar: int = SIMILAR, nearest: int = 0) -> DataFrame:
    """Distinct pairs (a < b) of one group, in different components, that their bit sketches allow to be similar.

    Groups of up to ``SMALL`` members list their pairs, each pair once for all its groups, and sketches are looked up for
    the pairs.  In larger groups sketches travel with the members: those of the component with most members stand on one
    side, only the others are compared with each other; either kind is split into blocks, each pair of blocks a piece of work.
    With ``nearest``, only the large groups are read, and each member there gives its pairs with that many nearest sketches.
    """
    spark = groups.sparkSession
    placed = stored(groups.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
                    .select("segment", "rep", F.coalesce("component", "rep").alias("component")), "parity-placed")
    sizes = placed.groupBy("segment", "component").agg(F.count("*").alias("n"))
    mixed_groups = stored(sizes.groupBy("segment").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
                          .where("main.n < all").select("segment", F.col("main.component").alias("main"), F.col("main.n").alias("n_main"), (F.col("all") - F.col("main.n")).alias("n_other")),
                          "parity-mixed")
    few = F.col("n_main") + F.col("n_other") <= SMALL
    listed = placed.join(mixed_groups.where(few).select("segment"), "segment").join(texts.select("rep", "n"), "rep")
    side = lambda x: listed.select("segment", F.col("rep").alias(x), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = (side("a").join(side("b"), "segment").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")))
             .where(100 * F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b")).select("a", "b").distinct())
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    member = (placed.join(mixed_groups.where(~few), "segment").withColumn("other", F.col("component") != F.col("main"))
              .withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("other"), blocks("n_other")).otherwise(blocks("n_main")))))
    seq = lambda n: F.sequence(F.lit(0).cast("long"), blocks(n) - 1)
    works = F.when(F.col("other"), F.concat(F.transform(seq("n_other"), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high"))),
                                            F.transform(seq("n_main"), lambda j: F.struct(F.col("block").alias("low"), (-1 - j).alias("high")))))
    works = works.otherwise(F.transform(seq("n_other"), lambda j: F.struct(j.alias("low"), (-1 - F.col("block")).alias("high"))))
    dealt = stored(member.select("segment", "rep", "component", "other", F.explode(works).alias("w")).select("segment", "rep", "component", "other", "w.*")
                   .join(texts.select("rep", "n", "sketch"), "rep"), "parity-work", "none")
    tasks = tasks_for(spark, dealt.count(), 20_000)
    schema = "a long, b long"

    def compare(key, work):
        work = work.sort_by([("segment", "ascending"), ("low", "ascending"), ("high", "ascending")])
        where = np.stack([work[c].to_numpy() for c in ("segment", "low", "high")])
        edges = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), work.num_rows]
        rep, component, n, other = (np.asarray(work[c]) for c in ("rep", "component", "n", "other"))
        sketches, found = work["sketch"].to_pylist(), [np.zeros((2, 0), np.int64)]
        for x, y in zip(edges, edges[1:]):
            if y - x < 2:
                continue
            size = min(len(s) for s in sketches[x:y])
            words = np.stack([folded_sketch(s, size) for s in sketches[x:y]])
            left = np.flatnonzero(other[x:y])
            for k in left:  # one against the rest of the block pair
                sizes = n[x:y] + n[x + k]
                rest = np.flatnonzero((component[x:y] != component[x + k]) & (100 * np.minimum(n[x:y], n[x + k]) >= similar * np.maximum(n[x:y], n[x + k])))
                if len(rest):
                    apart = np.bitwise_count(words[rest] ^ words[k]).sum(axis=1, dtype=np.int64)
                    close = apart * (100 + similar) <= sizes[rest] * (100 - similar)
                    near = rest[close]
                    if nearest and len(near) > nearest:
                        near = near[np.argsort(apart[close] / sizes[near], kind="stable")[:nearest]]
                    found.append(np.stack([np.minimum(rep[x + near], rep[x + k]), np.maximum(rep[x + near], rep[x + k])]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.Table.from_batches([rows(schema, pairs[0], pairs[1])])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, n in zip(*(column_of(batch, c).to_pylist() for c in ("sketch_a", "sketch_b", "n"))):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded_sketch(x, size) ^ folded_sketch(y, size)).sum())
                found.append(apart * (100 + similar) <= n * (100 - similar))
            keep = batch.filter(pa.array(found, pa.bool_()))
            yield rows(schema, column_of(keep, "a"), column_of(keep, "b"))

    of_large = (dealt.withColumn("task", F.pmod(F.xxhash64("segment", "low", "high"), F.lit(tasks)))
                .groupBy("task").applyInArrow(compare, schema))
    if nearest:
        return of_large.distinct()
    sketch = lambda x: texts.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}"))
    of_small = (pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "sketch_a", "sketch_b", (F.col("n_a") + F.col("n_b")).alias("n"))
                .mapInArrow(near, schema))
    return of_small.union(of_large).distinct()


def _judged(docs: DataFrame, similar: int) -> DataFrame:
    """doc_id, n, the text's hash, ``node`` (a key of its component; NULL without a set or an id) and component_id of each row."""
    spark = docs.sparkSession
    common, mean = common_shingles(docs)
    buckets = tasks_for(spark, int(docs.count() * mean / 2), BUCKET_ENTRIES)
    both = stored(sets_and_groups(docs, buckets, common, similar), "parity-groups")
    sets = both.where("segment IS NULL").select("doc_id", "n", "c1", "text")
    found = both.where("segment IS NOT NULL").select("segment", "set", "smallest")
    # a set's name is its key; any row that holds it can show its text
    classes = stored(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(F.col("c1").alias("rep")).agg(F.min("doc_id").alias("doc_id")), "parity-classes")
    # a set that by chance shares its short key with another is taken for both; each pair is checked later
    names = stored(classes.select("rep", "doc_id", F.col("rep").bitwiseAND((1 << BITS) - 1).alias("set")), "parity-names")
    groups = stored(found.join(names, "set").select("segment", "rep"), "parity-members")
    best = (found.where("set <> smallest").groupBy("set", "smallest").count().groupBy("set")
            .agg(F.max(F.struct("count", "smallest")).alias("m")).select("set", "m.smallest"))
    first = stored(best.join(names, "set").select("smallest", F.col("rep").alias("a")).join(names.select(F.col("set").alias("smallest"), F.col("rep").alias("b")), "smallest")
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "parity-first")
    texts = stored(texts_with_sets(docs, names.join(groups.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id")), "parity-texts")
    links = stored(checked(first, texts, similar), "parity-links")
    # groups that overlap hold the same sets again and again: the one with most members of each set comes first, and there
    # the nearest sketches only, so that what hangs together does so before all pairs across components are looked at
    sizes = stored(groups.groupBy("segment").agg(F.count("*").alias("n")).where(F.col("n") > SMALL), "parity-sizes")
    chosen = groups.join(sizes, "segment").groupBy("rep").agg(F.max(F.struct("n", "segment")).alias("m")).select("m.segment").distinct()
    near = across(groups.join(stored(chosen, "parity-chosen"), "segment"), components(links, "parity-components"), texts, similar, NEAREST)
    near = stored(near.join(first, ["a", "b"], "left_anti"), "parity-near")
    links, tried = links.union(stored(checked(near, texts, similar), "parity-links")), first.union(near)
    more = stored(across(groups, components(links, "parity-components"), texts, similar).join(tried, ["a", "b"], "left_anti"), "parity-more")
    links = links.union(stored(checked(more, texts, similar), "parity-links"))
    grouped = stored(components(links, "parity-components").join(classes, F.col("node") == F.col("rep")).select("rep", "component", "doc_id"), "parity-linked")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("least"))
    result = stored(classes.join(grouped.join(least, "component").select("rep", "component", "least"), "rep", "left")
                    .select(F.col("rep").alias("c1"), F.coalesce("component", "rep").alias("node"), F.coalesce("least", "doc_id").alias("component_id")), "parity-result")
    own = F.col("n") > 0
    return (sets.join(result, "c1", "left")
            .select("doc_id", "n", "text", F.when(own & F.col("doc_id").isNotNull(), F.col("node")).alias("node"),
                    F.when(F.col("doc_id").isNotNull(), F.when(own, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id")))


def parity_components(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    return _judged(docs, similar).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def kept(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns as they were.

    Of rows of a component that share that id the one whose text hashes lowest stays, and one of rows that are repeated.
    Rows with a NULL id all stay.
    """
    judged = stored(_judged(docs, similar), "parity-judged")
    linked = judged.where("node IS NOT NULL AND doc_id = component_id").groupBy("node", "doc_id").agg(F.min("text").alias("hash")).select("doc_id", "hash")
    alone = judged.where("node IS NULL AND doc_id IS NOT NULL").select("doc_id", F.col("text").alias("hash"))
    wanted, hashed = linked.union(alone).distinct(), docs.withColumn(_free(docs, "hash"), _text_hash())
    name = hashed.columns[-1]
    found = hashed.join(wanted.select(F.col("doc_id"), F.col("hash").alias(name)), ["doc_id", name])
    one = found.groupBy("doc_id", name).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return one.select("row.*").union(docs.where(F.col("doc_id").isNull()))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in docs.columns:
        name += "_"
    return name
