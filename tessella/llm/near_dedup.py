"""Near-duplicate documents by MinHash, banding, verification and connected components.

1. A document is the set of its distinct word shingles. ``BANDS * ROWS`` universal hash functions (a * x + b modulo 2**64,
   a odd) give its minima. Every ``ROWS`` of them make a band; one bit of each makes its signature.
2. Documents with the same words (by SHA-256) are one class, of which only the smallest doc_id goes on; of classes whose
   sets turn out equal, only the first. So thousands of copies cost one row each and are never paired.
3. Classes that agree in a band share a bucket. All members of a bucket are compared with its smallest doc_id, a linear
   number of pairs. After linking, only members in different components are still apart: in a bucket of up to ``SMALL``
   classes, all pairs that are apart are compared. Larger buckets that hold several components are gathered into clusters
   of buckets that share members; there, everything outside the largest component is compared with the whole cluster, in
   blocks that are bounded in rows and in shingles, and only links leave a block. So no pair of a bucket is skipped unless
   its two ends are already connected, and no group is expanded into its pairs.
4. A pair made by a join goes on if its sizes allow the threshold and its signatures agree in enough bits (six standard
   deviations below what the threshold gives), as a condition of the join itself. Then the texts of both decide: their
   shingles are compared as exact numbers of words, in integers, never by hashes.
5. Components come from alternating large-star and small-star.

With 42 bands of 6 rows, a pair at similarity 0.8 shares no bucket with a probability of 3e-6, at 0.85 of 1e-9. More rows
to a band (parameters of near_duplicates) keep chance meetings rare in a larger corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, contracted
from .scratch import Scratch
from .text_arrays import BLOCK, U, Words, blocks, mix, raw, shingle_keys, slices, values, windows

BANDS, ROWS, SMALL, LONG = 42, 6, 64, 1 << 24
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 19
_rng = np.random.default_rng(1234567)
FACTORS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
SHIFTS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2)


def shingle_values(texts: pa.Array, size: int) -> list[np.ndarray]:
    """A 64-bit value of each distinct shingle of each text, A-Z taken as a-z; fewer words than a shingle make one.

    Shingles are told apart by exact numbers of their words. Only a text of several blocks is put together by the values.
    """
    data, at = raw(texts)
    if len(texts) == 1 and len(data) > 2 * BLOCK:
        # A later block of fewer words than a shingle adds none: they are at the end of the block before.
        words = (Words(part, lower=True) for part, _ in blocks(data, size - 1))
        parts = [values_of(w, size)[0] for k, w in enumerate(words) if not k or len(w) >= size]
        return [np.unique(np.concatenate(parts))]
    return values_of(Words(texts, lower=True), size)


def values_of(words: Words, size: int) -> list[np.ndarray]:
    numbers, different = words.numbers()
    rolled = windows(values(different)[numbers], size)
    keys = shingle_keys(numbers, len(different), size)
    out = []
    for a, b in zip(words.before[:-1].tolist(), words.before[1:].tolist(), strict=True):
        if b - a >= size:
            _, first = np.unique(keys[a : b - size + 1], return_index=True)
            out.append(rolled[a + first])
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(words.run(a, b), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(items: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    best = None
    for at in range(0, len(items), 1024):
        values = np.multiply.outer(FACTORS, items[at : at + 1024])
        values += SHIFTS[:, None]
        least = values.min(axis=1)
        best = least if best is None else np.minimum(best, least)
    return best


def signatures(size: int):
    """For mapInArrow: digest of the words, size, hash, bands and signature bits of each document's shingle set."""
    words_of_bits = -(-BANDS * ROWS // 64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            sets = shingle_values(texts, size)
            words = Words(texts, lower=True)
            digests = [hashlib.sha256(words.run(a, b)).digest() for a, b in zip(words.before[:-1], words.before[1:], strict=True)]
            least = np.zeros((len(sets), BANDS * ROWS), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    least[i] = minima(s)
            rows = mix(least).reshape(len(sets), BANDS, ROWS)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands + rows[:, :, r])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            bits = np.zeros((len(sets), words_of_bits * 64), np.uint8)
            bits[:, : BANDS * ROWS] = (least >> U(40)) & U(1)
            packed = np.packbits(bits, axis=1).view(np.int64)
            whole = np.array([np.bitwise_xor.reduce(mix(s)) ^ np.add.reduce(mix(s ^ U(0x5BD1E995))) if len(s) else 0 for s in sets], np.uint64)
            at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            columns = [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(mix(whole).view(np.int64)),
                pa.ListArray.from_arrays(at, pa.array(bands.view(np.int64).ravel())),
                *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(words_of_bits)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "words_id", "set_id", "bands", *(f"s{i}" for i in range(words_of_bits))])

    return run


def exact_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted, as numbers that are equal for equal shingles of any of these texts.

    The numbers stand for words that were compared byte by byte. Only texts of more than ``LONG`` bytes together are
    represented by 128-bit digests of their shingles instead, so that memory stays in bounds.
    """
    data, at = raw(texts)
    if len(data) > LONG:
        return [long_set(data[a:b], size) for a, b in zip(at[:-1], at[1:], strict=True)]
    words = Words(texts, lower=True)
    numbers, different = words.numbers()
    keys = shingle_keys(numbers, len(different), size)
    out = []
    for a, b in zip(words.before[:-1].tolist(), words.before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(keys[a : b - size + 1]))
        else:  # shorter than a shingle: below all keys, and equal for the same words only
            out.append(np.array([-1 - int.from_bytes(hashlib.sha256(words.run(a, b)).digest()[:7])][: b - a], np.int64))
    return out


def long_set(data: np.ndarray, size: int) -> np.ndarray:
    """The set of one text, by 128-bit digests of its shingles."""
    parts = []
    for k, (part, _) in enumerate(blocks(data, size - 1)):
        words = Words(part, lower=True)
        count = len(words)
        starts = range(count - size + 1) if count >= size else range(0 if k else bool(count))
        digests = {hashlib.blake2b(words.run(i, min(i + size, count)), digest_size=16).digest() for i in starts}
        parts.append(np.frombuffer(b"".join(digests), np.dtype([("a", "<u8"), ("b", "<u8")])))
    return np.unique(np.concatenate(parts))


def confirmed(percent: int, size: int):
    """For mapInArrow: pairs of texts with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_u", "text_v", most=1 << 22):
            both = pa.concat_arrays([batch.column("text_u"), batch.column("text_v")]).dictionary_encode()
            sets = exact_sets(both.dictionary, size)
            which, n = np.asarray(both.indices), len(batch)
            keep = [similar(sets[i], sets[j], percent) for i, j in zip(which[:n].tolist(), which[n:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked_across(percent: int, size: int):
    """For applyInPandas: of two blocks, a link of each row of the first to each other component of the second, if any."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = rows[rows["asks"]], rows[~rows["asks"]]
        out: list[tuple[int, int]] = []
        if len(ours) and len(theirs):
            sets = exact_sets(pa.array([*ours["text"], *theirs["text"]], pa.large_string()), size)
            sizes = np.array([len(s) for s in sets])
            _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            n, first = len(ours), int(starts[len(ours)])
            marks = np.zeros(numbers.max() + 1, np.int32)
            components, names = theirs["component"].to_numpy(), theirs["rep"].to_numpy()
            for i, (rep, component) in enumerate(zip(ours["rep"], ours["component"], strict=True)):
                own = numbers[starts[i] : starts[i] + sizes[i]]
                marks[own] = 1
                both = np.add.reduceat(marks[numbers[first:]], starts[n:] - first)
                marks[own] = 0
                near = np.flatnonzero((100 * both >= percent * (sizes[i] + sizes[n:] - both)) & (components != component))
                _, one = np.unique(components[near], return_index=True)
                out += [(int(rep), int(names[j])) for j in near[one]]
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def across(many: DataFrame, texts_of: Callable[[DataFrame], DataFrame], scratch: Scratch, size: int, percent: int, block: int, shingles: int) -> DataFrame:
    """Links between members of different components in large buckets; no pair leaves a block unless it is a link.

    Buckets that share members form a cluster, so that a class which is in many of them is compared once. What is outside
    a cluster's largest component is dealt into blocks, and so is the whole cluster; blocks hold about ``block`` rows and
    ``shingles`` shingles each, and every two of them meet in a task.
    """
    clusters = scratch.cut(components(many.select(F.col("rep").alias("u"), F.col("hub").alias("v")), scratch))
    rows = many.select("rep", "component", "n").distinct().join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    rows = scratch.cut(rows)
    counts = rows.groupBy("cluster", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).groupBy("cluster")
    counts = counts.agg(F.max(F.struct("rows", "component", "n")).alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))

    def parts(rows_: Column, n: Column, name: str) -> Column:
        return F.greatest(F.ceil(rows_ / block), F.ceil(n / shingles)).cast("int").alias(name)

    asking = parts(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n"), "asking")
    counts = counts.select("cluster", F.col("top.component").alias("largest"), asking, parts(F.col("rows"), F.col("n"), "asked"))
    rows = rows.join(scratch.cut(counts.where("asking > 0")), "cluster")
    rows = scratch.cut(rows.join(texts_of(rows.select("rep").distinct()), "rep"))
    own, other = (F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(of)).cast("int") for salt, of in ((0, "asking"), (1, "asked")))
    kept = ["rep", "component", "text"]
    ask = rows.where("component <> largest").select("cluster", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"), F.lit(True).alias("asks"), *kept)
    answer = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), other.alias("j"), F.lit(False).alias("asks"), *kept)
    return ask.unionByName(answer).groupBy("cluster", "i", "j").applyInPandas(linked_across(percent, size), "u long, v long")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK_ROWS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Documents are linked if the sets of their ``size``-word shingles have a Jaccard similarity of percent / 100 or more;
    component_id is the smallest doc_id reachable by links. Texts without words, null texts and null doc_ids are linked
    with nothing; a null doc_id has a null component and is kept. Rows that share a doc_id are one node: if their texts
    differ, it joins the groups of all. Ties cannot occur; further columns are ignored; an empty table stays empty.
    """
    scratch = Scratch(documents.sparkSession, "near")
    texts = documents.select("doc_id", "text")
    sketch = [f"s{i}" for i in range(-(-BANDS * ROWS // 64))]
    kinds = "doc_id long, n_shingles long, words_id binary, set_id long, bands array<long>, " + ", ".join(f"{c} long" for c in sketch)
    sigs = scratch.cut(texts.mapInArrow(signatures(size), kinds))
    real = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.cut(real.groupBy("words_id").agg(F.min("doc_id").alias("rep")))
    docs = scratch.cut(real.select("doc_id", "words_id").join(classes, "words_id").select("doc_id", "rep").distinct())
    firsts = real.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "words_id"], "left_semi").dropDuplicates(["rep", "words_id"])
    firsts = scratch.cut(firsts.select("rep", F.col("n_shingles").alias("n"), "set_id", "bands", *sketch))

    known = None

    def texts_of(ids: DataFrame) -> DataFrame:
        """The texts of at least these classes; each is looked up once."""
        nonlocal known
        ids = scratch.cut(ids if known is None else ids.join(known, "rep", "left_anti"))
        if known is None or not ids.isEmpty():
            found = texts.join(ids, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
            more = scratch.cut(found.dropDuplicates(["rep", "text"]))
            known = more if known is None else known.unionByName(more)
        return known

    def links(pairs: DataFrame, least: int = percent) -> DataFrame:
        """Those of the pairs that meet the threshold."""
        near = scratch.cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        own = texts_of(near.select(F.explode(F.array("u", "v")).alias("rep")).distinct())
        for end in ("u", "v"):
            near = near.join(own.select(F.col("rep").alias(end), F.col("text").alias(f"text_{end}")), end)
        return near.mapInArrow(confirmed(least, size), "u long, v long")

    # Classes whose sets are equal: only the first goes on.
    groups = firsts.groupBy("set_id", "n").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").drop("last")
    twins = scratch.cut(links(firsts.select("set_id", "n", F.col("rep").alias("u")).join(scratch.cut(groups), ["set_id", "n"]).where("u <> v"), 100))
    reps = scratch.cut(firsts.drop("set_id").join(twins.select(F.greatest("u", "v").alias("rep")).distinct(), "rep", "left_anti"))
    bands = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = scratch.cut(bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    met = scratch.cut(bands.join(shared.select("bucket"), "bucket"))
    members = scratch.cut(met.join(reps.select("rep", "n", *sketch), "rep"))

    differ = " + ".join(f"bit_count(u{c} ^ v{c})" for c in sketch)
    share = (1 - percent / 100) / 2
    most = BANDS * ROWS * share + 6 * (BANDS * ROWS * share * (1 - share)) ** 0.5
    possible = f"100 * least(un, vn) >= {percent} * greatest(un, vn) and {differ} <= {int(most)}"

    def side(frame: DataFrame, x: str, *keys: str) -> DataFrame:
        return frame.select(*keys, F.col("rep").alias(x), *(F.col(c).alias(f"{x}{c}") for c in ("n", *sketch, "component") if c in frame.columns))

    # Rows that share a doc_id but not their words join their classes.
    several = scratch.cut(docs.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi"))
    edges = docs.join(several, "doc_id").select(F.col("rep").alias("u"), F.col("lo").alias("v")).unionByName(twins)
    hub = scratch.cut(members.groupBy("bucket").agg(F.min("rep").alias("rep")).join(reps.select("rep", "n", *sketch), "rep"))
    star = side(members, "u", "bucket").join(side(hub, "v", "bucket"), "bucket").where(f"u <> v and {possible}")
    # Two rounds connect nearly all that one hub links; who is told apart wrongly is only compared once more.
    linked = contracted(edges.unionByName(links(star.select("u", "v"))), scratch, rounds=2)
    comp = scratch.cut(linked.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("component")))

    now = scratch.cut(members.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    apart = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.min("rep").alias("hub"))
    still = scratch.cut(now.join(scratch.cut(apart.where("lo < hi").select("bucket", "members", "hub")), "bucket"))
    few, many = still.where(F.col("members") <= SMALL), still.where(F.col("members") > SMALL)
    pairs = side(few, "u", "bucket").join(side(few, "v", "bucket"), "bucket").where(f"u < v and ucomponent <> vcomponent and {possible}")
    edges = linked.unionByName(links(pairs.select("u", "v")))
    if not many.isEmpty():
        edges = edges.unionByName(across(many, texts_of, scratch, size, percent, block, shingles))
    comp = scratch.cut(components(edges, scratch))
    placed = docs.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    placed = scratch.cut(placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    scratch.keep(sigs, placed)
    out = sigs.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
