"""Removal of passages that an earlier document already has, by repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it also starts in a
document with a smaller doc_id. Windows are not compared one by one; they are reached through phrases:

1. Winnowing: every window selects one of its phrases of ``PHRASE`` words, that with the smallest hash (the first on
   ties). Equal windows select equal phrases. The windows of a document that select the same phrase are neighbours; their
   words together are a passage.
2. Confirming: a phrase recurs if passages of two documents selected it. A passage that also is one of a smaller document
   is to be removed whole; one that is the first of its kind while its phrase has other kinds is open: some of its windows
   may recur. Phrases are compared as texts, passages by 128-bit BLAKE2 digests of their bytes.
3. Automata: every document streams through an Aho-Corasick automaton of confirmed phrases. The automata are sharded: one
   for each slice of documents, compiled from the confirmed phrases that winnowing has found for documents of that slice,
   so its size follows the slice, however many phrases the corpus has, and no occurrence is missed. A hit gives the place
   of a phrase; there, the bytes are compared with the document's confirmed passages of that phrase. Words are removed, and
   open windows looked at, only around hits: an empty automaton removes nothing.
4. Windows of open passages are compared one by one by their digests: the smallest doc_id of each is an aggregation, never
   a group in one place.

Long texts are surveyed in blocks that overlap by a window, which may split a passage; its windows are then open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_arrays import BLOCK, Words, blocks, raw, slices, values, windows

PHRASE, STREAM = 8, 1 << 18
SURVEY = "doc_id long, passage binary, phrase binary, at int, n int"
LOCATED = "doc_id long, n_words long, sha string, text string, gone binary, places binary, hashes array<binary>"


def digest(words: memoryview) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def selected(phrases: np.ndarray, count: int) -> np.ndarray:
    """For each run of ``count`` entries, by its start: the place of its smallest entry, the first on ties."""
    n = len(phrases) - count + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(phrases)), 1
    while width < count:
        step = min(width, count - width)
        a, b = best[:-step], best[step:]
        best = np.where(phrases[a] <= phrases[b], a, b)
        width += step
    return best[:n]


def passages(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, end and place of the selected phrase of each passage."""
    numbers, different = words.numbers()
    pick = selected(windows(values(different)[numbers], PHRASE), window - PHRASE + 1)
    owner = words.owner()
    whole = owner[window - 1 :] == owner[: len(owner) - window + 1] if len(owner) >= window else np.zeros(0, bool)
    at = np.flatnonzero(whole)  # starts of windows inside one text
    new = np.ones(len(at), bool)
    new[1:] = (pick[at[1:]] != pick[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return owner[at[first]], at[first], at[last] + window, pick[at[first]]


def surveyed(window: int):
    """For mapInArrow: the passages of each document, each once, with their phrase."""

    def found(ids: pa.Array, words: Words) -> pa.RecordBatch:
        seen: set[tuple[int, bytes]] = set()
        rows = []
        for doc, first, end, phrase in zip(*(x.tolist() for x in passages(words, window)), strict=True):
            key = (doc, digest(words.run(first, end)))
            if key not in seen:
                seen.add(key)
                rows.append((*key, bytes(words.run(phrase, phrase + PHRASE)), phrase - first, end - first))
        doc, *columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
        arrays = [ids.take(pa.array(doc, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "passage", "phrase", "at", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, (data, _) = batch.column("doc_id"), raw(batch.column("text"))
            if len(batch) == 1 and len(data) > 2 * BLOCK:
                for part, _ in blocks(data, window - 1):
                    yield found(ids, Words(part))
            else:
                yield found(ids, Words(batch.column("text")))

    return run


def compiled(phrases: Iterable[bytes]) -> ahocorasick.Automaton:
    """The automaton of these phrases, each between blanks; a hit's value is the phrase."""
    out = ahocorasick.Automaton()
    for phrase in phrases:
        out.add_word(f" {phrase.decode('latin-1')} ", phrase)
    if len(out):
        out.make_automaton()
    return out


def hits(automaton: ahocorasick.Automaton, words: Words) -> Iterator[tuple[int, bytes]]:
    """The first word and the text of every occurrence; the words stream through the automaton."""
    if not len(automaton):
        return
    for a in range(0, len(words), STREAM):
        b = min(a + STREAM + PHRASE - 1, len(words))
        base = int(words.starts[a]) - 1
        stream = f" {str(words.run(a, b), 'latin-1')} "
        ends, phrases = list(zip(*automaton.iter(stream), strict=True)) or ((), ())
        last = np.searchsorted(words.ends, np.array(ends, np.int64) + base)
        yield from zip((last - PHRASE + 1).tolist(), phrases, strict=True)


def located(window: int):
    """For mapInArrow: places of each document's confirmed passages: removed words, and open windows with their digests.

    Only documents with any have their text in the result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            confirmed = [x or () for x in batch.column("confirmed").to_pylist()]
            owner, before = words.owner(), words.before.tolist()
            wanted: list[dict[bytes, list[dict]]] = [{} for _ in confirmed]
            for own, found in zip(wanted, confirmed, strict=True):
                for x in found:
                    own.setdefault(x["phrase"], []).append(x)
            gone: list[list[int]] = [[] for _ in confirmed]
            look: list[set[int]] = [set() for _ in confirmed]
            for at, phrase in hits(compiled(set().union(*wanted)), words):
                doc = int(owner[at])
                for x in wanted[doc].get(phrase, ()):
                    first = at - x["at"]
                    end = first + x["n"]
                    if first >= before[doc] and end <= before[doc + 1] and digest(words.run(first, end)) == x["passage"]:
                        if x["removed"]:
                            gone[doc] += (first - before[doc], end - before[doc])
                        else:
                            look[doc].update(range(first - before[doc], end - before[doc] - window + 1))
            rows = []
            for i, text in enumerate(batch.column("text")):
                places = sorted(look[i])
                found = bool(gone[i] or places)
                sha = hashlib.sha256(words.run(before[i], before[i + 1])).hexdigest()
                hashes = [digest(words.run(before[i] + p, before[i] + p + window)) for p in places]
                rows.append((before[i + 1] - before[i], sha, text.as_py() if found else None, np.array(gone[i], np.int64).tobytes(), np.array(places, np.int64).tobytes(), hashes))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "sha", "text", "gone", "places", "hashes"])

    return run


def trimmed(window: int):
    """For mapInArrow: the words that are left of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for i, (gone, places, hashes, hit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("gone", "places", "hashes", "hit")), strict=True)):
                words, hit = Words(batch.column("text").slice(i, 1)), set(hit or ())
                starts = np.frombuffer(places, np.int64)[[h in hit for h in hashes]]
                passed = np.frombuffer(gone, np.int64).reshape(-1, 2)
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, np.concatenate([passed[:, 0], starts]), 1)
                np.add.at(cover, np.concatenate([passed[:, 1], starts + window]), -1)
                keep = np.cumsum(cover[:-1]) == 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                left = b" ".join([words.run(a, b) for a, b in edges.reshape(-1, 2).tolist()])
                out.append((len(words), int((~keep).sum()), hashlib.sha256(left).hexdigest(), left.decode()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), batch.column("text_id")]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text_id"])

    return run


def repeated_passages(documents: DataFrame, window: int = 50) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, kept_text, text_id.

    kept_text is the words that are left, joined by one space, of documents with a confirmed passage, and text_id is the
    SHA-256 of their text; both are null for the others, which lose nothing. Null and empty texts have no words. Rows with
    a null doc_id lose nothing and make no other row lose anything. Rows that share a doc_id are one document for the
    comparison: their windows do not remove each other. A passage that repeats inside one document stays. Further columns
    are ignored; an empty table stays empty.
    """
    scratch = Scratch(documents.sparkSession, "passages")
    texts = documents.select("doc_id", "text")
    met = scratch.cut(texts.where("doc_id is not null").mapInArrow(surveyed(window), SURVEY))
    # A passage decides its phrase, place and length; as keys they need no sorting.
    kinds = met.groupBy("passage", "phrase", "at", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    kinds = scratch.cut(kinds)
    recurring = kinds.groupBy("phrase").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("kinds"))
    recurring = scratch.cut(recurring.where("lo < hi").select("phrase", (F.col("kinds") > 1).alias("open")))
    states = scratch.cut(kinds.join(recurring, "phrase").where("first < last or open").drop("last"))
    found = met.select("doc_id", "passage").join(states, "passage").where("doc_id > first or open")
    each = F.struct("phrase", "at", "n", "passage", (F.col("doc_id") > F.col("first")).alias("removed"))
    wanted = scratch.cut(found.groupBy("doc_id").agg(F.collect_list(each).alias("confirmed")))
    scratch.drop(met, kinds, recurring, states)
    shards = scratch.cut(texts.join(wanted, "doc_id", "left").mapInArrow(located(window), LOCATED))
    scratch.drop(wanted)
    looked = shards.select("doc_id", F.explode("hashes").alias("hash"))
    twice = looked.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    twice = scratch.cut(twice.select("hash", "first"))
    hit = looked.join(twice, "hash").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("hash").alias("hit"))
    some = shards.where("text is not null").join(hit, "doc_id", "left").withColumn("text_id", F.sha2("text", 256))
    changed = some.mapInArrow(trimmed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, text_id string")
    changed = scratch.cut(changed)
    scratch.keep(shards, changed)
    none = [F.lit(None).cast("string").alias(c) for c in ("kept_text", "text_id")]
    rest = shards.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), *none)
    return rest.unionByName(changed)


def without_repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """The documents, without the words that repeated_passages() removes; texts that lose nothing stay as they are.

    A column n_chars, if there is one, is set to the new length of a text that has lost words. A document may be left
    with an empty text.
    """
    found = repeated_passages(documents, window).where("n_removed > 0").select("doc_id", "text_id", "kept_text").dropDuplicates(["doc_id", "text_id"])
    found = found.select(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text"), F.col("kept_text").alias("__kept"))
    out = documents.join(found, (F.col("doc_id") == F.col("__doc")) & (F.sha2("text", 256) == F.col("__text")), "left")
    new = {"text": F.coalesce("__kept", "text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.coalesce(F.length("__kept").cast(documents.schema["n_chars"].dataType), "n_chars")
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns))
