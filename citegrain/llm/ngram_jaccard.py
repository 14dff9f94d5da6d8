"""N-gram Jaccard join with grouped prefixes.

A text is the set of its distinct five-word shingles (fewer words: the whole sequence as one).
Texts of equal sets are one class, kept by the digest of the set. Shingles have one global order:
by how often their slot of a counting sketch occurs in all texts, then by hash; its rarest first
shingles, a fifth of the set, are the prefix, and two sets that are similar enough share a
shingle there. Classes of equal prefix and size form one group; an inverted index of group
prefixes gives the group pairs, which size and position bounds filter; only those are expanded to
members and verified on the whole sets.

Links are needed up to components. So the groups of a posting are first verified against the one
whose shared shingle comes earliest; after joining the links found, only members that are still in
another component than that one are compared with the rest. No link between components is lost,
and a posting of copies stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import (
    arrow_pass, bitmap, bounded_batches, components, document_key, free_arrow, grams, in_bitmap, joined, mix, narrow, parts_of, signed, stored,
    texts_of, word_hashes,
)

WORDS = 5
SKETCH = 18
LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts and the text of each, sorted by text, then hash."""
    data, offsets = joined([t.encode().translate(LOWER) for t in texts])
    starts, _, words = word_hashes(data)
    owner = np.searchsorted(offsets, starts, "right") - 1
    found, at = grams(words, owner, WORDS)
    owners = owner[at]
    sizes = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    for n in range(1, WORDS):
        rows = np.flatnonzero(sizes == n)
        whole = words[first[rows][:, None] + np.arange(n)]
        total = np.full(len(rows), n, np.uint64)
        for k in range(n):
            total = mix(total + whole[:, k])
        found, owners = np.concatenate((found, total)), np.concatenate((owners, rows))
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    return found[fresh], owners[fresh]


def slot_counts(documents: DataFrame) -> np.ndarray:
    """How many (text, shingle) pairs of all texts fall in each of 2**SKETCH slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for part in parts_of(batch):
                found, _ = shingle_sets(texts_of(part.column("text")))
                counts += np.bincount(_slot(found), minlength=1 << SKETCH)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(counts[slot])], ["slot", "n"])

    bounded_batches(documents.sparkSession)
    rows = documents.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    del rows
    free_arrow()
    return counts


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64((1 << SKETCH) - 1)).astype(np.int64)


def signatures(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, doc_key, n, cid, gkey, row_key, prefix) of every text; cid and gkey are null for empty sets."""
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = shingle_sets(texts_of(batch.column("text")))
        order = np.lexsort((found, shared.value[_slot(found)], owner))
        found, rows = found[order], batch.num_rows
        sizes = np.bincount(owner, minlength=rows)
        first = np.concatenate(([0], np.cumsum(sizes)))
        prefix = sizes - (4 * sizes + 4) // 5 + (sizes > 0)
        head = np.arange(len(found)) - first[owner] < prefix[owner]
        digest = _digests(found, first, sizes)
        cuts = np.concatenate(([0], np.cumsum(prefix)))
        group = mix(_digests(found[head], cuts, prefix) + sizes.astype(np.uint64))
        empty = sizes == 0
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("doc_key"), pa.array(sizes.astype(np.int64)),
             pa.array(digest.view(np.int64), mask=empty), pa.array(group.view(np.int64), mask=empty),
             signed(_row_keys(digest, batch.column("doc_key"))), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), signed(found[head]))],
            ["doc_id", "doc_key", "n", "cid", "gkey", "row_key", "prefix"],
        )

    return arrow_pass(
        documents, step,
        f"doc_id {dict(documents.dtypes)['doc_id']}, doc_key long, n long, cid long, gkey long, row_key long, prefix array<long>",
    )


def _digests(found: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever its order."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(found))))
    return mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64))


def class_sets(documents: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """(cid, n, shingles, marks, left, right) of the rows whose class and row the bitmaps let through.

    marks are the distinct last 16 bits of the shingles.

    The bitmaps hold one row of each class of a side. They may let others through: a copy, whose
    pairs then come twice, or another class, which no pair names.
    """
    shared = documents.sparkSession.sparkContext.broadcast((left, right))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = shingle_sets(texts_of(batch.column("text")))
        sizes = np.bincount(owner, minlength=batch.num_rows)
        first = np.concatenate(([0], np.cumsum(sizes)))
        digest = _digests(found, first, sizes)
        keys = _row_keys(digest, batch.column("doc_key"))
        sides = [in_bitmap(words, keys) & (sizes > 0) for words in shared.value]
        rows = np.flatnonzero(sides[0] | sides[1])
        cuts = np.concatenate(([0], np.cumsum(sizes[rows])))
        found = found[np.repeat(first[rows] - cuts[:-1], sizes[rows]) + np.arange(cuts[-1])]
        marks = np.unique(np.repeat(np.arange(len(rows)) << 16, sizes[rows]) | (found & np.uint64(0xFFFF)).astype(np.int64))
        ends = np.searchsorted(marks, np.arange(len(rows) + 1) << 16)
        return pa.RecordBatch.from_arrays(
            [signed(digest[rows]), pa.array(sizes[rows].astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), signed(found)),
             pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(marks.astype(np.uint16).view(np.int16))),
             *(pa.array(side[rows]) for side in sides)],
            ["cid", "n", "shingles", "marks", "left", "right"],
        )

    return arrow_pass(
        documents.select("text", "doc_key"), step,
        "cid long, n int, shingles array<long>, marks array<short>, left boolean, right boolean",
    )


def postings(reps: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(token, gid, n, at) of every prefix shingle of the groups, of those the bitmap lets through."""
    shared = reps.sparkSession.sparkContext.broadcast(wanted)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("prefix")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        token, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = slice(None) if shared.value is None else in_bitmap(shared.value, token.view(np.uint64))
        rows = pa.array(row[keep])
        return pa.RecordBatch.from_arrays(
            [pa.array(token[keep]), batch.column("gid").take(rows), batch.column("n").take(rows),
             pa.array(at[keep].astype(np.int32))],
            ["token", "gid", "n", "at"],
        )

    return arrow_pass(reps.select("gid", "n", "prefix"), step, "token long, gid long, n long, at int")


def may_link(n: Column, at: Column, m: Column, there: Column) -> Column:
    """Sizes and the places of a first common shingle that still allow a similarity of 0.8."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - at, m - there) >= 4 * (n + m))


def linked(pairs: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, by exact intersection.

    `rows` gives (cid, row_key) of one row for each class. Marks come first: they are a quarter of
    the size, and common marks plus those a set lost to itself are never fewer than the common
    shingles, so only pairs that may be similar fetch their whole sets.
    """
    sides = [
        bitmap(pairs.select(F.col(c).alias("cid")).distinct().join(rows, "cid"), "row_key", 26) for c in ("a", "b")
    ]
    sets = stored(class_sets(documents, *sides))
    near = _side(sets, "left", "a", "marks").join(narrow(pairs), "a").join(_side(sets, "right", "b", "marks"), "b")
    lost = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    near = stored(_similar(near.withColumn("i", F.size(F.array_intersect("sa", "sb")) + lost)))
    wanted = narrow(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    few = sets.join(wanted, "cid", "left_semi")
    both = _side(few, "left", "a", "shingles").join(narrow(near), "a").join(_side(few, "right", "b", "shingles"), "b")
    return stored(_similar(both.withColumn("i", F.size(F.array_intersect("sa", "sb")))))


def _side(sets: DataFrame, side: str, name: str, kind: str) -> DataFrame:
    return sets.where(side).select(F.col("cid").alias(name), F.col("n").alias(f"n{name}"), F.col(kind).alias(f"s{name}"))


def _similar(pairs: DataFrame) -> DataFrame:
    shares = pairs.select("a", "b", "i", (F.col("na") + F.col("nb")).alias("t"))
    return shares.where("100 * i >= 80 * (t - i)").select("a", "b")


def class_roots(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, root) of the classes that are linked with others."""
    classes = stored(
        rows.where("n > 0").groupBy("cid")
        .agg(F.min("gkey").alias("gkey"), F.min("row_key").alias("row_key"))
    )
    row_keys = classes.select("cid", "row_key")
    reps = stored(
        rows.where("n > 0").groupBy("gkey").agg(F.min_by(F.struct("cid", "n", "prefix"), "cid").alias("rep"))
        .select("gkey", F.col("rep.cid").alias("gid"), "rep.n", "rep.prefix")
    )
    members = stored(
        classes.join(reps.select("gkey", "gid"), "gkey").where("cid <> gid").select("gid", "cid")
    )
    counted = postings(reps).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = stored(counted)
    met = postings(reps, bitmap(shared, "token", 26)).join(shared, "token")
    centres = met.groupBy("token").agg(F.min(F.struct("at", "n", "gid")).alias("c")).select(
        "token", F.col("c.gid").alias("centre"), F.col("c.n").alias("cn"), F.col("c.at").alias("cat")
    )
    # no partner in the posting stands before the centre, which bounds what a row can reach
    busy = stored(met.join(centres, "token").where("5 * at + 4 * cat <= n"))
    near = may_link(F.col("n"), F.col("at"), F.col("cn"), F.col("cat"))
    pairs = stored(
        busy.where((F.col("gid") != F.col("centre")) & near)
        .select(F.col("centre").alias("a"), F.col("gid").alias("b"))
        .union(members.select("gid", "cid")).distinct()
    )
    links = linked(pairs, row_keys, documents)
    roots = stored(components(links))
    done = pairs.union(pairs.select("b", "a"))
    rest = stored(_rest(busy, members, roots).join(done, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return roots
    return components(links.union(linked(rest, row_keys, documents)))


def _rest(busy: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share a posting or a group.

    Groups outside `known` are one class in a component of its own.
    """
    own = members.join(roots.toDF("cid", "root"), "cid", "left").select("gid", "cid", F.coalesce("root", "cid").alias("root"))
    lone = members.select("gid").distinct().join(roots.toDF("gid", "root"), "gid", "left_anti")
    known = stored(
        own.union(lone.select("gid", "gid", "gid"))
        .union(roots.select("node", "node", "root"))
    )
    bounds = stored(known.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")))
    of_centre = bounds.toDF("centre", "clo", "chi")
    labelled = (
        busy.select("token", "gid", "n", "at", "centre").join(bounds, "gid", "left").join(of_centre, "centre", "left")
        .select(
            "token", "gid", "n", "at", *(F.coalesce(c, "gid").alias(c) for c in ("lo", "hi")),
            *(F.coalesce(c, "centre").alias(c) for c in ("clo", "chi")),
        )
    )
    labelled = stored(labelled)
    apart = labelled.where("not (lo = hi and hi = clo and clo = chi)").select(
        "token", *(F.col(c).alias(f"x_{c}") for c in ("gid", "n", "at", "lo", "hi"))
    )
    met = (
        apart.join(labelled.drop("clo", "chi"), "token")
        .where(may_link(F.col("n"), F.col("at"), F.col("x_n"), F.col("x_at")))
        .where("gid <> x_gid and not (lo = x_hi and hi = x_lo)")
        .select(F.least("gid", "x_gid").alias("g"), F.greatest("gid", "x_gid").alias("h")).distinct()
    )
    met = stored(met)
    ends = met.select(F.explode(F.array("g", "h")).alias("gid")).distinct()
    whole = stored(
        known.join(ends, "gid", "left_semi").union(
            ends.join(known, "gid", "left_anti").select("gid", "gid", "gid")
        )
    )
    across = met.join(whole.toDF("g", "a", "ra"), "g").join(whole.toDF("h", "b", "rb"), "h").where("ra <> rb")
    mixed = known.join(bounds.where("lo <> hi"), "gid")
    strays = mixed.where("root <> lo").select("gid", F.col("cid").alias("a"), F.col("root").alias("ra"))
    inside = strays.join(mixed.select("gid", F.col("cid").alias("b"), F.col("root").alias("rb")), "gid").where("ra <> rb")
    pairs = across.select("a", "b").union(inside.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _row_keys(digest: np.ndarray, doc_key: pa.Array) -> np.ndarray:
    """Hash of a row's class together with the row."""
    return digest ^ mix(doc_key.to_numpy().view(np.uint64))


def _slim(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", document_key(F.col("text"), F.col("doc_id")).alias("doc_key"))


def _rooted(documents: DataFrame) -> DataFrame:
    """(doc_id, doc_key, n, root) of every row; root is null for empty sets."""
    slim = _slim(documents)
    rows = stored(signatures(slim, slot_counts(slim)))
    roots = class_roots(rows, slim).toDF("cid", "linked")
    return stored(
        rows.select("doc_id", "doc_key", "n", "cid").join(roots, "cid", "left")
        .select("doc_id", "doc_key", "n", F.coalesce("linked", "cid").alias("root"))
    )


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A text that is null or has no words has no shingles and is its own component. component_id is
    the smallest doc_id of the component; rows without doc_id join components but do not name
    them. Repeated rows are in one component, as are different rows of one doc_id only if linked.
    """
    rows = _rooted(documents)
    named = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(named, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents of which one stays for each component, with all their columns.

    The row of the smallest doc_id stays, rows without doc_id last; a repeated row stays once.
    Texts without words are no copies of anything and all stay.
    """
    rows = _rooted(documents)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "doc_key")
    kept = (
        rows.where("root is not null").groupBy("root", "doc_id", "doc_key").agg(F.count("*").alias("times"))
        .groupBy("root").agg(F.min(F.struct(order.alias("o"), "times")).alias("k"))
        .select(F.col("k.o.doc_id").alias("_citegrain_id"), F.col("k.o.doc_key").alias("_citegrain_key"), F.col("k.times").alias("_citegrain_times"))
    )
    empty = rows.where("root is null").select("doc_id", "doc_key").distinct()
    kept = stored(kept.union(empty.select("doc_id", "doc_key", F.lit(1).cast("long"))))
    key = document_key(documents["text"], documents["doc_id"])
    found = documents.join(kept, documents["doc_id"].eqNullSafe(kept["_citegrain_id"]) & (key == kept["_citegrain_key"]))
    once = found.where("_citegrain_times = 1")
    if not kept.where("_citegrain_times > 1").isEmpty():
        once = once.union(found.where("_citegrain_times > 1").dropDuplicates(["_citegrain_id", "_citegrain_key"]))
    return once.drop("_citegrain_id", "_citegrain_key", "_citegrain_times")


def oracle_sql() -> str:
    """The same components in SQL, by all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE spelt AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM spelt
), shingles AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN sets m ON m.doc_id = c.a JOIN sets n ON n.doc_id = c.b
  WHERE 100 * i >= 80 * (len(m.s) + len(n.s) - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
