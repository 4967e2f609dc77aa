"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find grouping.

1. One pass over the texts gives each document its shingle count, a 128-bit fingerprint of its shingle set and its band
   hashes. Documents of equal sets form a class, which goes on under a number of its own with one text; so an id that stands with
   several texts is several members.
2. Classes that share a band hash are candidates. Each is verified against the bucket's first class; links found so give
   first components. Most buckets then lie in one component and need nothing more.
3. In a bucket of several components every pair across components is verified, in blocks: members outside the bucket's
   largest component against all members. Pairs inside one component are never formed, so a group of copies costs no more
   than its size, and no partner is left out.
4. The components of all links are the groups.

Banding finds a pair of similarity s with probability 1 - (1 - s**rows)**bands: all but about one in a hundred thousand at
the threshold with five rows and twenty bands for 0.85, or four rows and twenty-five bands for 0.8, and more above it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_rows, give_back, materialize, may_be_among
from pageloom.llm.components import UnionFind, components
from pageloom.llm.minhash import bands, shingle_sets, signatures
from pageloom.llm.words import chunks, mix, words

SLOTS = 100
#: Members of one block of a bucket that is verified pair by pair.
BLOCK = 512
#: Bytes of text sketched at once: every shingle holds a permutation of the slots.
SKETCHED_BYTES = 1 << 19

_SKETCH = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>"


def _prints(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """Shingle sets of a batch's texts (values, row offsets), their sizes, and a 128-bit fingerprint of each set."""
    values, first = shingle_sets(words(part.column("text"), lower=True), k)
    total = np.zeros((2, len(values) + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate((11, 12)):
            np.cumsum(mix(values, seed), out=total[i, 1:])
        f1, f2 = (total[:, first[1:]] - total[:, first[:-1]]).view(np.int64)
    return values, first, np.diff(first).astype(np.int64), f1, f2


def sketches(docs: DataFrame, k: int, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, set fingerprint (f1, f2), band hashes (empty for an empty set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part in chunks(batch, "text", SKETCHED_BYTES):
            values, first, n, f1, f2 = _prints(part, k)
            full = n > 0
            found = bands(signatures(values, first, SLOTS), rows)
            ends = np.concatenate([[0], np.cumsum(np.where(full, found.shape[1], 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[full].reshape(-1)))
            out.append((part.column("key"), pa.array(n), pa.array(f1), pa.array(f2), lists))
        return {
            name: pa.concat_arrays([x[i] for x in out])
            for i, name in enumerate(("doc_id", "n_shingles", "f1", "f2", "bands"))
        } if out else None

    return by_rows(docs.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text"), run, _SKETCH)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batch: pa.RecordBatch) -> dict:
        a_out, b_out = [], []
        for part in chunks(batch, "text_a"):
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            _, once, at = np.unique(b, return_index=True, return_inverse=True)
            va, fa = shingle_sets(words(part.column("text_a"), True), k)
            vb, fb = shingle_sets(words(part.column("text_b").take(pa.array(once)), True), k)
            good = np.fromiter((_similar(va[fa[i] : fa[i + 1]], vb[fb[j] : fb[j + 1]], percent) for i, j in enumerate(at)), bool, len(a))
            a_out.append(a[good])
            b_out.append(b[good])
        return {"a": np.concatenate(a_out) if a_out else [], "b": np.concatenate(b_out) if b_out else []}

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    # One centre's pairs lie together; equal texts of one id and batch are taken once.
    return by_rows(joined, run, "a bigint, b bigint")


def _cells(members: DataFrame) -> DataFrame:
    """Block pairs (i, k) of each member: i counts blocks outside the largest component, k all blocks."""
    minor, major, own = F.col("minor_blocks"), F.col("major_blocks"), F.col("own")
    as_left = F.transform(F.sequence(own, minor + major - 1), lambda x: F.struct(own.alias("i"), x.alias("k"), F.lit(True).alias("left")))
    as_right = F.when(
        own > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), own - 1), lambda x: F.struct(x.alias("i"), own.alias("k"), F.lit(False).alias("left")))
    ).otherwise(F.array().cast("array<struct<i:bigint,k:bigint,left:boolean>>"))
    of_major = F.transform(F.sequence(F.lit(0).cast("bigint"), minor - 1), lambda x: F.struct(x.alias("i"), (minor + own).alias("k"), F.lit(False).alias("left")))
    return members.withColumn("cell", F.explode(F.when(F.col("is_major"), of_major).otherwise(F.concat(as_left, as_right)))).select(
        "band", "h", "cell.i", "cell.k", "cell.left", "doc", "label"
    )


def _cell_links(table: pa.Table, k: int, percent: int) -> pa.Table:
    """Links across components inside one block pair of a bucket; of links that join the same sets, one."""
    give_back()
    part = table.combine_chunks()
    text = part.column("text")
    doc, label, left = (part.column(c).to_numpy() for c in ("doc", "label", "left"))
    same = part.column("i")[0].as_py() == part.column("k")[0].as_py()
    band = part.column("band")[0].as_py()
    hashes = np.stack(part.column("bands").to_numpy())
    values, first = shingle_sets(words(text, True), k)
    sizes = np.diff(first)
    _, place = np.unique(values, return_inverse=True)
    _, component = np.unique(label, return_inverse=True)
    sets = UnionFind(int(component.max()) + 1)
    flag = np.zeros(int(place.max()) + 1, dtype=bool)
    out_a, out_b = [], []
    right = np.flatnonzero(~left) if not same else np.flatnonzero(left)
    for x in np.flatnonzero(left):
        others = right[right > x] if same else right
        n, m = sizes[x], sizes[others]
        fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (component[others] != component[x])
        others = others[fits]
        if band and len(others):  # met before in a lower band
            others = others[~(hashes[others, :band] == hashes[x, :band]).any(axis=1)]
        if not len(others):
            continue
        flag[place[first[x] : first[x + 1]]] = True
        for y in others:
            if sets.find(component[x]) == sets.find(component[y]):
                continue
            both = int(np.count_nonzero(flag[place[first[y] : first[y + 1]]]))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                sets.union(component[x], component[y])
                out_a.append(doc[x])
                out_b.append(doc[y])
        flag[place[first[x] : first[x + 1]]] = False
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


_SAME = ["n_shingles", "f1", "f2"]


def _several(found: DataFrame) -> DataFrame:
    """Ids that stand with more than one set: (doc_id)."""
    own = found.filter("doc_id is not null").groupBy("doc_id")
    return own.agg(*[F.min(F.struct(*_SAME)).alias("a"), F.max(F.struct(*_SAME)).alias("b")]).filter("a <> b").select("doc_id")


def _with_prints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) with the size and fingerprint of each text's set."""

    def run(batch: pa.RecordBatch) -> dict | None:
        made = [(part.column("doc_id"), part.column("text"), *map(pa.array, _prints(part, k)[2:])) for part in chunks(batch, "text")]
        return {name: pa.concat_arrays([x[i] for x in made]) for i, name in enumerate(("doc_id", "text", *_SAME))} if made else None

    return by_rows(docs.select("doc_id", "text"), run, "doc_id bigint, text string, n_shingles bigint, f1 bigint, f2 bigint")


def _texts(docs: DataFrame, wanted: DataFrame, several: DataFrame, k: int) -> DataFrame:
    """(doc_id, text): a text for each wanted class, (doc_id: its number, rep: the id it stands under, its set).

    Only an id with several sets needs the sets of its texts computed again.
    """
    known = wanted.join(several.withColumnRenamed("doc_id", "rep").withColumn("_several", F.lit(True)), "rep", "left")
    known = materialize(known.select("rep", "_several", *_SAME, F.col("doc_id").alias("number")))
    held = docs.filter(may_be_among(known.select("rep"))(F.col("doc_id"))).withColumnRenamed("doc_id", "rep")
    plain = held.join(known.filter("_several is null").select("rep", "number"), "rep").select(F.col("number").alias("doc_id"), "text")
    unsure = known.filter("_several")
    if unsure.isEmpty():
        return materialize(plain)
    printed = _with_prints(held.join(unsure.select("rep").distinct(), "rep").select(F.col("rep").alias("doc_id"), "text"), k)
    odd = printed.withColumnRenamed("doc_id", "rep").join(unsure, ["rep", *_SAME]).select(F.col("number").alias("doc_id"), "text")
    return materialize(plain.unionByName(odd))


def _grouped(docs: DataFrame, k: int, percent: int, rows: int, key: str, text: str) -> DataFrame:
    """``near_duplicates`` with the fingerprint of each row's set."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketch = materialize(sketches(docs, k, rows))
    classes = sketch.filter("n_shingles > 0").groupBy(*_SAME).agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes.withColumn("number", F.monotonically_increasing_id()))
    first = materialize(
        sketch.select("doc_id", *_SAME, "bands").join(classes, _SAME).filter("doc_id = rep")
        .select(F.col("number").alias("doc_id"), "bands").dropDuplicates(["doc_id"])
    )
    spread = first.select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("band", "h").agg(F.min("doc").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(spread.join(buckets, ["band", "h"]).select("band", "h", "doc", "centre", "n"))

    wanted = shared.select(F.col("doc").alias("number")).distinct().join(classes, "number").withColumnRenamed("number", "doc_id")
    texts = _texts(docs, wanted, _several(sketch), k)
    pairs = shared.filter("doc <> centre").select(F.col("doc").alias("a"), F.col("centre").alias("b")).distinct()
    links = materialize(_verified(pairs, texts, k, percent))
    found = components(links)

    labelled = shared.filter("n > 2").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc"))
    counts = labelled.groupBy("band", "h", "label").agg(F.count(F.lit(1)).alias("members"))
    mixed = (
        counts.groupBy("band", "h")
        .agg(F.max_by("label", F.struct("members", -F.col("label"))).alias("major"), F.sum("members").alias("all"), F.max("members").alias("most"))
        .filter("`all` > most")
        .withColumn("minor_blocks", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("bigint"))
        .withColumn("major_blocks", F.ceil(F.col("most") / BLOCK).cast("bigint"))
    )
    is_major = F.col("label") == F.col("major")
    members = (
        labelled.select("band", "h", "doc", "label").join(mixed, ["band", "h"])
        .withColumn("is_major", is_major)
        .withColumn("own", F.pmod(F.xxhash64("doc"), F.when(is_major, F.col("major_blocks")).otherwise(F.col("minor_blocks"))))
    )
    cells = materialize(_cells(members))
    details = texts.select(F.col("doc_id").alias("doc"), "text").join(first.withColumnRenamed("doc_id", "doc"), "doc")
    more = (
        cells.join(details, "doc").groupBy("band", "h", "i", "k")
        .applyInArrow(lambda t: _cell_links(t, k, percent), "a bigint, b bigint")
    )
    # Written first: a task that runs two Python functions holds two Python workers, and an executor keeps them.
    groups = components(links.unionByName(materialize(more)))

    named = classes.join(groups.withColumnRenamed("node", "number"), "number", "left").withColumn("group", F.coalesce("component", "number"))
    named = materialize(named.select(*_SAME, "rep", "group"))
    least = named.groupBy("group").agg(F.min("rep").alias("least"))
    out = sketch.select("doc_id", *_SAME).join(named.join(least, "group").select(*_SAME, "least"), _SAME, "left")
    component = F.coalesce("least", "doc_id")
    kept = F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", *_SAME, component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents whose sets of distinct ``k``-word shingles have a Jaccard similarity of ``percent`` / 100 or more are linked;
    ``component_id`` is the least id reachable, itself included, and ``kept`` tells whether it is the row's own id. A
    null, empty or blank text has no shingles and is linked with nothing. Repeated rows repeat their result; several texts
    under one id are judged each by its own shingles. A row without id is kept; its component is its text's, null where no row with
    an id has a near text.
    """
    return _grouped(docs, k, percent, rows, key, text).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document of least id stays, as it is.

    Rows that repeat both id and text count once. Rows without id, and texts without words, stay. Of an id with several texts
    each goes or stays by itself. Only rows that may have to go are shuffled.
    """
    found = materialize(_grouped(docs, k, percent, rows, key, text).select("doc_id", *_SAME, "kept"))
    several = materialize(_several(found))
    gone = found.filter("not kept").select("doc_id", *_SAME).distinct()
    whole = gone.select("doc_id").distinct().join(several, "doc_id", "left_anti")
    twice = found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    suspect = may_be_among(whole.union(twice))(F.col(key).cast("bigint"))
    checked = docs.filter(suspect).join(whole.withColumnRenamed("doc_id", "_gone"), F.col(key) == F.col("_gone"), "left_anti")
    if not several.isEmpty():
        theirs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(may_be_among(several)(F.col("doc_id")))
        lost = _with_prints(theirs.join(several, "doc_id").distinct(), k).join(gone, ["doc_id", *_SAME]).select(F.col("doc_id").alias("_gone"), F.col("text").alias("_lost"))
        checked = checked.join(lost, (F.col(key) == F.col("_gone")) & F.col(text).eqNullSafe(F.col("_lost")), "left_anti")
    return docs.filter(~suspect).unionByName(checked.dropDuplicates([key, text]))
