"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

Documents with equal shingle sets form a class; a class's least id stands for it. Band keys of
the classes' signatures gather classes in buckets. A bucket's members are first compared with
its leader, its least member, which joins a group of any size by a number of comparisons that
grows with the group, not with its square. Members of one leader that are still in different
components are then compared in blocks: those outside the leader's largest component are
queries against all of its members, so no link between components is missed.

Only sets whose sizes differ by no more than the similarity allows can be linked, so a bucket
is split by size first: a set is a member of two neighbouring size classes, and any two sets
that may be linked share one.

Every comparison is of whole shingle sets. The set of a leader with many followers goes to as
many salted copies as it needs, so no task holds a leader's whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import MinMax, same_share, set_key, shingle_sets
from .tables import Scratch, free_name, give_back, read

#: Of a similarity of 0.8, less than one pair in a million shares no band.
BANDS, ROWS = 36, 5
#: Followers of a leader that share a copy of its set.
PER_COPY = 64
#: In comparisons across components: queries that meet a part of a leader's members, and members of a part.
QUERIES_PER_BLOCK, MEMBERS_PER_PART = 64, 256


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """(id, n, key, bands) of (id, text): set size, the set's name, a key for each band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = MinMax(BANDS, ROWS)
        for pdf in batches:
            n, keys, bands = [], [], []
            for s in shingle_sets(pdf["text"].tolist(), k):
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                bands.append(hashing.band_keys(s) if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "n": n, "key": keys, "bands": bands})
        give_back()

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, n long, key binary, bands array<long>")


def led_by_size(members: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, lead) of the size classes of ``members`` (bucket, id, n) that have two members.

    Class c holds the sizes from r ** (c - 1) to r ** (c + 1). As r is a little more than
    100 / percent, two sets of this similarity are in one class at least.
    """
    at = F.floor(F.log("n") / F.log(F.lit(100.0 / percent * 1.0001))).cast("int")
    each = members.select("bucket", "id", F.explode(F.array(at, at + 1)).alias("class")).select(F.xxhash64("bucket", "class").alias("bucket"), "id")
    leads = each.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket", "lead")
    return each.join(leads, "bucket").select("bucket", "id", "lead").distinct()


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """(id, set) of (id, text): the sorted hashes of a text's shingles, eight bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "set": [s.tobytes() for s in shingle_sets(pdf["text"].tolist(), k)]})
        give_back()

    return texts.mapInPandas(run, f"id {dict(texts.dtypes)['id']}, set binary")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union.

    b's set joins by id. The pairs of an a are dealt to copies of a's set by b's hash, and a
    set gets a copy for each ``PER_COPY`` of its pairs.
    """
    kind = dict(sets.dtypes)["id"]
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies"))
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")).join(copies, "a")
    left = left.select("a", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "set_a")
    right = pairs.join(copies, "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    right = right.select("a", "b", "set_b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    both = right.join(left, ["a", "copy"]).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            for i, (a, b) in enumerate(zip(pdf["set_a"], pdf["set_b"], strict=True)):
                shared, union = same_share(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64))
                keep[i] = union > 0 and 100 * shared >= percent * union
            yield pdf.loc[keep, ["a", "b"]]
        give_back()

    return both.mapInPandas(run, f"a {kind}, b {kind}").distinct()


def _labelled(members: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    known = labels.select(F.col("node").alias(column), F.col("component").alias(f"_{name}"))
    return members.join(known, column, "left").withColumn(name, F.coalesce(f"_{name}", column)).drop(f"_{name}")


def confirmed_links(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Enough confirmed links (a, b) among ``members`` to make all their components.

    ``members`` (bucket, id, lead) and ``sets`` (id, set) are saved.
    """

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = scratch.save(pairs)
        return scratch.save(similar(pairs, sets, percent)), pairs

    # the least of a member's leaders first: most members of a group need no other comparison
    follow = members.where("id <> lead")
    links, tested = confirmed(follow.groupBy(F.col("id").alias("b")).agg(F.min("lead").alias("a")).select("a", "b"))
    labels = connected_components(links, scratch)

    # then every leader whose component is still another
    led = _labelled(_labelled(follow, labels, "id", "of_id"), labels, "lead", "of_lead")
    more = led.where("of_id <> of_lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    links = links.unionAll(confirmed(more)[0])
    labels = connected_components(links, scratch)

    # then all other members of one leader, in blocks
    known = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return known.unionAll(scratch.save(across(_labelled(follow, labels, "id", "label").select("lead", "id", "label").distinct(), sets, percent).distinct()))


def across(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of one leader's members, given by their labels.

    ``led`` has (lead, id, label). Of a leader's members those outside its largest component
    are the queries; blocks of them meet parts of all its members, so that a row stands for a
    member and a block and never for a pair. Of the links that a block and a part confirm, those
    that join what others joined already are left out, as components are all that is asked for.
    """
    kind = dict(sets.dtypes)["id"]
    by_label = led.groupBy("lead", "label").agg(F.count("*").alias("n"))
    groups = by_label.groupBy("lead").agg(F.max_by("label", "n").alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    groups = groups.select("lead", "main", F.ceil(F.col("others") / QUERIES_PER_BLOCK).cast("int").alias("blocks"), F.ceil(F.col("all") / MEMBERS_PER_PART).cast("int").alias("parts"))
    mixed = led.join(groups, "lead").join(sets, "id")
    spread = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    queries = mixed.where("label <> main").select("lead", "id", "label", "set", "parts", spread("blocks", "block").alias("block")).select("lead", "id", "label", "set", "block", each("parts").alias("part"))
    members = mixed.select(*[F.col(c).alias(c) for c in ("lead", "id", "label", "set", "blocks")], spread("parts", "part").alias("part")).select("lead", "id", "label", "set", "part", each("blocks").alias("block"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, queries = None, None
        for pdf in batches:
            out = []
            for lead, block, part, asks, label, data in zip(pdf["lead"], pdf["block"], pdf["part"], pdf["asks"], pdf["label"], pdf["set"], strict=True):
                if key != (lead, block, part):
                    key, queries = (lead, block, part), Queries(percent)
                s = np.frombuffer(data, dtype=np.uint64)
                if asks:
                    queries.add(label, s)
                else:
                    out += queries.linked(label, s)
            yield pd.DataFrame(out, columns=["a", "b"])
        give_back()

    # queries before members; a group lies in one partition, one row after the other
    keys = ["lead", "block", "part"]
    rows = queries.withColumn("asks", F.lit(True)).unionByName(members.withColumn("asks", F.lit(False)))
    rows = rows.select(*keys, "asks", "label", "set").repartition(*keys).sortWithinPartitions(*keys, F.desc("asks"))
    return rows.mapInPandas(compare, f"a {kind}, b {kind}")


class Queries:
    """The sets of a block, and which labels the sets compared with them have joined."""

    def __init__(self, percent: int):
        self.percent, self.labels, self.sets, self.root, self.index = percent, [], [], {}, None

    def add(self, label, s: np.ndarray) -> None:
        self.labels.append(label)
        self.sets.append(s)

    def _shared(self, s: np.ndarray) -> np.ndarray:
        """How many hashes each query has in common with ``s``."""
        if self.index is None:
            tokens = np.concatenate(self.sets)
            by = np.argsort(tokens, kind="stable")
            self.index = tokens[by], np.repeat(np.arange(len(self.sets)), [len(q) for q in self.sets])[by]
        tokens, owner = self.index
        low = np.searchsorted(tokens, s, "left")
        n = np.searchsorted(tokens, s, "right") - low
        hit = n > 0
        low, n = low[hit], n[hit]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else low
        return np.bincount(owner[at], minlength=len(self.sets))

    def _top(self, x):
        while x in self.root:
            x = self.root[x]
        return x

    def linked(self, label, s: np.ndarray) -> list[tuple]:
        """Links between ``label`` and the labels of queries, without those that others imply."""
        if not self.sets:
            return []
        if len(self.sets) > 3:
            shared = self._shared(s).tolist()
        else:
            apart = [self._top(x) != self._top(label) and self.percent * max(len(q), len(s)) <= 100 * min(len(q), len(s)) for x, q in zip(self.labels, self.sets, strict=True)]
            shared = [same_share(q, s)[0] if a else 0 for a, q in zip(apart, self.sets, strict=True)]
        out = []
        for q, both in enumerate(shared):
            if both and 100 * both >= self.percent * (len(self.sets[q]) + len(s) - both):
                one, other = self._top(self.labels[q]), self._top(label)
                if one != other:
                    self.root[max(one, other)] = min(one, other)
                    out.append((self.labels[q], label))
        return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Links are transitive; a component's id is its least document id, which alone is kept. A
    text of fewer than ``k`` words is one shingle. Null texts and texts without words have no
    shingles, are linked with nothing and are kept. Texts of any length are compared whole.
    Rows with one id are one document, linked by any of them, be their texts equal or not; each
    has its row. A null id is linked with nothing, has a null component and is kept. An empty
    table gives an empty table. Only the named columns are read, so other columns may have any
    name.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = scratch.save(signatures(rows, k))
    some = signed.where("key IS NOT NULL AND id IS NOT NULL")
    classes = scratch.save(some.groupBy("key").agg(F.min("id").alias("class"), F.count("*").alias("rows")).where("rows > 1").select("key", "class"))
    of = F.when(F.col("id").isNotNull() & F.col("key").isNotNull(), F.coalesce("class", "id"))
    known = scratch.save(signed.join(classes, "key", "left").select("id", "n", of.alias("class"), F.when(F.col("id") == of, F.col("bands")).alias("bands")))
    scratch.drop(signed)

    banded = known.where("bands IS NOT NULL").select("id", "n", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket")
    members = scratch.save(led_by_size(scratch.save(banded.join(buckets, "bucket").select("bucket", "id", "n").distinct()), percent))
    # only members' texts travel from here on; a leader is a member of its own bucket
    wanted = scratch.save(members.select(F.col("id").alias("wanted")).distinct())
    sets = scratch.save(sets_of(rows.join(scratch.small(wanted), F.col("id") == F.col("wanted"), "left_semi"), k))
    links = confirmed_links(members, sets, percent, scratch)
    # rows of one id with different texts are one document
    same = known.where("class IS NOT NULL AND id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"))
    same = same.join(_repeated(known, "id").withColumnRenamed("id", "repeated"), F.col("b") == F.col("repeated"), "left_semi")
    labels = connected_components(links.unionAll(same), scratch)
    out = _labelled(known.select("id", "n", F.coalesce("class", "id").alias("class")), labels, "class", "component_id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def _repeated(rows: DataFrame, column: str) -> DataFrame:
    """Ids of more than one row."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows")).where("rows > 1").select(column)


def _name_of(id_col: str, text_col: str, numbers: bool) -> Column:
    """A document id for a row whose own id is null or repeated: a hash of its id and text, beyond usual ids."""
    h = F.xxhash64(id_col, text_col, F.col(id_col).isNull())
    if numbers:
        return h.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.concat(F.lit("\U0010ffff"), F.hex(h))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that near-duplicate removal keeps.

    Of each component one row stays, that of the least id. Of rows alike in id and text one
    stays. Rows without an id, and rows of one id with different texts, are documents of their
    own, which in a component come after rows with an id of their own. Other rows without words
    all stay. An empty table gives an empty table. Columns may have any name.
    """
    scratch = Scratch(docs.sparkSession)
    numbers = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    node, odd, repeated = (free_name(docs, x) for x in ("_node", "_odd", "_repeated"))
    again = scratch.save(_repeated(docs.select(F.col(id_col).alias(repeated)), repeated))
    if again.limit(1).count():
        marked = docs.join(scratch.small(again), F.col(id_col) == F.col(repeated), "left")
        marked = marked.withColumn(odd, F.col(id_col).isNull() | F.col(repeated).isNotNull()).drop(repeated)
    else:
        marked = docs.withColumn(odd, F.col(id_col).isNull())
    own = F.col(id_col).cast("long" if numbers else "string")
    marked = marked.withColumn(node, F.when(F.col(odd), _name_of(id_col, text_col, numbers)).otherwise(own))
    if marked.where(odd).limit(1).count():
        alone = scratch.save(marked.where(odd).dropDuplicates([node]))
        # an id whose rows were all alike is its one row's own again
        still = scratch.save(_repeated(alone.select(F.col(id_col).alias(repeated)), repeated))
        named = F.when(F.col(id_col).isNull() | F.col(repeated).isNotNull(), F.col(node)).otherwise(own)
        alone = alone.join(scratch.small(still), F.col(id_col) == F.col(repeated), "left").withColumn(node, named).drop(repeated)
        marked = scratch.save(marked.where(~F.col(odd)).unionAll(alone))
    gone = near_duplicates(marked.select(node, F.col(text_col).alias("text")), k, percent, node, "text").where("NOT kept").select(F.col(node).alias(odd))
    gone = scratch.save(gone.distinct())
    return marked.drop(odd).join(scratch.small(gone), F.col(node) == F.col(odd), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, n, unnest(g) AS g FROM s JOIN n USING (doc_id)),
df AS (SELECT g, count(*) AS df FROM e GROUP BY g),
p AS (SELECT doc_id, n, g FROM (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS r FROM e JOIN df USING (g)) WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
i AS (SELECT a, b, count(*) AS i FROM c JOIN e x ON x.doc_id = a JOIN e y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v WHERE r.c < u.b),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.v = n.doc_id"""

QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
ORACLES = {"op4_minhash_dedup": SQL}
