"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Sections lie between blank lines, paragraphs are lines, a paragraph's leaves are its sentences. A leaf's
hash is SHA-256 of its text, an inner node's that of its children's hashes: a paragraph's of its leaves, a
section's of its paragraphs, the root's of its sections and of the blank lines between them. Sentences lose
the space that splits them, paragraphs the line feed, so equal roots mean equal texts.

Two trees are compared by descent: if the roots differ, sections whose hashes both trees have are taken as equal and
the others are opened; of their paragraphs those that both have are equal, and the others are opened; of their
leaves those that both have are equal. The likeness is twice the length of what is equal over the length of both
(equal nodes, and the leaves of what was opened; each once, in code points). ``first_difference`` tells where
an edit lies: the number of the first section, from 0, that the other tree doesn't have at that place.

Only DataFrame functions. ``op5`` moves each text once by its id (the exchange is reused on both
sides), and the part of the next text that an edit needs once more, with a tree of short node names. The order of ids is
found on ids alone, by a range sort; no window runs over all rows.

Defined results: null text counts as empty; the tree of an empty text has one empty paragraph, and two empty texts are alike;
rows with equal ids share their successor, whose smallest text counts if it repeats; a row with a
null id has no successor and is edited with an empty text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, bound

SECTION_RE = r"\n[ \t\r]*\n"
SENTENCE_RE = r"(?<=[.!?\n]) "


def sentences(paragraph: Column) -> Column:
    return F.split(paragraph, SENTENCE_RE, -1)


def name(hashed: Column) -> Column:
    """A node's short name: 64 bits of a hash of its SHA-256."""
    return F.xxhash64(hashed)


def tree(text: Column) -> Column:
    """struct(root, sections): the SHA-256 of the root, and the nodes below it by their short names.

    A section is (key, n, paragraphs), a paragraph (key, n, leaves), a leaf (key, n); n is the length of its leaves.
    """

    def total(nodes: Column) -> Column:
        return F.aggregate(nodes, F.lit(0), lambda a, x: a + x["n"])

    def children(nodes: Column) -> Column:
        return F.sha2(F.array_join(F.transform(nodes, lambda x: x["hash"]), ""), 256)

    def leaf(s: Column) -> Column:
        return F.struct(F.sha2(s, 256).alias("hash"), F.length(s).alias("n"))

    def inner(nodes: Column, below: str) -> Column:
        return bound(nodes, lambda ns: F.struct(children(ns).alias("hash"), total(ns).alias("n"), ns.alias(below)))

    def paragraph(p: Column) -> Column:
        return inner(F.transform(sentences(p), leaf), "leaves")

    def section(s: Column) -> Column:
        return inner(F.transform(F.split(s, "\n", -1), paragraph), "paragraphs")

    def short(ss: Column) -> Column:
        leaves = lambda p: F.transform(p["leaves"], lambda x: F.struct(name(x["hash"]).alias("key"), x["n"].alias("n")))
        paragraphs = lambda s: F.transform(s["paragraphs"], lambda p: F.struct(name(p["hash"]).alias("key"), p["n"].alias("n"), leaves(p).alias("leaves")))
        return F.transform(ss, lambda s: F.struct(name(s["hash"]).alias("key"), s["n"].alias("n"), paragraphs(s).alias("paragraphs")))

    t = F.coalesce(text, F.lit(""))
    gaps = F.array_join(F.regexp_extract_all(t, F.lit(SECTION_RE), F.lit(0)), "")
    sections = F.transform(F.split(t, SECTION_RE, -1), section)
    return bound(sections, lambda ss: F.struct(F.sha2(F.concat(F.array_join(F.transform(ss, lambda s: s["hash"]), ""), gaps), 256).alias("root"), short(ss).alias("sections")))


def weight(nodes: Column) -> Column:
    """The length of nodes (key, n), each key once."""
    return F.aggregate(F.array_distinct(F.transform(nodes, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n")))), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])


def level(a: Column, b: Column, below: str | None) -> Column:
    """One step of the descent over two lists of nodes: (equal: their length, a and b: the children of the other nodes)."""
    keys = lambda nodes: F.transform(nodes, lambda x: x["key"])

    def split(common: Column) -> Column:
        other = lambda nodes: F.filter(nodes, lambda x: ~F.array_contains(common, x["key"]))
        opened = lambda nodes: F.flatten(F.transform(other(nodes), lambda x: x[below])) if below else other(nodes)
        same = F.when(F.size(common) == 0, F.lit(0).cast("bigint")).otherwise(weight(F.filter(a, lambda x: F.array_contains(common, x["key"]))))
        return F.struct(same.alias("equal"), opened(a).alias("a"), opened(b).alias("b"))

    return bound(F.array_intersect(keys(a), keys(b)), split)


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two lists of sections, by descent into those that differ."""

    def shares(s: Column) -> Column:
        return bound(level(s["a"], s["b"], "leaves"), lambda p: bound(level(p["a"], p["b"], None), lambda x: quotient(s["equal"] + p["equal"] + x["equal"], weight(x["a"]) + weight(x["b"]))))

    def quotient(equal: Column, rest: Column) -> Column:
        return F.when(2 * equal + rest == 0, F.lit(1.0)).otherwise(2 * equal / (2 * equal + rest).cast("double"))

    return bound(level(a, b, "paragraphs"), shares)


def first_difference(a: Column, b: Column) -> Column:
    """The number of the first section of ``a``, from 0, that isn't the section of ``b`` at that place; null if each is."""
    return F.array_min(F.transform(a, lambda s, i: F.when(~s["key"].eqNullSafe(F.get(b, i)["key"]), i))).cast("bigint")


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, half, copies) -> plus next_id: the next larger id, for the largest the smallest one.

    ``monotonically_increasing_id`` numbers the rows of a range-sorted table; a join with the row
    after gives the successor, and a table of one row a partition that of a partition's last row.
    """
    mid = F.monotonically_increasing_id()
    spark, scratch = ids.sparkSession, Scratch(ids.sparkSession)
    placed = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("m", mid)
    placed = scratch.keep(placed.select("*", F.shiftright("m", 33).alias("part"), (F.col("m").bitwiseAND((1 << 33) - 1)).alias("row")).drop("m"), "order")
    firsts = sorted((r["part"], r["doc_id"]) for r in placed.where("row = 0").select("part", "doc_id").collect())  # one row a partition
    after = [(p, firsts[(k + 1) % len(firsts)][1]) for k, (p, _) in enumerate(firsts)]
    heads = spark.createDataFrame(after, "part bigint, head_id bigint") if after else spark.createDataFrame([], "part bigint, head_id bigint")
    following = placed.select("part", (F.col("row") - 1).alias("row"), F.col("doc_id").alias("row_next"))
    out = placed.join(following, ["part", "row"], "left").join(F.broadcast(heads), "part", "left")
    return out.select("doc_id", "half", "copies", F.coalesce("row_next", "head_id").alias("next_id"))


def op5_merkle(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    scratch = Scratch(documents.sparkSession)
    half = F.floor(F.length("text") / 2).cast("int")
    ids = known.select("doc_id", half.alias("half")).groupBy("doc_id").agg(F.max("half").alias("half"), F.count("*").alias("copies"))
    order = scratch.keep(successors(ids), "successors")
    repeated = order.where("copies > 1").limit(1).count() > 0
    step = order.select(F.col("doc_id").alias("cur"), "next_id", "half")
    sections = tree(F.col("text"))["sections"]
    head = known.join(step, known["doc_id"] == step["next_id"]).select("cur", F.left("text", F.col("half")).alias("head"), sections.alias("next_sections"))
    if repeated:
        head = head.groupBy("cur").agg(F.min(F.struct("head", "next_sections")).alias("h")).select("cur", "h.*")
    pair = known.join(head, known["doc_id"] == head["cur"], "left").drop("cur")
    lone = docs.where("doc_id is null").select("*", F.lit("").alias("head"), tree(F.lit(""))["sections"].alias("next_sections"))
    pair = pair.unionByName(lone)
    n = F.length("text")
    edited = F.concat(F.left("text", n - half), F.left(F.col("head"), half))
    row = pair.select("doc_id", n.cast("bigint").alias("n_chars"), tree(F.col("text")).alias("t"), edited.alias("edited"), "next_sections")
    row = row.withColumn("e", tree(F.col("edited")))
    same = F.col("t.root") == F.col("e.root")
    return row.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("t.root").alias("fingerprint"),
        F.col("e.root").alias("edited_fingerprint"),
        F.when(same, F.lit(1.0)).otherwise(likeness(F.col("t.sections"), F.col("e.sections"))).alias("near_edited"),
        likeness(F.col("t.sections"), F.col("next_sections")).alias("near_next"),
        first_difference(F.col("t.sections"), F.col("e.sections")).alias("first_difference"),
    )
