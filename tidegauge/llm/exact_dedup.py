"""Exact duplicates in three combining steps, in built-in operations only.

1. Every task folds its own rows (map-side combine of the first grouping).
2. Rows meet by (salt, digest, content); the salt is the task's number, so a text that fills a third of the
   table is spread over `salts` groups and arrives as one row per task.
3. The winners of the salts meet by (digest, content).

The whole content is a grouping key in each step: a digest only spreads the rows, equality is decided on text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, pick, run_folder, stored

SALTS = 16


def _content(text: str) -> Column:
    return F.coalesce(pick(text).cast("string"), F.lit(""))


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep_id, group_size): one row per distinct text."""
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("salt", "digest", "content")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    # dealt by digest alone, so that texts with one digest stand together for the next grouping too
    return (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def text_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest=_digest
) -> tuple[DataFrame, DataFrame | None]:
    """Classes of equal texts: (digest, keep_id, group_size), and, for digests that several texts share,
    (digest, content, keep_id, group_size); the second is None if no digest is shared.

    The classes are written to the shared folder, since two readers follow.
    """
    rows = docs.select(pick(doc_id).alias("doc_id"), _content(text).alias("content"))
    winners = _winners(rows.withColumn("digest", digest(F.col("content"))), salts)
    classes = stored(
        winners.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
            F.count("*").alias("texts"),
        ),
        run_folder(docs.sparkSession) + "/classes",
    )
    shared = classes.filter("texts > 1")
    if shared.isEmpty():
        return classes.drop("texts"), None
    return classes.filter("texts = 1").drop("texts"), winners.join(shared.select("digest"), "digest", "left_semi")


def _with_class(rows: DataFrame, classes: DataFrame, several: DataFrame | None) -> DataFrame:
    """Each row (with `digest` and `content`) beside keep_id and group_size of its class."""
    plain = rows.join(classes, "digest")
    if several is None:
        return plain
    return plain.unionByName(rows.join(several, ["digest", "content"]))


def mark_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest=_digest
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Of equal texts the row with the largest doc_id stays. A null text counts as empty, and empty texts equal
    each other. Rows repeated with the same id and text are one document: each of them is marked kept. Rows
    without an id never win against one with an id; in a class with no id at all keep_id is null and each row is
    kept, for nothing tells them apart. Other columns are not read; an empty table gives an empty result.
    """
    classes, several = text_classes(docs, text, doc_id, salts, digest)
    rows = docs.select(pick(doc_id).alias("doc_id"), _content(text).alias("content"))
    rows = rows.withColumns({"digest": digest(F.col("content")), "text_sha256": F.sha2(F.col("content"), 256)})
    if several is None:
        rows = rows.drop("content")  # only the digests travel
    return _with_class(rows, classes, several).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest=_digest
) -> DataFrame:
    """One row of each class of equal texts, with all its columns.

    It is one of those that mark_copies marks kept. Where these are several (rows repeated with an id, or a class with no
    id at all), the last one in the order of the other columns' JSON stays; rows alike in all columns are one.
    """
    classes, several = text_classes(docs, text, doc_id, salts, digest)
    key, content = free_name(docs, "digest__"), free_name(docs, "content__")
    keep, size = free_name(docs, "keep__"), free_name(docs, "size__")
    rows = docs.withColumn(key, digest(_content(text)))
    names = {"digest": key, "content": content, "keep_id": keep, "group_size": size}
    # a class without any id has a null keep_id: the condition is null-safe
    same = pick(doc_id).eqNullSafe(F.col(keep))
    kept = rows.join(classes.withColumnsRenamed(names), key).filter(same)
    if several is not None:
        more = rows.withColumn(content, _content(text)).join(several.withColumnsRenamed(names), [key, content])
        kept = kept.unionByName(more.filter(same).drop(content))
    # only classes of several rows can keep several: found on digests alone, mostly there are none
    repeated = stored(
        kept.filter(F.col(size) > 1).select(F.spark_partition_id().alias("salt") % salts, key)
        .toDF("salt", key).groupBy("salt", key).count()
        .groupBy(key).agg(F.sum("count").alias("n")).filter("n > 1").select(key),
        run_folder(docs.sparkSession) + "/repeated",
    )
    columns = [pick(c) for c in docs.columns]
    if repeated.isEmpty():
        return kept.select(*columns)
    return kept.join(repeated, key, "left_anti").select(*columns).unionByName(
        _one_each(kept.join(repeated, key, "left_semi"), docs.columns, key, text, salts)
    )


def _one_each(rows: DataFrame, columns: list[str], key: str, text: str, salts: int) -> DataFrame:
    """One row per text, chosen in two steps like the winners."""
    others = [pick(c).alias(f"c{n}") for n, c in enumerate(columns) if c != text]
    order = F.to_json(F.struct(*others, pick(text).isNull().alias("t")), {"ignoreNullFields": "false"})
    packed = rows.select(
        (F.spark_partition_id() % salts).alias("salt"), F.col(key).alias("digest"), _content(text).alias("content"),
        F.struct(*[pick(c) for c in columns]).alias("row"), order.alias("order"),
    )
    best = [F.max_by("row", "order").alias("row"), F.max("order").alias("order")]
    salted = packed.groupBy("salt", "digest", "content").agg(*best)
    return salted.groupBy("digest", "content").agg(*best).select("row.*")
