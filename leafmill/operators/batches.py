"""Operators on batches: results, outputs, caches, properties, ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(results: DataFrame) -> DataFrame:
    """Totals of results ``(error, outputs)`` and the exit code: 0 all succeeded, 2 some, 1 none."""
    ok = F.col("error").isNull()
    totals = results.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("outputs"))), F.lit(0)).cast("bigint").alias("outputs"))
    return totals.withColumn("exit_code", F.when(F.col("failed") == 0, 0).when(F.col("succeeded") == 0, 1).otherwise(2))


def conflicts(outputs: DataFrame, destination: str) -> DataFrame:
    """Destinations of more than one row."""
    return outputs.groupBy(destination).agg(F.count("*").alias("inputs")).where("inputs > 1")


def collisions(outputs: DataFrame, destination: str, inputs: DataFrame, path: str) -> DataFrame:
    """Outputs that would overwrite an input."""
    return outputs.join(inputs.select(F.col(path).alias(destination)).distinct(), destination, "left_semi")


def numbered_names(rows: DataFrame, base: str, order: str, ending: str) -> DataFrame:
    """``base.ext``, ``base_2.ext``, ... in order; bases must not themselves end in such a number."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("file", F.concat(F.col(base), F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(""), F.lit(ending)))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys not in the cache, each once, with the first document and the number of those that want it."""
    once = wanted.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("users"))
    return once.join(cache, "key", "left_anti")


def with_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages with their recognised text where that is not blank."""
    new = recognised.select("doc", "page", "recognised")
    chosen = F.coalesce(F.nullif(F.trim("recognised"), F.lit("")), F.col("text"))
    return pages.join(new, ["doc", "page"], "left").withColumn("text", chosen).drop("recognised")


def reading_order(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(doc, pos, href)`` of the spine's entries that the manifest lists; its later duplicates win."""
    last = manifest.groupBy("doc", "id").agg(F.max_by("href", "pos").alias("href"))
    return spine.join(last, ["doc", "id"]).select("doc", "pos", "href")


def running_budget(entries: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum("size").over(order).cast("bigint")).withColumn("over_budget", F.col("used") > limit)


def patched(old: Column, new: Column) -> Column:
    """Properties with a patch applied: null values leave, empty ones remove, others set."""
    told = F.map_filter(new, lambda k, v: v.isNotNull())
    rest = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(told, k), F.lit(False)))
    return F.map_filter(F.map_concat(rest, told), lambda k, v: v != "")


def event(level: Column, name: Column, message: Column, data: Column | None = None) -> Column:
    """One line of an event log in JSON."""
    fields = [level.alias("level"), name.alias("event"), message.alias("message")]
    return F.to_json(F.struct(*fields, *([data.alias("data")] if data is not None else [])))


def ranked(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order, without bringing them into one task.

    Ranges of the keys are dealt by edges that are fixed values of the plan, so counting
    a range's rows and numbering them agree on what is in it, however often a branch is
    computed.  The counts of the ranges before its own (one number for each) are added
    to each row's place in its range.  Rows equal in all keys are told apart by nothing
    else, so the keys must name a row for its place to be the same in every run.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys)))
    kinds = [keyed.schema[n].dataType for n in names]
    # Any edges give right places; these, of a few rows by hash, make ranges of like size.
    some = keyed.select(*names).orderBy(F.xxhash64(*names)).limit(20 * parts).orderBy(*names).collect()
    edges = [F.struct(*[F.lit(v).cast(k).alias(n) for n, v, k in zip(names, row, kinds)]) for row in some[20::20]]
    own = F.struct(*names)
    below = F.size(F.filter(F.array(*edges), lambda e: e <= own)) if edges else F.lit(0)
    ranged = keyed.withColumn("__range", below)
    earlier = Window.unboundedPreceding, -1
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(*earlier)), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*names)))
    return placed.join(F.broadcast(before), "__range").withColumn(name, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before", *names)


def cache_entries(files: DataFrame) -> DataFrame:
    """Files and bytes of a cache's own entries: a stem of 64 hexadecimal digits, ending ``md`` or ``json``."""
    own = F.regexp_extract("path", "([^/]*)$", 1).rlike(r"^[0-9a-fA-F]{64}\.(md|json)$")
    return files.where(own).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def without_blank_inputs(pages: DataFrame) -> DataFrame:
    """Pages ``(input, doc, page, blank)``: wholly blank documents of an input go, unless all of its are."""
    docs = pages.groupBy("input", "doc").agg(F.min("blank").alias("empty"))
    kept = docs.withColumn("all", F.min("empty").over(Window.partitionBy("input"))).where(~F.col("empty") | F.col("all"))
    return pages.join(kept.select("input", "doc"), ["input", "doc"], "left_semi")


def renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links ``(doc, name)`` under the new names ``(doc, name, new)`` where there is one."""
    return links.join(names, ["doc", "name"], "left").withColumn("target", F.coalesce("new", "name")).drop("new")


def line_boxes(words: DataFrame) -> DataFrame:
    """Left, top and bottom of the words of each line."""
    return words.groupBy("doc", "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("y") + F.col("height")).alias("bottom"))


def merged_outputs(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """``(batch, file)``: a name for the merged file of each batch of ``inputs (batch, seq, path)``, none of ``existing (path)`` or its inputs.

    A single input gives ``first.pdf``; several, or a taken name, give ``first_merged.pdf``
    or the first free one of ``first_merged_2.pdf``, ``first_merged_3.pdf``, ...
    """
    stem = F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", "")
    first = inputs.groupBy("batch").agg(F.min_by("path", "seq").alias("path"), F.count("*").alias("n")).select("batch", "n", stem.alias("stem"))
    pattern = r"(?s)^(.*)_merged(?:_([2-9]|[1-9][0-9]+))?\.pdf$"
    digits = F.regexp_extract("path", pattern, 2)
    number = F.when(digits == "", F.lit(1).cast("bigint")).otherwise(digits.try_cast("bigint"))
    plain_name = F.struct(F.expr("left(path, length(path) - 4)").alias("stem"), F.lit(0).cast("bigint").alias("number"))
    merged_name = F.when(F.col("path").rlike(pattern), F.struct(F.regexp_extract("path", pattern, 1).alias("stem"), number.alias("number")))

    def held(paths: DataFrame, *keys: str) -> DataFrame:
        """Stems and numbers (0 for the stem alone) that PDF paths take."""
        made = paths.where(F.col("path").endswith(".pdf")).select(*keys, F.explode(F.array_compact(F.array(plain_name, merged_name))).alias("t"))
        return made.select(*keys, "t.*").where("number is not null")

    own = held(inputs, "batch").join(first.select("batch", "stem"), ["batch", "stem"], "left_semi")
    other = held(existing).join(first.select("batch", "stem"), "stem").select("batch", "stem", "number")
    taken = own.select("batch", "number").union(other.select("batch", "number")).distinct()
    run = F.row_number().over(Window.partitionBy("batch").orderBy("number"))
    free = taken.where("number > 0").withColumn("run", run).where("number = run").groupBy("batch").agg(F.max("run").alias("last"))
    plain = taken.where("number = 0").select("batch", F.lit(True).alias("plain"))
    next_free = F.coalesce("last", F.lit(0)) + 1
    name = F.when((F.col("n") == 1) & F.col("plain").isNull(), "").when(next_free == 1, "_merged").otherwise(F.concat(F.lit("_merged_"), next_free.cast("string")))
    return first.join(plain, "batch", "left").join(free, "batch", "left").select("batch", F.concat("stem", name, F.lit(".pdf")).alias("file"))


def checked_ranges(files: DataFrame) -> DataFrame:
    """Files ``(path, format, pages)`` with ``error``: page ranges are for PDF files alone."""
    wrong = F.col("pages").isNotNull() & ~F.col("format").eqNullSafe("pdf")
    return files.withColumn("error", F.when(wrong, F.concat(F.lit("page ranges are only valid for PDF inputs: "), "path")))
