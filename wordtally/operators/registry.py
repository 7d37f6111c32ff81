"""Document registry and tokenized table operators (prepare stage)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.session import reliable_checkpoint


def select_docs(
    tok: DataFrame,
    start_date: dt.date | str | None = None,
    end_date: dt.date | str | None = None,
    symbols: tuple[str, ...] | list[str] = (),
    min_sentences: int = 1,
) -> DataFrame:
    """date between (both ends kept), sentences >= min, label pos or neg,
    symbol in the list when the list is not empty. Built as one conjunction so
    Catalyst pushes the date, label and symbol parts into the scan."""
    labelled = (F.col("sentences") >= min_sentences) & F.col("class_label").isin("pos", "neg")
    return tok.where(labelled & in_range(start_date, end_date, symbols))


def in_range(start_date: dt.date | str | None = None, end_date: dt.date | str | None = None, symbols: tuple[str, ...] | list[str] = ()) -> Column:
    """The date and symbol part of F1."""
    cond = F.lit(True)
    if start_date is not None:
        cond = cond & (F.col("associated_date") >= F.lit(str(start_date)).cast("date"))
    if end_date is not None:
        cond = cond & (F.col("associated_date") <= F.lit(str(end_date)).cast("date"))
    if symbols:
        cond = cond & F.col("symbol").isin(list(symbols))
    return cond


# ---------------------------------------------------------------- registry
REGISTRY_FIXED = ["id", "original_url", "path_saved", "file_type", "use_saved", "insert_seq"]
REGISTRY_MUTABLE = ["original_url", "symbol", "associated_date", "class_label", "error_cost", "success_gain", "xpath"]


def saved_path(md5: F.Column, ftype: F.Column) -> F.Column:
    """K8: content-addressed location of a stored copy."""
    return F.concat(F.lit("store/"), F.substring(md5, 1, 1), F.lit("/"), F.substring(md5, 2, 1), F.lit("/"), md5, F.lit("."), ftype)


def incoming_rows(manifest: DataFrame, files: DataFrame, store_content: bool = True) -> DataFrame:
    """Manifest rows (one per announcement, with ``seq``) joined to the scanned
    files by path (F13: a row without file keeps a null md5) with type (S4)
    and content hash (G19)."""
    from wordtally.functions.cells import file_type

    # local scans report file:/... URIs, manifests plain paths: compare without the scheme
    def key(c):
        return F.regexp_replace(c, "^file:(//)?", "")

    f = files.select(key(F.col("path")).alias("_key"), "orig_md5")
    rows = manifest.withColumn("_key", key(F.col("original_url"))).join(f, "_key", "left").drop("_key")
    ftype = file_type(F.col("original_url"))
    return rows.withColumn("file_type", ftype).withColumn(
        "path_saved", saved_path(F.col("orig_md5"), ftype) if store_content else F.col("original_url")
    ).withColumn("use_saved", F.lit(bool(store_content)))


def upsert(registry: DataFrame | None, incoming: DataFrame, modify: bool = False) -> DataFrame:
    """G2 + J1: one registry row per content hash.

    The first row of a hash (lowest ``seq``, the existing registry first)
    fixes id, saved path, type and insert order; without ``modify`` it fixes
    everything, with ``modify`` the last row sets url, symbol, date, label,
    cost, gain and block selector. ``min_by`` / ``max_by`` keep the group
    state bounded, so a hash shared by a third of all rows costs nothing
    extra. Rows without a file (null md5) never enter.
    """
    cols = ["id", "seq", "orig_md5", "symbol", "associated_date", "class_label", "error_cost", "success_gain",
            "original_url", "path_saved", "file_type", "use_saved", "xpath"]
    inc = incoming.where(F.col("orig_md5").isNotNull())
    if "xpath" not in inc.columns:
        inc = inc.withColumn("xpath", F.lit(None).cast("string"))
    # processing order: the existing registry first, then the batch by seq
    inc = inc.select(*cols, F.struct(F.lit(1).alias("b"), F.col("seq").alias("s")).alias("_ord"))
    allrows = (
        inc
        if registry is None
        else registry.select(*cols, F.struct(F.lit(0).alias("b"), F.col("seq").alias("s")).alias("_ord")).unionByName(inc)
    )
    fixed = F.struct(F.col("id"), F.col("seq"), F.col("path_saved"), F.col("file_type"), F.col("use_saved"))
    mutable = F.struct(*[F.col(c) for c in REGISTRY_MUTABLE])
    agg = allrows.groupBy("orig_md5").agg(
        F.min_by(fixed, F.col("_ord")).alias("f"),
        (F.max_by(mutable, F.col("_ord")) if modify else F.min_by(mutable, F.col("_ord"))).alias("m"),
    )
    return agg.select(
        "f.id", "f.seq", "orig_md5", "m.symbol", "m.associated_date", "m.class_label", "m.error_cost", "m.success_gain",
        "m.original_url", "f.path_saved", "f.file_type", "f.use_saved", "m.xpath",
    )


#: Folders of a registry kept on disk, by content hash.
REGISTRY_BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("orig_md5"), F.lit(buckets)).cast("int")


def import_batch(spark: SparkSession, path: str, incoming: DataFrame, modify: bool = False, buckets: int = REGISTRY_BUCKETS) -> DataFrame:
    """G2 on a registry kept at ``path`` in buckets of the content hash.

    Only the buckets that hold a hash of the batch are read, merged with it by
    :func:`upsert` and replaced (dynamic partition overwrite); the others keep
    their files. Importing the same batch again changes nothing. Returns the
    whole registry; ``buckets`` must be the same for every import."""
    inc = incoming.where(F.col("orig_md5").isNotNull()).withColumn("bucket", _bucket(buckets))
    touched = sorted(r[0] for r in inc.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    old = read_registry(spark, path)
    part = old.where(F.col("bucket").isin(touched)) if old is not None else None
    new = reliable_checkpoint(upsert(part, inc, modify).withColumn("bucket", _bucket(buckets)))
    writer = new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)
    return read_registry(spark, path)


def read_registry(spark: SparkSession, path: str) -> DataFrame | None:
    """The registry at ``path``, or None before the first import."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(folder) and fs.listStatus(folder) else None


def stamp(new_registry: DataFrame, old_registry: DataFrame | None, modify: bool = False, incoming: DataFrame | None = None) -> DataFrame:
    """Insert and update times, one value per run (``current_timestamp``
    is fixed for the whole query). Rows already registered keep their insert
    time; with ``modify`` the rows whose hash is among those of ``incoming``
    (this run's rows) get a new update time, all others keep theirs."""
    now = F.current_timestamp()
    if old_registry is None or "insert_time" not in old_registry.columns:
        return new_registry.withColumn("insert_time", now).withColumn("update_time", now)
    old = old_registry.select("orig_md5", F.col("insert_time").alias("_it"), F.col("update_time").alias("_ut"))
    out = new_registry.join(old, "orig_md5", "left")
    touched = F.lit(False)
    if modify:
        if incoming is None:
            raise ValueError("modify needs this run's incoming rows")
        out = out.join(incoming.select("orig_md5", F.lit(True).alias("_seen")).distinct(), "orig_md5", "left")
        touched = F.coalesce("_seen", F.lit(False))
    return out.withColumn("insert_time", F.coalesce("_it", now)).withColumn(
        "update_time", F.when(touched, now).otherwise(F.coalesce("_ut", now))
    ).drop("_it", "_ut", "_seen")


def import_status(registry: DataFrame | None, incoming: DataFrame, modify: bool = False) -> DataFrame:
    """One status per incoming row: ``missing`` (F13), ``inserted`` (the
    first row of its hash), ``modified`` or ``skipped`` (a later row, with or
    without modify)."""
    inc = incoming.select("seq", "original_url", "orig_md5")
    firsts = inc.where(F.col("orig_md5").isNotNull()).groupBy("orig_md5").agg(F.min("seq").alias("_first"))
    if registry is not None:
        prior = registry.select("orig_md5").distinct().withColumn("_known", F.lit(True))
        firsts = firsts.join(prior, "orig_md5", "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(False))
    later = "modified" if modify else "skipped"
    st = (
        F.when(F.col("orig_md5").isNull(), "missing")
        .when(~F.coalesce(F.col("_known"), F.lit(False)) & (F.col("seq") == F.col("_first")), "inserted")
        .otherwise(later)
    )
    return inc.join(firsts, "orig_md5", "left").select("seq", "original_url", "orig_md5", st.alias("status"))


def label_update(registry: DataFrame, labels: DataFrame) -> DataFrame:
    """J2 + W6: label rows (path, class_label, error_cost, success_gain, seq
    [, xpath]) matched to the registry by original url, first registry row per
    url (lowest id); several label rows for one url: the last one wins. A
    block selector on an html row is stored (Q2) and drops the row's
    tokenization: a ``tokenization_id`` of the registry becomes null, so the
    next tokenization picks the row up."""
    first = registry.groupBy("original_url").agg(F.min("id").alias("id"))
    lab = labels
    if "xpath" not in lab.columns:
        lab = lab.withColumn("xpath", F.lit(None).cast("string"))
    last = lab.groupBy(F.col("path").alias("original_url")).agg(
        F.max_by(F.struct("class_label", "error_cost", "success_gain", "xpath"), F.col("seq")).alias("l")
    )
    hit = first.join(last, "original_url").select("id", "l")
    out = registry.join(hit, "id", "left")
    new_xpath = F.when(F.col("l").isNotNull() & F.col("l.xpath").isNotNull() & (F.col("file_type") == "html"), F.col("l.xpath"))
    if "tokenization_id" in registry.columns:
        out = out.withColumn("tokenization_id", F.when(new_xpath.isNull(), F.col("tokenization_id")))
    return out.select(
        *[c for c in registry.columns if c not in ("class_label", "error_cost", "success_gain", "xpath")],
        F.coalesce("l.class_label", "class_label").alias("class_label"),
        F.coalesce("l.error_cost", "error_cost").alias("error_cost"),
        F.coalesce("l.success_gain", "success_gain").alias("success_gain"),
        F.coalesce(new_xpath, F.col("xpath")).alias("xpath"),
        F.col("l").isNotNull().alias("relabelled"),
    )


def label_status(registry: DataFrame, labels: DataFrame) -> DataFrame:
    """K11 for label rows: ``modified`` or ``no such record``."""
    urls = registry.select(F.col("original_url").alias("path")).distinct().withColumn("_hit", F.lit(True))
    return labels.join(urls, "path", "left").select(
        "seq", "path", F.when(F.col("_hit"), "modified").otherwise("no such record").alias("status")
    )


# ------------------------------------------------------------- tokenized
def merge_key() -> list[str]:
    return ["symbol", "associated_date"]


def merge_tokenized(tok: DataFrame) -> DataFrame:
    """One tokenized row per (symbol, date).

    Counts are summed, label, cost and gain come from the last processed
    document (``max_by`` on seq); all of it with partial aggregation. The
    merged sentences are kept as ordered parts (``merge_parts``), newest
    first, instead of one array per group, so that no group - however hot -
    is collected into one row.
    """
    last = F.struct("class_label", "error_cost", "success_gain")
    agg = tok.groupBy(*merge_key()).agg(
        F.max_by(last, F.col("seq")).alias("l"),
        F.sum("sentences").cast("long").alias("sentences"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.count(F.lit(1)).alias("parts"),
        F.min("id").alias("tokenization_id"),
    )
    return agg.select(
        "tokenization_id", *merge_key(), "l.class_label", "l.error_cost", "l.success_gain", "sentences", "tokens", "parts"
    )


def merge_parts(tok: DataFrame) -> DataFrame:
    """The order of the merged text: part 0 is the newest document."""
    from wordtally.operators.ranking import dense_index

    return dense_index(tok.select(*merge_key(), "id", "seq"), [F.col("seq").desc()], group=merge_key(), idx_col="part_no")


def tokenize_documents(registry: DataFrame, texts: DataFrame, keep_sentences: bool = True) -> DataFrame:
    """Tokenize registry rows from their converted texts (``path, text,
    error`` from ``sources.files.to_text``, or scanned files ``path,
    file_type, content`` - then each html row's stored block selector is
    applied, Q2), looked up by original url.

    One row per registry row with ``status``: ``tokenized``, ``unsupported
    file type`` (no text for the type) or ``missing file``; empty texts give
    zero sentences (Q5). The rows feed ``merge_tokenized``."""
    from wordtally.functions import text as T

    def key(c):
        return F.regexp_replace(c, "^file:(//)?", "")

    if "orig_md5" in texts.columns and "orig_md5" in registry.columns:
        # the registered content, wherever a copy of it lies: one file per hash
        one = texts.groupBy("orig_md5").agg(F.min("path").alias("path"))
        found = texts.join(one, ["orig_md5", "path"], "left_semi").dropDuplicates(["orig_md5"]).withColumnRenamed("orig_md5", "_key")
        r = registry.withColumn("_key", F.col("orig_md5"))
    else:
        found = texts.withColumn("_key", key(F.col("path"))).dropDuplicates(["_key"])
        r = registry.withColumn("_key", key(F.col("original_url")))
    found = found.withColumn("_found", F.lit(True))
    if "content" in texts.columns and "text" not in texts.columns:
        from wordtally.sources.files import to_text

        # converted per registry row, so that rows sharing a file keep their own selector
        files = found.select("_key", "path", F.col("file_type").alias("_type"), "content", "_found")
        j = r.drop("file_type").join(files, "_key", "left").withColumnRenamed("_type", "file_type")
        r = to_text(j, keep=[c for c in j.columns if c not in ("content", "path", "file_type")])
    else:
        r = r.join(found.select("_key", "text", "error", "_found"), "_key", "left")
    status = (
        F.when(F.col("_found").isNull(), "missing file")
        .when(F.col("text").isNull(), "unsupported file type")
        .otherwise("tokenized")
    )
    cols = [c for c in registry.columns]
    out = r.select(
        *cols,
        status.alias("status"),
        T.sentence_count("text").alias("sentences"),
        T.words("text").alias("words"),
        *([T.sentence_words("text").alias("text_tokenized")] if keep_sentences else []),
    ).withColumn("tokens", F.size("words"))
    return out


def untokenized(registry: DataFrame, tokenized_ids: DataFrame, symbols: tuple[str, ...] = ()) -> DataFrame:
    """registry rows with no tokenization yet (anti join), optional symbol list."""
    rows = registry.join(tokenized_ids.select("id"), "id", "left_anti")
    return rows.where(F.col("symbol").isin(list(symbols))) if symbols else rows


def drop_tokenizations(registry: DataFrame, tokenized: DataFrame, symbols: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """F3 + J10: drop the tokenized rows of the selection and null the
    registry keys that pointed at them. Returns (tokenized kept, registry)."""
    sel = F.col("symbol").isin(list(symbols)) if symbols else F.lit(True)
    dropped = tokenized.where(sel).select(F.col("tokenization_id").alias("_dropped"))
    kept = tokenized.where(~sel)
    reg = registry.join(dropped, registry.tokenization_id == dropped._dropped, "left").withColumn(
        "tokenization_id", F.when(F.col("_dropped").isNotNull(), F.lit(None).cast("long")).otherwise(F.col("tokenization_id"))
    ).drop("_dropped")
    return kept, reg
