"""Registry queries (prepare stage): S3-S5, K8, K10, K11, F1-F3, F12, F13,
G1, G2, G18, G19, J1, J2, J5, J6, J10, W5, W6, X1, X17.

The driver documents arrive as two import batches split by date (before and
from 2010-02-15); a document's path is ``docs/<symbol>/<id>.txt``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wordtally.functions import cells as C
from wordtally.functions import text as T
from wordtally.operators import registry as R
from wordtally.plans import query
from wordtally.plans import sql as S
from wordtally.sources import manifest as M
from wordtally.operators.ranking import join_groups
from wordtally.session import ensure_checkpoint_dir, reliable_checkpoint
from wordtally.sources.tables import announcements, doc_texts, read_table

SPLIT = "2010-02-15"
SYMBOLS = ("src1", "src2", "src3")
SEL_START, SEL_END, SEL_SYMBOLS, SEL_MIN = "2010-01-15", "2010-03-01", tuple(f"src{i}" for i in range(1, 10)), 2


def doc_path(symbol, id_):
    return F.concat(F.lit("docs/"), symbol, F.lit("/"), id_.cast("string"), F.lit(".txt"))


def manifest_rows(spark, sf_dir):
    """One announcement per document, in arrival order ``seq``."""
    ann = announcements(spark, sf_dir)
    return ann.select(
        "id", "seq", "symbol", "associated_date", "class_label", "error_cost", "success_gain",
        doc_path(F.col("symbol"), F.col("id")).alias("original_url"),
    )


def scanned_files(spark, sf_dir):
    ann = announcements(spark, sf_dir)
    return ann.select(doc_path(F.col("symbol"), F.col("id")).alias("path"), "orig_md5")


def batches(spark, sf_dir, store_content=True):
    inc = R.incoming_rows(manifest_rows(spark, sf_dir), scanned_files(spark, sf_dir), store_content)
    first = F.col("associated_date") < F.lit(SPLIT).cast("date")
    return inc.where(first), inc.where(~first)


# SQL pieces ----------------------------------------------------------------
INC = f"""inc AS (
  SELECT id, seq, symbol, associated_date, class_label, error_cost, success_gain,
         'docs/' || symbol || '/' || CAST(id AS VARCHAR) || '.txt' AS original_url, orig_md5,
         'txt' AS file_type,
         'store/' || substr(orig_md5, 1, 1) || '/' || substr(orig_md5, 2, 1) || '/' || orig_md5 || '.txt' AS path_saved,
         true AS use_saved,
         associated_date < DATE '{SPLIT}' AS batch1,
         CASE WHEN associated_date < DATE '{SPLIT}' THEN 0 ELSE 1 END * 1099511627776 + seq AS ord
  FROM ann)"""


def _reg_sql(rows: str, modify: bool) -> str:
    pick = "arg_max" if modify else "arg_min"
    return f"""SELECT arg_min(id, ord) AS id, arg_min(seq, ord) AS seq, orig_md5,
        {pick}(symbol, ord) AS symbol, {pick}(associated_date, ord) AS associated_date,
        {pick}(class_label, ord) AS class_label, {pick}(error_cost, ord) AS error_cost,
        {pick}(success_gain, ord) AS success_gain, {pick}(original_url, ord) AS original_url,
        arg_min(path_saved, ord) AS path_saved, arg_min(file_type, ord) AS file_type, arg_min(use_saved, ord) AS use_saved
      FROM {rows} GROUP BY orig_md5"""


REG_COLS = "id, seq, orig_md5, symbol, associated_date, class_label, error_cost, success_gain, original_url, path_saved, file_type, use_saved"


# ------------------------------------------------------------ manifests
@query(
    "manifest_generate",
    S.with_ctes(
        S.ANN,
        "f AS (SELECT 'corpus/' || class_label || '/' || lpad(CAST(id AS VARCHAR), 6, '0') || '.txt' AS path FROM ann)",
        "l AS (SELECT path, CASE WHEN contains(path, 'neg') THEN 'neg' ELSE 'pos' END AS class_label FROM f)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY path) - 1 AS rn FROM l)",
    )
    + """SELECT CASE WHEN rn < 100 THEN 'MOVIE_SHORT' ELSE 'MOVIE' END AS code,
       strftime(CASE WHEN class_label = 'neg' THEN DATE '1990-01-01' ELSE DATE '1990-01-02' END
                + CAST(2 * (rn + 1) AS INTEGER), '%d.%m.%Y') AS date,
       class_label, '1' AS error_cost, '1' AS success_gain, path FROM r""",
)
def manifest_generate(spark, sf_dir):
    """Demo manifest over the document files."""
    ann = announcements(spark, sf_dir)
    files = ann.select(
        F.concat(F.lit("corpus/"), F.col("class_label"), F.lit("/"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".txt")).alias("path")
    )
    return M.generate_demo(files)


def _wide(spark, sf_dir):
    """Wide manifest rows: up to three paths per (symbol, date, label, cost) row."""
    from wordtally.operators.ranking import dense_index

    rows = manifest_rows(spark, sf_dir)
    keys = ["symbol", "associated_date", "class_label", "error_cost"]
    ranked = dense_index(rows, [F.col("id").asc()], group=keys, idx_col="rn")
    ranked = ranked.withColumn("bucket", F.floor(F.col("rn") / 3)).withColumn("slot", F.pmod("rn", F.lit(3)))
    wide = ranked.groupBy(*keys, "bucket").agg(
        *[F.coalesce(F.max(F.when(F.col("slot") == i, F.col("original_url"))), F.lit("")).alias(f"path{i}") for i in range(3)]
    )
    return wide.select(
        F.col("symbol").alias("code"),
        F.date_format("associated_date", "dd.MM.yyyy").alias("date"),
        "class_label",
        "error_cost",
        F.lit(1.0).alias("success_gain"),
        "bucket",
        "path0",
        "path1",
        "path2",
    )


_WIDE_SQL = [
    S.ANN,
    """mr AS (SELECT id, symbol, associated_date, class_label, error_cost,
                'docs/' || symbol || '/' || CAST(id AS VARCHAR) || '.txt' AS original_url FROM ann)""",
    """rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, associated_date, class_label, error_cost ORDER BY id) - 1 AS rn
             FROM mr)""",
    """wide AS (SELECT symbol AS code, strftime(associated_date, '%d.%m.%Y') AS date, class_label, error_cost,
               1.0::DOUBLE AS success_gain, rn // 3 AS bucket,
               coalesce(max(CASE WHEN rn % 3 = 0 THEN original_url END), '') AS path0,
               coalesce(max(CASE WHEN rn % 3 = 1 THEN original_url END), '') AS path1,
               coalesce(max(CASE WHEN rn % 3 = 2 THEN original_url END), '') AS path2
             FROM rk GROUP BY symbol, associated_date, class_label, error_cost, rn // 3)""",
    """unp AS (SELECT code, date, class_label, error_cost, success_gain, 0 AS slot, path0 AS path FROM wide WHERE path0 <> ''
             UNION ALL SELECT code, date, class_label, error_cost, success_gain, 1, path1 FROM wide WHERE path1 <> ''
             UNION ALL SELECT code, date, class_label, error_cost, success_gain, 2, path2 FROM wide WHERE path2 <> '')""",
]


@query(
    "manifest_unpivot",
    S.with_ctes(*_WIDE_SQL) + "SELECT code, date, class_label, error_cost, success_gain, CAST(slot AS INTEGER) AS slot, path FROM unp",
)
def manifest_unpivot(spark, sf_dir):
    """S3: one announcement per non-empty path cell of the wide rows."""
    return M.unpivot(_wide(spark, sf_dir)).drop("bucket")


@query("manifest_check", S.with_ctes(*_WIDE_SQL) + "SELECT code, count(*) AS announcements FROM unp GROUP BY code")
def manifest_check(spark, sf_dir):
    """count the announcements of each manifest (one per symbol), change nothing."""
    return M.check_counts(_wide(spark, sf_dir), by="code")


@query(
    "file_type",
    f"""WITH p AS (SELECT url AS path FROM pages UNION ALL
              SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' FROM documents),
e AS (SELECT path, lower(regexp_extract(trim(path), '^.+\\.(.+)$', 1)) AS ext FROM p)
SELECT path, ext AS extension,
       CASE WHEN ext IN ('txt', 'text') THEN 'txt' WHEN ext IN ('htm', 'html') THEN 'html' WHEN ext = 'pdf' THEN 'pdf'
            ELSE 'unknown' END AS file_type FROM e""",
)
def file_type(spark, sf_dir):
    """Extension after the last dot -> txt, html, pdf or unknown."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    docs = read_table(spark, sf_dir, "documents").select(doc_path(F.col("source"), F.col("doc_id")).alias("path"))
    p = pages.unionByName(docs)
    return p.select("path", C.extension(F.col("path")).alias("extension"), C.file_type(F.col("path")).alias("file_type"))


_NUM_SQL = r"^[\t\n\x0B\f\r ]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))[\t\n\x0B\f\r ]*$"


@query(
    "cell_typing",
    f"""WITH c AS (
  SELECT o_orderkey, 'date' AS field, strftime(o_orderdate, '%d.%m.%Y') AS cell FROM orders UNION ALL
  SELECT o_orderkey, 'price', printf('%.2f', o_totalprice) FROM orders UNION ALL
  SELECT o_orderkey, 'customer', ' ' || CAST(o_custkey AS VARCHAR) FROM orders UNION ALL
  SELECT o_orderkey, 'status', ' ' || o_orderstatus || ' ' FROM orders UNION ALL
  SELECT o_orderkey, 'priority', o_orderpriority FROM orders),
t AS (SELECT *, CASE WHEN regexp_full_match(cell, '[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{4}}')
                     THEN CAST(try_strptime(cell, '%d.%m.%Y') AS DATE) END AS as_date FROM c)
SELECT o_orderkey, field, cell,
       CASE WHEN as_date IS NOT NULL THEN 'date' WHEN regexp_matches(cell, '{_NUM_SQL}') THEN 'number' ELSE 'text' END AS kind,
       as_date,
       CASE WHEN as_date IS NULL AND regexp_matches(cell, '{_NUM_SQL}') THEN TRY_CAST(trim(cell) AS DOUBLE) END AS as_number,
       CASE WHEN as_date IS NULL AND NOT regexp_matches(cell, '{_NUM_SQL}')
            THEN regexp_replace(cell, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') END AS as_text
FROM t""",
)
def cell_typing(spark, sf_dir):
    """Date d.m.Y, else number (nan stays text), else the stripped string."""
    o = read_table(spark, sf_dir, "orders")
    c = (
        o.select("o_orderkey", F.lit("date").alias("field"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("cell"))
        .unionByName(o.select("o_orderkey", F.lit("price").alias("field"), F.format_string("%.2f", "o_totalprice").alias("cell")))
        .unionByName(
            o.select("o_orderkey", F.lit("customer").alias("field"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("cell"))
        )
        .unionByName(
            o.select("o_orderkey", F.lit("status").alias("field"), F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("cell"))
        )
        .unionByName(o.select("o_orderkey", F.lit("priority").alias("field"), F.col("o_orderpriority").alias("cell")))
    )
    cell = F.col("cell")
    kind = C.cell_kind(cell)
    return c.select(
        "o_orderkey", "field", "cell", kind.alias("kind"), C.cell_date(cell).alias("as_date"),
        C.cell_number(cell).alias("as_number"), F.when(kind == "text", C.cell_text(cell)).alias("as_text"),
    )


# ------------------------------------------------------------- registry
@query(
    "content_dedup",
    S.with_ctes(S.ANN)
    + "SELECT orig_md5, count(*) AS copies, arg_min(id, seq) AS first_id FROM ann GROUP BY orig_md5 HAVING count(*) > 1",
)
def content_dedup(spark, sf_dir):
    """Content hashes held by more than one document."""
    ann = announcements(spark, sf_dir)
    g = ann.groupBy("orig_md5").agg(F.count(F.lit(1)).alias("copies"), F.min_by("id", "seq").alias("first_id"))
    return g.where(F.col("copies") > 1)


def _registry(spark, sf_dir, modify: bool):
    b1, b2 = batches(spark, sf_dir)
    reg1 = R.upsert(None, b1, modify=modify)
    return reg1, R.upsert(reg1, b2, modify=modify), b2


def _stored_registry(spark, sf_dir):
    """The registry without modify, written once for steps that read it several times."""
    return reliable_checkpoint(_registry(spark, sf_dir, False)[1])


@query("registry_buckets", S.with_ctes(S.ANN, INC) + f"SELECT {REG_COLS} FROM ({_reg_sql('inc', True)})")
def registry_buckets(spark, sf_dir):
    """G2 kept incrementally: both batches imported into a registry in hash buckets, with modify."""
    path = f"{ensure_checkpoint_dir(spark)}/registry/{uuid.uuid4().hex}"
    for batch in batches(spark, sf_dir):
        reg = R.import_batch(spark, path, batch, modify=True, buckets=32)
    return reg.select(*[c.strip() for c in REG_COLS.split(",")])


@query("import_upsert", S.with_ctes(S.ANN, INC) + f"SELECT {REG_COLS} FROM ({_reg_sql('inc', True)})")
def import_upsert(spark, sf_dir):
    """G2 + J1 + K8: two import batches with modify: the first row of a hash
    fixes the stored copy, the last one the labels and url."""
    _, reg, _ = _registry(spark, sf_dir, True)
    return reg.select(*[c.strip() for c in REG_COLS.split(",")])


@query("import_upsert_keep", S.with_ctes(S.ANN, INC) + f"SELECT {REG_COLS} FROM ({_reg_sql('inc', False)})")
def import_upsert_keep(spark, sf_dir):
    """G2 without modify: later copies are skipped entirely."""
    _, reg, _ = _registry(spark, sf_dir, False)
    return reg.select(*[c.strip() for c in REG_COLS.split(",")])


@query(
    "import_status",
    S.with_ctes(
        S.ANN,
        INC,
        "b2 AS (SELECT * FROM inc WHERE NOT batch1)",
        "known AS (SELECT DISTINCT orig_md5 FROM inc WHERE batch1)",
        "firsts AS (SELECT orig_md5, min(seq) AS first_seq FROM b2 GROUP BY orig_md5)",
    )
    + """SELECT b.seq, b.original_url, b.orig_md5,
       CASE WHEN b.orig_md5 IS NULL THEN 'missing'
            WHEN k.orig_md5 IS NULL AND b.seq = f.first_seq THEN 'inserted' ELSE 'skipped' END AS status
FROM b2 b LEFT JOIN firsts f ON f.orig_md5 = b.orig_md5 LEFT JOIN known k ON k.orig_md5 = b.orig_md5""",
)
def import_status(spark, sf_dir):
    """K11 + F13: outcome of each row of the second batch (no modify)."""
    b1, b2 = batches(spark, sf_dir)
    return R.import_status(R.upsert(None, b1), b2, modify=False)


def _label_rows(spark, sf_dir):
    ann = announcements(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels")
    return lab.join(ann.select("id", "symbol"), lab.doc_id == ann.id).select(
        doc_path(F.col("symbol"), F.col("doc_id")).alias("path"),
        F.when(F.col("toxic") == 1, "neg").otherwise("pos").alias("class_label"),
        (F.lit(1.0) + F.col("quality")).cast("double").alias("error_cost"),
        F.lit(2.0).alias("success_gain"),
        F.col("doc_id").alias("seq"),
    )


_LABEL_SQL = [
    S.ANN,
    INC,
    f"reg AS ({_reg_sql('inc', False)})",
    """lab AS (SELECT 'docs/' || a.symbol || '/' || CAST(l.doc_id AS VARCHAR) || '.txt' AS path,
              CASE WHEN l.toxic = 1 THEN 'neg' ELSE 'pos' END AS class_label, CAST(1 + l.quality AS DOUBLE) AS error_cost,
              2.0::DOUBLE AS success_gain, l.doc_id AS seq FROM labels l JOIN ann a ON a.id = l.doc_id)""",
    """lastlab AS (SELECT path, arg_max(class_label, seq) AS class_label, arg_max(error_cost, seq) AS error_cost,
                  arg_max(success_gain, seq) AS success_gain FROM lab GROUP BY path)""",
    "firstreg AS (SELECT original_url, min(id) AS id FROM reg GROUP BY original_url)",
    "hit AS (SELECT f.id, l.* FROM firstreg f JOIN lastlab l ON l.path = f.original_url)",
]


@query(
    "label_update",
    S.with_ctes(*_LABEL_SQL)
    + """SELECT r.id, r.original_url, coalesce(h.class_label, r.class_label) AS class_label,
       coalesce(h.error_cost, r.error_cost) AS error_cost, coalesce(h.success_gain, r.success_gain) AS success_gain,
       h.id IS NOT NULL AS relabelled
FROM reg r LEFT JOIN hit h ON h.id = r.id""",
)
def label_update(spark, sf_dir):
    """J2 + W6 + J5: relabel registry rows by original path (first match), the
    tokenized view reads labels from the registry (Q3)."""
    _, reg, _ = _registry(spark, sf_dir, False)
    out = R.label_update(reg, _label_rows(spark, sf_dir))
    return out.select("id", "original_url", "class_label", "error_cost", "success_gain", "relabelled")


@query(
    "registry_tokenization",
    S.with_ctes(
        *_LABEL_SQL,
        f"""rt AS (SELECT r.*, {S.sentence_count('a.text')} AS sentences, CAST(len({S.words('a.text')}) AS INTEGER) AS tokens
           FROM reg r JOIN ann a ON a.id = r.id)""",
        """lt AS (SELECT r.* REPLACE (coalesce(h.class_label, r.class_label) AS class_label, coalesce(h.error_cost, r.error_cost) AS error_cost,
              coalesce(h.success_gain, r.success_gain) AS success_gain) FROM rt r LEFT JOIN hit h ON h.id = r.id)""",
        """mg AS (SELECT min(id) AS tokenization_id, symbol, associated_date, arg_max(class_label, seq) AS class_label,
              CAST(sum(sentences) AS BIGINT) AS sentences, count(*) AS parts FROM lt GROUP BY symbol, associated_date)""",
    )
    + """SELECT l.id, l.class_label, m.tokenization_id, m.class_label AS merged_label, m.sentences, m.parts
FROM lt l JOIN mg m ON m.symbol IS NOT DISTINCT FROM l.symbol AND m.associated_date = l.associated_date""",
)
def registry_tokenization(spark, sf_dir):
    """Every relabelled registry row with the tokenization it belongs to, which reads its label from the registry (Q3)."""
    reg = R.label_update(_stored_registry(spark, sf_dir), _label_rows(spark, sf_dir))
    rows = reliable_checkpoint(_reg_tokenized(reg, spark, sf_dir))
    tok = R.merge_tokenized(rows).withColumnRenamed("class_label", "merged_label")
    return join_groups(rows.select("id", "class_label", *R.merge_key()), tok, R.merge_key()).select(
        "id", "class_label", "tokenization_id", "merged_label", "sentences", "parts"
    )


@query(
    "label_status",
    S.with_ctes(*_LABEL_SQL)
    + """SELECT l.seq, l.path, CASE WHEN r.original_url IS NOT NULL THEN 'modified' ELSE 'no such record' END AS status
FROM lab l LEFT JOIN (SELECT DISTINCT original_url FROM reg) r ON r.original_url = l.path""",
)
def label_status(spark, sf_dir):
    """K11 for label rows: copies whose path is not in the registry have no record."""
    _, reg, _ = _registry(spark, sf_dir, False)
    return R.label_status(reg, _label_rows(spark, sf_dir))


@query(
    "scan_docs",
    S.with_ctes(S.ANN) + "SELECT id, symbol, associated_date, class_label, orig_md5 FROM ann",
)
def scan_docs(spark, sf_dir):
    """Registry scan (lazy; only the projected columns are read)."""
    ann = announcements(spark, sf_dir)
    return ann.select("id", "symbol", "associated_date", "class_label", "orig_md5")


@query(
    "select_docs",
    S.with_ctes(S.ANN, S.TOK)
    + f"""SELECT id, symbol, associated_date, class_label, sentences FROM tok
WHERE associated_date BETWEEN DATE '{SEL_START}' AND DATE '{SEL_END}' AND sentences >= {SEL_MIN}
  AND class_label IN ('pos', 'neg') AND symbol IN ({", ".join(S.q(s) for s in SEL_SYMBOLS)})""",
)
def select_docs(spark, sf_dir):
    """F1 + G18: date between (inclusive), sentences, label, symbol list."""
    from wordtally.sources.tables import tokenized

    tok = tokenized(announcements(spark, sf_dir))
    sel = R.select_docs(tok, SEL_START, SEL_END, SEL_SYMBOLS, SEL_MIN)
    return sel.select("id", "symbol", "associated_date", "class_label", "sentences")


def _reg_tokenized(reg, spark, sf_dir):
    """Tokenized rows of registry documents (text looked up by id)."""
    # counted where the text is read; only the two counts are joined
    counts = doc_texts(spark, sf_dir).select("id", T.sentence_count("text").alias("sentences"), F.size(T.words("text")).alias("tokens"))
    return reg.join(counts, "id").select(
        "id", "seq", "symbol", "associated_date", "class_label", "error_cost", "success_gain", "sentences", "tokens"
    )


_REG_TOK_SQL = [
    S.ANN,
    INC,
    f"reg AS ({_reg_sql('inc', False)})",
    f"""rt AS (SELECT r.id, r.seq, r.symbol, r.associated_date, r.class_label, r.error_cost, r.success_gain,
              {S.sentence_count('a.text')} AS sentences, CAST(len({S.words('a.text')}) AS INTEGER) AS tokens
           FROM reg r JOIN ann a ON a.id = r.id)""",
]


def _merge_sql(src: str) -> str:
    return f"""SELECT min(id) AS tokenization_id, symbol, associated_date, arg_max(class_label, seq) AS class_label,
       arg_max(error_cost, seq) AS error_cost, arg_max(success_gain, seq) AS success_gain,
       CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS parts
FROM {src} GROUP BY symbol, associated_date"""


@query("merge_tokenized", S.with_ctes(*_REG_TOK_SQL) + _merge_sql("rt"))
def merge_tokenized(spark, sf_dir):
    """One tokenized row per (symbol, date) over the deduplicated
    registry (Q4: each document counts once)."""
    _, reg, _ = _registry(spark, sf_dir, False)
    return R.merge_tokenized(_reg_tokenized(reg, spark, sf_dir))


@query(
    "merge_parts",
    S.with_ctes(*_REG_TOK_SQL)
    + """SELECT symbol, associated_date, id, seq,
       row_number() OVER (PARTITION BY symbol, associated_date ORDER BY seq DESC) - 1 AS part_no FROM rt""",
)
def merge_parts(spark, sf_dir):
    """G1: order of the merged text, newest document first."""
    _, reg, _ = _registry(spark, sf_dir, False)
    return R.merge_parts(_reg_tokenized(reg, spark, sf_dir))


@query(
    "untokenized",
    S.with_ctes(*_REG_TOK_SQL[:3])
    + f"""SELECT id, symbol, associated_date FROM reg
WHERE id NOT IN (SELECT id FROM reg WHERE associated_date < DATE '{SPLIT}')
  AND symbol IN ({", ".join(S.q(s) for s in SYMBOLS)})""",
)
def untokenized(spark, sf_dir):
    """registry rows of the symbol list not tokenized yet (the first batch was)."""
    reg = _stored_registry(spark, sf_dir)
    done = reg.where(F.col("associated_date") < F.lit(SPLIT).cast("date")).select("id")
    return R.untokenized(reg, done, SYMBOLS).select("id", "symbol", "associated_date")


@query(
    "retokenize",
    S.with_ctes(
        *_REG_TOK_SQL,
        f"old AS ({_merge_sql(f'(SELECT * FROM rt WHERE associated_date < DATE {S.q(SPLIT)})')})",
        f"new AS ({_merge_sql(f'(SELECT * FROM rt WHERE symbol IN ({chr(44).join(S.q(s) for s in SYMBOLS)}))')})",
    )
    + f"""SELECT tokenization_id, symbol, associated_date, sentences, tokens, parts FROM old
WHERE symbol NOT IN ({", ".join(S.q(s) for s in SYMBOLS)})
UNION ALL SELECT tokenization_id, symbol, associated_date, sentences, tokens, parts FROM new""",
)
def retokenize(spark, sf_dir):
    """F3 + J10: force a new tokenization of the symbol list: its old merged
    rows are dropped (registry keys nulled), then rebuilt from all its
    registry rows; other symbols keep their first-batch rows."""
    reg = _stored_registry(spark, sf_dir)
    rt = reliable_checkpoint(_reg_tokenized(reg, spark, sf_dir))
    old = R.merge_tokenized(rt.where(F.col("associated_date") < F.lit(SPLIT).cast("date")))
    reg_keys = reg.join(
        old.select("tokenization_id", *R.merge_key()), R.merge_key(), "left"
    )
    kept, _reg_after = R.drop_tokenizations(reg_keys, old, SYMBOLS)
    new = R.merge_tokenized(rt.where(F.col("symbol").isin(list(SYMBOLS))))
    cols = ["tokenization_id", "symbol", "associated_date", "sentences", "tokens", "parts"]
    return kept.select(*cols).unionByName(new.select(*cols))
